"""Reading level of documents, from the vocabulary and length of their sentences.

Every sentence gets two scores. The first is its vocabulary: a regularised
linear model of hashed character n-grams and words, fitted for each language to
the levels of labelled samples together with a length term, so that its weights
carry what length doesn't explain. The second is its length, in words, or in
letters where words aren't spaced. A document has the means of both over its
sentences.

The scores of all documents of a language are then calibrated together: each
score has ``GRADES`` grades, a document's level is the sum of its two grades,
and a mixture with one normal component for each pair of grades is fitted by
expectation-maximisation to the counts of all documents in cells of the two
scores. Labelled samples, scored by models that haven't seen them, take part as
documents whose level is known. So the boundaries between levels lie where the
corpus has few documents, and a language with few documents rests on its samples.

The linear models are fitted on the driver on at most ``SAMPLES`` labelled rows
by conjugate gradients over sparse rows, so memory grows with their features
only. Scoring is one Arrow stage over all documents: a batch of texts becomes
one array of code points, rolling hashes over it index the weight tables, and
sums over sentence bounds give the scores.
"""

from __future__ import annotations

import html
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.sentences import (
    ANY_LATIN, CASED, KNOWN, MODEL_ROWS, Splitter, corpus_counts, language, learn_model, own_splitter, with_own_entries,
)
from glossa.runtime import cut, spread, stored

SAMPLES = 20_000
LEVELS, GRADES = 5, 3
LEAST_SENTENCES = 6
CHAR_BITS, WORD_BITS = 17, 16
CHAR_SLOTS, WORD_SLOTS = 1 << CHAR_BITS, 1 << WORD_BITS
CHAR_SIZES = (2, 3)
#: Code points scored at once.
BATCH_CHARS = 500_000
PENALTY, FOLDS = 0.2, 9
#: Mean square of the lexical features of a sample against those of its length.
LEXICAL_SCALE = 3.0
#: Cells of the two scores in which documents are counted: side and number of a score's cells.
CELL, CELLS = 0.05, 256
ROUNDS = 60
#: Languages whose words aren't spaced, so that length is counted in letters.
UNSPACED = ("zh", "ja", "th")

_TAG = regex.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_BREAK = regex.compile(r"</p>\s*|<br\s*/?>\s*", regex.I)


def unmarked(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", _BREAK.sub("\n\n", text))
    return html.unescape(text) if "&" in text else text


# A table from code points to 1 (letter or mark), 2 (digit), 0 (other), for the planes in use.
_KIND = np.zeros(0x110000, np.uint8)


def _kinds() -> np.ndarray:
    if not _KIND[97]:
        for c in range(0x30000):
            k = unicodedata.category(chr(c))
            _KIND[c] = 1 if k[0] in "LM" else 2 if k[0] == "N" else 0
    return _KIND


_B = np.uint32(0x9E3779B1)
_END = "\x1e"


@dataclass
class Features:
    """Hashed features of sentences: slots with the sentence they belong to, and counts."""

    char: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    word: tuple[np.ndarray, np.ndarray] = (np.array([], np.int64),) * 2
    letters: np.ndarray | None = None
    words: np.ndarray | None = None


def features(sentences: list[str]) -> Features:
    """Features of a list of sentences, computed over one array of code points."""
    n = len(sentences)
    text = unicodedata.normalize("NFC", _END.join(sentences).lower()) + _END
    if text.count(_END) != n:
        return features([s.replace(_END, " ") for s in sentences])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == ord(_END))
    owner = np.zeros(len(codes), np.int32)
    owner[ends[:-1] + 1] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    kind = _kinds()[codes]
    letter = kind == 1
    plain = np.where(letter, codes, np.where(kind == 2, np.uint32(48), np.uint32(32)))
    out = Features()
    for size in CHAR_SIZES:
        m = max(0, len(plain) - size + 1)
        h = np.full(m, size, np.uint32)
        ok = letter[:m].copy()
        for d in range(size):
            h *= np.uint32(0x01000193)
            h += plain[d : d + m]
            if 0 < d < size - 1:
                ok &= codes[d : d + m] != ord(_END)
        at = np.flatnonzero(ok)
        h = h[at] * np.uint32(0x9E3779B1)
        out.char.append(((h >> np.uint32(32 - CHAR_BITS)).astype(np.int32), owner[at]))
    starts = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    power = np.full(64, _B, np.uint32)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint32)
    # Words are hashed by letters from their start.
    offset = np.arange(len(codes), dtype=np.int32) - np.repeat(np.r_[0, starts].astype(np.int32), np.diff(np.r_[0, starts, len(codes)]))
    value = np.where(letter, plain * np.uint32(0x85EBCA6B) * power[np.minimum(offset, 63)], np.uint32(0))
    sums = np.add.reduceat(value, starts, dtype=np.uint32) if len(starts) else np.array([], np.uint32)
    sums = (sums ^ (sums >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    out.word = ((sums >> np.uint32(32 - WORD_BITS)).astype(np.int32), owner[starts])
    out.letters = np.bincount(owner[letter], minlength=n)
    out.words = np.bincount(owner[starts], minlength=n)
    return out


class _Rows:
    """Sparse rows of samples: shares of hashed features, centred and scaled."""

    def __init__(self, texts: list[list[str]]):
        size = len(CHAR_SIZES) * CHAR_SLOTS + WORD_SLOTS
        cols, vals, runs = [], [], []
        for sentences in texts:
            f = features(sentences)
            col, val = [], []
            for i, (slots, _) in enumerate([*f.char, f.word]):
                slot, n = np.unique(slots, return_counts=True)
                col.append(slot.astype(np.int32) + i * CHAR_SLOTS)
                val.append((n / max(1, len(slots))).astype(np.float32))
            cols.append(np.concatenate(col))
            vals.append(np.concatenate(val))
            runs.append(len(cols[-1]))
        self.n = len(texts)
        col, self.val = np.concatenate(cols), np.concatenate(vals)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), runs)
        # A feature of a single sample says nothing about the others.
        keep = np.bincount(col, minlength=size)[col] >= 2
        self.val, self.row = self.val[keep], self.row[keep]
        self.slots, self.col = np.unique(col[keep], return_inverse=True)
        self.mean = np.bincount(self.col, self.val, minlength=len(self.slots)) / self.n
        norm = (np.bincount(self.row, self.val**2, minlength=self.n)).mean() - (self.mean**2).sum()
        self.scale = float(np.sqrt(LEXICAL_SCALE / max(norm, 1e-9)))

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Every sample's centred, scaled features times ``w``."""
        return self.scale * (np.bincount(self.row, self.val * w[self.col], minlength=self.n) - self.mean @ w)

    def sums(self, r: np.ndarray) -> np.ndarray:
        """Sums over samples of their features times ``r``."""
        return self.scale * (np.bincount(self.col, self.val * r[self.row], minlength=len(self.slots)) - self.mean * r.sum())

    def fit(self, length: np.ndarray, y: np.ndarray, use: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """Ridge weights of the lexical features beside those of ``length``, by conjugate gradients on the samples ``use``."""
        k = len(self.slots)
        on = use.astype(float)
        centre = lambda v: on * (v - (on @ v) / on.sum())

        def normal(w):
            r = centre(self.dot(w[:k]) + length @ w[k:])
            return np.r_[self.sums(r), length.T @ r] + penalty * w

        target = centre(y)
        b = np.r_[self.sums(target), length.T @ target]
        w = np.zeros(k + length.shape[1])
        r, p = b.copy(), b.copy()
        rr = first = r @ r
        for _ in range(400):
            if rr <= 1e-10 * first:
                break
            q = normal(p)
            a = rr / (p @ q)
            w += a * p
            r -= a * q
            rr, old = r @ r, rr
            p = r + (rr / old) * p
        return w[:k]


@dataclass
class Scale:
    """The vocabulary weights of one language and its samples' scores by models that haven't seen them."""

    tables: list[np.ndarray]
    offset: float
    length: np.ndarray
    vocabulary: np.ndarray
    level: np.ndarray


class LevelModel:
    """Vocabulary models of all languages; ``fit`` trains them on (lang, level, sentences) samples."""

    def fit(self, samples: list[tuple[str, int, list[str]]]) -> LevelModel:
        self.words: dict[str, frozenset] = {}
        self.scales: dict[str, Scale] = {}
        langs = sorted({lang for lang, _, _ in samples})
        for lang in langs:
            self._learn(lang, [(v, ss) for l, v, ss in samples if l == lang])
        if KNOWN - set(langs):
            self._learn("", [(v, ss) for _, v, ss in samples])
        for lang in langs:
            if lang in CASED:
                self.words[lang] = frozenset(w for l, _, ss in samples if l == lang for s in ss for w in regex.findall(r"\p{L}+", s.lower()))
        return self

    def _learn(self, lang: str, samples: list[tuple[int, list[str]]]) -> None:
        y = np.array([v for v, _ in samples], float)
        rows = _Rows([ss for _, ss in samples])
        length = np.array([_lengths(features(ss), [lang] * len(ss)).mean() for _, ss in samples])
        z = (length - length.mean()) / (length.std() + 1e-3)
        basis = np.column_stack([z, np.tanh(3 * (z + 0.7)), np.tanh(3 * (z - 0.5))])
        n = len(samples)
        fold = np.empty(n, int)
        fold[np.argsort(y, kind="stable")] = np.arange(n) % FOLDS
        seen = np.zeros(n)
        for k in set(fold):
            use = fold != k
            if use.any():
                seen[~use] = rows.dot(rows.fit(basis, y, use))[~use]
        w = rows.fit(basis, y, np.ones(n, bool))
        flat = np.zeros(len(CHAR_SIZES) * CHAR_SLOTS + WORD_SLOTS, np.float32)
        flat[rows.slots] = rows.scale * w
        tables = [flat[i * CHAR_SLOTS : (i + 1) * CHAR_SLOTS] for i in range(len(CHAR_SIZES))] + [flat[len(CHAR_SIZES) * CHAR_SLOTS :]]
        self.scales[lang] = Scale(tables, -float(rows.scale * (rows.mean @ w)), length, seen, y.astype(int))

    def known(self, lang: str) -> str:
        return lang if lang in self.scales else ""

    def sentence_scores(self, texts: list[str], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vocabulary score, its weight, length) of each sentence; ``langs`` are keys of ``scales``."""
        n = len(texts)
        f = features(texts)
        score = np.zeros(n)
        keys = np.unique(langs)
        for key in keys:
            scale = self.scales[key]
            score[langs == key] = scale.offset
            for (slots, own), table in zip([*f.char, f.word], scale.tables):
                if len(keys) > 1:
                    mine = (langs == key)[own]
                    slots, own = slots[mine], own[mine]
                if len(own):
                    # Owners ascend, so a sentence's features are one run.
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    score[own[first]] += np.add.reduceat(table[slots], first) / np.diff(np.r_[first, len(own)])
        return score, np.maximum(f.letters, 1), _lengths(f, langs)

    def document_scores(self, texts: list[str], langs: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(mean vocabulary score by letters, mean length) of ``n`` documents from their sentences."""
        score, weight, length = self.sentence_scores(texts, langs)
        total = np.bincount(doc, weight, minlength=n)
        return np.bincount(doc, score * weight, minlength=n) / total, np.bincount(doc, length, minlength=n) / np.bincount(doc, minlength=n)

    def latin(self, text: str) -> str:
        """The Latin-script language whose words a text shares most."""
        words = set(regex.findall(r"\p{L}+", text.lower()))
        return max((l for l in CASED if l in self.words), key=lambda l: (len(words & self.words[l]), l), default=ANY_LATIN)


def _lengths(f: Features, langs) -> np.ndarray:
    return np.log1p(np.where(np.isin(langs, UNSPACED), f.letters, f.words))


#: Level of each pair of grades, (length, vocabulary), the latter changing fastest.
LEVEL_OF = np.add.outer(np.arange(GRADES), np.arange(GRADES)).ravel() + 1


class Calibration:
    """A normal component for each pair of grades, fitted to (length, vocabulary) points with counts."""

    def __init__(self, points: np.ndarray, counts: np.ndarray, known: np.ndarray, level: np.ndarray):
        x = np.vstack([points, known])
        n = np.r_[counts, np.ones(len(known))].astype(float)
        label = np.r_[np.zeros(len(points), int), level]
        at = (np.arange(GRADES) + 0.5) / GRADES
        q = [_quantiles(x[:, d], n, at) for d in (0, 1)]
        self.mean = np.array([(a, b) for a in q[0] for b in q[1]])
        gap = [max(np.diff(v).mean(), 0.05) for v in q]
        self.cov = np.repeat(np.diag([(g / 3) ** 2 for g in gap])[None], len(LEVEL_OF), 0)
        self.share = np.full(len(LEVEL_OF), 1 / len(LEVEL_OF))
        other = (label[:, None] > 0) & (LEVEL_OF[None] != label[:, None])
        least = np.diag([(g / 30) ** 2 for g in gap])
        for _ in range(ROUNDS):
            r = _normalised(np.where(other, -30.0, 0.0) + self._logs(x)) * n[:, None]
            size = r.sum(0)
            self.share = (size + 5) / (size.sum() + 5 * len(size))
            self.mean = (r.T @ x + 0.5 * self.mean) / (size + 0.5)[:, None]
            d = x[:, None] - self.mean[None]
            own = np.einsum("nk,nki,nkj->kij", r, d, d)
            # Small components borrow the spread that all have together.
            self.cov = (own + 10 * own.sum(0) / size.sum()) / (size + 10)[:, None, None] + least

    def _logs(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None] - self.mean[None]
        inside = np.einsum("nki,kij,nkj->nk", d, np.linalg.inv(self.cov), d)
        return np.log(self.share) - 0.5 * (inside + np.log(np.linalg.det(self.cov)))

    def levels(self, x: np.ndarray) -> np.ndarray:
        """The probability of each level for each (length, vocabulary) row."""
        r = _normalised(self._logs(x))
        return np.column_stack([r[:, LEVEL_OF == v].sum(1) for v in range(1, LEVELS + 1)])


def _normalised(logs: np.ndarray) -> np.ndarray:
    r = np.exp(logs - logs.max(1, keepdims=True))
    return r / r.sum(1, keepdims=True)


def _quantiles(x: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    below = np.cumsum(n[order]) - 0.5 * n[order]
    return np.interp(at * n.sum(), below, x[order])


def train_levels(rows, splitter_of) -> LevelModel:
    """The models of labelled rows (``lang, level, text`` and what ``splitter_of`` needs)."""
    data = []
    for r in rows:
        text = unmarked(r["text"])
        lang = language(r["lang"], text)
        parts = [text[a:b] for a, b in splitter_of(r).spans(text, lang)]
        if parts:
            data.append((lang, int(r["level"]), parts))
    if not data:
        raise ValueError("no labelled sample has a text and a level")
    return LevelModel().fit(data)


def _scored(src: DataFrame, shared) -> DataFrame:
    """``(id, key, length, vocabulary, sentences)`` of every document with sentences."""
    schema = T.StructType([
        src.schema["id"], T.StructField("key", T.StringType()), T.StructField("length", T.DoubleType()),
        T.StructField("vocabulary", T.DoubleType()), T.StructField("sentences", T.IntegerType()),
    ])

    def run(batches):
        entries, model, least = shared.value
        splitter = Splitter(entries) if entries is not None else None

        def score(rows):
            parts, own, langs = [], [], []
            for i, (_, lang, ss) in enumerate(rows):
                parts += ss
                own += [i] * len(ss)
                langs += [lang] * len(ss)
            vocabulary, length = model.document_scores(parts, np.array(langs), np.array(own, np.int64), len(rows))
            return pd.DataFrame({
                "id": [r[0] for r in rows], "key": [r[1] for r in rows], "length": length, "vocabulary": vocabulary,
                "sentences": [len(r[2]) for r in rows],
            })

        for pdf in batches:
            rows, chars = [], 0
            for key, text, lang, own in zip(pdf["id"], pdf["text"], pdf["lang"], pdf["own"] if splitter is None else [None] * len(pdf)):
                if not text:
                    continue
                text = unmarked(text)
                lang = language(lang, text)
                spans = (splitter or own_splitter(own)).spans(text, lang)
                if not spans or len(spans) < least:
                    continue
                if lang == ANY_LATIN:
                    lang = model.latin(text)
                rows.append((key, model.known(lang), [text[a:b] for a, b in spans]))
                chars += len(text)
                if chars > BATCH_CHARS:
                    yield score(rows)
                    rows, chars = [], 0
            if rows:
                yield score(rows)

    return src.mapInPandas(run, schema)


def calibrations(scores: DataFrame, model: LevelModel) -> dict[str, Calibration]:
    """The calibration of each language from counts of all its documents; at most ``CELLS`` squared cells a language come here."""
    cell = lambda c: F.greatest(F.lit(-CELLS // 2), F.least(F.lit(CELLS // 2 - 1), F.floor(F.col(c) / CELL)))
    cells = scores.groupBy("key", cell("length").alias("l"), cell("vocabulary").alias("v")).agg(F.count("*").alias("n")).toPandas()
    out = {}
    for key, scale in model.scales.items():
        own = cells[cells["key"] == key]
        points = (own[["l", "v"]].to_numpy(float) + 0.5) * CELL
        out[key] = Calibration(points, own["n"].to_numpy(), np.column_stack([scale.length, scale.vocabulary]), scale.level)
    return out


def reading_levels(
    docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST_SENTENCES
) -> DataFrame:
    """``(id_col, reading_level, confidence, expected, sentences)`` of every document of at least ``least`` sentences.

    Null, empty and shorter texts give no row; unknown languages are told from
    the script and, in Latin letters, from the words of the samples; a language
    without samples is scored by the samples of all languages together; ties go
    to the lower level; repeated rows give repeated rows; an empty table gives an
    empty table; without labelled samples a ValueError is raised.
    """
    spark = docs.sparkSession
    learned = cut(learn_model(corpus_counts(docs, text_col, lang_col, unmarked)))
    labelled = (
        samples.where(F.col("text").isNotNull() & F.col("reading_level").between(1, LEVELS))
        .select("lang", F.col("reading_level").alias("level"), "text").distinct().orderBy(F.xxhash64("text")).limit(SAMPLES)
    )
    src = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    entries = [tuple(r) for r in learned.limit(MODEL_ROWS + 1).collect()]
    if len(entries) <= MODEL_ROWS:
        every = Splitter(entries)
        model = train_levels(labelled.collect(), lambda r: every)
        shared = spark.sparkContext.broadcast((entries, model, least))
    else:
        # The sentence model is too large to send: every text gets the entries for its own words.
        model = train_levels(with_own_entries(labelled, learned).collect(), lambda r: own_splitter(r["own"]))
        shared = spark.sparkContext.broadcast((None, model, least))
        src = with_own_entries(src, learned)
    scores = stored(_scored(src, shared), "reading")
    fitted = spark.sparkContext.broadcast(calibrations(scores, model))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("reading_level", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()), T.StructField("expected", T.DoubleType()), T.StructField("sentences", T.IntegerType()),
    ])

    def judge(batches):
        for pdf in batches:
            x = pdf[["length", "vocabulary"]].to_numpy(float)
            d = np.zeros((len(pdf), LEVELS))
            for key in pdf["key"].unique():
                at = (pdf["key"] == key).to_numpy()
                d[at] = fitted.value[key].levels(x[at])
            yield pd.DataFrame({
                id_col: pdf["id"], "reading_level": d.argmax(1) + 1, "confidence": d.max(1),
                "expected": d @ np.arange(1, LEVELS + 1), "sentences": pdf["sentences"],
            })

    return scores.mapInPandas(judge, schema)
