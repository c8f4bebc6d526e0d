"""Mapping freely typed values to the entries of a reference list.

Each value is cleaned of its decoration (markup, entities, wrongly decoded
letters, brackets, the label itself) and goes through two stages:

1. An Aho-Corasick automaton over the canonical names and their aliases (names
   without accents, without joining words, written together) finds the mentions
   embedded in the value; of overlapping mentions the longest wins. A mention
   decides if nothing but joining words, numbers and the label is left over.
2. The remaining values are compared as sets of words: every word must be a
   spelling of one word of the entry (edits within a bound set by its length,
   abbreviation, cut end, plural), in any order, and the other way round. A word
   that is itself another word of the reference vocabulary is no spelling.
   The cheapest entry wins; the label decides between entries.

Near words are found by counts of letters, which no edit changes by more than
one each way: one array operation over the vocabulary leaves the few words whose
edit distance is then computed.

There is no shuffle: values are matched where they are read, and each task
remembers the values it has seen. The reference is broadcast in blocks of about
``BLOCK`` entries, those with the same letters together; a larger list is worked
through block by block, and the best entry of all blocks is taken. Every block
knows the words and labels of the whole list, so the answer doesn't depend on
the blocks; the words of a list must number ``VOCABULARY`` at most.
"""

from __future__ import annotations

import html
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.runtime import cut, spread

BLOCK, VOCABULARY = 50_000, 1_000_000
MEMO = 300_000

# Words that join others in a name; a value may leave them out or add them.
JOINING = frozenset("a al and da de del des di do du el for in la las le les los of on the und van von y et".split())

_TAG = regex.compile(r"<[^<>]*>")
_LOWERED = regex.compile(r"[ãâ](?=[\u0080-\u00bf])")
_NOTE = regex.compile(r"\[\s*\d*\s*\]|\((?:see also|see|sic|also)\)|\ba\.?k\.?a\.?(?=\s)|\bi\.e\.(?=\s)")
_ENTITY = regex.compile(r"&\w{2,6};")  # misspelt entities
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’]l(?!\p{L}))?\.?")
_MARKS = regex.compile(r"\p{M}+")


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.casefold())
    return s if s.isascii() else _MARKS.sub("", s)


def redecode(s: str) -> str:
    """Undo UTF-8 text that was read as a single-byte encoding."""
    s = _LOWERED.sub(lambda m: m.group().upper() if m.group() in "ãâ" else m.group(), s)
    if "Ã" in s or "Â" in s:
        for enc in ("cp1252", "latin-1"):
            try:
                return s.encode(enc).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
    return s


def clean(s: str) -> str:
    s = _ENTITY.sub(" ", redecode(html.unescape(s)))
    return _NOTE.sub(" ", fold(_TAG.sub(" ", s)))


def label_key(s: str | None) -> str:
    """Letters of an acronym: upper case, no dots, zero read as O, no plural s."""
    if not s:
        return ""
    s = "".join(c for c in redecode(html.unescape(s)) if c.isalnum()).replace("0", "O")
    return (s[:-1] if s.endswith("s") and s[:-1].isupper() else s).upper()


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions (each neighbouring swap counts once), or ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def name_words(name: str) -> tuple[list[str], list[str]]:
    """(all words of a name, those that don't just join others)."""
    words = [w.rstrip(".") for w in _WORD.findall(fold(name))]
    return words, [w for w in words if w not in JOINING] or words


class Bags:
    """Words by length with the counts of their letters in ``SIZE`` classes."""

    SIZE = 32

    def __init__(self, words):
        self.words = sorted(words, key=lambda w: (len(w), w))
        self.first = np.array([len(w) for w in self.words], np.int64)
        self.counts = np.zeros((len(self.words), self.SIZE), np.int16)
        if self.words:
            own = np.repeat(np.arange(len(self.words)), self.first)
            np.add.at(self.counts, (own, self._classes("".join(self.words))), 1)

    def _classes(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % self.SIZE

    def near(self, w: str, shortest: int, longest: int, most: int) -> list[str]:
        """All words of the given lengths within ``most`` edits of ``w``, and some more."""
        lo, hi = np.searchsorted(self.first, [shortest, longest + 1])
        gap = self.counts[lo:hi] - np.bincount(self._classes(w), minlength=self.SIZE).astype(np.int16)
        over = np.maximum(gap, 0).sum(1)
        return [self.words[lo + i] for i in np.flatnonzero(np.maximum(over, over - gap.sum(1)) <= most)]


class Matcher:
    """Finds the entry a value means. ``entries``: (ref_id, label, name).

    ``words`` and ``labels`` are those of the whole list where ``entries`` are a
    block of it.
    """

    def __init__(self, entries: list[tuple[int, str | None, str | None]], words=None, labels=None):
        import ahocorasick

        self.entries: list[tuple[int, str, list[str], list[str]]] = []
        self.postings: dict[str, set[int]] = defaultdict(set)
        self.names: dict[str, list[int]] = defaultdict(list)
        for ref_id, label, name in entries:
            if ref_id is None or not name:
                continue
            all_words, main = name_words(name)
            if not all_words:
                continue
            k = len(self.entries)
            self.entries.append((ref_id, label_key(label), all_words, main))
            for w in set(main):
                self.postings[w].add(k)
            for alias in {" ".join(all_words), " ".join(main), "".join(all_words)}:
                self.names[f" {alias} "].append(k)
        self.vocabulary = frozenset(self.postings if words is None else words)
        self.labels = frozenset(e[1] for e in self.entries if e[1]) if labels is None else frozenset(labels)
        self.longest = max(map(len, self.labels), default=0)
        self.labels -= {label_key(w) for w in self.vocabulary}
        self.most_words = max((len(e[3]) for e in self.entries), default=0)  # a value of more words is no entry
        self.automaton = ahocorasick.Automaton()
        for alias, ks in self.names.items():
            self.automaton.add_word(alias, (len(alias), tuple(ks)))
        if self.names:
            self.automaton.make_automaton()
        self.sorted = sorted(self.vocabulary)
        self.bags = Bags(self.vocabulary)
        self.beginnings = lru_cache(None)(self._beginnings)
        self.spellings = lru_cache(MEMO)(self._spellings)
        self.memo: dict[tuple[str | None, str], tuple[int, float]] = {}

    def _starting(self, w: str) -> list[str]:
        """The words of the vocabulary that begin with ``w``."""
        lo = hi = bisect_left(self.sorted, w)
        while hi < len(self.sorted) and self.sorted[hi].startswith(w):
            hi += 1
        return self.sorted[lo:hi]

    def _beginnings(self, n: int) -> Bags:
        """The first ``n`` letters of all longer words."""
        return Bags({x[:n] for x in self.vocabulary if len(x) >= n})

    def _spellings(self, token: str) -> tuple[tuple[str, float], ...]:
        """Reference words that ``token`` may be a spelling of, with a cost."""
        w = token.rstrip(".")
        if w in self.vocabulary:
            return ((w, 0.0),)
        for end, other in (("s", ""), ("es", ""), ("ies", "y")):
            if w.endswith(end) and w[: -len(end)] + other in self.vocabulary:
                return ((w[: -len(end)] + other, 0.1),)
        found: dict[str, float] = {}
        if len(w) >= 3 and token.endswith("."):
            found = dict.fromkeys(self._starting(w), 0.3)
            if not found and len(w) >= 4:
                heads = {h for n in range(len(w) - 1, len(w) + 2) for h in self.beginnings(n).near(w, n, n, 1) if edits(w, h, 1) <= 1}
                found = {x: 0.7 for h in heads for x in self._starting(h) if len(x) > len(w)}
            if found:
                return tuple(found.items())
        if w[-2:] in ("'l", "’l"):  # as in nat'l
            return tuple((x, 0.3) for x in self._starting(w[:-2]) if x.endswith("l"))
        if len(w) < 3:
            return ()
        near = set(self.bags.near(w, len(w) - 3, len(w) + 3, 3))
        if w.endswith("s"):
            near |= set(self.bags.near(w[:-1], len(w) - 3, len(w) + 3, 3))
        for x in near:
            most = 1 if len(x) < 4 else 2 if len(x) < 9 or w[0] != x[0] else 3
            d = edits(w, x, most)
            if d > most and w.endswith("s"):
                d = edits(w[:-1], x, most)
            if d <= most:
                found[x] = 0.4 * d
        if not found and len(w) >= 4:
            found = {x: 0.5 for x in self._starting(w) if len(x) > len(w) >= 0.55 * len(x)}
        if found:
            best = min(found.values())
            found = {x: c for x, c in found.items() if c <= best + 1e-9}
        return tuple(sorted(found.items()))

    def _split(self, token: str) -> list[tuple[str, str]]:
        """Two words that may have been written as one."""
        w = token.rstrip(".")
        if len(w) < 7 or w in self.vocabulary:
            return []
        out = []
        for i in range(2, len(w) - 1):
            a, b = w[:i], w[i:]
            if a in self.vocabulary and (b in JOINING or self.spellings(b)) or b in self.vocabulary and (a in JOINING or self.spellings(a)):
                out.append((a, b))
        return out

    def match(self, label: str | None, value: str) -> tuple[int, float]:
        """(ref_id, cost), or (-1, inf)."""
        key = (label, value)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[key] = self._match(label, value)
        return got

    def _match(self, label: str | None, value: str) -> tuple[int, float]:
        text = clean(value)
        known = label_key(label)
        tokens = _WORD.findall(text)
        if label and len(tokens) == 1 and tokens[0].isalnum() and len(_WORD.findall(clean(label))) > 1 or (
            label and label_key(value) and len(_WORD.findall(clean(label))) > 1 and len(label_key(value)) <= self.longest and len(tokens) >= 1
            and all(len(t.rstrip(".")) == 1 for t in tokens)
        ):
            known, text = label_key(value), clean(label)  # the two fields are interchanged
            tokens = _WORD.findall(text)
        if not known and len(tokens) > 1:
            # A label written with the value takes the place of a missing one.
            known = next((k for k in map(label_key, tokens) if k in self.labels), "")
        bare = [t for t in tokens if label_key(t) != known or t.rstrip(".") in self.vocabulary] if known else tokens
        found = self._mentions(bare, known)
        if found is not None:
            return found
        tries = [bare]
        if len(bare) > 1 and ":" in text and len(bare[0]) <= self.longest and bare[0] not in self.vocabulary:
            tries.append(bare[1:])
        best = (float("inf"), -1)
        for words in tries:
            words = [t for t in words if t.rstrip(".") not in JOINING and len(t.rstrip(".")) > 1] or words
            best = min(best, self._sets(words, known))
            for i, t in enumerate(words):
                for pair in self._split(t):
                    c, k = self._sets([*words[:i], *(x for x in pair if x not in JOINING), *words[i + 1 :]], known)
                    best = min(best, (c + 0.2, k))
        return (self.entries[best[1]][0], best[0]) if best[1] >= 0 else (-1, float("inf"))

    def _mentions(self, tokens: list[str], known: str) -> tuple[int, float] | None:
        """The entry whose name, embedded in the value, leaves nothing else over."""
        if not tokens or not self.names:
            return None
        text = " " + " ".join(t.rstrip(".") for t in tokens) + " "
        spans = sorted(((e - n + 1, e, ks) for e, (n, ks) in self.automaton.iter(text)), key=lambda x: (x[0] - x[1], x[0]))
        taken: list[tuple[int, int, tuple[int, ...]]] = []
        for s, e, ks in spans:
            if all(e <= a or s >= b for a, b, _ in taken):
                taken.append((s, e, ks))
        if not taken:
            return None
        s, e, ks = taken[0]
        rest = (text[:s] + " " + text[e:]).split()
        if any(w not in JOINING and not w.isdigit() and len(w) > 1 for w in rest):
            return None
        fit = [k for k in ks if not known or self.entries[k][1] == known]
        if len(fit) == 1:
            return self.entries[fit[0]][0], 0.0
        return (self.entries[ks[0]][0], 0.0) if len(ks) == 1 and not self._others(ks[0], known) else None

    def _others(self, k: int, known: str) -> bool:
        """Whether another entry has the same words and the given label."""
        main = sorted(self.entries[k][3])
        share = set.intersection(*(self.postings[w] for w in main))
        return any(self.entries[o][1] == known and sorted(self.entries[o][3]) == main for o in share if o != k)

    def _sets(self, words: list[str], known: str) -> tuple[float, int]:
        """Cheapest entry with a one-to-one assignment of all words: (cost, entry)."""
        if not words or len(words) > self.most_words:
            return float("inf"), -1
        options = [self.spellings(w) for w in words]
        if not all(options):
            return float("inf"), -1
        candidates: set[int] | None = None
        for o in options:
            here = set().union(*(self.postings.get(w, ()) for w, _ in o))
            candidates = here if candidates is None else candidates & here
        best = (float("inf"), -1)
        for k in candidates or ():
            _, label, names, main = self.entries[k]
            if len(main) != len(words):
                continue
            cost = _assign([dict(o) for o in options], main)
            if cost is None:
                continue
            if known and label != known:
                cost += 1.5
            order = [next((i for i, m in enumerate(main) if m in dict(o)), 0) for o in options]
            if order != sorted(order):
                cost += 0.2
            best = min(best, (cost, k))
        return best


def _assign(options: list[dict[str, float]], main: list[str]) -> float | None:
    """Least cost of giving every option one of the words, each word once; None if impossible."""
    if not options:
        return 0.0
    i = min(range(len(options)), key=lambda j: sum(m in options[j] for m in main))
    best = None
    for j, m in enumerate(main):
        c = options[i].get(m)
        if c is None or m in main[:j]:
            continue
        rest = _assign(options[:i] + options[i + 1 :], main[:j] + main[j + 1 :])
        if rest is not None and (best is None or c + rest < best):
            best = c + rest
    return best


def map_to_reference(
    values: DataFrame, reference: DataFrame, id_col: str = "def_id", label_col: str = "acronym", value_col: str = "acronym_expansion",
    ref_id: str = "ref_id", ref_label: str = "acronym", ref_name: str = "expansion",
) -> DataFrame:
    """``(id_col, ref_id)`` for every row whose value is neither null nor empty; -1 if it means no entry.

    Blank values and fillers give -1; a null label leaves the decision to the
    value; ties go to the entry with the row's label, then to the earlier entry
    of the reference; repeated rows give repeated rows; an empty reference gives
    -1 throughout; an empty table gives an empty table; other columns are ignored.
    """
    spark = values.sparkSession
    id_type = values.schema[id_col].dataType
    src = spread(
        values.where(F.col(value_col).isNotNull() & (F.col(value_col) != "")).select(
            F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(value_col).alias("value")
        )
    )
    ref = reference.select(F.col(ref_id).cast("long").alias("r"), F.col(ref_label).alias("l"), F.col(ref_name).alias("n")).where("r is not null")
    blocks = max(1, -(-ref.count() // BLOCK))
    words = labels = None
    if blocks > 1:
        words, labels = _whole_list(ref)
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ref_id", T.LongType())])
    if blocks == 1:
        shared = spark.sparkContext.broadcast([tuple(x) for x in ref.orderBy("r").collect()])

        def run(batches):
            m = Matcher(shared.value)
            for pdf in batches:
                yield pd.DataFrame({id_col: pdf["id"], "ref_id": [m.match(l, v)[0] for l, v in zip(pdf["label"], pdf["value"])]})

        return src.mapInPandas(run, schema)

    known = spark.sparkContext.broadcast((words, labels))
    # Entries that may be told apart only by their labels have the same letters and so the same block.
    letters = F.udf(lambda n: "".join(sorted("".join(name_words(n)[1]))) if n else "")
    ref = cut(ref.withColumn("b", F.pmod(F.xxhash64(letters("n")), F.lit(blocks))))
    carried = T.StructType([*src.schema.fields, T.StructField("best", T.LongType()), T.StructField("cost", T.DoubleType())])
    out = src.select("*", F.lit(-1).cast("long").alias("best"), F.lit(float("inf")).alias("cost"))
    for block in range(blocks):
        shared = spark.sparkContext.broadcast([tuple(x) for x in ref.where(F.col("b") == block).select("r", "l", "n").orderBy("r").collect()])

        def run(batches, shared=shared):
            m = Matcher(shared.value, *known.value)
            for pdf in batches:
                got = [m.match(l, v) for l, v in zip(pdf["label"], pdf["value"])]
                pick = [min((c, b < 0, b), (g[1], g[0] < 0, g[0])) for g, b, c in zip(got, pdf["best"], pdf["cost"])]
                yield pdf.assign(best=[x[2] for x in pick], cost=[x[0] for x in pick])

        out = cut(out.mapInPandas(run, carried))
    return out.select(F.col("id").alias(id_col), F.col("best").alias("ref_id"))


def _whole_list(ref: DataFrame) -> tuple[frozenset, frozenset]:
    """(words, labels) of the whole reference; a list of more than ``VOCABULARY`` words is refused."""

    def run(batches):
        for pdf in batches:
            rows = {("w", w) for n in pdf["n"] if n for w in name_words(n)[1]} | {("l", k) for l in pdf["l"] if (k := label_key(l))}
            yield pd.DataFrame(list(rows), columns=["k", "v"])

    rows = ref.mapInPandas(run, "k string, v string").distinct().limit(2 * VOCABULARY + 1).collect()
    if len(rows) > 2 * VOCABULARY:
        raise ValueError(f"the reference has more than {VOCABULARY} words and labels each can hold")
    return frozenset(r["v"] for r in rows if r["k"] == "w"), frozenset(r["v"] for r in rows if r["k"] == "l")
