"""Sentence boundaries, learned without labels for each language.

Two passes over the corpus. The first counts, for each language, how often each
word stands with and without a closing period and what follows it. From these
counts log-likelihood ratios give the language's abbreviations, the words that
start sentences, the collocations (a type with its period and the word or number
that follows it more often than by chance, so that the period between them ends
nothing), and, for Thai, the letters that end and begin sentences at white
space. An abbreviation may also end a sentence if its capitalised followers are
mostly sentence starters rather than names, as in a title before a surname. The
second pass classifies every period with these statistics: after an abbreviation,
an initial or a number a collocation continues the sentence, a starter begins
another, and the type's own flag decides the rest.

The counts are summed by Spark; only the learned model, which is small against
the corpus, is used on the executors. It is broadcast if it has at most
``MODEL_ROWS`` rows; beyond that each document is joined with just the entries
for the words it holds.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.runtime import spread

MODEL_ROWS = 200_000

#: Least log-likelihood ratios: abbreviation (after length and period factors),
#: sentence starter, collocation with a number and with a word (of which there
#: are many more to be tested), and Thai edge.
ABBR_LLR, START_LLR, NUMBER_LLR, PAIR_LLR, TH_LLR = 1.0, 25.0, 7.88, 25.0, 3.84
#: Last letters by which words too rare for a statistic of their own are judged before numbers.
TAIL = 3
#: Share of an abbreviation's followers that must be other than sentence
#: starters, and share of its capitalised followers from which it may end one.
ABBR_INSIDE, FINAL_SHARE = 0.08, 0.5
#: Letters of a Thai sentence's end and beginning that are counted, longest first.
TH_EDGES = (5, 3)

CASED = ("en", "fr", "es", "de")
KNOWN = frozenset((*CASED, "zh", "ja", "ar", "hi", "th"))
#: The key of texts in Latin letters whose language isn't given.
ANY_LATIN = "xx"

_SCRIPTS = (
    ("th", regex.compile(r"\p{Thai}")),
    ("hi", regex.compile(r"\p{Devanagari}")),
    ("ar", regex.compile(r"\p{Arabic}")),
    ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")),
    ("zh", regex.compile(r"\p{Han}")),
)
_LETTERS = regex.compile(r"\p{L}")


def language(lang: str | None, text: str) -> str:
    """The given language if it is known, else one told from the letters."""
    lang = (lang or "").strip().lower()[:2]
    if lang in KNOWN:
        return lang
    n = max(1, len(_LETTERS.findall(text)))
    for name, pattern in _SCRIPTS:
        if len(pattern.findall(text)) > 0.2 * n:
            return name
    return ANY_LATIN


OPEN = "\"'“„«‹「『（([{¿¡‘"
CLOSE = "\"'”“»›」』）)]}’"
_BLOCK = regex.compile(r"(?:\r\n?|\n)[^\S\n\r]*(?:\r\n?|\n)\s*")
_TOKEN = regex.compile(r"\S+")
_ACR = regex.compile(r"(?:\p{Lu}\.){2,}")
_INITIAL = regex.compile(r"\p{L}\p{M}*\.(?:-\p{L}\.)*")
_NUM = regex.compile(r"[\p{N}.,]*\p{N}\.")
_TH = regex.compile(r"\p{Thai}")
_SPACE = regex.compile(r"\s+")


def word_type(token: str) -> str:
    """The type under which a token with a final period is counted."""
    if _ACR.fullmatch(token):
        return "##acr"
    if _INITIAL.fullmatch(token):
        return "##ini" if "-" not in token else "##ini2"
    if _NUM.fullmatch(token):
        return "##num"
    return token[:-1].lower()


def _next_class(nxt: str | None) -> str:
    if nxt is None:
        return "<end>"
    core = nxt.lstrip(OPEN)
    if not core:
        return "<o>"
    c = core[0]
    if c.isupper():
        return core.rstrip(CLOSE + ".,;:!?…")
    return "<l>" if c.islower() else "<9>" if c.isdigit() else "<o>"


_ENDS = frozenset(".!?" + CLOSE)


class Counts:
    """Statistics of texts: whole tokens are counted as they stand and taken apart once each at the end."""

    def __init__(self):
        self.tokens: dict[str, Counter] = {}
        self.found: Counter = Counter()

    def __len__(self) -> int:
        return len(self.found) + sum(map(len, self.tokens.values()))

    def add(self, lang: str, text: str) -> None:
        found = self.found
        for block in _BLOCK.split(text):
            if lang == "th":
                _count_thai(found, block)
                continue
            if lang in ("zh", "ja"):
                continue
            toks = block.split()
            if not toks:
                continue
            if lang not in self.tokens:
                self.tokens[lang] = Counter()
            self.tokens[lang].update(toks)
            last = len(toks) - 1
            self._clear(lang, toks[0])
            for i in [i for i, t in enumerate(toks) if t[-1] in _ENDS]:
                core = toks[i].strip(OPEN + CLOSE)
                if not core:
                    continue
                if core[-1] == "." and len(core) > 1 and core[-2] != ".":
                    found[lang, "period", word_type(core), _next_class(toks[i + 1]) if i < last else "<end>"] += 1
                elif toks[i][-1] in "!?" and i < last:
                    self._clear(lang, toks[i + 1])

    def _clear(self, lang: str, token: str) -> None:
        core = token.strip(OPEN + CLOSE)
        if core and core[0].isupper():
            self.found[lang, "clear", core.rstrip(".,;:!?…"), ""] += 1

    def frame(self) -> pd.DataFrame:
        out = self.found
        for lang, tokens in self.tokens.items():
            for token, n in tokens.items():
                core = token.strip(OPEN + CLOSE)
                if not core:
                    continue
                bare = core.rstrip(".,;:!?…")
                word = core.rstrip(",;:!?…")
                if word and not (core[-1] == "." and len(core) > 1 and core[-2] != "."):
                    out[lang, "plain", word.lower(), ""] += n
                if core[0].isupper():
                    out[lang, "upper", bare, ""] += n
        return pd.DataFrame([(*k, n) for k, n in out.items()], columns=["lang", "kind", "a", "b", "n"])


def _thai_edges(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """The letters before and after the white space text[a:b], in the counted lengths."""
    return [text[max(0, a - k) : a] for k in TH_EDGES], [text[b : b + k] for k in TH_EDGES]


def _count_thai(counts: Counter, block: str) -> None:
    text = block.strip()
    if not text:
        return
    for w in _thai_edges(text, 0, 0)[1]:
        counts["th", "th_start", w, "plain"] += bool(_TH.match(text))
    for m in _SPACE.finditer(text):
        left, right = bool(_TH.match(text[m.start() - 1])), bool(_TH.match(text[m.end()]))
        before, after = _thai_edges(text, m.start(), m.end())
        if left:
            for w in before:
                counts["th", "th_end", w, "plain" if right else "foreign"] += 1
        if right:
            for w in after:
                counts["th", "th_start", w, "plain" if left else "foreign"] += 1


STATS = "lang string, kind string, a string, b string, n long"


def corpus_counts(docs: DataFrame, text_col: str, lang_col: str, prepare=None) -> DataFrame:
    """``(lang, kind, a, b, n)`` over all documents, after ``prepare`` where given; each task sums before the shuffle."""

    def run(batches):
        counts = Counts()
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                if text and not text.isspace():
                    text = prepare(text) if prepare else text
                    counts.add(language(lang, text), text)
            if len(counts) > 500_000:
                yield counts.frame()
                counts = Counts()
        yield counts.frame()

    raw = spread(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))).mapInPandas(run, STATS)
    return raw.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def _xlogy(x, y):
    return F.when(x <= 0, F.lit(0.0)).otherwise(x * F.log(F.greatest(y, F.lit(1e-12))))


def _llr(a, b, ab, n):
    """Dunning's ratio of a pair seen ``ab`` times, of events seen ``a`` and ``b`` times in ``n``."""
    a, b, ab, n = (c.cast("double") for c in (a, b, ab, n))
    p, p1, p2 = b / n, ab / a, (b - ab) / F.greatest(n - a, F.lit(1.0))
    return -2 * (
        _xlogy(ab, p) + _xlogy(a - ab, 1 - p) + _xlogy(b - ab, p) + _xlogy(n - a - b + ab, 1 - p)
        - _xlogy(ab, p1) - _xlogy(a - ab, 1 - p1) - _xlogy(b - ab, p2) - _xlogy(n - a - b + ab, 1 - p2)
    )


def _pair(a: str, b: str, ab: str, n: str, least: float):
    """Whether a pair is seen significantly more often than by chance."""
    a, b, ab, n = (F.col(c).cast("double") for c in (a, b, ab, n))
    return (_llr(a, b, ab, n) >= least) & (ab * n > a * b)


def learn_model(counts: DataFrame) -> DataFrame:
    """``(lang, kind, w, final)``: abbreviations, sentence starters, collocations and Thai edges by log-likelihood."""
    from glossa.runtime import cut

    # Latin languages count for themselves and for texts whose language isn't given.
    cased = F.col("lang").isin(*CASED)
    keys = F.when(cased, F.array("lang", F.lit(ANY_LATIN))).otherwise(F.array("lang"))
    counts = cut(counts.withColumn("lang", F.explode(keys)).groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")))
    words = counts.where(F.col("kind").isin("plain", "period"))
    totals = words.groupBy("lang").agg(
        F.sum("n").alias("N"), F.sum(F.when(F.col("kind") == "period", F.col("n")).otherwise(0)).alias("NP")
    )
    upper = counts.where("kind = 'upper'").groupBy("lang", F.col("a").alias("w")).agg(F.sum("n").alias("ca"))
    # Breaks that need no model: after ! and ?, at block starts, and after periods of words of five letters or more.
    after = (
        counts.where(
            (F.col("kind") == "clear")
            | ((F.col("kind") == "period") & (F.length("a") >= 5) & ~F.col("a").startswith("##") & ~F.col("b").startswith("<"))
        )
        .select("lang", F.when(F.col("kind") == "clear", F.col("a")).otherwise(F.col("b")).alias("w"), "n")
        .groupBy("lang", "w")
        .agg(F.sum("n").alias("cab"))
    )
    breaks = after.groupBy("lang").agg(F.sum("cab").alias("cb"))
    s = upper.join(after, ["lang", "w"]).join(F.broadcast(breaks), "lang").join(F.broadcast(totals), "lang")
    ca, cb, n = (F.col(c).cast("double") for c in ("ca", "cb", "N"))
    cab = F.least(F.col("cab").cast("double"), ca)
    llr, p, p1 = _llr(ca, cb, cab, n), cb / n, cab / ca
    starters = s.where((llr >= START_LLR) & (p1 > p)).select("lang", "w")

    period = counts.where("kind = 'period'").join(
        starters.withColumnRenamed("w", "b").withColumn("starts", F.lit(True)), ["lang", "b"], "left"
    )
    caps = ~F.col("b").startswith("<")
    seen = period.groupBy("lang", F.col("a").alias("w")).agg(
        F.sum("n").alias("with_p"),
        F.sum(F.when(caps, F.col("n")).otherwise(0)).alias("caps"),
        F.sum(F.when(F.col("starts"), F.col("n")).otherwise(0)).alias("caps_start"),
        F.sum(F.when(F.col("b") == "<end>", F.col("n")).otherwise(0)).alias("at_end"),
    )
    plain = counts.where("kind = 'plain'").select("lang", F.col("a").alias("w"), F.col("n").alias("without_p"))
    t = seen.join(plain, ["lang", "w"], "left").na.fill(0, ["without_p"]).join(F.broadcast(totals), "lang")
    w_p, wo = F.col("with_p").cast("double"), F.col("without_p").cast("double")
    pb = F.col("NP") / F.col("N")
    dunning = -2 * (_xlogy(w_p, pb) + _xlogy(wo, 1 - pb) - _xlogy(w_p, F.lit(0.99)) - _xlogy(wo, F.lit(0.01)))
    letters = F.length(F.regexp_replace("w", r"\.", ""))
    dots = F.length("w") - letters + 1
    score = dunning * F.exp(-letters.cast("double")) * dots * F.pow(letters.cast("double"), -wo)
    inside = 1 - (F.col("caps_start") + F.col("at_end")) / F.col("with_p")
    final = F.col("caps_start") >= FINAL_SHARE * F.greatest(F.col("caps"), F.lit(1))
    special = F.col("w").startswith("##")
    abbr = t.where(special | ((score >= ABBR_LLR) & (inside >= ABBR_INSIDE))).select(
        "lang", F.lit("abbr").alias("kind"), "w", F.when(F.col("caps") > 0, final).otherwise(F.lit(False)).alias("final")
    )

    # Collocations of a type, or of its last letters, with its period and a number ("<9>"), and of a type that
    # would else end the sentence with a capitalised word that is no starter, against the followers of all periods.
    tails = period.where(~F.col("a").startswith("##") & (F.length("a") > TAIL)).withColumn("a", F.concat(F.lit("~"), F.expr(f"right(a, {TAIL})")))
    typed = period.select("lang", "a", "b", "n").unionByName(tails.select("lang", "a", "b", "n"))
    before = typed.groupBy("lang", F.col("a").alias("w")).agg(F.sum("n").alias("wp"), F.sum(F.when(F.col("b") == "<9>", F.col("n")).otherwise(0)).alias("ab"))
    sides = period.groupBy("lang").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("b") == "<9>", F.col("n")).otherwise(0)).alias("numbers"),
        F.sum(F.when(caps, F.col("n")).otherwise(0)).alias("words"),
    )
    numbers = before.where("ab > 0").join(F.broadcast(sides), "lang").where(_pair("wp", "numbers", "ab", "all", NUMBER_LLR))
    names = period.where(caps & F.col("starts").isNull()).select("lang", F.col("a").alias("w"), "b", F.col("n").alias("ab"))
    names = names.join(abbr.where(F.col("final") | F.col("w").isin("##num", "##ini", "##ini2")).select("lang", "w"), ["lang", "w"])
    followers = period.where(caps).groupBy("lang", "b").agg(F.sum("n").alias("nb"))
    names = names.join(seen.select("lang", "w", F.col("caps").alias("wc")), ["lang", "w"]).join(followers, ["lang", "b"]).join(F.broadcast(sides), "lang")
    names = names.where(_pair("wc", "nb", "ab", "words", PAIR_LLR))
    pairs = numbers.select("lang", "w", F.lit("<9>").alias("b")).unionByName(names.select("lang", "w", "b")).select(
        "lang", F.lit("pair").alias("kind"), F.concat_ws(" ", "w", "b").alias("w"), F.lit(True).alias("final")
    )

    th = counts.where(F.col("kind").isin("th_end", "th_start"))
    sums = th.groupBy("kind", "b").agg(F.sum("n").alias("total"))
    here = lambda b, x: F.sum(F.when(F.col("b") == b, x).otherwise(0.0))
    edges = (
        th.join(F.broadcast(sums), ["kind", "b"])
        .groupBy("lang", "kind", F.col("a").alias("w"))
        .agg(
            here("plain", F.col("n") / F.col("total")).alias("plain"),
            here("foreign", F.col("n") / F.col("total")).alias("foreign"),
            here("foreign", F.col("n")).alias("times"),
        )
    )
    # An edge continues the sentence only if it stands beside foreign words significantly more than beside Thai.
    total = lambda b: F.max(F.when(F.col("b") == b, F.col("total")))
    sides = sums.groupBy("kind").agg(total("foreign").alias("f"), total("plain").alias("p")).na.fill(0, ["f", "p"])
    edges = edges.join(F.broadcast(sides), "kind")
    continues = (F.col("plain") < F.col("foreign")) & (
        _llr(F.col("times") + F.col("plain") * F.col("p"), F.col("f"), F.col("times"), F.col("f") + F.col("p")) >= TH_LLR
    )
    thai = edges.where((F.col("plain") >= F.col("foreign")) | continues).select("lang", "kind", "w", (F.col("plain") >= F.col("foreign")).alias("final"))
    return abbr.unionByName(starters.select("lang", F.lit("start").alias("kind"), "w", F.lit(True).alias("final"))).unionByName(pairs).unionByName(thai)


class Splitter:
    """Splits texts with the learned entries; ``model`` is {lang: {kind: {w: final}}}."""

    def __init__(self, rows):
        self.model: dict[str, dict[str, dict[str, bool]]] = {}
        for lang, kind, w, final in rows:
            self.model.setdefault(lang, {}).setdefault(kind, {})[w] = bool(final)

    def spans(self, text: str, lang: str | None) -> list[tuple[int, int]]:
        """(start, end) of each sentence in code points; neither end is white space."""
        if not text or text.isspace():
            return []
        lang = language(lang, text)
        ends: list[int] = []
        at = 0
        for gap in _BLOCK.finditer(text):
            self._block(text, at, gap.start(), lang, ends)
            at = gap.end()
        self._block(text, at, len(text), lang, ends)
        out, start = [], 0
        for end in ends:
            a, b = start, end
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            start = end
        return out

    def _block(self, text: str, lo: int, hi: int, lang: str, ends: list[int]) -> None:
        if lo >= hi:
            return
        quoted = _quotes(text, lo, hi)
        if lang == "th":
            self._thai(text, lo, hi, quoted, ends)
        else:
            m = self.model.get(lang, {})
            known = m.get("abbr", {}), m.get("start", {}), m.get("pair", {})
            for c in _CANDIDATES.get(lang, _LATIN_END).finditer(text, lo, hi):
                e = c.end()
                while e < hi and text[e] in CLOSE and not (text[e] in "\"'“" and e + 1 < hi and text[e + 1].isalnum()):
                    e += 1
                if e >= hi:
                    break
                if _inside(quoted, c.start(), e):
                    continue
                if self._ends(text, c, e, hi, lang, *known):
                    ends.append(e)
        ends.append(hi)

    def _ends(self, text, c, e, hi, lang, abbr, start, pair) -> bool:
        mark = c.group()
        n = e
        while n < hi and text[n].isspace():
            n += 1
        if n >= hi:
            return False  # the block's own end follows
        spaced = n > e
        nxt = text[n]
        k = n
        while k < hi and text[k] in OPEN:
            k += 1
        head = text[k] if k < hi else nxt
        closed = e > c.end() and text[e - 1] in "\"”“»›」』"
        if lang in ("zh", "ja"):
            return mark[0] != "…" and not closed
        if lang in ("hi", "ar") and closed:
            return False
        if closed and not head.isupper():
            return False
        if nxt in ",;:—–-%)" and not (nxt in "—–-" and spaced):
            return False
        if lang == "hi":
            return mark[0] != "." and mark[0] != "…"
        if mark[0] == "…" or mark.endswith(".."):
            return spaced and head.isupper()
        if mark[-1] != ".":
            return spaced or head.isupper() or lang == "ar"
        if not spaced:
            # A blank may be missing, but not inside addresses, versions and dotted letters.
            b = c.start()
            return (
                head.isupper() and k + 1 < hi and text[k + 1].islower()
                and b >= 2 and text[b - 1].islower() and text[b - 2].isalpha()
            )
        b = c.start()
        while b > 0 and not text[b - 1].isspace():
            b -= 1
        w = word_type(text[b : c.end()].lstrip(OPEN))
        initial = w in ("##ini", "##ini2")  # without evidence the first letter of a name
        if head.isdigit():
            # A number may continue what the period abbreviates.
            return not (w in abbr or initial or f"{w} <9>" in pair or len(w) > TAIL and f"~{w[-TAIL:]} <9>" in pair)
        final = False if initial else abbr.get(w)
        if final is None:
            return True
        if head.islower():
            return w == "##num" and final
        if not head.isupper():
            return lang == "ar" and w == "##num" or k > n and final
        f = k
        while f < hi and (text[f].isalnum() or text[f] in "'’-"):
            f += 1
        follower = text[k:f]
        if f"{w} {follower}" in pair:
            return False
        return final or follower in start and not (initial and len(follower) == 1)

    def _thai(self, text: str, lo: int, hi: int, quoted, ends: list[int]) -> None:
        m = self.model.get("th", {})
        end_ok, start_ok = m.get("th_end", {}), m.get("th_start", {})
        for c in _SPACE.finditer(text, lo, hi):
            s, e = c.start(), c.end()
            if s <= lo or e >= hi or _inside(quoted, s, e):
                continue
            a, b = text[s - 1], text[e]
            left, right = bool(_TH.match(a)), bool(_TH.match(b))
            if a in "?!。":
                ends.append(s)
            elif left and right:
                ends.append(s)
            elif left and b not in OPEN and not b.isdigit():
                if _edge(end_ok, _thai_edges(text, s, e)[0]):
                    ends.append(s)
            elif right and not a.isdigit() and (a not in CLOSE or a == ")") and _edge(start_ok, _thai_edges(text, s, e)[1]):
                ends.append(s)


def _edge(known: dict[str, bool], edges: list[str]) -> bool:
    """Whether letters beside a foreign word bound a sentence; open classes of words, such as names, do."""
    return next((known[w] for w in edges if w in known), True)


_LATIN_END = regex.compile(r"[.!?…]+")
_CANDIDATES = {
    "zh": regex.compile(r"[。！？!?…]+"),
    "ja": regex.compile(r"[。！？!?…]+"),
    "hi": regex.compile(r"[।॥!?]+"),
    "ar": regex.compile(r"[.!?؟…]+"),
}
_PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』"}
_QUOTE = regex.compile('[“”„«»「」『』"]')


def _quotes(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """(open, close) positions of the quotations that are closed within the block."""
    out, opened, want = [], -1, ""
    for m in _QUOTE.finditer(text, lo, hi):
        c = m.group()
        if opened >= 0 and c == want:
            out.append((opened, m.start()))
            opened = -1
        elif opened < 0 or c in _PAIRS and c != "“":
            if c in _PAIRS or c == '"':
                opened, want = m.start(), _PAIRS.get(c, '"')
    return out


def _inside(quoted: list[tuple[int, int]], at: int, end: int) -> bool:
    """A mark at ``at`` that is within a quotation still open at ``end``."""
    return any(a < at and end <= b for a, b in quoted)


def split_corpus(
    docs: DataFrame, model: DataFrame, id_col: str, text_col: str, lang_col: str
) -> DataFrame:
    """``(id_col, start_pos, end_pos)`` of every sentence, by the learned ``model``."""
    spark = docs.sparkSession
    rows = model.limit(MODEL_ROWS + 1).collect()
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    src = spread(docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    if len(rows) <= MODEL_ROWS:
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def run(batches):
            splitter = Splitter(shared.value)
            for pdf in batches:
                yield _spans_frame(pdf, id_col, lambda _, t, l: splitter.spans(t, l))

        return src.mapInPandas(run, schema)

    def run_own(batches):
        for pdf in batches:
            yield _spans_frame(pdf, id_col, lambda i, t, l: own_splitter(pdf["own"][i]).spans(t, l))

    return with_own_entries(src, model).select(id_col, "text", "lang", "own").mapInPandas(run_own, schema)


def own_splitter(own) -> Splitter:
    """A splitter with the entries a document was given."""
    return Splitter([(r["lang"], r["kind"], r["w"], r["final"]) for r in (own if own is not None else [])])


def with_own_entries(src: DataFrame, model: DataFrame) -> DataFrame:
    """``src`` (with ``text, lang``) and ``own``: the model's entries for the words of each text.

    The way for a model too large to send: texts are stored under a row key,
    their distinct words meet the model by a join, and the entries return to
    their texts.
    """
    from glossa.runtime import stored

    def words(batches):
        for pdf in batches:
            out = []
            for row, text, lang in zip(pdf["_row"], pdf["text"], pdf["lang"]):
                if text:
                    key = language(lang, text)
                    if key == "th":
                        seen = {w for m in _SPACE.finditer(text) for side in _thai_edges(text, m.start(), m.end()) for w in side}
                    else:
                        raw = text.split()
                        toks = [t.strip(OPEN + CLOSE) for t in raw]
                        seen = {word_type(t) for t in toks if t.endswith(".")} | {t.rstrip(".,;:!?…") for t in toks}
                        ended = [(word_type(t), _next_class(n)) for t, n in zip(toks, raw[1:]) if t.endswith(".")]
                        seen |= {f"{w} {n}" for w, n in ended} | {f"~{w[-TAIL:]} {n}" for w, n in ended}
                        seen |= {n for _, n in ended}
                    out += [(row, key, w) for w in seen]
            yield pd.DataFrame(out, columns=["_row", "lang", "w"])

    keyed = stored(src.withColumn("_row", F.expr("uuid()")), "sentences")
    found = keyed.select("_row", "text", "lang").mapInPandas(words, "_row string, lang string, w string")
    own = found.join(model, ["lang", "w"]).groupBy("_row").agg(F.collect_list(F.struct("lang", "kind", "w", "final")).alias("own"))
    return keyed.join(own, "_row", "left").drop("_row")


def _spans_frame(pdf: pd.DataFrame, id_col: str, spans) -> pd.DataFrame:
    ids, starts, ends = [], [], []
    for i, (key, text, lang) in enumerate(zip(pdf[id_col], pdf["text"], pdf["lang"])):
        for a, b in spans(i, text, lang) if text else ():
            ids.append(key)
            starts.append(a)
            ends.append(b)
    return pd.DataFrame({id_col: pd.Series(ids, dtype=pdf[id_col].dtype if len(ids) else object), "start_pos": starts, "end_pos": ends})


def sentences(docs: DataFrame, id_col: str = "sample_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id_col, start_pos, end_pos)``: one row for each sentence of every text.

    Positions count code points from 0; the end is exclusive; neither end is
    white space. Null, empty and blank texts give no row; a repeated row gives
    its sentences again; unknown and null languages are told from the script,
    Latin texts then use the statistics of all Latin languages together; an
    empty table gives an empty table; other columns are ignored.
    """
    return split_corpus(docs, learn_model(corpus_counts(docs, text_col, lang_col)), id_col, text_col, lang_col)
