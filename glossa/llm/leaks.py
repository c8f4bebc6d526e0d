"""Evaluation passages that stand in training text, by suffix arrays of the training text.

Every task turns its shard of documents into one array of token numbers (words
without case, accents, punctuation and markup; single letters where words are
not spaced) and builds its suffix array: the places at which a match of
``WORDS`` words (``LETTERS`` letters) can begin, sorted by the tokens from there
on by prefix doubling, with the lengths that neighbours in this order have in
common. Only suffixes that begin with such a run of some passage can hold a
match of that length, so just these are sorted, and only as far as a passage
could match them. Every suffix of every passage is then placed by binary search,
comparing tokens: the suffix beside its place is its longest verbatim match in
the shard, and going outwards from there the common lengths give its match with
every other document. Matches are summed to the part of a passage that a
document holds; a changed word or a foreign sentence in between only splits a
match.

Tokens that no passage holds are all the same to the search, so a shard needs a
small array of 32-bit numbers, whatever its vocabulary. The passages are a
fixed benchmark and are broadcast in blocks of at most ``PASSAGE_TOKENS``
tokens; a larger benchmark is searched block by block.
"""

from __future__ import annotations

import html
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.runtime import cut, spread

WORDS, LETTERS = 5, 9
HELD, NEAR = 0.33, 3
PASSAGE_TOKENS = 4_000_000
SHARD_CHARS = 8_000_000
#: A run of at most ``NOTICE_TOKENS`` places of a passage is a notice or phrase,
#: and counts for no document, only on evidence from outside the passage: it also
#: stands in another passage, and most documents that hold it lack the rest; or
#: it ends the passage and, alone of the passage, most of the documents that hold
#: it, and these are more than a share ``NOTICE_SHARE`` of all (and ``NOTICE_DOCS``).
NOTICE_TOKENS, NOTICE_DOCS, NOTICE_ALONE, NOTICE_SHARE = 30, 3, 0.5, 0.001

_TAG = regex.compile(r"<[^<>]{0,200}>")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\W_\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+")
_MARKS = regex.compile(r"\p{M}+")


def tokens(text: str) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _TOKEN.findall(text)


class Passages:
    """The evaluation passages as token numbers, with their windows sorted for binary search."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        words = [(i, tokens(t)) for i, t in items if i is not None and t]
        words = [(i, w) for i, w in words if w]
        self.ids = [i for i, _ in words]
        self.sizes = np.array([len(w) for _, w in words], np.int64)
        dense = np.array([sum(len(t) == 1 for t in w) > 0.5 * len(w) and any(ord(c) > 0x2E7F for t in w[:9] for c in t) for _, w in words], bool)
        flat, owner = [-2], [-1]
        for k, (_, w) in enumerate(words):
            flat += [self.vocab.setdefault(t, len(self.vocab)) for t in w]
            owner += [k] * len(w)
            flat.append(-2)
            owner.append(-1)
        self.flat, self.owner = np.array(flat, np.int64), np.array(owner, np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes + 1)][: len(words)] + 1
        self.windows = []
        for size, of in ((WORDS, ~dense), (LETTERS, dense)):
            key, ok = window_keys(self.flat, size)
            at = np.flatnonzero(ok)
            at = at[of[self.owner[at]]] if len(words) else at
            order = np.argsort(key[at], kind="stable")
            self.windows.append((size, key[at][order], at[order]))


    def shared_cells(self) -> list[tuple[int, int]]:
        """(passage, place) of all windows that another passage, not made of the same tokens, holds too."""
        text = [self.flat[s : s + n].tobytes() for s, n in zip(self.starts, self.sizes)]
        out = set()
        for size, keys, places in self.windows:
            cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else np.array([0])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own = self.owner[places[lo:hi]]
                if hi - lo > 1 and len({text[k] for k in own}) > 1:
                    out |= {(int(k), int(t - self.starts[k]) + d) for k, t in zip(own, places[lo:hi]) for d in range(size)}
        return sorted(out)


def window_keys(t: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``size`` tokens from each place, whether all are passage tokens)."""
    n = max(0, len(t) - size + 1)
    key = np.zeros(n, np.uint64)
    ok = np.ones(n, bool)
    for d in range(size):
        x = t[d : d + n]
        ok &= x >= 0
        key = (key ^ (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(32)
    return key, ok


def common_lengths(x: np.ndarray, at: np.ndarray, y: np.ndarray, by: np.ndarray, limit: int) -> np.ndarray:
    """How many passage tokens the suffixes of ``x`` at ``at`` and of ``y`` at ``by`` have in common, ``limit`` at most."""
    length = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for _ in range(limit):
        a, b = at[live] + length[live], by[live] + length[live]
        inside = (a < len(x)) & (b < len(y))
        live, a, b = live[inside], a[inside], b[inside]
        live = live[(x[a] == y[b]) & (x[a] >= 0)]
        if not len(live):
            break
        length[live] += 1
    return length


def suffix_array(shard: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``at`` (ascending places of windows of ``size`` passage tokens that a passage holds) in the order of their suffixes.

    Windows are ranked by their tokens, then pairs, fours and so on of windows
    that follow each other. A window no passage holds ends a suffix: no match
    goes on behind it.
    """
    places = np.union1d(at, at[at + size < len(shard)] + size)
    n = len(places)
    own = places[:, None] + np.arange(size)
    windows = np.where(own < len(shard), shard[np.minimum(own, len(shard) - 1)], -1)
    windows = np.where(np.minimum.accumulate(windows >= 0, axis=1), windows, -1)
    order = np.lexsort(windows.T[::-1])
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.cumsum(np.r_[True, (windows[order[1:]] != windows[order[:-1]]).any(1)])
    begins = np.searchsorted(places, at)
    after = np.full(n + 1, n)
    further = np.searchsorted(places, at + size)
    after[begins] = np.where(at + size < len(shard), further, n)
    while True:
        pair = rank[:-1] * (n + 1) + rank[after[:-1]]
        _, finer = np.unique(pair, return_inverse=True)
        known, rank[:-1] = rank.max(), finer + 1
        if rank.max() == known:
            break
        after = after[after]
    return at[np.argsort(rank[begins], kind="stable")]


def place(p_flat: np.ndarray, starts: np.ndarray, shard: np.ndarray, suffixes: np.ndarray, limit: int) -> np.ndarray:
    """The place of each passage suffix in the suffix array, by binary search over tokens."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(suffixes), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        s = suffixes[mid]
        same = common_lengths(p_flat, starts[live], shard, s, limit)
        mine = p_flat[starts[live] + same]
        its = np.where(s + same < len(shard), shard[np.minimum(s + same, len(shard) - 1)], -1)
        more = mine > its
        lo[live[more]] = mid[more] + 1
        hi[live[~more]] = mid[~more]


def shard_matches(p: Passages, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage place, shard place, length) of every maximal match of a window or more."""
    found = []
    limit = int(p.sizes.max(initial=0)) + 1
    for size, keys, places in p.windows:
        if not len(keys):
            continue
        # Suffixes that can match, and passage suffixes they can match with, by hashes of their first windows.
        key, ok = window_keys(shard, size)
        at = np.flatnonzero(ok)
        distinct = np.unique(keys)
        hit = np.searchsorted(distinct, key[at])
        at = at[distinct[np.minimum(hit, len(distinct) - 1)] == key[at]]
        if not len(at):
            continue
        there = np.unique(key[at])
        starts = places[there[np.minimum(np.searchsorted(there, keys), len(there) - 1)] == keys]
        suffixes = suffix_array(shard, at, size)
        shared = np.r_[0, common_lengths(shard, suffixes[:-1], shard, suffixes[1:], limit), 0]
        spot = place(p.flat, starts, shard, suffixes, limit)
        for step in (-1, 1):
            j = spot - 1 if step < 0 else spot.copy()
            live = np.flatnonzero((j >= 0) & (j < len(suffixes)))
            length = common_lengths(p.flat, starts[live], shard, suffixes[j[live]], limit)
            j = j[live]
            while True:
                go = length >= size
                live, j, length = live[go], j[go], length[go]
                if not len(live):
                    break
                found.append((starts[live], suffixes[j], length))
                length = np.minimum(length, shared[j if step < 0 else j + 1])
                j = j + step
    if not found:
        z = np.array([], np.int64)
        return z, z, z
    t, s, n = (np.concatenate(x) for x in zip(*found))
    # Left-maximal matches only: the others are inside a longer one.
    first = (p.flat[t - 1] != np.where(s > 0, shard[np.maximum(s - 1, 0)], -3)) | (p.flat[t - 1] < 0)
    return t[first], s[first], n[first]


def coherent_tokens(start: np.ndarray, length: np.ndarray, at: np.ndarray, size: int) -> int:
    """The most tokens of a passage in runs in its order, or in any order within ``NEAR`` times its length; runs come by ``at``."""
    end, sums, most = start + length, length.copy(), 0
    for i in range(len(start)):
        before = np.flatnonzero((start[:i] < start[i]) & (at[:i] < at[i]))
        gain = np.clip(end[i] - np.maximum(start[i], end[before]), 0, None)
        sums[i] = max(sums[i], (sums[before] + gain).max(initial=0))
        seen = np.zeros(size, bool)
        for k in range(i, np.searchsorted(at, at[i] + NEAR * size)):
            seen[start[k] : end[k]] = True
        most = max(most, sums[i], seen.sum())
    return int(most)


MATCH = "item int, start int, length int, at int, last boolean"


def _matches(docs: DataFrame, shared, id_type: T.DataType) -> DataFrame:
    """``(doc_id, item, start, length, at, last)``: maximal matches, places in the passages, and whether the document ends with it."""
    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(MATCH).fields])

    def run(batches):
        p = Passages(shared.value)

        def search(rows):
            flat, doc, pos = [], [], []
            get = p.vocab.get
            parts = []
            for i, t in rows:
                parts.append([get(w, -1) for w in tokens(t)])
            sizes = np.array([len(x) + 1 for x in parts], np.int64)
            flat = np.fromiter((y for x in parts for y in (*x, -1)), np.int64, int(sizes.sum()))
            t, s, n = shard_matches(p, flat)
            ends = np.cumsum(sizes)
            k = np.searchsorted(ends, s, "right")
            item = p.owner[t]
            keys = pd.Series([r[0] for r in rows])
            return pd.DataFrame({
                "doc_id": keys.iloc[k].to_numpy(), "item": item, "start": t - p.starts[item] if len(item) else item,
                "length": n, "at": s - (ends - sizes)[k] if len(k) else k,
                "last": s + n == ends[k] - 1 if len(k) else np.array([], bool),
            })

        rows, chars = [], 0
        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                if t:
                    rows.append((i, t))
                    chars += len(t)
                if chars > SHARD_CHARS:
                    yield search(rows)
                    rows, chars = [], 0
        if rows:
            yield search(rows)

    return docs.mapInPandas(run, schema)


def leaked(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage",
    held: float = HELD,
) -> DataFrame:
    """``(doc_id, item_id, part, longest, at)``: documents holding a passage or at least ``held`` of it.

    ``part`` is the share of the passage's tokens in verbatim matches, ``longest``
    the longest match in tokens and ``at`` its token place in the document.
    Null and empty texts and passages give no row; a passage shorter than a
    window is no case; a repeated document row counts once; empty tables give an
    empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    it = items.where(F.col(item_col).isNotNull() & F.col(passage_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(passage_col).alias("t")).distinct()
    size = it.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // PASSAGE_TOKENS))
    src = spread(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    out = None
    for b in range(blocks):
        part = it if blocks == 1 else it.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        rows = [tuple(x) for x in part.orderBy("i", "t").collect()]
        one = _held(src, rows, id_type, held, item_col)
        out = one if out is None else out.unionByName(one)
    return out


def _held(src: DataFrame, rows: list[tuple[int, str]], id_type, held: float, item_col: str) -> DataFrame:
    spark = src.sparkSession
    p = Passages(rows)
    shared = spark.sparkContext.broadcast(rows)
    sizes = spark.createDataFrame([(k, int(i), int(n)) for k, (i, n) in enumerate(zip(p.ids, p.sizes))], f"item int, {item_col} long, size int")
    m = cut(_matches(src, shared, id_type).distinct())
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)))
    rough = m.groupBy("doc_id", "item").agg(F.sum("length").alias("n"), F.max("length").alias("longest"))
    likely = rough.join(F.broadcast(sizes), "item").where((F.col("n") >= 0.15 * F.col("size")) | (F.col("longest") >= 2 * WORDS))
    tail = F.col("last") & (F.col("start") + F.col("length") == F.col("size")) & (F.col("length") <= NOTICE_TOKENS)
    every = cells(m.join(likely.select("doc_id", "item", "size"), ["doc_id", "item"]).withColumn("tail", tail))
    every = cut(every.groupBy("doc_id", "item", "cell").agg(F.first("size").alias("size"), F.max("tail").alias("tail")))
    shared_cells = spark.createDataFrame(p.shared_cells(), "item int, cell int")
    others = F.broadcast(shared_cells.withColumn("shared", F.lit(True)))
    every = every.join(others, ["item", "cell"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    lent = shared_cells.groupBy("item").agg(F.count("*").alias("lent"))
    raw = every.groupBy("doc_id", "item").agg(
        F.count("*").alias("raw"), F.sum((~F.col("shared")).cast("int")).alias("rest"), F.min("tail").alias("only")
    ).join(F.broadcast(lent), "item", "left")
    spread_cells = every.join(raw, ["doc_id", "item"]).withColumn("rich", F.col("raw") >= held * F.col("size"))
    poor = F.col("rest") < held * (F.col("size") - F.coalesce("lent", F.lit(0)))
    seen = spread_cells.groupBy("item", "cell").agg(
        F.count("*").alias("docs"), F.max("shared").alias("shared"), F.sum(poor.cast("int")).alias("alone"), F.sum(F.col("only").cast("int")).alias("tails")
    )
    many = F.greatest(F.lit(NOTICE_DOCS), F.lit(NOTICE_SHARE * src.count()))
    often = F.col("shared") & (F.col("alone") > NOTICE_ALONE * F.col("docs")) | (F.col("tails") > many) & (F.col("tails") > NOTICE_ALONE * F.col("docs"))
    flagged = seen.where(often).select("item", "cell")
    # Runs of flagged places; the table has at most the tokens of the passages of this block.
    run = F.col("cell") - F.row_number().over(Window.partitionBy("item").orderBy("cell"))
    flagged = flagged.withColumn("run", run).withColumn("n", F.count("*").over(Window.partitionBy("item", "run")))
    notice = flagged.where(F.col("n") <= NOTICE_TOKENS).select("item", "cell")
    notice = F.broadcast(notice)  # at most the tokens of the passages of this block
    common = notice.groupBy("item").agg(F.count("*").alias("common"))
    own = (
        spread_cells.join(notice, ["item", "cell"], "left_anti")
        .groupBy("doc_id", "item").agg(F.count("*").alias("cells"), F.first("size").alias("size"), F.first("rich").alias("rich"))
        .join(F.broadcast(common), "item", "left")
    )
    part = F.col("cells") / F.greatest(F.col("size") - F.coalesce("common", F.lit(0)), F.lit(1))
    kept = own.withColumn("part", part).where(F.col("rich") & (F.col("part") >= held) & (F.col("cells") > WORDS))
    best = m.groupBy("doc_id", "item").agg(F.max(F.struct("length", F.negate("at").alias("b"))).alias("x"))
    kept = kept.join(best, ["doc_id", "item"])
    # Without a long run, scattered phrases are no passage, but sentences in order or close together are.
    long = F.col("x.length") > 2 * WORDS
    short = m.join(kept.where(~long).select("doc_id", "item", "size"), ["doc_id", "item"])

    def coherent(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "start"])
        whole = coherent_tokens(*(pdf[c].to_numpy() for c in ("start", "length", "at")), int(pdf["size"].iloc[0]))
        return pdf[["doc_id", "item"]].iloc[: int(whole >= held * pdf["size"].iloc[0])]

    sure = short.select("doc_id", "item", "size", "start", "length", "at").groupBy("doc_id", "item").applyInPandas(
        coherent, T.StructType([T.StructField("doc_id", id_type), T.StructField("item", T.IntegerType())])
    )
    kept = kept.where(long).unionByName(kept.where(~long).join(sure, ["doc_id", "item"], "left_semi"))
    return kept.join(F.broadcast(sizes.drop("size")), "item").select(
        "doc_id", item_col, F.round("part", 4).alias("part"), F.col("x.length").alias("longest"), F.negate("x.b").alias("at")
    )


def without_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no evaluation passage; rows with a null id stay."""
    return docs.join(leaks.select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti")
