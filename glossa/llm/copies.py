"""Near-duplicate records: banded signatures, Bayesian pruning, exact verification.

The unit of comparison is the multiset of neighbouring word pairs (in Chinese,
Japanese and Thai: runs of three letters), after removing case, accents and
punctuation. Two records are copies if twice their common units is more than
``threshold`` of the units of both (Dice).

1. A hashed document-frequency table of fixed size (``DF_SLOTS`` counters,
   whatever the corpus) is summed over all records and its flags are broadcast. Units seen in
   more than ``FREQUENT`` of the records are phrases of the domain: they bring
   unrelated records together and hardly tell copies apart.
2. Records with the same multiset of units are represented by one of them; from
   here on a group of exact copies, however large, is a single row.
3. Every representative gets a MinHash sketch and banded signatures over all
   its units, so any two copies can meet, and banded signatures over its rare
   units as well. Records that hold few rare units (a group holding a large
   share of all rows makes its own phrases frequent) have only the former.
4. Representatives that share a band are candidates. Buckets of up to
   ``BUCKET`` rows give all their pairs. Larger buckets are compared with
   ``PIVOTS`` members drawn for the bucket. Pairs of a larger bucket that the
   links found so far leave in different groups are then all compared on their
   sketches, in blocks of ``BLOCK`` by ``BLOCK`` rows; pairs within a group
   would change nothing. A bucket never becomes one task.
5. Candidates are verified sequentially on their sketches, batch by batch:
   with m matches of n, the posterior of the similarity under a uniform prior
   is a Beta distribution; a pair whose probability of reaching the threshold
   is below ``MISS`` is dropped at the first batch that shows it. The limits
   are tabulated once (``prune_limits``). Survivors are verified exactly on
   their units.
6. Verified links are closed to groups by connected components.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.graph import connected_components
from glossa.runtime import cut, dropped, sized_broadcast, spread, stored

THRESHOLD = 0.6
DF_SLOTS = 1 << 20
FREQUENT, FREQUENT_LEAST = 0.005, 24
ROWS, BANDS = 3, 48
SKETCH, BATCH, MISS = 64, 16, 1e-4
RARE_LEAST, RARE_SHARE_ALL = 12, 0.35
BUCKET, PIVOTS, BLOCK = 64, 4, 1_024
#: Most slices of the bands, and of pairs, that are worked through one after the other; band keys in a bucket, least pairs in a slice.
SLICES, PAIR_SLICES, KEYS, PAIRS = 4, 4, 1 << 18, 5_000
ALONE, MARK, SURE = 0, 1, 2
ID_SLOTS = 1 << 26

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_MARKS = regex.compile(r"\p{M}+")


def plain(text: str) -> str:
    """Lower case without accents (combining marks)."""
    text = unicodedata.normalize("NFKD", text.casefold())
    return text if text.isascii() else _MARKS.sub("", text)


def units(text: str, lang: str | None = None) -> list[str]:
    """The neighbouring word pairs, or runs of three letters, of a text, in order."""
    dense = lang in ("zh", "ja", "th")
    if not dense and lang not in ("en", "fr", "es", "de", "ar", "hi"):
        dense = len(_DENSE.findall(text)) > 0.2 * max(1, len(_WORD.findall(text))) and len(_DENSE.findall(text)) > 0.3 * len(text)
    words = _WORD.findall(plain(text))
    if dense:
        s = "".join(words)
        return [s[i : i + 3] for i in range(len(s) - 2)] or ([s] if s else [])
    return [a + " " + b for a, b in zip(words, words[1:])] or words


def unit_hashes(text: str, lang: str | None = None) -> np.ndarray:
    """64-bit hashes of the units; repeats of a unit are told apart by their number."""
    us = units(text, lang)
    out = [xxhash.xxh64_intdigest(u, 0) for u in us]
    if len(set(us)) < len(us):
        seen: Counter = Counter()
        for i, u in enumerate(us):
            if k := seen[u]:
                out[i] = xxhash.xxh64_intdigest(u, k)
            seen[u] = k + 1
    return np.sort(np.array(out, np.uint64))


_RNG = np.random.default_rng(20_011)
_MUL = (_RNG.integers(0, 1 << 32, 512, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, 512, dtype=np.uint64).astype(np.uint32)


def min_hashes(h: np.ndarray, k0: int, k1: int) -> np.ndarray:
    """MinHash values k0..k1-1 of a set of 64-bit hashes."""
    x = (h ^ (h >> np.uint64(29))).astype(np.uint32)
    return (_MUL[k0:k1, None] * x + _ADD[k0:k1, None]).min(1)


def prune_limits(threshold: float, miss: float = MISS, size: int = SKETCH, batch: int = BATCH) -> list[int]:
    """Least matches after each batch for a pair to go on.

    P(J >= j | m of n match) with a uniform prior is the upper tail of
    Beta(m + 1, n - m + 1) at j, that is P(Binomial(n + 1, j) <= m). Sketch
    values are kept as single bytes, of which 1/256 agree by chance, so the
    similarity that must be reached is that of the bytes.
    """
    j = threshold / (2 - threshold)
    j = j + (1 - j) / 256
    limits = []
    for n in range(batch, size + 1, batch):
        tail, m = 0.0, -1
        while True:
            tail += math.comb(n + 1, m + 1) * j ** (m + 1) * (1 - j) ** (n - m)
            if tail >= miss:
                break
            m += 1
        limits.append(m + 1)
    return limits


def frequent_slots(h: DataFrame) -> np.ndarray:
    """Flags of the hashed document frequencies above the limit, counted over all records.

    Every task, as many as there are cores, counts in a table of ``DF_SLOTS``
    numbers and the tables are summed by slot. Only slots above the limit reach the driver; as a record
    counts once for each of its units, there are at most the mean number of
    units of a record, divided by ``FREQUENT``, of them.
    """
    limit = max(FREQUENT * h.count(), FREQUENT_LEAST)

    def run(batches):
        table = np.zeros(DF_SLOTS, np.int64)
        for pdf in batches:
            for x in pdf["h"]:
                table[np.unique(np.asarray(x).view(np.uint64) & np.uint64(DF_SLOTS - 1)).astype(np.int64)] += 1
        at = np.flatnonzero(table)
        yield pd.DataFrame({"slot": at, "n": table[at]})

    got = h.select("h").coalesce(h.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    flags = np.zeros(DF_SLOTS, bool)
    flags[[r["slot"] for r in got.select("slot").collect()]] = True
    return flags


def hashed(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, kept: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *kept, h)``: the unit hashes of every non-blank text; texts without a letter or digit have none."""
    id_type = docs.schema[id_col].dataType.simpleString()
    lang = F.lower(F.trim(F.col(lang_col))) if lang_col else F.lit(None).cast("string")

    def run(batches):
        for pdf in batches:
            at, hs = [], []
            for i, (t, l) in enumerate(zip(pdf["text"], pdf["lang"])):
                if t and len(h := unit_hashes(t, l)):
                    at.append(i)
                    hs.append(h.view(np.int64))
            yield pdf[["id", *kept]].iloc[at].assign(h=pd.Series(hs, index=pdf.index[at], dtype=object))

    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"), *kept)
    types = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return spread(src).mapInPandas(run, f"id {id_type}{types}, h array<long>")


def units_key() -> list:
    """Columns that tell the units of one record from those of another."""
    return [F.xxhash64("h"), F.size("h"), F.xxhash64(F.lit(1), "h")]


def banded(h: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``(band, id)``: the representatives of every band that at least two have.

    Few bands are shared, so the keys of one slice of the bands after the other
    are sent in arrays to buckets by key, where those that stand alone end.
    Repeats of a key within a batch are known to be shared and go on at once;
    one mark of them is sent, so no bucket grows with a band.
    """
    spark = h.sparkSession
    shared = spark.sparkContext.broadcast(np.packbits(frequent))
    id_type = h.schema["id"].dataType.simpleString()
    h = h.select("id", "h")
    keys = h.count() * 2 * BANDS
    step = math.ceil(BANDS / max(1, min(SLICES, keys // KEYS)))
    buckets = max(1, math.ceil(keys * step / BANDS / KEYS))

    def sent(lo: int, hi: int):
        def run(batches):
            flags = np.unpackbits(shared.value).astype(bool)
            salt = np.arange(lo, hi, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for pdf in batches:
                owners, bands = [], []
                for i, x in enumerate(pdf["h"]):
                    x = np.asarray(x).view(np.uint64)
                    rare = x[~flags[(x & np.uint64(DF_SLOTS - 1)).astype(np.int64)]]
                    share = len(rare) / len(x)
                    over = [(1, x)]
                    if len(rare) >= RARE_LEAST and RARE_SHARE_ALL < share < 1:
                        over.append((0, rare))
                    for way, of in over:
                        sig = min_hashes(of, lo * ROWS, hi * ROWS).astype(np.uint64).reshape(hi - lo, ROWS)
                        key = salt + np.uint64(way)
                        for r in range(ROWS):
                            key = (key ^ sig[:, r]) * np.uint64(0xFF51AFD7ED558CCD)
                            key ^= key >> np.uint64(33)
                        bands.append(key)
                        owners.append(np.full(hi - lo, i))
                if not bands:
                    continue
                key, own = np.concatenate(bands), np.concatenate(owners)
                order = np.lexsort((key, key % np.uint64(buckets)))
                key, own = key[order], pdf["id"].to_numpy()[own[order]]
                again = np.append(False, key[1:] == key[:-1])
                first = ~again & np.append(again[1:], False)
                rows = [(-1 - int(key[0] % np.uint64(buckets)), SURE, key[again | first], own[again | first])]
                for kind, of in ((ALONE, ~again & ~first), (MARK, first)):
                    k, o = key[of], own[of]
                    at, ends = np.unique(k % np.uint64(buckets), return_index=True)
                    rows += zip(at.tolist(), [kind] * len(at), np.split(k, ends[1:]), np.split(o, ends[1:]))
                rows = [r for r in rows if len(r[2])]
                yield pd.DataFrame({
                    "bucket": [r[0] for r in rows], "kind": [r[1] for r in rows],
                    "band": pd.Series([r[2].view(np.int64) for r in rows], dtype=object), "id": pd.Series([r[3] for r in rows], dtype=object),
                })

        return h.mapInPandas(run, f"bucket long, kind int, band array<long>, id array<{id_type}>")

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ids = np.concatenate(pdf["band"].to_list()), np.concatenate(pdf["id"].to_list())
        kind = np.repeat(pdf["kind"].to_numpy(), [len(x) for x in pdf["band"]])
        order = np.argsort(key, kind="stable")
        key, ids, kind = key[order], ids[order], kind[order]
        same = key[1:] == key[:-1]
        keep = (np.append(False, same) | np.append(same, False)) & (kind == ALONE) | (kind == SURE)
        return pd.DataFrame({"band": key[keep], "id": ids[keep]})

    return by_slices((sent(lo, min(BANDS, lo + step)).groupBy("bucket").applyInPandas(met, f"band long, id {id_type}") for lo in range(0, BANDS, step)), "bands")


def sketched(h: DataFrame) -> DataFrame:
    """``(id, sketch)``: one byte of each of ``SKETCH`` MinHash values over all units."""
    id_type = h.schema["id"].dataType.simpleString()
    first = ROWS * BANDS

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({
                "id": pdf["id"],
                "sketch": [
                    (min_hashes(np.asarray(x).view(np.uint64), first, first + SKETCH) & np.uint32(255)).astype(np.uint8).tobytes()
                    for x in pdf["h"]
                ],
            })

    return h.select("id", "h").mapInPandas(run, f"id {id_type}, sketch binary").dropDuplicates(["id"])


def _survivors(pairs: DataFrame, sketches: DataFrame, limits: list[int]) -> DataFrame:
    """Candidate pairs whose sketches pass every batch."""
    id_type = pairs.schema["a"].dataType.simpleString()
    a = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sa = np.frombuffer(b"".join(pdf["sa"]), np.uint8).reshape(-1, SKETCH)
            sb = np.frombuffer(b"".join(pdf["sb"]), np.uint8).reshape(-1, SKETCH)
            left = np.arange(len(pdf))
            matches = np.zeros(len(pdf), np.int64)
            for k, least in enumerate(limits):
                cols = slice(k * BATCH, (k + 1) * BATCH)
                matches[left] += (sa[left, cols] == sb[left, cols]).sum(1)
                left = left[matches[left] >= least]
            yield pdf.iloc[left][["a", "b"]]

    joined = (some.join(a, "a").join(b, "b").select("a", "b", "sa", "sb") for some in _slices(pairs))
    return by_slices((j.mapInPandas(run, f"a {id_type}, b {id_type}") for j in joined), "survivors")


def _slices(pairs: DataFrame) -> list[DataFrame]:
    n = max(1, min(PAIR_SLICES, pairs.count() // PAIRS))
    return [pairs.where(F.pmod(F.xxhash64("a"), F.lit(n)) == k) for k in range(n)]


def by_slices(parts, name: str) -> DataFrame:
    """The union of parts that are worked out one after the other, so only one's shuffle is on disk at a time."""
    parts = [stored(part, name) for part in parts]
    if len(parts) == 1:
        return parts[0]
    out = stored(reduce(DataFrame.unionByName, parts), name)
    dropped(*parts)
    return out


def candidate_pairs(bands: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(a, b)``, a < b, without repeats: pairs that share a small band, or a large one with a pivot; and the rows of large bands.

    A bucket of two, the usual case, is read off its count, least and greatest
    id, which are summed on the map side; only the rows of larger buckets are
    looked up again.
    """
    sizes = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    sizes = stored(sizes, "band-sizes")
    twos = sizes.where("size = 2").select("a", "b")
    _, wide = sized_broadcast(sizes.where("size > 2").select("band", "size"), 200_000)
    rows = bands.join(wide, "band")
    small = rows.where(F.col("size") <= BUCKET)
    a, b = small.select("band", F.col("id").alias("a")), small.select("band", F.col("id").alias("b"))
    out = twos.unionByName(a.join(b, "band").where("a < b").select("a", "b"))
    if not sizes.where(F.col("size") > BUCKET).limit(1).count():
        out = stored(out.distinct(), "pairs")
        dropped(bands, sizes)
        return out, None
    large = cut(rows.where(F.col("size") > BUCKET).select("band", "id"))
    drawn = large.groupBy("band").agg(*(F.min_by("id", F.xxhash64("id", F.lit(p), "band")).alias(f"p{p}") for p in range(PIVOTS)))
    drawn = drawn.select("band", F.explode(F.array_distinct(F.array(*(f"p{p}" for p in range(PIVOTS))))).alias("p"))
    met = large.join(drawn, "band").where(F.col("id") != F.col("p")).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
    out = stored(out.unionByName(met).distinct(), "pairs")
    dropped(bands, sizes)
    return out, large


def parted_pairs(large: DataFrame, labels: DataFrame, sketches: DataFrame, limits: list[int]) -> DataFrame:
    """``(a, b)``, a < b: all pairs of rows of a band that are in different groups and whose sketches pass every batch.

    The rows of a band's largest group are not compared with each other; the
    rows of a band are dealt to parts by hash, and two parts are a block.
    """
    id_type = large.schema["id"].dataType.simpleString()
    rows = large.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    rows = cut(rows)
    tops = rows.groupBy("band", "c").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "c")).alias("x"), F.sum("n").alias("size"))
    tops = tops.where(F.col("x.n") < F.col("size")).select(
        "band", F.col("x.c").alias("top"), F.ceil((F.col("size") - F.col("x.n")) / BLOCK).alias("rest"), F.ceil(F.col("x.n") / BLOCK).alias("most")
    )
    at, main = F.xxhash64("id"), F.col("c") == F.col("top")
    dealt = rows.join(tops, "band").select(
        "band", "id", "c", F.when(main, F.col("rest") + F.pmod(at, F.col("most"))).otherwise(F.pmod(at, F.col("rest"))).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.when(main, F.col("rest")).otherwise(F.col("rest") + F.col("most")) - 1)).alias("other"),
    )
    dealt = dealt.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other").join(sketches, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, groups = pdf["id"].to_numpy(), pd.factorize(pdf["c"])[0]
        s = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, SKETCH)
        one = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        left = np.arange(len(pdf)) if one else np.flatnonzero(pdf["part"] == pdf["lo"])
        right = left if one else np.flatnonzero(pdf["part"] == pdf["hi"])
        xs, ys = [], []
        for k, i in enumerate(left):
            js = right[k + 1 :] if one else right
            js = js[groups[js] != groups[i]]
            matches = np.zeros(len(js), np.int64)
            for n, least in enumerate(limits):
                cols = slice(n * BATCH, (n + 1) * BATCH)
                matches += (s[js, cols] == s[i, cols]).sum(1)
                js, matches = js[matches >= least], matches[matches >= least]
            xs.append(np.full(len(js), i))
            ys.append(js)
        x, y = (ids[np.concatenate(z).astype(np.int64)] if z else ids[:0] for z in (xs, ys))
        swap = x > y
        return pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y)})

    return dealt.groupBy("band", "lo", "hi").applyInPandas(compare, f"a {id_type}, b {id_type}").distinct()


def listed(h: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``h`` whose id is listed; of long lists, those whose id has a slot of a listed one. ``h`` isn't shuffled."""
    small, ids = sized_broadcast(ids, 200_000)
    if small:
        return h.join(ids, "id", "left_semi")
    slot = F.pmod(F.xxhash64("id"), F.lit(ID_SLOTS))
    word, bit = F.shiftright(slot, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {ID_SLOTS}) % 64 as int))")
    flags = ids.groupBy(word.alias("_w")).agg(F.bit_or(bit).alias("_b"))  # at most ID_SLOTS / 64 rows
    return h.withColumn("_w", word).join(F.broadcast(flags), "_w").where(F.col("_b").bitwiseAND(bit) != 0).drop("_w", "_b")


def verified(pairs: DataFrame, h: DataFrame, threshold: float) -> DataFrame:
    """The pairs that truly exceed the threshold, by their units."""
    id_type = h.schema["id"].dataType.simpleString()
    pairs = cut(pairs)
    touched = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    h = stored(listed(h, cut(touched)).dropDuplicates(["id"]), "verify")

    def run(batches):
        for pdf in batches:
            keep = [
                2 * len(np.intersect1d(x, y, assume_unique=True)) > threshold * (len(x) + len(y))
                for x, y in zip(pdf["ha"], pdf["hb"])
            ]
            yield pdf[np.array(keep, bool)][["a", "b"]] if len(pdf) else pdf[["a", "b"]]

    def joined(some: DataFrame, alone: bool) -> DataFrame:
        x, y = (h if alone else listed(h, cut(some.select(F.col(c).alias("id")).distinct())) for c in "ab")
        return some.join(x.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(y.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")

    slices = _slices(pairs)
    out = by_slices((joined(some, len(slices) == 1).select("a", "b", "ha", "hb").mapInPandas(run, f"a {id_type}, b {id_type}") for some in slices), "verified")
    dropped(h)
    return out


def copy_classes(
    docs: DataFrame, id_col: str = "sample_id", text_col: str = "text", lang_col: str | None = "lang", threshold: float = THRESHOLD
) -> DataFrame:
    """``(id, class_id)``: every record that has a copy, with the least id of its group.

    Defined cases: null, empty and blank texts, texts without letters or digits,
    and rows with a null id belong to no group; texts of one word are copies of
    equal texts; a repeated row counts once; an empty table gives an empty
    table; other columns are ignored.
    """
    h = stored(hashed(docs, id_col, text_col, lang_col), "units")
    members = h.select("id", F.struct(*units_key()).alias("k"))
    heads = members.groupBy("k").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n"))
    members = cut(members.join(heads, "k").select("id", "rep", "n"))
    _, repeats = sized_broadcast(members.where("id <> rep").select("id").distinct(), 1_000_000)
    reps = h.join(repeats, "id", "left_anti")
    sketches = stored(sketched(reps), "sketches")
    limits = prune_limits(threshold)
    pairs, large = candidate_pairs(banded(reps, frequent_slots(h)))
    near = _survivors(pairs, sketches, limits)
    dropped(pairs)
    links = verified(near, h, threshold)
    labels = connected_components(links, "a", "b")
    if large is not None:
        more = verified(parted_pairs(large, labels, sketches, limits), h, threshold)
        if more.limit(1).count():
            labels = connected_components(links.unionByName(more), "a", "b")
    joined = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return joined.where("n > 1 or component is not null").select("id", F.coalesce("component", "rep").alias("class_id")).distinct()


def pairs_of_classes(classes: DataFrame, left: str, right: str) -> DataFrame:
    """All pairs within each group, smaller id first."""
    a = classes.select("class_id", F.col("id").alias(left))
    b = classes.select("class_id", F.col("id").alias(right))
    return a.join(b, "class_id").where(F.col(left) < F.col(right)).select(left, right)
