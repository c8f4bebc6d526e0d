"""Linkage of expansions that mean the same, and rewriting to canonical forms.

Similarity is not transitive, so similar pairs within an acronym are closed to
components, over distinct expansions only; the canonical form of a component is
its most frequent expansion (ties: longest, then least).

Similar pairs are found without comparing all pairs of an acronym: equal prefix
keys meet by an equi join, and expansions within two edits share at least one
of three pieces into which either can be cut (pigeonhole on ``PIECES`` pieces,
with the shifts two edits allow), so they meet by an equi join on pieces and
are then verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators.graph import connected_components

PIECES, EDITS = 3, 2


def _pieces(e: DataFrame, shifts: bool) -> DataFrame:
    """(acronym, expansion, piece): the pieces of a string, or all substrings that may equal one within the edits.

    A piece is named by its number, its text and the length of the string it
    was cut from, so that the other side can compute the cuts of each length
    within ``EDITS`` of its own.
    """
    n = F.length("expansion")
    if not shifts:
        cuts = F.array(*(F.struct(F.lit(k).alias("k"), n.alias("n"), F.lit(0).alias("s")) for k in range(PIECES)))
    else:
        cuts = F.array(*(
            F.struct(F.lit(k).alias("k"), (n + d).alias("n"), F.lit(s).alias("s"))
            for k in range(PIECES) for d in range(-EDITS, EDITS + 1) for s in range(-EDITS, EDITS + 1)
        ))
    x = e.select("acronym", "expansion", F.explode(cuts).alias("c"))
    size = F.col("c.n").cast("int")
    start = F.floor(size * F.col("c.k") / PIECES).cast("int")
    stop = F.floor(size * (F.col("c.k") + 1) / PIECES).cast("int")
    at = start + F.col("c.s")
    ok = (size > 0) & (at >= 0) & (stop > start)
    return x.where(ok).select(
        "acronym", "expansion", F.xxhash64("c.k", "c.n", F.substring("expansion", at + 1, stop - start)).alias("piece")
    ).distinct()


def similar_pairs(expansions: DataFrame) -> DataFrame:
    """``acronym, a, b`` (a < b): distinct similar expansions of an acronym, under their keys (J-03)."""
    e = expansions.select("acronym", "expansion").distinct()
    k = e.withColumn("key", X.prefix_key(F.col("expansion")))
    by_key = k.join(k.withColumnRenamed("expansion", "b"), ["acronym", "key"]).where("expansion < b").select("acronym", F.col("expansion").alias("a"), "b")
    own, other = _pieces(e, False), _pieces(e, True).withColumnRenamed("expansion", "o")
    met = own.join(other, ["acronym", "piece"]).where("expansion <> o")
    near = met.select("acronym", F.least("expansion", "o").alias("a"), F.greatest("expansion", "o").alias("b")).distinct()
    near = near.where(F.levenshtein("a", "b", EDITS) >= 0)
    return by_key.unionByName(near).distinct()


def linked(pairs: DataFrame) -> DataFrame:
    """``acronym, expansion, canonical, component``: every distinct expansion with its component's canonical form (G-05, A-07, A-08).

    Expansions are linked if they are similar, and if one article gives both for the acronym (J-03b).
    The canonical form is the most frequent, of several the longest. Null article ids link nothing.
    """
    node = lambda c: F.concat_ws("\u0001", "acronym", c)
    counts = pairs.groupBy("acronym", "expansion").agg(F.count("*").alias("n"))
    together = same_article_links(pairs.where("article_id is not null"))
    links = similar_pairs(counts).unionByName(together).select(node("a").alias("u"), node("b").alias("v")).distinct()
    parts = connected_components(links, "u", "v")
    c = counts.withColumn("node", node("expansion")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    best = c.groupBy("component").agg(F.min_by("expansion", F.struct(-F.col("n"), -F.length("expansion"), "expansion")).alias("canonical"))
    return c.join(best, "component").select("acronym", "expansion", "canonical", F.substring_index("component", "\u0001", -1).alias("component"))


def rewritten(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs with canonical expansions, without the repeats this makes (J-05, A-09, U-03)."""
    return pairs.join(links.select("acronym", "expansion", "canonical"), ["acronym", "expansion"]).select(
        "acronym", F.col("canonical").alias("expansion"), "article_id"
    ).distinct()


def changes(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``article_id, acronym, old, new`` where the canonical form differs."""
    return pairs.select("acronym", "expansion", "article_id").distinct().join(links, ["acronym", "expansion"]).where("expansion <> canonical").select(
        "article_id", "acronym", F.col("expansion").alias("old"), F.col("canonical").alias("new")
    )


def same_article_links(pairs: DataFrame) -> DataFrame:
    """Links between expansions one article gives for one acronym: a star to the least, whatever their number (D-20)."""
    least = pairs.groupBy("acronym", "article_id").agg(F.min("expansion").alias("a"))
    return pairs.select("acronym", "article_id", "expansion").distinct().join(least, ["acronym", "article_id"]).where("expansion <> a").select(
        "acronym", "a", F.col("expansion").alias("b")
    ).distinct()


def guided(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pairs mapped to the entry of a dictionary within two edits; acronyms it lacks are dropped (G-06, J-06)."""
    p = pairs.select("acronym", "expansion").distinct()
    d = dictionary.select(F.col("acronym"), F.col("expansion").alias("entry")).distinct()
    j = p.join(d, "acronym").withColumn("edits", F.levenshtein("expansion", "entry", EDITS)).where("edits >= 0")
    best = j.groupBy("acronym", "expansion").agg(F.min_by("entry", F.struct("edits", "entry")).alias("entry"))
    return pairs.join(best, ["acronym", "expansion"]).select("acronym", F.col("entry").alias("expansion"), "article_id")


def greedy_labels(choices: list[str]) -> list[int]:
    """Labels by the first earlier expansion that is similar; order decides (A-06)."""
    reps: list[tuple[str, int]] = []
    out = []
    for e in choices:
        label = next((l for r, l in reps if similar(r, e)), None)
        if label is None:
            label = len(reps)
            reps.append((e, label))
        out.append(label)
    return out


def similar(a: str, b: str) -> bool:
    """Plain version of ``functions.text.fuzzy_equal``, for small ordered groups and tests."""
    def key(s: str) -> str:
        s = s.lower().translate(str.maketrans(X.ACCENTED, X.UNACCENTED))
        return " ".join(s.replace("-", " ").replace("_", " ").split())

    a, b = key(a), key(b)
    if a == b or [w[:4] for w in a.split(" ")] == [w[:4] for w in b.split(" ")]:
        return True
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1] <= 2
