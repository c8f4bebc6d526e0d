"""Agreement of annotators on sets of labels: alpha and kappa under Jaccard and MASI distances, and scores against a reviewer.

``labels`` has ``item, annotator, labels array<string>``. Pairs are formed
within an item, whose annotators are few; expected disagreement is computed on
the distinct label sets with their frequencies, grouped by the item's key, so
it never pairs all annotations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_distance(a, b, kind: str = "jaccard"):
    """1 - |a n b| / |a u b|, for MASI weighted by how the sets contain each other; 0 for two empty sets."""
    union, common = F.size(F.array_union(a, b)), F.size(F.array_intersect(a, b))
    j = F.when(union > 0, common / union).otherwise(1.0)
    if kind == "jaccard":
        return 1.0 - j
    sa, sb = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    m = F.when((sa == sb) & (common == sa), 1.0).when(common == F.least(sa, sb), F.when(common == 0, 0.0).otherwise(0.67)).when(common > 0, 0.33).otherwise(0.0)
    return 1.0 - j * m


def observed(labels: DataFrame, kind: str = "jaccard") -> DataFrame:
    """``pairs, disagreement``: mean distance of the pairs of annotators of an item."""
    b = labels.select("item", F.col("annotator").alias("b"), F.col("labels").alias("y"))
    p = labels.select("item", F.col("annotator").alias("a"), F.col("labels").alias("x")).join(b, "item").where("a < b")
    return p.agg(F.count("*").alias("pairs"), F.avg(set_distance(F.col("x"), F.col("y"), kind)).alias("disagreement"))


def alpha(labels: DataFrame, block: str = "block", kind: str = "jaccard") -> DataFrame:
    """One row ``pairs, observed, expected, alpha``; chance pairs are label sets of the same block (e.g. acronym)."""
    o = observed(labels, kind)
    f = labels.withColumn("labels", F.array_sort(F.array_distinct("labels"))).groupBy(block, "labels").agg(F.count("*").cast("double").alias("n"))
    t = f.groupBy(block).agg(F.sum("n").alias("t"))
    g = f.select(block, F.col("labels").alias("y"), F.col("n").alias("m"))
    d = f.join(g, block).where(F.col("labels") != F.col("y")).join(t, block)
    e = d.agg(F.sum(F.col("n") * F.col("m") * set_distance(F.col("labels"), F.col("y"), kind)).alias("s"))
    z = t.agg(F.sum(F.col("t") * (F.col("t") - 1)).alias("z"))
    x = o.crossJoin(e).crossJoin(z)  # one row each
    expected = F.when(F.col("z") > 0, F.coalesce("s", F.lit(0.0)) / F.col("z")).otherwise(0.0)
    return x.select(
        "pairs", F.round("disagreement", 6).alias("observed"), F.round(expected, 6).alias("expected"),
        F.round(F.when(expected > 0, 1 - F.col("disagreement") / expected).otherwise(1.0), 6).alias("alpha"),
    )


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of two raters' labels ``x, y`` per item: ``items, observed, expected, kappa``."""
    n = pairs.agg(F.count("*").cast("double").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("po"))
    a = pairs.groupBy(F.col("x").alias("l")).agg(F.count("*").cast("double").alias("a"))
    b = pairs.groupBy(F.col("y").alias("l")).agg(F.count("*").cast("double").alias("b"))
    e = a.join(b, "l").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("ab"))
    pe = F.col("ab") / (F.col("n") * F.col("n"))
    return n.crossJoin(e).select(
        F.col("n").cast("long").alias("items"), F.round("po", 6).alias("observed"), F.round(pe, 6).alias("expected"),
        F.round(F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).otherwise(1.0), 6).alias("kappa"),
    )


def against_reviewer(labels: DataFrame, gold: DataFrame) -> DataFrame:
    """``annotator, labelled, right, accuracy`` on items with a reviewer's label (A-22)."""
    j = labels.join(gold, ["doc_id", "acronym"])
    return j.groupBy("annotator").agg(
        F.count("*").alias("labelled"), F.sum((F.col("label") == F.col("gold")).cast("long")).alias("right")
    ).withColumn("accuracy", F.round(F.col("right") / F.col("labelled"), 6))


def set_differences(two: DataFrame) -> DataFrame:
    """``item, both, only_a, only_b`` of two annotators' arrays ``a, b`` (U-06)."""
    a, b = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in ("a", "b"))
    return two.select("item", F.array_sort(F.array_intersect(a, b)).alias("both"), F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b"))


def partial_credit(acronym: str, parts: dict[str, str], expansion: str) -> tuple[dict[str, str], int, int, int]:
    """Credit for a slashed acronym annotated as a whole while its parts were annotated one by one (P-26).

    Returns the parts left over and (true positives, false positives, false negatives):
    right if the parts' expansions stand, in order, within two edits at the
    beginnings of words of the expansion.
    """
    from glossa.operators.linkage import similar

    pieces = [p for p in acronym.split("/") if p]
    if len(pieces) < 2 or not all(p in parts for p in pieces):
        return dict(parts), 0, 0, 1
    words = expansion.split()
    at = 0
    for p in pieces:
        want = parts[p].split()
        hit = next((i for i in range(at, len(words) - len(want) + 1) if similar(" ".join(words[i : i + len(want)]), parts[p])), None)
        if hit is None:
            return {k: v for k, v in parts.items() if k not in pieces}, 0, 1, 1
        at = hit + len(want)
    return {k: v for k, v in parts.items() if k not in pieces}, 1, 0, 0
