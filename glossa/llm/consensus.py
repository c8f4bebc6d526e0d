"""Consensus of several annotators by minimax conditional entropy.

Of all label distributions the observed labels allow, the one of greatest
conditional entropy given the true labels is sought, and the true labels that
make it least. Its dual has a tilting parameter for each annotator and one for
each item: the probability that annotator a gives label l to item i of true
label y is proportional to exp((alpha_a + beta_i) [l = y]) over the labels the
item may have. ``consensus`` alternates

* posteriors: q_i(y) proportional to exp of the summed tilts of the annotators who chose y, and
* one regularised coordinate ascent step of the dual for all annotators, then
  for all items: the surplus of expected right labels over those the model
  predicts, divided by the curvature, both with a quadratic penalty,

until the posteriors settle. Items whose true label a reviewer has given keep
it, so that the annotators are calibrated on them. Everything is joins and
aggregations on items and annotators with map-side sums; the annotators' table
is broadcast only if it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.runtime import cut, sized_broadcast

#: Largest change of a tilt at which the rounds end, and rounds after which it is an error that they haven't.
SETTLED, ROUNDS = 1e-2, 200
#: Penalties of the annotators' and the items' parameters, and the tilt at which annotators start.
ANNOTATOR_PENALTY, ITEM_PENALTY, START = 0.5, 4.0, 1.5
ANNOTATORS_BROADCAST = 200_000


def acronym_label(c):
    """Trimmed, without dots and without a final lower-case s."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\.|^\s+|\s+(?=\.*$)", ""), r"(?<=.)s$", "")


def expansion_label(c):
    """Lower case, trimmed, with single blanks for hyphens and white space."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[-‐‑\s]+", " "))


def _entries(df: DataFrame, column: str, *keys: str) -> DataFrame:
    e = df.where(F.col(column).isNotNull()).select(*keys, F.explode(F.map_entries(column)).alias("e"))
    return (
        e.select(*keys, acronym_label(F.col("e.key")).alias("acronym"), expansion_label(F.col("e.value")).alias("label"))
        .where((F.length("acronym") > 0) & (F.length("label") > 0))
    )


def annotation_labels(
    rows: DataFrame, doc: str = "doc_id", annotator: str = "annotator", predicted: str = "predicted_expansions",
    actual: str = "actual_expansions", at: str = "submitted_at", row: str = "row_id",
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, acronym, annotator, label)`` of each annotator's latest submission, and the reviewer's ``(doc_id, acronym, gold)``.

    If a submission spells one acronym in several ways the least label counts.
    A submission with a null map is still the latest one. Rows without document
    or annotator give no label.
    """
    named = rows.select(F.col(doc).alias("doc_id"), F.col(annotator).alias("annotator"), predicted, actual, at, row).where("doc_id is not null")
    last = named.where("annotator is not null").groupBy("doc_id", "annotator").agg(
        F.max_by(predicted, F.struct(F.coalesce(F.col(at).cast("timestamp"), F.lit("1900-01-01").cast("timestamp")), row)).alias("m")
    )
    labels = _entries(last, "m", "doc_id", "annotator").groupBy("doc_id", "acronym", "annotator").agg(F.min("label").alias("label"))
    gold = (
        _entries(named.withColumn("_at", F.struct(at, row)), actual, "doc_id", "_at")
        .groupBy("doc_id", "acronym").agg(F.max_by("label", "_at").alias("gold"))
    )
    return labels, gold


def consensus(labels: DataFrame, gold: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, annotators, agreement).

    items: ``doc_id, acronym, expansion, confidence, agreement`` with agreement
    the share of agreeing pairs of annotators (1 for a single annotator);
    annotators: ``annotator, labels, tilt, reliability`` with the estimated
    share of right labels; agreement: one row ``items, labels, observed,
    expected, alpha`` (Krippendorff's alpha for nominal labels).

    Ties of the posterior go to the least label. Null labels must have been
    removed; items without labels have no row; empty tables give empty tables.
    """
    key = ["doc_id", "acronym"]
    labels = labels.select(*key, "annotator", "label")
    sizes = labels.groupBy(*key).agg((F.greatest(F.count_distinct("label"), F.lit(2))).cast("double").alias("k"))
    base = labels.join(sizes, key)
    if gold is not None:
        base = base.join(gold.select(*key, "gold"), key, "left")
    else:
        base = base.withColumn("gold", F.lit(None).cast("string"))
    # A reviewer's label no annotator gave can't be a consensus of theirs.
    by_item = Window.partitionBy(*key)
    base = base.withColumn("gold", F.max(F.when(F.col("label") == F.col("gold"), F.col("gold"))).over(by_item))
    base = cut(base.repartition(*key))

    params = cut(base.groupBy("annotator").agg(F.lit(START).alias("alpha")))
    items = None
    by_label = Window.partitionBy(*key, "label")
    for r in range(rounds):
        damp = min(1.0, 20 / (r + 1))  # slower steps if the rounds don't settle
        small, p = sized_broadcast(params, ANNOTATORS_BROADCAST)
        x = base.join(p, "annotator")
        x = x.join(items, key) if items is not None else x.withColumn("beta", F.lit(0.0))
        # Tilts are summed for each label; the posterior is their softmax over the item's labels.
        x = x.withColumn("s", F.col("alpha") + F.col("beta")).withColumn("score", F.sum("s").over(by_label))
        x = x.withColumn("first", F.row_number().over(by_label.orderBy("annotator")) == 1)
        x = x.withColumn("top", F.max("score").over(by_item))
        x = x.withColumn("e", F.exp(F.col("score") - F.col("top")))
        x = x.withColumn("z", F.sum(F.when(F.col("first"), F.col("e")).otherwise(0.0)).over(by_item))
        x = x.withColumn(
            "q", F.when(F.col("gold").isNotNull(), (F.col("label") == F.col("gold")).cast("double")).otherwise(F.col("e") / F.col("z"))
        )
        x = x.withColumn("p", F.exp("s") / (F.exp("s") + F.col("k") - 1))
        x = cut(x.select(*key, "annotator", "label", "k", "gold", "alpha", "beta", "q", "p"))
        surplus, curve = F.sum(F.col("q") - F.col("p")), F.sum(F.col("p") * (1 - F.col("p")))
        fresh = x.groupBy("annotator").agg(surplus.alias("g"), curve.alias("h"), F.first("alpha").alias("old"), F.avg("q").alias("reliability"), F.count("*").alias("labels"))
        fresh = cut(fresh.withColumn("alpha", F.col("old") + damp * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("g") - ANNOTATOR_PENALTY * (F.col("old") - START)) / (F.col("h") + ANNOTATOR_PENALTY)))))
        step = x.groupBy(*key).agg(surplus.alias("g"), curve.alias("h"), F.first("beta").alias("b"))
        items = step.select(*key, (F.col("b") + damp * F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (F.col("g") - ITEM_PENALTY * F.col("b")) / (F.col("h") + ITEM_PENALTY)))).alias("beta"))
        moved = fresh.agg(F.max(F.abs(F.col("alpha") - F.col("old")))).first()[0]
        params = fresh.select("annotator", "alpha")
        if moved is None or moved < SETTLED:
            break
    else:
        raise RuntimeError(f"the annotators' tilts haven't settled after {rounds} rounds")
    result = (
        x.groupBy(*key, "label").agg(F.max("q").alias("q"), F.count("*").alias("n"))
        .groupBy(*key)
        .agg(
            F.min_by("label", F.struct(-F.col("q"), "label")).alias("expansion"), F.max("q").alias("confidence"),
            F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"),
        )
        .select(*key, "expansion", "confidence", F.when(F.col("m") > 1, F.col("same") / (F.col("m") * (F.col("m") - 1))).otherwise(1.0).alias("agreement"))
    )
    annotators = fresh.select("annotator", "labels", F.col("alpha").alias("tilt"), "reliability")
    return result, annotators, krippendorff(labels)


def krippendorff(labels: DataFrame) -> DataFrame:
    """One row ``items, labels, observed, expected, alpha`` for nominal labels (acronym and expansion)."""
    counts = labels.groupBy("doc_id", "acronym", "label").agg(F.count("*").cast("double").alias("n"))
    items = counts.groupBy("doc_id", "acronym").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    seen = items.agg(F.count("*").alias("items"), F.sum("m").alias("labels"), F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("apart"))
    pairable = counts.join(items.select("doc_id", "acronym"), ["doc_id", "acronym"])
    # Chance disagreement is within an acronym: labels of different acronyms never meet.
    sums = pairable.groupBy("acronym", "label").agg(F.sum("n").alias("n"))
    per = sums.groupBy("acronym").agg(F.sum("n").alias("t"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("t > 1")
    chance = per.agg(F.sum((F.col("t") * (F.col("t") - 1) - F.col("same")) / (F.col("t") - 1)).alias("apart_by_chance"))
    j = seen.crossJoin(F.broadcast(chance))  # one row each
    observed, expected = F.col("apart") / F.col("labels"), F.col("apart_by_chance") / F.col("labels")
    return j.select(
        "items", F.col("labels").cast("long").alias("labels"), F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"),
        F.round(F.when(expected > 0, 1 - observed / expected).otherwise(1.0), 6).alias("alpha"),
    )
