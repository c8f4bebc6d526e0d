"""Scores of predictions: accuracies, precision and recall, by module, by fold, and their significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as X


def _ratio(a, b, digits: int = 6):
    return F.round(F.when(b > 0, a / b).otherwise(0.0), digits)


def _f1(p, r):
    return F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6)


def fold_accuracy(evaluated: DataFrame) -> DataFrame:
    """One row of means and population deviations over folds of four accuracies (A-14, A-15).

    ``evaluated`` has ``fold, success, n_options, in_db``: over all acronyms,
    those whose expansion the dictionary has, ambiguous ones, and both.
    """
    ok = F.col("success").cast("double")
    amb, known = F.col("n_options") > 1, F.col("in_db")
    per = evaluated.groupBy("fold").agg(
        F.avg(ok).alias("a"), F.avg(F.when(known, ok)).alias("b"), F.avg(F.when(amb, ok)).alias("c"), F.avg(F.when(amb & known, ok)).alias("d")
    )
    names = {"a": "all", "b": "known", "c": "ambiguous", "d": "ambiguous_known"}
    return per.agg(
        F.count("*").alias("folds"),
        *(F.round(F.avg(c), 6).alias(f"mean_{n}") for c, n in names.items()), *(F.round(F.stddev_pop(c), 6).alias(f"std_{n}") for c, n in names.items()),
    )


def per_expansion(evaluated: DataFrame) -> DataFrame:
    """``acronym, expansion, precision, recall, f1`` of every gold expansion; one never predicted has precision 1 (A-16, D-19)."""
    gold = evaluated.groupBy("acronym", F.col("actual").alias("expansion")).agg(F.count("*").alias("g"), F.sum(F.col("success").cast("long")).alias("hit"))
    said = evaluated.where("predicted is not null").groupBy("acronym", F.col("predicted").alias("expansion")).agg(F.count("*").alias("s"))
    j = gold.join(said, ["acronym", "expansion"], "left")
    p = F.when(F.coalesce("s", F.lit(0)) > 0, F.col("hit") / F.col("s")).otherwise(1.0)
    return j.select("acronym", "expansion", F.round(p, 6).alias("precision"), F.round(F.col("hit") / F.col("g"), 6).alias("recall")).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def macro(evaluated: DataFrame) -> DataFrame:
    """Macro precision, recall and mean F1 over gold expansions, and the harmonic mean of the first two (A-16, A-17)."""
    m = per_expansion(evaluated).agg(
        F.count("*").alias("expansions"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("f1"), 6).alias("mean_f1")
    )
    return m.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def micro(evaluated: DataFrame) -> DataFrame:
    """One row ``gold, predicted, right, precision, recall, f1`` (A-17)."""
    c = evaluated.agg(
        F.count("*").alias("gold"), F.sum(F.col("predicted").isNotNull().cast("long")).alias("predicted"), F.sum(F.col("success").cast("long")).alias("right")
    )
    return c.withColumn("precision", _ratio(F.col("right"), F.col("predicted"))).withColumn("recall", _ratio(F.col("right"), F.col("gold"))).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def matched(gold: DataFrame, predicted: DataFrame, ids: list[str]) -> DataFrame:
    """Full outer match of gold and predicted acronyms of a document, exact first, then without and with a plural s (J-08).

    ``*ids, acronym, gold, predicted, kind``; every prediction is used once; what
    is left over is spurious (gold null).
    """
    g = gold.select(*ids, F.col("acronym").alias("g_acr"), F.col("expansion").alias("gold"))
    p = predicted.select(*ids, F.col("acronym").alias("p_acr"), F.col("expansion").alias("predicted"))
    keys = g.select(*ids, "g_acr", "gold", F.explode(F.array(
        F.struct(F.lit(0).alias("rank"), F.col("g_acr").alias("k")),
        F.struct(F.lit(1).alias("rank"), F.regexp_replace("g_acr", "s$", "").alias("k")),
        F.struct(F.lit(2).alias("rank"), F.concat("g_acr", F.lit("s")).alias("k")),
    )).alias("x")).select(*ids, "g_acr", "gold", "x.rank", F.col("x.k").alias("p_acr"))
    c = keys.join(p, [*ids, "p_acr"])
    c = c.withColumn("r", F.row_number().over(Window.partitionBy(*ids, "g_acr").orderBy("rank", "p_acr"))).where("r = 1")
    c = c.withColumn("r", F.row_number().over(Window.partitionBy(*ids, "p_acr").orderBy("rank", "g_acr"))).where("r = 1").drop("r", "rank")
    hit = g.join(c.select(*ids, "g_acr", "p_acr", "predicted"), [*ids, "g_acr"], "left").select(
        *ids, F.col("g_acr").alias("acronym"), "gold", "predicted", F.when(F.col("p_acr").isNull(), "missed").otherwise("found").alias("kind")
    )
    spare = p.join(c.select(*ids, "p_acr"), [*ids, "p_acr"], "left_anti").select(
        *ids, F.col("p_acr").alias("acronym"), F.lit(None).cast("string").alias("gold"), "predicted", F.lit("spurious").alias("kind")
    )
    return hit.unionByName(spare)


def extraction_scores(match: DataFrame) -> DataFrame:
    """``element, right, extracted, gold, precision, recall, f1`` for acronyms, expansions and pairs (A-18).

    A spurious pair counts as extracted for acronyms and pairs, not for expansions (D-18).
    """
    found, spare = F.col("kind") == "found", F.col("kind") == "spurious"
    same = found & X.fuzzy_equal(F.col("gold"), F.col("predicted"))
    one = lambda c: F.sum(c.cast("long"))
    c = match.agg(
        one(found).alias("acr_right"), one(found | spare).alias("acr_out"), one(~spare).alias("acr_gold"),
        one(same).alias("exp_right"), one(found & F.col("predicted").isNotNull()).alias("exp_out"), one(~spare & F.col("gold").isNotNull()).alias("exp_gold"),
        one((found | spare) & F.col("predicted").isNotNull()).alias("pair_out"),
    )
    s = c.select(F.explode(F.array(
        F.struct(F.lit("acronyms").alias("element"), F.col("acr_right").alias("right"), F.col("acr_out").alias("extracted"), F.col("acr_gold").alias("gold")),
        F.struct(F.lit("expansions").alias("element"), F.col("exp_right").alias("right"), F.col("exp_out").alias("extracted"), F.col("exp_gold").alias("gold")),
        F.struct(F.lit("pairs").alias("element"), F.col("exp_right").alias("right"), F.col("pair_out").alias("extracted"), F.col("exp_gold").alias("gold")),
    )).alias("x")).select("x.*")
    s = s.withColumn("precision", _ratio(F.col("right"), F.col("extracted"))).withColumn("recall", _ratio(F.col("right"), F.col("gold")))
    return s.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def dictionary_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision and recall of distinct (acronym, expansion) pairs (A-19)."""
    g, p = gold.select("acronym", "expansion").distinct(), predicted.select("acronym", "expansion").distinct()
    g, p = g.withColumn("g", F.lit(1)), p.withColumn("p", F.lit(1))
    c = g.join(p, ["acronym", "expansion"], "full").agg(F.sum("g").alias("gold"), F.sum("p").alias("extracted"), F.sum(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("right"))
    c = c.na.fill(0)
    c = c.withColumn("precision", _ratio(F.col("right"), F.col("extracted"))).withColumn("recall", _ratio(F.col("right"), F.col("gold")))
    return c.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def by_module(evaluated: DataFrame) -> DataFrame:
    """``module, in_text, gold, predicted, right``: by module, by where the expansion stands, and in total, in one pass (A-20)."""
    e = evaluated.select("module", F.coalesce(F.col("in_text"), F.lit(False)).cast("string").alias("in_text"), "predicted", "success")
    return e.groupingSets([["module", "in_text"], ["module"], ["in_text"], []], "module", "in_text").agg(
        F.count("*").alias("gold"), F.sum(F.col("predicted").isNotNull().cast("long")).alias("predicted"), F.sum(F.col("success").cast("long")).alias("right"),
    ).select(F.coalesce("module", F.lit("total")).alias("module"), F.coalesce("in_text", F.lit("any")).alias("in_text"), "gold", "predicted", "right")


def _resampled(scores: DataFrame, column, draws: int, seed: int, draw) -> DataFrame:
    """``r, s, w``: for each of ``draws`` rounds the sums of drawn weight times value, and of the weights.

    Every document draws its own weights from a generator seeded by its id, so
    neither order nor partitions matter; a task sends one row a round.
    """
    def run(batches):
        import numpy as np
        import pandas as pd

        total, weights, rows = np.zeros(draws), np.zeros(draws), 0
        for pdf in batches:
            for key, value in zip(pdf["k"], pdf["v"]):
                w = draw(np.random.Generator(np.random.Philox(key=[key & (2**63 - 1), seed])), draws)
                total += w * value
                weights += w
                rows += 1
        if rows:
            yield pd.DataFrame({"r": np.arange(draws), "s": total, "w": weights})

    v = scores.select(F.xxhash64(F.col("doc_id")).alias("k"), column.cast("double").alias("v")).where("v is not null")
    return v.mapInPandas(run, "r long, s double, w double").groupBy("r").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def paired_randomisation(scores: DataFrame, rounds: int = 1_000, seed: int = 0) -> DataFrame:
    """``observed, p_value``: sign flips of the per-document differences ``a - b`` (G-07)."""
    diff = F.col("a") - F.col("b")
    sums = _resampled(scores, diff, rounds, seed, lambda rng, n: rng.integers(0, 2, n) * 2.0 - 1.0)
    seen = scores.agg(F.sum(diff.cast("double")).alias("t"), F.avg(diff.cast("double")).alias("observed"))
    return sums.crossJoin(F.broadcast(seen)).groupBy("observed").agg(
        F.round(F.avg((F.abs("s") >= F.abs("t") - 1e-9).cast("double")), 6).alias("p_value")
    ).select(F.round("observed", 6).alias("observed"), "p_value")


def bootstrap_interval(scores: DataFrame, resamples: int = 10_000, level: float = 0.9, seed: int = 0) -> DataFrame:
    """``mean, low, high`` by Poisson resampling of documents (G-08)."""
    m = _resampled(scores, F.col("a"), resamples, seed, lambda rng, n: rng.poisson(1.0, n)).where("w > 0").select((F.col("s") / F.col("w")).alias("m"))
    q = m.agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    return q.crossJoin(scores.agg(F.avg(F.col("a").cast("double")).alias("mean"))).select(F.round("mean", 6).alias("mean"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def document_scores(results: DataFrame, doc: str = "doc_id", success: str = "success") -> DataFrame:
    """``doc_id, right, total`` of a table of results, wherever a document's rows stand (G-09, W-02); null outcomes are not right."""
    return results.groupBy(F.col(doc).alias("doc_id")).agg(
        F.sum(F.coalesce(F.col(success).cast("boolean"), F.lit(False)).cast("long")).alias("right"), F.count("*").alias("total")
    )


def document_extraction_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``doc_id, tp, fp, fn`` over distinct ``doc_id, acronym, expansion`` (G-09)."""
    k = ["doc_id", "acronym", "expansion"]
    g, p = gold.select(*k).distinct().withColumn("g", F.lit(1)), predicted.select(*k).distinct().withColumn("p", F.lit(1))
    both = g.join(p, k, "full")
    n = lambda c: F.sum(c.cast("long"))
    return both.groupBy("doc_id").agg(
        n(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), n(F.col("g").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn")
    )


def shared_spans(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """The spans (all columns) that both have, once each (U-05)."""
    return predicted.select(*gold.columns).intersect(gold)


def execution_times(reports: DataFrame) -> DataFrame:
    """``fold, reports, skipped, total_time, mean_time`` (A-24)."""
    return reports.groupBy("fold").agg(
        F.count("*").alias("reports"), F.sum(F.coalesce(F.col("skipped"), F.lit(False)).cast("long")).alias("skipped"),
        F.round(F.sum(F.col("execution_times").cast("double")), 4).alias("total_time"), F.round(F.avg(F.col("execution_times").cast("double")), 4).alias("mean_time"),
    )
