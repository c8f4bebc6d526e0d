"""The acronym dictionary: building, inverting, filtering, routing and its baselines.

A dictionary is a flat relation ``acronym, expansion, article_id`` (optionally
``in_text``); nested forms are views of it. Nothing here is per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as X


def normalised(pairs: DataFrame) -> DataFrame:
    """``acronym, expansion, article_id, in_text`` under their keys; pairs without acronym or expansion are dropped."""
    return (
        pairs.select(
            X.acronym_key(F.col("acronym")).alias("acronym"), X.expansion_key(F.col("expansion")).alias("expansion"),
            "article_id", *(["in_text"] if "in_text" in pairs.columns else []),
        ).where("acronym <> '' and expansion <> ''")
    )


def most_frequent(pairs: DataFrame) -> DataFrame:
    """``acronym, expansion, confidence, n_options``: the most frequent expansion; ties go to the least (A-01, C-04).

    Two aggregations with map-side sums; the second keeps the best by ``min_by``, so no sort and no window.
    """
    counts = pairs.groupBy("acronym", "expansion").agg(F.count("*").alias("n"))
    return counts.groupBy("acronym").agg(
        F.min_by("expansion", F.struct(-F.col("n"), "expansion")).alias("expansion"),
        F.round(F.max("n") / F.sum("n"), 6).alias("confidence"),
        F.count("*").alias("n_options"),
    )


def distinct_options(pairs: DataFrame) -> DataFrame:
    """``acronym, options, share``: sorted distinct expansions and the confidence of a uniform choice (A-02)."""
    o = pairs.groupBy("acronym").agg(F.array_sort(F.collect_set("expansion")).alias("options"))
    return o.withColumn("share", F.round(1.0 / F.size("options"), 6))


def seeded_choice(tests: DataFrame, pairs: DataFrame, seed: int = 1337) -> DataFrame:
    """A uniform but repeatable choice for each (article_id, acronym) (C-05)."""
    o = distinct_options(pairs)
    pick = F.pmod(F.xxhash64("article_id", "acronym", F.lit(seed)), F.size("options").cast("long")).cast("int")
    return tests.join(o, "acronym").select("article_id", "acronym", F.get("options", pick).alias("expansion"), F.col("share").alias("confidence"))


def nested(pairs: DataFrame) -> DataFrame:
    """``acronym, entries``: one row an acronym, with sorted distinct (expansion, article_id) (J-07 source, A-09)."""
    return pairs.groupBy("acronym").agg(F.array_sort(F.collect_set(F.struct("expansion", "article_id"))).alias("entries"))


def article_map(pairs: DataFrame) -> DataFrame:
    """``article_id, pairs``: map of acronyms to expansions of an article; of several expansions the least (A-03)."""
    one = pairs.where(F.col("article_id").isNotNull()).groupBy("article_id", "acronym").agg(F.min("expansion").alias("expansion"))
    return one.groupBy("article_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("acronym", "expansion")))).alias("pairs"))


def definition_index(pairs: DataFrame) -> DataFrame:
    """``acronym, expansion, def_idx, canonical``: sorted expansions start a new definition when their word beginnings change (A-05)."""
    d = pairs.select("acronym", "expansion").distinct().withColumn("key", X.prefix_key(F.col("expansion")))
    w = Window.partitionBy("acronym").orderBy("expansion")
    change = F.coalesce((F.col("key") != F.lag("key").over(w)).cast("int"), F.lit(0))
    d = d.withColumn("change", change).withColumn("def_idx", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy("acronym", "def_idx").orderBy("expansion")
    return d.select("acronym", "expansion", "def_idx", F.first("expansion").over(first).alias("canonical"))


def plural_keys_joined(pairs: DataFrame) -> DataFrame:
    """Pairs under their singular acronym where both the singular and the plural key exist (J-07)."""
    keys = pairs.select(F.col("acronym").alias("k")).distinct()
    p = pairs.join(keys, F.col("k") == X.singular_acronym(F.col("acronym")), "left")
    return p.withColumn("acronym", F.coalesce("k", "acronym")).drop("k")


def in_articles(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of listed articles (F-01)."""
    return df.join(ids.select("article_id").distinct(), "article_id", "left_semi")


def not_in_articles(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of other articles (F-02, U-04)."""
    return df.join(ids.select("article_id").distinct(), "article_id", "left_anti")


def leakage(train: DataFrame, test: DataFrame) -> DataFrame:
    """Articles in both sets; empty if the split is clean (F-03)."""
    return train.select("article_id").distinct().join(test.select("article_id").distinct(), "article_id", "left_semi")


def ambiguous(pairs: DataFrame) -> DataFrame:
    """Pairs of acronyms with several expansions (F-07)."""
    many = pairs.groupBy("acronym").agg(F.count_distinct("expansion").alias("n")).where("n > 1").select("acronym")
    return pairs.join(many, "acronym", "left_semi")


def visible_expansion(pairs: DataFrame) -> DataFrame:
    """The expansion only where it stands in the text, else null (F-10)."""
    return pairs.withColumn("expansion", F.when(F.col("in_text"), F.col("expansion")))


def routed(tests: DataFrame, pairs: DataFrame) -> DataFrame:
    """``article_id, acronym, n_options, route, expansion, confidence``: what becomes of each test acronym (G-02).

    Without training data it is skipped, a single option is taken with
    confidence -5, and several go to an expander (expansion null).
    """
    o = pairs.groupBy("acronym").agg(F.count_distinct("expansion").alias("n_options"), F.min("expansion").alias("only"))
    j = tests.select("article_id", "acronym").distinct().join(o, "acronym", "left")
    n = F.coalesce("n_options", F.lit(0))
    return j.select(
        "article_id", "acronym", n.alias("n_options"),
        F.when(n == 0, "skip").when(n == 1, "single").otherwise("expander").alias("route"),
        F.when(n == 1, F.col("only")).alias("expansion"), F.when(n == 1, F.lit(-5.0)).alias("confidence"),
    )


def prefixed_union(parts: list[DataFrame]) -> DataFrame:
    """Datasets under ids that carry their number (U-01)."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("article_id", F.concat(F.lit(f"{i}_"), F.col("article_id")))
        out = p if out is None else out.unionByName(p)
    return out


def last_wins(parts: list[DataFrame], *keys: str) -> DataFrame:
    """Union in which, for equal keys, the later dataset's row stays (U-02)."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_rank", F.lit(i))
        out = p if out is None else out.unionByName(p)
    cols = [c for c in out.columns if c not in (*keys, "_rank")]
    best = out.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("_rank", *cols)).alias("r"))
    return best.select(*keys, "r.*")


def corrected(pairs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Manual corrections ``acronym, expansion, correct`` applied (J-17)."""
    return pairs.join(corrections, ["acronym", "expansion"], "left").withColumn("expansion", F.coalesce("correct", "expansion")).drop("correct")


def external_evidence(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Which of two outside dictionaries knows each (acronym, expansion): first, second or neither (F-13)."""
    d = pairs.select("acronym", "expansion").distinct()
    tag = lambda x, n: x.select("acronym", "expansion").distinct().withColumn(n, F.lit(True))
    j = d.join(tag(first, "a"), ["acronym", "expansion"], "left").join(tag(second, "b"), ["acronym", "expansion"], "left")
    return j.select("acronym", "expansion", F.when(F.col("a"), "first").when(F.col("b"), "second").otherwise("neither").alias("evidence"))


def hashed_fold(ids: DataFrame, folds: int, id_col: str = "article_id") -> DataFrame:
    """``id_col, fold``: a repeatable fold from the md5 of the id, the same in every engine (T-08)."""
    digits = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    return ids.select(id_col).distinct().withColumn("fold", (digits % folds).cast("int"))


def corpus_statistics(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of counts: articles, acronyms, expansions, ambiguous acronyms and their means (A-23)."""
    per = pairs.groupBy("acronym").agg(F.count_distinct("expansion").alias("n"))
    p = per.agg(
        F.count("*").alias("acronyms"), F.sum("n").alias("expansions"), F.sum((F.col("n") > 1).cast("long")).alias("ambiguous"),
        F.round(F.avg(F.when(F.col("n") > 1, F.col("n"))), 6).alias("expansions_per_ambiguous"),
    )
    a = articles.agg(F.count_distinct("article_id").alias("articles"))
    m = pairs.where("article_id is not null").groupBy("article_id").agg(F.count_distinct("acronym", "expansion").alias("k")).agg(F.round(F.avg("k"), 6).alias("expansions_per_article"))
    return a.crossJoin(p).crossJoin(m)  # one row each


def rewritten_tests(tests: DataFrame, id_col: str, text_col: str = "text", pairs_col: str = "pairs") -> tuple[DataFrame, DataFrame]:
    """(``id_col, text, pairs``, ids left out): expansion tokens of test texts back to acronyms (F-11).

    ``pairs_col`` is an array of (acronym, expansion), applied in order. Only
    pairs whose token stands in the text stay; a text without any is left out
    and listed apart instead of failing the run.
    """
    from glossa.functions import text as X

    def step(state, p):
        text, n = X.restore_acronym(state["text"], p["expansion"], p["acronym"])
        hit = (p["expansion"].isNotNull()) & (n > 0)
        return F.struct(
            F.when(hit, text).otherwise(state["text"]).alias("text"),
            F.when(hit, F.array_append(state["pairs"], p)).otherwise(state["pairs"]).alias("pairs"),
        )

    kind = tests.schema[pairs_col].dataType.simpleString()
    start = F.struct(F.col(text_col).alias("text"), F.array().cast(kind).alias("pairs"))
    done = tests.where(F.col(text_col).isNotNull()).select(id_col, F.aggregate(pairs_col, start, step).alias("x")).select(id_col, "x.text", "x.pairs")
    return done.where(F.size("pairs") > 0), done.where(F.size("pairs") == 0).select(id_col)
