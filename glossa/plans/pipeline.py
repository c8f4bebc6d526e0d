"""End-to-end plans: from raw documents to an expansion for every acronym."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import acronyms as A
from glossa.operators import dictionary as D
from glossa.operators import inexpansion as I


def end_to_end(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, rules: tuple[str, ...] = ("schwartz_hearst",)) -> DataFrame:
    """``id_col, acronym, expansion, confidence, module`` of every acronym that can be resolved (G-01, F-04, F-05, T-06).

    Acronyms defined in the text take that expansion; the rest is routed: no
    option drops it, one option is taken, of several the most frequent is.
    """
    found = I.best_by_priority(I.extract(docs, id_col, text_col, rules), id_col)
    found = found.select(id_col, F.upper("acronym").alias("acronym"), F.lower("expansion").alias("in_text")).groupBy(id_col, "acronym").agg(F.min("in_text").alias("in_text"))
    every = A.exploded(docs, id_col, A.v2(F.col(text_col), 2)).withColumn("acronym", F.regexp_replace("acronym", "(?<=..)S$", "")).distinct()
    best = D.most_frequent(pairs)
    j = every.join(found, [id_col, "acronym"], "full").join(best, "acronym", "left")
    one = F.col("n_options") == 1
    return j.select(
        id_col, "acronym", F.coalesce("in_text", "expansion").alias("expansion"),
        F.when(F.col("in_text").isNotNull(), 1.0).when(one, -5.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("in_text").isNotNull(), "in_expander").when(one, "single_option").otherwise("out_expander").alias("module"),
    ).where("expansion is not null")


def corpus(docs: DataFrame, id_col: str, text_col: str, rules: tuple[str, ...] = ("schwartz_hearst",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles with substituted, cleaned text; acronym pairs; train/test roles and folds) of raw documents (G-04).

    Pairs whose substitution changes nothing are dropped, and documents without pairs with them (F-06).
    """
    from glossa.functions import text as X

    pairs = I.best_by_priority(I.extract(docs, id_col, text_col, rules), id_col)
    per = pairs.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("acronym", "expansion"))).alias("pairs"))
    d = docs.select(id_col, F.col(text_col).alias("raw_text")).join(per, id_col)
    d = d.withColumn("text", X.substitute_pairs(F.col("raw_text"), F.col("pairs"))).where("text <> raw_text")
    articles = d.select(id_col, "raw_text", F.array_join(X.content_words(F.col("text")), " ").alias("text"))
    roles = D.hashed_fold(articles, 10, id_col).select(id_col, F.when(F.col("fold") < 7, "train").otherwise("test").alias("role"), (F.col("fold") % 5).alias("fold"))
    return articles, pairs.join(articles.select(id_col), id_col, "left_semi"), roles


def sorted_output(expansions: DataFrame, id_col: str) -> DataFrame:
    """The rows by document and acronym, for output (T-06); the only place where rows are put in order."""
    return expansions.orderBy(id_col, "acronym")
