"""Writers of relations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_relation(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, partitioned by dataset or fold (K-01, K-02)."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def append_report(df: DataFrame, path: str) -> None:
    """CSV report with header, appended; maps and arrays become JSON (K-03, K-05, K-08)."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_confidences(spark, path: str) -> DataFrame:
    """The confidence log with its map read back (S-01 of reports)."""
    r = spark.read.option("header", True).option("escape", '"').csv(path)
    return r.withColumn("confidences", F.from_json("confidences", "map<string,double>"))


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines ``{id, prediction}`` (K-06)."""
    df.select(F.col("article_id").alias("id"), F.col("expansion").alias("prediction")).write.mode("overwrite").json(path)


def responses(df: DataFrame, id_col: str) -> DataFrame:
    """``id_col, response``: acronyms of a document as a JSON object (K-07)."""
    one = df.groupBy(id_col, "acronym").agg(F.min("expansion").alias("expansion"))
    return one.groupBy(id_col).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("acronym", "expansion"))))).alias("response"))


def append_jdbc(df: DataFrame, url: str, table: str, dead_letter: str, **options: str) -> bool:
    """Append to a database; if it can't be reached the rows go to parquet under ``dead_letter`` (K-04)."""
    try:
        df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()
        return True
    except Exception:
        df.write.mode("append").parquet(dead_letter)
        return False
