"""Streams of documents: extraction is stateless per document, so the batch operators run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import acronyms as A


def document_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def expanded(stream: DataFrame, best: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, acronym, expansion, confidence`` by a stream-static join with the dictionary's most frequent expansions."""
    found = stream.select(id_col, F.explode(A.v2(F.col(text_col), 2)).alias("acronym"))
    return found.join(best, "acronym", "left").select(id_col, "acronym", "expansion", "confidence")


def hourly_acronyms(stream: DataFrame, time_col: str, text_col: str = "text", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """``start, acronym, n``: acronyms per time window, late rows accepted up to a watermark."""
    found = stream.select(F.col(time_col).alias("at"), F.explode(A.v2(F.col(text_col), 2)).alias("acronym"))
    return found.withWatermark("at", late).groupBy(F.window("at", width), "acronym").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "acronym", "n")
