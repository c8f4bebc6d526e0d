"""BIO-tagged sentences: codecs, and pairing of tagged short and long forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_bio(tokens: DataFrame) -> DataFrame:
    """Plain labels to BIO: a label begins where the one before differs (E-17). ``sent_id, pos, token, label``."""
    before = F.coalesce(F.lag("label").over(Window.partitionBy("sent_id").orderBy("pos")), F.lit("O"))
    return tokens.withColumn("label", F.when(F.col("label") == "O", "O").when(F.col("label") == before, F.concat(F.lit("I-"), F.col("label"))).otherwise(F.concat(F.lit("B-"), F.col("label"))))


def from_bioul(tokens: DataFrame) -> DataFrame:
    """BIOUL (or unit tags) to BIO: units begin, lasts continue (E-17)."""
    return tokens.withColumn("label", F.regexp_replace(F.regexp_replace("label", "^U-", "B-"), "^L-", "I-"))


def spans(tokens: DataFrame) -> DataFrame:
    """``sent_id, kind, start, stop, form``: runs of one kind, a B opening a new run (W-04)."""
    w = Window.partitionBy("sent_id").orderBy("pos")
    kind = F.regexp_extract("label", r"^[BI]-(.*)$", 1)
    t = tokens.withColumn("kind", kind)
    opens = (F.col("kind") != "") & (F.col("label").startswith("B-") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind")))
    t = t.withColumn("run", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> ''")
    return t.groupBy("sent_id", "run", "kind").agg(
        F.min("pos").alias("start"), F.max("pos").alias("stop"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("form"),
    ).drop("run")


def _capitals(s: str) -> str:
    return "".join(c for c in s if c.isupper()).lower()


def _steps(short: str, long: list[str], gap: list[str], near: int, threshold: float) -> int | None:
    """Rank of the strongest evidence that a short form means a long one, least first; None without any."""
    low = short.lower()
    first = "".join(w[0] for w in long).lower()
    caps = "".join(w[0] for w in long if w[0].isupper()).lower()
    if first == low or first == _capitals(short) and first:
        return 0
    if caps and caps == _capitals(short):
        return 1
    if sum(c in low for c in first) >= threshold * len(first) > 0:
        return 2
    if "(" in gap and near <= 3:
        return 3
    return 4 if near < 3 else None


def paired_forms(tokens: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``sent_id, acronym, expansion``: every long form with its best short form; short forms without one have null (E-18).

    Evidence in order: initials, capital initials, share of initials, brackets
    between, nearness. The first long form of an acronym stays.
    """
    s = spans(tokens)
    words = tokens.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    g = s.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "form"))).alias("spans")).join(words, "sent_id")

    def run(batches):
        for pdf in batches:
            out = []
            for sent, sp, toks in zip(pdf["sent_id"], pdf["spans"], pdf["tokens"]):
                shorts = [x for x in sp if x["kind"] == "short"]
                got: dict[str, str | None] = {}
                for long in (x for x in sp if x["kind"] == "long"):
                    options = []
                    for short in shorts:
                        lo, hi = sorted(((long["start"], long["stop"]), (short["start"], short["stop"])))
                        gap = list(toks[lo[1] + 1 : hi[0]])
                        rank = _steps(short["form"], long["form"].split(" "), gap, hi[0] - lo[1], threshold)
                        if rank is not None:
                            options.append((rank, hi[0] - lo[1], short["start"], short["form"]))
                    if options:
                        got.setdefault(min(options)[3], long["form"])
                for short in shorts:
                    got.setdefault(short["form"], None)
                out += [(sent, a, e) for a, e in got.items()]
            yield pd.DataFrame(out, columns=["sent_id", "acronym", "expansion"])

    id_type = tokens.schema["sent_id"].dataType.simpleString()
    return g.mapInPandas(run, f"sent_id {id_type}, acronym string, expansion string")


def token_mode(votes: DataFrame) -> DataFrame:
    """``sent_id, pos, label``: the label most models gave a token; ties go to the least (E-16)."""
    n = votes.groupBy("sent_id", "pos", "label").agg(F.count("*").alias("n"))
    return n.groupBy("sent_id", "pos").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))


def token_features(tokens: DataFrame) -> DataFrame:
    """A token with its neighbours and shape, the features of a sequence tagger (W-03)."""
    w = Window.partitionBy("sent_id").orderBy("pos")
    return tokens.select(
        "sent_id", "pos", "token", F.lag("token").over(w).alias("previous"), F.lead("token").over(w).alias("next"),
        (F.col("token") == F.upper("token")).alias("upper"), F.col("token").rlike(r"^\p{N}+$").alias("digits"), F.right("token", F.lit(3)).alias("suffix"),
    )
