"""Queries of the training-data operators: {name: callable(spark, sf_dir)} and their SQL."""

from __future__ import annotations

from glossa.runtime import table


def p1_found(spark, sf_dir):
    from glossa.llm.sentences import sentences

    return sentences(table(spark, sf_dir, "sci_dr"))


def p2_found(spark, sf_dir):
    from glossa.llm.canonical import map_to_reference

    return map_to_reference(table(spark, sf_dir, "scraped_definitions"), table(spark, sf_dir, "expansion_reference"))


def _p3(spark, sf_dir):
    from glossa.llm.consensus import annotation_labels, consensus

    return consensus(*annotation_labels(table(spark, sf_dir, "compare_annotations")))


def p3_found(spark, sf_dir):
    return _p3(spark, sf_dir)[0].select("doc_id", "acronym", "expansion")


def p3_reliability(spark, sf_dir):
    return _p3(spark, sf_dir)[1]


def p3_agreement(spark, sf_dir):
    """Krippendorff's alpha over all items."""
    from glossa.llm.consensus import annotation_labels, krippendorff

    return krippendorff(annotation_labels(table(spark, sf_dir, "compare_annotations"))[0])


def _p4_groups(spark, sf_dir):
    from glossa.llm.grouped import related_groups

    return related_groups(table(spark, sf_dir, "sci_dr"))


def p4_found(spark, sf_dir):
    from glossa.llm.grouped import latest_folds, torn_articles

    folds = latest_folds(table(spark, sf_dir, "results_reporter_base"))
    return torn_articles(_p4_groups(spark, sf_dir), folds).select("doc_id")


def p4_splits(spark, sf_dir):
    """The 80/10/10 split of all articles, stratified by the languages of their passages."""
    from glossa.llm.grouped import stratified_splits
    from pyspark.sql import functions as F

    labels = table(spark, sf_dir, "sci_dr").select("article_id", F.lower(F.trim("lang")).alias("label"))
    return stratified_splits(_p4_groups(spark, sf_dir), labels)


def p5_found(spark, sf_dir):
    from glossa.llm.copies import copy_classes, pairs_of_classes

    return pairs_of_classes(copy_classes(table(spark, sf_dir, "sci_dr")), "sample_id_a", "sample_id_b")


def p5_classes(spark, sf_dir):
    """Every record with its class: those without a copy are a class of their own."""
    from glossa.llm.copies import copy_classes
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "sci_dr")
    classes = copy_classes(docs).withColumnRenamed("id", "sample_id")
    return docs.select("sample_id").join(classes, "sample_id", "left").select(
        "sample_id", F.coalesce("class_id", "sample_id").alias("class_id")
    )


def _p6_overlaps(spark, sf_dir):
    from glossa.llm.overlap import cross_split_overlaps, split_records

    records = split_records(table(spark, sf_dir, "sci_dr"), table(spark, sf_dir, "splits"))
    return records, cross_split_overlaps(records)


def p6_found(spark, sf_dir):
    from pyspark.sql import functions as F

    _, o = _p6_overlaps(spark, sf_dir)
    return o.select(
        F.least("held_id", "train_id").alias("sample_id_a"), F.greatest("held_id", "train_id").alias("sample_id_b")
    ).distinct()


def p6_counts(spark, sf_dir):
    """Overlapping evaluation records, pairs and mean best containment per role and source."""
    from pyspark.sql import functions as F

    records, o = _p6_overlaps(spark, sf_dir)
    best = o.groupBy(F.col("held_id").alias("id")).agg(F.count("*").alias("pairs"), F.max("containment").alias("best"))
    held = records.where("held").select("id", "role", "source").distinct()
    return held.join(best, "id").groupBy("role", "source").agg(
        F.count("*").alias("records"), F.sum("pairs").alias("pairs"), F.round(F.avg("best"), 4).alias("mean_containment")
    )


def p7_ids(spark, sf_dir):
    from glossa.llm.tokens import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"))



def _p8(spark, sf_dir):
    from glossa.llm.leaks import leaked

    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark, sf_dir):
    return _p8(spark, sf_dir).select("doc_id", "item_id")


def p8_report(spark, sf_dir):
    """Documents, whole and partial copies of each leaked item."""
    from pyspark.sql import functions as F

    return _p8(spark, sf_dir).groupBy("item_id").agg(
        F.count("*").alias("documents"), F.sum((F.col("part") >= 0.9).cast("int")).alias("whole"), F.max("part").alias("most")
    )


def p8_clean(spark, sf_dir):
    """The documents that hold no evaluation passage."""
    from glossa.llm.leaks import without_leaks

    return without_leaks(table(spark, sf_dir, "documents"), _p8(spark, sf_dir)).select("doc_id", "source")


def _p9(spark, sf_dir):
    from glossa.llm.reading import reading_levels

    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_samples"))


def p9_found(spark, sf_dir):
    return _p9(spark, sf_dir).select("doc_id", "reading_level")


def p9_profile(spark, sf_dir):
    """Documents and mean expected level per source and level."""
    from pyspark.sql import functions as F

    levels = _p9(spark, sf_dir)
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(levels, "doc_id").groupBy("source", "reading_level").agg(
        F.count("*").alias("documents"), F.round(F.avg("expected"), 4).alias("mean_level")
    )


QUERIES = {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}

_P3_LABELS = (
    "last AS (SELECT doc_id, annotator, predicted_expansions AS m FROM compare_annotations WHERE doc_id IS NOT NULL AND annotator IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY doc_id, annotator ORDER BY submitted_at DESC NULLS LAST, row_id DESC) = 1), "
    "e AS (SELECT doc_id, annotator, unnest(map_entries(m)) AS e FROM last WHERE m IS NOT NULL), "
    "l AS (SELECT doc_id, annotator, regexp_replace(trim(regexp_replace(trim(e.key), '\\.', '', 'g')), '(.)s$', '\\1') AS acronym, trim(regexp_replace(lower(e.value), '[-\\s]+', ' ', 'g')) AS label FROM e), "
    "labels AS (SELECT doc_id, acronym, annotator, min(label) AS label FROM l WHERE acronym <> '' AND label <> '' GROUP BY 1, 2, 3)"
)
ORACLE: dict[str, str] = {
    "p3_agreement": (
        f"WITH {_P3_LABELS}, c AS (SELECT doc_id, acronym, label, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2, 3), i AS (SELECT doc_id, acronym, sum(n) AS m, sum(n * (n - 1)) AS same FROM c GROUP BY 1, 2 HAVING sum(n) > 1), "
        "o AS (SELECT count(*) AS items, sum(m) AS labels, sum((m * (m - 1) - same) / (m - 1)) AS apart FROM i), s AS (SELECT c.acronym, label, sum(n) AS n FROM c JOIN i ON c.doc_id = i.doc_id AND c.acronym = i.acronym GROUP BY 1, 2), "
        "t AS (SELECT acronym, sum(n) AS t, sum(n * (n - 1)) AS same FROM s GROUP BY 1 HAVING sum(n) > 1), x AS (SELECT sum((t * (t - 1) - same) / (t - 1)) AS chance FROM t) "
        "SELECT items, labels::BIGINT AS labels, round(apart / labels, 6) AS observed, round(chance / labels, 6) AS expected, round(CASE WHEN chance > 0 THEN 1 - apart / chance ELSE 1 END, 6) AS alpha FROM o, x"
    ),
}
