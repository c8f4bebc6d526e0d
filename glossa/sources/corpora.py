"""Readers of corpus formats, all to the same relations.

Each returns plain DataFrames; nested files are exploded, identifiers become strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def key_value(spark: SparkSession, path: str) -> DataFrame:
    """Stored articles, pairs or maps as parquet (S-01 to S-03)."""
    return spark.read.parquet(path)


def scraped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and quoted line breaks (S-04, S-12)."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def wiki_documents(spark: SparkSession, path: str) -> DataFrame:
    """``article_id, url, title, text`` of files of <doc id url title> elements (S-05 to S-07)."""
    raw = spark.read.text(path, wholetext=True)
    d = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<doc\b.*?</doc>)"), F.lit(1))).alias("d"))
    at = lambda name: F.regexp_extract("d", rf'{name}="([^"]*)"', 1)
    return d.select(at("id").alias("article_id"), at("url").alias("url"), at("title").alias("title"), F.regexp_extract("d", r"(?s)^<doc\b[^>]*>\s*(.*?)\s*</doc>$", 1).alias("text"))


def bioc_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``article_id, acronym, expansion`` of annotated collections: annotations joined over their relations (S-08, J-12)."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<document>.*?</document>)"), F.lit(1))).alias("d"))
    docs = docs.withColumn("article_id", F.regexp_extract("d", r"(?s)<id>([^<]*)</id>", 1))
    notes = docs.select("article_id", F.explode(F.regexp_extract_all("d", F.lit(r"(?s)(<annotation .*?</annotation>)"), F.lit(1))).alias("x")).select(
        "article_id", F.regexp_extract("x", r'<annotation id="([^"]*)"', 1).alias("ref"), F.regexp_extract("x", r"(?s)<text>(.*?)</text>", 1).alias("form")
    )
    links = docs.select("article_id", F.explode(F.regexp_extract_all("d", F.lit(r"(?s)(<relation .*?</relation>)"), F.lit(1))).alias("x")).select(
        "article_id", F.regexp_extract("x", r'refid="([^"]*)" role="ShortForm"', 1).alias("s"), F.regexp_extract("x", r'refid="([^"]*)" role="LongForm"', 1).alias("l")
    )
    s = notes.select("article_id", F.col("ref").alias("s"), F.col("form").alias("acronym"))
    l = notes.select("article_id", F.col("ref").alias("l"), F.col("form").alias("expansion"))
    return links.join(s, ["article_id", "s"]).join(l, ["article_id", "l"]).select("article_id", "acronym", "expansion")


def arff_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, article_id, text, code`` of ARFF data lines ``id,"text",code`` (S-09)."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    row = r'^\s*([^,@%]+),\s*"((?:[^"\\]|\\.)*)"\s*,\s*(\S+)\s*$'
    return raw.where(F.col("value").rlike(row)).select("file", F.regexp_extract("value", row, 1).alias("article_id"), F.regexp_extract("value", row, 2).alias("text"), F.regexp_extract("value", row, 3).alias("code"))


def coded_lines(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    """``line, acronym, expansion, text`` of lines that hold a code of ``codes(code, acronym, expansion)`` (S-10)."""
    t = spark.read.text(path).select(F.col("value").alias("text"), F.explode(F.array_distinct(F.split("value", r"\s+"))).alias("code"))
    return t.join(codes, "code").select("text", "code", "acronym", "expansion")


def sgml_articles(spark: SparkSession, path: str) -> DataFrame:
    """``article_id, text`` of <reuters newid> elements with a body (S-11, P-15)."""
    raw = spark.read.text(path, wholetext=True)
    d = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)(<reuters\b.*?</reuters>)"), F.lit(1))).alias("d"))
    body = F.regexp_extract("d", r"(?is)<body>(.*?)</body>", 1)
    return d.select(F.regexp_extract("d", r'(?i)newid="(\d+)"', 1).alias("article_id"), F.regexp_replace(body, r"\n(?!    )", " ").alias("text")).where("text <> ''")


def token_samples(spark: SparkSession, path: str) -> DataFrame:
    """``article_id, acronym, expansion, text`` of JSON samples {id, tokens, acronym: place, expansion} (S-13)."""
    s = spark.read.schema("id string, tokens array<string>, acronym int, expansion string").json(path, multiLine=True)
    return s.select(F.col("id").alias("article_id"), F.get("tokens", F.col("acronym")).alias("acronym"), "expansion", F.array_join("tokens", " ").alias("text"))


def tagged_sentences(spark: SparkSession, path: str) -> DataFrame:
    """``sent_id, pos, token, label`` of JSON sentences {id, tokens, labels} (S-14)."""
    s = spark.read.schema("id string, tokens array<string>, labels array<string>").json(path, multiLine=True)
    z = s.select(F.col("id").alias("sent_id"), F.posexplode(F.arrays_zip("tokens", "labels")).alias("pos", "x"))
    return z.select("sent_id", "pos", F.col("x.tokens").alias("token"), F.col("x.labels").alias("label"))


def masked_lines(spark: SparkSession, path: str, mask: str = "__ABB__") -> DataFrame:
    """``article_id, acronym, expansion, text`` of JSON lines {sentence, short-form, long-form} with a masked short form (S-15)."""
    s = spark.read.schema("sentence array<string>, `short-form` string, `long-form` string").json(path)
    text = F.replace(F.array_join("sentence", " "), F.lit(mask), F.col("`short-form`"))
    t = s.select(F.col("`short-form`").alias("acronym"), F.col("`long-form`").alias("expansion"), text.alias("text"))
    return t.select(F.md5(F.concat_ws("|", "acronym", "expansion", "text")).alias("article_id"), "acronym", "expansion", "text")


def nested_possibilities(spark: SparkSession, path: str) -> DataFrame:
    """``acronym, expansion, link, text`` of one JSON object of acronyms with possibilities (S-16)."""
    entry = "struct<full_form string, link string, content string>"
    kind = f"map<string, struct<full_form string, link string, content string, possibilities array<{entry}>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("acronym", "v"))
    own = F.struct(F.col("v.full_form").alias("full_form"), F.col("v.link").alias("link"), F.col("v.content").alias("content"))
    every = F.array_union(F.array(own), F.coalesce("v.possibilities", F.array().cast(f"array<{entry}>")))
    return raw.select("acronym", F.explode(every).alias("p")).where("p.full_form is not null").select("acronym", F.col("p.full_form").alias("expansion"), F.col("p.link").alias("link"), F.col("p.content").alias("text"))


def span_samples(spark: SparkSession, path: str) -> DataFrame:
    """``article_id, text, acronyms, expansions`` of JSON samples with [start, end] places (S-17)."""
    s = spark.read.schema("ID string, text string, acronyms array<array<int>>, `long-forms` array<array<int>>").json(path, multiLine=True)
    cut = lambda c: F.transform(c, lambda p: F.substring("text", p[0] + 1, p[1] - p[0]))
    return s.select(F.col("ID").alias("article_id"), "text", cut(F.col("acronyms")).alias("acronyms"), cut(F.col("`long-forms`")).alias("expansions"))


def annotation_cells(rows: DataFrame, id_col: str, cell: str) -> DataFrame:
    """``id_col, acronym, expansion`` of cells of "acronym;expansion" lines; other lines are left out (S-18)."""
    lines = rows.select(id_col, F.explode(F.split(cell, r"\r?\n")).alias("l")).select(id_col, F.split("l", ";").alias("p")).where(F.size("p") == 2)
    return lines.select(id_col, F.trim(F.col("p")[0]).alias("acronym"), F.lower(F.trim(F.col("p")[1])).alias("expansion")).where("acronym <> ''")


def labelled_text(lines: DataFrame) -> DataFrame:
    """``doc_id, acronym, expansion, in_text`` of lines "doc : " and "acronym | expansion", brackets for not in the text (S-19).

    ``lines`` has ``file, line_no, value``; a header holds for the lines after it.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("value", r"^\s*(\S+)\s*:\s*$", 1), F.lit(""))
    t = lines.withColumn("doc_id", F.last(head, ignorenulls=True).over(w)).where(F.col("value").contains("|"))
    exp = F.trim(F.element_at(F.split("value", r"\|"), 2))
    return t.select("doc_id", F.trim(F.element_at(F.split("value", r"\|"), 1)).alias("acronym"), F.regexp_replace(exp, r"^\[|\]$", "").alias("expansion"), (~exp.startswith("[")).alias("in_text"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """``word`` of one word a line, lower case, blank lines left out (S-23)."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def version_before(versions: DataFrame, cut_off: str) -> DataFrame:
    """The newest version of each article updated before a time (S-24)."""
    v = versions.where(F.col("updated") < F.lit(cut_off).cast("timestamp"))
    cols = [c for c in v.columns if c != "article_id"]
    return v.groupBy("article_id").agg(F.max_by(F.struct(*cols), F.struct("updated", "version")).alias("v")).select("article_id", "v.*")


def main_font_text(spans: DataFrame) -> DataFrame:
    """``page, text``: the text in the font size most characters of a page have (S-20, A-25)."""
    sizes = spans.groupBy("page", "size").agg(F.sum(F.length("text")).alias("n"))
    main = sizes.groupBy("page").agg(F.max_by("size", F.struct("n", "size")).alias("size"))
    return spans.join(main, ["page", "size"]).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def unavailable(what: str):
    """Sources that need a network, binary parsers or trained weights that are not part of this library (S-21, S-22, E-14, E-15, R-09, C-18 to C-20)."""
    raise NotImplementedError(f"{what} needs a network or weights that are not available; read its stored output with key_value() instead")
