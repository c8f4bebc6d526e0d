"""Links, abbreviations and text of stored pages, and resolving acronyms through them."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import plain_html


class _Page(HTMLParser):
    def __init__(self):
        super().__init__()
        self.links: list[tuple[str, str | None, str | None]] = []
        self.abbrs: list[tuple[str, str]] = []
        self.text: list[str] = []
        self._open: list[tuple[str, dict, list[str]]] = []
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1
        elif tag in ("a", "abbr"):
            self._open.append((tag, dict(attrs), []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif self._open and self._open[-1][0] == tag:
            _, attrs, words = self._open.pop()
            name = " ".join(" ".join(words).split())
            href = attrs.get("href")
            if tag == "a" and href and not href.startswith("#"):
                self.links.append((name, attrs.get("title"), href))
            elif tag == "abbr" and attrs.get("title"):
                self.abbrs.append((name, attrs["title"]))

    def handle_data(self, data):
        if not self._skip:
            self.text.append(data)
            for _, _, words in self._open:
                words.append(data)


PARSED = "text string, links array<struct<name string, title string, href string>>, abbrs array<struct<name string, title string>>"


def parsed(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id_col, text, links, abbrs`` of any markup; links within the page are left out (P-14, F-12)."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for i, h in zip(pdf["i"], pdf["h"]):
                p = _Page()
                p.feed(h or "")
                p.close()
                out.append((i, " ".join(" ".join(p.text).split()), [dict(zip(("name", "title", "href"), x)) for x in p.links], [dict(zip(("name", "title"), x)) for x in p.abbrs]))
            yield pd.DataFrame(out, columns=[id_col, "text", "links", "abbrs"])

    return pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("h")).mapInPandas(run, f"{id_col} {id_type}, {PARSED}")


def link_table(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id_col, name, href`` of well-formed anchors, inside the JVM; names in lower case (J-13, F-12)."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r'(?is)(<a\s[^>]*>.*?</a>)'), F.lit(1))
    t = pages.select(F.col(id_col), F.explode(tags).alias("t"))
    return t.select(id_col, F.lower(plain_html(F.col("t"))).alias("name"), F.regexp_extract("t", r'href="([^"]*)"', 1).alias("href")).where("href <> '' and not startswith(href, '#')")


def followed(unresolved: DataFrame, abbrs: DataFrame, links: DataFrame, page_pairs: DataFrame) -> DataFrame:
    """Expansion of unresolved acronyms: by abbreviation title, then anchor title, then the linked page's own pairs (G-03).

    ``unresolved``: ``doc_id, acronym``; ``abbrs``: ``doc_id, name, title``;
    ``links``: ``doc_id, name, title, href``; ``page_pairs``: ``href, acronym, expansion``.
    """
    key = F.lower("acronym")
    a = abbrs.groupBy("doc_id", F.lower("name").alias("k")).agg(F.min("title").alias("by_abbr"))
    l = links.groupBy("doc_id", F.lower("name").alias("k")).agg(F.min("title").alias("by_title"), F.min("href").alias("href"))
    p = page_pairs.groupBy("href", "acronym").agg(F.min("expansion").alias("by_page"))
    j = unresolved.withColumn("k", key).join(a, ["doc_id", "k"], "left").join(l, ["doc_id", "k"], "left").join(p, ["href", "acronym"], "left")
    return j.select("doc_id", "acronym", F.coalesce("by_abbr", "by_title", "by_page").alias("expansion"))


def redirected(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """Link targets after redirects ``source, target`` (J-14)."""
    return links.join(redirects, links.href == redirects.source, "left").withColumn("href", F.coalesce("target", "href")).drop("source", "target")
