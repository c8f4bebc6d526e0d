"""Splits that keep related records together.

Articles that name the same author or the same issue of a periodical are
related. The names are read from the author and source lines of the texts, each
article is linked with the entities it names, and the connected components of
that graph are the groups no split may part. Groups are then placed by grouped
iterative stratification: of the labels still to be placed the rarest goes
first, its largest groups first, each into the split that needs the label most.

Groups of more than 1/``LARGE`` of all articles, of which there are at most
``LARGE``, are placed one after the other on the driver. If there is more than
one block, groups of labels with fewer than ``SCARCE`` articles a block follow
there, so no label is too rare for its share. The rest is dealt to blocks of about ``BLOCK`` groups by hash, and each block fills its share of what
the large groups have left open; so no task sees more than a block.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.graph import connected_components
from glossa.runtime import cut, spread

LARGE, BLOCK, SCARCE = 1_000, 20_000, 100

# The words with which author lines and source lines begin in the
# nine languages, and those that join two names.
AUTHOR_LABELS = (
    "written by", "reported by", "by", "author", "authors", "text",
    "rédigé par", "par", "texte", "auteur", "auteurs",
    "escrito por", "por", "texto", "autor", "autora", "autores",
    "verfasst von", "von", "autorin",
    "作者", "文", "著者", "بقلم", "लेखक", "ผู้เขียน",
)
SOURCE_LABELS = (
    "source", "from", "first printed in", "printed in", "paru dans", "fuente", "publicado en", "quelle", "zuerst in", "in",
    "来源", "出典", "المصدر", "स्रोत", "ที่มา",
)
JOINERS = ("and", "et", "y", "e", "und", "و", "और", "และ", "&")

_BLOCK = regex.compile(r"(?:\r\n?|\n)[^\S\n\r]*(?:\r\n?|\n)\s*")
_AUTHOR = regex.compile(
    r"\s*[(（]?\s*(?:(?:" + "|".join(sorted(map(regex.escape, AUTHOR_LABELS), key=len, reverse=True)) + r")\s*(?:[:：／/]\s*|(?<![\p{Latin}])\s*|\s+)|[—–―]\s*)(.*)",
    regex.I | regex.S,
)
_NAME = regex.compile(r"(?:[\p{L}\p{M}'’-]+|\p{L}\.(?:-?\p{L}\.)*)(?:[ ,]+(?:[\p{L}\p{M}'’-]+|\p{L}\.(?:-?\p{L}\.)*))*")
_SPLIT = regex.compile(r"\s*[、;&]\s*|\s+(?:" + "|".join(JOINERS[:-1]) + r")\s+")
_SOURCE = regex.compile(
    r"(?:" + "|".join(sorted(map(regex.escape, SOURCE_LABELS), key=len, reverse=True)) + r")?\s*[:：]?\s*"
    r"([\p{L}][\p{L}\p{M} '’&.-]*?),?\s*(?:vol\.?\s*(\d+)\s*,\s*n[o°º]\.?\s*(\d+)|(\d+)\s*\(\s*(\d+)\s*\)|(\d+)\s*,\s*n[o°º]\.?\s*(\d+)|(\d+)\s*/\s*(\d+))\s*[.。।]?\s*[)）]?\s*",
    regex.I,
)
_MARKS = regex.compile(r"(?<=[\p{Lu}\p{Ll}\p{Lt}])\p{M}+")  # accents, but not the vowel signs of scripts without case


def _fold(s: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", s.casefold())).strip(" .,'’-")


_PARTICLE = regex.compile(r"\p{Ll}{1,3}")
_CASELESS = regex.compile(r"[\p{Lo}\p{M}]")


def surname(name: str) -> str | None:
    """The family name of "First Last", "F. LAST" or "Last, F."; None for what is no name.

    A name written without blanks in a script without case (as in Chinese)
    stands as a whole, since its family name can't be told safely.
    """
    name = name.strip(" .。।)）(（,")
    if "," in name:
        family = name.split(",", 1)[0].strip()
    else:
        parts = name.split()
        if len(parts) < 2 and not (parts and _CASELESS.match(parts[0])):
            return None
        family = parts[-1]
    family = _fold(family)
    return family if len(family) > 1 else None


def _named(name: str, marked: bool) -> bool:
    """Whether words after an author label are a name: capitalised but for particles, or in a script without case after a mark."""
    words = name.replace(",", " ").split()
    if not words or not _NAME.fullmatch(name):
        return False
    if words[0][0].isupper():
        return all(w[0].isupper() or _PARTICLE.fullmatch(w) for w in words) and words[-1][0].isupper()
    return marked and all(_CASELESS.match(w) for w in words)


def _listed(name: str) -> list[str]:
    """The names of a list divided by commas, in which each has several words; "Last, First" is one name."""
    parts = [x.strip() for x in name.split(",")]
    return parts if len(parts) > 1 and all(len(x.split()) > 1 for x in parts) else [name]


def entities(text: str) -> set[str]:
    """Keys of the authors (``a:surname``) and issues (``s:title|volume|number``) a text names in blocks of their own."""
    out: set[str] = set()
    for block in _BLOCK.split(text.strip()):
        block = " ".join(block.split())
        if not block:
            continue
        # A source line ends with a number, which spares most blocks the pattern.
        m = block.rstrip(" .。।)）")[-1:].isdecimal() and (_SOURCE.fullmatch(block) or _SOURCE.fullmatch(block.lstrip("(（ ")))
        if m:
            vol, no = [x for x in m.groups()[1:] if x]
            title = _fold(" ".join(m.group(1).split()))
            if len(title) > 1:
                out.add(f"s:{title}|{int(vol)}|{int(no)}")
            continue
        m = _AUTHOR.fullmatch(block)
        if not m:
            continue
        rest = m.group(1).strip(" .。।)）")
        names = [y for x in _SPLIT.split(rest) for y in _listed(x.strip())]
        marked = block[m.start(1) - 1 : m.start(1)] in tuple(" :：／/")
        if names and all(_named(x, marked) for x in names):
            out |= {f"a:{s}" for s in map(surname, names) if s}
    return out


def article_entities(docs: DataFrame, article_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """``(article_id, entity)`` without repeats; null articles and texts give no row."""

    def run(batches):
        for pdf in batches:
            rows = {(a, e) for a, t in zip(pdf["a"], pdf["t"]) if t for e in entities(t)}
            yield pd.DataFrame(list(rows), columns=["article_id", "entity"])

    src = docs.where(F.col(article_col).isNotNull()).select(F.col(article_col).cast("string").alias("a"), F.col(text_col).alias("t"))
    return spread(src).mapInPandas(run, "article_id string, entity string").distinct()


def related_groups(docs: DataFrame, article_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """``(article_id, group_id)`` of every article; those naming nobody are groups of one.

    Null article ids are left out; repeated rows count once; an empty table
    gives an empty table; other columns are ignored.
    """
    links = cut(article_entities(docs, article_col, text_col))
    parts = connected_components(links, "article_id", "entity").select(F.col("node").alias("article_id"), F.col("component").alias("group_id"))
    every = docs.where(F.col(article_col).isNotNull()).select(F.col(article_col).cast("string").alias("article_id")).distinct()
    return every.join(parts, "article_id", "left").select("article_id", F.coalesce("group_id", "article_id").alias("group_id"))


def latest_folds(reports: DataFrame) -> DataFrame:
    """``(doc_id, fold)``: the fold of each article's latest report that has one; ties go to the larger report id."""
    r = reports.where("doc_id is not null and fold is not null")
    return r.groupBy("doc_id").agg(F.max_by("fold", F.struct("reported_at", "report_id")).alias("fold"))


def torn_articles(groups: DataFrame, folds: DataFrame) -> DataFrame:
    """``(doc_id, group_id, fold)``: articles with a fold whose group has articles in several folds."""
    g = folds.join(groups, folds.doc_id == groups.article_id).select("doc_id", "group_id", "fold")
    torn = g.groupBy("group_id").agg(F.min("fold").alias("x"), F.max("fold").alias("y")).where("x <> y").select("group_id")
    return g.join(torn, "group_id", "left_semi")


def _place(groups: list[tuple[str, float, dict[str, float]]], need: dict[str, dict[str, float]], size_need: dict[str, float]) -> dict[str, str]:
    """Greedy iterative stratification of (group, weight, label weights); updates the needs."""
    left: dict[str, float] = {}
    having: dict[str, list[int]] = {}
    for i, (_, _, labels) in enumerate(groups):
        for l, w in labels.items():
            left[l] = left.get(l, 0.0) + w
            having.setdefault(l, []).append(i)
    out: dict[str, str] = {}

    def put(i: int, label: str | None) -> None:
        g, w, labels = groups[i]
        key = (lambda s: (need[s].get(label, 0.0), size_need[s], s)) if label else (lambda s: (size_need[s], s))
        s = max(size_need, key=key)
        out[g] = s
        size_need[s] -= w
        for l, x in labels.items():
            need[s][l] = need[s].get(l, 0.0) - x
            left[l] -= x

    for _ in range(len(having)):
        label = min(having, key=lambda l: (left[l], l))
        for i in sorted(having.pop(label), key=lambda i: (-groups[i][1], groups[i][0])):
            if groups[i][0] not in out:
                put(i, label)
    for i in sorted(range(len(groups)), key=lambda i: (-groups[i][1], groups[i][0])):
        if groups[i][0] not in out:
            put(i, None)
    return out


def stratified_splits(
    members: DataFrame, labels: DataFrame, proportions: dict[str, float] | None = None
) -> DataFrame:
    """``(article_id, group_id, split)`` with whole groups placed.

    ``members`` has ``article_id, group_id``; ``labels`` has ``article_id,
    label``. Null labels are no label; an article without label only counts for
    size; repeated rows count once; an empty table gives an empty table.
    """
    shares = proportions or {"train": 0.8, "validation": 0.1, "test": 0.1}
    spark = members.sparkSession
    m = cut(members.select("article_id", "group_id").distinct())
    per_label = (
        m.join(labels.where("label is not null").select("article_id", "label").distinct(), "article_id")
        .groupBy("group_id", "label").agg(F.count("*").cast("double").alias("n"))
    )
    g = cut(
        m.groupBy("group_id").agg(F.count("*").cast("double").alias("weight"))
        .join(per_label.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels")), "group_id", "left")
    )
    count, total = g.agg(F.count("*"), F.sum("weight")).first()
    if not count:
        return m.withColumn("split", F.lit(None).cast("string"))
    totals = {r["label"]: r["n"] for r in per_label.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    need = {s: {l: p * n for l, n in totals.items()} for s, p in shares.items()}
    size_need = {s: p * total for s, p in shares.items()}
    big = [(r["group_id"], r["weight"], r["labels"] or {}) for r in g.where(F.col("weight") > total / LARGE).collect()]
    placed = _place(big, need, size_need)
    rest = g.where(F.col("weight") <= total / LARGE)
    blocks = max(1, -(-count // BLOCK))
    scarce = {l for l, n in totals.items() if blocks > 1 and n < SCARCE * blocks}
    if scarce:
        has = F.coalesce(F.arrays_overlap(F.map_keys("labels"), F.array(*map(F.lit, sorted(scarce)))), F.lit(False))
        few = [(r["group_id"], r["weight"], r["labels"]) for r in rest.where(has).collect()]
        rest = rest.where(~has)
        # Only the scarce labels decide; the others are booked.
        placed |= _place([(k, w, {l: n for l, n in x.items() if l in scarce}) for k, w, x in few], need, size_need)
        for k, _, x in few:
            for l in x.keys() - scarce:
                need[placed[k]][l] -= x[l]
        big += few
    rest_total = max(1.0, total - sum(w for _, w, _ in big))
    gone: dict[str, float] = {}
    for _, _, x in big:
        for l, n in x.items():
            gone[l] = gone.get(l, 0.0) + n
    rest_labels = {l: max(1.0, n - gone.get(l, 0.0)) for l, n in totals.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, w, dict(x) if x is not None else {}) for k, w, x in zip(pdf["group_id"], pdf["weight"], pdf["labels"])]
        size = sum(w for _, w, _ in rows)
        here: dict[str, float] = {}
        for _, _, x in rows:
            for l, n in x.items():
                here[l] = here.get(l, 0.0) + n
        mine = {s: {l: v * here.get(l, 0.0) / rest_labels[l] for l, v in of.items()} for s, of in need.items()}
        got = _place(rows, mine, {s: v * size / rest_total for s, v in size_need.items()})
        return pd.DataFrame(list(got.items()), columns=["group_id", "split"])

    small = rest.withColumn("block", F.pmod(F.xxhash64("group_id"), F.lit(blocks))).groupBy("block").applyInPandas(run, "group_id string, split string")
    big_rows = spark.createDataFrame(list(placed.items()) or [], "group_id string, split string")
    return m.join(small.unionByName(big_rows), "group_id").select("article_id", "group_id", "split")
