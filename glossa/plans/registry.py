"""Operators by name, with parameters: the plug-in surface, and sweeps over parameter grids."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import acronyms as A
from glossa.functions import text as X
from glossa.operators import dictionary as D
from glossa.operators import expanders as E
from glossa.operators import inexpansion as I
from glossa.operators import vectors as V
from glossa.operators.learners import LEARNERS, trained_expander

#: Acronym extractors: text column -> array column.
EXTRACTORS: dict[str, Callable] = {
    "v2": A.v2, "v2_small": lambda c: A.v2(c, 2), "v3_small": A.v3, "v4": A.upper_tokens, "spanish": A.spanish, "french": A.french_candidates,
    "short_forms": A.short_forms, "capitals": A.capital_tokens, "candidates": A.candidate_tokens,
}

#: In-expanders: (documents, id column, text column) -> pairs.
IN_EXPANDERS: dict[str, Callable] = {
    name: (lambda docs, i, t, n=name: I.extract(docs, i, t, (n,)).drop("rule")) for name in I.RULES
} | {"cascade": lambda docs, i, t: I.best_by_priority(I.extract(docs, i, t, I.CASCADE), i), "switched_cascade": I.cascaded}

#: Text representators: (documents, id column, **parameters) -> id, term, weight.
REPRESENTATORS: dict[str, Callable] = {
    "document_context_vector": lambda docs, i, **p: V.bag_of_words(docs, i, X.content_words(F.col("text"))),
    "tfidf": lambda docs, i, **p: V.tfidf(docs, i, X.content_words(F.col("text")), **p),
    "n_grams_context_vector": lambda docs, i, weights=None: V.weighted_ngrams(docs, i, X.words(F.col("text")), weights or {1: 1.0}),
    "locality": lambda docs, i, concept, **p: V.locality(docs, i, "text", concept, **p),
    "window": lambda docs, i, concept, size=5: V.window_terms(docs, i, X.words(F.col("text")), concept, size).withColumnRenamed("n", "weight"),
    "lda": lambda docs, i, **p: V.lda_topics(docs, i, X.content_words(F.col("text")), **p),
    "doc2vec": lambda docs, i, **p: V.w2v_mean(docs, i, X.content_words(F.col("text")), **p),
    "cleaned_words": lambda docs, i, numbers=False: V.bag_of_words(docs, i, X.cleaned_words(F.col("text"), not numbers)),
}


def _cosine_term(train: DataFrame, tests: DataFrame, representator: str = "document_context_vector", **p) -> DataFrame:
    """Options by the cosine of a text's terms with those of the option's texts summed (C-02, C-16)."""
    own = lambda df: get(REPRESENTATORS, representator)(df.select("article_id", "text").dropDuplicates(["article_id"]), "article_id", **p).select("article_id", "term", F.col("weight").cast("double").alias("weight"))
    options = E.context_vectors(train.withColumnRenamed("article_id", "id"), own(train).withColumnRenamed("article_id", "id"))
    asked = tests.select("article_id", "acronym").distinct().join(own(tests), "article_id")
    return E.top_option(E.cosine_long(asked, options, ["article_id"], ["expansion"]), ["article_id", "acronym"], "expansion")


def _cosine_text(train: DataFrame, tests: DataFrame, representator: str = "document_context_vector", **p) -> DataFrame:
    """Options by the greatest cosine with one of the option's texts (C-01, C-03)."""
    own = lambda df: get(REPRESENTATORS, representator)(df.select("article_id", "text").dropDuplicates(["article_id"]), "article_id", **p).select("article_id", "term", F.col("weight").cast("double").alias("weight"))
    rows = train.where("expansion is not null").select("article_id", "acronym", "expansion").distinct().join(own(train), "article_id")
    asked = tests.select("article_id", "acronym").distinct().join(own(tests), "article_id")
    c = E.cosine_long(asked, rows.withColumnRenamed("article_id", "train_id"), ["article_id"], ["train_id", "expansion"])
    return E.top_option(c, ["article_id", "acronym"], "expansion")


#: Out-expanders: (training rows, test rows, **parameters) -> article_id, acronym, expansion, confidence.
OUT_EXPANDERS: dict[str, Callable] = {
    "most_frequent": lambda train, tests, **p: tests.select("article_id", "acronym").distinct().join(D.most_frequent(train).drop("n_options"), "acronym"),
    "random": lambda train, tests, seed=1337: D.seeded_choice(tests.select("article_id", "acronym").distinct(), train, seed),
    "cossim_term": _cosine_term, "classic_context_vector": _cosine_term, "cossim": _cosine_text,
} | {name: (lambda train, tests, n=name, **p: trained_expander(train, tests, n, **p)) for name in LEARNERS}

#: Ways to combine the predictions of several expanders: (predictions, id columns, **parameters) -> options with scores.
ENSEMBLES: dict[str, Callable] = {
    "hard": lambda predictions, ids, **p: E.hard_vote(predictions, ids), "soft": lambda predictions, ids, **p: E.soft_vote(predictions, ids),
    "combiner": lambda predictions, ids, weights: E.weighted_vote(predictions, weights, ids), "priority": lambda predictions, ids, order: E.by_priority(predictions, ids, order),
}


def get(kind: dict[str, Callable], name: str) -> Callable:
    """The operator of a name; an unknown name lists the known ones."""
    if name not in kind:
        raise KeyError(f"{name!r} is none of {', '.join(sorted(kind))}")
    return kind[name]


def parameters(text: str) -> dict:
    """Parameters given as a JSON object; a list or scalar is not accepted."""
    got = json.loads(text) if text.strip() else {}
    if not isinstance(got, dict):
        raise ValueError("parameters are a JSON object")
    return got


def sweep(run: Callable[..., DataFrame], grid: dict[str, Iterable], score: Callable[[DataFrame], float]) -> list[tuple[dict, float]]:
    """(parameters, score) of every point of a grid, best first (G-10); each point is one distributed job."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return sorted(((p, score(run(**p))) for p in points), key=lambda x: (-x[1], json.dumps(x[0], sort_keys=True)))
