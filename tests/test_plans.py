import pytest

from glossa.plans import catalogue, registry
from glossa.plans.pipeline import corpus, end_to_end


def test_registry(spark):
    docs = spark.createDataFrame([("1", "The big blue box (BBB) opened. ABC fell.")], "id string, text string")
    assert {r.acronym for r in registry.get(registry.IN_EXPANDERS, "cascade")(docs, "id", "text").collect()} == {"BBB"}
    train = spark.createDataFrame([("A", "x", "1"), ("A", "x", "2"), ("A", "y", "3")], "acronym string, expansion string, article_id string")
    tests = spark.createDataFrame([("9", "A")], "article_id string, acronym string")
    assert registry.get(registry.OUT_EXPANDERS, "most_frequent")(train, tests).first().expansion == "x"
    assert registry.get(registry.REPRESENTATORS, "tfidf")(docs, "id").count() > 0
    with pytest.raises(KeyError):
        registry.get(registry.OUT_EXPANDERS, "none")
    assert registry.parameters('{"c": 1}') == {"c": 1} and registry.parameters("") == {}
    with pytest.raises(ValueError):
        registry.parameters("[1]")


def test_sweep(spark):
    run = lambda a, b: spark.range(a * b)
    best = registry.sweep(run, {"a": [1, 3], "b": [2, 5]}, lambda df: float(df.count()))
    assert best[0] == ({"a": 3, "b": 5}, 15.0) and len(best) == 4


def test_end_to_end(spark):
    docs = spark.createDataFrame([(1, "The big blue box (BBB) opened. ABC fell. XYZ too."), (2, None), (3, "ABC and QQQ.")], "doc_id int, text string")
    pairs = spark.createDataFrame([("ABC", "a big cat", "1"), ("ABC", "a big cat", "2"), ("ABC", "all best cards", "3"), ("QQQ", "quiet queen", "1")], "acronym string, expansion string, article_id string")
    got = {(r.doc_id, r.acronym): (r.expansion, r.module) for r in end_to_end(docs, "doc_id", "text", pairs).collect()}
    assert got == {(1, "BBB"): ("big blue box", "in_expander"), (1, "ABC"): ("a big cat", "out_expander"), (3, "ABC"): ("a big cat", "out_expander"), (3, "QQQ"): ("quiet queen", "single_option")}


def test_corpus(spark):
    docs = spark.createDataFrame([(1, "The big blue box (BBB) opened."), (2, "nothing")], "doc_id int, text string")
    articles, pairs, roles = corpus(docs, "doc_id", "text")
    assert [r.text for r in articles.collect()] == ["big_blue_box big_blue_box opened"] and pairs.count() == roles.count() == 1


def test_catalogue_names():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 80
