"""Cleaned words, sentences, rewritten tests, result files, regex expanders, linkage of one article's expansions."""

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.functions.inflect import lancaster, lancaster_stem
from glossa.operators import dictionary as D
from glossa.operators import expanders as E
from glossa.operators import linkage as L
from glossa.operators import metrics as M


def one(spark, c, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(c).first()[0]


# Expected rows of expansion linkage (acronym ATE).
LINKAGE = [
    ([("Acronym Test Expansion", 0), ("Acronym Test Expansions", 0), ("A very diff exp", 1), ("Acronym Test Expansion", 2)],
     {("Acronym Test Expansion", 0), ("A very diff exp", 1), ("Acronym Test Expansion", 2)}, {(0, "Acronym Test Expansions", "Acronym Test Expansion")}),
    ([("bla bla", 0), ("Acronym Test Expansion", 0), ("A very diff exp", 1), ("Acronym Test Expansion", 2)],
     {("Acronym Test Expansion", 0), ("A very diff exp", 1), ("Acronym Test Expansion", 2)}, {(0, "bla bla", "Acronym Test Expansion")}),
    ([("Acronym Test Expansion", 0), ("bla bla", 0), ("A very diff exp", 1)],
     {("Acronym Test Expansion", 0), ("A very diff exp", 1)}, {(0, "bla bla", "Acronym Test Expansion")}),
]


@pytest.mark.parametrize("given,kept,changed", LINKAGE)
def test_expansions_of_one_article_are_linked(spark, given, kept, changed):
    p = spark.createDataFrame([("ATE", e, a) for e, a in given], "acronym string, expansion string, article_id int")
    links = L.linked(p)
    assert {(r.expansion, r.article_id) for r in L.rewritten(p, links).collect()} == kept
    assert {(r.article_id, r.old, r.new) for r in L.changes(p, links).collect()} == changed


def test_null_articles_link_nothing(spark):
    p = spark.createDataFrame([("AB", "one two", None), ("AB", "three four", None)], "acronym string, expansion string, article_id int")
    assert {r.canonical for r in L.linked(p).collect()} == {"one two", "three four"}


def test_cleaned_words(spark):
    words = lambda t, n=False: one(spark, X.cleaned_words(F.col("t"), n), t=t)
    assert words("This Is A Test String") == ["test", "string"] and words("") == []
    assert words("This is a sentence with 01 2 10 numbers and 10% and 1+2=5.", True) == ["sentence", "numbers"]
    assert one(spark, X.lowered_words(F.col("t"), F.array(F.lit("Core_Set"))), t="The Core_Set of  IT") == ["Core_Set"]


def test_lancaster_stems(spark):
    # Stems of the published rules.
    known = {"maximum": "maxim", "presumably": "presum", "multiply": "multiply", "provision": "provid", "owed": "ow", "ear": "ear", "saying": "say", "crying": "cry", "string": "string", "meant": "meant", "cement": "cem"}
    assert {w: lancaster_stem(w) for w in known} == known and lancaster_stem("") == ""
    assert one(spark, lancaster(F.split("t", " ")), t="crying meant") == ["cry", "meant"]


def test_sentences(spark):
    cut = lambda t: one(spark, X.sentence_array(F.col("t")), t=t)
    assert cut("Dr. Lee came, e.g. today. It costs 3.5 units! Who? ") == ["Dr. Lee came, e.g. today.", "It costs 3.5 units!", "Who?"]
    assert cut("你好。再见！") == ["你好。", "再见！"] and cut(" ") == []


def test_linked_text_and_removed_substrings(spark):
    pairs = F.array(F.struct(F.lit("AB").alias("acronym"), F.lit("alpha beta").alias("expansion")), F.struct(F.lit("XY").alias("acronym"), F.lit(None).cast("string").alias("expansion")))
    assert one(spark, X.linked_text(F.col("t"), pairs), t="The alpha beta (AB) and XY.") == "The alpha_beta (alpha_beta) and ."
    text, at = X.without_substring(F.col("t"), F.col("p"))
    assert one(spark, F.struct(text, at), t="a--b--", p="--") == ("ab", [1, 2])
    assert one(spark, F.struct(text, at), t="ab", p="x") == ("ab", []) and one(spark, F.struct(text, at), t="ab", p="") == ("ab", [])
    assert X.flat_strings({"a": [1, ("b", {"c": 2.5})], "d": "e"}) == ["1", "b", "2.5", "e"] and X.flat_strings("x") == "x" and X.flat_strings(3) == "3"


def test_rewritten_tests(spark):
    rows = [(1, "the alpha_beta of gamma", [("AB", "alpha beta"), ("CD", "cell death")]), (2, "nothing here", [("AB", "alpha beta")]), (3, None, [("AB", "alpha beta")])]
    t = spark.createDataFrame(rows, "id int, text string, pairs array<struct<acronym:string,expansion:string>>")
    kept, out = D.rewritten_tests(t, "id")
    assert [(r.id, r.text, [p.acronym for p in r.pairs]) for r in kept.collect()] == [(1, "the AB of gamma", ["AB"])] and [r.id for r in out.collect()] == [2]


def test_scores_of_result_rows(spark):
    r = spark.createDataFrame([("a", "True"), ("b", "False"), ("a", "true"), ("a", None)], "doc_id string, success string")
    assert {tuple(x) for x in M.document_scores(r).collect()} == {("a", 2, 3), ("b", 0, 1)}
    g = spark.createDataFrame([("a", "AB", "x"), ("a", "CD", "y"), ("a", "AB", "x")], "doc_id string, acronym string, expansion string")
    p = spark.createDataFrame([("a", "AB", "x"), ("b", "AB", "z")], "doc_id string, acronym string, expansion string")
    assert {tuple(x) for x in M.document_extraction_scores(g, p).collect()} == {("a", 1, 0, 1), ("b", 0, 1, 0)}
    assert [tuple(x) for x in M.shared_spans(p, g).collect()] == [("a", "AB", "x")]


def test_resampling_is_the_same_for_any_partitions(spark):
    s = spark.createDataFrame([(f"d{i}", float(i % 3 == 0), float(i % 4 == 0)) for i in range(60)], "doc_id string, a double, b double")
    for run in (lambda x: M.paired_randomisation(x), lambda x: M.bootstrap_interval(x, 2_000)):
        assert run(s.repartition(1)).collect() == run(s.repartition(4)).collect()
    r = M.bootstrap_interval(s).first()
    assert r.low < r.mean < r.high and abs(r.mean - 1 / 3) < 1e-6
    assert M.paired_randomisation(s.withColumn("b", F.col("a"))).first().p_value == 1.0


def test_expansion_in_text(spark):
    from glossa.operators.inexpansion import expansion_in_text

    find = lambda t, v, a="TEA": one(spark, expansion_in_text(F.col("t"), F.col("a"), v), t=t, a=a)
    for v in ("v1", "v3"):
        assert find("We saw Thermal Energy Absorption (TEA) here", v) == "Thermal Energy Absorption"
        assert find("We use TEA (Thermal Energy Absorption) here", v) == "Thermal Energy Absorption"
        assert find("Thermal Energy Absorption or the TEA", v) == "Thermal Energy Absorption"
        assert find("no such thing for TEA", v) is None and find("x (T)", v, "T") is None
    assert find("Thermal Energy Absorption - TEA", "v3") == "Thermal Energy Absorption"
    assert find("the thermal.energy absorption, TEA", "v2") == "thermal.energy absorption"


def test_ranked_options_and_context_vectors(spark):
    p = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9), (1, "c", 0.1)], "id int, label string, confidence double")
    assert [o.label for o in E.ranked_options(p, ["id"]).first().options] == ["c", "a", "b"]
    t = spark.createDataFrame([("0_1", "AB", "x"), ("1_1", "AB", "x"), ("0_2", "AB", None), ("0_1", "AB", "x")], "id string, acronym string, expansion string")
    w = spark.createDataFrame([("0_1", "w", 2.0), ("1_1", "w", 3.0), ("0_2", "w", 9.0)], "id string, term string, weight double")
    assert E.context_vectors(t, w).first().weight == 5.0 and E.context_vectors(t, w, "0_").first().weight == 2.0


def test_a_cluster_needs_a_shared_folder():
    from glossa.runtime import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Option:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: Option())})

    with pytest.raises(RuntimeError):
        shared_dir(type("Session", (), {"conf": Conf(), "sparkContext": Context})())


def test_switched_cascade(spark):
    from glossa.operators.inexpansion import SWITCHES, cascade, cascaded

    t = "The thermal energy absorption (TEA) was seen. Each WHO stands for World Health Organisation here. Part IV ended."
    got = cascade(t)
    assert got["TEA"] == "thermal energy absorption" and got["WHO"] == "World Health Organisation" and "IV" not in cascade(t, unexpanded=True)
    assert cascade(t, unexpanded=True, roman=False)["IV"] is None
    free = "They use an adaptive noise filter, the ANF, for it."
    assert "ANF" not in cascade(free, character_match=False) and cascade(free, character_match=False, high_recall=True).get("ANF") == "adaptive noise filter"
    assert cascade("light of the moon (LM) shone", high_recall_character=True)["LM"] == "light of the moon"
    assert cascade("the RNA binding protein (RBP) and no more").get("RNA", "x") is None
    assert cascade("") == {} and len(SWITCHES) >= 20
    with pytest.raises(ValueError):
        cascade("x", nonsense=True)
    d = spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, text string")
    assert {r.id for r in cascaded(d, "id", "text").collect()} == {1}


def test_registry_reaches_cosine_expanders(spark):
    from glossa.plans import registry

    train = spark.createDataFrame([("a", "AB", "alpha beta", "cell wall grows"), ("b", "AB", "air brake", "train stops fast")], "article_id string, acronym string, expansion string, text string")
    tests = spark.createDataFrame([("t", "AB", "the train stops")], "article_id string, acronym string, text string")
    for name in ("cossim", "cossim_term", "classic_context_vector"):
        assert registry.get(registry.OUT_EXPANDERS, name)(train, tests).first().expansion == "air brake"
    assert registry.get(registry.REPRESENTATORS, "cleaned_words")(tests, "article_id").count() == 2
