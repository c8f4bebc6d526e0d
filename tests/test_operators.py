import itertools
import random

import pytest

from pyspark.sql import functions as F

from glossa.operators import bio as B
from glossa.operators import dictionary as D
from glossa.operators import expanders as E
from glossa.operators import linkage as L
from glossa.operators import metrics as M
from glossa.operators import vectors as V
from glossa.operators.agreement import alpha, kappa, partial_credit
from glossa.operators.graph import connected_components
from glossa.operators.learners import trained_expander
from glossa.operators.inexpansion import RULES, bounded, places, schwartz_hearst, select_after, select_before, valid

PAIRS = "acronym string, expansion string, article_id string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- in-expansion, golden rows

BEFORE = [
    ("EXP", "expannot Test sentence expansion a", "expansion"),
    ("EXP", "Expansion bla bla some more text", "Expansion"),
    ("5-HIAA", "bla dssdd  5--hydroxy-indole-acetic acid", "5--hydroxy-indole-acetic acid"),
    ("2AAF", "2-acetylaminofluorene", "2-acetylaminofluorene"),
    ("GNAT", "Gcn5 Gcn5-related N-acetyltransferase", "Gcn5-related N-acetyltransferase"),
    ("BG", "sd Beta-1, 4-glucosidase", "Beta-1, 4-glucosidase"),
    ("T3S", "tsddd type III secretion", "type III secretion"),
    ("EXPANSION", "Test sentence expansion", None),
    ("EXP3", "Test sentence expansion2", None),
    ("EXP", "e a x b c d pansion", None),
]
AFTER = [
    ("EXP", "expannot Test sentence expansion", "expannot"),
    ("nNOS", "aa nervours NOS sdsdd", "nervours NOS"),
    ("T3S", "type bb III aa secretion secretion", "type bb III aa secretion"),
]


def test_selection_on_both_sides():
    assert [select_before(a, t) for a, t, _ in BEFORE] == [w for _, _, w in BEFORE]
    assert [select_after(a, t) for a, t, _ in AFTER] == [w for _, _, w in AFTER]


def test_places():
    assert list(places("Test sentence blabla more text some more.")) == []
    assert ("EXP", "Test sentence expansion", True) in list(places("Test sentence expansion (EXP) bla bla some more text."))
    assert ("EXP", "Expansion bla bla some more text", False) in list(places("Test sentence EXP - Expansion bla bla some more text."))


def test_validity():
    assert all(valid(a) for a in ["AAA", "LDA", "ACRO", "BG", "myc-glu-glu", "T3S", "Asf1", "IPCs", "PDMAEMA", "[(18)F]FLT", "AA AA"])
    assert not any(valid(a) for a in ["THAT", "11233", "sdodssoddsosd", "A", "", "AA AA AA"])


def test_rules():
    text = "The central intelligence agency (CIA) met. The World Wide Web, or WWW, grew. ABC, which stands for a better choice, won."
    assert schwartz_hearst(text) == {"CIA": "central intelligence agency"}
    assert bounded("Measured by mass spectrometry (MS).") == {"MS": "mass spectrometry"}
    assert RULES["template"](text) == {"ABC": "a better choice", "WWW": "World Wide Web"}
    assert RULES["initial_capitals"]("NASA is the National Aeronautics and Space Administration.") == {"NASA": "National Aeronautics and Space Administration"}
    assert RULES["french"]("Le réseau numérique des bâtiments (RNB) aime.") == {"RNB": "réseau numérique des bâtiments"}
    assert RULES["spanish"]("La dirección agrícola de patología vegetal (DAPV) toca.")["DAPV"].endswith("vegetal")
    assert all(e.split()[0] in text for r in RULES.values() for e in r(text).values())


def test_extract_takes_odd_texts(spark):
    from glossa.operators.inexpansion import extract

    df = spark.createDataFrame([(1, None), (2, ""), (3, "x (" * 2000), (4, "big blue box (BBB)")], "id int, text string")
    assert rows(extract(df, "id", "text")) == [(4, "BBB", "big blue box", "schwartz_hearst")]
    assert extract(df.where("id < 0"), "id", "text").count() == 0


def test_bio_pairing(spark):
    toks = "Quantum key distribution ( QKD ) is safe unlike WWW".split()
    labels = ["B-long", "I-long", "I-long", "O", "B-short", "O", "O", "O", "O", "B-short"]
    df = spark.createDataFrame([(1, i, t, l) for i, (t, l) in enumerate(zip(toks, labels))], "sent_id int, pos int, token string, label string")
    assert {r.acronym: r.expansion for r in B.paired_forms(df).collect()} == {"QKD": "Quantum key distribution", "WWW": None}
    plain = df.withColumn("label", F.regexp_replace("label", "^[BI]-", ""))
    assert [r.label for r in B.to_bio(plain).orderBy("pos").collect()] == labels


# ---- dictionary and linkage


def test_most_frequent_breaks_ties_by_least(spark):
    p = spark.createDataFrame([("A", "y", "1"), ("A", "x", "2"), ("B", "z", None)], PAIRS)
    assert rows(D.most_frequent(p)) == [("A", "x", 0.5, 2), ("B", "z", 1.0, 1)]
    assert D.most_frequent(p.where("acronym = 'C'")).count() == 0


def test_article_map_and_definition_index(spark):
    p = spark.createDataFrame([("A", "big kitten", "1"), ("A", "big kittens", "1"), ("B", "cat", "1"), ("A", "red", "2")], PAIRS)
    assert {r.article_id: r.pairs for r in D.article_map(p).collect()} == {"1": {"A": "big kitten", "B": "cat"}, "2": {"A": "red"}}
    assert rows(D.definition_index(p)) == [("A", "big kitten", 0, "big kitten"), ("A", "big kittens", 0, "big kitten"), ("A", "red", 1, "red"), ("B", "cat", 0, "cat")]


def test_routing(spark):
    train = spark.createDataFrame([("A", "x", "1"), ("B", "y", "1"), ("B", "z", "1")], PAIRS)
    tests = spark.createDataFrame([("9", "A"), ("9", "B"), ("9", "C")], "article_id string, acronym string")
    got = {r.acronym: (r.route, r.expansion, r.confidence) for r in D.routed(tests, train).collect()}
    assert got == {"A": ("single", "x", -5.0), "B": ("expander", None, None), "C": ("skip", None, None)}


def test_greedy_labels():
    names = ["nuclear pore complexes", "nuclear pore complex", "polychlorinated biphenyl", "t replacing factor", "this supernatant factor", "polychlorinated biphenyls"]
    assert L.greedy_labels(names) == [0, 0, 1, 2, 3, 1]
    assert L.greedy_labels([]) == []


def test_similar_pairs_match_brute_force(spark):
    rnd = random.Random(4)
    words = ["array", "arrays", "arry", "output", "outptu", "digital", "digitals", "dgtl", "a", "of"]
    exps = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(60)})
    df = spark.createDataFrame([("AOD", e, "1") for e in exps], PAIRS)
    want = [("AOD", a, b) for a, b in itertools.combinations(exps, 2) if L.similar(a, b)]
    assert rows(L.similar_pairs(df)) == sorted(want)


def test_linkage_takes_the_most_frequent_form(spark):
    p = spark.createDataFrame([("ATE", "acronym test expansion", "2"), ("ATE", "acronym test expansion", "3"), ("ATE", "acronym test expansions", "0"), ("ATE", "a very diff exp", "1")], PAIRS)
    links = L.linked(p)
    assert rows(L.changes(p, links)) == [("0", "ATE", "acronym test expansions", "acronym test expansion")]
    once = L.rewritten(p, links)
    assert rows(L.linked(once).where("expansion <> canonical")) == []


def test_components_match_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(1, 80), rnd.randint(1, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (500, 500), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


# ---- vectors and expanders


def test_cosine_neighbour(spark):
    train = spark.createDataFrame([("k", 0, [0.0] * 4), ("k", 1, [1.0] * 4), ("k", 2, [0.0, 4.0, 0.0, 4.0])], "acronym string, label int, vec array<double>")
    tests = spark.createDataFrame([(1, "k", [0.0] * 4), (2, "k", [1.0] * 4), (3, "k", [1.0, 1.0, 2.0, 2.0]), (4, "k", [0.05, 0.05, 0.1, 0.1]), (5, "k", [0.0, 8.0, 0.0, 8.0])], "id int, acronym string, vec array<double>")
    got = rows(E.top_option(E.nearest(tests, train, ["acronym"], "id"), ["id"]))
    assert [(i, l, round(c, 4)) for i, l, c in got] == [(1, 0, 0.0), (2, 1, 1.0), (3, 1, 0.9487), (4, 1, 0.9487), (5, 2, 1.0)]


def test_ngram_and_locality_weights(spark):
    df = spark.createDataFrame([(1, "I am a sentence TEST_ACRO. I am another sentence. And another, one i i. \nA paragraph", "I am a sentence TEST_ACRO I am".split())], "id int, text string, toks array<string>")
    w = {r.term: r.weight for r in V.weighted_ngrams(df, "id", F.col("toks"), {1: 0.2, 2: 0.3, 3: 0.5}).collect()}
    assert (w["I"], w["a"], w["I am"], w["am a"], w["I am a"]) == (0.4, 0.2, 0.6, 0.3, 0.5)
    loc = {r.term: r.weight for r in V.locality(df, "id", "text", "TEST_ACRO").collect()}
    assert (loc["I"], loc["am"], loc["a"], loc["sentence"], loc["another"], loc["And"], loc["one"], loc["i"], loc["A"], loc["paragraph"]) == (2.0, 2.0, 1.0, 2.0, 1.4, 0.7, 0.7, 1.4, 0.4, 0.4)


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["a"]), (3, [])], "id int, t array<string>")
    w = V.tfidf(df, "id", F.col("t"))
    assert all(abs(r.s - 1) < 1e-5 for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    assert w.where("id = 3").count() == 0


def test_votes(spark):
    p = spark.createDataFrame([(1, "e", "x", 2.0), (1, "e", "y", -1.0), (1, "f", "y", 0.0), (1, "f", "x", 0.0)], "doc int, expander string, label string, confidence double")
    soft = {r.label: r.score for r in E.soft_vote(p, ["doc"]).collect()}
    assert soft == {"x": 1.5, "y": 0.5}
    assert {r.label: r.votes for r in E.hard_vote(p, ["doc"]).collect()} == {"x": 2}


@pytest.mark.parametrize("learner", ["svm", "lr", "svm_calibrated", "svm_sgd", "rf", "network"])
def test_learners_separate(spark, learner):
    train = spark.createDataFrame([("A", e, f"{e}{i}", {e: 1.0, "z": 0.3}) for e in ("cat", "dog") for i in range(4)] + [("C", "one", "x", {"a": 1.0})], "acronym string, expansion string, article_id string, terms map<string,double>")
    tests = spark.createDataFrame([("A", "t1", {"cat": 1.0}), ("A", "t2", {"dog": 2.0}), ("B", "t3", {"dog": 2.0}), ("C", "t4", {"a": 1.0})], "acronym string, article_id string, terms map<string,double>")
    assert {r.article_id: r.expansion for r in trained_expander(train, tests, learner).collect()} == {"t1": "cat", "t2": "dog"}
    assert trained_expander(train.where("acronym = 'none'"), tests, learner).count() == 0


def test_locality_similarity(spark):
    a = spark.createDataFrame([(1, "k", "x", 1.0), (1, "k", "x", 0.5), (1, "k", "y", 1.0)], "doc int, acronym string, term string, weight double")
    b = spark.createDataFrame([("p", "k", "x", 0.4), ("p", "k", "x", 1.0), ("p", "k", "x", 0.7), ("q", "k", "y", 0.2)], "option string, acronym string, term string, weight double")
    got = {r.option: r.confidence for r in E.locality_similarity(a, b, ["doc"], ["option"]).collect()}
    assert got == {"p": 1.0 * 1.0 + 0.5 * 0.7, "q": 0.2}


def test_training_pairs_are_balanced(spark):
    x = spark.createDataFrame([("A", f"e{i % 3}", str(i)) for i in range(300)] + [("B", "only", str(i)) for i in range(50)], PAIRS)
    p = E.training_pairs(x).groupBy("acronym", "same").count().collect()
    n = {(r.acronym, r.same): r["count"] for r in p}
    assert n[("A", True)] == n[("A", False)] > 50 and ("B", True) not in n


def test_priority_and_report(spark):
    p = spark.createDataFrame([(1, "e", "x", 0.2), (1, "f", "y", 0.9), (2, "f", "z", 0.1), (3, "g", "w", 1.0)], "doc int, expander string, label string, confidence double")
    assert {r.doc: (r.label, r.expander) for r in E.by_priority(p, ["doc"], ["e", "f"]).collect()} == {1: ("x", "e"), 2: ("z", "f")}
    r = {r.doc: r for r in E.report_table(p, ["doc"], ["e", "f"]).collect()}
    assert r[1].expansion_e == "x" and r[2].expansion_e is None and r[2].confidence_f == 0.1


# ---- metrics and agreement


def test_matching_falls_back_to_plurals(spark):
    g = spark.createDataFrame([(1, "ABCs", "x y"), (1, "DEF", "q"), (1, "GHI", "r")], "doc int, acronym string, expansion string")
    p = spark.createDataFrame([(1, "ABC", "x y"), (1, "DEF", "other words"), (1, "ZZZ", "s")], "doc int, acronym string, expansion string")
    m = M.matched(g, p, ["doc"])
    assert {(r.acronym, r.kind) for r in m.collect()} == {("ABCs", "found"), ("DEF", "found"), ("GHI", "missed"), ("ZZZ", "spurious")}
    s = {r.element: (r.right, r.extracted, r.gold) for r in M.extraction_scores(m).collect()}
    assert s == {"acronyms": (2, 3, 3), "expansions": (1, 2, 3), "pairs": (1, 3, 3)}


def test_agreement(spark):
    l = spark.createDataFrame([("i", "k", "a", ["x"]), ("i", "k", "b", ["x"]), ("j", "k", "a", ["x"]), ("j", "k", "b", ["y"])], "item string, block string, annotator string, labels array<string>")
    r = alpha(l).first()
    assert (r.pairs, r.observed, r.expected, r.alpha) == (2, 0.5, 0.5, 0.0)
    k = kappa(spark.createDataFrame([("x", "x"), ("y", "y"), ("x", "y"), ("y", "x")], "x string, y string")).first()
    assert (k["items"], k.kappa) == (4, 0.0)
    assert partial_credit("mbit/s", {"mbit": "megabit", "s": "second"}, "megabit per second") == ({}, 1, 0, 0)


def test_randomisation_and_bootstrap(spark):
    s = spark.createDataFrame([(i, 1.0, 0.0) for i in range(30)], "doc_id int, a double, b double")
    r = M.paired_randomisation(s, 200).first()
    assert r.observed == 1.0 and r.p_value < 0.01
    b = M.bootstrap_interval(s, 100).first()
    assert (b["mean"], b.low, b.high) == (1.0, 1.0, 1.0)


def test_nearest_text_and_neighbours_equal_all_pairs(spark, monkeypatch):
    import random

    monkeypatch.setattr(E, "BLOCK", 7, raising=False)
    monkeypatch.setattr(E, "AT_ONCE", 3, raising=False)
    rnd = random.Random(4)
    side = lambda n, a: [(a + i, rnd.choice("xxxyz"), rnd.choice("pqr"), [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))], [float(rnd.randint(-1, 1)) for _ in range(4)]) for i in range(n)]
    tests, train = side(40, 0), side(60, 100)
    frame = lambda r: V.with_norm(spark.createDataFrame(r, "sample_id long, acronym string, label string, words array<string>, vec array<double>"))
    a, b = frame(tests), frame(train).withColumnRenamed("sample_id", "train_id")
    long = lambda f, i: V.term_counts(f, i, F.col("words")).join(f.select(i, "acronym", "label"), i).withColumn("weight", F.col("tf").cast("double"))
    c = E.cosine_long(long(a, "sample_id").drop("label"), long(b, "train_id"), ["sample_id"], ["train_id", "label"])
    want = E.top_option(c.groupBy("sample_id", "acronym", "label").agg(F.max("confidence").alias("confidence")), ["sample_id", "acronym"])
    assert rows(E.nearest_text(a, b, "sample_id", option="label")) == rows(want)

    j = a.select("sample_id", "acronym", "vec").join(b.select("acronym", "train_id", "label", F.col("vec").alias("v")), "acronym")
    got = {}
    for r in j.select("sample_id", "acronym", "train_id", "label", F.round(E.cosine(F.col("vec"), F.col("v")), 6).alias("c")).collect():
        got.setdefault((r.sample_id, r.acronym), []).append((-r.c, r.train_id, r.label))
    votes = []
    for k, near in got.items():
        near = sorted(near)[:5]
        tally = {x: (-sum(n[2] == x for n in near), round(sum(n[0] for n in near if n[2] == x), 6), x) for x in {n[2] for n in near}}
        votes.append((*k, min(tally.values())[2], -min(tally.values())[0]))
    assert rows(E.neighbour_vote(a, b, "sample_id")) == sorted(votes)
    plan = E.nearest_text(a, b, "sample_id", option="label")._jdf.queryExecution().toString() + E.neighbour_vote(a, b, "sample_id")._jdf.queryExecution().toString()
    assert plan.count("FlatMapCoGroupsInPandas") and "Join Inner, (acronym" not in plan.split("FlatMapCoGroups")[0]
    assert E.neighbour_vote(a.limit(0), b, "sample_id").count() == 0 == E.nearest_text(a, b.limit(0), "sample_id", option="label").count()


def test_rounding_is_half_up():
    import numpy as np

    assert E.rounded(np.array([0.0000005, 0.1234565, -0.1234565, 0.9999995, 0.3, 1.0])).tolist() == [1, 123457, -123457, 1000000, 300000, 1000000]
