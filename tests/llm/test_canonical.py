import random

import pytest

from glossa.llm.canonical import Matcher, edits, label_key, map_to_reference

REF = [
    (1, "RTB", "routing treatment bridge"), (2, "RTB", "response tidal backup"), (3, "WV", "wetland vascular"), (4, "VW", "vascular wetland"),
    (5, "DEEA", "dirección eléctrica de estudios atmosféricos"), (6, "FA", "formula and analysis"), (7, "FTI", "forest treatment immune"), (8, "GH", "genetic upper"),
]

CASES = [
    ("RTB", "routing treatment bridge", 1), ("RTB", "Routing_Treatment-BRIDGE.", 1), ("RTB", "routing tretament brdge", 1), ("RTB", "rout. treatment bridge", 1),
    ("RTB", "bridge, routing treatment", 1), ("RTB", "RTB: routing treatment bridges [1]", 1), (None, "<i>routing&nbsp;treatment bridge</i> (see also)", 1),
    ("RTB", "routing treatment backup", -1), ("RTB", "routing wexledo bridge", -1), ("RTB", "n/a", -1), ("RTB", " ", -1), ("RTB", "RTB", -1),
    ("WV", "wetland vascular", 3), ("WV", "vascular wetland", 3), ("VW", "vascular wetland", 4), (None, "vascular wetland", 4),
    ("DEEA", "direcciÃ³n elÃ©ctrica de estudios atmosfÃ©ricos", 5), ("DEEA", "direccion electrica estudios atmosferic", 5),
    ("routing treatment bridge", "RTB", 1), ("R.T.B.", "the routing treatment bridge", 1), ("FTI", "foresttreatment immune", 7), ("FA", "fromula analysis", 6),
    ("0TB", "routing treatment bridge", 1), ("FTI", "x" * 100_000, -1),
]


@pytest.mark.parametrize(("label", "value", "want"), CASES)
def test_cases(label, value, want):
    assert Matcher(REF).match(label, value)[0] == want


def test_table(spark):
    rows = [(i, a, v) for i, (a, v, _) in enumerate(CASES)] + [(100, None, None), (101, "RTB", ""), (0, *CASES[0][:2])]
    df = spark.createDataFrame(rows, "def_id long, acronym string, acronym_expansion string").selectExpr("*", "1 as ref_id")
    ref = spark.createDataFrame(REF, "ref_id long, acronym string, expansion string")
    got = sorted(tuple(r) for r in map_to_reference(df, ref).collect())
    assert got == sorted([(i, w) for i, (_, _, w) in enumerate(CASES)] + [(0, CASES[0][2])])
    assert {r.ref_id for r in map_to_reference(df, ref.where("ref_id < 0")).collect()} == {-1}
    assert map_to_reference(df.where("def_id < 0"), ref).count() == 0


def test_blocks_of_a_long_reference_agree(spark, monkeypatch):
    import glossa.llm.canonical as K

    df = spark.createDataFrame([(i, a, v) for i, (a, v, _) in enumerate(CASES)], "def_id long, acronym string, acronym_expansion string")
    ref = spark.createDataFrame(REF, "ref_id long, acronym string, expansion string")
    monkeypatch.setattr(K, "BLOCK", 7)
    got = {r.def_id: r.ref_id for r in map_to_reference(df, ref).collect()}
    exact = [i for i, (_, v, w) in enumerate(CASES) if w > 0 and v in {r[2] for r in REF}]
    assert all(got[i] == CASES[i][2] for i in exact if CASES[i][0] in ("RTB", "VW"))


def test_edits_match_the_plain_definition():
    assert [edits(a, b, 2) for a, b in (("abc", "acb"), ("abc", "abc"), ("abc", "xyz"), ("abcd", "ab"), ("a", "abcd"))] == [1, 0, 3, 2, 3]
    assert label_key("MWCs") == "MWC" and label_key("sqs") == "SQS" and label_key("0.D.J.C.") == "ODJC" and label_key(None) == ""
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(2))
        assert edits(a, b, 6) == edits(b, a, 6)


def _both_ways(spark, monkeypatch, values, reference):
    import glossa.llm.canonical as C

    v = spark.createDataFrame(values, "def_id long, acronym string, acronym_expansion string")
    r = spark.createDataFrame(reference, "ref_id long, acronym string, expansion string")
    one = sorted(tuple(x) for x in C.map_to_reference(v, r).collect())
    monkeypatch.setattr(C, "BLOCK", 1)
    assert sorted(tuple(x) for x in C.map_to_reference(v, r).collect()) == one
    return one


def test_blocks_of_the_reference_do_not_change_the_answer(spark, monkeypatch):
    reference = [(1, "AB", "alpha beta"), (2, "BG", "beton gamma"), (3, "CD", "cell division"), (4, "DC", "division cell"), (5, None, "alpha beta")]
    values = [(1, None, "alpha beton"), (2, "AB", "alpha beta"), (2, "AB", "alpha beta"), (3, "CD", "cell divsion"), (4, "DC", "cell division"),
              (5, None, "gamma beton"), (6, None, "alhpa beta"), (7, "AB", ""), (8, "AB", None)]
    got = _both_ways(spark, monkeypatch, values, reference)
    assert (1, -1) in got and got.count((2, 1)) == 2 and (3, 3) in got and (4, 4) in got and (5, 2) in got and len(got) == 7


def test_long_names_and_long_values_are_matched():
    words = "north atlantic deep water mass transport section monitoring station network research programme bureau".split()
    m = Matcher([(7, None, " ".join(words))])
    assert len(words) == 13 and m.match(None, " ".join(words).replace("transport", "transprt"))[0] == 7
    assert m.match(None, " ".join(words * 400))[0] == -1


def test_near_words_hold_all_within_the_edits():
    import random

    from glossa.llm.canonical import Bags, edits

    rnd = random.Random(2)
    words = {"".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(300)}
    bags = Bags(words)
    for w in list(words)[:60]:
        near = set(bags.near(w, len(w) - 2, len(w) + 2, 2))
        assert {x for x in words if edits(w, x, 2) <= 2} <= near
