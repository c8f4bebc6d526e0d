from pyspark.sql import functions as F

from glossa.functions import acronyms as A
from glossa.functions import text as X
from glossa.functions.inflect import plural, porter, sequence_ratio, singular, stems


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()[0]


def test_v3_keeps_tokens_with_half_capitals(spark):
    got = one(spark, A.v3(F.col("t")), t="A Aa tPa tPA First eCG USA Ala")
    assert set(got) == {"ECG", "TPA", "USA"}


def test_extractors_take_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ABC XYZs")], "id int, t string")
    assert [tuple(r) for r in A.exploded(df, "id", A.v2(F.col("t"))).collect()] == [(3, "ABC"), (3, "XYZS")]
    assert one(spark, A.singular(A.v2(F.col("t"))), t="ABCs ABC DEF") == ["ABC", "DEF"]


def test_accented_letters_do_not_split_words(spark):
    assert one(spark, A.v2(F.col("t")), t="ACCIÓN ABC") == ["ABC"]
    assert one(spark, A.embedded(F.col("t")), t="the RNA-DNA pair") == ["RNA-DNA"]


def test_without_words_drops_listed_words(spark):
    found = spark.createDataFrame([(1, "THE"), (1, "USA")], "id int, acronym string")
    words = spark.createDataFrame([("the",)], "w string")
    assert [r.acronym for r in A.without_words(found, words).collect()] == ["USA"]


FUZZY = [
    ("premature ventricular contractions", "premature ventricular contractions", True),
    ("diamond-blackfan anemia", "diamond blackfan anemia", True),
    ("anti-lymphocyte serum", "antilymphocyte serum", True),
    ("primary ciliary dyskinesia", "primary ciliary diskinesia", True),
    ("osteochondritis dissecans", "osteochondral defects", False),
]


def test_fuzzy_equality(spark):
    from glossa.operators.linkage import similar

    df = spark.createDataFrame(FUZZY, "a string, b string, want boolean")
    for r in df.select("a", "b", "want", X.fuzzy_equal(F.col("a"), F.col("b")).alias("got"), X.fuzzy_equal(F.col("b"), F.col("a")).alias("back")).collect():
        assert r.got == r.want == r.back == similar(r.a, r.b)


def test_substitution_and_its_reverse(spark):
    pairs = F.array(F.struct(F.lit("NASA").alias("acronym"), F.lit("National Aeronautics").alias("expansion")))
    text = "National Aeronautics (NASA) flew. nasa landed."
    assert one(spark, X.substitute_pairs(F.col("t"), pairs), t=text) == "National_Aeronautics (National_Aeronautics) flew. National_Aeronautics landed."
    back, n = X.restore_acronym(X.substitute_pairs(F.col("t"), pairs), F.lit("National Aeronautics"), F.lit("NASA"))
    assert one(spark, back, t=text) == "NASA (NASA) flew. NASA landed." and one(spark, n, t=text) == 3


def test_cleaned_words(spark):
    assert one(spark, X.content_words(F.col("t")), t="This Is A Test String") == ["test", "string"]
    assert one(spark, X.content_words(F.col("t")), t="This is a sentence with 01 2 10 numbers") == ["sentence", "numbers"]
    assert one(spark, X.content_words(F.col("t")), t="") == []


def test_small_text_functions(spark):
    assert one(spark, X.expansion_token(F.col("t")), t=" a-b (c) ") == "a_b_c"
    assert one(spark, X.word_ngrams(F.col("t"), 2), t=["a", "b", "c"]) == ["a b", "b c"]
    assert one(spark, X.word_ngrams(F.col("t"), 2), t=["a"]) == []
    assert one(spark, X.french_form(F.col("t")), t="Réseaux des-Bâtiments") == "reseaux de batiment"
    assert one(spark, X.plain_html(F.col("t")), t="<p>a &amp; b</p><script>x</script>") == "a & b"
    assert one(spark, X.detokenise(F.col("t")), t="Superior Técnico ( IST ) .".split()) == "Superior Técnico (IST)."
    assert one(spark, X.context(F.col("t"), F.lit("xyz"), 2), t="abcXYZdef") == "bcXYZde"
    assert one(spark, X.context(F.col("t"), F.lit("q"), 2), t="abc") is None
    assert one(spark, X.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == 1 / 3


def test_stems_and_plurals(spark):
    for word, stem in (("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("agreed", "agre"), ("sky", "sky"), ("happy", "happi"), ("adoption", "adopt"), ("controll", "control")):
        assert porter(word) == stem
    assert one(spark, stems(F.col("t")), t=["ponies", "sky"]) == ["poni", "sky"]
    assert [plural(w) for w in ("box", "city", "array")] == ["boxes", "cities", "arrays"]
    assert [singular(w) for w in ("boxes", "cities", "arrays", "glass")] == ["box", "city", "array", "glass"]
    assert one(spark, sequence_ratio(F.col("a"), F.col("b")), a="abcd", b="abce") == 0.75


def test_token_budget_and_near_replacement():
    from glossa.functions.inflect import replace_nearly, token_budget

    parts = [list("abcd"), list("efghij"), list("klm")]
    assert token_budget(parts, 100) == list("abcdefghijklm")
    assert token_budget(parts, 4) == ["d", "e", "j", "k"]
    assert token_budget(parts, 6) == ["c", "d", "e", "f", "j", "k"] or len(token_budget(parts, 6)) == 6
    assert replace_nearly("the primary ciliary dyskinesya here", "primary ciliary dyskinesia", "P_C_D") == "the P_C_D here"
    assert replace_nearly("nothing like it", "primary ciliary dyskinesia", "P") is None
