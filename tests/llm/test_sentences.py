import random

from glossa.llm.sentences import Splitter, corpus_counts, language, learn_model, sentences, split_corpus

NAMES = "Braho Vewi Oskar Lumor Drebra Kafro Pelum Zeora Quahel Rulgi".split()


def corpus():
    rnd = random.Random(3)
    texts = []
    for _ in range(400):
        n = rnd.choice(NAMES) + rnd.choice("abcdefgh")
        texts.append(rnd.choice([
            f"The dog met Dr. {n} near the lake. Every bell rang at noon.",
            f"The dog saw Fig. {rnd.randint(1, 99)} on the wall. The cat slept.",
            f"The old cat came with Prof. {n} today. Every road was long.",
            f"Every lake froze in winter! The bell of {n} rang. The road ended.",
            f"The road is long, e.g. the one of {n}. Every cat knows the wall.",
        ]))
    return texts


def model(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(corpus())], "sample_id int, text string, lang string")
    return learn_model(corpus_counts(df, "text", "lang"))


def split(s, t, lang="en"):
    return [t[a:b] for a, b in s.spans(t, lang)]


def test_learned_abbreviations(spark):
    rows = model(spark).collect()
    abbr = {r.w: r.final for r in rows if r.lang == "en" and r.kind == "abbr"}
    assert {"dr", "prof", "fig"} <= set(abbr) and not abbr["dr"]
    assert {"The", "Every"} <= {r.w for r in rows if r.lang == "en" and r.kind == "start"}
    s = Splitter([tuple(r) for r in rows])
    assert split(s, "The cat met Dr. Zorbal. Every road.") == ["The cat met Dr. Zorbal.", "Every road."]
    assert split(s, "See Fig. 3 now.\nThe end? Yes!") == ["See Fig. 3 now.", "The end?", "Yes!"]
    assert split(s, "By J. Smith\n\nThe dog\nslept. “Who came? The cat.” said Dr. Lee. The end.") == [
        "By J. Smith", "The dog\nslept.", "“Who came? The cat.” said Dr. Lee.", "The end."]
    assert split(s, "It is at a.example/v1.2/x.txt for Pim.The next came.") == ["It is at a.example/v1.2/x.txt for Pim.", "The next came."]


def test_scripts_without_model():
    s = Splitter([])
    assert split(s, "你好。“谁有钥匙？”然后就离开了。系统……后来停用了！", "zh") == ["你好。", "“谁有钥匙？”然后就离开了。", "系统……后来停用了！"]
    assert split(s, "「はい。そう。」と言った。次は？", None) == ["「はい。そう。」と言った。", "次は？"]
    assert split(s, "यह है। वह डॉ. राम है? हाँ।", "hi") == ["यह है।", "वह डॉ. राम है?", "हाँ।"]
    assert split(s, "ไปบ้าน กินข้าว", "th") == ["ไปบ้าน", "กินข้าว"]
    assert split(s, "د. كار جاء. سأل: «لمن؟» ثم ذهب.", "ar") == ["د. كار جاء.", "سأل: «لمن؟» ثم ذهب."]


def test_spans_cover_the_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    s = Splitter([])

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="aB .!?\n“”।。ก(),1", max_size=60), st.sampled_from(["en", "th", "zh", "hi", None]))
    def run(t, lang):
        spans = s.spans(t, lang)
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        covered = set().union(*(range(a, b) for a, b in spans)) if spans else set()
        assert all(i in covered or c.isspace() for i, c in enumerate(t))

    run()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "en", 0), (2, "", None, 0), (3, " \n ", "xx", 0), (4, "One. Two.", None, 0), (4, "One. Two.", None, 0), (5, "y" * 200_000, "en", 0)], "sample_id long, text string, lang string, start_pos int")
    got = sorted(tuple(r) for r in sentences(df).collect())
    assert got == [(4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9), (5, 0, 200_000)]
    assert sentences(df.where("sample_id = 9")).count() == 0


def test_both_ways_of_sharing_the_model_agree(spark, monkeypatch):
    import glossa.llm.sentences as S

    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(corpus()[:40])] + [(99, "ไปบ้าน ABC กินข้าว", "th")], "sample_id long, text string, lang string")
    m = model(spark)
    one = sorted(tuple(r) for r in split_corpus(df, m, "sample_id", "text", "lang").collect())
    monkeypatch.setattr(S, "MODEL_ROWS", 3)
    two = sorted(tuple(r) for r in split_corpus(df, m, "sample_id", "text", "lang").collect())
    assert one == two


def test_language():
    assert [language(*x) for x in (("EN ", "x"), (None, "नमस्ते"), ("zz", "hello"), (None, "漢字かな"), (None, "汉字"))] == ["en", "hi", "xx", "ja", "zh"]


def test_collocations_initials_and_numbers_are_decided_by_statistics(spark):
    from glossa.llm.sentences import Splitter, corpus_counts, learn_model

    rows = []
    for k in range(120):
        name = "".join("bdfgk"[k // 5**i % 5] + "aeiou"[k // 3**i % 5] for i in range(4))
        rows += [
            f"It is known! The {name} ran, as in Fig. {k} of the book. It was seen by Dr. {name.title()} of the town.",
            f"The {name} slept well! It came from {name} et al. In the north the {name} sang. It met {name} et al. It went home.",
            f"The house of J. {name.title()} is old. It stands by the {name}.",
        ]
    docs = spark.createDataFrame([(r, "en") for r in rows], "text string, lang string")
    model = [tuple(r) for r in learn_model(corpus_counts(docs, "text", "lang")).collect()]
    assert ("en", "pair", "fig <9>", True) in model
    split = Splitter(model)
    cut = lambda t: [t[a:b] for a, b in split.spans(t, "en")]
    assert cut("He needs vitamin C. It helps bones.") == ["He needs vitamin C.", "It helps bones."]
    assert cut("The house of J. Baker is old. It fell.") == ["The house of J. Baker is old.", "It fell."]
    assert cut("He left early. 12 men stayed there.") == ["He left early.", "12 men stayed there."]
    assert cut("It is in Fig. 7 of it.") == ["It is in Fig. 7 of it."]


def test_a_fixed_expression_over_a_period_is_a_collocation(spark):
    from glossa.llm.sentences import _pair

    row = spark.createDataFrame([(100, 40, 38, 20000), (100, 40, 1, 20000), (100, 9000, 50, 20000)], "a long, b long, ab long, n long")
    assert [r.x for r in row.select(_pair("a", "b", "ab", "n", 25.0).alias("x")).collect()] == [True, False, False]
