import random

from glossa.llm.leaks import Passages, leaked, shard_matches, tokens, without_leaks
from glossa.llm.reading import LEVEL_OF, Calibration, LevelModel, features, reading_levels, train_levels

WORDS = [f"w{i}" for i in range(300)]


def passage(rnd, n=60):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_maximal_matches_equal_brute_force():
    import numpy as np

    rnd = random.Random(1)
    items = [(1, passage(rnd)), (2, passage(rnd, 30)), (3, "short one"), (4, None), (5, "中文测试一二三四五六七八九十")]
    p = Passages(items)
    text = passage(rnd, 20) + " " + " ".join(items[0][1].split()[10:40]) + " x " + " ".join(items[1][1].split()[:7]) + " " + items[4][1][2:]
    shard = np.array([p.vocab.get(w, -1) for w in tokens(text)] + [-1])
    got = set(zip(*(x.tolist() for x in shard_matches(p, shard))))
    want = set()
    for size, _, places in p.windows:
        for t in places.tolist():
            for s in range(len(shard)):
                k = 0
                while t + k < len(p.flat) and s + k < len(shard) and p.flat[t + k] == shard[s + k] >= 0:
                    k += 1
                if k >= size and (p.flat[t - 1] != shard[s - 1] or p.flat[t - 1] < 0 or s == 0):
                    want.add((t, s, k))
    assert got == want and got


def test_leaks(spark):
    rnd = random.Random(3)
    items = [(i, passage(rnd)) for i in range(6)]
    notice = "this notice stands at the end of very many pages of the yearbook"
    items[5] = (5, " ".join(items[5][1].split()[:20]) + " " + notice)
    w = items[0][1].split()
    docs = [
        (1, "lead in text " + items[0][1].upper() + "!"), (2, "x " + " ".join(w[:25]) + " other words here " + passage(rnd, 20)), (3, passage(rnd)),
        (4, "<p>" + ", ".join(w[5:20]) + "</p> foreign. " + " ".join(w[21:40]) + "</p>"), (5, " ".join(w[:9])), (6, None), (7, ""), (1, "lead in text " + items[0][1].upper() + "!"),
    ] + [(20 + k, passage(rnd, 30) + " " + notice) for k in range(14)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id")
    it = spark.createDataFrame([(i, t) for i, t in items] + [(9, None), (10, "")], "item_id long, passage string")
    got = leaked(d, it)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 0), (2, 0), (4, 0)]
    assert {r.doc_id: r.part for r in got.collect()}[1] == 1.0
    assert without_leaks(d, got).where("doc_id in (1, 2, 4)").count() == 0
    assert leaked(d.where("doc_id < 0"), it).count() == 0


def test_copies_of_a_third_are_no_notice(spark):
    rnd = random.Random(9)
    w, other = passage(rnd, 82).split(), passage(rnd, 50)
    notice = "this notice stands at the end of very many pages of the yearbook"
    items = [(1, " ".join(w)), (2, passage(rnd, 20) + " " + notice), (3, other + " " + notice)]
    docs = [(i, passage(rnd, 30) + " z " + " ".join(w[20:48]) + " z " + passage(rnd, 5)) for i in range(40)]
    docs += [(50, " ".join(w)), (51, other)] + [(60 + i, passage(rnd, 30) + " z " + notice + " z") for i in range(9)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = leaked(d, spark.createDataFrame(items, "item_id long, passage string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, 1) for i in [*range(40), 50]] + [(51, 3)]


def test_leaks_in_short_runs(spark):
    rnd = random.Random(6)
    w = passage(rnd).split()
    parts = [w[i : i + 9] for i in range(0, 60, 10)]
    foreign = lambda n: " ".join(f"z{rnd.randrange(999)}" for _ in range(n))
    docs = [
        (1, ". ".join(" ".join(x) + " " + foreign(40) for x in parts)), (2, " other ".join(" ".join(x) for x in parts)),
        (3, ". ".join(" ".join(x) + foreign(400) for x in parts[::-1])), (4, " ".join(" ".join(x) + " y" for x in parts[::-1])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in leaked(d, spark.createDataFrame([(1, " ".join(w))], "item_id long, passage string")).collect()) == [1, 2, 4]


def test_suffix_array_gives_all_maximal_matches():
    import numpy as np

    from glossa.llm.leaks import Passages, shard_matches, suffix_array

    rnd = random.Random(9)
    for k in range(60):
        letters = "abcde"[: rnd.randrange(2, 6)]
        p = Passages([(i, " ".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 40)))) for i in range(5)])
        shard = np.array([x for _ in range(8) for x in [*(p.vocab.get(rnd.choice(letters + "x"), -1) for _ in range(rnd.randrange(40))), -1]], np.int64)
        want = set()
        for t in range(1, len(p.flat) - 1):
            for s in range(len(shard)):
                n = 0
                while s + n < len(shard) and p.flat[t + n] >= 0 and p.flat[t + n] == shard[s + n]:
                    n += 1
                if n >= 5 and (s == 0 or p.flat[t - 1] < 0 or p.flat[t - 1] != shard[s - 1]):
                    want.add((t, s, n))
        assert set(zip(*(x.tolist() for x in shard_matches(p, shard)))) == want
    shard = np.array([1, 1, 1, 1, 1, 1, 1, -1, 1, 1, 1, 1, 1, 2], np.int64)
    order = suffix_array(shard, np.array([0, 1, 2, 8, 9]), 5).tolist()
    assert order == sorted([0, 1, 2, 8, 9], key=lambda a: shard[a:].tolist())


def test_clean_corpus(spark):
    from glossa.llm.leaks import without_leaks

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "b")], "doc_id long, text string")
    leaks = spark.createDataFrame([(2, 7), (2, 8)], "doc_id long, item_id long")
    assert sorted((r.doc_id or 0) for r in without_leaks(docs, leaks).collect()) == [0, 1]


def test_features_are_those_of_single_sentences():
    import numpy as np

    ss = ["The Dog ran.", "", "中文 测试", "a\nb c", "x1 y2"]
    f = features(ss)
    for i, s in enumerate(ss):
        g = features([s])
        for (slots, own), (one, _) in zip([*f.char, f.word], [*g.char, g.word]):
            assert sorted(slots[own == i].tolist()) == sorted(one.tolist())
        assert (f.letters[i], f.words[i]) == (g.letters[0], g.words[0])


def samples():
    rnd = random.Random(4)
    easy, hard = "cat dog sun bed red map".split(), "stratification homeostasis permeability jurisprudence epidemiology".split()
    out = []
    for k in range(150):
        level = k % 5 + 1
        words, size = (easy if level < 3 else hard), 3 + 3 * level
        out.append((k, "en", " ".join("The " + " ".join(rnd.choice(words) for _ in range(size)) + "." for _ in range(7)), level))
    return out


def graded(n, seed=4):
    """Texts of three grades of length by three of vocabulary; the level is the sum of the two."""
    rnd = random.Random(seed)
    easy, hard = "cat dog sun bed red map".split(), "stratification homeostasis permeability jurisprudence epidemiology".split()
    out = []
    for k in range(n):
        a, b = k % 3, k // 3 % 3
        size = (4, 9, 22)[a]
        word = lambda: rnd.choice(hard if rnd.random() < (0.02, 0.25, 0.6)[b] else easy)
        ss = ["The " + " ".join(word() for _ in range(size + rnd.randrange(-1, 2))) + "." for _ in range(9)]
        out.append(("en", a + b + 1, ss))
    return out


def points(m, data):
    import numpy as np

    own = np.repeat(np.arange(len(data)), [len(d[2]) for d in data])
    v, l = m.document_scores([s for d in data for s in d[2]], np.array(["en"] * len(own)), own, len(data))
    return np.column_stack([l, v])


def test_held_out_accuracy():
    import numpy as np

    m = LevelModel().fit(graded(27))
    new = graded(600, 5)
    x, s = points(m, new), m.scales["en"]
    known = np.column_stack([s.length, s.vocabulary])
    y = np.array([v for _, v, _ in new])
    alone = Calibration(np.zeros((0, 2)), np.zeros(0), known, s.level).levels(x).argmax(1) + 1
    both = Calibration(x, np.ones(len(x)), known, s.level).levels(x).argmax(1) + 1
    assert (alone == y).mean() > 0.85 and (both == y).mean() > 0.93
    assert sorted(set(LEVEL_OF)) == [1, 2, 3, 4, 5]


def test_thousands_of_samples_need_little_memory():
    import subprocess
    import sys

    code = (
        "import resource, random\n"
        "from glossa.llm.reading import LevelModel\n"
        "r = random.Random(1)\n"
        "w = [''.join(r.choice('abcdefghijklmnop') for _ in range(r.randrange(3, 12))) for _ in range(3000)]\n"
        "LevelModel().fit([('en', k % 5 + 1, [' '.join(r.choice(w) for _ in range(4 + 4 * (k % 5))) for _ in range(8)]) for k in range(2000)])\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout.split()[-1]) < 1_500_000  # KB


def test_levels_of_odd_documents(spark):
    s = spark.createDataFrame(samples(), "reading_id long, lang string, text string, reading_level int")
    t = samples()[3][2]
    docs = spark.createDataFrame([(1, t, "en"), (2, None, "en"), (3, "", None), (4, "One. Two.", "en"), (5, "<p>" + t + "</p>", None), (1, t, "en")], "doc_id long, text string, lang string").selectExpr("*", "9 as reading_level")
    got = sorted((r.doc_id, r.reading_level, r.sentences) for r in reading_levels(docs, s).collect())
    assert [g[0] for g in got] == [1, 1, 5] and {g[2] for g in got} == {7} and len({g[1] for g in got}) == 1
    assert reading_levels(docs.where("doc_id = 2"), s).count() == 0


def test_a_model_too_large_to_send_gives_the_same_levels(spark, monkeypatch):
    import glossa.llm.reading as R

    s = spark.createDataFrame(samples(), "reading_id long, lang string, text string, reading_level int")
    docs = spark.createDataFrame([(i, samples()[i][2] + " Dr. Lee met Fig. 3.", "en") for i in range(20)], "doc_id long, text string, lang string")
    one = sorted(tuple(r)[:2] + (r.sentences,) for r in reading_levels(docs, s).collect())
    monkeypatch.setattr(R, "MODEL_ROWS", 0)
    assert sorted(tuple(r)[:2] + (r.sentences,) for r in reading_levels(docs, s).collect()) == one and len(one) == 20
