import random

from glossa.llm.consensus import annotation_labels, consensus
from glossa.llm.grouped import entities, latest_folds, related_groups, stratified_splits, surname, torn_articles


def test_names():
    assert {surname(n) for n in ("Orvane Kestrelin", "O. KESTRELIN", "Kestrelin, O.", "KESTRELIN, Orvane.")} == {"kestrelin"}
    assert surname("Orvane") is None
    for line in ("By Orvane Kestrelin.", "(Rédigé par KESTRELIN, Orvane.)", "— O. Kestrelin", "文／Kestrelin, O.", "作者：Orvane KESTRELIN。", "بقلم Orvane Kestrelin.", "ผู้เขียน O. Kestrelin", "लेखक: Kestrelin, O.।", "Texte : Orvane Kestrelin"):
        assert entities("body text.\n\n" + line) == {"a:kestrelin"}, line
    assert entities("x\n\nVon Neris Clig und Corva Kak.") == {"a:clig", "a:kak"}
    for line in ("Source: Sopey Bulletin, vol. 5, no. 3.", "(From SOPEY BULLETIN 5, No. 3.)", "First printed in Sopey Bulletin 5(3).", "ที่มา Sopey Bulletin 5/3", "来源：Sopey Bulletin, vol. 5, no. 3。"):
        assert entities("x\n\n" + line) == {"s:sopey bulletin|5|3"}, line
    assert entities("By Orvane Kestrelin.") == {"a:kestrelin"} and entities("x\n\nBy the old bridge near town.") == set() and entities("") == set()


def docs(spark):
    rows = [("a1", "x.\n\nBy A. One."), ("a1", "y."), ("a2", "x.\n\nOne, A."), ("a2", "x.\n\nBy Bea ONE."), ("a3", "z.\n\nSource: Ju, vol. 1, no. 2."), ("a4", "w\n\n(From JU 1(2).)"), ("a4", "w\n\nBy B. Two."), ("a5", None), (None, "x\n\nBy A. One."), ("a6", "")]
    return spark.createDataFrame(rows, "article_id string, text string")


def test_groups_and_torn_articles(spark):
    g = {r.article_id: r.group_id for r in related_groups(docs(spark)).collect()}
    assert set(g) == {"a1", "a2", "a3", "a4", "a5", "a6"}
    assert g["a1"] == g["a2"] != g["a3"] == g["a4"] and g["a5"] == "a5"
    reports = spark.createDataFrame([(1, "0", "a1", 1), (2, "1", "a1", 2), (3, None, "a1", 3), (4, "0", "a2", 1), (5, "2", "a3", 1), (6, "2", "a4", 1), (7, "3", None, 1), (8, "1", "zz", 1)], "report_id long, fold string, doc_id string, reported_at int")
    f = latest_folds(reports)
    assert {r.doc_id: r.fold for r in f.collect()} == {"a1": "1", "a2": "0", "a3": "2", "a4": "2", "zz": "1"}
    assert sorted(r.doc_id for r in torn_articles(related_groups(docs(spark)), f).collect()) == ["a1", "a2"]


def test_splits_keep_groups_and_proportions(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for g in range(600):
        for k in range(300 if g == 0 else rnd.randint(1, 4)):
            rows.append((f"{g}-{k}", str(g)))
            labels.append((f"{g}-{k}", rnd.choice(["en", "en", "en", "fr", "th", None])))
    m = spark.createDataFrame(rows, "article_id string, group_id string")
    s = stratified_splits(m, spark.createDataFrame(labels, "article_id string, label string")).toPandas()
    assert len(s) == len(rows) and s.groupby("group_id").split.nunique().max() == 1
    share = s.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    th = s[s.article_id.isin([a for a, l in labels if l == "th"])].split.value_counts(normalize=True)
    assert abs(th["test"] - 0.1) < 0.04
    assert stratified_splits(m.where("group_id = 'none'"), spark.createDataFrame(labels, "article_id string, label string")).count() == 0


def test_blocks(spark, monkeypatch):
    import glossa.llm.grouped as G

    monkeypatch.setattr(G, "BLOCK", 50)
    m = spark.createDataFrame([(str(i), str(i // 2)) for i in range(2_000)], "article_id string, group_id string")
    l = spark.createDataFrame([(str(i), "x" if i % 3 else "y") for i in range(2_000)], "article_id string, label string")
    s = stratified_splits(m, l).toPandas()
    assert abs((s.split == "train").mean() - 0.8) < 0.03 and s.groupby("group_id").split.nunique().max() == 1


def test_a_label_rare_in_every_block_gets_its_shares(spark, monkeypatch):
    import glossa.llm.grouped as G

    monkeypatch.setattr(G, "BLOCK", 50)
    m = spark.createDataFrame([(str(i), str(i)) for i in range(2_000)], "article_id string, group_id string")
    rare = {str(i) for i in range(0, 2_000, 20)}
    l = spark.createDataFrame([(str(i), "x") for i in range(2_000)] + [(i, "rare") for i in rare], "article_id string, label string")
    s = stratified_splits(m, l).toPandas()
    assert s[s.article_id.isin(rare)].split.value_counts().to_dict() == {"train": 80, "validation": 10, "test": 10}
    assert len(s) == 2_000 and abs((s.split == "train").mean() - 0.8) < 0.03


def annotations(spark, n=300):
    rnd = random.Random(5)
    care = {f"an{i}": (0.95 if i < 4 else 0.4) for i in range(12)}
    rows, truth, row = [], {}, 0
    for d in range(n):
        right, wrong = f"good label {d}", f"bad label {d}"
        truth[f"d{d}"] = right
        for a in rnd.sample(sorted(care), 5):
            row += 1
            rows.append((row, f"d{d}", a, None, {"A.Bs": right.upper() if rnd.random() < care[a] else wrong}, row))
    return rows, truth


SCHEMA = "row_id long, doc_id string, annotator string, actual_expansions map<string,string>, predicted_expansions map<string,string>, submitted_at int"


def test_consensus_beats_the_majority(spark):
    rows, truth = annotations(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    labels, gold = annotation_labels(df.withColumn("submitted_at", df.submitted_at.cast("timestamp")))
    items, annotators, agreement = consensus(labels, gold)
    got = {r.doc_id: r.expansion for r in items.collect()}
    assert {r.acronym for r in items.collect()} == {"AB"} and set(got) == set(truth)
    right = sum(got[d] == t for d, t in truth.items()) / len(truth)
    votes = labels.groupBy("doc_id", "label").count().toPandas().sort_values(["count", "label"], ascending=[False, True]).drop_duplicates("doc_id")
    majority = (votes.set_index("doc_id").label.map(str) == [truth[d] for d in votes.doc_id]).mean()
    assert right > 0.8 and right > majority + 0.03
    tilt = {r.annotator: r.tilt for r in annotators.collect()}
    assert min(tilt[f"an{i}"] for i in range(4)) > max(tilt[f"an{i}"] for i in range(4, 12))
    assert -1 <= agreement.first().alpha <= 1


def test_odd_annotations(spark):
    rows = [
        (1, "d", "a", None, {"X.Ys": "Old"}, 1), (2, "d", "a", {"XY": "new-one"}, {" XY ": "New-One "}, 2), (3, "d", "b", None, None, 3), (4, "e", "a", None, {"Q": None}, 1),
        (5, None, "a", None, {"Z": "z"}, 1), (6, "f", None, None, {"Z": "z"}, 1), (2, "d", "a", {"XY": "new-one"}, {" XY ": "New-One "}, 2), (7, "g", "a", {"P": "unseen"}, {"P": "b"}, 1), (8, "g", "b", None, {"P": "a"}, 1), (9, "h", "a", None, {"": "x"}, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumn("submitted_at", df.submitted_at.cast("timestamp"))
    items, _, _ = consensus(*annotation_labels(df))
    assert sorted((r.doc_id, r.acronym, r.expansion) for r in items.collect()) == [("d", "XY", "new one"), ("g", "P", "b")]  # annotator a is the more reliable
    empty, annotators, agreement = consensus(*annotation_labels(df.where("row_id < 0")))
    assert empty.count() == 0 and annotators.count() == 0 and agreement.count() == 1


def test_author_lines_in_all_scripts_and_lengths():
    from glossa.llm.grouped import entities

    name = lambda line: entities("A text stands here.\n\n" + line)
    assert name("作者：王小明") == {"a:王小明"} and name("بقلم: أحمد علي") == {"a:علي"}
    assert name("लेखक: राम शर्मा") == name("लेखक: श्याम शर्मा") != name("लेखक: राम शरम") and name("ผู้เขียน: สมชาย ใจดี") == {"a:ใจดี"}
    assert name("By Jane Roe, Ann Lee, Tom Fox") == {"a:roe", "a:lee", "a:fox"} and name("By Roe, J.") == {"a:roe"}
    assert name("By Maria del Carmen de la Cruz") == {"a:cruz"} and name("By " + " and ".join(f"Ann Roe{c}" for c in "abcdefghijklmnopqrstuvwxyz" * 2)) == {f"a:roe{c}" for c in "abcdefghijklmnopqrstuvwxyz"}
    assert name("By the old mill") == name("文章很好") == set() and entities("By Jane Roe") == {"a:roe"}


def test_rounds_that_do_not_settle_are_an_error(spark):
    import pytest

    from glossa.llm.consensus import consensus

    labels = spark.createDataFrame([(d, "AB", a, "x" if (d + a) % 3 else "y") for d in range(12) for a in range(4)], "doc_id int, acronym string, annotator int, label string")
    with pytest.raises(RuntimeError):
        consensus(labels, rounds=1)
    assert consensus(labels)[0].count() == 12
