import json

from glossa.sources import corpora as C
from glossa.sources import sinks as K
from glossa.streaming.extraction import hourly_acronyms


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_wiki_documents(spark, tmp_path):
    p = put(tmp_path, "w", '<doc id="1" url="u" title="T">\nhello\n</doc>\n<doc id="2" url="v" title="S">\nmore\n</doc>')
    assert rows(C.wiki_documents(spark, p)) == [("1", "u", "T", "hello"), ("2", "v", "S", "more")]


def test_bioc(spark, tmp_path):
    p = put(tmp_path, "b.xml", '<collection><document><id>7</id><passage><annotation id="SF0"><text>ABC</text></annotation><annotation id="LF0"><text>a big cat</text></annotation><relation id="R0"><node refid="LF0" role="LongForm"/><node refid="SF0" role="ShortForm"/></relation></passage></document></collection>')
    assert rows(C.bioc_pairs(spark, p)) == [("7", "ABC", "a big cat")]


def test_json_formats(spark, tmp_path):
    p = put(tmp_path, "a.json", json.dumps([{"id": "1", "tokens": ["the", "RNA", "x"], "acronym": 1, "expansion": "ribo"}]))
    assert rows(C.token_samples(spark, p)) == [("1", "RNA", "ribo", "the RNA x")]
    p = put(tmp_path, "t.json", json.dumps([{"id": "1", "tokens": ["a", "B"], "labels": ["O", "B-short"]}]))
    assert rows(C.tagged_sentences(spark, p)) == [("1", 0, "a", "O"), ("1", 1, "B", "B-short")]
    p = put(tmp_path, "u.json", json.dumps({"sentence": ["see", "__ABB__"], "short-form": "AB", "long-form": "a b"}))
    assert [r[1:] for r in rows(C.masked_lines(spark, p))] == [("AB", "a b", "see AB")]
    p = put(tmp_path, "n.json", json.dumps({"AB": {"full_form": "a b", "link": "l", "content": "c", "possibilities": [{"full_form": "x y", "link": "m", "content": "d"}]}}))
    assert rows(C.nested_possibilities(spark, p)) == [("AB", "a b", "l", "c"), ("AB", "x y", "m", "d")]
    p = put(tmp_path, "s.json", json.dumps([{"ID": "1", "text": "big cat BC", "acronyms": [[8, 10]], "long-forms": [[0, 7]]}]))
    assert rows(C.span_samples(spark, p)) == [("1", "big cat BC", ["BC"], ["big cat"])]


def test_line_formats(spark, tmp_path):
    p = put(tmp_path, "m.arff", '@DATA\n12,"some \\"text\\"",M1\n')
    assert [r[1:] for r in rows(C.arff_rows(spark, p))] == [("12", 'some \\"text\\"', "M1")]
    p = put(tmp_path, "r.sgm", '<REUTERS NEWID="5"><BODY>one\ntwo</BODY></REUTERS><REUTERS NEWID="6"></REUTERS>')
    assert rows(C.sgml_articles(spark, p)) == [("5", "one two")]
    lines = spark.createDataFrame([("f", 1, "d1 :"), ("f", 2, "AB | a b"), ("f", 3, "CD | [c d]")], "file string, line_no int, value string")
    assert rows(C.labelled_text(lines)) == [("d1", "AB", "a b", True), ("d1", "CD", "c d", False)]
    cells = spark.createDataFrame([(1, "AB;A B\nbad line\nCD;c"), (2, None)], "id int, c string")
    assert rows(C.annotation_cells(cells, "id", "c")) == [(1, "AB", "a b"), (1, "CD", "c")]
    v = spark.createDataFrame([("1", 1, "2020-01-01"), ("1", 2, "2021-01-01"), ("1", 3, "2022-01-01")], "article_id string, version int, updated string").selectExpr("article_id", "version", "cast(updated as timestamp) updated")
    assert [r.version for r in C.version_before(v, "2021-06-01").collect()] == [2]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f", "d", "AB", {"x": 0.5})], "fold string, doc_id string, acronym string, confidences map<string,double>")
    K.append_report(df, str(tmp_path / "log"))
    assert K.read_confidences(spark, str(tmp_path / "log")).first().confidences == {"x": 0.5}
    K.write_relation(df, str(tmp_path / "rel"), "fold")
    assert spark.read.parquet(str(tmp_path / "rel")).count() == 1
    assert not K.append_jdbc(df.drop("confidences"), "jdbc:none://x", "t", str(tmp_path / "dead"))
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 1
    r = K.responses(spark.createDataFrame([(1, "A", "x"), (1, "B", "y")], "id int, acronym string, expansion string"), "id").first()
    assert json.loads(r.response) == {"A": "x", "B": "y"}


def test_pages(spark):
    from glossa.operators.pages import followed, link_table, parsed

    html = '<p>See <a href="/x" title="big cat">BC</a>, <a href="#y">no</a> <abbr title="red fox">RF</abbr><script>no</script></p>'
    pages = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    p = {r.id: r for r in parsed(pages, "id", "html").collect()}
    assert p[1].text == "See BC , no RF" and [tuple(x) for x in p[1].links] == [("BC", "big cat", "/x")] and [tuple(x) for x in p[1].abbrs] == [("RF", "red fox")] and p[2].text == ""
    assert rows(link_table(pages, "id", "html")) == [(1, "bc", "/x")]
    u = spark.createDataFrame([(1, "BC"), (1, "RF"), (1, "ZZ")], "doc_id int, acronym string")
    a = spark.createDataFrame([(1, "RF", "red fox")], "doc_id int, name string, title string")
    l = spark.createDataFrame([(1, "BC", "big cat", "/x")], "doc_id int, name string, title string, href string")
    q = spark.createDataFrame([], "href string, acronym string, expansion string")
    assert rows(followed(u, a, l, q).fillna("")) == [(1, "BC", "big cat"), (1, "RF", "red fox"), (1, "ZZ", "")]


def test_stream_windows(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "ABC DEF"), ("2024-01-01 11:00:00", "ABC")], "at string, text string").selectExpr("cast(at as timestamp) at", "text")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = hourly_acronyms(s, "at").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select acronym, n from windows")) == [("ABC", 2), ("DEF", 1)]
