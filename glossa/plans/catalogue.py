"""Queries of the core operators: {name: callable(spark, sf_dir)} and their DuckDB SQL.

Every query runs over its whole tables. The SQL is written from the meaning of
the operators, on the registered views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import acronyms as A
from glossa.functions import text as X
from glossa.operators import agreement as G
from glossa.operators import dictionary as D
from glossa.operators import expanders as E
from glossa.operators import linkage as L
from glossa.operators import metrics as M
from glossa.operators import vectors as V
from glossa.runtime import cut, sized_broadcast, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- shared pieces of SQL

_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
_ACR = "upper(regexp_replace(regexp_replace(trim(acronym), '\\.', '', 'g'), '([A-Z0-9])s$', '\\1'))"
_FOLD = f"translate(lower(%s), '{X.ACCENTED}', '{X.UNACCENTED}')"


def _exp(c: str) -> str:
    return f"trim(regexp_replace({_FOLD % c}, '[-_ ]+', ' ', 'g'))"


_PAIRS = (
    f"pairs AS (SELECT * FROM (SELECT {_ACR} AS acronym, {_exp('expansion')} AS expansion, article_id, in_text FROM acronym_pairs) t "
    "WHERE acronym <> '' AND expansion <> '')"
)
_MF = (
    "counts AS (SELECT acronym, expansion, count(*) AS n FROM {src} GROUP BY 1, 2), "
    "mf AS (SELECT acronym, (array_agg(expansion ORDER BY n DESC, expansion))[1] AS expansion, round(max(n) / sum(n), 6) AS confidence, count(*) AS n_options FROM counts GROUP BY 1)"
)
_ROLES = "roles AS (SELECT DISTINCT article_id, role FROM splits WHERE article_id IS NOT NULL)"
_SPLIT = (
    f"{_PAIRS}, {_ROLES}, train AS (SELECT p.* FROM pairs p SEMI JOIN (SELECT * FROM roles WHERE role = 'train') r USING (article_id)), "
    "test AS (SELECT p.* FROM pairs p SEMI JOIN (SELECT * FROM roles WHERE role = 'test') r USING (article_id))"
)


def _prefix(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda w: left(w, 4)), ' ')"


def _fuzzy(a: str, b: str) -> str:
    return f"({a} = {b} OR {_prefix(a)} = {_prefix(b)} OR levenshtein({a}, {b}) <= 2)"


_GOLD = "gold AS (SELECT article_id, acronym, min(expansion) AS actual, bool_or(in_text) AS in_text FROM test GROUP BY 1, 2)"
_EVAL = (
    f"{_SPLIT}, {_GOLD}, {_MF.format(src='train')}, known AS (SELECT DISTINCT acronym, expansion FROM train), "
    "folds AS (SELECT article_id, CAST(('0x' || substr(md5(article_id), 1, 8))::BIGINT % 5 AS INT) AS fold FROM (SELECT DISTINCT article_id FROM gold)), "
    f"evaluated AS (SELECT g.article_id, g.acronym, g.actual, g.in_text, f.fold, m.expansion AS predicted, coalesce(m.n_options, 0) AS n_options, "
    f"coalesce({_fuzzy('g.actual', 'm.expansion')}, false) AS success, k.expansion IS NOT NULL AS in_db, "
    "CASE WHEN m.n_options IS NULL THEN 'none' WHEN m.n_options = 1 THEN 'single' ELSE 'expander' END AS module "
    "FROM gold g JOIN folds f USING (article_id) LEFT JOIN mf m ON g.acronym = m.acronym LEFT JOIN known k ON g.acronym = k.acronym AND g.actual = k.expansion)"
)


# ---- shared frames


def _pairs(spark, d):
    return D.normalised(table(spark, d, "acronym_pairs"))


def _roles(spark, d, role):
    return table(spark, d, "splits").where((F.col("role") == role) & F.col("article_id").isNotNull()).select("article_id").distinct()


def _train_test(spark, d):
    p = _pairs(spark, d)
    return D.in_articles(p, _roles(spark, d, "train")), D.in_articles(p, _roles(spark, d, "test"))


def _evaluated(spark, d):
    train, test = _train_test(spark, d)
    gold = test.groupBy("article_id", "acronym").agg(F.min("expansion").alias("actual"), F.bool_or("in_text").alias("in_text"))
    known = train.select("acronym", F.col("expansion").alias("actual")).distinct().withColumn("k", F.lit(True))
    best = D.most_frequent(train).withColumnRenamed("expansion", "predicted")
    folds = D.hashed_fold(gold, 5)
    g = gold.join(folds, "article_id").join(best, "acronym", "left").join(known, ["acronym", "actual"], "left")
    n = F.coalesce("n_options", F.lit(0))
    return g.select(
        "article_id", "acronym", "actual", "in_text", "fold", "predicted", n.alias("n_options"),
        F.coalesce(X.fuzzy_equal(F.col("actual"), F.col("predicted")), F.lit(False)).alias("success"), F.coalesce("k", F.lit(False)).alias("in_db"),
        F.when(n == 0, "none").when(n == 1, "single").otherwise("expander").alias("module"),
    )


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


# ---- acronym extraction


def _upper_sql(pattern: str) -> str:
    return f"SELECT DISTINCT doc_id, upper(w) AS acronym FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE regexp_full_match(w, '{pattern}')"


@query(_upper_sql("[A-Z]{3,8}s?"))
def acronym_v2(spark, d):
    return A.exploded(_docs(spark, d), "doc_id", A.v2(F.col("text")))


@query(_upper_sql("[A-Z]{2,8}s?"))
def acronym_v2_small(spark, d):
    return A.exploded(_docs(spark, d), "doc_id", A.v2(F.col("text"), 2))


@query(
    f"WITH w AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS w FROM documents), "
    "lexicon AS (SELECT DISTINCT upper(w) AS w FROM w WHERE regexp_full_match(w, '[a-z]+')) "
    "SELECT DISTINCT doc_id, upper(w) AS acronym FROM w WHERE regexp_full_match(w, '[A-Z]{3,8}s?') AND upper(w) NOT IN (SELECT w FROM lexicon)"
)
def acronym_v1(spark, d):
    docs = _docs(spark, d)
    lexicon = docs.select(F.explode(X.words(F.col("text"))).alias("w")).where(F.col("w").rlike("^[a-z]+$")).distinct()
    return A.without_words(A.exploded(docs, "doc_id", A.v2(F.col("text"))), lexicon)


@query(
    f"SELECT DISTINCT doc_id, upper(w) AS acronym FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE regexp_full_match(w, '[A-Za-z0-9]{{2,8}}s?') "
    "AND CASE WHEN length(regexp_replace(w, 's$', '')) <= 2 THEN regexp_full_match(regexp_replace(w, 's$', ''), '[A-Z0-9]+') AND regexp_matches(w, '[A-Z]') "
    "ELSE length(regexp_replace(w, '[^A-Z]', '', 'g')) * 2 >= length(w) END"
)
def acronym_v3_small(spark, d):
    return A.exploded(_docs(spark, d), "doc_id", A.v3(F.col("text")))


@query(f"SELECT w AS acronym, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE regexp_full_match(w, '[A-Z]{{2,8}}s?') GROUP BY 1")
def acronym_v4(spark, d):
    e = A.exploded(_docs(spark, d), "doc_id", A.upper_tokens(F.col("text"), 2))
    return e.groupBy("acronym").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"SELECT DISTINCT doc_id, regexp_replace(upper(w), 'S$', '') AS acronym FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE regexp_full_match(w, '[A-Z]{{3,8}}s?')")
def acronym_singular(spark, d):
    return A.exploded(_docs(spark, d), "doc_id", A.singular(A.v2(F.col("text"))))


@query(
    "SELECT DISTINCT doc_id, t AS acronym FROM (SELECT doc_id, regexp_replace(regexp_replace(t, '[.,;:()\\[\\]\"''¿?¡!]', '', 'g'), 'Ch|Ll', 'C', 'g') AS t "
    "FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n\\t]+')) AS t FROM documents)) WHERE length(t) > 1 AND NOT regexp_matches(t, '[ÁÉÍÓÚÑ]') "
    "AND length(regexp_replace(t, '[^A-Z]', '', 'g')) >= 0.6 * length(t)"
)
def acronym_spanish(spark, d):
    return A.exploded(_docs(spark, d), "doc_id", A.spanish(F.col("text")))


_CLOSED = ", ".join(f"'{w}'" for w in A.CLOSED_CLASS)


@query(
    f"SELECT DISTINCT doc_id, w AS acronym FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE w = upper(w) AND w <> lower(w) AND length(w) >= 2 "
    f"AND length(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')) <= 10 AND regexp_matches(w, '\\p{{L}}') AND lower(w) NOT IN ({_CLOSED})"
)
def acronym_upper_tokens(spark, d):
    return A.exploded(_docs(spark, d), "doc_id", A.capital_tokens(F.col("text")))


_ROMAN = ", ".join(f"'{r}'" for r in X.ROMAN)


@query(
    f"SELECT DISTINCT doc_id, w AS acronym FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE length(w) BETWEEN 2 AND 10 "
    f"AND length(regexp_replace(w, '[^\\p{{Lu}}]', '', 'g')) > 0.6 * length(w) AND w NOT IN ({_ROMAN})"
)
def acronym_short_forms(spark, d):
    return A.exploded(_docs(spark, d), "doc_id", A.short_forms(F.col("text")))


@query(
    f"SELECT DISTINCT doc_id, w AS acronym FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE NOT regexp_full_match(w, '\\p{{N}}+') "
    f"AND w NOT IN ({_ROMAN}) AND length(w) > 1 AND regexp_full_match(w, '[\\p{{Lu}}\\p{{N}}]+')"
)
def acronym_french(spark, d):
    return A.exploded(_docs(spark, d), "doc_id", A.french_candidates(F.col("text")))


@query(
    f"SELECT DISTINCT doc_id, t AS acronym FROM (SELECT doc_id, regexp_replace(t, '^[^\\p{{L}}\\p{{N}}(]+|[^\\p{{L}}\\p{{N}})]+$', '', 'g') AS t FROM "
    f"(SELECT doc_id, unnest(regexp_split_to_array(text, '[\\s{A.DASHES}]+')) AS t FROM documents)) WHERE length(t) >= 2 AND regexp_matches(t, '^[\\p{{L}}\\p{{N}}(]') "
    "AND regexp_matches(t, '\\p{L}') AND NOT regexp_full_match(t, '(?s).[\\p{Ll}\\p{M}]+')"
)
def acronym_candidates(spark, d):
    return A.exploded(_docs(spark, d), "doc_id", A.candidate_tokens(F.col("text")))


@query()
def acronym_embedded(spark, d):
    """Labels and values of the scraped definitions joined by a hyphen, as they stand in headings."""
    t = table(spark, d, "scraped_definitions").select("def_id", F.concat_ws("-", "acronym", F.upper("acronym_expansion")).alias("text"))
    return A.exploded(t, "def_id", A.embedded(F.col("text")))


# ---- text functions


@query(
    "SELECT acronym, expansion, regexp_replace(trim(regexp_replace(expansion, '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' +', '_', 'g') AS token, "
    "regexp_replace(acronym, 's$', '') AS singular FROM (SELECT DISTINCT acronym, expansion FROM acronym_pairs)"
)
def expansion_tokens(spark, d):
    p = table(spark, d, "acronym_pairs").select("acronym", "expansion").distinct()
    return p.select("acronym", "expansion", X.expansion_token(F.col("expansion")).alias("token"), X.singular_acronym(F.col("acronym")).alias("singular"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_CONTENT = (
    f"content AS (SELECT doc_id, lower(w) AS term FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) "
    f"WHERE NOT regexp_full_match(lower(w), '\\p{{N}}+') AND lower(w) NOT IN ({_STOP}))"
)


@query(f"WITH {_CONTENT} SELECT doc_id, count(*) AS words, count(DISTINCT term) AS distinct_words FROM content GROUP BY 1")
def word_tokens(spark, d):
    w = X.content_words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct_words")).where("words > 0").withColumns({"words": F.col("words").cast("long"), "distinct_words": F.col("distinct_words").cast("long")})


@query()
def stemmed_words(spark, d):
    from glossa.functions.inflect import stems

    w = _docs(spark, d).select(F.explode(stems(X.content_words(F.col("text")))).alias("stem"))
    return w.groupBy("stem").agg(F.count("*").alias("n"))


@query(
    "WITH w AS (SELECT sample_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM sci_dr), "
    "g AS (SELECT sample_id, t, unnest(range(1, len(t))) AS i FROM w) SELECT t[i] || ' ' || t[i + 1] AS gram, count(*) AS n FROM g GROUP BY 1"
)
def ngram_counts(spark, d):
    t = table(spark, d, "sci_dr").select(F.explode(X.word_ngrams(X.words(F.col("text")), 2)).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n"))


@query(
    f"WITH {_PAIRS}, e AS (SELECT DISTINCT acronym, expansion FROM pairs) SELECT a.acronym, a.expansion AS a, b.expansion AS b FROM e a JOIN e b "
    f"ON a.acronym = b.acronym AND a.expansion < b.expansion WHERE {_fuzzy('a.expansion', 'b.expansion')}"
)
def fuzzy_equal_pairs(spark, d):
    return L.similar_pairs(_pairs(spark, d))


@query(f"WITH {_PAIRS}, o AS (SELECT acronym, list_sort(array_agg(DISTINCT expansion)) AS c FROM pairs GROUP BY 1) SELECT acronym, {_prefix('c[1]')} <> {_prefix('c[len(c)]')} AS differ FROM o")
def distinct_choice_test(spark, d):
    return D.distinct_options(_pairs(spark, d)).select("acronym", X.distinct_choices(F.col("options")).alias("differ"))


@query(
    f"WITH {_PAIRS}, e AS (SELECT DISTINCT acronym, expansion, list_distinct(string_split(expansion, ' ')) AS w FROM pairs), "
    "j AS (SELECT a.acronym, a.expansion, b.expansion AS other, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS s FROM e a JOIN e b ON a.acronym = b.acronym AND a.expansion <> b.expansion) "
    "SELECT acronym, expansion, (array_agg(other ORDER BY s DESC, other))[1] AS nearest, round(max(s), 6) AS similarity FROM j GROUP BY 1, 2"
)
def nearest_by_jaccard(spark, d):
    e = _pairs(spark, d).select("acronym", "expansion").distinct().withColumn("w", F.array_distinct(F.split("expansion", " ")))
    o = e.select("acronym", F.col("expansion").alias("other"), F.col("w").alias("v"))
    j = e.join(o, "acronym").where("expansion <> other").withColumn("s", X.jaccard(F.col("w"), F.col("v")))
    return j.groupBy("acronym", "expansion").agg(F.min_by("other", F.struct(-F.col("s"), "other")).alias("nearest"), F.round(F.max("s"), 6).alias("similarity"))


@query(
    f"WITH e AS (SELECT DISTINCT {_exp('expansion')} AS expansion FROM acronym_pairs WHERE expansion IS NOT NULL) "
    "SELECT expansion, array_to_string(list_transform(string_split(expansion, ' '), lambda w: regexp_replace(w, 's$', '')), ' ') AS form FROM e"
)
def french_forms(spark, d):
    e = table(spark, d, "acronym_pairs").where("expansion is not null").select(X.expansion_key(F.col("expansion")).alias("expansion")).distinct()
    return e.select("expansion", X.french_form(F.col("expansion")).alias("form"))


@query(
    "SELECT sample_id, substr(text, greatest(p - 40, 1), least(p - 1, 40) + length(acronym_) + 40) AS around FROM "
    "(SELECT *, instr(lower(text), lower(acronym_)) AS p FROM sci_dr WHERE text IS NOT NULL AND acronym_ IS NOT NULL) WHERE p > 0"
)
def acronym_context(spark, d):
    t = table(spark, d, "sci_dr").select("sample_id", X.context(F.col("text"), F.col("acronym_"), 40).alias("around"))
    return t.where("around is not null")


@query()
def substituted_text(spark, d):
    t = table(spark, d, "sci_dr").where("acronym_ is not null and expansion is not null")
    s = X.substitute_pairs(F.col("text"), F.array(F.struct(F.col("acronym_").alias("acronym"), "expansion")))
    back, n = X.restore_acronym(s, F.col("expansion"), F.col("acronym_"))
    return t.select("sample_id", s.alias("substituted"), back.alias("restored"), n.alias("tokens"))


@query()
def plain_documents(spark, d):
    from glossa.operators.pages import parsed

    p = parsed(table(spark, d, "documents"), "doc_id", "text")
    return p.select("doc_id", F.length("text").cast("long").alias("chars"), F.size("links").alias("links"))


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def _decoded(c: str) -> str:
    for entity, char in _ENTITIES:
        c = f"replace({c}, '{entity}', '{char}')"
    return c


@query(f"SELECT doc_id, trim(regexp_replace({_decoded("regexp_replace(text, '<[^>]*>', ' ', 'g')")}, '[ \\t\\n\\r]+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL")
def untagged_documents(spark, d):
    plain = F.regexp_replace("text", "<[^>]*>", " ")
    for entity, char in _ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.trim(F.regexp_replace(plain, r"[ \t\n\r]+", " ")).alias("plain"))


# ---- dictionary


@query(f"WITH {_PAIRS}, {_MF.format(src='pairs')} SELECT * FROM mf")
def most_frequent(spark, d):
    return D.most_frequent(_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT acronym, list_sort(array_agg(DISTINCT expansion)) AS options, round(1.0 / count(DISTINCT expansion), 6) AS share FROM pairs GROUP BY 1")
def distinct_options(spark, d):
    return D.distinct_options(_pairs(spark, d))


@query()
def random_seeded(spark, d):
    train, test = _train_test(spark, d)
    return D.seeded_choice(test.select("article_id", "acronym").distinct(), train)


@query(f"WITH {_PAIRS} SELECT acronym, count(*) AS entries, min(expansion || '|' || coalesce(article_id, '')) AS first_entry FROM (SELECT DISTINCT acronym, expansion, article_id FROM pairs) GROUP BY 1")
def acronym_db_nested(spark, d):
    n = D.nested(_pairs(spark, d))
    return n.select("acronym", F.size("entries").cast("long").alias("entries"), F.array_min(F.transform("entries", lambda e: F.concat_ws("|", e["expansion"], F.coalesce(e["article_id"], F.lit(""))))).alias("first_entry"))


@query(
    f"WITH {_PAIRS}, o AS (SELECT article_id, acronym, min(expansion) AS expansion FROM pairs WHERE article_id IS NOT NULL GROUP BY 1, 2) "
    "SELECT article_id, count(*) AS n, string_agg(acronym || '=' || expansion, ';' ORDER BY acronym) AS pairs FROM o GROUP BY 1"
)
def article_acronym_map(spark, d):
    m = D.article_map(_pairs(spark, d))
    e = F.array_sort(F.map_entries("pairs"))
    return m.select("article_id", F.size("pairs").cast("long").alias("n"), F.array_join(F.transform(e, lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("pairs"))


@query(
    f"WITH {_PAIRS}, k AS (SELECT DISTINCT acronym, expansion, {_prefix('expansion')} AS key FROM pairs), "
    "c AS (SELECT *, CASE WHEN key <> lag(key) OVER (PARTITION BY acronym ORDER BY expansion) THEN 1 ELSE 0 END AS change FROM k), "
    "g AS (SELECT *, CAST(sum(change) OVER (PARTITION BY acronym ORDER BY expansion ROWS UNBOUNDED PRECEDING) AS BIGINT) AS def_idx FROM c) "
    "SELECT acronym, expansion, def_idx, first_value(expansion) OVER (PARTITION BY acronym, def_idx ORDER BY expansion) AS canonical FROM g"
)
def definition_index(spark, d):
    return D.definition_index(_pairs(spark, d))


@query(
    f"WITH p AS (SELECT trim(acronym) AS acronym, {_exp('expansion')} AS expansion FROM acronym_pairs WHERE acronym IS NOT NULL AND expansion IS NOT NULL), k AS (SELECT DISTINCT acronym FROM p) "
    "SELECT coalesce(k.acronym, p.acronym) AS acronym, count(*) AS n, count(DISTINCT p.expansion) AS expansions FROM p LEFT JOIN k ON k.acronym = regexp_replace(p.acronym, 's$', '') GROUP BY 1"
)
def plural_key_union(spark, d):
    p = table(spark, d, "acronym_pairs").where("acronym is not null and expansion is not null").select(F.trim("acronym").alias("acronym"), X.expansion_key(F.col("expansion")).alias("expansion"))
    return D.plural_keys_joined(p).groupBy("acronym").agg(F.count("*").alias("n"), F.count_distinct("expansion").alias("expansions"))


@query(f"WITH {_SPLIT}, o AS (SELECT acronym, count(DISTINCT expansion) AS n, min(expansion) AS single FROM train GROUP BY 1), t AS (SELECT DISTINCT article_id, acronym FROM test) "
       "SELECT t.article_id, t.acronym, coalesce(n, 0) AS n_options, CASE WHEN n IS NULL THEN 'skip' WHEN n = 1 THEN 'single' ELSE 'expander' END AS route, "
       "CASE WHEN n = 1 THEN single END AS expansion, CASE WHEN n = 1 THEN -5.0::DOUBLE END AS confidence FROM t LEFT JOIN o ON t.acronym = o.acronym")
def routing(spark, d):
    train, test = _train_test(spark, d)
    return D.routed(test, train)


@query(f"WITH {_SPLIT} SELECT 'train' AS part, count(*) AS n, count(DISTINCT article_id) AS articles FROM train UNION ALL SELECT 'test', count(*), count(DISTINCT article_id) FROM test")
def train_test_split(spark, d):
    train, test = _train_test(spark, d)
    one = lambda x, n: x.agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("articles")).select(F.lit(n).alias("part"), "n", "articles")
    return one(train, "train").unionByName(one(test, "test"))


@query("SELECT article_id, CAST(('0x' || substr(md5(article_id), 1, 8))::BIGINT % 5 AS INT) AS fold FROM (SELECT DISTINCT article_id FROM sci_dr WHERE article_id IS NOT NULL)")
def cv_folds(spark, d):
    return D.hashed_fold(table(spark, d, "sci_dr").where("article_id is not null"), 5)


@query(f"WITH {_ROLES} SELECT article_id FROM roles WHERE role = 'train' INTERSECT SELECT article_id FROM roles WHERE role <> 'train'")
def leakage_check(spark, d):
    s = table(spark, d, "splits").where("article_id is not null")
    return D.leakage(s.where("role = 'train'"), s.where("role <> 'train'"))


@query(f"WITH {_PAIRS}, m AS (SELECT acronym FROM pairs GROUP BY 1 HAVING count(DISTINCT expansion) > 1) SELECT acronym, expansion, count(*) AS n FROM pairs SEMI JOIN m USING (acronym) GROUP BY 1, 2")
def ambiguous_pairs(spark, d):
    return D.ambiguous(_pairs(spark, d)).groupBy("acronym", "expansion").agg(F.count("*").alias("n"))


@query("SELECT coalesce(in_text, false) AS in_text, count(*) AS n, count(CASE WHEN in_text THEN expansion END) AS visible FROM acronym_pairs GROUP BY 1")
def visible_expansions(spark, d):
    p = D.visible_expansion(table(spark, d, "acronym_pairs"))
    return p.groupBy(F.coalesce("in_text", F.lit(False)).alias("in_text")).agg(F.count("*").alias("n"), F.count("expansion").alias("visible"))


@query(
    f"WITH {_PAIRS}, u AS (SELECT '0_' || article_id AS article_id, acronym FROM pairs UNION ALL SELECT '1_' || article_id, {_ACR} FROM scraped_definitions) "
    "SELECT substr(article_id, 1, 1) AS dataset, count(*) AS n, count(DISTINCT article_id) AS articles, count(DISTINCT acronym) AS acronyms FROM u WHERE article_id IS NOT NULL GROUP BY 1"
)
def dataset_union_prefixed(spark, d):
    s = table(spark, d, "scraped_definitions").select(X.acronym_key(F.col("acronym")).alias("acronym"), "article_id")
    u = D.prefixed_union([_pairs(spark, d).select("acronym", "article_id"), s]).where("article_id is not null")
    return u.groupBy(F.left("article_id", F.lit(1)).alias("dataset")).agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("articles"), F.count_distinct("acronym").alias("acronyms"))


@query(
    f"WITH {_PAIRS}, a AS (SELECT acronym, min(expansion) AS expansion FROM pairs GROUP BY 1), b AS (SELECT {_ACR} AS acronym, min({_exp('expansion')}) AS expansion FROM expansion_reference GROUP BY 1) "
    "SELECT coalesce(b.acronym, a.acronym) AS acronym, coalesce(b.expansion, a.expansion) AS expansion FROM a FULL JOIN b ON a.acronym = b.acronym"
)
def union_last_wins(spark, d):
    least = lambda x: x.groupBy("acronym").agg(F.min("expansion").alias("expansion"))
    return D.last_wins([least(_pairs(spark, d)), least(D.normalised(table(spark, d, "expansion_reference").withColumn("article_id", F.lit(None).cast("string"))))], "acronym")


@query(
    f"WITH {_PAIRS}, r AS (SELECT DISTINCT {_ACR} AS acronym, {_exp('expansion')} AS expansion FROM expansion_reference), "
    f"s AS (SELECT DISTINCT {_ACR} AS acronym, {_exp('acronym_expansion')} AS expansion FROM scraped_definitions WHERE acronym_expansion IS NOT NULL), e AS (SELECT DISTINCT acronym, expansion FROM pairs) "
    "SELECT e.acronym, e.expansion, CASE WHEN r.expansion IS NOT NULL THEN 'first' WHEN s.expansion IS NOT NULL THEN 'second' ELSE 'neither' END AS evidence "
    "FROM e LEFT JOIN r ON e.acronym = r.acronym AND e.expansion = r.expansion LEFT JOIN s ON e.acronym = s.acronym AND e.expansion = s.expansion"
)
def external_evidence(spark, d):
    none = F.lit(None).cast("string")
    r = D.normalised(table(spark, d, "expansion_reference").withColumn("article_id", none))
    s = D.normalised(table(spark, d, "scraped_definitions").withColumn("expansion", F.col("acronym_expansion")))
    return D.external_evidence(_pairs(spark, d), r, s)


@query(
    f"WITH {_PAIRS}, {_MF.format(src='pairs')}, per AS (SELECT acronym, count(*) AS n FROM counts GROUP BY 1), "
    "k AS (SELECT article_id, count(DISTINCT (acronym, expansion)) AS k FROM pairs WHERE article_id IS NOT NULL GROUP BY 1) "
    "SELECT (SELECT count(DISTINCT article_id) FROM sci_dr) AS articles, count(*) AS acronyms, CAST(sum(n) AS BIGINT) AS expansions, count(CASE WHEN n > 1 THEN 1 END) AS ambiguous, "
    "round(avg(CASE WHEN n > 1 THEN n END), 6) AS expansions_per_ambiguous, (SELECT round(avg(k), 6) FROM k) AS expansions_per_article FROM per"
)
def corpus_statistics(spark, d):
    return D.corpus_statistics(table(spark, d, "sci_dr"), _pairs(spark, d))


@query("SELECT lang, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '[.!?]+(\\s|$)'))) AS BIGINT) AS ends FROM sci_dr WHERE text IS NOT NULL GROUP BY 1")
def corpus_sentence_stats(spark, d):
    t = table(spark, d, "sci_dr").where("text is not null")
    return t.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.length("text").cast("long")).alias("chars"), F.sum(F.regexp_count("text", F.lit(r"[.!?]+(\s|$)")).cast("long")).alias("ends"))


# ---- linkage

_EDGES = f"{_PAIRS}, e AS (SELECT DISTINCT acronym, expansion FROM pairs), sim AS (SELECT a.acronym, a.expansion AS a, b.expansion AS b FROM e a JOIN e b ON a.acronym = b.acronym AND a.expansion <> b.expansion WHERE {_fuzzy('a.expansion', 'b.expansion')} UNION SELECT DISTINCT a.acronym, a.expansion, b.expansion FROM pairs a JOIN pairs b ON a.acronym = b.acronym AND a.article_id = b.article_id AND a.expansion <> b.expansion)"
_COMPONENTS = (
    f"WITH RECURSIVE {_EDGES}, reach(acronym, expansion, root) AS (SELECT acronym, expansion, expansion FROM e UNION SELECT s.acronym, s.b, r.root FROM reach r JOIN sim s ON s.acronym = r.acronym AND s.a = r.expansion), "
    "comp AS (SELECT acronym, expansion, min(root) AS component FROM reach GROUP BY 1, 2), n AS (SELECT acronym, expansion, count(*) AS n FROM pairs GROUP BY 1, 2), "
    "canon AS (SELECT c.acronym, c.component, (array_agg(c.expansion ORDER BY n DESC, length(c.expansion) DESC, c.expansion))[1] AS canonical FROM comp c JOIN n ON c.acronym = n.acronym AND c.expansion = n.expansion GROUP BY 1, 2), "
    "linked AS (SELECT c.acronym, c.expansion, k.canonical, c.component FROM comp c JOIN canon k ON c.acronym = k.acronym AND c.component = k.component) "
)


@query(_COMPONENTS + "SELECT * FROM linked")
def linkage_canonical(spark, d):
    return L.linked(_pairs(spark, d))


@query(_COMPONENTS + "SELECT DISTINCT p.article_id, p.acronym, p.expansion AS old, l.canonical AS new FROM pairs p JOIN linked l ON p.acronym = l.acronym AND p.expansion = l.expansion WHERE p.expansion <> l.canonical")
def linkage_changes(spark, d):
    p = _pairs(spark, d)
    return L.changes(p, L.linked(p))


@query(
    f"WITH {_PAIRS}, r AS (SELECT DISTINCT {_ACR} AS acronym, {_exp('expansion')} AS entry FROM expansion_reference), e AS (SELECT DISTINCT acronym, expansion FROM pairs), "
    "j AS (SELECT e.acronym, e.expansion, (array_agg(entry ORDER BY levenshtein(expansion, entry), entry))[1] AS entry FROM e JOIN r ON e.acronym = r.acronym WHERE levenshtein(expansion, entry) <= 2 GROUP BY 1, 2) "
    "SELECT p.acronym, j.entry AS expansion, count(*) AS n FROM pairs p JOIN j ON p.acronym = j.acronym AND p.expansion = j.expansion GROUP BY 1, 2"
)
def linkage_guided(spark, d):
    r = D.normalised(table(spark, d, "expansion_reference").withColumn("article_id", F.lit(None).cast("string")))
    return L.guided(_pairs(spark, d), r).groupBy("acronym", "expansion").agg(F.count("*").alias("n"))


@query(
    f"WITH {_PAIRS}, m AS (SELECT acronym, article_id, min(expansion) AS a FROM pairs GROUP BY 1, 2) SELECT DISTINCT p.acronym, m.a, p.expansion AS b FROM pairs p JOIN m ON p.acronym = m.acronym AND p.article_id = m.article_id WHERE p.expansion <> m.a"
)
def same_article_links(spark, d):
    return L.same_article_links(_pairs(spark, d))


# ---- vectors and expanders


@query(f"WITH {_CONTENT}, tf AS (SELECT doc_id, term, count(*) AS tf FROM content GROUP BY 1, 2) SELECT doc_id, term, round(tf / (SELECT max(tf) FROM tf), 8) AS weight FROM tf")
def bow_counts(spark, d):
    return V.bag_of_words(_docs(spark, d), "doc_id", X.content_words(F.col("text")))


@query(
    f"WITH {_CONTENT}, tf AS (SELECT doc_id, term, count(*) AS tf FROM content GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), "
    "w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"
)
def tfidf(spark, d):
    return V.tfidf(_docs(spark, d), "doc_id", X.content_words(F.col("text")))


@query(
    "WITH w AS (SELECT sample_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM sci_dr), g AS (SELECT sample_id, unnest(t) AS term, 0.2 AS w FROM w UNION ALL "
    "SELECT sample_id, t[i] || ' ' || t[i + 1], 0.3 FROM (SELECT sample_id, t, unnest(range(1, len(t))) AS i FROM w)) SELECT sample_id, term, round(sum(w)::DOUBLE, 6) AS weight FROM g GROUP BY 1, 2"
)
def weighted_ngrams(spark, d):
    return V.weighted_ngrams(table(spark, d, "sci_dr"), "sample_id", X.words(F.col("text")), {1: 0.2, 2: 0.3})


@query()
def locality_weights(spark, d):
    t = table(spark, d, "sci_dr").where("acronym_ is not null and text is not null").select("sample_id", "text", F.col("acronym_").alias("concept"))
    return V.locality(t, "sample_id", "text", "concept")


@query(
    "WITH w AS (SELECT sample_id, acronym_ AS a, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM sci_dr), "
    "p AS (SELECT sample_id, a, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM w), c AS (SELECT sample_id, i FROM p WHERE term = a) "
    "SELECT p.sample_id, p.term, count(DISTINCT p.i) AS n FROM p JOIN c ON p.sample_id = c.sample_id AND abs(p.i - c.i) <= 5 WHERE p.term <> a GROUP BY 1, 2"
)
def window_terms(spark, d):
    return V.window_terms(table(spark, d, "sci_dr"), "sample_id", X.words(F.col("text")), "acronym_", 5)


_SCI_TF = (
    "sci AS (SELECT sample_id, article_id, {acr} AS acronym, {exp} AS expansion, text FROM sci_dr WHERE acronym_ IS NOT NULL AND article_id IS NOT NULL AND text IS NOT NULL), "
    "tok AS (SELECT sample_id, lower(w) AS term FROM (SELECT sample_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM sci) WHERE NOT regexp_full_match(lower(w), '\\p{{N}}+') AND lower(w) NOT IN ({stop})), "
    "tf AS (SELECT sample_id, term, count(*)::DOUBLE AS weight FROM tok GROUP BY 1, 2)"
).format(acr=_ACR.replace("acronym", "acronym_"), exp=_exp("expansion"), stop=_STOP)


def _sci(spark, d):
    t = table(spark, d, "sci_dr").where("acronym_ is not null and article_id is not null and text is not null")
    t = t.select("sample_id", "article_id", X.acronym_key(F.col("acronym_")).alias("acronym"), X.expansion_key(F.col("expansion")).alias("expansion"), "text")
    tf = V.term_counts(t, "sample_id", X.content_words(F.col("text"))).select("sample_id", "term", F.col("tf").cast("double").alias("weight"))
    return t.drop("text"), tf


@query(f"WITH {_SCI_TF} SELECT acronym, expansion, term, sum(weight) AS weight FROM sci JOIN tf USING (sample_id) WHERE expansion IS NOT NULL GROUP BY 1, 2, 3")
def text_to_term(spark, d):
    t, tf = _sci(spark, d)
    return V.expansion_vectors(tf, t.where("expansion is not null"), "sample_id")


_COS_SQL = (
    f"WITH {_SCI_TF}, {_ROLES}, tr AS (SELECT s.* FROM sci s SEMI JOIN (SELECT * FROM roles WHERE role = 'train') r USING (article_id) WHERE expansion IS NOT NULL), "
    "te AS (SELECT s.* FROM sci s SEMI JOIN (SELECT * FROM roles WHERE role = 'test') r USING (article_id)), "
)


def _sci_sides(spark, d):
    t, tf = _sci(spark, d)
    v = t.join(tf, "sample_id")
    train = D.in_articles(v.where("expansion is not null"), _roles(spark, d, "train"))
    return D.in_articles(v, _roles(spark, d, "test")), train


@query(
    _COS_SQL + "ov AS (SELECT acronym, expansion, term, sum(weight) AS v FROM tr JOIN tf USING (sample_id) GROUP BY 1, 2, 3), onn AS (SELECT acronym, expansion, sqrt(sum(v * v)) AS n FROM ov GROUP BY 1, 2), "
    "tv AS (SELECT sample_id, acronym, term, weight AS w FROM te JOIN tf USING (sample_id)), tn AS (SELECT sample_id, sqrt(sum(w * w)) AS n FROM tv GROUP BY 1), "
    "s AS (SELECT sample_id, tv.acronym, expansion, sum(w * v) AS dot FROM tv JOIN ov ON tv.acronym = ov.acronym AND tv.term = ov.term GROUP BY 1, 2, 3), "
    "c AS (SELECT s.sample_id, s.acronym, s.expansion, round(dot / (tn.n * onn.n), 6) AS c FROM s JOIN tn ON s.sample_id = tn.sample_id JOIN onn ON s.acronym = onn.acronym AND s.expansion = onn.expansion) "
    "SELECT sample_id, acronym, (array_agg(expansion ORDER BY c DESC, expansion))[1] AS expansion, max(c) AS confidence FROM c GROUP BY 1, 2"
)
def cossim_term(spark, d):
    test, train = _sci_sides(spark, d)
    options = train.groupBy("acronym", "expansion", "term").agg(F.sum("weight").alias("weight"))
    c = E.cosine_long(test.select("sample_id", "acronym", "term", "weight"), options, ["sample_id"], ["expansion"])
    return E.top_option(c, ["sample_id", "acronym"], "expansion")


@query(
    _COS_SQL + "ov AS (SELECT sample_id AS train_id, acronym, expansion, term, weight AS v FROM tr JOIN tf USING (sample_id)), onn AS (SELECT train_id, sqrt(sum(v * v)) AS n FROM ov GROUP BY 1), "
    "tv AS (SELECT sample_id, acronym, term, weight AS w FROM te JOIN tf USING (sample_id)), tn AS (SELECT sample_id, sqrt(sum(w * w)) AS n FROM tv GROUP BY 1), "
    "s AS (SELECT sample_id, tv.acronym, train_id, expansion, sum(w * v) AS dot FROM tv JOIN ov ON tv.acronym = ov.acronym AND tv.term = ov.term GROUP BY 1, 2, 3, 4), "
    "c AS (SELECT s.sample_id, s.acronym, s.expansion, round(dot / (tn.n * onn.n), 6) AS c FROM s JOIN tn ON s.sample_id = tn.sample_id JOIN onn ON s.train_id = onn.train_id), "
    "m AS (SELECT sample_id, acronym, expansion, max(c) AS c FROM c GROUP BY 1, 2, 3) "
    "SELECT sample_id, acronym, (array_agg(expansion ORDER BY c DESC, expansion))[1] AS expansion, max(c) AS confidence FROM m GROUP BY 1, 2"
)
def cossim_text(spark, d):
    """Samples as lists of words, never as pairs of samples; the rows of a repeated id count together, as in the SQL."""
    t = table(spark, d, "sci_dr").where("acronym_ is not null and article_id is not null and text is not null and sample_id is not null")
    t = t.select("sample_id", "article_id", X.acronym_key(F.col("acronym_")).alias("acronym"), X.expansion_key(F.col("expansion")).alias("expansion"), X.content_words(F.col("text")).alias("words"))
    again = t.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select("sample_id")
    repeats = cut(again)
    _, again = sized_broadcast(repeats, 200_000)
    once, more = t.join(again, "sample_id", "left_anti"), None
    if repeats.limit(1).count():
        more = t.join(again, "sample_id", "left_semi")
        more = more.drop("words").join(more.groupBy("sample_id").agg(F.flatten(F.collect_list("words")).alias("words")), "sample_id")

    def side(role: str, ids: list[str], where: str):
        rows = V.with_norm(D.in_articles(once.where(where), _roles(spark, d, role)))
        if more is None:
            return rows
        m = D.in_articles(more.where(where), _roles(spark, d, role))
        m = V.with_norm(m).join(m.groupBy("sample_id").agg(F.count("*").alias("all")), "sample_id")
        m = m.groupBy(*ids).agg(F.count("*").alias("n"), F.first("words").alias("words"), F.first(F.sqrt(F.round(F.col("norm") * F.col("norm")) * F.col("all"))).alias("norm"))
        m = m.withColumn("words", F.flatten(F.expr("array_repeat(words, cast(n as int))"))).select(*ids, "words", "norm")
        return rows.select(*ids, "words", "norm").unionByName(m)

    test = side("test", ["sample_id", "acronym"], "true")
    return E.nearest_text(test, side("train", ["sample_id", "acronym", "expansion"], "expansion is not null"), "sample_id")


_EMB = (
    "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), te AS (SELECT * FROM v WHERE vec_id % 50 = 0), tr AS (SELECT * FROM v WHERE vec_id % 50 <> 0), "
    "c AS (SELECT te.vec_id, tr.label, round(greatest(list_cosine_similarity(te.e, tr.e), 0), 6) AS c FROM te, tr), m AS (SELECT vec_id, label, max(c) AS c FROM c GROUP BY 1, 2)"
)


def _emb(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    return e.where("vec_id % 50 = 0"), e.where("vec_id % 50 <> 0")


@query(f"WITH {_EMB} SELECT vec_id, (array_agg(label ORDER BY c DESC, label))[1] AS label, max(c) AS confidence FROM m GROUP BY 1")
def cossim_embeddings(spark, d):
    test, train = _emb(spark, d)
    return _query_neighbours(test, train)


def _query_neighbours(test, train):
    """The stated query set (every 50th vector) against all others: the queries are one broadcast block, the collection is scanned once."""
    from glossa.runtime import sized_broadcast

    _, q = sized_broadcast(test.select("vec_id", F.col("vec").alias("a")), 20_000)
    j = train.select("label", F.col("vec").alias("b")).crossJoin(q)  # queries in a block, not all pairs of a group
    c = j.select("vec_id", "label", F.greatest(E.cosine(F.col("a"), F.col("b")), F.lit(0.0)).alias("c"))
    best = c.groupBy("vec_id", "label").agg(F.round(F.max("c"), 6).alias("confidence"))
    return E.top_option(best, ["vec_id"])


@query(
    f"WITH {_EVAL.replace('evaluated AS', 'ev0 AS')}, p AS (SELECT g.article_id, g.acronym, 'frequency' AS expander, c.expansion AS label, c.n / sum(c.n) OVER (PARTITION BY g.article_id, g.acronym) AS confidence FROM gold g JOIN counts c USING (acronym) "
    "UNION ALL SELECT g.article_id, g.acronym, 'shortest', c.expansion, 1.0 / length(c.expansion) FROM gold g JOIN counts c USING (acronym)), "
    "t AS (SELECT article_id, acronym, expander, label, confidence / sum(confidence) OVER (PARTITION BY article_id, acronym, expander) AS s FROM p) "
    "SELECT article_id, acronym, label, round(sum(s), 6) AS score FROM t GROUP BY 1, 2, 3"
)
def soft_vote(spark, d):
    return E.soft_vote(_votes(spark, d), ["article_id", "acronym"])


@query(
    f"WITH {_EVAL.replace('evaluated AS', 'ev0 AS')}, p AS (SELECT g.article_id, g.acronym, 'frequency' AS expander, c.expansion AS label, c.n / sum(c.n) OVER (PARTITION BY g.article_id, g.acronym) AS confidence FROM gold g JOIN counts c USING (acronym) "
    "UNION ALL SELECT g.article_id, g.acronym, 'shortest', c.expansion, 1.0 / length(c.expansion) FROM gold g JOIN counts c USING (acronym)), "
    "b AS (SELECT article_id, acronym, expander, (array_agg(label ORDER BY confidence DESC, label))[1] AS label FROM p GROUP BY 1, 2, 3) SELECT article_id, acronym, label, count(*) AS votes FROM b GROUP BY 1, 2, 3"
)
def hard_vote(spark, d):
    return E.hard_vote(_votes(spark, d), ["article_id", "acronym"])


def _votes(spark, d):
    return _votes_of(*_train_test(spark, d))


def _votes_of(train, test):
    counts = train.groupBy("acronym", "expansion").agg(F.count("*").alias("n"))
    total = counts.groupBy("acronym").agg(F.sum("n").alias("t"))
    o = test.select("article_id", "acronym").distinct().join(counts, "acronym").join(total, "acronym")
    one = lambda name, c: o.select("article_id", "acronym", F.lit(name).alias("expander"), F.col("expansion").alias("label"), c.alias("confidence"))
    return one("frequency", F.col("n") / F.col("t")).unionByName(one("shortest", 1.0 / F.length("expansion")))


def _vote_truth(spark, d):
    _, test = _train_test(spark, d)
    return test.groupBy("article_id", "acronym").agg(F.min("expansion").alias("label"))


_VOTES = (
    f"{_SPLIT}, {_GOLD}, counts AS (SELECT acronym, expansion, count(*) AS n FROM train GROUP BY 1, 2), tot AS (SELECT acronym, sum(n) AS t FROM counts GROUP BY 1), "
    "p AS (SELECT g.article_id, g.acronym, 'frequency' AS expander, c.expansion AS label, c.n / t.t AS confidence FROM gold g JOIN counts c USING (acronym) JOIN tot t USING (acronym) "
    "UNION ALL SELECT g.article_id, g.acronym, 'shortest', c.expansion, 1.0 / length(c.expansion) FROM gold g JOIN counts c USING (acronym))"
)


@query(
    f"WITH {_VOTES}, b AS (SELECT article_id, acronym, expander, (array_agg(label ORDER BY confidence DESC, label))[1] AS label, max(confidence) - coalesce((array_agg(confidence ORDER BY confidence DESC, label))[2], -1e9) AS gap FROM p GROUP BY 1, 2, 3), "
    "j AS (SELECT a.label AS a, a.gap, b.label AS b, g.actual FROM (SELECT * FROM b WHERE expander = 'frequency') a JOIN (SELECT * FROM b WHERE expander = 'shortest') b USING (article_id, acronym) JOIN gold g USING (article_id, acronym)) "
    "SELECT x.gap::DOUBLE AS gap, CAST(sum((j.gap >= x.gap)::INT) AS BIGINT) AS used_a, CAST(sum((CASE WHEN j.gap >= x.gap THEN a ELSE b END = actual)::INT) AS BIGINT) AS \"right\" FROM j, (VALUES (0.0), (0.1), (0.3), (0.5), (0.9)) x(gap) GROUP BY 1"
)
def gap_sweep(spark, d):
    v = _votes(spark, d)
    pick = lambda n: v.where(F.col("expander") == n).drop("expander")
    return E.gap_sweep(pick("frequency"), pick("shortest"), _vote_truth(spark, d), [0.0, 0.1, 0.3, 0.5, 0.9], ["article_id", "acronym"])


@query()
def trained_ensemble(spark, d):
    """Fitted on one half of the training articles, whose votes come from the other half's dictionary; applied to the test articles."""
    from pyspark.ml.functions import vector_to_array

    train, _ = _train_test(spark, d)
    train = train.where("article_id is not null").withColumn("half", F.pmod(F.xxhash64("article_id"), F.lit(2)))
    own, other = train.where("half = 0"), train.where("half = 1")
    ids = ["article_id", "acronym"]
    truth = own.groupBy(*ids).agg(F.min("expansion").alias("label"))
    model, names = E.trained_ensemble(_votes_of(other, own), truth, ids)
    wide = _votes(spark, d).groupBy(*ids, "label").pivot("expander", names).agg(F.max("confidence")).na.fill(0.0, names)
    p = model.transform(wide).select(*ids, "label", vector_to_array("probability")[1].alias("confidence"))
    return E.top_option(p, ids)


def _term_maps(spark, d):
    test, train = _sci_sides(spark, d)
    m = lambda x, *k: x.groupBy(F.col("sample_id").cast("string").alias("article_id"), "acronym", *k).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    return m(train, "expansion"), m(test)


def _trained(learner):
    def run(spark, d):
        from glossa.operators.learners import trained_expander

        return trained_expander(*_term_maps(spark, d), learner)

    run.__name__ = f"{learner}_expander"
    return query()(run)


for _name in ("svm", "lr", "svm_calibrated", "svm_sgd", "rf", "network"):
    _trained(_name)


@query(
    _COS_SQL.rstrip(", ") + ", v AS (SELECT sample_id, acronym, term, generate_subscripts(w, 1) - 1 AS rank, unnest(w) AS v FROM (SELECT sample_id, acronym, term, [1.0 / greatest(weight, 1)] AS w FROM te JOIN tf USING (sample_id))), "
    "o AS (SELECT expansion, acronym, term, generate_subscripts(w, 1) - 1 AS rank, unnest(w) AS w FROM (SELECT expansion, acronym, term, list_sort(array_agg(1.0 / greatest(weight, 1)), 'DESC') AS w FROM tr JOIN tf USING (sample_id) GROUP BY 1, 2, 3)) "
    "SELECT sample_id, v.acronym, expansion, round(sum(v * w)::DOUBLE, 6) AS confidence FROM v JOIN o ON v.acronym = o.acronym AND v.term = o.term AND v.rank = o.rank GROUP BY 1, 2, 3"
)
def locality_similarity(spark, d):
    test, train = _sci_sides(spark, d)
    damp = lambda x, i: x.select(i, "acronym", "term", (1.0 / F.greatest("weight", F.lit(1.0))).alias("weight"))
    return E.locality_similarity(damp(test, "sample_id"), damp(train, "expansion"), ["sample_id"], ["expansion"])


@query(
    _COS_SQL + "tk AS (SELECT sample_id, acronym, term FROM te JOIN tf USING (sample_id) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY weight DESC, term) <= 20), "
    "ok AS (SELECT sample_id, acronym, expansion, term, weight FROM tr JOIN tf USING (sample_id) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY weight DESC, term) <= 20), "
    "o AS (SELECT acronym, expansion, term, sum(weight) AS weight FROM ok GROUP BY 1, 2, 3) SELECT sample_id, tk.acronym, expansion, round(sum(weight), 6) AS confidence FROM tk JOIN o ON tk.acronym = o.acronym AND tk.term = o.term GROUP BY 1, 2, 3"
)
def keyword_overlap(spark, d):
    test, train = _sci_sides(spark, d)
    return E.keyword_overlap(test, train.withColumnRenamed("sample_id", "train_id"), ["sample_id"])


@query(
    "WITH v AS (SELECT vec_id, label, vec_id // 10 AS doc, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v WHERE doc % 50 <> 0), "
    "m AS (SELECT label, array_agg(x ORDER BY i) AS e FROM (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2) GROUP BY 1), c AS (SELECT v.doc, m.label, sum(list_cosine_similarity(v.e, m.e)) / count(*) AS c FROM v, m WHERE v.doc % 50 = 0 GROUP BY 1, 2) "
    "SELECT doc, label, round(c, 6) AS confidence FROM c"
)
def uad_vote(spark, d):
    """Every ten vectors are the chunks of a document; options are the mean vectors of the labels (at most ten)."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("doc"), "label", F.col("embedding").cast("array<double>").alias("vec"), F.lit(1).alias("k"))
    options = V.mean_vectors(e.where("doc % 50 <> 0"), "label", "vec").select("label", F.col("mean").alias("vec"), F.lit(1).alias("k"))
    return E.chunk_vote(e.where("doc % 50 = 0").select("doc", "k", "vec"), F.broadcast(options), "doc", ["k"])


@query()
def neighbour_vote(spark, d):
    from pyspark.sql import functions as f

    t, _ = _sci(spark, d)
    texts = table(spark, d, "sci_dr").where("text is not null")
    vec = V.w2v_mean(texts, "sample_id", X.content_words(f.col("text")), size=32).join(t, "sample_id")
    train = D.in_articles(vec.where("expansion is not null"), _roles(spark, d, "train"))
    test = D.in_articles(vec, _roles(spark, d, "test"))
    return E.neighbour_vote(test.select("sample_id", "acronym", "vec"), train.select("acronym", F.col("sample_id").alias("train_id"), F.col("expansion").alias("label"), "vec"), "sample_id")


@query()
def training_pairs(spark, d):
    return E.training_pairs(_train_test(spark, d)[0].where("article_id is not null"))


@query(
    f"WITH {_EVAL.replace('evaluated AS', 'ev0 AS')}, b AS (SELECT g.article_id, g.acronym, max(c.n / t.t) AS confidence_frequency, (array_agg(c.expansion ORDER BY c.n DESC, c.expansion))[1] AS expansion_frequency, "
    "max(1.0 / length(c.expansion)) AS confidence_shortest, (array_agg(c.expansion ORDER BY length(c.expansion), c.expansion))[1] AS expansion_shortest "
    "FROM gold g JOIN counts c USING (acronym) JOIN (SELECT acronym, sum(n) AS t FROM counts GROUP BY 1) t USING (acronym) GROUP BY 1, 2) SELECT * FROM b"
)
def expander_report(spark, d):
    best = E.top_option(_votes(spark, d), ["article_id", "acronym", "expander"])
    return E.report_table(best, ["article_id", "acronym"], ["frequency", "shortest"])


@query(
    f"WITH {_VOTES}, b AS (SELECT article_id, acronym, expander, (array_agg(label ORDER BY confidence DESC, label))[1] AS label, max(confidence) AS c FROM p GROUP BY 1, 2, 3), "
    "k AS (SELECT * FROM b WHERE expander <> 'frequency' OR c >= 0.9) SELECT article_id, acronym, (array_agg(label ORDER BY expander))[1] AS label, min(expander) AS expander FROM k GROUP BY 1, 2"
)
def expander_priority(spark, d):
    best = E.top_option(_votes(spark, d), ["article_id", "acronym", "expander"])
    return E.by_priority(best.where("expander <> 'frequency' or confidence >= 0.9"), ["article_id", "acronym"], ["frequency", "shortest"])


@query(f"WITH {_PAIRS} SELECT acronym, min(article_id) AS article_id FROM pairs WHERE article_id IS NOT NULL GROUP BY 1")
def first_articles(spark, d):
    return V.first_articles(_pairs(spark, d))


@query(f"SELECT doc_id FROM documents WHERE len({_WORDS}) >= 100 AND NOT contains(lower(source), 'list')")
def long_documents(spark, d):
    return V.long_enough(table(spark, d, "documents"), X.words(F.col("text")), 100, "source").select("doc_id")


@query()
def lda_expansions(spark, d):
    return V.lda_term_vectors(table(spark, d, "sci_dr").where("text is not null"), _pairs(spark, d), X.content_words(F.col("text")))


@query(f"WITH {_CONTENT}, b AS (SELECT doc_id, 'words:' || term AS term, count(*) AS n FROM content GROUP BY 1, 2), s AS (SELECT doc_id, 'ends:' || right(term, 3) AS term, count(*) AS n FROM content GROUP BY 1, 2) SELECT doc_id, term, n::DOUBLE AS weight FROM b UNION ALL SELECT doc_id, term, n::DOUBLE FROM s")
def concatenated_vectors(spark, d):
    w = X.content_words(F.col("text"))
    tf = lambda t: V.term_counts(_docs(spark, d), "doc_id", t).select("doc_id", "term", F.col("tf").cast("double").alias("weight"))
    return V.concatenated({"words": tf(w), "ends": tf(F.transform(w, lambda x: F.right(x, F.lit(3))))}, "doc_id")


@query()
def replaced_nearly(spark, d):
    from glossa.functions.inflect import replaced_nearly as near

    t = table(spark, d, "sci_dr").where("text is not null and expansion is not null")
    return t.select("sample_id", near(F.col("text"), F.col("expansion"), X.expansion_token(F.col("expansion"))).alias("text")).where("text is not null")


@query()
def lda_topics(spark, d):
    return V.lda_topics(table(spark, d, "sci_dr").where("text is not null"), "sample_id", X.content_words(F.col("text")))


@query()
def w2v_mean(spark, d):
    return V.w2v_mean(table(spark, d, "sci_dr").where("text is not null"), "sample_id", X.content_words(F.col("text")))


# ---- metrics


@query(
    f"WITH {_EVAL}, f AS (SELECT fold, avg(success::INT) AS a, avg(CASE WHEN in_db THEN success::INT END) AS b, avg(CASE WHEN n_options > 1 THEN success::INT END) AS c, avg(CASE WHEN n_options > 1 AND in_db THEN success::INT END) AS d FROM evaluated GROUP BY 1) "
    "SELECT count(*) AS folds, round(avg(a), 6) AS mean_all, round(avg(b), 6) AS mean_known, round(avg(c), 6) AS mean_ambiguous, round(avg(d), 6) AS mean_ambiguous_known, "
    "round(stddev_pop(a), 6) AS std_all, round(stddev_pop(b), 6) AS std_known, round(stddev_pop(c), 6) AS std_ambiguous, round(stddev_pop(d), 6) AS std_ambiguous_known FROM f"
)
def out_accuracy(spark, d):
    return M.fold_accuracy(_evaluated(spark, d))


_PER = (
    "g AS (SELECT acronym, actual AS expansion, count(*) AS g, sum(success::INT) AS hit FROM evaluated GROUP BY 1, 2), s AS (SELECT acronym, predicted AS expansion, count(*) AS s FROM evaluated WHERE predicted IS NOT NULL GROUP BY 1, 2), "
    "pe0 AS (SELECT g.acronym, g.expansion, round(CASE WHEN s IS NULL THEN 1.0 ELSE hit / s END, 6) AS precision, round(hit / g, 6) AS recall FROM g LEFT JOIN s ON g.acronym = s.acronym AND g.expansion = s.expansion), "
    "pe AS (SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM pe0)"
)


@query(f"WITH {_EVAL}, {_PER} SELECT * FROM pe")
def out_per_expansion(spark, d):
    return M.per_expansion(_evaluated(spark, d))


@query(
    f"WITH {_EVAL}, {_PER}, m AS (SELECT count(*) AS expansions, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS mean_f1 FROM pe) "
    "SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m"
)
def out_macro_prf(spark, d):
    return M.macro(_evaluated(spark, d))


@query(
    f"WITH {_EVAL}, c AS (SELECT count(*) AS gold, count(predicted) AS predicted, CAST(sum(success::INT) AS BIGINT) AS \"right\" FROM evaluated), r AS (SELECT *, round(\"right\" / predicted, 6) AS precision, round(\"right\" / gold, 6) AS recall FROM c) "
    "SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r"
)
def out_micro_prf(spark, d):
    return M.micro(_evaluated(spark, d))


@query(
    f"WITH {_EVAL} SELECT coalesce(module, 'total') AS module, coalesce(in_text, 'any') AS in_text, count(*) AS gold, count(predicted) AS predicted, CAST(sum(success::INT) AS BIGINT) AS \"right\" "
    "FROM (SELECT module, CAST(coalesce(in_text, false) AS VARCHAR) AS in_text, predicted, success FROM evaluated) GROUP BY GROUPING SETS ((module, in_text), (module), (in_text), ())"
)
def end_to_end_by_module(spark, d):
    return M.by_module(_evaluated(spark, d))


def _last_labels(spark, d):
    c = table(spark, d, "compare_annotations").where("doc_id is not null and annotator is not null")
    last = c.groupBy("doc_id", "annotator").agg(F.max_by("predicted_expansions", F.struct("submitted_at", "row_id")).alias("m"))
    e = last.where("m is not null").select("doc_id", "annotator", F.explode(F.map_entries("m")).alias("e"))
    e = e.select("doc_id", "annotator", X.acronym_key(F.col("e.key")).alias("acronym"), X.expansion_key(F.col("e.value")).alias("label")).where("acronym <> '' and label <> ''")
    return e.groupBy("doc_id", "acronym", "annotator").agg(F.min("label").alias("label"))


_LABELS = (
    "lastr AS (SELECT doc_id, annotator, predicted_expansions AS m FROM compare_annotations WHERE doc_id IS NOT NULL AND annotator IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, annotator ORDER BY submitted_at DESC NULLS LAST, row_id DESC) = 1), "
    f"lab0 AS (SELECT doc_id, annotator, {_ACR.replace('acronym', 'e.key')} AS acronym, {_exp('e.value')} AS label FROM (SELECT doc_id, annotator, unnest(map_entries(m)) AS e FROM lastr WHERE m IS NOT NULL)), "
    "labels AS (SELECT doc_id, acronym, annotator, min(label) AS label FROM lab0 WHERE acronym <> '' AND label <> '' GROUP BY 1, 2, 3)"
)


@query(
    f"WITH {_LABELS}, p AS (SELECT a.acronym, a.label AS x, b.label AS y FROM labels a JOIN labels b ON a.doc_id = b.doc_id AND a.acronym = b.acronym AND a.annotator < b.annotator), "
    "o AS (SELECT count(*) AS pairs, avg(CASE WHEN x = y THEN 0.0 ELSE 1.0 END) AS d FROM p), f AS (SELECT acronym, label, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), "
    "t AS (SELECT acronym, sum(n) AS t, sum(n * n) AS q FROM f GROUP BY 1), e AS (SELECT sum(t * t - q) / sum(t * (t - 1)) AS e FROM t) "
    "SELECT pairs, round(d, 6) AS observed, round(e, 6) AS expected, round(CASE WHEN e > 0 THEN 1 - d / e ELSE 1 END, 6) AS alpha FROM o, e"
)
def agreement_alpha(spark, d):
    l = _last_labels(spark, d).select(F.concat_ws("|", "doc_id", "acronym").alias("item"), F.col("acronym").alias("block"), "annotator", F.array("label").alias("labels"))
    return G.alpha(l)


_WORD_SETS = "list_sort(list_distinct(string_split(label, ' ')))"


@query(
    f"WITH {_LABELS}, w AS (SELECT doc_id || '|' || acronym AS item, annotator, {_WORD_SETS} AS s FROM labels), p AS (SELECT a.s AS x, b.s AS y FROM w a JOIN w b ON a.item = b.item AND a.annotator < b.annotator), "
    "m AS (SELECT len(list_intersect(x, y)) AS c, len(list_distinct(list_concat(x, y))) AS u, len(x) AS sx, len(y) AS sy FROM p) "
    "SELECT count(*) AS pairs, round(avg(1 - c / u), 6) AS jaccard, round(avg(1 - c / u * CASE WHEN sx = sy AND c = sx THEN 1.0 WHEN c = least(sx, sy) THEN CASE WHEN c = 0 THEN 0.0 ELSE 0.67 END WHEN c > 0 THEN 0.33 ELSE 0.0 END), 6) AS masi FROM m"
)
def agreement_set_distances(spark, d):
    l = _last_labels(spark, d).select(F.concat_ws("|", "doc_id", "acronym").alias("item"), "annotator", F.array_sort(F.array_distinct(F.split("label", " "))).alias("labels"))
    j = G.observed(l).select("pairs", F.round("disagreement", 6).alias("jaccard"))
    return j.crossJoin(G.observed(l, "masi").select(F.round("disagreement", 6).alias("masi")))  # one row each


_GOLDL = (
    f"act0 AS (SELECT doc_id, row_id, submitted_at, {_ACR.replace('acronym', 'e.key')} AS acronym, {_exp('e.value')} AS gold FROM (SELECT doc_id, row_id, submitted_at, unnest(map_entries(actual_expansions)) AS e FROM compare_annotations WHERE actual_expansions IS NOT NULL)), "
    "act AS (SELECT doc_id, acronym, min(gold) AS gold FROM act0 WHERE acronym <> '' AND gold <> '' GROUP BY 1, 2)"
)


def _reviewed(spark, d):
    c = table(spark, d, "compare_annotations").where("actual_expansions is not null").select("doc_id", F.explode(F.map_entries("actual_expansions")).alias("e"))
    c = c.select("doc_id", X.acronym_key(F.col("e.key")).alias("acronym"), X.expansion_key(F.col("e.value")).alias("gold")).where("acronym <> '' and gold <> ''")
    return c.groupBy("doc_id", "acronym").agg(F.min("gold").alias("gold"))


@query(f"WITH {_LABELS}, {_GOLDL} SELECT annotator, count(*) AS labelled, CAST(sum((label = gold)::INT) AS BIGINT) AS \"right\", round(sum((label = gold)::INT) / count(*), 6) AS accuracy FROM labels JOIN act USING (doc_id, acronym) GROUP BY 1")
def annotator_performance(spark, d):
    return G.against_reviewer(_last_labels(spark, d), _reviewed(spark, d))


@query(
    f"WITH {_LABELS}, {_GOLDL}, m AS (SELECT doc_id, acronym, (array_agg(label ORDER BY n DESC, label))[1] AS x FROM (SELECT doc_id, acronym, label, count(*) AS n FROM labels GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    "p AS (SELECT x, gold AS y FROM m JOIN act USING (doc_id, acronym)), n AS (SELECT count(*) AS n, avg((x = y)::INT) AS po FROM p), a AS (SELECT x AS l, count(*) AS a FROM p GROUP BY 1), b AS (SELECT y AS l, count(*) AS b FROM p GROUP BY 1), "
    "e AS (SELECT coalesce(sum(a * b), 0) AS ab FROM a JOIN b USING (l)) SELECT n AS items, round(po, 6) AS observed, round(ab / (n * n), 6) AS expected, round(CASE WHEN ab / (n * n) < 1 THEN (po - ab / (n * n)) / (1 - ab / (n * n)) ELSE 1 END, 6) AS kappa FROM n, e"
)
def agreement_kappa(spark, d):
    n = _last_labels(spark, d).groupBy("doc_id", "acronym", "label").agg(F.count("*").alias("n"))
    m = n.groupBy("doc_id", "acronym").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("x"))
    return G.kappa(m.join(_reviewed(spark, d).withColumnRenamed("gold", "y"), ["doc_id", "acronym"]))


@query(
    f"WITH {_LABELS}, r AS (SELECT doc_id, annotator, row_number() OVER (PARTITION BY doc_id ORDER BY annotator) AS k FROM (SELECT DISTINCT doc_id, annotator FROM labels)), "
    "s AS (SELECT doc_id, annotator, k, array_agg(acronym || '=' || label) AS x FROM labels JOIN r USING (doc_id, annotator) GROUP BY 1, 2, 3), "
    "t AS (SELECT a.doc_id AS item, a.annotator AS first, b.annotator AS second, a.x AS a, coalesce(b.x, []) AS b FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.k = 1 OR b.k IS NOT NULL) "
    "SELECT item, first, second, array_to_string(list_sort(list_filter(a, lambda v: list_contains(b, v))), ';') AS both, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), ';') AS only_a, "
    "array_to_string(list_sort(list_filter(b, lambda v: NOT list_contains(a, v))), ';') AS only_b FROM t"
)
def annotator_set_ops(spark, d):
    """Every annotator of a document against the next one by name; a document's single annotator against nobody."""
    from pyspark.sql import Window

    per = _last_labels(spark, d).groupBy("doc_id", "annotator").agg(F.collect_list(F.concat_ws("=", "acronym", "label")).alias("a"))
    w = Window.partitionBy("doc_id").orderBy("annotator")  # at most as many rows as there are annotators
    t = per.select(F.col("doc_id").alias("item"), F.col("annotator").alias("first"), F.lead("annotator").over(w).alias("second"), "a", F.lead("a").over(w).alias("b"), F.row_number().over(w).alias("k"))
    t = t.where("k = 1 or second is not null")
    sets = G.set_differences(t.withColumn("item", F.struct("item", "first", "second")))
    return sets.select("item.*", *(F.array_join(c, ";").alias(c) for c in ("both", "only_a", "only_b")))


@query(
    f"WITH {_LABELS}, {_GOLDL}, g AS (SELECT doc_id, acronym, gold FROM act), p AS (SELECT doc_id, acronym, min(label) AS predicted FROM labels SEMI JOIN (SELECT DISTINCT doc_id FROM g) x USING (doc_id) GROUP BY 1, 2), "
    "m AS (SELECT g.acronym AS ga, p.acronym AS pa, gold, predicted FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.acronym = p.acronym), "
    "c AS (SELECT count(CASE WHEN ga IS NOT NULL AND pa IS NOT NULL THEN 1 END) AS acr_right, count(pa) AS acr_out, count(ga) AS acr_gold, "
    f"count(CASE WHEN ga IS NOT NULL AND pa IS NOT NULL AND {_fuzzy('gold', 'predicted')} THEN 1 END) AS exp_right FROM m), "
    "u AS (SELECT 'acronyms' AS element, acr_right AS \"right\", acr_out AS extracted, acr_gold AS gold FROM c UNION ALL SELECT 'expansions', exp_right, acr_right, acr_gold FROM c UNION ALL SELECT 'pairs', exp_right, acr_out, acr_gold FROM c), "
    "r AS (SELECT *, round(CASE WHEN extracted > 0 THEN \"right\" / extracted ELSE 0 END, 6) AS precision, round(CASE WHEN gold > 0 THEN \"right\" / gold ELSE 0 END, 6) AS recall FROM u) "
    "SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r"
)
def in_expansion_prf(spark, d):
    g = _reviewed(spark, d).select("doc_id", "acronym", F.col("gold").alias("expansion"))
    p = _last_labels(spark, d).join(g.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "acronym").agg(F.min("label").alias("expansion"))
    return M.extraction_scores(M.matched(g, p, ["doc_id"]))


@query(
    f"WITH {_SPLIT}, g AS (SELECT DISTINCT acronym, expansion FROM test), p AS (SELECT DISTINCT acronym, expansion FROM train), c AS (SELECT (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM p) AS extracted, "
    "(SELECT count(*) FROM g JOIN p USING (acronym, expansion)) AS \"right\"), r AS (SELECT *, round(\"right\" / extracted, 6) AS precision, round(\"right\" / gold, 6) AS recall FROM c) "
    "SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r"
)
def dict_level_prf(spark, d):
    train, test = _train_test(spark, d)
    return M.dictionary_scores(test, train)


@query("SELECT fold, count(*) AS reports, CAST(sum(coalesce(skipped, false)::INT) AS BIGINT) AS skipped, round(sum(execution_times::DOUBLE), 4) AS total_time, round(avg(execution_times::DOUBLE), 4) AS mean_time FROM results_reporter_base GROUP BY 1")
def execution_times(spark, d):
    return M.execution_times(table(spark, d, "results_reporter_base"))


def _doc_scores(spark, d):
    e = _evaluated(spark, d)
    return e.groupBy(F.col("article_id").alias("doc_id")).agg(F.avg(F.col("success").cast("double")).alias("a"), F.avg((F.col("success") & (F.col("n_options") == 1)).cast("double")).alias("b"))


@query()
def paired_randomisation(spark, d):
    return M.paired_randomisation(_doc_scores(spark, d))


@query()
def bootstrap_ci(spark, d):
    return M.bootstrap_interval(_doc_scores(spark, d))


# ---- in-expansion and end to end


@query()
def schwartz_hearst(spark, d):
    from glossa.operators.inexpansion import extract

    return extract(table(spark, d, "sci_dr"), "sample_id", "text").drop("rule")


@query()
def rule_cascade(spark, d):
    from glossa.operators.inexpansion import CASCADE, best_by_priority, extract

    return best_by_priority(extract(table(spark, d, "sci_dr"), "sample_id", "text", CASCADE), "sample_id")


@query()
def switched_cascade(spark, d):
    """The cascade with every rule on."""
    from glossa.operators.inexpansion import cascaded

    return cascaded(table(spark, d, "sci_dr"), "sample_id", "text", high_recall=True, high_recall_character=True, hyphenated=True, unexpanded=True)


@query()
def french_in_expansion(spark, d):
    from glossa.operators.inexpansion import extract

    return extract(table(spark, d, "sci_dr").where("lang = 'fr'"), "sample_id", "text", ("french",)).drop("rule")


@query()
def spanish_in_expansion(spark, d):
    from glossa.operators.inexpansion import extract

    return extract(table(spark, d, "sci_dr").where("lang = 'es'"), "sample_id", "text", ("spanish",)).drop("rule")


@query(
    "WITH h AS (SELECT sample_id, unnest(regexp_extract_all(text, '((?:[A-Za-z]+ ){2,6}\\([A-Z]{2,6}\\))')) AS h FROM sci_dr), s AS (SELECT sample_id, regexp_extract(h, '\\(([A-Z]+)\\)', 1) AS acronym, string_split(trim(regexp_extract(h, '^([^(]*)', 1)), ' ') AS w FROM h), "
    "c AS (SELECT sample_id, acronym, w[len(w) - length(acronym) + 1:] AS w FROM s WHERE len(w) >= length(acronym)) "
    "SELECT DISTINCT sample_id, acronym, lower(array_to_string(w, ' ')) AS expansion FROM c WHERE upper(array_to_string(list_transform(w, lambda x: left(x, 1)), '')) = acronym"
)
def initials_in_text(spark, d):
    from glossa.operators.inexpansion import initials_before

    t = table(spark, d, "sci_dr").select("sample_id", F.explode(initials_before(F.col("text"))).alias("x"))
    return t.select("sample_id", "x.acronym", "x.expansion").distinct()


@query()
def expansion_by_letters(spark, d):
    from glossa.operators.inexpansion import by_letters

    t = table(spark, d, "sci_dr").where("acronym_ is not null and text is not null")
    return t.select("sample_id", by_letters(F.col("text"), F.upper("acronym_")).alias("expansion")).where("expansion is not null")


@query()
def bio_forms(spark, d):
    """Brackets in the texts as tags: the bracketed token is a short form, the words its initials spell a long form."""
    from glossa.operators import bio

    t = table(spark, d, "sci_dr").select("sample_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[()]"), F.lit(0))).alias("pos", "token"))
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy("pos")
    short = (F.lag("token").over(w) == "(") & F.col("token").rlike("^[A-Z]{2,6}$")
    lead = F.array(*(F.lead("token", k).over(w) for k in range(1, 8)))
    inside = F.array_position(lead, F.lit("("))
    ahead = F.get(lead, inside.cast("int"))
    long = (inside > 0) & ahead.rlike("^[A-Z]{2,6}$") & (inside <= F.length(ahead)) & F.col("token").rlike("^[a-z]+$")
    tags = t.select(F.col("sample_id").alias("sent_id"), "pos", "token", F.when(short, "short").when(long, "long").otherwise("O").alias("label"))
    return bio.paired_forms(bio.to_bio(tags))


@query()
def corpus_build(spark, d):
    from glossa.plans.pipeline import corpus

    articles, pairs, roles = corpus(table(spark, d, "sci_dr"), "sample_id", "text")
    n = pairs.groupBy("sample_id").agg(F.count("*").alias("pairs"))
    return articles.join(roles, "sample_id").join(n, "sample_id").select("sample_id", F.length("text").alias("chars"), "role", "fold", "pairs")


@query()
def end_to_end_expand(spark, d):
    from glossa.plans.pipeline import end_to_end

    return end_to_end(table(spark, d, "documents"), "doc_id", "text", _pairs(spark, d))


@query(
    f"WITH {_PAIRS}, {_MF.format(src='pairs')}, a AS ({_upper_sql('[A-Z]{2,8}s?')}) SELECT doc_id, a.acronym, mf.expansion, mf.confidence FROM a LEFT JOIN mf ON a.acronym = mf.acronym"
)
def streamed_expansion(spark, d):
    """The documents as a stream, expanded against the dictionary, drained into memory."""
    from glossa.streaming.extraction import document_stream, expanded
    import os
    import uuid

    from glossa.runtime import shared_dir

    schema = table(spark, d, "documents").schema
    source = f"{d}/documents.parquet"
    source = f"{d}/documents*.parquet" if os.path.isfile(source) else source
    out = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    best = D.most_frequent(_pairs(spark, d))
    q = expanded(document_stream(spark, source, schema), best).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("doc_id long, acronym string, expansion string, confidence double").parquet(out)


# ---- operators on sentences, cleaned words, rewritten tests, result files

_SENTENCES = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\\p{L}\\p{N}_])(" + "|".join(X.ABBREVIATIONS) + ")\\.', '\\1\\2\u2024', 'g'), "
    "'([.!?][\"”»’)\\]]*)[ \\t\\r\\n]+', '\\1\u241e', 'g'), '([。！？।][\"”」』]*)', '\\1\u241e', 'g'), '\u241e'), lambda s: trim(replace(s, '\u2024', '.'))), lambda s: s <> '')"
)


@query(f"SELECT doc_id, len({_SENTENCES}) AS sentences, coalesce(list_max(list_transform({_SENTENCES}, lambda s: length(s))), 0) AS longest FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", X.sentence_array(F.col("text")).alias("s"))
    return t.select("doc_id", F.size("s").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


_CLEANED = f"string_split_regex(regexp_replace(text, '{X.CLEANED_MARKS.replace(chr(39), chr(39) * 2)}', ' ', 'g'), '[ \\t\\r\\n]+')"


@query(f"SELECT sample_id, w AS word, count(*) AS n FROM (SELECT sample_id, unnest(list_transform({_CLEANED}, lambda w: lower(w))) AS w FROM sci_dr) WHERE w <> '' AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '\\p{{N}}+') GROUP BY 1, 2")
def cleaned_words(spark, d):
    w = X.cleaned_words(F.col("text"), True)
    return table(spark, d, "sci_dr").select("sample_id", F.explode(w).alias("word")).groupBy("sample_id", "word").agg(F.count("*").alias("n"))


@query()
def cleaned_stems(spark, d):
    from glossa.functions.inflect import lancaster

    t = table(spark, d, "sci_dr").where("text is not null").select("sample_id", lancaster(X.cleaned_words(F.col("text"))).alias("s"))
    return t.select("sample_id", F.explode("s").alias("stem")).groupBy("sample_id", "stem").agg(F.count("*").alias("n"))


@query(f"SELECT sample_id, lower(w) AS word, count(*) AS n FROM (SELECT sample_id, unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS w FROM sci_dr) WHERE w <> '' AND lower(w) NOT IN ({_STOP}) GROUP BY 1, 2")
def lowered_words(spark, d):
    return table(spark, d, "sci_dr").select("sample_id", F.explode(X.lowered_words(F.col("text"))).alias("word")).groupBy("sample_id", "word").agg(F.count("*").alias("n"))


@query()
def linked_text(spark, d):
    """Acronyms with an expansion become its token, those without are deleted."""
    t = table(spark, d, "sci_dr").where("text is not null and acronym_ is not null")
    return t.select("sample_id", X.linked_text(F.col("text"), F.array(F.struct(F.col("acronym_").alias("acronym"), "expansion"))).alias("text"))


@query(
    "WITH t AS (SELECT sample_id, string_split(text, acronym_) AS p FROM sci_dr WHERE text IS NOT NULL AND acronym_ <> '') "
    "SELECT sample_id, array_to_string(p, '') AS text, array_to_string(list_transform(range(1, len(p)), lambda i: length(array_to_string(p[1:i], ''))), ',') AS offsets FROM t"
)
def removed_substrings(spark, d):
    t = table(spark, d, "sci_dr").where("text is not null and acronym_ <> ''")
    text, at = X.without_substring(F.col("text"), F.col("acronym_"))
    return t.select("sample_id", text.alias("text"), F.array_join(F.transform(at, lambda x: x.cast("string")), ",").alias("offsets"))


@query()
def test_rewrite(spark, d):
    pair = F.array(F.struct(F.col("acronym_").alias("acronym"), "expansion"))
    t = table(spark, d, "sci_dr").where("text is not null and acronym_ is not null and expansion is not null")
    t = t.select("sample_id", X.substitute_pairs(F.col("text"), pair).alias("text"), pair.alias("pairs"))
    kept, _ = D.rewritten_tests(t, "sample_id")
    return kept.select("sample_id", "text", F.size("pairs").cast("long").alias("pairs"))


@query(f"WITH {_EVAL} SELECT article_id AS doc_id, CAST(sum(success::INT) AS BIGINT) AS \"right\", count(*) AS total FROM evaluated GROUP BY 1")
def document_scores(spark, d):
    return M.document_scores(_evaluated(spark, d), "article_id")


@query(
    f"WITH {_LABELS}, {_GOLDL}, g AS (SELECT DISTINCT doc_id, acronym, gold AS expansion FROM act), p AS (SELECT DISTINCT doc_id, acronym, label AS expansion FROM labels), "
    "j AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.doc_id IS NOT NULL AS a, p.doc_id IS NOT NULL AS b FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.acronym = p.acronym AND g.expansion = p.expansion) "
    "SELECT doc_id, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a) AS fp, count(*) FILTER (NOT b) AS fn FROM j GROUP BY 1"
)
def document_extraction_scores(spark, d):
    return M.document_extraction_scores(_reviewed(spark, d).withColumnRenamed("gold", "expansion"), _last_labels(spark, d).withColumnRenamed("label", "expansion"))


@query(f"WITH {_LABELS}, {_GOLDL} SELECT doc_id, acronym, gold AS expansion FROM act INTERSECT SELECT doc_id, acronym, label FROM labels")
def shared_labels(spark, d):
    gold = _reviewed(spark, d).select("doc_id", "acronym", F.col("gold").alias("expansion"))
    return M.shared_spans(_last_labels(spark, d).withColumnRenamed("label", "expansion"), gold)


@query(
    f"WITH {_VOTES}, b AS (SELECT article_id, acronym, label, max(confidence) AS c FROM p GROUP BY 1, 2, 3) "
    "SELECT article_id, acronym, array_to_string(list(label ORDER BY c DESC, label), ';') AS ranked, count(*) AS options FROM b GROUP BY 1, 2"
)
def ranked_options(spark, d):
    r = E.ranked_options(_votes(spark, d), ["article_id", "acronym"])
    return r.select("article_id", "acronym", F.array_join(F.transform("options", lambda o: o["label"]), ";").alias("ranked"), F.size("options").cast("long").alias("options"))


@query(f"WITH {_PAIRS}, {_MF.format(src='pairs')}, a AS ({_upper_sql('[A-Z]{2,8}s?')}) SELECT doc_id, a.acronym, mf.expansion FROM a JOIN mf ON a.acronym = mf.acronym ORDER BY 1, 2")
def sorted_expansions(spark, d):
    from glossa.plans.pipeline import sorted_output

    w = F.filter(X.words(F.col("text")), lambda x: x.rlike("^[A-Z]{2,8}s?$"))
    a = A.exploded(_docs(spark, d), "doc_id", F.array_distinct(F.transform(w, F.upper)))
    return sorted_output(a.join(D.most_frequent(_pairs(spark, d)), "acronym").select("doc_id", "acronym", "expansion"), "doc_id")


@query(_COS_SQL + "x AS (SELECT 1) SELECT acronym, expansion, term, sum(weight) AS weight FROM tr JOIN tf USING (sample_id) GROUP BY 1, 2, 3")
def context_vectors(spark, d):
    t, tf = _sci(spark, d)
    train = D.in_articles(t.where("expansion is not null"), _roles(spark, d, "train"))
    return E.context_vectors(train.withColumnRenamed("sample_id", "id"), tf.withColumnRenamed("sample_id", "id"))


def _in_text(version):
    def run(spark, d):
        from glossa.operators.inexpansion import expansion_in_text

        t = table(spark, d, "sci_dr").where("acronym_ is not null and text is not null")
        return t.select("sample_id", expansion_in_text(F.col("text"), F.col("acronym_"), version).alias("expansion")).where("expansion is not null")

    run.__name__ = f"expansion_in_text_{version}"
    return run


for _version in ("v1", "v2", "v3"):
    query()(_in_text(_version))
