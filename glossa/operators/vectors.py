"""Document and expansion vectors, in long form ``(id…, term, weight)`` or through Spark ML.

Long form keeps everything in aggregations and joins on the term; nothing is
collected and no vocabulary is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as X


def term_counts(docs: DataFrame, id_col: str, tokens) -> DataFrame:
    """``id_col, term, tf`` (R-01, A-10)."""
    return docs.select(F.col(id_col), F.explode(tokens).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def with_norm(docs: DataFrame, words: str = "words") -> DataFrame:
    """With ``norm``, the length of the vector of term counts of a list of words."""
    def squares(w):
        runs = F.aggregate(F.array_sort(w), F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s")), lambda a, x: F.struct(
            x.alias("t"), F.when(a["t"] == x, a["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"), (a["s"] + F.when(a["t"] == x, 2 * a["n"] + 1).otherwise(F.lit(1))).alias("s")))
        return runs["s"]

    return docs.withColumn("norm", F.sqrt(squares(F.col(words)).cast("double"))).where("norm > 0")


def bag_of_words(docs: DataFrame, id_col: str, tokens) -> DataFrame:
    """Counts over the greatest count of the corpus, as ``id_col, term, weight`` (R-01, A-11)."""
    tf = term_counts(docs, id_col, tokens)
    top = tf.agg(F.max("tf").alias("top"))
    return tf.crossJoin(F.broadcast(top)).select(id_col, "term", F.round(F.col("tf") / F.col("top"), 8).alias("weight"))  # one row


def tfidf(docs: DataFrame, id_col: str, tokens, min_df: int = 1, max_df: float = 1.0, top: int | None = None) -> DataFrame:
    """Rows of unit length with idf = ln((1 + n) / (1 + df)) + 1, as ``id_col, term, weight`` (R-02).

    ``top`` keeps the most frequent terms of the corpus (ties: least term), the
    vocabulary limit of the model.
    """
    tf = term_counts(docs, id_col, tokens)
    n = docs.select(id_col).distinct().agg(F.count("*").cast("double").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    df = df.crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if top is not None:
        df = df.orderBy(F.desc("cf"), "term").limit(top)
    w = tf.join(df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, id_col).select(id_col, "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


def weighted_ngrams(docs: DataFrame, id_col: str, tokens, weights: dict[int, float]) -> DataFrame:
    """Counts of n-grams times the weight of their length, as ``id_col, term, weight`` (R-03, P-22)."""
    def weighted(n: int, w: float):
        return F.transform(X.word_ngrams(tokens, n), lambda g: F.struct(g.alias("term"), F.lit(w).alias("w")))

    grams = F.flatten(F.array(*(weighted(n, w) for n, w in weights.items())))
    return docs.select(F.col(id_col), F.explode(grams).alias("g")).groupBy(id_col, F.col("g.term").alias("term")).agg(F.round(F.sum("g.w"), 6).alias("weight"))


def locality(docs: DataFrame, id_col: str, text_col: str, concept: str, sentence_decay: float = 0.3, paragraph_decay: float = 0.6) -> DataFrame:
    """Token weights by distance from a concept: 1 in its sentence, less in its paragraph, least elsewhere (R-04, R-05, W-06).

    A token's value is its greatest weight times its occurrences. Sentences end
    at periods, paragraphs at line breaks; documents without the concept give no row.
    """
    paras = docs.select(F.col(id_col), F.posexplode(F.split(text_col, r"\n")).alias("par", "ptext"))
    sents = paras.select(id_col, "par", F.posexplode(F.split("ptext", r"(?<=\.)\s+")).alias("sen", "stext"))
    has = F.contains(F.col("stext"), F.col(concept)) if concept in docs.columns else F.contains(F.col("stext"), F.lit(concept))
    sents = sents.withColumn("here", has) if concept not in docs.columns else sents.join(docs.select(id_col, concept), id_col).withColumn("here", has)
    sents = sents.withColumn("in_par", F.max("here").over(Window.partitionBy(id_col, "par"))).withColumn("in_doc", F.max("here").over(Window.partitionBy(id_col)))
    w = F.when(F.col("here"), 1.0).when(F.col("in_par"), 1.0 - sentence_decay).otherwise(1.0 - paragraph_decay)
    term = sents.where("in_doc").select(id_col, w.alias("w"), F.explode(X.words(F.col("stext"))).alias("term"))
    name = F.col(concept) if concept in docs.columns else F.lit(concept)
    if concept in docs.columns:
        term = term.join(docs.select(id_col, concept), id_col)
    return term.where(F.col("term") != name).groupBy(id_col, "term").agg(F.round(F.max("w") * F.count("*"), 6).alias("weight"))


def window_terms(docs: DataFrame, id_col: str, tokens, concept: str, size: int) -> DataFrame:
    """``id_col, term, n``: tokens within ``size`` places of an occurrence of the concept, a word or a column of words (W-05, R-08)."""
    name = F.col(concept) if concept in docs.columns else F.lit(concept)
    at = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: F.get("_t", i) == F.col("_c"))
    d = docs.select(F.col(id_col), tokens.alias("_t"), name.alias("_c")).where(F.array_contains(F.col("_t"), F.col("_c")))
    near = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: F.struct(i.alias("i"), F.get("_t", i).alias("term"))),
        lambda x: (x["term"] != F.col("_c")) & F.exists(F.col("_at"), lambda p: F.abs(p - x["i"]) <= size),
    )
    return d.withColumn("_at", at).select(id_col, F.explode(F.transform(near, lambda x: x["term"])).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("n"))


def expansion_vectors(vectors: DataFrame, pairs: DataFrame, id_col: str = "article_id") -> DataFrame:
    """``acronym, expansion, term, weight``: vectors of an expansion's articles summed (R-13, A-12)."""
    p = pairs.select("acronym", "expansion", id_col).distinct()
    return p.join(vectors, id_col).groupBy("acronym", "expansion", "term").agg(F.sum("weight").alias("weight"))


def concatenated(parts: dict[str, DataFrame], id_col: str) -> DataFrame:
    """Several representations side by side: terms carry the name of theirs (R-11)."""
    out = None
    for name, p in parts.items():
        p = p.select(id_col, F.concat(F.lit(name + ":"), F.col("term")).alias("term"), "weight")
        out = p if out is None else out.unionByName(p)
    return out


def mean_vectors(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """``key, mean``: element-wise mean of arrays of doubles (A-13)."""
    e = vectors.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def lda_topics(docs: DataFrame, id_col: str, tokens, topics: int = 8, rounds: int = 10, vocabulary: int = 20_000, seed: int = 7) -> DataFrame:
    """``id_col, topics``: topic distribution by online variational LDA (R-06)."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    t = docs.select(F.col(id_col), tokens.alias("_t"))
    counted = CountVectorizer(inputCol="_t", outputCol="features", vocabSize=vocabulary, minDF=2.0).fit(t).transform(t)
    model = LDA(k=topics, maxIter=rounds, optimizer="online", seed=seed).fit(counted)
    return model.transform(counted).select(id_col, vector_to_array("topicDistribution").alias("topics"))


def w2v_mean(docs: DataFrame, id_col: str, tokens, size: int = 50, window: int = 5, rounds: int = 1, seed: int = 7) -> DataFrame:
    """``id_col, vec``: mean word vector of a document (a documented stand-in for paragraph vectors, R-07, R-14)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    t = docs.select(F.col(id_col), tokens.alias("_t"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=3, maxIter=rounds, numPartitions=4, seed=seed, inputCol="_t", outputCol="v").fit(t)
    return model.transform(t).select(id_col, vector_to_array("v").alias("vec"))


def lda_term_vectors(docs: DataFrame, expansions: DataFrame, tokens, topics: int = 8, rounds: int = 10, vocabulary: int = 20_000, seed: int = 7) -> DataFrame:
    """``acronym, expansion, vec``: sum over an expansion's words of their shares in the topics (R-15).

    The topic matrix has ``vocabulary`` x ``topics`` entries, whatever the corpus.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    spark = docs.sparkSession
    t = docs.select(tokens.alias("_t"))
    vectorizer = CountVectorizer(inputCol="_t", outputCol="features", vocabSize=vocabulary, minDF=2.0).fit(t)
    model = LDA(k=topics, maxIter=rounds, optimizer="online", seed=seed).fit(vectorizer.transform(t))
    m = model.topicsMatrix().toArray()
    share = m / m.sum(1, keepdims=True)
    words = spark.createDataFrame([(w, share[i].tolist()) for i, w in enumerate(vectorizer.vocabulary)], "term string, share array<double>")
    e = expansions.select("acronym", "expansion").distinct().select("acronym", "expansion", F.explode(X.content_words(F.col("expansion"))).alias("term"))
    s = e.join(words, "term").select("acronym", "expansion", F.posexplode("share").alias("k", "x")).groupBy("acronym", "expansion", "k").agg(F.sum("x").alias("x"))
    return s.groupBy("acronym", "expansion").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("vec"))


def first_articles(pairs: DataFrame) -> DataFrame:
    """``acronym, article_id``: the least article of every acronym, the training side of a one-shot split (T-09)."""
    return pairs.where("article_id is not null").groupBy("acronym").agg(F.min("article_id").alias("article_id"))


def chunked(df: DataFrame, id_col: str, size: int) -> DataFrame:
    """Rows with the number of their chunk of about ``size`` rows, by hash, without a global order (W-07)."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("chunk", F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int"))


def long_enough(docs: DataFrame, tokens, least: int = 100, title: str | None = None) -> DataFrame:
    """Documents of at least ``least`` tokens whose title doesn't hold "list" (F-09)."""
    d = docs.where(F.size(tokens) >= least)
    return d.where(~F.contains(F.lower(title), F.lit("list"))) if title else d
