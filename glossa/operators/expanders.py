"""Out-expanders: predictions for acronyms whose expansion is not in the text.

All predictions have the form ``article_id, acronym, expansion, confidence`` or,
with all options, ``article_id, acronym, option, confidence``. A model depends
only on the acronym, so every operator groups by acronym and never fits per document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.runtime import cut, ship, sized_broadcast

#: Rows of either side of a key that meet in one task; tests that are compared at once.
BLOCK, AT_ONCE = 8_192, 128


def cosine(a, b):
    """Cosine of two arrays of doubles; 0 if either is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(0.0)


def nearest(tests: DataFrame, train: DataFrame, key: list[str], test_id: str, vec: str = "vec", label: str = "label") -> DataFrame:
    """Options of each test vector with the greatest cosine to their training vectors, floor 0 (C-01, C-03, J-15).

    ``test_id, label, confidence``; the join is on ``key`` (the acronym, or a block).
    """
    j = tests.select(test_id, *key, F.col(vec).alias("a")).join(train.select(*key, label, F.col(vec).alias("b")), key)
    return j.select(test_id, label, F.greatest(cosine(F.col("a"), F.col("b")), F.lit(0.0)).alias("c")).groupBy(test_id, label).agg(F.round(F.max("c"), 6).alias("confidence"))


def top_option(options: DataFrame, ids: list[str], option: str = "label") -> DataFrame:
    """The option of greatest confidence; ties go to the least (T-01, T-02, T-04)."""
    return options.groupBy(*ids).agg(F.min_by(option, F.struct(-F.col("confidence"), option)).alias(option), F.max("confidence").alias("confidence"))


def cosine_long(tests: DataFrame, options: DataFrame, test_ids: list[str], option_ids: list[str], key: str = "acronym") -> DataFrame:
    """Cosine of vectors in long form: ``*test_ids, key, *option_ids, confidence`` (C-01 and C-02 on sparse vectors).

    Test terms meet option terms by (key, term); norms are joined afterwards, so
    the work grows with shared terms, not with pairs of documents. Options that
    share no term have confidence 0 and no row.
    """
    tn = tests.groupBy(*test_ids, key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("tn"))
    on = options.groupBy(key, *option_ids).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("on"))
    dot = (
        tests.select(*test_ids, key, "term", F.col("weight").alias("w")).join(options.select(key, *option_ids, "term", F.col("weight").alias("v")), [key, "term"])
        .groupBy(*test_ids, key, *option_ids).agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    )
    return dot.join(tn, [*test_ids, key]).join(on, [key, *option_ids]).select(
        *test_ids, key, *option_ids, F.round(F.col("dot") / (F.col("tn") * F.col("on")), 6).alias("confidence")
    )


def blocked(tests: DataFrame, train: DataFrame, key: str, test_by: str, train_by: str) -> tuple:
    """Both sides with ``_i, _j``, so that any two rows of a key meet in exactly one group by ``key, _i, _j``, and groups stay small."""
    rows = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    sizes = cut(rows(tests, "_x").join(rows(train, "_y"), key).select(key, F.ceil(F.col("_x") / BLOCK).alias("_x"), F.ceil(F.col("_y") / BLOCK).alias("_y")))

    def dealt(df: DataFrame, by: str, own: str, blocks: str, other: str, others: str) -> DataFrame:
        at = F.pmod(F.xxhash64(by), F.col(blocks)).alias(own)
        return df.join(sizes, key).select(*(F.col(c).alias(c) for c in df.columns), at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias(other))

    a = dealt(tests, test_by, "_i", "_x", "_j", "_y").groupBy(key, "_i", "_j")
    return a, dealt(train, train_by, "_j", "_y", "_i", "_x").groupBy(key, "_i", "_j")


def nearest_text(tests: DataFrame, train: DataFrame, test_id: str, key: str = "acronym", option: str = "expansion") -> DataFrame:
    """``test_id, key, option, confidence``: the option of the training text with the greatest cosine of term counts (C-01 on texts).

    Both sides have ``key, words, norm``, a list of terms and the length of its
    vector; training rows have an option. Texts that share no term have no row;
    ties go to the least option. Texts meet in blocks, term by term, and only the
    best options of a test and block leave it.
    """
    ship(tests.sparkSession)
    types = {c: tests.schema[c].dataType.simpleString() for c in (test_id, key)} | {option: train.schema[option].dataType.simpleString()}
    a, b = blocked(tests.select(test_id, key, "words", "norm"), train.select(key, option, "words", "norm"), key, test_id, "words")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({test_id: x[test_id][:0], key: x[key][:0], option: y[option][:0] if len(y) else [], "c": np.array([], float)})
        if not len(x) or not len(y):
            return empty
        y = y.sort_values(option, kind="stable")
        nx, ny = ([len(w) for w in z["words"]] for z in (x, y))
        terms = pd.factorize(np.concatenate([*x["words"], *y["words"]]))[0]
        own = terms[sum(nx) :]
        order = np.argsort(own, kind="stable")
        owner = np.repeat(np.arange(len(y)), ny)[order]
        starts = np.searchsorted(own[order], np.arange(terms.max() + 2 if len(terms) else 1))
        options = y[option].to_numpy()
        first = np.flatnonzero(np.append(True, options[1:] != options[:-1]))
        norm, tn, rows, at, cs = y["norm"].to_numpy(float), x["norm"].to_numpy(float), [], [], []
        for i, mine in enumerate(np.split(terms[: sum(nx)], np.cumsum(nx)[:-1])):
            met = [owner[starts[t] : starts[t + 1]] for t in mine]  # a term that is repeated on either side counts as often
            dot = np.bincount(np.concatenate(met), minlength=len(y)) if met else np.zeros(len(y))
            best = np.maximum.reduceat(np.where(dot > 0, dot / (tn[i] * norm), -1.0), first)
            top = np.flatnonzero((best > 0) & (best >= best.max() - 2e-6))  # what can be the greatest once rounded to six digits
            rows.append(np.full(len(top), i))
            at.append(first[top])
            cs.append(best[top])
        rows, at = np.concatenate(rows), np.concatenate(at)
        return pd.DataFrame({test_id: x[test_id].to_numpy()[rows], key: x[key].to_numpy()[rows], option: options[at], "c": np.concatenate(cs)})

    best = a.cogroup(b).applyInPandas(compare, ", ".join(f"{c} {t}" for c, t in types.items()) + ", c double")
    best = best.groupBy(test_id, key, option).agg(F.round(F.max("c"), 6).alias("confidence"))
    return top_option(best, [test_id, key], option)


def chunk_vote(chunks: DataFrame, train: DataFrame, test_id: str, key: list[str]) -> DataFrame:
    """Cosines of a document's chunks summed by option and divided by the number of chunks (C-13)."""
    n = chunks.groupBy(test_id).agg(F.count("*").alias("n"))
    j = chunks.select(test_id, *key, F.col("vec").alias("a")).join(train.select(*key, "label", F.col("vec").alias("b")), key)
    s = j.groupBy(test_id, "label").agg(F.sum(cosine(F.col("a"), F.col("b"))).alias("s"))
    return s.join(n, test_id).select(test_id, "label", F.round(F.col("s") / F.col("n"), 6).alias("confidence"))


def hard_vote(predictions: DataFrame, ids: list[str], option: str = "label", voter: str = "expander") -> DataFrame:
    """Each expander votes for its best option (C-14 hard, A-26): ``*ids, option, votes``."""
    best = top_option(predictions, [*ids, voter], option)
    return best.groupBy(*ids, option).agg(F.count("*").alias("votes"))


def soft_vote(predictions: DataFrame, ids: list[str], option: str = "label", voter: str = "expander") -> DataFrame:
    """Confidences shifted to be non-negative and normalised within each expander, then summed (C-14 soft): ``*ids, option, score``."""
    per = predictions.groupBy(*ids, voter).agg(F.min("confidence").alias("low"), F.sum("confidence").alias("s"), F.count("*").alias("k"))
    shift = F.greatest(-F.col("low"), F.lit(0.0))
    total = F.col("s") + F.col("k") * shift
    p = predictions.join(per, [*ids, voter]).withColumn("share", F.when(total > 0, (F.col("confidence") + shift) / total).otherwise(1.0 / F.col("k")))
    return p.groupBy(*ids, option).agg(F.round(F.sum("share"), 6).alias("score"))


def weighted_vote(predictions: DataFrame, weights: DataFrame, ids: list[str], option: str = "label") -> DataFrame:
    """Weighted sum of confidences; ``weights`` has ``expander, w`` (C-15)."""
    small, w = sized_broadcast(weights, 100_000)
    return predictions.join(w, "expander").groupBy(*ids, option).agg(F.round(F.sum(F.col("w") * F.col("confidence")), 6).alias("score"))


def trained_ensemble(predictions: DataFrame, truth: DataFrame, ids: list[str], option: str = "label", rounds: int = 100, seed: int = 0):
    """Gradient-boosted stumps on the expanders' confidences; label: is the option true (C-14 trained). Returns (model, expanders)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    names = sorted(r[0] for r in predictions.select("expander").distinct().collect())  # the expanders that were run
    wide = predictions.groupBy(*ids, option).pivot("expander", names).agg(F.max("confidence")).na.fill(0.0, names)
    data = wide.join(truth.withColumn("y", F.lit(1.0)), [*ids, option], "left").na.fill(0.0, ["y"])
    stages = [VectorAssembler(inputCols=names, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=1, stepSize=1.0, seed=seed)]
    return Pipeline(stages=stages).fit(data), names


def gap_sweep(a: DataFrame, b: DataFrame, truth: DataFrame, gaps: list[float], ids: list[str]) -> DataFrame:
    """Take model A where its two best options are at least a gap apart, else B: ``gap, used_a, right`` (A-27)."""
    def best(p: DataFrame, n: str) -> DataFrame:
        s = p.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "label"))).alias("s"))
        gap = F.when(F.size("s") > 1, F.get("s", F.lit(1))["c"] - F.get("s", F.lit(0))["c"]).otherwise(F.lit(float("inf")))
        return s.select(*ids, F.get("s", F.lit(0))["label"].alias(n), gap.alias(n + "_gap"))

    j = best(a, "a").join(best(b, "b"), ids).join(truth.select(*ids, F.col("label").alias("true")), ids)
    j = j.withColumn("gap", F.explode(F.array(*(F.lit(g) for g in gaps))))
    use = F.col("a_gap") >= F.col("gap")
    return j.groupBy("gap").agg(F.sum(use.cast("long")).alias("used_a"), F.sum((F.when(use, F.col("a")).otherwise(F.col("b")) == F.col("true")).cast("long")).alias("right"))


def locality_similarity(tests: DataFrame, train: DataFrame, test_ids: list[str], option_ids: list[str], key: str = "acronym") -> DataFrame:
    """Sum over shared tokens of products of their weights, each side's weights in falling order (C-21).

    Both sides have ``key, term, weight``, a row for each occurrence of a token.
    Weights meet by rank, so the work is that of shared occurrences.
    """
    def ranked(df: DataFrame, ids: list[str], name: str) -> DataFrame:
        w = df.groupBy(*ids, key, "term").agg(F.sort_array(F.collect_list("weight"), asc=False).alias("w"))
        return w.select(*ids, key, "term", F.posexplode("w").alias("rank", name))

    j = ranked(tests, test_ids, "v").join(ranked(train, option_ids, "w"), [key, "term", "rank"])
    return j.groupBy(*test_ids, key, *option_ids).agg(F.round(F.sum(F.col("v") * F.col("w")), 6).alias("confidence"))


def keyword_overlap(tests: DataFrame, train: DataFrame, test_ids: list[str], top: int = 20, key: str = "acronym", option: str = "expansion") -> DataFrame:
    """Sum of the weights that an option's best training keywords have in common with a document's (C-17)."""
    def best(df: DataFrame, ids: list[str]) -> DataFrame:
        k = df.groupBy(*ids).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("m"), "term"))), 1, top).alias("k"))
        return k.select(*ids, F.explode("k").alias("x")).select(*ids, F.col("x.term").alias("term"), (-F.col("x.m")).alias("weight"))

    t = best(tests.select(*test_ids, key, "term", "weight"), [*test_ids, key]).select(*test_ids, key, "term")
    o = best(train.select("train_id", key, option, "term", "weight"), ["train_id", key, option]).groupBy(key, option, "term").agg(F.sum("weight").alias("weight"))
    return t.join(o, [key, "term"]).groupBy(*test_ids, key, option).agg(F.round(F.sum("weight"), 6).alias("confidence"))


def rounded(c: np.ndarray) -> np.ndarray:
    """Millionths, half up as Spark rounds the decimals of a double."""
    from decimal import ROUND_HALF_UP, Decimal

    r = np.sign(c) * np.floor(np.abs(c) * 1e6 + 0.5)
    for i in np.flatnonzero(np.abs(np.abs(c) * 1e6 % 1 - 0.5) < 1e-6):
        r[i] = float((Decimal(repr(float(c[i]))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    return r


def neighbour_vote(tests: DataFrame, train: DataFrame, test_id: str, k: int = 5, key: str = "acronym") -> DataFrame:
    """The label most of the k nearest training vectors of the acronym have; ties go to the nearer sum, then the least label (C-12, C-23).

    Vectors meet in blocks as matrices; of each block a test keeps its k nearest.
    Equally near ones, to six digits, are taken by training id.
    """
    ship(tests.sparkSession)
    types = {c: tests.schema[c].dataType.simpleString() for c in (test_id, key)} | {c: train.schema[c].dataType.simpleString() for c in ("train_id", "label")}
    a, b = blocked(tests.select(test_id, key, "vec"), train.select(key, "train_id", "label", "vec"), key, test_id, "train_id")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows, near, cs = [np.array([], int)], [np.array([], int)], [np.array([], float)]
        if len(x) and len(y):
            ids, labels = (pd.factorize(y[c], sort=True)[0] for c in ("train_id", "label"))
            order = np.lexsort((labels, ids))
            y = y.iloc[order]
            p, q = np.stack(x["vec"]).astype(float), np.stack(y["vec"]).astype(float)
            pn, qn = (np.sqrt(_in_order(z, z)) for z in (p, q))
            for i in range(0, len(p), AT_ONCE):
                n = pn[i : i + AT_ONCE, None] * qn
                c = np.divide(p[i : i + AT_ONCE] @ q.T, n, out=np.zeros_like(n), where=n > 0)
                least = np.partition(c, len(q) - k, axis=1)[:, len(q) - k] if len(q) > k else np.full(len(c), -2.0)
                r, j = np.nonzero(c >= least[:, None] - 2e-6)  # what can be among the k nearest once rounded
                n = n[r, j]
                m = rounded(np.divide(_in_order(p[i + r], q[j]), n, out=np.zeros_like(n), where=n > 0))
                by = np.lexsort((j, -m, r))
                r, j, m = r[by], j[by], m[by]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                rows.append(i + r[keep])
                near.append(j[keep])
                cs.append(m[keep] / 1e6)
        r, j = np.concatenate(rows), np.concatenate(near)
        return pd.DataFrame({test_id: x[test_id].iloc[r].array, key: x[key].iloc[r].array, "train_id": y["train_id"].iloc[j].array, "label": y["label"].iloc[j].array, "c": np.concatenate(cs)})

    c = a.cogroup(b).applyInPandas(compare, ", ".join(f"{n} {t}" for n, t in types.items()) + ", c double")
    near = c.groupBy(test_id, key).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("m"), "train_id", "label"))), 1, k).alias("n"))
    n = near.select(test_id, key, F.explode("n").alias("x")).groupBy(test_id, key, F.col("x.label").alias("label")).agg(F.count("*").alias("votes"), F.round(F.sum(-F.col("x.m")), 6).alias("s"))
    return n.groupBy(test_id, key).agg(F.min_by("label", F.struct(-F.col("votes"), -F.col("s"), "label")).alias("label"), F.max("votes").alias("votes"))


def _in_order(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of rows summed from left to right, as ``cosine`` does."""
    s = np.zeros(len(p))
    for d in range(p.shape[1]):
        s += p[:, d] * q[:, d]
    return s


def training_pairs(instances: DataFrame, blocks: int = 16) -> DataFrame:
    """``acronym, left, right, same``: as many pairs of equal as of unequal expansions for similarity learning (J-16).

    Instances (``acronym, expansion, article_id``) of an acronym are dealt to
    blocks by hash and meet their next neighbour there, in an order by
    expansion for equal pairs and by hash for unequal ones; the number of pairs
    grows with the instances, never with their square. A sampling operator.
    """
    x = instances.select("acronym", "expansion", "article_id").distinct()
    x = x.withColumn("h", F.xxhash64("article_id", "expansion")).withColumn("b", F.pmod("h", F.lit(blocks)))
    equal = Window.partitionBy("acronym", "b").orderBy("expansion", "h")
    other = Window.partitionBy("acronym", "b").orderBy("h")

    def neighbours(w) -> DataFrame:
        n = x.withColumn("right", F.lead("article_id").over(w)).withColumn("e", F.lead("expansion").over(w)).where("right is not null")
        return n.select("acronym", "b", F.col("article_id").alias("left"), "right", (F.col("expansion") == F.col("e")).alias("same"), "h")

    p = neighbours(equal).where("same").unionByName(neighbours(other).where("not same"))
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("acronym", "b", "same").orderBy("h")))
    n = p.groupBy("acronym", "b").agg(F.sum(F.col("same").cast("int")).alias("yes"), F.sum((~F.col("same")).cast("int")).alias("no"))
    return p.join(n, ["acronym", "b"]).where(F.col("r") <= F.least("yes", "no")).select("acronym", "left", "right", "same")


def report_table(predictions: DataFrame, ids: list[str], expanders: list[str]) -> DataFrame:
    """One row per (document, acronym) with every expander's expansion and confidence, missing ones null (J-09 to J-11)."""
    one = lambda c, n: [F.max(F.when(F.col("expander") == e, F.col(c))).alias(f"{n}_{e}") for e in expanders]
    return predictions.groupBy(*ids).agg(*one("label", "expansion"), *one("confidence", "confidence"))


def by_priority(predictions: DataFrame, ids: list[str], order: list[str]) -> DataFrame:
    """The answer of the first expander of an order that has one (G-11)."""
    rank = F.array_position(F.array(*(F.lit(e) for e in order)), F.col("expander"))
    p = predictions.where(F.col("label").isNotNull()).withColumn("rank", rank).where("rank > 0")
    return p.groupBy(*ids).agg(F.min_by("label", F.struct("rank", -F.col("confidence"), "label")).alias("label"), F.min_by("expander", "rank").alias("expander"))


def with_zeros(options: DataFrame, ids: list[str], candidates: DataFrame) -> DataFrame:
    """Confidences of all candidate options, 0 for those a model left out (U-07)."""
    return candidates.join(options, [*ids, "label"], "left").na.fill(0.0, ["confidence"])


def ranked_options(predictions: DataFrame, ids: list[str], option: str = "label") -> DataFrame:
    """``*ids, options``: every option with its greatest confidence, best first, ties by name (T-05)."""
    best = predictions.groupBy(*ids, option).agg(F.max("confidence").alias("c"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("m"), F.col(option).alias("o"))))
    return best.groupBy(*ids).agg(ranked.alias("x")).select(*ids, F.transform("x", lambda x: F.struct(x["o"].alias(option), (-x["m"]).alias("confidence"))).alias("options"))


def context_vectors(train: DataFrame, weights: DataFrame, prefix: str | None = None) -> DataFrame:
    """``acronym, expansion, term, weight``: term weights of an expansion's texts summed, within its acronym's terms (R-12, C-16).

    ``train`` has ``id, acronym, expansion``, ``weights`` ``id, term, weight``;
    with ``prefix`` only ids that begin with it count.
    """
    t = train.where(F.col("expansion").isNotNull())
    if prefix is not None:
        t = t.where(F.col("id").cast("string").startswith(prefix))
    return t.select("id", "acronym", "expansion").distinct().join(weights, "id").groupBy("acronym", "expansion", "term").agg(F.sum("weight").alias("weight"))
