"""Comparing embeddings and scoring predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import cosine, dot, l2_distance, l2_normalise, norm
from ..functions.hashing import hash32

#: Clusters whose sums or centroids travel in one row, at most.
FEW_CLUSTERS = 10_000
#: Query vectors that are compared with the corpus at a time.
QUERY_BLOCK = 20_000


def top_k(queries: DataFrame, corpus: DataFrame, k: int, width: int = 64) -> DataFrame:
    """``(id, rank, other, similarity)``: exact, for a stated set of queries against all of the corpus, in blocks.

    Both have ``(id, vec)``. A block of query vectors goes to every task, which keeps each query's best k of its own rows; only those
    travel. Ranks count from 0, a query itself is left out, equal similarities go by id. Vectors of another width or length 0 take no part.
    """
    import numpy as np
    import pandas as pd

    sound = lambda df: df.filter(F.size("vec") == width).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).filter(norm("vec") > 0)
    asked, rows = sound(queries), sound(corpus)
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    best = None
    for b in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        if not len(got):
            continue
        ids, q = got["id"].to_numpy(), np.stack(got["vec"].to_numpy())
        held = queries.sparkSession.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

        def search(batches, held=held):
            qid, qv = held.value
            for pdf in batches:
                cid, cv = pdf["id"].to_numpy(), np.stack(pdf["vec"].to_numpy())
                cv = cv / np.linalg.norm(cv, axis=1, keepdims=True)
                for a in range(0, len(qid), 1024):
                    s = np.round(qv[a : a + 1024] @ cv.T, 8)
                    s[qid[a : a + 1024][:, None] == cid[None, :]] = -9
                    m = min(k, len(cid))
                    top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(cid) else np.tile(np.arange(m), (len(s), 1))
                    edge = np.take_along_axis(s, top, 1).min(1)
                    r, c = np.nonzero(s >= edge[:, None])  # all that tie with the last
                    yield pd.DataFrame({"id": qid[a + r], "other": cid[c], "similarity": s[r, c]})

        part = rows.mapInPandas(search, "id long, other long, similarity double").filter("similarity > -2")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return rows.select("id", F.lit(0).alias("rank"), F.col("id").alias("other"), F.lit(0.0).alias("similarity")).limit(0)
    order = W.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return best.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select("id", "rank", "other", "similarity")


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``(id, overlap)``: the share of k neighbours that two lists ``(id, other)`` have in common."""
    common = a.select("id", "other").intersect(b.select("id", "other")).groupBy("id").agg(F.count("*").alias("n"))
    return a.select("id").distinct().join(common, "id", "left").select("id", (F.coalesce("n", F.lit(0)) / k).alias("overlap"))


def footrule(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``(id, distance)``: sum of rank differences weighted by 1 / (smaller rank + 1); a missing neighbour has rank k."""
    met = a.select("id", "other", F.col("rank").alias("ra")).join(b.select("id", "other", F.col("rank").alias("rb")), ["id", "other"], "full")
    ra, rb = F.coalesce("ra", F.lit(k)), F.coalesce("rb", F.lit(k))
    return met.groupBy("id").agg(F.sum(F.abs(ra - rb) / (F.least(ra, rb) + 1)).alias("distance"))


def partner_ranks(pairs: DataFrame, vectors: DataFrame, candidates: int = 100, seed: str = "rank") -> DataFrame:
    """``(year, person, rank)``: 1 + how many of so many random others of the partner's gender are nearer to a person than the partner is.

    ``pairs``: ``(year, person, partner)``; ``vectors``: ``(idx, id, gender, vec)``, idx dense from 0 in the order of gender and id. Draws are
    by hash, with replacement, and pass over person and partner, so none is lost. Persons without a gender are one more gender. A
    pair is left out if there is no other of the partner's gender. Pairs grow by a constant factor and nobody is compared with all.
    """
    groups = vectors.groupBy(F.coalesce("gender", F.lit(0)).alias("__g")).agg(F.min("idx").alias("__from"), F.count("*").alias("__n"))
    p, q = (vectors.select(F.col("id").alias(c), F.col("vec").alias(f"{c[0]}v_{c}"), F.col("idx").alias(f"__i_{c}"), F.coalesce("gender", F.lit(0)).alias(f"__g_{c}")) for c in ("person", "partner"))
    met = pairs.join(p, "person").join(q, "partner").withColumn("own", F.round(cosine("pv_person", "pv_partner"), 9)).join(F.broadcast(groups), F.col("__g_partner") == F.col("__g"))
    same = F.col("__g_person") == F.col("__g_partner")
    rest = F.col("__n") - 1 - same.cast("int")
    low = F.when(same, F.least("__i_person", "__i_partner")).otherwise(F.col("__i_partner"))
    high = F.when(same, F.greatest("__i_person", "__i_partner"))
    key = F.concat_ws("-", "year", "person", "partner")
    ready = met.filter(rest > 0).select("year", "person", "partner", F.col("pv_person").alias("pv"), "own", "__from", rest.alias("__rest"), low.alias("__low"), high.alias("__high"))
    over = lambda x, skipped: x + F.coalesce((x >= F.col(skipped)).cast("int"), F.lit(0))
    drawn = ready.select("year", "person", "partner", "pv", "own", "__low", "__high", F.explode(F.transform(F.sequence(F.lit(1), F.lit(candidates)), lambda t: F.col("__from") + F.pmod(hash32(F.concat_ws("-", key, t), seed), F.col("__rest")))).alias("x"))
    placed = drawn.withColumn("x", over(F.col("x"), "__low")).select("year", "person", "partner", "pv", "own", over(F.col("x"), "__high").alias("idx"))
    compared = placed.join(vectors.select("idx", F.col("vec").alias("ov")), "idx")
    counts = compared.groupBy("year", "person", "partner").agg(F.sum((F.round(cosine("pv", "ov"), 9) > F.col("own")).cast("int")).alias("nearer"))
    return counts.select("year", "person", (F.col("nearer") + 1).alias("rank"))


def with_overall(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean by group and ``OVERALL``."""
    return df.rollup(by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.grouping(by).alias("__g")).select(F.when(F.col("__g") == 1, "OVERALL").otherwise(F.col(by).cast("string")).alias(by), "mean", "n")


def histogram(df: DataFrame, value: str, bins: int, least: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """``(bin, n)`` over the range of all values, the last bin closed; bins of ``least`` members or fewer are suppressed."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    place = F.least(F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1))
    return df.filter(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(*by, F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n")).filter(F.col("n") > least)


def centroids(df: DataFrame, cluster: str, vector: str, width: int = 64) -> DataFrame:
    """``(cluster, n, centroid)`` by sums of the elements; nothing but sums travels."""
    sums = df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(F.col(vector)[i].cast("double")).alias(f"c{i}") for i in range(width)])
    return sums.select(cluster, "n", F.array(*[f"c{i}" for i in range(width)]).alias("centroid"))


def own_centroid_share(df: DataFrame, cluster: str, vector: str, width: int = 64) -> DataFrame:
    """``(cluster, share)`` of members whose nearest centroid by cosine is their own. Clusters are few: their centroids are one array, checked."""
    c = centroids(df, cluster, vector, width)
    held = c.orderBy(cluster).limit(FEW_CLUSTERS + 1).collect()
    if len(held) > FEW_CLUSTERS:
        raise ValueError(f"more than {FEW_CLUSTERS} clusters")
    table = df.sparkSession.createDataFrame([([(r[cluster], r["centroid"]) for r in held],)], f"all array<struct<c:{dict(df.dtypes)[cluster]},v:array<double>>>")
    near = F.array_max(F.transform("all", lambda x: F.struct(F.round(cosine(vector, x["v"]), 9).alias("s"), (-x["c"]).alias("m"))))
    return df.join(F.broadcast(table)).select(cluster, (near["m"] == -F.col(cluster)).cast("double").alias("own")).groupBy(cluster).agg(F.avg("own").alias("share"))


def cluster_scores(df: DataFrame, cluster: str, vector: str, width: int = 64) -> DataFrame:
    """Calinski-Harabasz: between and within sums of squares from counts, sums and sums of squares in one pass."""
    x = lambda i: F.col(vector)[i].cast("double")
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(dot(vector, vector)).alias("ss"), *[F.sum(x(i)).alias(f"s{i}") for i in range(width)])
    square = sum(((F.col(f"s{i}") * F.col(f"s{i}")) for i in range(width)), F.lit(0.0))
    one = per.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum("ss").alias("ss"), F.sum(square / F.col("n")).alias("means"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    between, within = F.col("means") - square / F.col("N"), F.col("ss") - F.col("means")
    return one.select(((between / (F.col("k") - 1)) / (within / (F.col("N") - F.col("k")))).alias("calinski_harabasz"), within.alias("within"), between.alias("between"))


def silhouette(df: DataFrame, cluster: str, vector: str, width: int = 64) -> DataFrame:
    """One row ``silhouette``: the mean over all vectors by cosine distance, exact, from each cluster's sum of unit vectors: no pairs are formed.

    The clusters' sums travel in one array, checked to be few; a vector alone in its cluster scores 0, vectors of length 0 take no part.
    """
    unit = df.withColumn("__u", l2_normalise(vector)).filter(norm(vector) > 0).select(F.col(cluster).alias("c"), "__u")
    sums = unit.groupBy("c").agg(F.count("*").alias("n"), *[F.sum(F.col("__u")[i]).alias(f"s{i}") for i in range(width)])
    packed = sums.select("c", "n", F.array(*[f"s{i}" for i in range(width)]).alias("s"))
    held = packed.limit(FEW_CLUSTERS + 1).collect()
    if len(held) > FEW_CLUSTERS:
        raise ValueError(f"more than {FEW_CLUSTERS} clusters")
    table = df.sparkSession.createDataFrame([([(r["c"], r["n"], r["s"]) for r in held],)], f"all array<struct<c:{dict(unit.dtypes)['c']},n:bigint,s:array<double>>>")
    far = F.transform("all", lambda x: F.struct(x["c"].alias("c"), x["n"].alias("n"), dot("__u", x["s"]).alias("t")))
    met = unit.join(F.broadcast(table)).select("c", far.alias("far"))
    own = F.filter("far", lambda x: x["c"] == F.col("c"))[0]
    a = F.when(own["n"] > 1, (own["n"] - own["t"]) / (own["n"] - 1))
    b = F.array_min(F.transform(F.filter("far", lambda x: x["c"] != F.col("c")), lambda x: 1 - x["t"] / x["n"]))
    return met.select(F.coalesce((b - a) / F.greatest(a, b), F.lit(0.0)).alias("s")).agg(F.avg("s").alias("silhouette"))


def davies_bouldin(df: DataFrame, cluster: str, vector: str, width: int = 64) -> DataFrame:
    """One row ``davies_bouldin``: the mean over clusters of the worst ratio of two clusters' spreads to the distance of their centroids. Clusters are compared in pairs."""
    c = centroids(df, cluster, vector, width).select(F.col(cluster).alias("c"), "centroid")
    spread = df.join(c, F.col(cluster) == F.col("c")).groupBy("c").agg(F.avg(l2_distance(vector, "centroid")).alias("spread"))
    placed = c.join(spread, "c")
    a, b = placed.toDF("a", "xa", "sa"), placed.toDF("b", "xb", "sb")
    ratio = (F.col("sa") + F.col("sb")) / l2_distance("xa", "xb")
    return a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def distance_histogram(pairs: DataFrame, vectors: DataFrame, by: Sequence[str], a: str, b: str, bins: int = 100, least: int = 10) -> DataFrame:
    """``(by..., bin, n, weight)`` of the cosine of each pair's vectors ``(id, vec)``: ``bins`` of equal width from -1 to 1, their share of the group; bins of ``least`` members or fewer are suppressed."""
    met = pairs.join(vectors.select(F.col("id").alias(a), F.col("vec").alias("__a")), a).join(vectors.select(F.col("id").alias(b), F.col("vec").alias("__b")), b)
    place = F.least(F.floor((F.round(cosine("__a", "__b"), 6) + 1) / 2 * bins), F.lit(bins - 1)).cast("int")
    counts = met.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.col("n") / F.sum("n").over(W.partitionBy(*by))).filter(F.col("n") > least)


def probability_gap(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, mean_1, mean_0, gap)``: mean score of the positives and of the others, and how far they are apart."""
    mean = lambda v: F.avg(F.when(F.col(label) == v, F.col(score)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), mean(1).alias("mean_1"), mean(0).alias("mean_0"), (mean(1) - mean(0)).alias("gap"))


def binomial_bound(n: int, errors: int, delta: float) -> float:
    """The largest error rate at which so few errors are seen with a chance of ``delta``: found by halving, from the exact binomial sum."""
    if n == 0 or errors >= n:
        return 1.0
    fact = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(errors + 1)]
    chance = lambda p: sum(math.exp(c + k * math.log(p) + (n - k) * math.log1p(-p)) for k, c in enumerate(fact))
    low, high = max(errors / n, 1e-12), 1.0 - 1e-12
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chance(mid) > delta else (low, mid)
    return (low + high) / 2


def selective_risk(df: DataFrame, score: str, error: str, thresholds: Sequence[float], delta: float = 0.05) -> DataFrame:
    """``(threshold, n, errors, coverage, risk, bound)``: of the rows scored at least so high, the share in error and a bound that holds with ``1 - delta``."""
    t = df.select(score, error, F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    hit = F.col(score) >= F.col("threshold")
    rows = t.groupBy("threshold").agg(F.sum(hit.cast("bigint")).alias("n"), F.sum((hit & (F.col(error) == 1)).cast("bigint")).alias("errors"), F.count("*").alias("all")).collect()  # one for each threshold
    told = [(r["threshold"], r["n"], r["errors"], r["n"] / r["all"], r["errors"] / max(r["n"], 1), binomial_bound(r["n"], r["errors"], delta)) for r in rows]
    return df.sparkSession.createDataFrame(told, "threshold double, n bigint, errors bigint, coverage double, risk double, bound double")


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 7, rounds: int = 20) -> DataFrame:
    """``df`` with ``cluster``: k-means over all vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("__x", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__x", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("__x")


def mean_pair_cosine(df: DataFrame, cluster: str, vector: str, width: int = 64) -> DataFrame:
    """``(a, b, mean_cosine)``: mean cosine of the pairs within a cluster (a = b) and between two; from sums of unit vectors, without forming pairs."""
    unit = df.withColumn("__n", norm(vector)).filter("__n > 0")
    sums = unit.groupBy(cluster).agg(F.count("*").alias("n"), *[F.sum(F.col(vector)[i].cast("double") / F.col("__n")).alias(f"s{i}") for i in range(width)])
    packed = sums.select(F.col(cluster).alias("c"), "n", F.array(*[f"s{i}" for i in range(width)]).alias("s"))
    a, b = packed.toDF("a", "na", "sa"), packed.toDF("b", "nb", "sb")
    prod = dot("sa", "sb")
    mean = F.when(F.col("a") == F.col("b"), (prod - F.col("na")) / (F.col("na") * (F.col("na") - 1))).otherwise(prod / (F.col("na") * F.col("nb")))
    return a.join(b, F.col("a") <= F.col("b")).select("a", "b", mean.alias("mean_cosine"))


def confusion(df: DataFrame, label: str, score: str, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``(threshold, by..., tp, fp, tn, fn)``: all thresholds in one pass."""
    t = df.select(*by, label, score, F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    hit, true = F.col(score) >= F.col("threshold"), F.col(label) == 1
    count = lambda c: F.sum(c.cast("int"))
    return t.groupBy("threshold", *by).agg(count(hit & true).alias("tp"), count(hit & ~true).alias("fp"), count(~hit & ~true).alias("tn"), count(~hit & true).alias("fn"))


def pu_metrics(tp: Column, fp: Column, tn: Column, fn: Column, alpha: float, beta: float) -> dict[str, Column]:
    """Corrected for positives among the unlabelled: ``alpha`` their share there, ``beta`` the share of negatives among the labelled."""
    recall, false_ = tp / (tp + fn), fp / (fp + tn)
    scale = 1 - alpha - beta
    tpr, fpr = ((1 - alpha) * recall - beta * false_) / scale, ((1 - beta) * false_ - alpha * recall) / scale
    prior = (tp + fn) / (tp + fp + tn + fn)
    positive = prior * (1 - beta) + (1 - prior) * alpha
    precision = tpr * positive / (tpr * positive + fpr * (1 - positive))
    told = (tp + fp) / (tp + fp + tn + fn)
    mcc = F.sqrt(positive * (1 - positive) / (told * (1 - told))) * (tpr - fpr)
    return {"f1": 2 * precision * tpr / (precision + tpr), "balanced_accuracy": (1 + tpr - fpr) / 2, "mcc": mcc}


def area_under_lift(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row ``aul``: (pairs of a positive and any row it outranks, ties half) / (positives x rows), from counts of the distinct scores."""
    from .ranking import global_order

    counts = df.groupBy(score).agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("int")).alias("p"))
    ordered = global_order(counts, score, count="n")
    return ordered.agg((F.sum(F.col("p") * (F.col("before") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("aul"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse frequencies that sum to 1."""
    inverse = df.groupBy(label).agg((1 / F.count("*")).alias("w"))
    return inverse.select(label, (F.col("w") / F.sum("w").over(W.partitionBy())).alias("weight"))
