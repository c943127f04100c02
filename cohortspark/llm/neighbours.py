"""The most similar vectors of every vector (problem 3), by learned partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .learned_index import BLOCK
from .vectors import Copies, fit_tree, in_cells, sound_vectors, to_cells

#: Parts a query is sent to: of a full list of neighbours, and where only close ones (cosine 0.8 and more) are asked for.
PROBES, CLOSE_PROBES = 8, 3


def _best(k: int, least: float | None):
    """Each query's k best of a cell, equal similarities by smaller id; with ``least`` only those that reach it."""

    def work(iid, itag, ix, qid, qtag, qx):
        rows, cols, sims = [], [], []
        for b in range(0, len(qid) if len(iid) else 0, BLOCK):
            s = qx[b : b + BLOCK] @ ix.T
            at = np.searchsorted(iid, qid[b : b + BLOCK])
            own = np.flatnonzero((at < len(iid)) & (iid[np.minimum(at, len(iid) - 1)] == qid[b : b + BLOCK]))
            s[own, at[own]] = -np.inf
            if least is None:
                wide = np.arange(len(s))
            else:
                hit = s >= least - 5e-7
                count = hit.sum(1)
                wide = np.flatnonzero(count > 4 * k)
                hit[wide] = False
                r, c = np.nonzero(hit)
                rows.append(r + b), cols.append(c), sims.append(s[r, c])
            if len(wide):
                n = min(k, len(iid))
                top = np.argpartition(s[wide], len(iid) - n, axis=1)[:, -n:]
                r, c = np.repeat(wide, n), top.ravel()
                rows.append(r + b), cols.append(c), sims.append(s[r, c])
        r, c, s = (np.concatenate(a) if a else np.empty(0, t) for a, t in ((rows, np.int64), (cols, np.int64), (sims, np.float32)))
        fine = np.isfinite(s)
        r, c, s = r[fine], c[fine], np.round(np.minimum(s[fine].astype(np.float64), 1.0), 6)
        order = np.lexsort((iid[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        first = np.searchsorted(r, r, "left")
        keep = np.arange(len(r)) - first < k
        return qid[r[keep]], iid[c[keep]], s[keep]

    return work


def neighbours(
    df: DataFrame, entity: str, vector: str, k: int = 10, dim: int = 64, least: float | None = None, is_query: Column | None = None, probes: int | None = None
) -> DataFrame:
    """``(id, neighbour, similarity)``: the k most similar other entities of each entity with a sound vector.

    Similarity is the cosine, rounded to 6 places; equal ones are taken by smaller id. ``least`` leaves out pairs below it
    (a pair that reaches it is among the k best if it is among those k that reach it, so nothing else is lost).
    ``is_query`` chooses whose neighbours are sought, among all. Copies of a vector are searched once and then stand
    for each of their entities. Rows without a sound vector neither ask nor answer; an empty table gives no rows.
    """
    probes = probes or (PROBES if least is None or least < 0.8 else CLOSE_PROBES)
    copies = Copies(sound_vectors(df, entity, vector, dim, is_query))
    reps = copies.reps
    tree = fit_tree(reps, dim)
    total = reps.count()
    cells = to_cells(reps.select("id", F.col("id").alias("tag"), "vec", F.lit(True).alias("is_index"), "is_query"), tree, total, probes, dim)
    near = in_cells(cells, _best(k, least), "id long, neighbour long, similarity double", ["id", "neighbour", "similarity"], dim)
    rank = lambda by: F.row_number().over(W.partitionBy(by).orderBy(F.desc("similarity"), "neighbour"))
    best = near.withColumn("r", rank("id")).filter(F.col("r") <= k).drop("r")

    members = copies.shared_members()
    few = members.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1).select("rep", F.col("id").alias("member"))
    spread = best.join(few, best["neighbour"] == few["rep"], "left").select("id", F.coalesce("member", "neighbour").alias("neighbour"), "similarity")
    own = few.select(F.col("rep").alias("id"), F.col("member").alias("neighbour"), F.lit(1.0).alias("similarity"))
    listed = spread.unionByName(own).withColumn("r", rank("id")).filter(F.col("r") <= k + 1).drop("r")
    each = members.toDF("rep", "each")
    of_all = listed.join(each, listed["id"] == each["rep"], "left").select(F.coalesce("each", "id").alias("id"), "neighbour", "similarity")
    others = of_all.filter("id != neighbour").distinct()
    if is_query is not None:
        others = others.join(df.filter(is_query).select(F.col(entity).cast("long").alias("id")).distinct(), "id", "left_semi")
    return others.withColumn("r", rank("id")).filter(F.col("r") <= k).drop("r")


def close_pairs(near: DataFrame) -> DataFrame:
    """``(a, b)``, a < b, from :func:`neighbours`, each pair once."""
    return near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
