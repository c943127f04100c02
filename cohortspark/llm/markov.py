"""Clusters of mutually similar records by Markov clustering (problem 4).

Vectors are first gathered around leaders within the blocks of a learned index: that keeps the similarity graph
sparse in dense regions, where the pairs of a cluster would grow as its square. Two leaders are linked if any members of
theirs are: a record that reaches the other leader shows it at once. On the graph of leaders the flow matrix is squared,
inflated and pruned, as sparse rows spread over the cluster, until it stays as it is. The rows of attractors define the clusters.
All that follows works on those clusters: links that the flow has cut join them to groups, and where only the triangle of
angles leaves a link between two groups possible, the members themselves are compared. The
members that are most similar to all others of their cluster represent it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import Stage
from .learned_index import RoutingTree
from .splits import components
from .vectors import Copies, binary, fit_tree, in_cells, matrix, sound_vectors, to_cells

#: Cosine from which two records are linked, and from which a record may join a leader.
LINK, JOIN = 0.80, 0.90
PROBES = 4
#: Rows of a block in which leaders are chosen, and of a group in one cell of the comparison of members.
BLOCK_ROWS = 4096
INFLATION = 2.0
#: Entries of a column that are kept, and the flow below which an entry is pruned.
KEEP, PRUNE = 24, 1e-4
#: Largest change of an entry in a round that counts as none, and rounds after which a flow that still changes is an error.
STILL, MAX_ROUNDS = 1e-3, 100
#: Slack for rounding where angles are compared.
SLACK = 1e-5


def _leaders(join: float):
    """Greedy: the first record free becomes a leader, all free ones similar enough join it. Behind a leader's vector: the least cosine of its members."""

    def work(iid, itag, ix, qid, qtag, qx):
        leader, least = np.zeros(len(iid), np.int64), np.ones(len(iid), np.float32)
        free = np.arange(len(iid))
        while len(free):
            s = ix[free] @ ix[free[0]]
            near = s >= join
            near[0] = True
            leader[free[near]] = iid[free[0]]
            least[free[0]] = min(1.0, s[near].min())
            free = free[~near]
        return iid, leader, binary(np.c_[ix, least])

    return work


def _reached(link: float, least: np.ndarray) -> np.ndarray:
    """The cosine to a leader below which no member of it, the farthest being at ``least``, can be linked to a record."""
    angle = np.arccos(link) + np.arccos(np.clip(least, -1, 1))
    return np.where(angle >= np.pi, -1.0, np.cos(np.minimum(angle, np.pi))) - SLACK


def _leader_pairs(link: float):
    """For each leader of queries and each leader of the index that a member might be linked to: ``(from, to, strongest, members)``."""

    def work(iid, itag, ix, qid, qtag, qx):
        out = []
        floor = np.minimum(_reached(link, ix[:, -1]), link)
        for b in range(0, len(qid) if len(iid) else 0, 4096):
            s = qx[b : b + 4096, :-1] @ ix[:, :-1].T
            r, c = np.nonzero((s >= floor[None, :]) & (qtag[b : b + 4096][:, None] != iid[None, :]))
            if len(r):
                from_, at = np.unique(qtag[b : b + 4096][r], return_inverse=True)
                key, where = np.unique(at.astype(np.int64) * len(iid) + c, return_inverse=True)
                strongest = np.full(len(key), -1.0)
                np.maximum.at(strongest, where, s[r, c])
                out.append((from_[key // len(iid)], iid[key % len(iid)], strongest, np.bincount(where, s[r, c] >= link).astype(np.int64)))
        kinds = (np.int64, np.int64, np.float64, np.int64)
        return tuple(np.concatenate([o[k] for o in out]) if out else np.empty(0, kind) for k, kind in enumerate(kinds))

    return work


def gather(reps: DataFrame, tree: RoutingTree, total: int, dim: int = 64, join: float = JOIN) -> DataFrame:
    """``(id, leader, vec)`` for each of ``reps``, written to the shared folder; ``vec`` has one number more, see :func:`_leaders`."""
    rows = reps.select("id", F.col("id").alias("tag"), "vec", F.lit(True).alias("is_index"), F.lit(False).alias("is_query"))
    cells = to_cells(rows, tree, total, 1, dim, cell_rows=BLOCK_ROWS).filter("qi = 0")
    return Stage(in_cells(cells, _leaders(join), "id long, leader long, vec binary", ["id", "leader", "vec"], dim), "leaders").df


def leader_pairs(gathered: DataFrame, tree: RoutingTree, total: int, dim: int = 64, link: float = LINK) -> DataFrame:
    """``(a, b, strongest, members)``: leaders a < b whose members may be linked, with the largest cosine seen between a record and a leader.

    From ``link`` on they are linked; below it they can be, by the triangle of angles. Every record is compared with the leaders of its
    most probable parts.
    """
    rows = gathered.select("id", F.col("leader").alias("tag"), "vec", (F.col("id") == F.col("leader")).alias("is_index"), F.lit(True).alias("is_query"))
    cells = to_cells(rows, tree, total, PROBES, dim, extra=1)
    found = in_cells(cells, _leader_pairs(link), "a long, b long, strongest double, members long", ["a", "b", "strongest", "members"], dim + 1)
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("strongest").alias("strongest"), F.sum("members").alias("members"))


def member_links(pairs: DataFrame, gathered: DataFrame, dim: int = 64, link: float = LINK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b, strongest, members)`` of those of ``(a, b)`` of which a member of one is linked to one of the other: members are compared with members.

    Groups of any size are cut into blocks, and each block of a meets each of b, so a task holds two blocks.
    """
    blocks = gathered.groupBy("leader").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    sized = pairs.select("a", "b").join(blocks.toDF("a", "na"), "a").join(blocks.toDF("b", "nb"), "b")

    def side(own: str, other: str, role: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(f"n{own}")).cast("int")
        met = sized.join(gathered.select(F.col("leader").alias(own), "id", "vec"), own)
        each = met.select("a", "b", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias("theirs"), F.lit(role).alias("role"), "vec")
        return each.select("a", "b", *([F.col("mine").alias("i"), F.col("theirs").alias("k")] if role else [F.col("theirs").alias("i"), F.col("mine").alias("k")]), "role", "vec")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        role, x = table["role"].to_numpy(), matrix(table["vec"], dim + 1)[:, :dim]
        s = x[role == 1] @ x[role == 0].T
        hit = s >= link
        rows = [[key[0].as_py()], [key[1].as_py()], [float(s.max())], [int(hit.sum())]] if hit.any() else [[], [], [], []]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("a", "b", "strongest", "members"), rows, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))})

    cells = side("a", "b", 1).unionByName(side("b", "a", 0)).groupBy("a", "b", "i", "k")
    found = cells.applyInArrow(compare, "a long, b long, strongest double, members long")
    return found.groupBy("a", "b").agg(F.max("strongest").alias("strongest"), F.sum("members").alias("members"))


def cluster_groups(cut: DataFrame) -> DataFrame:
    """``(cluster, whole)`` of the clusters that links cut by the flow, ``(ca, cb)``, join: the smallest of each group."""
    return components(cut.select(F.struct("ca", "cb").alias("record"), F.explode(F.array("ca", "cb")).alias("entity"))).toDF("cluster", "whole")


def across(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """``pairs`` of leaders, with their clusters ``ca`` and ``cb``, that the flow has left in different ones."""
    a, b = (clusters.select(F.col("leader").alias(c), F.col("cluster").alias(f"c{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").filter("ca != cb")


def border_links(pairs: DataFrame, clusters: DataFrame, gathered: DataFrame, dim: int = 64, link: float = LINK) -> tuple[DataFrame, DataFrame | None]:
    """``(cluster, whole)`` as :func:`cluster_groups`, and the links ``(a, b, strongest, members)`` between members that :func:`leader_pairs` only holds possible; None if there are none.

    Pairs within a Markov cluster, and between clusters that cut links join anyway, need no comparison.
    """
    borders = Stage(across(pairs, clusters), "borders").df
    cut = borders.filter(F.col("strongest") >= link).select("ca", "cb")
    groups = cluster_groups(cut)
    of = lambda c: groups.toDF(f"c{c}", f"g{c}")
    apart = F.coalesce("ga", "ca") != F.coalesce("gb", "cb")
    open_ = borders.filter(F.col("strongest") < link).join(of("a"), "ca", "left").join(of("b"), "cb", "left").filter(apart).select("a", "b")
    more = Stage(member_links(open_, gathered, dim, link), "links").df
    if more.isEmpty():
        return groups, None
    return cluster_groups(cut.unionByName(across(more, clusters).select("ca", "cb"))), more


def markov_flow(links: DataFrame, comp: DataFrame | None = None, inflation: float = INFLATION, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(j, i, w)``: the share of j's flow that ends in i, from ``(a, b, weight)``. Self-loops of the column's strongest weight are added.

    ``comp``: ``(leader, comp)``, the components of the links, if they are known. Flow never leaves a component, so those that have become still take
    no part in further rounds; without it, all go on until all are still. An error is raised if any flow still changes after ``max_rounds``.
    """
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("j"), F.col("b").alias("i")), F.struct(F.col("b").alias("j"), F.col("a").alias("i")))).alias("e"), "weight").select("e.j", "e.i", F.col("weight").alias("w"))
    loops = both.groupBy("j").agg(F.max("w").alias("w")).select("j", F.col("j").alias("i"), "w")
    col = W.partitionBy("j")

    def normal(entries: DataFrame, power: float) -> DataFrame:
        """Inflate, prune and make each column sum to 1 again; ``moved``: by how much an entry has changed."""
        share = entries.withColumn("w", F.pow("w", F.lit(power))).withColumn("w", F.col("w") / F.sum("w").over(col))
        ranked = share.withColumn("r", F.row_number().over(col.orderBy(F.desc("w"), "i")))
        kept = ranked.withColumn("w", F.when((F.col("r") <= KEEP) & ((F.col("w") >= PRUNE) | (F.col("r") == 1)), F.col("w")).otherwise(0.0))
        new = F.col("w") / F.sum("w").over(col)
        return kept.select("comp", "j", "i", new.alias("w"), F.abs(new - F.col("old")).alias("moved"))

    entries = both.unionByName(loops).withColumn("old", F.lit(0.0))
    entries = entries.withColumn("comp", F.lit(0)) if comp is None else entries.join(comp.toDF("j", "comp"), "j")
    live = Stage(normal(entries, 1.0), "flow").df.filter("w > 0")
    done: list[DataFrame] = []
    for _ in range(max_rounds):
        onward = live.select(F.col("j").alias("k"), F.col("i").alias("to"), F.col("w").alias("v"))
        squared = live.join(onward, F.col("i") == F.col("k")).select("comp", "j", F.col("to").alias("i"), (F.col("w") * F.col("v")).alias("w"), F.lit(0.0).alias("old"))
        before = live.select("comp", "j", "i", F.lit(0.0).alias("w"), F.col("w").alias("old"))
        summed = squared.unionByName(before).repartition("j").groupBy("comp", "j", "i").agg(F.sum("w").alias("w"), F.sum("old").alias("old"))
        new = Stage(normal(summed, inflation), "flow").df
        moving = Stage(new.groupBy("comp").agg(F.max("moved").alias("moved")).filter(F.col("moved") > STILL).select("comp"), "moving").df
        live = new.filter("w > 0")
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, done, live.select("j", "i", "w"))
        if comp is not None:
            done.append(Stage(live.join(moving, "comp", "left_anti").select("j", "i", "w"), "settled").df)
            live = live.join(moving, "comp", "left_semi")
    raise RuntimeError(f"the flow still changes after {max_rounds} rounds")


def attractor_clusters(flow: DataFrame) -> DataFrame:
    """``(leader, cluster)``: attractors are the rows in which flow ends; a column belongs to the row that gets most of its flow, equal shares going to
    the smaller one. Rows that an attractor's own flow ends in are one system, named by the smallest."""
    most = flow.groupBy("j").agg(F.max(F.struct(F.round("w", 6).alias("w"), (-F.col("i")).alias("i")))["i"].alias("i"), F.min("i").alias("least"))
    most = Stage(most, "attractors").df
    ends = most.select(F.col("j").alias("leader"), (-F.col("i")).alias("attractor"))
    systems = most.select(F.col("j").alias("attractor"), F.col("least").alias("system"))
    return ends.join(systems, "attractor").select("leader", F.col("system").alias("cluster"))


def _numbers(dim: int):
    """The bytes of the last column as an array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(b.num_columns - 1), dim + 1)[:, :dim].astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], b.schema.names)

    return run


class Clustering:
    """Markov clusters of the sound vectors of a table.

    ``members``: ``(id, leader, cluster)`` of every entity with a sound vector, ``cluster`` being the smallest attractor of its
    Markov cluster; ``flow``: the limit of the flow matrix; ``links``: the graph; ``groups``: clusters joined over the cuts, ``(leader, whole)``. Where members
    alone link two groups, those links have their part in the flow too, which is then taken once more. Entities whose vectors are equal have the
    same cluster. Rows without a sound vector are left out; an empty table gives no members.
    """

    def __init__(self, df: DataFrame, entity: str, vector: str, dim: int = 64, link: float = LINK, join: float = JOIN, inflation: float = INFLATION):
        copies = Copies(sound_vectors(df, entity, vector, dim))
        tree = fit_tree(copies.reps, dim)
        total = copies.reps.count()
        gathered = gather(copies.reps, tree, total, dim, join)
        pairs = Stage(leader_pairs(gathered, tree, total, dim, link), "pairs").df
        self._leaders, self._inflation = gathered.select("leader").distinct(), inflation
        self.links = pairs.filter(F.col("strongest") >= link)
        self.clusters = self._flow_clusters()
        joined, more = border_links(pairs, self.clusters, gathered, dim, link)
        self.groups = Stage(self.clusters.join(joined, "cluster", "left").select("leader", F.coalesce("whole", "cluster").alias("whole")), "groups").df
        if more is not None:
            self.links = self.links.unionByName(more)
            self.clusters = self._flow_clusters()
        self._placed, self._dim = gathered.withColumnRenamed("id", "rep").join(self.clusters, "leader"), dim
        reps = self._placed.select("rep", "leader", "cluster")
        shared = copies.shared_members().withColumnRenamed("id", "member")
        self._shared = shared
        self.members = reps.join(shared, "rep", "left").select(F.coalesce("member", "rep").alias("id"), "leader", "cluster").distinct()

    def _flow_clusters(self) -> DataFrame:
        """``(leader, cluster)`` of all leaders, by the flow over ``links``."""
        self.flow = markov_flow(self.links.select("a", "b", F.col("strongest").alias("weight")), inflation=self._inflation)
        ends = attractor_clusters(self.flow)
        return Stage(self._leaders.join(ends, "leader", "left").select("leader", F.coalesce("cluster", "leader").alias("cluster")), "clusters").df

    def summary(self, typical: int = 3) -> DataFrame:
        """``(cluster_key, size, typical)``: smallest entity, entities, and those of all members whose similarities to all of the cluster sum to most, best first.

        The sum over a cluster is the product with the sum of its vectors, so no pairs are formed. Equal sums (to 6 places of
        their mean) are taken by smaller entity.
        """
        # a copy counts as often as there are entities with it
        copies = self._shared.groupBy("rep").agg(F.count("*").alias("n"))
        rows = self._placed.join(copies, "rep", "left").select("rep", "cluster", F.coalesce("n", F.lit(1)).alias("n"), "vec")
        held = Stage(rows.mapInArrow(_numbers(self._dim), "rep long, cluster long, n long, x array<double>"), "placed").df
        sums = held.groupBy("cluster").agg(F.sum("n").alias("all"), *[F.sum(F.col("x")[k] * F.col("n")).alias(f"s{k}") for k in range(self._dim)])
        whole = sums.select("cluster", "all", F.array(*[f"s{k}" for k in range(self._dim)]).alias("s"))
        near = F.aggregate(F.zip_with("x", "s", lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v) / F.col("all")
        scored = held.join(whole, "cluster").select("rep", "cluster", F.round(near, 6).alias("near"))
        each = scored.join(self._shared, "rep", "left").groupBy("cluster", F.coalesce("member", "rep").alias("id")).agg(F.max("near").alias("near"))
        best = each.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("near"), "id"))).filter(F.col("r") <= typical)
        top = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("top"))
        sizes = each.groupBy("cluster").agg(F.min("id").alias("cluster_key"), F.count("*").alias("size"))
        return sizes.join(top, "cluster").select("cluster_key", "size", F.concat_ws(",", F.transform("top", lambda t: t["id"])).alias("typical"))

    def joined(self, least: int = 3) -> DataFrame:
        """``(cluster_key, id)`` after an exact check of the cuts: Markov clusters between which a link exists are one, those of fewer entities than ``least`` are left out."""
        placed = self.members.join(self.groups, "leader").select("id", "whole")
        sizes = placed.groupBy("whole").agg(F.count_distinct("id").alias("n"), F.min("id").alias("cluster_key")).filter(F.col("n") >= least)
        return placed.join(sizes, "whole").select("cluster_key", "id").distinct()
