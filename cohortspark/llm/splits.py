"""Splits that keep related records together (problem 2).

Records and their entities form a bipartite graph. The smallest label travels from entities to records and
back until nothing changes, with pointer jumping so that long chains take few rounds. The groups found are
then given to splits so that the label distributions deviate as little as possible.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import Stage

#: Name and share of each split.
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Rounds after which propagation counts as failed. With jumps a chain of any real length needs about its logarithm.
MAX_ROUNDS = 60
#: Records of an entity beyond which its ties are cut into parts.
HOT = 1_000_000
#: Counts up to this are told apart exactly when groups are classed, larger ones in steps of 1/16.
EXACT_COUNT = 32
#: Parts into which the groups of a class are cut to be ranked.
SALTS = 64


def components(incidence: DataFrame, hot: int = HOT) -> DataFrame:
    """``(entity, label)`` from ``(record, entity)``: the smallest entity tied to each, directly or through others.

    Entities are longs, records of any type that compares. Rows with a null on either side are left out, repeated rows change
    nothing, an empty table gives an empty one. A record with a single entity ties nothing but the entity has a row. Labels are
    minima, so they are combined before they travel, however many records an entity has; the ties of an entity with more than
    ``hot`` records are cut into parts that each meet a copy of its label.
    """
    given = incidence.select("record", "entity").filter("record is not null and entity is not null").distinct()
    degrees = Stage(given, "ties")
    # one row of this list for every `hot` ties at most
    hubs = F.broadcast(degrees.df.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("entity", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    salted = degrees.df.join(hubs, "entity", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    ties = salted.select("record", "entity", F.pmod(F.xxhash64("record"), "parts").cast("int").alias("part"))
    entities = salted.groupBy("entity").agg(F.first("parts").alias("parts"))
    held = Stage(entities.select("entity", "parts", F.col("entity").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        labels = held.df.select("entity", "parts", "label")
        copies = labels.select("entity", "parts", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        met = ties.join(copies, ["entity", "part"])
        by_record = met.groupBy("record").agg(F.min("label").alias("least"))
        heard = met.join(by_record, "record").groupBy("entity").agg(F.min("least").alias("heard"), F.first("label").alias("label"), F.first("parts").alias("parts"))
        jump = labels.select(F.col("entity").alias("at"), F.col("label").alias("further"))
        # the label of the label heard belongs to the same component, and is often a much smaller one
        moved = heard.join(jump, F.col("heard") == F.col("at"), "left").withColumn("new", F.least("heard", "further"))
        new = Stage(moved.select("entity", "parts", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels")
        held.release()
        held = new
        if new.df.filter("moved").isEmpty():
            degrees.release()
            return new.df.select("entity", "label")
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")


def _class_of(c):
    """Counts as they are up to EXACT_COUNT, then in relative steps."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(c)) - 4)
    return F.when(c <= EXACT_COUNT, c).otherwise((F.floor(c / step) * step).cast("long"))


def quotas(counts: np.ndarray, groups: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """How many groups of each class go to each split.

    ``counts``: mean label counts of each class's groups; ``groups``: how many groups it has. Classes are taken
    from the largest groups down. Each is divided so that the label totals come as near as they can to their
    shares of all that has been divided (least squares, each label weighted by its total), what whole groups leave over goes one by one to
    the split that then deviates least.
    """
    p, (k, labels) = np.asarray(shares, float), counts.shape
    scale = 1.0 / np.maximum((counts * groups[:, None]).sum(0), 1)
    v_all = counts * scale
    now, out, seen = np.zeros((len(p), labels)), np.zeros((k, len(p)), np.int64), np.zeros(labels)
    for c in np.argsort(-v_all.sum(1), kind="stable"):
        v, m = v_all[c], int(groups[c])
        seen = seen + m * v
        want = np.outer(p, seen) - now
        x = want @ v / max(v @ v, 1e-300)
        for _ in range(len(p)):  # onto x >= 0, sum m
            free = x > 0
            x = np.where(free, x, 0)
            if free.any():
                x = np.where(free, x + (m - x.sum()) / free.sum(), 0)
        x = np.maximum(x, 0) if x.sum() > 0 else p * m
        whole = np.floor(x * m / x.sum() + 1e-9).astype(np.int64)
        now = now + np.outer(whole, v)
        for _ in range(m - int(whole.sum())):
            gain = ((want_left := np.outer(p, seen) - now) @ v) - 0.5 * (v @ v)
            best = int(np.argmax(gain / np.maximum(p, 1e-9) if np.allclose(want_left, 0) else gain))
            whole[best] += 1
            now[best] += v
        out[c] = whole
    return out


def assign(groups: DataFrame, labels: Sequence[str], splits: Sequence[tuple[str, float]] = SPLITS, seed: int = 7) -> DataFrame:
    """``(label, split)`` from ``(label, <count columns>)``, one row per group.

    Groups with equal (large ones: nearly equal) counts form a class. Their number is bounded by the counts'
    steps and not by the data, so only it goes to the driver. Which groups of a class go where is decided by a hash.
    Ranks within a class are taken in parts with their offsets, so a class may hold most groups.
    """
    names = list(labels)
    classed = groups.withColumn("cls", F.concat_ws("|", *[_class_of(F.coalesce(F.col(c), F.lit(0))).cast("string") for c in names]))
    order = F.xxhash64(F.col("label"), F.lit(seed))
    placed = classed.withColumns({"ord": order, "salt": F.pmod(F.shiftrightunsigned(order, 7), F.lit(SALTS)).cast("int")})
    sizes = placed.groupBy("cls", "salt").agg(F.count("*").alias("m"), *[F.sum(c).alias(c) for c in names])
    offsets = sizes.select("cls", "salt", (F.sum("m").over(W.partitionBy("cls").orderBy("salt")) - F.col("m")).alias("off"))
    totals = sizes.groupBy("cls").agg(F.sum("m").alias("m"), *[F.sum(c).alias(c) for c in names]).orderBy("cls").collect()
    spark = groups.sparkSession
    if not totals:
        return groups.select("label", F.lit("").alias("split")).limit(0)
    m = np.array([r["m"] for r in totals], np.int64)
    mean = np.array([[float(r[c] or 0) for c in names] for r in totals]) / m[:, None]
    upto = np.cumsum(quotas(mean, m, [s for _, s in splits]), axis=1)
    bounds = spark.createDataFrame([(r["cls"], [int(x) for x in u]) for r, u in zip(totals, upto)], "cls string, upto array<long>")
    rank = F.row_number().over(W.partitionBy("cls", "salt").orderBy("ord", "label")) - 1
    ranked = placed.select("label", "cls", "salt", rank.alias("r")).join(offsets, ["cls", "salt"]).join(bounds, "cls")
    named = F.array(*[F.lit(n) for n, _ in splits])
    passed = F.size(F.filter("upto", lambda u: u <= F.col("r") + F.col("off")))
    return ranked.select("label", F.element_at(named, passed + 1).alias("split"))


def tied_groups(entities: DataFrame, ties: DataFrame) -> DataFrame:
    """``(entity, label)``: each entity once, with the smallest entity of its group.

    ``entities``: ``entity``; ``ties``: ``(a, b)``, where rows with a null, with a = b or with an entity that isn't in
    ``entities`` tie nothing and repeated rows change nothing. An entity without ties is a group of its own.
    """
    known = entities.filter("entity is not null").distinct()
    real = ties.filter("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = real.join(known.select(F.col("entity").alias("a")), "a", "left_semi").join(known.select(F.col("entity").alias("b")), "b", "left_semi")
    incidence = both.select(F.struct("a", "b").alias("record"), F.explode(F.array("a", "b")).alias("entity"))
    found = components(incidence)
    return Stage(known.join(found, "entity", "left").select("entity", F.coalesce("label", "entity").alias("label")), "groups").df


def balanced_splits(groups: DataFrame, labelled: DataFrame, splits: Sequence[tuple[str, float]] = SPLITS, seed: int = 7) -> DataFrame:
    """``(entity, label, split)`` from :func:`tied_groups` and ``labelled``.

    ``labelled``: ``(entity, value)`` rows whose counts of 0, of 1 and of anything else are to be balanced along with
    the number of entities; entities without such rows are assigned too.
    """
    kinds = (("zeros", F.col("value") == 0), ("ones", F.col("value") == 1), ("others", F.col("value").isNull() | ~F.col("value").isin(0, 1)))
    of = labelled.groupBy("entity").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in kinds])
    counted = groups.join(of, "entity", "left").groupBy("label").agg(F.count("*").alias("members"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n, _ in kinds])
    chosen = assign(Stage(counted, "groups").df, ["members", *[n for n, _ in kinds]], splits, seed)
    return groups.join(chosen, "label").select("entity", "label", "split")


def contested(groups: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(label, entity)`` of each group of two or more whose rows hold both a value of 0 and one of 1."""
    marks = labelled.filter("value in (0, 1)").groupBy("entity").agg(F.max((F.col("value") == 0).cast("int")).alias("zero"), F.max((F.col("value") == 1).cast("int")).alias("one"))
    both = groups.join(marks, "entity", "left").groupBy("label").agg(F.count("*").alias("n"), F.max("zero").alias("zero"), F.max("one").alias("one"))
    return groups.join(both.filter("n >= 2 and zero = 1 and one = 1").select("label"), "label", "left_semi")
