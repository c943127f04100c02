"""Percentiles of very large columns with bounded rank error (problem 1).

A summary is a sorted list of tuples ``(value, below, least, most)``: at most ``below`` amounts are smaller than
the value, and between ``least`` and ``most`` are smaller or equal. Summaries are built per partition, thinned
as far as the permitted uncertainty allows, and merged upward (partition, delivery day, month, group). The
uncertainty that merging and thinning add up to stays in the tuples, so each answer carries its own bound.
A summary can also be taken away from another: that is how a later delivery replaces an amount.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Permitted rank error as a share of the amounts summarised.
EPS = 0.001
#: Amounts that mean "missing" or "ineligible".
MISSING = (9999999999.0, 8888888888.0)
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Summaries of a key that a task holds before it merges them.
FAN_IN = 32
#: Amounts a task holds before it summarises them.
BUFFER = 1_000_000

SUMMARY = ("value", "below", "least", "most", "n")
_FIELDS = "value array<double>, below array<long>, least array<long>, most array<long>, n long"
Summary = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]


def exact(values: np.ndarray) -> Summary:
    """The summary without uncertainty."""
    v, counts = np.unique(np.asarray(values, dtype=np.float64), return_counts=True)
    upto = np.cumsum(counts)
    return v, upto - counts, upto, upto, int(counts.sum())


def merge(parts: Sequence[Summary], signs: Sequence[int] | None = None) -> Summary:
    """Sum of summaries, those of sign -1 taken away. Uncertainties of the parts add up."""
    signs = signs or [1] * len(parts)
    v = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.empty(0)
    below, least, most = (np.zeros(len(v), np.int64) for _ in range(3))
    total = 0
    for (pv, pb, pl, pm, n), sign in zip(parts, signs):
        at, after = np.searchsorted(pv, v, "left"), np.searchsorted(pv, v, "right")
        here = at < after
        pb_, pl_ = np.r_[pb, n], np.r_[0, pl]
        # least: of the last tuple up to v; most: of the tuple at v, else what lies below the next tuple
        lo, hi = pl_[after], np.where(here, np.r_[pm, n][np.minimum(at, len(pv))], pb_[at])
        blo, bhi = pl_[at], pb_[at]  # bounds of what is smaller than v
        if sign > 0:
            below, least, most = below + bhi, least + lo, most + hi
        else:
            below, least, most = below - blo, least - hi, most - lo
        total += sign * n
    least = np.maximum.accumulate(np.clip(least, 0, total)) if len(v) else least
    most = np.minimum.accumulate(np.clip(most, 0, total)[::-1])[::-1] if len(v) else most
    below = np.minimum.accumulate(np.clip(below, 0, total)[::-1])[::-1] if len(v) else below
    return v, below, least, most, total


def thin(s: Summary, eps: float) -> Summary:
    """Drop tuples as long as no gap between neighbours leaves more than ``2 * eps * n`` ranks open."""
    v, below, least, most, n = s
    room, size = 2 * eps * n, len(v)
    if size < 3 or room < 1:
        return s
    keep, i = [0], 0
    while i < size - 1:
        i = max(i + 1, int(np.searchsorted(below, least[i] + room, "right")) - 1)
        keep.append(min(i, size - 1))
    k = np.array(keep)
    return v[k], below[k], least[k], most[k], n


def query(s: Summary, q: float) -> tuple[float, int]:
    """The amount of rank ``ceil(q * n)`` (1 at least) and the largest rank error it can have; NaN if empty."""
    v, below, least, most, n = s
    if n <= 0 or not len(v):
        return float("nan"), 0
    rank = max(1, int(np.ceil(q * n - 1e-9)))
    error = np.maximum(0, np.maximum(rank - least, below + 1 - rank))
    best = int(np.argmin(error))
    return float(v[best]), int(error[best])


def _row(s: Summary) -> list:
    return [s[0].tolist(), s[1].tolist(), s[2].tolist(), s[3].tolist(), s[4]]


def _summary(row) -> Summary:
    return np.asarray(row.value, np.float64), *(np.asarray(x, np.int64) for x in (row.below, row.least, row.most)), int(row.n)  # type: ignore[return-value]


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _leaf(keys: list[str], eps: float):
    """Map-side: one thinned summary for each key of every BUFFER amounts that a partition holds.

    All keys are summarised at once by one sort; only those with amounts enough to be thinned are taken up one by one.
    """

    def summarise(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = np.zeros(len(rows), np.int64)
        for k in keys:
            own, _ = pd.factorize(rows[k].to_pandas(), use_na_sentinel=False)
            codes = codes * (int(own.max()) + 1) + own
        amount = rows["amount"].to_numpy()
        order = np.lexsort((amount, codes))
        c, v = codes[order], amount[order]
        new_key = np.r_[True, c[1:] != c[:-1]]
        new = new_key | np.r_[True, v[1:] != v[:-1]]
        begin = np.flatnonzero(new)  # where a value of a key begins
        key_of = np.cumsum(new_key)[begin] - 1
        key_at = np.flatnonzero(new_key)
        n = np.diff(np.r_[key_at, len(c)])
        below = begin - key_at[key_of]
        upto = np.r_[begin[1:], len(c)] - key_at[key_of]
        value, offsets = v[begin], np.searchsorted(key_of, np.arange(len(key_at) + 1))
        large = 2 * eps * n >= 1
        first = rows.take(pa.array(order[key_at])).select(keys)
        small = np.flatnonzero(~large)
        if len(small):
            keep = ~large[key_of]
            ends = np.r_[0, np.cumsum(np.diff(offsets)[small])]
            parts = [_lists(ends, x[keep], t) for x, t in ((value, pa.float64()), (below, pa.int64()), (upto, pa.int64()), (upto, pa.int64()))]
            yield from pa.table([*first.take(pa.array(small)).columns, *parts, pa.array(n[small], pa.int64())], names=[*keys, *SUMMARY]).to_batches(max_chunksize=10_000)
        for k in np.flatnonzero(large):
            cut = slice(offsets[k], offsets[k + 1])
            s = thin((value[cut], below[cut], upto[cut], upto[cut], int(n[k])), eps)
            parts = [_lists(np.array([0, len(x)]), x, t) for x, t in zip(s[:4], (pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
            yield from pa.table([*first.slice(k, 1).columns, *parts, pa.array([s[4]], pa.int64())], names=[*keys, *SUMMARY]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= BUFFER:
                yield from summarise(pa.Table.from_batches(held))
                held, count = [], 0
        if held:
            yield from summarise(pa.Table.from_batches(held))

    return run


def _rolled_up(df: DataFrame, keys: list[str], types: str, eps: float | None, signed: bool = False) -> DataFrame:
    """Reduce-side: all summaries of a key to one. A task merges every FAN_IN that it holds of a key."""
    names = [*keys, "value", "below", "least", "most", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[tuple[Summary, int]]] = {}

        def one(parts: list[tuple[Summary, int]]) -> Summary:
            added = [s for s, sign in parts if sign > 0]
            taken = [s for s, sign in parts if sign < 0]
            return merge(added + taken, [1] * len(added) + [-1] * len(taken)) if len(parts) > 1 or taken else parts[0][0]

        alone: dict[tuple, tuple] = {}  # keys with one summary so far, which may be all there is: passed on as it came

        def add(key: tuple, row: tuple) -> None:
            parts = held.setdefault(key, [])
            parts.append((_summary(row), row.sign if signed else 1))
            if len(parts) >= FAN_IN:  # those to be taken away are kept apart until all are there
                for sign in (1, -1):
                    if len(same := [s for s, x in parts if x == sign]) >= FAN_IN // 2:
                        parts[:] = [(merge(same), sign), *(x for x in parts if x[1] != sign)]

        for pdf in batches:
            for key, row in zip(zip(*(pdf[k] for k in keys)), pdf.itertuples(index=False)):
                if key in held:
                    add(key, row)
                elif key in alone:
                    add(key, alone.pop(key))
                    add(key, row)
                else:
                    alone[key] = row
        rows = []
        for key, row in alone.items():
            if (signed and row.sign < 0) or (eps and 2 * eps * row.n >= 1 and len(row.value) >= 3):
                add(key, row)
            else:
                rows.append([*key, row.value, row.below, row.least, row.most, row.n])
        rows += [[*key, *_row(thin(s, eps) if eps else s)] for key, s in ((k, one(p)) for k, p in held.items())]
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return df.repartition(*keys).mapInPandas(run, f"{types}, {_FIELDS}")


def in_force(df: DataFrame, entity: str, group: str, amount: str, delivered: str, missing: Sequence[float] = MISSING) -> DataFrame:
    """``(grp, day, sign, amount)``: what each delivery day adds to a group and what it takes away.

    A delivery replaces the amount that the same entity and group had before. Only real amounts take part: null,
    NaN, infinite and ``missing`` ones, and rows without group or delivery time, are left out and replace nothing;
    zeros and negative amounts are real. Of several deliveries at the same time the largest amount counts. Rows
    without entity replace nothing and are all counted. Rows of one entity and group are reduced to one per day first.
    """
    real = df.select(
        F.col(entity).alias("e"), F.col(group).cast("int").alias("grp"), F.col(amount).cast("double").alias("amount"), F.col(delivered).alias("at")
    ).filter(F.col("grp").isNotNull() & F.col("at").isNotNull() & F.col("amount").isNotNull() & ~F.isnan("amount") & (F.abs("amount") != float("inf")) & ~F.col("amount").isin(list(missing)))
    known = real.filter("e is not null").groupBy("e", "grp", F.to_date("at").alias("day")).agg(F.max(F.struct("at", "amount"))["amount"].alias("amount"))
    before = F.lag("amount").over(W.partitionBy("e", "grp").orderBy("day"))
    one = lambda sign, c: F.struct(F.lit(sign).alias("sign"), c.alias("amount"))
    changes = known.withColumn("before", before).select(
        "grp", "day", F.inline(F.when(F.col("before").isNull(), F.array(one(1, F.col("amount")))).otherwise(F.array(one(1, F.col("amount")), one(-1, F.col("before")))))
    )
    loose = real.filter("e is null").select("grp", F.to_date("at").alias("day"), F.lit(1).alias("sign"), "amount")
    return changes.unionByName(loose)


def daily_summaries(changes: DataFrame, eps: float = EPS) -> DataFrame:
    """``(grp, day, sign, value, below, least, most, n)``: one mergeable summary per group, delivery day and sign.

    This table is what is kept: days can be added to it and combined in any choice. Each partition first makes
    its own summaries, so of a group of any size only those travel.
    """
    keys = ["grp", "day", "sign"]
    leaves = changes.select(*keys, "amount").mapInArrow(_leaf(keys, eps / 3), f"grp int, day date, sign int, {_FIELDS}")
    spread = leaves.withColumn("bucket", F.spark_partition_id() % 64)
    first = _rolled_up(spread, ["bucket", *keys], "bucket int, grp int, day date, sign int", eps / 3)
    return _rolled_up(first, keys, "grp int, day date, sign int", 2 * eps / 3)


def combine(daily: DataFrame, eps: float = EPS) -> DataFrame:
    """``(grp, value, below, least, most, n)``: days to months, months to groups."""
    months = _rolled_up(daily.withColumn("month", F.date_trunc("month", "day").cast("date")), ["grp", "month", "sign"], "grp int, month date, sign int", 2 * eps / 3)
    return _rolled_up(months, ["grp"], "grp int", None, signed=True)


def percentiles(summaries: DataFrame, qs: Sequence[float] = PERCENTILES) -> DataFrame:
    """``(grp, percentile, amount, n, max_rank_error)`` from :func:`combine`; the error is at most ``eps * n`` plus that of replaced rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [[int(r.grp), q, *query(s := _summary(r), q), s[4]] for r in pdf.itertuples() for q in qs if r.n > 0]
            yield pd.DataFrame(rows, columns=["grp", "percentile", "amount", "max_rank_error", "n"])

    return summaries.mapInPandas(run, "grp int, percentile double, amount double, max_rank_error long, n long")


def group_percentiles(df: DataFrame, entity: str, group: str, amount: str, delivered: str, qs: Sequence[float] = PERCENTILES, eps: float = EPS) -> DataFrame:
    """Percentiles of the amounts in force for each group; an empty table gives no rows."""
    return percentiles(combine(daily_summaries(in_force(df, entity, group, amount, delivered), eps), eps), qs)


def rank_error_share(result: DataFrame) -> Column:
    return result["max_rank_error"] / result["n"]
