"""Ranks over a whole column without gathering it in one task.

Values are counted, the distinct ones are spread by range, and each range continues where the ones before it end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import Stage


def global_order(df: DataFrame, *by: str, count: str | None = None) -> DataFrame:
    """``df`` with ``position`` (rows up to and with this one in the order of ``by``) and ``before`` (summed ``count`` before it).

    Rows have to be distinct in ``by``. Without ``count`` each counts as one. The rows are written once, by range;
    only one sum for each range is combined across ranges.
    """
    n = F.col(count) if count else F.lit(1)
    spread = Stage(df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges").df
    sums = spread.groupBy("__range").agg(F.sum(n).alias("__sum"), F.count("*").alias("__rows"))
    over = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__s"), F.coalesce(F.sum("__rows").over(over), F.lit(0)).alias("__r"))
    within = W.partitionBy("__range").orderBy(*by)
    upto = F.sum(n).over(within.rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = spread.withColumns({"__p": F.row_number().over(within), "__u": upto - n}).join(starts, "__range")
    return ranked.withColumns({"position": (F.col("__p") + F.col("__r")).cast("bigint"), "before": (F.col("__u") + F.col("__s")).cast("bigint")}).drop("__range", "__p", "__u", "__s", "__r")


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """``(value, ties, avg_rank, total)`` for each distinct value; nulls are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    ordered = global_order(counts, value, count="ties")
    total = counts.agg(F.coalesce(F.sum("ties"), F.lit(0)).alias("total"))
    return ordered.join(F.broadcast(total)).select(value, "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias("avg_rank"), "total")


def percentile_buckets(df: DataFrame, value: str, into: str, buckets: int = 100) -> DataFrame:
    """``df`` with ``into``: floor(average rank / n * buckets), at most ``buckets - 1``; null for a null value."""
    ranks = average_ranks(df, value)
    bucket = F.least(F.floor(F.col("avg_rank") / F.col("total") * buckets), F.lit(buckets - 1)).cast("int")
    return df.join(ranks.select(value, bucket.alias(into)), value, "left")


def dense_index(df: DataFrame, *by: str, into: str = "idx") -> DataFrame:
    """The distinct rows of ``by`` numbered from 0 in their order."""
    return global_order(df.select(*by).distinct(), *by).select(*by, (F.col("position") - 1).alias(into))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], into: str = "p") -> DataFrame:
    """``(by..., into)``: the exact interpolated quantiles of each group, as an array; a group without a value has none and no row.

    Values are counted and ordered by range, so a group of any size is spread; of each group only the few values at the quantiles' ranks are picked.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    ordered = global_order(counts, *by, value, count="__c")
    groups = ordered.groupBy(*by).agg(F.sum("__c").alias("__n"), F.min("before").alias("__first"))
    if by:
        names = {c: f"__by_{c}" for c in by}
        on = [F.col(c).eqNullSafe(F.col(names[c])) for c in by]
        met = ordered.join(groups.withColumnsRenamed(names), on)
    else:
        met = ordered.join(F.broadcast(groups))
    first, n = F.col("before") - F.col("__first"), F.col("__n")
    at = lambda rank: F.max(F.when((first <= rank) & (rank < first + F.col("__c")), F.col(value).cast("double")))
    picked = [x for k, p in enumerate(probabilities) for x in (at(F.floor((n - 1) * p)).alias(f"__lo{k}"), at(F.ceil((n - 1) * p)).alias(f"__hi{k}"))]
    found = met.groupBy(*by).agg(F.first("__n").alias("__n"), *picked)
    place = lambda p: (F.col("__n") - 1) * p - F.floor((F.col("__n") - 1) * p)
    return found.select(*by, F.array(*[F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * place(p) for k, p in enumerate(probabilities)]).alias(into))


def quantile_edges(df: DataFrame, value: str, probabilities: list[float]) -> DataFrame:
    """One row ``edges``: the exact interpolated quantiles of a column, ascending and distinct."""
    return exact_quantiles(df, [], value, probabilities).select(F.array_sort(F.array_distinct("p")).alias("edges"))
