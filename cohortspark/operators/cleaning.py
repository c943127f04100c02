"""Cleaning of event tables described by metadata: nulls, rounding, categories, special values, statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranking import dense_index, exact_quantiles

MISSING, OTHERS, ZERO = "MISSING", "Others", "SPECIAL_NUMERIC_ZERO"


def require_times(df: DataFrame, *times: str) -> DataFrame:
    """Rows without one of the time columns are dropped."""
    return df.dropna(subset=list(times))


def round_half_even(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.bround(x.try_cast("double")).cast("bigint")


def fill_missing(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(x.cast("string"), F.lit(MISSING))


def drop_restricted(df: DataFrame, restricted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Without columns whose name holds one of the substrings."""
    return df.drop(*[c for c in df.columns if c not in keep and any(r in c for r in restricted)])


def columns_holding(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns whose name holds one of the given ones."""
    return [c for c in df.columns if any(n in c for n in names)]


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in set(names)])


def top_or_other(df: DataFrame, column: str, n: int = 100, into: str | None = None) -> DataFrame:
    """The n most frequent values stay (ties by value), others become ``Others``; nulls become ``MISSING`` and aren't counted."""
    filled = df.withColumn(into or column, fill_missing(column))
    c = into or column
    counts = filled.filter(F.col(c) != MISSING).groupBy(c).agg(F.count("*").alias("__n"))
    top = counts.orderBy(F.desc("__n"), c).limit(n).select(F.col(c).alias("__top"))
    kept = F.when(F.col(c).eqNullSafe(MISSING) | F.col("__top").isNotNull(), F.col(c)).otherwise(OTHERS)
    return filled.join(top, F.col(c) == F.col("__top"), "left").withColumn(c, kept).drop("__top")


def top_labelled(df: DataFrame, column: str, labels: DataFrame, n: int = 100) -> DataFrame:
    """Of values that have a label (``labels``: one column) the n most frequent stay (ties by value) and others become ``Others``; values without a label stay."""
    known = labels.toDF("__l").filter("__l IS NOT NULL").distinct()
    counts = df.groupBy(column).agg(F.count("*").alias("__n")).join(known, F.col(column) == F.col("__l")).orderBy(F.desc("__n"), column).limit(n).select(F.col(column).alias("__top"))
    rare = known.join(counts, F.col("__l") == F.col("__top"), "left_anti")
    return df.join(rare, F.col(column) == F.col("__l"), "left").withColumn(column, F.when(F.col("__l").isNotNull(), F.lit(OTHERS)).otherwise(F.col(column))).drop("__l")


def special_zeros(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All columns but the keys as text, zeros as ``SPECIAL_NUMERIC_ZERO``."""
    zero = lambda c: F.when(F.col(c).try_cast("double") == 0, F.lit(ZERO)).otherwise(F.col(c).cast("string")).alias(c)
    return df.select(*[F.col(c) if c in keys else zero(c) for c in df.columns])


def mapped(c: str | Column, values: dict[str, str]) -> Column:
    """Values by a dict; null for those it lacks."""
    x = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), x)


def cleaned_columns(df: DataFrame, keep: Sequence[str], restricted: Sequence[str], change) -> DataFrame:
    """Columns without restricted substrings; those in ``keep`` (keys and times) pass as they are, the others through ``change``."""
    left = drop_restricted(df, restricted, keep)
    return left.select(*[F.col(c) if c in keep else change(F.col(c)).alias(c) for c in left.columns])


def by_modulus(df: DataFrame, key: str, of: int = 100) -> DataFrame:
    """The sample of rows whose key is divisible by ``of``."""
    return df.filter(F.pmod(F.col(key), F.lit(of)) == 0)


def missing_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    """``(column, n_missing)`` of all columns or those with most, in one pass."""
    one = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("n_missing")) for c in df.columns])))
    return rows.orderBy(F.desc("n_missing"), "column").limit(top) if top else rows


def year_limits(tables: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """``(name, first, last)`` of a year over several tables."""
    parts = [df.agg(F.min(c).alias("first"), F.max(c).alias("last")).select(F.lit(n).alias("name"), "first", "last") for n, df, c in tables]
    return reduce(DataFrame.unionByName, parts)


def log_summary(df: DataFrame, by: str, step: str, loss: str) -> DataFrame:
    """``(by, max_step, min_loss, first_nan)``: of a training log whose loss is text; ``first_nan``: the first step at which it is no number."""
    value = F.col(loss).try_cast("double")
    bad = value.isNull() | F.isnan(value)
    return df.groupBy(by).agg(F.max(step).alias("max_step"), F.min(F.when(~bad, value)).alias("min_loss"), F.min(F.when(bad, F.col(step))).alias("first_nan"))


def nan_fractions(df: DataFrame, vectors: Sequence[str]) -> DataFrame:
    """``(layer, fraction)`` of numbers that are NaN or infinite in each vector column."""
    odd = lambda c: F.size(F.filter(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    one = df.agg(*[(F.sum(odd(c)) / F.sum(F.size(c))).alias(c) for c in vectors])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("fraction")) for c in vectors])))


def factor_codes(df: DataFrame, column: str, into: str = "code") -> DataFrame:
    """``df`` with the rank of each value among the distinct ones, from 1; -1 for null."""
    index = dense_index(df.select(column).filter(F.col(column).isNotNull()), column, into="__i").withColumnRenamed(column, "__v")
    return df.join(index, F.col(column) == F.col("__v"), "left").withColumn(into, F.coalesce(F.col("__i") + 1, F.lit(-1)).cast("bigint")).drop("__i", "__v")


def parse_labels(text: str | Column) -> Column:
    """The text of a dict of codes and labels as a map; an empty map where there is none."""
    x = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    codes = F.regexp_extract_all(x, F.lit(r"'?([-\w.]+)'?\s*:\s*'([^']*)'"), 1)
    labels = F.regexp_extract_all(x, F.lit(r"'?([-\w.]+)'?\s*:\s*'([^']*)'"), 2)
    return F.map_from_arrays(F.array_distinct(codes), F.slice(labels, F.lit(1), F.size(F.array_distinct(codes))))


def substitute_special(value: str | Column, labels: Column, numeric: Column) -> Column:
    """For numeric columns a labelled code becomes its label and a zero without label ``SPECIAL_NUMERIC_ZERO``; others stay."""
    x = F.col(value) if isinstance(value, str) else value
    text = F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))
    found = F.try_element_at(labels, text)
    return F.when(numeric, F.coalesce(found, F.when(x == 0, F.lit(ZERO)), text)).otherwise(text)


def describe_numeric(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, null share, mean, deviation and five exact percentiles per group; a group of any size is spread."""
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(value).isNull().cast("double")).alias("null_share"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    p = exact_quantiles(df, list(by), value, [0.1, 0.25, 0.5, 0.75, 0.9]).withColumnsRenamed({c: f"__{c}" for c in by})
    met = sums.join(p, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left")
    return met.select(*by, "n", "null_share", "mean", "std", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate((10, 25, 50, 75, 90))])


def describe_categorical(df: DataFrame, column: str, top: int = 5, least: int = 10) -> DataFrame:
    """``(category, share)`` of the ``top`` categories that have at least ``least`` rows, the rest together as ``Others``."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    ranked = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "category").limit(top).select(F.col("category").alias("__c"))
    named = counts.join(ranked, F.col("category") == F.col("__c"), "left").select(F.coalesce("__c", F.lit(OTHERS)).alias("category"), "n")
    grouped = named.groupBy("category").agg(F.sum("n").alias("n"))
    total = grouped.agg(F.sum("n").alias("total"))
    return grouped.join(F.broadcast(total)).select("category", (F.col("n") / F.col("total")).alias("share"))


def covariance_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, covariance)`` for each pair a <= b of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("covariance")) for k, (a, b) in enumerate(pairs)])))


def few_valued(df: DataFrame, columns: Sequence[str], threshold: int) -> dict[str, bool]:
    """Whether each column has at most ``threshold`` distinct values. Sketches in one pass settle the columns of many values; those near the threshold or
    below, whose values are few, are counted exactly."""
    if not columns:
        return {}
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    near = [c for c in columns if rough[c] <= 4 * threshold + 10]
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in near]).first() if near else {}
    return {c: c in near and exact[c] <= threshold for c in columns}


def inferred_metadata(df: DataFrame, threshold: int = 100) -> DataFrame:
    """``(Name, Type)``: text columns and those of few distinct values are String, others Numeric."""
    few = few_valued(df, [c for c, t in df.dtypes if t != "string"], threshold)
    return df.sparkSession.createDataFrame([(c, "String" if few.get(c, True) else "Numeric") for c in df.columns], "Name string, Type string")


def drop_constant(df: DataFrame) -> DataFrame:
    """Without columns of at most one distinct value (nulls don't count)."""
    got = few_valued(df, df.columns, 1)
    return df.select(*[c for c in df.columns if not got[c]])


def mean_impute(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Nulls become the mean of their group."""
    return df.withColumn(value, F.coalesce(value, F.avg(value).over(W.partitionBy(*by))))


def year_in_name(name: str) -> int:
    """The one number of four digits in a name; an error if there isn't exactly one."""
    found = re.findall(r"\d{4}", name)
    if len(found) != 1:
        raise ValueError(f"{name}: {len(found)} years")
    return int(found[0])
