"""Spells: begin and end events, aggregates per job, panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import days_since_genesis


def spells_to_events(df: DataFrame, beg: str, end: str, keep: Sequence[str]) -> DataFrame:
    """``(keep..., eventType, daysSinceFirstEvent, age)``: a row for the begin and one for the end of each spell, the age being 0.

    A spell without begin has no begin event and one without end no end event.
    """
    moments = F.array(F.struct(F.lit("beg").alias("eventType"), days_since_genesis(beg).alias("daysSinceFirstEvent")), F.struct(F.lit("end").alias("eventType"), days_since_genesis(end).alias("daysSinceFirstEvent")))
    return df.select(*keep, F.inline(moments)).filter("daysSinceFirstEvent IS NOT NULL").withColumn("age", F.lit(0))


def melt_tokens(df: DataFrame, key: str, columns: Sequence[str], year: Column, years: tuple[int, int]) -> DataFrame:
    """``(key, year, token)``: each column's value as ``column_value``, nulls left out, within a range of years."""
    long = df.filter(year.between(*years)).select(key, year.alias("year"), F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])))
    return long.filter("v IS NOT NULL").select(key, "year", F.concat_ws("_", "c", "v").alias("token"))


def job_spells(df: DataFrame, person: str, job: str, beg: str, end: str, hours: str, first: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per person and job: first begin, last end, hours, the attributes of its first row, its number and how many jobs there are."""
    firsts = [F.min_by(c, F.struct(*order)).alias(c) for c in first]
    jobs = df.groupBy(person, job).agg(F.min(beg).alias("beg"), F.max(end).alias("end"), F.sum(hours).alias("hours"), *firsts)
    mine = W.partitionBy(person)
    return jobs.withColumns({"job_no": F.row_number().over(mine.orderBy("beg", F.desc_nulls_last("end"), job)), "n_jobs": F.count("*").over(mine)})


def filled_panel(df: DataFrame, entity: str, time: str, value: str, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """A row for every time from an entity's first to its last, the value carried forward, with its lags. Rows are one per entity and time."""
    span = df.groupBy(entity).agg(F.min(time).alias("a"), F.max(time).alias("b")).select(entity, F.explode(F.sequence("a", "b")).alias(time))
    by = W.partitionBy(entity).orderBy(time)
    full = span.join(df.select(entity, time, value), [entity, time], "left").withColumn(value, F.last(value, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return full.select("*", *[F.lag(value, k).over(by).alias(f"lag{k}") for k in lags])


def years_covered(df: DataFrame, entity: str, first: Column, last: Column, years: tuple[int, int]) -> DataFrame:
    """``(entity, year)`` for every year within ``years`` that an interval touches: the interval join without comparing rows."""
    a, b = F.greatest(first, F.lit(years[0])), F.least(last, F.lit(years[1]))
    return df.filter(first.isNotNull() & last.isNotNull()).select(entity, F.explode(F.when(a <= b, F.sequence(a, b))).alias("year")).distinct()
