"""Per-entity feature table from events (problem 5).

Cumulative counts and totals are kept by entity, type and day. A window feature is then the difference
of two as-of endpoints of that store, and recency is the latest day in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Amounts that mean "missing".
MISSING_AMOUNTS = (9999999999.0,)
#: What is trimmed off codes: white space and the no-break space.
BLANKS = " \t\n\x0b\x0c\r\xa0"
#: Days that can be told apart, both ends included.
DAY_RANGE = (0, 17999)
#: Ages that are taken as real, both ends included.
AGE_RANGE = (1, 120)


def clean_events(
    events: DataFrame,
    entity: str = "RINPERSOON",
    code: str = "event_code",
    day: str = "daysSinceFirstEvent",
    amount: str = "amount",
    age: str = "age",
    day_range: tuple[int, int] = DAY_RANGE,
    missing: Sequence[float] = MISSING_AMOUNTS,
) -> DataFrame:
    """``(entity, code, day, amount, age)``, one row per event.

    Codes are trimmed and upper-cased. Rows without entity, code or day, or with a day outside
    ``day_range``, are left out; a blank code is a code. Rows equal in entity, code, day and amount (nulls equal) are one event;
    its age is the largest plausible one, null if there is none. Amounts in ``missing`` count as 0, like nulls and NaN, but
    only after rows were compared. Other columns of the input are ignored; an empty table gives an empty one.
    """
    normal = F.upper(F.btrim(F.col(code), F.lit(BLANKS)))
    years = F.col(age).cast("int")
    rows = events.select(
        F.col(entity).cast("long").alias("entity"),
        normal.alias("code"),
        F.col(day).cast("int").alias("day"),
        F.col(amount).cast("double").alias("amount"),
        F.when(years.between(*AGE_RANGE), years).alias("age"),
    ).filter(F.col("entity").isNotNull() & F.col("code").isNotNull() & F.col("day").between(*day_range))
    once = rows.groupBy("entity", "code", "day", "amount").agg(F.max("age").alias("age"))
    is_missing = F.col("amount").isNull() | F.isnan("amount") | F.col("amount").isin(list(missing))
    return once.withColumn("amount", F.when(is_missing, 0.0).otherwise(F.col("amount")))


def cumulative_store(events: DataFrame) -> DataFrame:
    """``(entity, code, day, n, total, age)``: events and amounts up to and with ``day``, from :func:`clean_events`.

    One row per entity, code and day that has an event. A group of the running sums holds at most one row per
    day, however many events an entity has, as days are added up before the rows of a group come together.
    """
    daily = events.groupBy("entity", "code", "day").agg(
        F.count("*").alias("dn"), F.sum("amount").alias("dt"), F.max("age").alias("age")
    )
    upto = W.partitionBy("entity", "code").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.select(
        "entity", "code", "day", F.sum("dn").over(upto).alias("n"), F.sum("dt").over(upto).alias("total"), "age"
    )


def latest(store: DataFrame, as_of: int | None = None) -> DataFrame:
    """``(entity, code, n, total, last_day, age)``: the store's endpoint at ``as_of`` (null: the end)."""
    upto = store if as_of is None else store.filter(F.col("day") <= as_of)
    end = F.max_by(F.struct("n", "total", "day", "age"), "day").alias("end")
    return upto.groupBy("entity", "code").agg(end).select(
        "entity", "code", "end.n", "end.total", F.col("end.day").alias("last_day"), "end.age"
    )


def window_features(store: DataFrame, as_of: int, widths: Sequence[int]) -> DataFrame:
    """Counts and totals of the last ``w`` days up to ``as_of`` for each ``w``, by subtracting endpoints.

    ``(entity, code, n_all, total_all, days_since_last, n_<w>, total_<w>...)``. All endpoints are found in one
    pass over the store; a pair without an event up to ``as_of`` has no row.
    """

    def at(day: int, what: str) -> Column:
        return F.coalesce(F.max_by(F.when(F.col("day") <= day, F.col(what)), F.when(F.col("day") <= day, F.col("day"))), F.lit(0))

    ends = [at(as_of, "n").alias("n_all"), at(as_of, "total").cast("double").alias("total_all"), F.max("day").alias("last")]
    for w in widths:
        ends += [at(as_of - w, "n").alias(f"_n{w}"), at(as_of - w, "total").cast("double").alias(f"_t{w}")]
    wide = store.filter(F.col("day") <= as_of).groupBy("entity", "code").agg(*ends)
    return wide.select(
        "entity",
        "code",
        "n_all",
        "total_all",
        (F.lit(as_of) - F.col("last")).alias("days_since_last"),
        *[c for w in widths for c in ((F.col("n_all") - F.col(f"_n{w}")).alias(f"n_{w}"), (F.col("total_all") - F.col(f"_t{w}")).alias(f"total_{w}"))],
    )


def entity_table(store: DataFrame, as_of: int | None = None) -> DataFrame:
    """One row per entity: ``(entity, n_events, total, last_day, age, features)``.

    ``features`` is an array of ``(code, n, last_day, total)`` sorted by code, so any number of codes fits without
    naming them. ``age`` is the largest plausible age among the events of the entity's latest day.
    """
    ends = latest(store, as_of)
    newest = F.max(F.struct("last_day", "age"))
    return ends.groupBy("entity").agg(
        F.sum("n").alias("n_events"),
        F.sum("total").alias("total"),
        newest["last_day"].alias("last_day"),
        newest["age"].alias("age"),
        F.array_sort(F.collect_list(F.struct("code", "n", "last_day", "total"))).alias("features"),
    )
