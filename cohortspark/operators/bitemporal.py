"""Attributes as known at event time (problem 7).

An entity's versions become usable once they hold and are known. The history is kept as periodic as-known
snapshots (of the periods that hold events) plus a change log: an event is joined to the snapshot that precedes it and to the log of its own
period, and only the log entries up to the event's time are replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Days between two snapshots.
PERIOD_DAYS = 1826


def _day(c: Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def snapshot_store(
    versions: DataFrame,
    wanted: DataFrame,
    entity: str,
    version_id: str,
    valid_from: str,
    known_from: str,
    period: int = PERIOD_DAYS,
) -> DataFrame:
    """``(entity, period, snapshot, log)`` for each ``(entity, period)`` of ``wanted``, whose rows are distinct and not null.

    ``snapshot`` is the state ``(valid, known, id)`` when the period begins, null before the first version;
    ``log`` holds the changes ``(day, state)`` within the period, by day. A version takes part from the later of
    ``valid_from`` and ``known_from`` on; a version without either, without entity or without id never does. Of
    usable versions the latest ``valid_from`` counts, then the latest ``known_from``, then the largest id. A
    state is entered only where it differs from the one before, so a version reported late that is older than
    what is known leaves no entry. All rows of an entity are first reduced to one per day; an entity of any
    number of versions has at most one row per day after that. Only periods that are wanted become rows.
    """
    usable = versions.select(
        F.col(entity).alias("entity"),
        F.struct(_day(F.col(valid_from)).alias("valid"), _day(F.col(known_from)).alias("known"), F.col(version_id).alias("id")).alias("state"),
    ).filter("entity is not null and state.valid is not null and state.known is not null and state.id is not null")
    daily = usable.groupBy("entity", F.greatest("state.valid", "state.known").alias("day")).agg(F.max("state").alias("state"))
    by_day = W.partitionBy("entity").orderBy("day")
    best = F.max("state").over(by_day.rowsBetween(W.unboundedPreceding, W.currentRow))
    running = daily.select("entity", "day", best.alias("state"))
    changes = running.withColumn("before", F.lag("state").over(by_day)).filter("before is null or state != before")
    logs = changes.groupBy("entity", F.floor(F.col("day") / period).alias("period")).agg(
        F.array_sort(F.collect_list(F.struct("day", "state"))).alias("log"), F.max("state").alias("end")
    )
    # periods with changes and periods with events in one order: a snapshot is the end of the last changes before it
    met = logs.join(wanted.select("entity", "period", F.lit(True).alias("asked")), ["entity", "period"], "full")
    earlier = W.partitionBy("entity").orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    return met.withColumn("snapshot", F.last("end", ignorenulls=True).over(earlier)).filter("asked").select("entity", "period", "snapshot", "log")


def as_known(
    events: DataFrame,
    versions: DataFrame,
    entity: str,
    event_day: Column,
    version_entity: str,
    version_id: str,
    valid_from: str,
    known_from: str,
    period: int = PERIOD_DAYS,
) -> DataFrame:
    """``events`` with ``as_known_id``: the version that held and was known on each event's day.

    ``event_day`` counts days since 1970-01-01. Null without a usable version, and for events without entity or
    day; every event row is kept, repeated ones too, with all its columns. One row of the store meets each event, so a busy
    entity never multiplies rows; a hot entity's events are split by the adaptive skew join as they meet a single row.
    """
    left = events.withColumns({"__entity": F.col(entity), "__day": event_day, "__period": F.floor(event_day / period)})
    wanted = left.select(F.col("__entity").alias("entity"), F.col("__period").alias("period")).filter("entity is not null and period is not null").distinct()
    store = snapshot_store(versions, wanted, version_entity, version_id, valid_from, known_from, period)
    right = store.select(F.col("entity").alias("__e"), F.col("period").alias("__p"), F.col("snapshot").alias("__s"), F.col("log").alias("__log"))
    met = left.join(right, (F.col("__entity") == F.col("__e")) & (F.col("__period") == F.col("__p")), "left")
    passed = F.filter("__log", lambda x: x["day"] <= F.col("__day"))
    state = F.when(F.size(passed) > 0, F.element_at(passed, -1)["state"]).otherwise(F.col("__s"))
    return met.withColumn("as_known_id", state["id"]).drop("__entity", "__day", "__period", "__e", "__p", "__s", "__log")
