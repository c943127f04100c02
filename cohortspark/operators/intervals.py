"""Merging overlapping intervals and listing the gaps (problem 6).

Day intervals are taken apart into canonical dyadic blocks (day numbers that share all but their last L bits).
Blocks inside another block of the entity are removed, sibling pairs become their parent, and neighbouring
blocks are joined to periods. The same reduction runs over all batches of a task before the shuffle, and again on
salted parts of each entity, so what travels for an entity is bounded by the days it covers and not by its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bits of a day number: days since 0001-01-01 up to beyond 9999-12-31.
BITS = 22
OPEN_END = (1 << BITS) - 1
EPOCH = "0001-01-01"
#: Periods that a task holds, already reduced, before it lets them go.
HELD_PERIODS = 1_000_000
#: Parts of an entity that are reduced apart before its periods come together.
SALTS = 32


def dyadic_blocks(ent: np.ndarray, beg: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(entity, level, index)`` of the fewest dyadic blocks that make up each closed interval."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    level = 0
    while len(ent):
        odd = (beg & 1 == 1) & (beg <= end)
        out.append((ent[odd], level, beg[odd]))
        beg = beg + odd
        even = (end & 1 == 0) & (beg <= end)
        out.append((ent[even], level, end[even]))
        end = end - even
        go = beg <= end
        ent, beg, end, level = ent[go], beg[go] >> 1, end[go] >> 1, level + 1
    if not out:
        return (np.empty(0, np.int64),) * 3
    return (
        np.concatenate([e for e, _, _ in out]),
        np.concatenate([np.full(len(e), lv, np.int64) for e, lv, _ in out]),
        np.concatenate([i for _, _, i in out]),
    )


def _outermost(ent: np.ndarray, level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without blocks that lie in an ancestor or are repeated. Blocks are nested or apart, so one sorted pass finds them."""
    start, stop = index << level, ((index + 1) << level) - 1
    order = np.lexsort((-level, start, ent))
    ent, level, index, stop = ent[order], level[order], index[order], stop[order]
    if not len(ent):
        return ent, level, index
    first = np.r_[True, ent[1:] != ent[:-1]]
    offset = (np.cumsum(first) - 1) << (BITS + 1)
    reach = np.maximum.accumulate(stop + offset)
    keep = np.r_[True, (stop + offset)[1:] > reach[:-1]] | first
    return ent[keep], level[keep], index[keep]


def reduce_blocks(ent: np.ndarray, level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks covered by ancestors removed, then sibling pairs merged upward as far as they go."""
    ent, level, index = _outermost(ent, level, index)
    done, carried = [], (np.empty(0, np.int64), np.empty(0, np.int64))
    for lv in range(BITS + 1):
        at = level == lv
        e, i = np.r_[ent[at], carried[0]], np.r_[index[at], carried[1]]
        if not len(e):
            carried = (e, i)
            continue
        order = np.lexsort((i, e))
        e, i = e[order], i[order]
        pair = np.zeros(len(e), bool)
        pair[:-1] = (e[1:] == e[:-1]) & (i[1:] == i[:-1] + 1) & (i[:-1] & 1 == 0)
        both = pair.copy()
        both[1:] |= pair[:-1]
        done.append((e[~both], np.full((~both).sum(), lv, np.int64), i[~both]))
        carried = (e[pair], i[pair] >> 1)
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (ent, level, index)  # type: ignore[return-value]


def coalesce_blocks(ent: np.ndarray, level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods ``(entity, begin, end)`` from disjoint blocks, by entity and begin."""
    start, stop = index << level, ((index + 1) << level) - 1
    order = np.lexsort((start, ent))
    ent, start, stop = ent[order], start[order], stop[order]
    if not len(ent):
        return ent, start, stop
    new = np.r_[True, (ent[1:] != ent[:-1]) | (start[1:] > stop[:-1] + 1)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(ent) - 1]
    return ent[new], start[new], stop[last]


def merge_intervals(ent: np.ndarray, beg: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed intervals to the continuous periods of each entity."""
    return coalesce_blocks(*reduce_blocks(*dyadic_blocks(ent, beg, end)))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))  # type: ignore[return-value]


def _batch(ent: np.ndarray, beg: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ent, beg, end)], ["entity", "beg", "end"])


def _reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All batches of a task to their periods. Rows wait until there are as many as periods held, so each is merged a few times at most."""
    held, waiting, size = tuple(np.empty(0, np.int64) for _ in range(3)), [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(_arrays(batch))
            size += batch.num_rows
        if size > max(len(held[0]), HELD_PERIODS // 8):
            held = merge_intervals(*(np.concatenate([h, *(w[k] for w in waiting)]) for k, h in enumerate(held)))
            waiting, size = [], 0
            if len(held[0]) > HELD_PERIODS:
                yield _batch(*held)
                held = tuple(x[:0] for x in held)
    held = merge_intervals(*(np.concatenate([h, *(w[k] for w in waiting)]) for k, h in enumerate(held)))
    for a in range(0, len(held[0]), 100_000):
        yield _batch(*(x[a : a + 100_000] for x in held))


def _reduce_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by entity; what belongs to a batch's last entity waits, already reduced, for the next batch."""
    kept = tuple(np.empty(0, np.int64) for _ in range(3))
    for batch in batches:
        if batch.num_rows:
            ent, beg, end = merge_intervals(*(np.r_[k, x] for k, x in zip(kept, _arrays(batch))))
            open_ = ent == ent[-1]
            kept = (ent[open_], beg[open_], end[open_])
            if not open_.all():
                yield _batch(ent[~open_], beg[~open_], end[~open_])
    if len(kept[0]):
        yield _batch(*kept)


def _gaps_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From periods by entity and begin: what lies between two neighbours."""
    prev = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ent, beg, end = _arrays(batch)
        if prev is not None:
            ent, beg, end = np.r_[prev[0], ent], np.r_[prev[1], beg], np.r_[prev[2], end]
        same = ent[1:] == ent[:-1]
        yield _batch(ent[1:][same], end[:-1][same] + 1, beg[1:][same] - 1)
        prev = ent[-1:], beg[-1:], end[-1:]


def _spells(spells: DataFrame, entity: str, beg: str, end: str) -> DataFrame:
    number = lambda c: F.datediff(F.col(c).cast("date"), F.lit(EPOCH).cast("date")).cast("long")
    rows = spells.select(F.col(entity).cast("long").alias("entity"), number(beg).alias("beg"), F.coalesce(number(end), F.lit(OPEN_END)).alias("end"))
    return rows.filter("entity is not null and beg is not null and beg >= 0 and end >= beg")


SCHEMA = "entity long, beg long, end long"


def periods(spells: DataFrame, entity: str, beg: str, end: str) -> DataFrame:
    """``(entity, beg, end)`` in day numbers: the continuous periods of each entity, by entity and begin in each partition.

    Both days belong to a spell; adjoining days join two spells. A null end means the spell still runs (``OPEN_END``).
    Rows without entity or begin, with an end before the begin or a day before 0001-01-01 are left out. Repeated
    rows change nothing; an empty table gives an empty one; other columns are ignored. Of an entity with any share of the rows
    a task sends its periods once, and at most SALTS sets of them meet in one task.
    """
    small = _spells(spells, entity, beg, end).mapInArrow(_reduce_batches, SCHEMA)
    salted = small.repartition("entity", F.pmod(F.spark_partition_id(), F.lit(SALTS))).mapInArrow(_reduce_batches, SCHEMA)
    placed = salted.repartition("entity").sortWithinPartitions("entity")
    return placed.mapInArrow(_reduce_sorted, SCHEMA)


def gaps(spells: DataFrame, entity: str, beg: str, end: str) -> DataFrame:
    """``(entity, beg, end)`` in day numbers: each longest stretch of uncovered days between two periods of an entity."""
    return periods(spells, entity, beg, end).mapInArrow(_gaps_sorted, SCHEMA)


def day_text(column: str):
    """A day number as ``yyyy-MM-dd``."""
    return F.date_format(F.date_add(F.lit(EPOCH).cast("date"), F.col(column).cast("int")), "yyyy-MM-dd")
