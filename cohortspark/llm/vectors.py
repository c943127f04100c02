"""Sound unit vectors, collapsed copies and cells of a learned index: what problems 3 and 4 share.

A cell is the meeting of a block of index rows and a block of query rows of one part. Parts that hold more
than a block's rows are cut into a grid of cells, so no task's size follows the data.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Stage
from .learned_index import FIT_ROWS, MAX_PARTS, LearnedPartition, RoutingTree

#: Vectors a part should hold.
PART_ROWS = 2400
#: Index rows of a cell, about.
CELL_ROWS = 16_384
ROLE_INDEX, ROLE_QUERY = 1, 2


def binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a float matrix as one binary column, without a copy for each row."""
    data = np.ascontiguousarray(matrix, np.float32)
    width = data.shape[1] * 4 if data.ndim == 2 else 0
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * width), pa.py_buffer(data)])


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The reverse of :func:`binary`."""
    if isinstance(column, pa.ChunkedArray):
        chunks = [matrix(c, dim) for c in column.chunks if len(c)]
        return np.concatenate(chunks) if chunks else np.empty((0, dim), np.float32)
    if not len(column):
        return np.empty((0, dim), np.float32)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    first = np.frombuffer(column.buffers()[1], kind)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + len(column) * dim * 4].view(np.float32).reshape(-1, dim)


def _sound(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col, query = batch.column(0), batch.column(1), batch.column(2)
            offsets = col.offsets.to_numpy()
            good = np.flatnonzero((np.diff(offsets) == dim) & ~np.asarray(col.is_null()) & ~np.asarray(ids.is_null()))
            values = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = values[offsets[good][:, None] + np.arange(dim)] if len(good) else np.empty((0, dim))
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(1))
                fine = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
            unit = (x[fine] / norm[fine][:, None] + 0.0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good[fine])), binary(unit), query.take(pa.array(good[fine]))], ["id", "vec", "is_query"])

    return run


def sound_vectors(df: DataFrame, entity: str, vector: str, dim: int = 64, is_query: Column | None = None) -> DataFrame:
    """``(id, vec, is_query)``: each sound vector at length 1, as bytes.

    Sound are vectors of ``dim`` finite numbers, not all zero, with an id. All other rows are left out.
    """
    asked = F.lit(True) if is_query is None else F.coalesce(is_query, F.lit(False))
    rows = df.select(F.col(entity).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"), asked.alias("is_query"))
    return rows.mapInArrow(_sound(dim), "id long, vec binary, is_query boolean")


class Copies:
    """Equal vectors stand for one: ``reps`` has ``(id, vec, is_query, shared)`` with the smallest id of each.

    Copies are combined before they travel, so a group of copies of any size is one row from then on. An entity
    with two different sound vectors takes part with both; one delivered twice with the same vector does once.
    """

    def __init__(self, vectors: DataFrame):
        self._vectors = vectors.select("id", "vec")
        once = vectors.groupBy("vec").agg(F.min("id").alias("id"), F.max("is_query").alias("is_query"), (F.min("id") != F.max("id")).alias("shared"))
        self.stage = Stage(once.select("id", "vec", "is_query", "shared"), "vectors")
        self.reps = self.stage.df

    def shared_members(self) -> DataFrame:
        """``(rep, id)`` of every member of each group of copies."""
        mark = lambda c: (F.xxhash64(c).alias("h1"), F.xxhash64(c, F.lit(1)).alias("h2"))
        groups = self.reps.filter("shared").select(F.col("id").alias("rep"), *mark("vec"))
        return self._vectors.select("id", *mark("vec")).join(groups, ["h1", "h2"]).select("rep", "id").distinct()


def _sample(reps: DataFrame, rows: int, total: int) -> Column:
    """About so many rows of all, chosen by a hash of the id."""
    return F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, rows / max(total, 1)) * (1 << 30))


def fit_tree(reps: DataFrame, dim: int = 64, fit_rows: int = FIT_ROWS, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> RoutingTree:
    """Fit the index on a sample: ``fit_rows`` vectors for the first model and, with too many vectors for its parts, for each part's own.

    Only the sample of the first model and the models (about 100 KB each) come to the driver.
    """
    total = reps.count()
    got = reps.filter(_sample(reps, fit_rows, total)).select("id", "vec").orderBy("id").toArrow()
    sample = matrix(got["vec"], dim)
    leaves = int(np.ceil(total / part_rows))
    root = LearnedPartition.fit(sample, min(leaves, max_parts))
    if leaves <= 4 * max_parts or root.weights is None:
        return RoutingTree(root)
    each = int(np.ceil(leaves / root.parts))
    chosen = reps.filter(_sample(reps, fit_rows * root.parts, total)).select("id", "vec")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(root.route(x, 1)[:, 0]), b.column(0), b.column(1)], ["part", "id", "vec"])

    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        x = matrix(rows.sort_by("id")["vec"], dim)
        step = max(1, -(-len(x) // fit_rows))  # a part far above its share
        model = LearnedPartition.fit(x[::step], each)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "model": [pickle.dumps((model.parts, model.weights, model.load))]})

    placed = chosen.mapInArrow(place, "part int, id long, vec binary")
    models = placed.groupBy("part").applyInArrow(learn, "part int, model binary").collect()
    return RoutingTree(root, {r["part"]: LearnedPartition(*pickle.loads(bytes(r["model"]))) for r in models})


CELL_SCHEMA = "part int, ci int, qi int, role int, id long, tag long, vec binary"


def to_cells(rows: DataFrame, tree: RoutingTree, total: int, probes: int, dim: int = 64, cell_rows: int = CELL_ROWS, extra: int = 0) -> DataFrame:
    """``(part, ci, qi, role, id, tag, vec)`` from ``(id, tag, vec, is_index, is_query)``. ``extra``: numbers that travel behind each vector.

    Index rows go to their most probable part, queries to their ``probes`` most probable ones. A part of about
    n blocks of ``cell_rows`` becomes n x n cells: an index row is in one row of that grid, a query in one column.
    """
    blocks = np.maximum(1, np.ceil(tree.load * total * 1.2 / cell_rows)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = matrix(batch.column(2), dim + extra)
            index, query = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), bool) for k in (3, 4))
            parts = tree.route(x[:, :dim], probes)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = (mixed % blocks[parts[:, 0]].astype(np.uint64)).astype(np.int32)
            out: list[tuple[np.ndarray, ...]] = []
            for rank in range(parts.shape[1]):
                part = parts[:, rank]
                n = np.where(part >= 0, blocks[part], 0)
                asks, held = query & (part >= 0), index & (rank == 0)
                block = (mixed % np.maximum(n, 1).astype(np.uint64)).astype(np.int32)
                both = np.flatnonzero(asks & held & (n == 1))
                out.append((both, part[both], 0 * both, 0 * both, 0 * both + ROLE_INDEX + ROLE_QUERY))
                many = ~(asks & held & (n == 1))
                for cell in range(int(n[(asks | held) & many].max(initial=0))):
                    rows_ = np.flatnonzero(held & many & (cell < n))
                    out.append((rows_, part[rows_], own[rows_], 0 * rows_ + cell, 0 * rows_ + ROLE_INDEX))
                    rows_ = np.flatnonzero(asks & many & (cell < n))
                    out.append((rows_, part[rows_], 0 * rows_ + cell, block[rows_], 0 * rows_ + ROLE_QUERY))
            row, part, ci, qi, role = (np.concatenate([o[k] for o in out]) for k in range(5))
            for b in range(0, len(row), 16_384):
                cut = slice(b, b + 16_384)
                take = pa.array(row[cut])
                ints = [pa.array(a[cut].astype(np.int32)) for a in (part, ci, qi, role)]
                yield pa.RecordBatch.from_arrays([*ints, batch.column(0).take(take), batch.column(1).take(take), binary(x[row[cut]])], ["part", "ci", "qi", "role", "id", "tag", "vec"])

    return rows.select("id", "tag", "vec", "is_index", "is_query").mapInArrow(run, CELL_SCHEMA)


def in_cells(cells: DataFrame, work: Callable, schema: str, names: list[str], dim: int = 64) -> DataFrame:
    """Run ``work(index ids, index tags, index vectors, query ids, query tags, query vectors)`` on each cell; it gives arrays for ``names``."""

    def run(table: pa.Table) -> pa.Table:
        role, ids, tags = (table[c].to_numpy() for c in ("role", "id", "tag"))
        x = matrix(table["vec"], dim)
        order = np.argsort(ids, kind="stable")
        i, q = order[role[order] & ROLE_INDEX > 0], order[role[order] & ROLE_QUERY > 0]
        return pa.table(dict(zip(names, work(ids[i], tags[i], x[i], ids[q], tags[q], x[q]))))

    return cells.groupBy("part", "ci", "qi").applyInArrow(run, schema)
