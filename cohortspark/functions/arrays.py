"""Array expressions on embeddings and sequences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def l2_normalise(a) -> Column:
    """Vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x / n)).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def finite_or_zero(a) -> Column:
    """NaN, infinite and null elements become 0."""
    return F.transform(_c(a), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))


def digitize(value, edges) -> Column:
    """How many of the ascending edges are at most the value; null for a null value."""
    v = _c(value)
    return F.when(v.isNotNull(), F.size(F.filter(_c(edges), lambda e: e <= v)))


def repeat_each(values, lengths) -> Column:
    """Each value as often as its length says."""
    return F.flatten(F.zip_with(_c(values), _c(lengths), lambda v, n: F.array_repeat(v, n.cast("int"))))


def pad_right(a, length: int, fill) -> Column:
    """To ``length`` elements: cut, or filled on the right."""
    x = _c(a)
    return F.slice(F.concat(x, F.array_repeat(F.lit(fill), length)), 1, length)


def keep_last_within(sizes, budget) -> Column:
    """How many of the last elements fit: the largest k whose sizes sum to less than ``budget``."""
    state = F.aggregate(
        F.reverse(_c(sizes)),
        F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("kept"), F.lit(True).alias("open")),
        lambda s, x: F.when(s["open"] & (s["total"] + x < budget), F.struct((s["total"] + x).cast("bigint").alias("total"), (s["kept"] + 1).alias("kept"), F.lit(True).alias("open"))).otherwise(
            F.struct(s["total"].alias("total"), s["kept"].alias("kept"), F.lit(False).alias("open"))
        ),
    )
    return state["kept"]
