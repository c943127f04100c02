"""Linear models by sums of squares and products, cross-validated, and target transforms.

A fold's model needs no pass of its own: the sums of all other folds are those of all less the fold's, so one aggregation serves every fold
and feature subset. Only those sums, as many as pairs of features, reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def fold_sums(df: DataFrame, by: Sequence[str], fold: str, features: Sequence[str], target: str) -> dict[tuple, dict[int, np.ndarray]]:
    """Sums of the products of ``(1, features, target)`` for each group and fold. Rows with a null in any of them are left out."""
    names = [*features, target]
    col = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    pairs = [(i, j) for i in range(len(col)) for j in range(i, len(col))]
    rows = df.dropna(subset=names).groupBy(*by, fold).agg(*[F.sum(col[i] * col[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out: dict[tuple, dict[int, np.ndarray]] = {}
    for r in rows:
        m = np.zeros((len(col), len(col)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out.setdefault(tuple(r[b] for b in by), {})[r[fold]] = m
    return out


def solve(m: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Intercept and coefficients from the sums; features are scaled while solving, so that their units don't matter."""
    x, y = m[:-1, :-1], m[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(x), 1e-300))
    a = x / scale[:, None] / scale[None, :]
    penalty = np.eye(len(a)) * ridge
    penalty[0, 0] = 0
    return np.linalg.lstsq(a + penalty, y / scale, rcond=1e-12)[0] / scale


def cross_validated(df: DataFrame, by: Sequence[str], fold: str, features: Sequence[str], target: str, ridge: float = 0.0) -> tuple[DataFrame, dict[tuple, np.ndarray]]:
    """``df`` with ``guess`` by the model of the other folds of its group, and the coefficients ``(intercept, features...)`` by group and fold.

    Groups and folds are few (their coefficients travel in the plan). A group with a single fold has no guesses.
    """
    sums = fold_sums(df, by, fold, features, target)
    coef = {(*g, f): solve(sum(s for k, s in folds.items() if k != f), ridge) for g, folds in sums.items() if len(folds) > 1 for f in folds}
    spark = df.sparkSession
    types = dict(df.dtypes)
    names = [*by, fold]
    schema = ", ".join(f"`__{c}` {types[c]}" for c in names) + ", __coef array<double>"
    table = spark.createDataFrame([(*k, [float(x) for x in v]) for k, v in coef.items()], schema)
    guess = sum((F.col("__coef")[i + 1] * F.col(c).cast("double") for i, c in enumerate(features)), F.col("__coef")[0])
    met = df.join(F.broadcast(table), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names], "left")
    return met.withColumn("guess", guess).drop(*[f"__{c}" for c in names], "__coef"), coef


def scores(df: DataFrame, by: Sequence[str], truth: str, guess: str) -> DataFrame:
    """n, MSE, RMSE, MAE, MAPE (of values other than 0), R2 and correlation per group."""
    e = F.col(truth) - F.col(guess)
    mse = F.avg(e * e)
    return df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(F.col(truth) != 0, F.abs(e / F.col(truth)))).alias("mape"),
        (1 - mse / F.var_pop(truth)).alias("r2"), F.corr(truth, guess).alias("corr"),
    )


def over_folds(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each measure over the folds of a group, and over all groups (null in ``by``)."""
    return df.rollup(*by).agg(F.count("*").alias("n_folds"), *[x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


def yeo_johnson(value: Column, power: float) -> Column:
    """Yeo and Johnson's transform at a power."""
    up = F.log1p(value) if abs(power) < 1e-12 else (F.pow(value + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-value) if abs(power - 2) < 1e-12 else -(F.pow(1 - value, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(value >= 0, up).otherwise(down)


def yeo_johnson_inverse(value: Column, power: float) -> Column:
    up = F.expm1(value) if abs(power) < 1e-12 else F.pow(value * power + 1, F.lit(1 / power)) - 1
    down = -F.expm1(-value) if abs(power - 2) < 1e-12 else 1 - F.pow(1 - (2 - power) * value, F.lit(1 / (2 - power)))
    return F.when(value >= 0, up).otherwise(down)


def yeo_johnson_power(df: DataFrame, value: str, low: float = -2.0, high: float = 4.0, passes: int = 4, steps: int = 13) -> float:
    """The power at which the transformed values are most like normal ones: the likelihood of many powers in each pass, between ever nearer bounds."""
    rows = df.filter(F.col(value).isNotNull())
    best = 1.0
    for _ in range(passes):
        grid = np.linspace(low, high, steps)
        one = rows.agg(
            F.count("*").alias("n"), F.sum(F.signum(value) * F.log1p(F.abs(value))).alias("j"), *[F.var_pop(yeo_johnson(F.col(value), float(p))).alias(f"v{k}") for k, p in enumerate(grid)]
        ).first()
        if not one["n"]:
            return 1.0
        like = [-one["n"] / 2 * np.log(max(one[f"v{k}"], 1e-300)) + (p - 1) * one["j"] if one[f"v{k}"] is not None and np.isfinite(one[f"v{k}"]) else -np.inf for k, p in enumerate(grid)]
        k = int(np.argmax(like))
        best, width = float(grid[k]), grid[1] - grid[0]
        low, high = best - width, best + width
    return best


def adjusted_by_rate(value: Column, year: Column, rates: dict[int, float]) -> Column:
    """``value`` raised by the year's rate; as it is for a year without one."""
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    return value + value * F.coalesce(F.try_element_at(table, year), F.lit(0.0))
