"""Prediction labels, evaluation subsets and baselines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import hash32, uniform
from .ranking import global_order


def mutual_rows(df: DataFrame, a: str, b: str, same: Sequence[str]) -> DataFrame:
    """Rows whose twin with a and b swapped exists and agrees in ``same`` (nulls equal). Rows are kept, however many twins there are."""
    twin = df.select(F.col(b).alias("__a"), F.col(a).alias("__b"), *[F.col(c).alias(f"__{c}") for c in same]).distinct()
    on = (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b"))
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(twin, on, "left_semi")


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often each unordered pair comes."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("n"))


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a full order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__r = 1").drop("__r")


def latest_values(df: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """For each key and column the last value that isn't null. Rows are distinct in key and time."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns])


def yearly_partner(df: DataFrame, a: str, b: str, year: str, order: Sequence[Column]) -> DataFrame:
    """``(year, person, partner)``: each person's first pair of a year, whichever side it was entered from."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(year).isNotNull()).select(F.col(year).alias("year"), F.inline(F.array(F.struct(F.col(a).alias("person"), F.col(b).alias("partner")), F.struct(F.col(b).alias("person"), F.col(a).alias("partner")))), *order)
    names = both.columns[3:]
    return first_row(both, ["year", "person"], [*[F.col(c) for c in names], F.col("partner")]).select("year", "person", "partner")


def never_partnered(persons: DataFrame, unions: DataFrame, person: str) -> DataFrame:
    return persons.join(unions.select(person).distinct(), person, "left_anti")


def hash_subsets(df: DataFrame, key: str, sizes: Sequence[tuple[str, int]], seed: str) -> DataFrame:
    """``(key, subset)``: the first keys by hash, so many for each subset in turn."""
    ids = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__h", hash32(key, seed))
    ranked, upto, name = global_order(ids, "__h", key), 0, None
    for subset, n in sizes:
        upto += n
        name = F.when(F.col("position") <= upto, subset) if name is None else name.when(F.col("position") <= upto, subset)
    return ranked.filter(F.col("position") <= upto).select(key, name.alias("subset"))


def scaled_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to 0..1 by one pass for the limits."""
    limits = df.agg(*[x for c in columns for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))])
    return df.join(F.broadcast(limits)).select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))).alias(c) for c in columns])


def survival_targets(population: DataFrame, events: DataFrame, person: str, day: str, first: int, last: int) -> DataFrame:
    """``(person, target, censor_day)``: 1 with the day of the last event within the period, else 0 with its end."""
    final = events.filter(F.col(day).between(first, last)).groupBy(person).agg(F.max(day).alias("__d"))
    return population.join(final, person, "left").select(person, F.col("__d").isNotNull().cast("int").alias("target"), F.coalesce("__d", F.lit(last)).alias("censor_day"))


def hash_folds(key: str, k: int = 5, seed: str = "42") -> Column:
    return F.floor(uniform(key, seed) * k).cast("int")


def target_encoded(df: DataFrame, category: str, target: str, fold: str) -> DataFrame:
    """``encoded``: the mean target of the row's category in the other folds, the mean of all other folds where it has none."""
    by = df.groupBy(category, fold).agg(F.sum(target).alias("s_own"), F.count(target).alias("n_own"))
    total = by.groupBy(category).agg(F.sum("s_own").alias("s_cat"), F.sum("n_own").alias("n_cat"))
    every = by.groupBy(fold).agg(F.sum("s_own").alias("s_fold"), F.sum("n_own").alias("n_fold"))
    overall = by.agg(F.sum("s_own").alias("s_all"), F.sum("n_own").alias("n_all"))
    means = by.join(total, category).join(every, fold).join(F.broadcast(overall))
    rest = lambda a, b: (F.col(f"s_{a}") - F.col(f"s_{b}")) / (F.col(f"n_{a}") - F.col(f"n_{b}"))
    other = F.when(F.col("n_cat") > F.col("n_own"), rest("cat", "own")).otherwise(rest("all", "fold"))
    return df.join(means.select(category, fold, other.alias("encoded")), [category, fold])


def regression_metrics(df: DataFrame, by: Sequence[str], truth: str, guess: str) -> DataFrame:
    """n, MSE, MAE, R2 and correlation per group."""
    e = F.col(truth) - F.col(guess)
    return df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.avg(e * e) / F.var_pop(truth)).alias("r2"), F.corr(truth, guess).alias("corr")
    )


def transforms(value: str, mean: Column, std: Column, low: Column, high: Column) -> dict[str, tuple[Column, Column]]:
    """Target transforms and what each becomes when it is undone."""
    x = F.col(value)
    z, m, shift = (x - mean) / std, (x - low) / (high - low), F.abs(low) + 1
    log = F.log1p(x + shift)
    return {"z": (z, z * std + mean), "min_max": (m, m * (high - low) + low), "log": (log, F.expm1(log) - shift)}


def common_keys(sets: dict[str, DataFrame]) -> DataFrame:
    """``(a, b, n_common)`` for each pair of key sets of one column, from each key's set of names; none in common means they are disjoint."""
    names = list(sets)
    key = sets[names[0]].columns[0]
    marks = [df.toDF(key).distinct().withColumn("bit", F.lit(1 << k)) for k, df in enumerate(sets.values())]
    bits = reduce(DataFrame.unionByName, marks).groupBy(key).agg(F.sum("bit").alias("bits"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    both = lambda i, j: F.coalesce(F.sum((F.col("bits").bitwiseAND((1 << i) | (1 << j)) == (1 << i) | (1 << j)).cast("bigint")), F.lit(0))
    one = bits.agg(*[both(i, j).alias(f"p{i}_{j}") for i, j in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"p{i}_{j}").alias("n_common")) for i, j in pairs])))


def hash_sample(df: DataFrame, by: Sequence[str], key: Column, n: int, seed: str = "sample") -> DataFrame:
    """``n`` rows of each group, the first by a hash of the key: what reservoir sampling gives, but the same each time.

    Each partition keeps its own first n of a group before they meet, so a group of any size sends few rows.
    """
    order = W.partitionBy(*by).orderBy("__h", "__k")
    return df.withColumns({"__k": key, "__h": hash32(key, seed)}).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).drop("__k", "__h", "__r")


def positional_split(df: DataFrame, key: str, n_val: int, ranks: int) -> DataFrame:
    """``(key, split, shard)``: by position the first ``n_val`` keys validate, the others are cut into contiguous shards, one for each rank."""
    placed, total = global_order(df.select(key).distinct(), key), df.select(key).distinct().agg(F.count("*").alias("__n"))
    shard = F.floor((F.col("position") - n_val - 1) * ranks / (F.col("__n") - n_val)).cast("int")
    return placed.join(F.broadcast(total)).select(key, F.when(F.col("position") <= n_val, "val").otherwise("train").alias("split"), F.when(F.col("position") > n_val, shard).alias("shard"))


def evaluation_order(df: DataFrame, key: str, target: str, seed: str = "0") -> DataFrame:
    """``(key, target, place)``: positives first, then the negatives in an order by hash; places from 0."""
    keyed = df.select(key, target, (-F.col(target)).alias("__t"), F.when(F.col(target) == 1, 0).otherwise(hash32(key, seed)).alias("__h"))
    return global_order(keyed, "__t", "__h", key).select(key, target, (F.col("position") - 1).alias("place"))


def weighted_draws(df: DataFrame, key: str, weight: str, seed: str = "draw") -> DataFrame:
    """``(key)``, a row for each of as many draws as there are rows, with replacement and chances by whole weights.

    A draw is a number below the sum of weights and falls to the row whose stretch holds it. Stretches are cut at multiples of a width, so that
    draws meet them by an equality and no draw is compared with all rows.
    """
    placed = global_order(df.select(key, F.col(weight).cast("bigint").alias("__w")), key, count="__w")
    total = placed.agg(F.sum("__w").alias("__total"), F.count("*").alias("__n"))
    width = F.greatest(F.lit(1), F.ceil(F.col("__total") / F.col("__n")).cast("bigint"))
    cells = placed.join(F.broadcast(total)).select(
        key, "before", "__w", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("__w") - 1) / width))).alias("__cell")
    ).filter("__w > 0")
    draws = placed.join(F.broadcast(total)).select(F.floor(uniform((F.col("position") - 1).cast("string"), seed) * F.col("__total")).alias("__u"), width.alias("__width"))
    met = draws.select("__u", F.floor(F.col("__u") / F.col("__width")).alias("__cell")).join(cells, "__cell")
    return met.filter((F.col("__u") >= F.col("before")) & (F.col("__u") < F.col("before") + F.col("__w"))).select(key)


def ranks_within(df: DataFrame, by: Sequence[str], score: str, into: str = "rank") -> DataFrame:
    """``df`` with the average rank of the score in its group. Distinct scores are counted first, so a group is as large as it has scores."""
    counts = df.groupBy(*by, score).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, 0))
    ranks = counts.withColumn(into, upto - F.col("__c") + (F.col("__c") + 1) / 2).drop("__c")
    return df.join(ranks, [*by, score])


def listed_income(income: DataFrame, ids: DataFrame, key: str, missing: Sequence[float]) -> DataFrame:
    """Income rows of the persons of a list given as text, without null and missing amounts; what is no number in the list is left out."""
    known = ids.select(F.col(key).try_cast("bigint").alias("rinpersoon")).filter("rinpersoon IS NOT NULL").distinct()
    return income.filter(F.col("income").isNotNull() & ~F.col("income").isin(list(missing))).join(known, "rinpersoon", "left_semi")


def data_checks(vectors: DataFrame, key: str, vector: str, values: DataFrame, value: str, year: str, last: int = 2022, least: int = 100) -> DataFrame:
    """``(check, holds)``: what an evaluation relies on."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    there = F.col(vector).isNotNull()
    v = vectors.agg((F.count_distinct(F.when(there, F.size(vector))) == 1).alias("a"), (F.sum(F.when(there & odd, 1).otherwise(0)) == 0).alias("b"), (F.sum((~there).cast("int")) == 0).alias("c"))
    w = values.agg((F.sum((F.col(value).isNull() | F.isnan(value)).cast("int")) == 0).alias("d"), (F.max(year) <= last).alias("e"))
    n = vectors.filter(there).select(key).intersect(values.select(key)).agg((F.count("*") >= least).alias("f"))
    one = v.join(F.broadcast(w)).join(F.broadcast(n))
    names = ("vectors have one length", "vectors are numbers", "no vector is missing", "values are numbers", f"no year beyond {last}", "a hundred in common")
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("check"), F.col(c).alias("holds")) for c, t in zip("abcdef", names)])))
