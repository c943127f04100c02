"""Unions between persons: their ends, labels, genders, households, and the vectors of both partners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .labels import mutual_rows

#: End of a union that lasts.
LASTS = 2200


def with_ends(unions: DataFrame, a: str, b: str, year: str) -> DataFrame:
    """``(a, b, year, end_year)``, each once: a union ends in the year in which one of the two is next entered with someone else, else in ``LASTS``."""
    rows = unions.select(a, b, year).distinct()
    own = rows.select(F.col(a).alias("__p"), F.col(b).alias("__q"), F.col(year).alias("__y"))
    pairs = rows.select(a, b, year, F.explode(F.array(a, b)).alias("__p"))
    later = pairs.join(own, "__p", "left").filter(F.col("__y").isNull() | ((F.col("__y") > F.col(year)) & ~F.col("__q").isin(F.col(a), F.col(b))))
    ends = later.groupBy(a, b, year).agg(F.min("__y").alias("end_year"))
    return rows.join(ends, [a, b, year], "left").withColumn("end_year", F.coalesce("end_year", F.lit(LASTS)))


def divorce_labels(unions: DataFrame, cutoff: int, a: str = "rinpersoon", b: str = "partner", kinds: Sequence[str] = ("H", "P")) -> DataFrame:
    """Unions that stood at the end of the year ``cutoff``, with ``label``: whether they end later.

    ``unions``: ``a, b, year, end_year, kind, reason``. Taken are those entered alike from both sides, of the given kinds; those that end for
    another reason than divorce (``S``) are left out.
    """
    both = mutual_rows(unions, a, b, ["year", "end_year"]).filter(F.col("kind").isin(list(kinds)))
    ended = F.col("end_year") != LASTS
    kept = both.filter(~(ended & (F.coalesce("reason", F.lit("ACTIVE")) != "S")))
    return kept.filter((F.col("year") <= cutoff) & (F.col("end_year") > cutoff)).withColumn("label", ended.cast("int"))


def by_gender(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """``(year, person, partner, gender, partner_gender)``; pairs of which a gender isn't known are left out."""
    known = people.filter("gender IS NOT NULL").select("rinpersoon", "gender")
    return pairs.join(known.toDF("person", "gender"), "person").join(known.toDF("partner", "partner_gender"), "partner")


def households(unions: DataFrame, people: DataFrame, income: DataFrame) -> DataFrame:
    """One row per couple: the elder as ``reference`` person (the smaller number if equal or unknown), the ``other``, when they were born, their incomes and in how many couples each is.

    A couple's two rows are turned into columns by conditional firsts; couples of which a person isn't in ``people`` are left out.
    """
    couples = unions.select(F.least("rinpersoon", "partner").alias("a"), F.greatest("rinpersoon", "partner").alias("z")).filter("a IS NOT NULL AND z IS NOT NULL AND a != z").distinct()
    sides = couples.select("a", "z", F.explode(F.array("a", "z")).alias("rinpersoon"))
    number = sides.groupBy("rinpersoon").agg(F.count("*").alias("unions"))
    known = people.select("rinpersoon", F.col("birth_year").alias("born"))
    met = sides.join(known, "rinpersoon").join(number, "rinpersoon").join(income, "rinpersoon", "left")
    order = F.struct(F.coalesce("born", F.lit(9999)), "rinpersoon")
    row = F.struct("rinpersoon", "born", "income", "unions")
    wide = met.groupBy("a", "z").agg(F.min_by(row, order).alias("r"), F.max_by(row, order).alias("o"), F.count("*").alias("n")).filter("n = 2")
    return wide.select(
        F.col("r.rinpersoon").alias("reference"), F.col("o.rinpersoon").alias("other"), F.col("r.born").alias("reference_born"), F.col("o.born").alias("other_born"),
        F.col("r.income").alias("reference_income"), F.col("o.income").alias("other_income"), F.col("r.unions").alias("reference_unions"), F.col("o.unions").alias("other_unions"),
    )


def with_variable(vectors: DataFrame, variable: DataFrame, baseline: DataFrame | None = None, columns: Sequence[str] = (), key: str = "rinpersoon") -> DataFrame:
    """Vectors that have a value of the variable, as ``x``; with a baseline its numbers follow the vector, and persons without them are left out."""
    met = vectors.join(variable, key)
    if baseline is None:
        return met.withColumn("x", F.transform("vec", lambda v: v.cast("double")))
    full = met.join(baseline.select(key, *columns).dropna(), key)
    return full.withColumn("x", F.concat(F.transform("vec", lambda v: v.cast("double")), F.array(*[F.col(c).cast("double") for c in columns])))


def pair_vectors(pairs: DataFrame, vectors: DataFrame, a: str = "rinpersoon", b: str = "partner") -> DataFrame:
    """``pairs`` of which both have a vector, with both one behind the other as ``x``."""
    met = pairs.join(vectors.toDF(a, "__a"), a).join(vectors.toDF(b, "__b"), b)
    return met.withColumn("x", F.transform(F.concat("__a", "__b"), lambda v: v.cast("double"))).drop("__a", "__b")
