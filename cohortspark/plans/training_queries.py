"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bitemporal, event_features as ef, intervals as iv
from ..sources.tables import table

#: As-of day and widths of the window features.
AS_OF, WIDTHS = 16500, (365, 1826)


def _store(spark: SparkSession, d: str) -> DataFrame:
    names = ("RINPERSOON", "event_code", "daysSinceFirstEvent", "amount", "age")
    return ef.cumulative_store(ef.clean_events(table(spark, d, "life_events", *names)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ends = ef.latest(_store(spark, d))
    case = (F.col("n") >= 3) & (F.col("last_day") >= 16500) & (F.col("total") >= 5000)
    return ends.filter(case).select(F.col("entity").alias("RINPERSOON"), F.col("code").alias("event_code"))


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per person; the features as one text, so that they can be compared with SQL."""
    one = lambda x: F.concat_ws(":", x["code"], x["n"], x["last_day"], F.format_string("%.2f", x["total"]))
    return ef.entity_table(_store(spark, d)).select(
        F.col("entity").alias("RINPERSOON"), F.col("n_events").cast("long"), F.round("total", 2).alias("total"), "last_day", "age",
        F.concat_ws(";", F.transform("features", one)).alias("features"),
    )


def p5_windows(spark: SparkSession, d: str) -> DataFrame:
    wide = ef.window_features(_store(spark, d), AS_OF, WIDTHS)
    return wide.select(F.col("entity").alias("RINPERSOON"), F.col("code").alias("event_code"), *[F.col(c) for c in wide.columns[2:]])


def _spells(spark: SparkSession, d: str) -> tuple[DataFrame, str, str, str]:
    return table(spark, d, "spolisbus", "RINPERSOON", "begJob", "endJob"), "RINPERSOON", "begJob", "endJob"


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return iv.gaps(*_spells(spark, d)).select(F.col("entity").alias("RINPERSOON"), iv.day_text("beg").alias("gap_beg"), iv.day_text("end").alias("gap_end"))


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("end") < iv.OPEN_END, iv.day_text("end"))
    return iv.periods(*_spells(spark, d)).select(F.col("entity").alias("RINPERSOON"), iv.day_text("beg").alias("period_beg"), end.alias("period_end"))


def _as_known(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.make_date(F.col("year"), F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date"))
    marriages = table(spark, d, "person_marriages", "marriage_id", "rinpersoon", "year")
    versions = table(spark, d, "person_background", "background_id", "rinpersoon", "valid_from", "known_from")
    return bitemporal.as_known(marriages, versions, "rinpersoon", day, "rinpersoon", "background_id", "valid_from", "known_from")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    several = table(spark, d, "person_background", "rinpersoon").groupBy("rinpersoon").count().filter("count >= 2").select("rinpersoon")
    known = _as_known(spark, d).filter("as_known_id is not null")
    return known.join(several, "rinpersoon", "left_semi").select("marriage_id", F.col("as_known_id").alias("background_id")).distinct()


def p7_as_known(spark: SparkSession, d: str) -> DataFrame:
    """Every marriage row's year and person with the attributes known then."""
    values = table(spark, d, "person_background", "background_id", "gender", "birth_year", "municipality")
    known = _as_known(spark, d)
    return known.join(values, known["as_known_id"] == values["background_id"], "left").select(
        "marriage_id", "rinpersoon", "year", "background_id", "gender", "birth_year", "municipality"
    )


QUERIES = {
    "p5_found": p5_found, "p5_features": p5_features, "p5_windows": p5_windows,
    "p6_found": p6_found, "p6_periods": p6_periods, "p7_found": p7_found, "p7_as_known": p7_as_known,
}

_EVENTS = """
WITH e AS (
  SELECT RINPERSOON, upper(trim(event_code, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))) AS event_code,
         daysSinceFirstEvent AS day, amount, max(CASE WHEN age BETWEEN 1 AND 120 THEN age END) AS age
  FROM life_events
  WHERE RINPERSOON IS NOT NULL AND event_code IS NOT NULL AND daysSinceFirstEvent BETWEEN 0 AND 17999
  GROUP BY 1, 2, 3, 4),
c AS (SELECT RINPERSOON, event_code, day, age, CASE WHEN amount IS NULL OR isnan(amount) OR amount = 9999999999 THEN 0.0 ELSE amount END AS amount FROM e)
"""

_SPELLS = """
WITH s AS (
  SELECT DISTINCT RINPERSOON, begJob::DATE AS b, coalesce(endJob::DATE, DATE '20000-01-01') AS e
  FROM spolisbus WHERE RINPERSOON IS NOT NULL AND begJob IS NOT NULL AND (endJob IS NULL OR endJob >= begJob)),
m AS (SELECT *, max(e) OVER (PARTITION BY RINPERSOON ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
"""

_KNOWN = """
WITH k AS (
  SELECT m.marriage_id, m.rinpersoon, m.year, b.background_id, b.gender, b.birth_year, b.municipality
  FROM person_marriages m LEFT JOIN person_background b
    ON b.rinpersoon = m.rinpersoon AND b.valid_from <= make_date(m.year, 1, 1) AND b.known_from <= make_date(m.year, 1, 1)
  QUALIFY row_number() OVER (PARTITION BY m.rowid_ ORDER BY b.valid_from DESC NULLS LAST, b.known_from DESC NULLS LAST, b.background_id DESC NULLS LAST) = 1)
""".replace("FROM person_marriages m", "FROM (SELECT *, row_number() OVER () AS rowid_ FROM person_marriages) m")

ORACLE = {
    "p5_found": _EVENTS + """
SELECT RINPERSOON, event_code FROM c GROUP BY 1, 2
HAVING count(*) >= 3 AND max(day) >= 16500 AND sum(amount) >= 5000""",
    "p5_features": _EVENTS + """,
g AS (SELECT RINPERSOON, event_code, count(*) AS n, max(day) AS last_day, sum(amount) AS total FROM c GROUP BY 1, 2),
a AS (SELECT RINPERSOON, max(age) AS age FROM (SELECT *, max(day) OVER (PARTITION BY RINPERSOON) AS newest FROM c) WHERE day = newest GROUP BY 1)
SELECT g.RINPERSOON, sum(n)::BIGINT AS n_events, round(sum(total), 2) AS total, max(last_day) AS last_day, any_value(a.age) AS age,
       string_agg(event_code || ':' || n || ':' || last_day || ':' || printf('%.2f', total), ';' ORDER BY event_code) AS features
FROM g JOIN a USING (RINPERSOON) GROUP BY 1""",
    "p5_windows": _EVENTS + f"""
SELECT RINPERSOON, event_code, count(*) AS n_all, sum(amount) AS total_all, ({AS_OF} - max(day))::INTEGER AS days_since_last"""
    + "".join(f""",
       count(*) FILTER (day > {AS_OF - w}) AS n_{w}, coalesce(sum(amount) FILTER (day > {AS_OF - w}), 0.0) AS total_{w}""" for w in WIDTHS)
    + f"""
FROM c WHERE day <= {AS_OF} GROUP BY 1, 2""",
    "p6_found": _SPELLS + """
SELECT RINPERSOON, strftime(reach + 1, '%Y-%m-%d') AS gap_beg, strftime(b - 1, '%Y-%m-%d') AS gap_end FROM m WHERE b > reach + 1""",
    "p6_periods": _SPELLS + """,
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR (reach < DATE '20000-01-01' AND b > reach + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY RINPERSOON ORDER BY b, e) AS island FROM m)
SELECT RINPERSOON, strftime(min(b), '%Y-%m-%d') AS period_beg,
       CASE WHEN max(e) < DATE '20000-01-01' THEN strftime(max(e), '%Y-%m-%d') END AS period_end FROM i GROUP BY RINPERSOON, island""",
    "p7_found": _KNOWN + """
SELECT DISTINCT marriage_id, background_id FROM k WHERE background_id IS NOT NULL
AND rinpersoon IN (SELECT rinpersoon FROM person_background GROUP BY 1 HAVING count(*) >= 2)""",
    "p7_as_known": _KNOWN + "SELECT * FROM k",
}
