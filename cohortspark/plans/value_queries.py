"""Strings, dates, projections, checks and summaries of columns, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import dates, strings as st
from ..functions.hashing import hash32, uniform
from ..operators import cleaning as cl, labels as lb, ranking
from ..sources import files
from ..sources.tables import table
from .cleaning_queries import REAL, UNIFORM


def string_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spolisbus", "IKVID", "contractType", "jobType", "begJob", "nbHours").distinct()
    text = F.concat(F.coalesce("contractType", F.lit("--")), F.lit("--"), F.format_string("%.2f", F.floor("nbHours") / 100))
    name, share = st.class_and_probability(text)
    path = F.concat(F.lit("in/2001/y"), F.date_format("begJob", "yyyyMMdd"), F.lit(".csv"))
    return rows.select(
        "IKVID", F.substring("IKVID", 1, 4).alias("head"), F.substring("IKVID", 2, 3).alias("middle"), st.joined_fields("contractType", "jobType").alias("joined"),
        name.alias("class"), F.round(share, 4).alias("probability"), st.short_year(F.date_format("begJob", "yyyy-MM-dd")).alias("short_year"),
        st.short_number(F.floor("nbHours") * 10 + 1).alias("hours"), st.year_replaced(path, 1999).alias("path"),
    )


def date_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spolisbus", "begJob", "endJob").filter("begJob IS NOT NULL AND endJob IS NOT NULL AND year(endJob) < 3000 AND endJob >= begJob").distinct()
    born = F.date_sub("begJob", 6000)
    return rows.select(
        "begJob", "endJob", F.date_format(dates.parse_date(F.date_format("begJob", "yyyyMMdd"), "yyyyMMdd"), "yyyy-MM-dd").alias("parsed"), dates.parse_date(F.date_format("begJob", "yyyy/MM"), "yyyyMMdd").isNull().alias("is_bad"),
        F.date_format(dates.date_of_sas_day(F.datediff("begJob", F.lit("1960-01-01").cast("date")) + 7), "yyyy-MM-dd").alias("sas"), dates.num_months("endJob", "begJob").alias("months"),
        F.date_format(dates.add_years("begJob", 3), "yyyy-MM-dd").alias("three_on"), dates.bounded_age("endJob", born, 18, 40).alias("age"),
    )


_SOURCES = {"spolisbus": "JOB", "inpatab": "INCOME", "household": "HOME"}


def cleaned_columns(spark: SparkSession, d: str) -> DataFrame:
    """Keys and times pass, restricted columns go, others become text; sources by a dict."""
    rows = table(spark, d, "life_events").withColumn("source", cl.mapped(F.lower("source"), _SOURCES)).withColumn("amount", F.col("amount").cast("decimal(14,2)"))
    out = cl.cleaned_columns(rows, ["RINPERSOON", "daysSinceFirstEvent", "age"], ["loaded", "RINPERSOON2"], cl.fill_missing)
    return out.withColumnsRenamed({"RINPERSOON": "person", "daysSinceFirstEvent": "days"})


def modulus_sample(spark: SparkSession, d: str) -> DataFrame:
    return cl.by_modulus(table(spark, d, "life_events", "RINPERSOON", "daysSinceFirstEvent", "event_code"), "RINPERSOON")


def top_labelled_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = cl.top_labelled(table(spark, d, "life_events", "event_code"), "event_code", table(spark, d, "life_events_meta", "Name"))
    return rows.groupBy("event_code").agg(F.count("*").alias("n"))


def special_zeros(spark: SparkSession, d: str) -> DataFrame:
    out = cl.special_zeros(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"])
    count = lambda c: F.sum((F.col(c) == cl.ZERO).cast("bigint")).alias(c)
    return out.agg(F.count("*").alias("n"), count("l_discount"), count("l_tax"))


def column_report(spark: SparkSession, d: str) -> DataFrame:
    """For each column of person_background: constant or not, and whether its name tells of a person."""
    df = table(spark, d, "person_background").withColumn("one", F.lit(1))
    kept, pii = cl.drop_constant(df).columns, cl.columns_holding(df, ["rin", "name", "city"])
    return spark.createDataFrame([(c, c not in kept, c in pii) for c in df.columns], "column string, is_constant boolean, is_pii boolean")


def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    return cl.missing_counts(table(spark, d, "person_background"), 3)


def year_limits(spark: SparkSession, d: str) -> DataFrame:
    return cl.year_limits([(n, table(spark, d, n, c), x) for n, c, x in (("person_income", "year", F.col("year")), ("person_marriages", "year", F.col("year")), ("spolisbus", "begJob", F.year("begJob")))])


def log_summary(spark: SparkSession, d: str) -> DataFrame:
    """Incomes read as a log: the year as step, an amount that is missing or coded as no number."""
    rows = table(spark, d, "person_income", "is_eval", "year", "income")
    return cl.log_summary(rows.withColumn("loss", F.when(F.expr(REAL), F.col("income").cast("string")).otherwise("nan")), "is_eval", "year", "loss")


def nan_fractions(spark: SparkSession, d: str) -> DataFrame:
    return cl.nan_fractions(table(spark, d, "person_embeddings", "cls_emb", "mean_emb"), ["cls_emb", "mean_emb"]).select("layer", F.round("fraction", 10).alias("fraction"))


def factor_codes(spark: SparkSession, d: str) -> DataFrame:
    return cl.factor_codes(table(spark, d, "spolisbus", "contractType"), "contractType").groupBy("contractType", "code").agg(F.count("*").alias("n"))


def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Event codes in natural order: C2 before C10."""
    codes = table(spark, d, "life_events", "event_code").filter("event_code IS NOT NULL").distinct()
    text, number = st.natural_parts("event_code")
    ordered = ranking.global_order(codes.withColumns({"t": text, "k": number}), "t", "k", "event_code")
    return ordered.select("event_code", (F.col("position") - 1).alias("place"))


def flagged_by_membership(spark: SparkSession, d: str) -> DataFrame:
    """Income rows of three years with a flag: whether the person is one of those married in the data, and only rows flagged 0 or 1 as held out."""
    members = table(spark, d, "person_marriages", "rinpersoon")
    rows = table(spark, d, "person_income", "rinpersoon", "year", "is_eval").filter("year IN (2012, 2015, 2018) AND is_eval = 1")
    return files.flagged(rows, "rinpersoon", members, "is_married").groupBy("year", "is_married").agg(F.count("*").alias("n"))


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.first_rows(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), 50, "o_orderkey")


def disjoint_subsets(spark: SparkSession, d: str) -> DataFrame:
    """How many keys each pair of evaluation subsets has in common."""
    s = lb.hash_subsets(table(spark, d, "person_marriages", "rinpersoon"), "rinpersoon", [("model", 400), ("eval", 100), ("rank", 100)], "subset")
    return lb.common_keys({n: s.filter(F.col("subset") == n).select("rinpersoon") for n in ("model", "eval", "rank")})


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Of each event code five rows, by hash."""
    rows = table(spark, d, "life_events", "event_code", "RINPERSOON", "daysSinceFirstEvent").filter("event_code IS NOT NULL AND RINPERSOON IS NOT NULL AND daysSinceFirstEvent IS NOT NULL").distinct()
    return lb.hash_sample(rows, ["event_code"], F.concat_ws("-", "RINPERSOON", "daysSinceFirstEvent", "event_code"), 5)


def positional_split(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 persons validate, the others are dealt to four ranks in order."""
    p = table(spark, d, "person_background", "rinpersoon").distinct()
    return lb.positional_split(p, "rinpersoon", 200, 4)


def evaluation_order(spark: SparkSession, d: str) -> DataFrame:
    """Positives first, negatives shuffled."""
    rows = table(spark, d, "person_income", "rinpersoon", "income").filter(f"{REAL}").groupBy("rinpersoon").agg((F.max("income") > 60000).cast("int").alias("target"))
    return lb.evaluation_order(rows, "rinpersoon", "target")


def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """As many draws as persons, with replacement, by weight."""
    rows = table(spark, d, "person_background", "rinpersoon").distinct().withColumn("weight", F.when(F.pmod("rinpersoon", F.lit(10)) == 0, 9).otherwise(1))
    return lb.weighted_draws(rows, "rinpersoon", "weight").groupBy("rinpersoon").agg(F.count("*").alias("n"))


def rank_within(spark: SparkSession, d: str) -> DataFrame:
    """Average rank of a score within year and gender of the marriages."""
    rows = table(spark, d, "person_marriages", "marriage_id", "rinpersoon", "partner", "year").filter("year IS NOT NULL").distinct()
    return lb.ranks_within(rows.withColumn("score", F.floor(uniform("rinpersoon", "score") * 20)), ["year"], "score").select("marriage_id", "partner", "year", "score", "rank")


def synthetic_table(spark: SparkSession, d: str) -> DataFrame:
    """A thousand invented rows with the mean, deviation, tenth percentile and null share of the incomes of a year."""
    real = table(spark, d, "person_income", "year", "income").filter("year = 2015").withColumn("income", F.when(F.expr(REAL), F.col("income")))
    s = cl.describe_numeric(real, ["year"], "income").first()
    return files.synthetic(spark, 1000, {"income": (s["mean"], s["std"], s["p10"], s["null_share"])}, {"gender": [("1", 0.49), ("2", 0.51)]}).select("id", "gender", F.round("income", 2).alias("income"))


def person_list_income(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "person_marriages", "rinpersoon").select(F.col("rinpersoon").cast("string").alias("id"))
    return lb.listed_income(table(spark, d, "person_income", "rinpersoon", "year", "income"), ids, "id", [9999999999.0, 8888888888.0]).groupBy("year").agg(F.count("*").alias("n"), F.max("income").alias("highest"))


def data_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the inputs of an evaluation: each with whether it holds."""
    e = table(spark, d, "person_embeddings", "rinpersoon", "cls_emb")
    return lb.data_checks(e, "rinpersoon", "cls_emb", table(spark, d, "person_income", "rinpersoon", "year", "income"), "income", "year")


QUERIES = {
    q.__name__: q
    for q in (
        string_functions, date_functions, cleaned_columns, modulus_sample, top_labelled_codes, special_zeros, column_report, missing_columns, year_limits, log_summary, nan_fractions,
        factor_codes, natural_order, flagged_by_membership, first_rows, disjoint_subsets, hash_sample, positional_split, evaluation_order, weighted_sample, rank_within, synthetic_table,
        person_list_income, data_checks,
    )
}

_H = "('0x' || substr(md5({0} || ':{1}'), 1, 8))::BIGINT"
_SUBSET = f"""k AS (SELECT x, row_number() OVER (ORDER BY {_H.format("x::VARCHAR", "subset")}, x) AS r FROM (SELECT DISTINCT rinpersoon AS x FROM person_marriages WHERE rinpersoon IS NOT NULL)),
s AS (SELECT x, CASE WHEN r <= 400 THEN 'model' WHEN r <= 500 THEN 'eval' WHEN r <= 600 THEN 'rank' END AS subset FROM k WHERE r <= 600)"""

ORACLE = {
    "string_functions": r"""
WITH r AS (SELECT DISTINCT IKVID, contractType, jobType, begJob, nbHours FROM spolisbus),
t AS (SELECT *, coalesce(contractType, '--') || '--' || printf('%.2f', floor(nbHours) / 100) AS x, 'y' || strftime(begJob, '%Y%m%d') || '.csv' AS p FROM r)
SELECT IKVID, substr(IKVID, 1, 4) AS head, substr(IKVID, 2, 3) AS middle, CASE WHEN contractType IS NOT NULL OR jobType IS NOT NULL THEN concat_ws(' ', contractType, jobType) END AS joined,
       CASE WHEN regexp_matches(x, '^.*--\d+\.\d+$') THEN regexp_extract(x, '^(.*)--(\d+\.\d+)$', 1) END AS "class", round(nullif(regexp_extract(x, '^(.*)--(\d+\.\d+)$', 2), '')::DOUBLE, 4) AS probability,
       nullif(regexp_extract(strftime(begJob, '%Y-%m-%d'), '20(\d\d)', 1), '') AS short_year, CASE WHEN abs(floor(nbHours) * 10 + 1) >= 1000 THEN printf('%.2e', floor(nbHours) * 10 + 1) ELSE printf('%.2f', floor(nbHours) * 10 + 1) END AS hours,
       CASE WHEN p IS NOT NULL THEN 'in/2001/' || regexp_replace(p, '\d{4}', '1999', 'g') END AS path FROM t""",
    "date_functions": """
SELECT DISTINCT begJob, endJob, strftime(begJob, '%Y-%m-%d') AS parsed, true AS is_bad, strftime(begJob + 7, '%Y-%m-%d') AS sas,
       ((year(endJob) - year(begJob)) * 12 + month(endJob) - month(begJob) - (day(endJob) < day(begJob))::INTEGER)::INTEGER AS months,
       strftime(CASE WHEN month(begJob) = 2 AND day(begJob) = 29 THEN make_date(year(begJob) + 3, 3, 1) ELSE (begJob + INTERVAL 3 YEAR)::DATE END, '%Y-%m-%d') AS three_on,
       CASE WHEN floor(((year(endJob) - year(begJob - 6000)) * 12 + month(endJob) - month(begJob - 6000) - (day(endJob) < day(begJob - 6000))::INTEGER) / 12) BETWEEN 18 AND 40
            THEN floor(((year(endJob) - year(begJob - 6000)) * 12 + month(endJob) - month(begJob - 6000) - (day(endJob) < day(begJob - 6000))::INTEGER) / 12)::INTEGER END AS age
FROM spolisbus WHERE begJob IS NOT NULL AND endJob IS NOT NULL AND year(endJob) < 3000 AND endJob >= begJob""",
    "cleaned_columns": """
SELECT RINPERSOON AS person, daysSinceFirstEvent AS days, age, coalesce(CASE lower(source) WHEN 'spolisbus' THEN 'JOB' WHEN 'inpatab' THEN 'INCOME' WHEN 'household' THEN 'HOME' END, 'MISSING') AS source,
       coalesce(event_code, 'MISSING') AS event_code, coalesce(amount::DECIMAL(14, 2)::VARCHAR, 'MISSING') AS amount FROM life_events""",
    "modulus_sample": "SELECT RINPERSOON, daysSinceFirstEvent, event_code FROM life_events WHERE RINPERSOON % 100 = 0",
    "top_labelled_codes": """
WITH t AS (SELECT event_code AS e FROM life_events WHERE event_code IN (SELECT Name FROM life_events_meta) GROUP BY 1 ORDER BY count(*) DESC, e LIMIT 100)
SELECT CASE WHEN event_code IN (SELECT Name FROM life_events_meta) AND event_code NOT IN (FROM t) THEN 'Others' ELSE event_code END AS event_code, count(*) AS n FROM life_events GROUP BY 1""",
    "special_zeros": "SELECT count(*) AS n, count(*) FILTER (l_discount = 0) AS l_discount, count(*) FILTER (l_tax = 0) AS l_tax FROM lineitem",
    "column_report": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) <= 1 AS is_constant, {str(pii).lower()} AS is_pii FROM " + ("person_background" if c != "one" else "(SELECT 1 AS one FROM person_background)")
        for c, pii in (("background_id", False), ("rinpersoon", True), ("gender", False), ("birth_year", False), ("birth_city", True), ("municipality", False), ("is_eval", False), ("valid_from", False), ("known_from", False), ("one", False))
    ),
    "missing_columns": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing FROM person_background"
        for c in ("background_id", "rinpersoon", "gender", "birth_year", "birth_city", "municipality", "is_eval", "valid_from", "known_from")
    ) + ') ORDER BY n_missing DESC, "column" LIMIT 3',
    "year_limits": """
SELECT 'person_income' AS name, min(year) AS "first", max(year) AS "last" FROM person_income UNION ALL SELECT 'person_marriages', min(year), max(year) FROM person_marriages
UNION ALL SELECT 'spolisbus', min(year(begJob))::INTEGER, max(year(begJob))::INTEGER FROM spolisbus""",
    "log_summary": f"""
SELECT is_eval, max(year) AS max_step, min(CASE WHEN {REAL} THEN income END) AS min_loss, min(CASE WHEN NOT coalesce({REAL}, false) THEN year END) AS first_nan FROM person_income GROUP BY 1""",
    "nan_fractions": " UNION ALL ".join(
        f"SELECT '{c}' AS layer, round(sum(len(list_filter({c}, lambda x: NOT isfinite(x)))) / sum(len({c})), 10) AS fraction FROM person_embeddings" for c in ("cls_emb", "mean_emb")
    ),
    "factor_codes": """
WITH f AS (SELECT contractType, row_number() OVER (ORDER BY contractType) AS code FROM (SELECT DISTINCT contractType FROM spolisbus WHERE contractType IS NOT NULL))
SELECT s.contractType, coalesce(code, -1)::BIGINT AS code, count(*) AS n FROM spolisbus s LEFT JOIN f USING (contractType) GROUP BY 1, 2""",
    "natural_order": r"""
WITH c AS (SELECT DISTINCT event_code, regexp_replace(event_code, '\d+$', '') AS t, coalesce(TRY_CAST(nullif(regexp_extract(event_code, '(\d+)$', 1), '') AS BIGINT), -1) AS k FROM life_events WHERE event_code IS NOT NULL)
SELECT event_code, row_number() OVER (ORDER BY t, k, event_code) - 1 AS place FROM c""",
    "flagged_by_membership": """
SELECT year, (rinpersoon IS NOT NULL AND rinpersoon IN (SELECT rinpersoon FROM person_marriages WHERE rinpersoon IS NOT NULL))::INTEGER AS is_married, count(*) AS n
FROM person_income WHERE year IN (2012, 2015, 2018) AND is_eval = 1 GROUP BY 1, 2""",
    "first_rows": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50",
    "disjoint_subsets": f"""WITH {_SUBSET} SELECT a.subset AS a, b.subset AS b, (SELECT count(*) FROM s x JOIN s y USING (x) WHERE x.subset = a.subset AND y.subset = b.subset) AS n_common
FROM (SELECT DISTINCT subset FROM s) a JOIN (SELECT DISTINCT subset FROM s) b ON (a.subset, b.subset) IN (('model', 'eval'), ('model', 'rank'), ('eval', 'rank'))""",
    "hash_sample": f"""
SELECT event_code, RINPERSOON, daysSinceFirstEvent FROM (SELECT DISTINCT event_code, RINPERSOON, daysSinceFirstEvent FROM life_events WHERE event_code IS NOT NULL AND RINPERSOON IS NOT NULL AND daysSinceFirstEvent IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY event_code ORDER BY {_H.format("RINPERSOON || '-' || daysSinceFirstEvent || '-' || event_code", "sample")}, RINPERSOON || '-' || daysSinceFirstEvent || '-' || event_code) <= 5""",
    "positional_split": """
WITH p AS (SELECT rinpersoon, row_number() OVER (ORDER BY rinpersoon) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT rinpersoon FROM person_background))
SELECT rinpersoon, CASE WHEN r <= 200 THEN 'val' ELSE 'train' END AS split, CASE WHEN r > 200 THEN ((r - 201) * 4 // (n - 200))::INTEGER END AS shard FROM p""",
    "evaluation_order": f"""
WITH t AS (SELECT rinpersoon, (max(income) > 60000)::INTEGER AS target FROM person_income WHERE {REAL} GROUP BY 1)
SELECT rinpersoon, target, row_number() OVER (ORDER BY target DESC, CASE WHEN target = 1 THEN 0 ELSE {_H.format("rinpersoon::VARCHAR", "0")} END, rinpersoon) - 1 AS place FROM t""",
    "weighted_sample": f"""
WITH p AS (SELECT rinpersoon, CASE WHEN rinpersoon % 10 = 0 THEN 9 ELSE 1 END AS w FROM (SELECT DISTINCT rinpersoon FROM person_background)),
c AS (SELECT *, sum(w) OVER (ORDER BY rinpersoon) AS upto, sum(w) OVER () AS total, row_number() OVER (ORDER BY rinpersoon) - 1 AS k FROM p),
d AS (SELECT floor({UNIFORM.format("k", "draw")} * total) AS u FROM c)
SELECT rinpersoon, count(*) AS n FROM d JOIN c ON u >= upto - w AND u < upto GROUP BY 1""",
    "rank_within": f"""
WITH r AS (SELECT DISTINCT marriage_id, rinpersoon, partner, year, floor({UNIFORM.format("rinpersoon", "score")} * 20)::BIGINT AS score FROM person_marriages WHERE year IS NOT NULL)
SELECT marriage_id, partner, year, score, rank() OVER (PARTITION BY year ORDER BY score) + (count(*) OVER (PARTITION BY year, score) - 1) / 2.0 AS rank FROM r""",
    "synthetic_table": f"""
WITH s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd, quantile_cont(x, 0.1) AS lo, avg((x IS NULL)::INTEGER) AS ns FROM (SELECT CASE WHEN {REAL} THEN income END AS x FROM person_income WHERE year = 2015)),
g AS (SELECT unnest(range(1000)) AS id)
SELECT id, CASE WHEN {UNIFORM.format("id", "gender")} < 0.49 THEN '1' ELSE '2' END AS gender,
       CASE WHEN {UNIFORM.format("id", "income-null")} >= ns THEN round(greatest(lo, m + sd * sqrt(-2 * ln(1 - {UNIFORM.format("id", "income-r")})) * cos(2 * pi() * {UNIFORM.format("id", "income-a")})), 2) END AS income FROM g, s""",
    "person_list_income": """
SELECT year, count(*) AS n, max(income) AS highest FROM person_income WHERE income IS NOT NULL AND income NOT IN (9999999999, 8888888888) AND rinpersoon IN (SELECT rinpersoon FROM person_marriages) GROUP BY 1""",
    "data_checks": """
SELECT 'vectors have one length' AS "check", count(DISTINCT len(cls_emb)) = 1 AS holds FROM person_embeddings WHERE cls_emb IS NOT NULL
UNION ALL SELECT 'vectors are numbers', count(*) FILTER (len(list_filter(cls_emb, lambda x: x IS NULL OR NOT isfinite(x))) > 0) = 0 FROM person_embeddings WHERE cls_emb IS NOT NULL
UNION ALL SELECT 'no vector is missing', count(*) FILTER (cls_emb IS NULL) = 0 FROM person_embeddings
UNION ALL SELECT 'values are numbers', count(*) FILTER (income IS NULL OR isnan(income)) = 0 FROM person_income
UNION ALL SELECT 'no year beyond 2022', max(year) <= 2022 FROM person_income
UNION ALL SELECT 'a hundred in common', (SELECT count(*) FROM (SELECT DISTINCT rinpersoon FROM person_embeddings WHERE cls_emb IS NOT NULL INTERSECT SELECT DISTINCT rinpersoon FROM person_income)) >= 100""",
}
