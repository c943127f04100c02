"""Cleaning, describing and joining tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrays
from ..functions.hashing import uniform
from ..operators import cleaning as cl, ranking
from ..sources.tables import table

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
REAL = "income IS NOT NULL AND NOT isnan(income) AND income NOT IN (9999999999, 8888888888)"


def _income(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person_income", "rinpersoon", "year", "income", "is_eval").filter(REAL)


def missing_fill_round(spark: SparkSession, d: str) -> DataFrame:
    rows = cl.require_times(table(spark, d, "life_events"), "daysSinceFirstEvent", "age")
    return rows.select(
        "RINPERSOON", cl.round_half_even("daysSinceFirstEvent").alias("days"), cl.round_half_even("age").alias("age"),
        cl.fill_missing("event_code").alias("event_code"), cl.fill_missing(cl.round_half_even("amount")).alias("amount"),
    )


def percentile_tokens(spark: SparkSession, d: str) -> DataFrame:
    b = ranking.percentile_buckets(_income(spark, d).select("rinpersoon", "year", "income"), "income", "bucket")
    return b.select("rinpersoon", "year", F.concat(F.lit("income_"), F.col("bucket")).alias("token"))


def topn_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = cl.top_or_other(table(spark, d, "life_events", "event_code"), "event_code", 100)
    return rows.groupBy("event_code").agg(F.count("*").alias("n"))


def special_values(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "life_events_meta", "Name", "Type", "ValueLabels").select("Name", "Type", cl.parse_labels("ValueLabels").alias("labels"))
    rows = table(spark, d, "life_events", "event_code", "amount").filter("amount IS NOT NULL AND (amount = 9999999999 OR amount <= 0)")
    met = rows.join(meta, rows["event_code"] == meta["Name"])
    return met.select("event_code", cl.substitute_special("amount", F.col("labels"), F.col("Type") == "Numeric").alias("value")).groupBy("event_code", "value").agg(F.count("*").alias("n"))


def try_cast_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events", "event_type", "props").select("event_type", k.alias("k")).filter("k IS NOT NULL AND k != 99").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum((F.col("k") == 0).cast("int")).alias("zeros"), F.sum("k").alias("total")
    )


def describe_numeric(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "person_income", "year", "income").withColumn("income", F.when(F.expr(REAL), F.col("income")))
    out = cl.describe_numeric(rows, ["year"], "income")
    return out.select("year", "n", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


def describe_categorical(spark: SparkSession, d: str) -> DataFrame:
    return cl.describe_categorical(table(spark, d, "life_events", "event_code"), "event_code").select("category", F.round("share", 8).alias("share"))


def covariance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return cl.covariance_pairs(table(spark, d, "lineitem", *MEASURES), MEASURES).select("a", "b", (F.round("covariance", 4) + 0.0).alias("covariance"))


def inferred_metadata(spark: SparkSession, d: str) -> DataFrame:
    return cl.inferred_metadata(table(spark, d, "part"))


def id_uniqueness_check(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "person_background", "rinpersoon").select(F.col("rinpersoon").cast("string").alias("x"))
    return ids.agg(F.count("x").alias("n"), F.count_distinct(F.col("x").try_cast("bigint")).alias("n_distinct"), F.sum(F.when(F.col("x").try_cast("bigint").cast("string") != F.col("x"), 1).otherwise(0)).alias("n_changed"))


def mean_impute(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "person_income", "rinpersoon", "year", "income").withColumn("income", F.when(F.expr(REAL), F.col("income")))
    return cl.mean_impute(rows, ["year"], "income").groupBy("year").agg(F.round(F.avg("income"), 4).alias("mean"), F.count("income").alias("n"))


def winsor_minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = _income(spark, d)
    q = ranking.exact_quantiles(rows, ["year"], "income", [0.1, 0.25, 0.5, 0.75, 0.9])
    met = rows.join(q, "year")
    clipped = F.least(F.greatest("income", F.col("p")[0]), F.col("p")[4])
    width = lambda a, b: F.greatest(F.col("p")[b] - F.col("p")[a], F.lit(1e-9))
    return met.select(
        "rinpersoon", "year", "income", F.round((clipped - F.col("p")[0]) / width(0, 4), 6).alias("scaled"), F.round((F.col("income") - F.col("p")[2]) / width(1, 3), 6).alias("robust")
    )


def binned_income(spark: SparkSession, d: str) -> DataFrame:
    """Edges from the training persons' incomes; below the first edge there is no bin, from the last on the last one."""
    rows = _income(spark, d)
    edges = ranking.quantile_edges(rows.filter(uniform("rinpersoon", "bin") < 0.7), "income", [i / 10 for i in range(10)])
    bins = arrays.digitize("income", "edges")
    return rows.join(F.broadcast(edges)).select("rinpersoon", "year", "income", F.when(bins > 0, bins).alias("bin"))


_FILES = (("person_background", "rinpersoon"), ("person_income", "rinpersoon"), ("person_marriages", "rinpersoon"), ("person_embeddings", "rinpersoon"), ("spolisbus", "RINPERSOON"), ("life_events", "RINPERSOON"))


def file_overlap_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each id's set of files as bits; the sets are counted, so no ids are joined with each other."""
    marks = [table(spark, d, t, c).select(F.col(c).alias("id"), F.lit(1 << k).alias("bit")).filter("id IS NOT NULL").distinct() for k, (t, c) in enumerate(_FILES)]
    sets = reduce(DataFrame.unionAll, marks).groupBy("id").agg(F.sum("bit").cast("int").alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    has = lambda k: F.col("bits").bitwiseAND(1 << k) > 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    pairs = [(i, j) for i in range(len(_FILES)) for j in range(len(_FILES))]
    one = sets.agg(*[F.struct(count(has(i) & has(j)).alias("both"), count(has(i)).alias("a"), count(has(i) | has(j)).alias("any")).alias(f"p{i}{j}") for i, j in pairs])
    rows = [F.struct(F.lit(_FILES[i][0]).alias("file_a"), F.lit(_FILES[j][0]).alias("file_b"), F.col(f"p{i}{j}.both").alias("n_both"), (100.0 * F.col(f"p{i}{j}.both") / F.col(f"p{i}{j}.a")).alias("overlap"), (F.col(f"p{i}{j}.both") / F.col(f"p{i}{j}.any")).alias("jaccard")) for i, j in pairs]
    out = one.select(F.inline(F.array(*rows)))
    return out.select("file_a", "file_b", "n_both", F.round("overlap", 6).alias("overlap"), F.round("jaccard", 8).alias("jaccard"))


def embedding_sanity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "person_embeddings", "rinpersoon", "cls_emb").filter("cls_emb IS NOT NULL")
    odd = F.size(F.filter("cls_emb", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    fixed = arrays.finite_or_zero("cls_emb")
    unit = arrays.l2_normalise(fixed)
    return e.select(F.size("cls_emb").alias("width"), odd.alias("odd"), F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x).alias("length")).groupBy("width").agg(
        F.count("*").alias("n"), F.sum("odd").cast("bigint").alias("n_odd"), F.round(F.avg("length"), 5).alias("mean_length")
    )


def one_hot_target_encode(spark: SparkSession, d: str) -> DataFrame:
    """Brand groups as 0/1 columns; type as the mean price of its parts; whether a name is given."""
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_name", "p_retailprice")
    means = p.groupBy("p_type").agg(F.avg("p_retailprice").alias("mean"))
    hot = [(F.col("p_brand") == f"Brand#{k}").cast("int").alias(f"brand_{k}") for k in range(1, 6)]
    return p.join(means, "p_type").select("p_partkey", *hot, F.round("mean", 4).alias("type_mean"), F.col("p_name").isNotNull().cast("int").alias("named"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of union, intersection and differences of two id sets, and of the symmetric difference both ways."""
    a = table(spark, d, "person_income", "rinpersoon").distinct()
    b = table(spark, d, "person_marriages", "rinpersoon").distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "only_a": a.subtract(b), "only_b": b.join(a, "rinpersoon", "left_anti")}
    return reduce(DataFrame.unionAll, [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, x in parts.items()])


QUERIES = {
    q.__name__: q
    for q in (
        missing_fill_round, percentile_tokens, topn_categories, special_values, try_cast_filter, describe_numeric, describe_categorical, covariance_matrix,
        inferred_metadata, id_uniqueness_check, mean_impute, winsor_minmax_scale, binned_income, file_overlap_jaccard, embedding_sanity, one_hot_target_encode, set_operations,
    )
}

UNIFORM = "(('0x' || substr(md5({0}::VARCHAR || ':{1}'), 1, 8))::BIGINT / 4294967296.0)"

ORACLE = {
    "missing_fill_round": """
SELECT RINPERSOON, daysSinceFirstEvent::BIGINT AS days, age::BIGINT AS age, coalesce(event_code, 'MISSING') AS event_code,
       coalesce(round_even(amount, 0)::BIGINT::VARCHAR, 'MISSING') AS amount
FROM life_events WHERE daysSinceFirstEvent IS NOT NULL AND age IS NOT NULL""",
    "percentile_tokens": f"""
WITH r AS (SELECT rinpersoon, year, rank() OVER (ORDER BY income) + (count(*) OVER (PARTITION BY income) - 1) / 2.0 AS r, count(*) OVER () AS n
           FROM person_income WHERE {REAL})
SELECT rinpersoon, year, 'income_' || least(floor(r / n * 100), 99)::INTEGER AS token FROM r""",
    "topn_categories": """
WITH c AS (SELECT coalesce(event_code, 'MISSING') AS e FROM life_events),
t AS (SELECT e FROM c WHERE e <> 'MISSING' GROUP BY 1 ORDER BY count(*) DESC, e LIMIT 100)
SELECT CASE WHEN e = 'MISSING' OR e IN (FROM t) THEN e ELSE 'Others' END AS event_code, count(*) AS n FROM c GROUP BY 1""",
    "special_values": """
SELECT event_code,
       CASE WHEN m.Type = 'Numeric' THEN coalesce(nullif(regexp_extract(m.ValueLabels, '\\b' || (CASE WHEN amount = floor(amount) THEN amount::BIGINT::VARCHAR ELSE amount::VARCHAR END) || '''?\\s*:\\s*''([^'']*)''', 1), ''),
            CASE WHEN amount = 0 THEN 'SPECIAL_NUMERIC_ZERO' END, CASE WHEN amount = floor(amount) THEN amount::BIGINT::VARCHAR ELSE amount::VARCHAR END)
            ELSE CASE WHEN amount = floor(amount) THEN amount::BIGINT::VARCHAR ELSE amount::VARCHAR END END AS value, count(*) AS n
FROM life_events e JOIN life_events_meta m ON e.event_code = m.Name WHERE amount = 9999999999 OR amount <= 0 GROUP BY 1, 2""",
    "try_cast_filter": """
WITH k AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_type, count(*) AS n, sum((k = 0)::INTEGER)::BIGINT AS zeros, sum(k)::BIGINT AS total FROM k WHERE k IS NOT NULL AND k <> 99 GROUP BY 1""",
    "describe_numeric": f"""
WITH r AS (SELECT year, CASE WHEN {REAL} THEN income END AS income FROM person_income)
SELECT year, count(*) AS n, round(avg((income IS NULL)::INTEGER), 4) AS null_share, round(avg(income), 4) AS mean, round(stddev_pop(income), 4) AS std,
       {", ".join(f"round(quantile_cont(income, {q / 100}), 4) AS p{q}" for q in (10, 25, 50, 75, 90))} FROM r GROUP BY 1""",
    "describe_categorical": """
WITH c AS (SELECT event_code AS e, count(*) AS n FROM life_events WHERE event_code IS NOT NULL GROUP BY 1),
t AS (SELECT e FROM c WHERE n >= 10 ORDER BY n DESC, e LIMIT 5)
SELECT CASE WHEN e IN (FROM t) THEN e ELSE 'Others' END AS category, round(sum(n) / (SELECT sum(n) FROM c), 8) AS share FROM c GROUP BY 1""",
    "covariance_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) + 0.0 AS covariance FROM lineitem"
        for i, a in enumerate(MEASURES)
        for b in MEASURES[i:]
    ),
    "inferred_metadata": " UNION ALL ".join(
        f"SELECT '{c}' AS Name, " + ("'String'" if text else f"CASE WHEN count(DISTINCT {c}) <= 100 THEN 'String' ELSE 'Numeric' END") + " AS Type" + ("" if text else " FROM part")
        for c, text in (("p_partkey", 0), ("p_name", 1), ("p_brand", 1), ("p_type", 1), ("p_size", 0), ("p_retailprice", 0))
    ),
    "id_uniqueness_check": "SELECT count(rinpersoon) AS n, count(DISTINCT rinpersoon) AS n_distinct, 0::BIGINT AS n_changed FROM person_background",
    "mean_impute": f"SELECT year, round(avg(CASE WHEN {REAL} THEN income END), 4) AS mean, count(*) AS n FROM person_income GROUP BY 1",
    "winsor_minmax_scale": f"""
WITH r AS (SELECT rinpersoon, year, income FROM person_income WHERE {REAL}),
q AS (SELECT year, quantile_cont(income, [0.1, 0.25, 0.5, 0.75, 0.9]) AS p FROM r GROUP BY 1)
SELECT rinpersoon, year, income, round((least(greatest(income, p[1]), p[5]) - p[1]) / greatest(p[5] - p[1], 1e-9), 6) AS scaled,
       round((income - p[3]) / greatest(p[4] - p[2], 1e-9), 6) AS robust FROM r JOIN q USING (year)""",
    "binned_income": f"""
WITH r AS (SELECT rinpersoon, year, income FROM person_income WHERE {REAL}),
e AS (SELECT DISTINCT unnest(quantile_cont(income, [{", ".join(str(i / 10) for i in range(10))}])) AS e FROM r WHERE {UNIFORM.format("rinpersoon", "bin")} < 0.7),
l AS (SELECT list(e) AS edges FROM e)
SELECT rinpersoon, year, income, nullif(len(list_filter(edges, lambda x: x <= income)), 0)::INTEGER AS bin FROM r, l""",
    "file_overlap_jaccard": "WITH f AS (" + " UNION ".join(f"SELECT '{t}' AS f, {c} AS id FROM {t} WHERE {c} IS NOT NULL" for t, c in _FILES) + """),
n AS (SELECT f, count(*) AS n FROM f GROUP BY 1),
b AS (SELECT x.f AS a, y.f AS b, count(*) AS nb FROM f x JOIN f y USING (id) GROUP BY 1, 2)
SELECT n1.f AS file_a, n2.f AS file_b, coalesce(nb, 0) AS n_both, round(100.0 * coalesce(nb, 0) / n1.n, 6) AS overlap,
       round(coalesce(nb, 0) / (n1.n + n2.n - coalesce(nb, 0)), 8) AS jaccard FROM n n1 CROSS JOIN n n2 LEFT JOIN b ON b.a = n1.f AND b.b = n2.f""",
    "embedding_sanity": """
WITH e AS (SELECT cls_emb AS x, list_transform(cls_emb, lambda v: CASE WHEN v IS NULL OR NOT isfinite(v) THEN 0.0 ELSE v END::DOUBLE) AS y FROM person_embeddings WHERE cls_emb IS NOT NULL),
s AS (SELECT len(x) AS width, len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) AS odd, list_sum(list_transform(y, lambda v: v * v)) > 0 AS sound FROM e)
SELECT width::INTEGER AS width, count(*) AS n, sum(odd)::BIGINT AS n_odd, round(avg(coalesce(sound, false)::INTEGER), 5) AS mean_length FROM s GROUP BY 1""",
    "one_hot_target_encode": f"""
SELECT p_partkey, {", ".join(f"(p_brand = 'Brand#{k}')::INTEGER AS brand_{k}" for k in range(1, 6))},
       round(avg(p_retailprice) OVER (PARTITION BY p_type), 4) AS type_mean, (p_name IS NOT NULL)::INTEGER AS named FROM part""",
    "set_operations": """
WITH a AS (SELECT DISTINCT rinpersoon FROM person_income), b AS (SELECT DISTINCT rinpersoon FROM person_marriages)
SELECT 'union' AS part, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b)
UNION ALL SELECT 'only_a', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'only_b', count(*) FROM (FROM b EXCEPT FROM a)""",
}
