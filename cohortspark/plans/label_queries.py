"""Labels, panels, baselines and the comparison of embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import uniform
from ..operators import evaluation as ev, labels as lb, ranking, spells as sp
from ..sources.tables import table
from .cleaning_queries import REAL, UNIFORM

K = 5


def _marriages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person_marriages", "marriage_id", "rinpersoon", "partner", "year").distinct()


def _income(spark: SparkSession, d: str) -> DataFrame:
    """One real amount per person and year: the largest."""
    return table(spark, d, "person_income", "rinpersoon", "year", "income").filter(REAL).groupBy("rinpersoon", "year").agg(F.max("income").alias("income"))


def _background(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "person_background", "background_id", "rinpersoon", "gender", "birth_year", "municipality")
    return lb.first_row(b, ["rinpersoon"], [F.col("background_id")]).select("rinpersoon", "gender", "birth_year", "municipality")


def mutual_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lb.mutual_rows(_marriages(spark, d), "rinpersoon", "partner", ["year"]).select("marriage_id", "rinpersoon", "partner", "year")


def pair_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return lb.pair_counts(_marriages(spark, d), "rinpersoon", "partner").groupBy("n").agg(F.count("*").alias("pairs"))


def first_union_labels(spark: SparkSession, d: str) -> DataFrame:
    m = _marriages(spark, d).filter("rinpersoon IS NOT NULL AND year IS NOT NULL")
    first = lb.first_row(m, ["rinpersoon"], [F.col("year"), F.col("marriage_id")]).select("rinpersoon", F.col("year").alias("first_year"), F.lit(1).alias("label"))
    never = lb.never_partnered(_background(spark, d).filter("birth_year BETWEEN 1930 AND 1995"), m, "rinpersoon").select("rinpersoon", F.lit(None).cast("int").alias("first_year"), F.lit(0).alias("label"))
    return first.unionByName(never)


def yearly_partner(spark: SparkSession, d: str) -> DataFrame:
    return lb.yearly_partner(_marriages(spark, d), "rinpersoon", "partner", "year", [F.col("marriage_id")])


def latest_non_null(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "person_background", "rinpersoon", "background_id", "gender", "birth_year", "municipality")
    return lb.latest_values(rows, "rinpersoon", "background_id", ["gender", "birth_year", "municipality"])


def panel_forward_fill_lag(spark: SparkSession, d: str) -> DataFrame:
    return sp.filled_panel(_income(spark, d), "rinpersoon", "year", "income")


def interval_residents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spolisbus", "RINPERSOON", "begJob", "endJob").filter("RINPERSOON IS NOT NULL")
    return sp.years_covered(rows, "RINPERSOON", F.year("begJob"), F.year("endJob"), (2000, 2020)).groupBy("year").agg(F.count("*").alias("n"))


def population_filter(spark: SparkSession, d: str) -> DataFrame:
    """Persons with at least three events of a year in the end of the eighties of the table's days and neither of two exclusions."""
    e = table(spark, d, "life_events", "RINPERSOON", "daysSinceFirstEvent", "event_code").filter("daysSinceFirstEvent BETWEEN 14000 AND 15000")
    busy = e.groupBy(F.col("RINPERSOON").alias("rinpersoon")).agg(F.count("*").alias("n"), F.count_distinct("event_code").alias("n_codes")).filter("n >= 3")
    low = _income(spark, d).groupBy("rinpersoon").agg(F.sum(F.when(F.col("income") <= 0, 1).otherwise(0)).alias("z")).filter("z > 0").select("rinpersoon")
    foreign = table(spark, d, "person_background", "rinpersoon", "birth_city").filter("birth_city IS NULL").select("rinpersoon")
    return busy.join(low.union(foreign).distinct(), "rinpersoon", "left_anti").join(_background(spark, d).select("rinpersoon"), "rinpersoon", "left_semi")


def survival_targets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "life_events", "RINPERSOON", "daysSinceFirstEvent", "event_code").filter("event_code LIKE 'HH%'").withColumnRenamed("RINPERSOON", "rinpersoon")
    return lb.survival_targets(_background(spark, d).select("rinpersoon"), e, "rinpersoon", "daysSinceFirstEvent", 15000, 17000)


def income_baseline_summary(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "person_income", "rinpersoon", "year", "income")
    real = F.when(F.expr(REAL), F.col("income"))
    met = i.withColumn("x", real).join(_background(spark, d), "rinpersoon", "left")
    by = lambda g: F.avg(F.when(F.col("gender") == g, F.col("x")))
    return met.groupBy("year").agg(
        F.count("*").alias("n"), F.max("x").alias("highest"), F.min("x").alias("lowest"), F.round(F.avg("x"), 4).alias("mean"), F.sum((F.col("x") == 0).cast("int")).alias("zeros"),
        F.sum(F.col("x").isNull().cast("int")).alias("unfound"), F.round(by(1) - by(2), 4).alias("gender_gap"),
    )


def background_income_join(spark: SparkSession, d: str) -> DataFrame:
    i, out = _income(spark, d), _background(spark, d)
    out = out.join(i.filter("year = 2015").select("rinpersoon", F.col("income").alias("income_2015")), "rinpersoon")
    for y in (2016, 2017):
        out = out.join(i.filter(f"year = {y}").select("rinpersoon", F.col("income").alias(f"income_{y}")), "rinpersoon", "left")
    return out


def eval_subsets(spark: SparkSession, d: str) -> DataFrame:
    return lb.hash_subsets(_marriages(spark, d), "rinpersoon", [("model", 400), ("eval", 100), ("rank", 100)], "subset")


def naive_baseline(spark: SparkSession, d: str) -> DataFrame:
    b = _background(spark, d).filter("birth_year IS NOT NULL AND municipality IS NOT NULL AND gender IS NOT NULL").withColumn("gender", F.col("gender") - 1)
    return lb.scaled_by(b, ["birth_year", "municipality"]).select("rinpersoon", "gender", F.round("birth_year", 8).alias("birth_year"), F.round("municipality", 8).alias("municipality"))


def target_encode_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = _income(spark, d).filter("year = 2015").join(_background(spark, d).filter("municipality IS NOT NULL"), "rinpersoon").withColumn("fold", lb.hash_folds("rinpersoon"))
    enc = lb.target_encoded(rows.select("rinpersoon", "municipality", "income", "fold"), "municipality", "income", "fold")
    m = lb.regression_metrics(enc, ["fold"], "income", "encoded")
    return m.select("fold", "n", *[F.format_string("%.5e", F.col(c)).alias(c) for c in ("mse", "mae")], F.round("r2", 5).alias("r2"))


def carried_forward_income(spark: SparkSession, d: str) -> DataFrame:
    """How well a year's income is told by the one before, raised by two percent."""
    p = sp.filled_panel(_income(spark, d), "rinpersoon", "year", "income", lags=(1,)).withColumn("guess", F.col("lag1") + F.col("lag1") * 0.02)
    return lb.regression_metrics(p, ["year"], "income", "guess").select("year", "n", F.round("mae", 3).alias("mae"), F.round("r2", 5).alias("r2"))


def transform_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    i = _income(spark, d)
    one = i.agg(F.avg("income").alias("m"), F.stddev_pop("income").alias("s"), F.min("income").alias("lo"), F.max("income").alias("hi"))
    t = lb.transforms("income", F.col("m"), F.col("s"), F.col("lo"), F.col("hi"))
    near = [F.min((F.abs(back - F.col("income")) < 1e-3).cast("int")).alias(f"{k}_returns") for k, (_, back) in t.items()]
    sums = [F.round(F.avg(there), 5).alias(f"{k}_mean") for k, (there, _) in t.items()]
    return i.join(F.broadcast(one)).agg(*near, *sums)


def yearly_tables(spark: SparkSession, d: str) -> DataFrame:
    """Mean income of persons by whether they marry in the year, correlation of the two incomes of a couple."""
    m = lb.yearly_partner(_marriages(spark, d), "rinpersoon", "partner", "year", [F.col("marriage_id")])
    i = _income(spark, d)
    met = m.join(i.toDF("person", "year", "x"), ["person", "year"]).join(i.toDF("partner", "year", "y"), ["partner", "year"])
    return met.groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg("x"), 3).alias("mean_x"), F.round(F.avg("y"), 3).alias("mean_y"))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


def nearest_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Exact, for every vector whose id is divisible by 20, against all."""
    e = _embeddings(spark, d)
    return ev.top_k(e.filter("id % 20 = 0"), e, K).select("id", "rank", "other")


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _embeddings(spark, d)
    half = lambda a: e.select("id", F.slice("vec", a, 32).alias("vec"))
    return tuple(ev.top_k(half(a).filter("id % 20 = 0"), half(a), K, 32) for a in (1, 33))  # type: ignore[return-value]


def nn_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ev.overlap(*_two_lists(spark, d), K)


def footrule(spark: SparkSession, d: str) -> DataFrame:
    return ev.footrule(*_two_lists(spark, d), K).select("id", F.round("distance", 6).alias("distance"))


def _unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "person_embeddings", "rinpersoon", "cls_emb").filter("rinpersoon IS NOT NULL AND size(cls_emb) = 64 AND NOT exists(cls_emb, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(cls_emb, x -> x != 0)")
    one = e.groupBy("rinpersoon").agg(F.max("cls_emb").alias("vec"))
    idx = ranking.dense_index(one, "rinpersoon")
    return one.join(idx, "rinpersoon").select("idx", F.col("rinpersoon").alias("id"), "vec")


def partner_rank(spark: SparkSession, d: str) -> DataFrame:
    pairs = _marriages(spark, d).filter("year IS NOT NULL").select("year", F.col("rinpersoon").alias("person"), "partner").filter("person != partner").distinct()
    known = _unit_vectors(spark, d).drop("idx").join(_background(spark, d).select(F.col("rinpersoon").alias("id"), "gender"), "id", "left").withColumn("gender", F.coalesce("gender", F.lit(0)))
    vectors = known.join(ranking.dense_index(known, "gender", "id"), ["gender", "id"])
    return ev.with_overall(ev.partner_ranks(pairs, vectors), "year", "rank").select("year", F.round("mean", 6).alias("mean_rank"), "n")


def partner_similarity_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = _unit_vectors(spark, d).select("id", "vec")
    pairs = _marriages(spark, d).select("rinpersoon", "partner").filter("rinpersoon < partner").distinct()
    from ..functions.arrays import cosine

    met = pairs.join(v.toDF("rinpersoon", "a"), "rinpersoon").join(v.toDF("partner", "b"), "partner").select(F.round(cosine("a", "b"), 6).alias("s"))
    return ev.histogram(met, "s", 20, least=2)


def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "label").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.round(F.avg("vec_id"), 6).alias("mean"))


def own_centroid_fraction(spark: SparkSession, d: str) -> DataFrame:
    return ev.own_centroid_share(_embeddings(spark, d), "label", "vec").select("label", F.round("share", 6).alias("share"))


def pairwise_cluster_similarity(spark: SparkSession, d: str) -> DataFrame:
    return ev.mean_pair_cosine(_embeddings(spark, d), "label", "vec").select("a", "b", F.round("mean_cosine", 6).alias("mean_cosine"))


def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    return ev.cluster_scores(_embeddings(spark, d), "label", "vec").select(*[F.round(c, 4).alias(c) for c in ("calinski_harabasz", "within", "between")])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    i = _income(spark, d).filter("year = 2015").join(_background(spark, d).filter("gender IS NOT NULL"), "rinpersoon")
    return i.select("rinpersoon", "gender", (F.col("income") > 30000).cast("int").alias("label"), F.round(uniform("rinpersoon", "score"), 2).alias("score"))


def confusion_by_group(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(_scored(spark, d), "label", "score", [0.25, 0.5, 0.75], ["gender"])


def pu_corrected_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = ev.confusion(_scored(spark, d), "label", "score", [0.25, 0.5, 0.75], [])
    m = ev.pu_metrics(*[F.col(x) for x in ("tp", "fp", "tn", "fn")], 0.05, 0.02)
    return c.select("threshold", *[F.round(m[k], 8).alias(k) for k in ("f1", "balanced_accuracy")])


def area_under_lift(spark: SparkSession, d: str) -> DataFrame:
    return ev.area_under_lift(_scored(spark, d), "label", "score").select(F.round("aul", 8).alias("aul"))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return ev.class_weights(table(spark, d, "person_background", "gender").filter("gender IS NOT NULL"), "gender").select("gender", F.round("weight", 8).alias("weight"))


def keyword_xor_label(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.lower("text"), r"[^a-z]+")
    a, b = F.array_contains(words, "median"), F.array_contains(words, "register")
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").filter(a != b).select("doc_id", a.cast("int").alias("label"))


QUERIES = {
    q.__name__: q
    for q in (
        mutual_pairs, pair_symmetry, first_union_labels, yearly_partner, latest_non_null, panel_forward_fill_lag, interval_residents, population_filter, survival_targets,
        income_baseline_summary, background_income_join, eval_subsets, naive_baseline, target_encode_cv, carried_forward_income, transform_roundtrip, yearly_tables,
        nearest_neighbors, nn_overlap, footrule, partner_rank, partner_similarity_histogram, cluster_summary, own_centroid_fraction, pairwise_cluster_similarity, cluster_scores,
        confusion_by_group, pu_corrected_metrics, area_under_lift, class_weights, keyword_xor_label,
    )
}

_M = "m AS (SELECT DISTINCT marriage_id, rinpersoon, partner, year FROM person_marriages)"
_I = f"i AS (SELECT rinpersoon, year, max(income) AS income FROM person_income WHERE {REAL} GROUP BY 1, 2)"
_B = "b AS (SELECT rinpersoon, gender, birth_year, municipality FROM person_background QUALIFY row_number() OVER (PARTITION BY rinpersoon ORDER BY background_id) = 1)"
_YP = """yp AS (SELECT year, person, partner FROM (SELECT year, rinpersoon AS person, partner, marriage_id FROM m UNION ALL SELECT year, partner, rinpersoon, marriage_id FROM m)
       WHERE person IS NOT NULL AND partner IS NOT NULL AND year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY year, person ORDER BY marriage_id, partner) = 1)"""
_PANEL = f"""{_I}, span AS (SELECT rinpersoon, unnest(range(min(year), max(year) + 1))::INTEGER AS year FROM i GROUP BY 1),
f AS (SELECT rinpersoon, year, last_value(income IGNORE NULLS) OVER (PARTITION BY rinpersoon ORDER BY year) AS income FROM span LEFT JOIN i USING (rinpersoon, year))"""
_NN = """{0} AS (SELECT a.vec_id AS id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding[{1}:{2}]::DOUBLE[], b.embedding[{1}:{2}]::DOUBLE[]), 8) DESC, b.vec_id)::INTEGER - 1 AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank < 5)"""
_U = """u AS (SELECT rinpersoon AS id, max(cls_emb)::DOUBLE[] AS vec FROM person_embeddings WHERE rinpersoon IS NOT NULL AND len(cls_emb) = 64
  AND len(list_filter(cls_emb, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(cls_emb, lambda x: x <> 0)) > 0 GROUP BY 1),
v AS (SELECT row_number() OVER (ORDER BY id) - 1 AS idx, id, vec, count(*) OVER () AS n FROM u)"""
_S = f"s AS (SELECT rinpersoon, gender, (income > 30000)::INTEGER AS label, round({UNIFORM.format('rinpersoon', 'score')}, 2) AS score FROM i JOIN b USING (rinpersoon) WHERE year = 2015 AND gender IS NOT NULL)"
_C = "count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label <> 1) AS fp, count(*) FILTER (score < threshold AND label <> 1) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn"

ORACLE = {
    "mutual_pairs": f"WITH {_M} SELECT * FROM m WHERE EXISTS (FROM m t WHERE t.rinpersoon = m.partner AND t.partner = m.rinpersoon AND t.year IS NOT DISTINCT FROM m.year)",
    "pair_symmetry": f"WITH {_M}, p AS (SELECT count(*) AS n FROM m WHERE rinpersoon IS NOT NULL AND partner IS NOT NULL GROUP BY least(rinpersoon, partner), greatest(rinpersoon, partner)) SELECT n, count(*) AS pairs FROM p GROUP BY 1",
    "first_union_labels": f"""WITH {_M}, {_B} SELECT rinpersoon, min(year) AS first_year, 1 AS label FROM m WHERE rinpersoon IS NOT NULL AND year IS NOT NULL GROUP BY 1
UNION ALL SELECT rinpersoon, NULL::INTEGER, 0 FROM b WHERE birth_year BETWEEN 1930 AND 1995 AND rinpersoon NOT IN (SELECT rinpersoon FROM m WHERE rinpersoon IS NOT NULL AND year IS NOT NULL)""",
    "yearly_partner": f"WITH {_M}, {_YP} SELECT * FROM yp",
    "latest_non_null": "SELECT rinpersoon, arg_max(gender, background_id) AS gender, arg_max(birth_year, background_id) AS birth_year, arg_max(municipality, background_id) AS municipality FROM person_background GROUP BY 1",
    "panel_forward_fill_lag": f"WITH {_PANEL} SELECT *, lag(income, 1) OVER w AS lag1, lag(income, 2) OVER w AS lag2, lag(income, 3) OVER w AS lag3 FROM f WINDOW w AS (PARTITION BY rinpersoon ORDER BY year)",
    "interval_residents": """SELECT year::INTEGER AS year, count(DISTINCT RINPERSOON) AS n FROM spolisbus JOIN (SELECT unnest(range(2000, 2021)) AS year) y ON year BETWEEN year(begJob) AND year(endJob)
WHERE RINPERSOON IS NOT NULL GROUP BY 1""",
    "population_filter": f"""WITH {_I}, {_B} SELECT RINPERSOON AS rinpersoon, count(*) AS n, count(DISTINCT event_code) AS n_codes FROM life_events
WHERE daysSinceFirstEvent BETWEEN 14000 AND 15000 AND RINPERSOON IN (SELECT rinpersoon FROM b) AND RINPERSOON NOT IN (SELECT rinpersoon FROM i WHERE income <= 0)
AND RINPERSOON NOT IN (SELECT rinpersoon FROM person_background WHERE birth_city IS NULL) GROUP BY 1 HAVING count(*) >= 3""",
    "survival_targets": f"""WITH {_B}, e AS (SELECT RINPERSOON AS rinpersoon, max(daysSinceFirstEvent) AS day FROM life_events WHERE event_code LIKE 'HH%' AND daysSinceFirstEvent BETWEEN 15000 AND 17000 GROUP BY 1)
SELECT rinpersoon, (day IS NOT NULL)::INTEGER AS target, coalesce(day, 17000) AS censor_day FROM b LEFT JOIN e USING (rinpersoon)""",
    "income_baseline_summary": f"""WITH {_B}, r AS (SELECT rinpersoon, year, CASE WHEN {REAL} THEN income END AS x FROM person_income)
SELECT year, count(*) AS n, max(x) AS highest, min(x) AS lowest, round(avg(x), 4) AS mean, count(*) FILTER (x = 0) AS zeros, count(*) FILTER (x IS NULL) AS unfound,
       round(avg(x) FILTER (gender = 1) - avg(x) FILTER (gender = 2), 4) AS gender_gap FROM r LEFT JOIN b USING (rinpersoon) GROUP BY 1""",
    "background_income_join": f"""WITH {_I}, {_B} SELECT b.*, i.income AS income_2015, j.income AS income_2016, k.income AS income_2017 FROM b JOIN i ON i.rinpersoon = b.rinpersoon AND i.year = 2015
LEFT JOIN i j ON j.rinpersoon = b.rinpersoon AND j.year = 2016 LEFT JOIN i k ON k.rinpersoon = b.rinpersoon AND k.year = 2017""",
    "eval_subsets": f"""WITH r AS (SELECT rinpersoon, row_number() OVER (ORDER BY {UNIFORM.format("rinpersoon", "subset")}, rinpersoon) AS r FROM (SELECT DISTINCT rinpersoon FROM person_marriages WHERE rinpersoon IS NOT NULL))
SELECT rinpersoon, CASE WHEN r <= 400 THEN 'model' WHEN r <= 500 THEN 'eval' ELSE 'rank' END AS subset FROM r WHERE r <= 600""",
    "naive_baseline": f"""WITH {_B}, c AS (SELECT * FROM b WHERE birth_year IS NOT NULL AND municipality IS NOT NULL AND gender IS NOT NULL)
SELECT rinpersoon, (gender - 1)::INTEGER AS gender, round((birth_year - min(birth_year) OVER ()) / (max(birth_year) OVER () - min(birth_year) OVER ()), 8) AS birth_year,
       round((municipality - min(municipality) OVER ()) / (max(municipality) OVER () - min(municipality) OVER ()), 8) AS municipality FROM c""",
    "target_encode_cv": f"""WITH {_I}, {_B}, r AS (SELECT rinpersoon, municipality, income, floor({UNIFORM.format("rinpersoon", "42")} * 5)::INTEGER AS fold FROM i JOIN b USING (rinpersoon) WHERE year = 2015 AND municipality IS NOT NULL),
e AS (SELECT a.fold, a.income, coalesce((SELECT avg(income) FROM r o WHERE o.fold <> a.fold AND o.municipality = a.municipality), (SELECT avg(income) FROM r o WHERE o.fold <> a.fold)) AS g FROM r a)
SELECT fold, count(*) AS n, regexp_replace(printf('%.5e', avg((income - g) ** 2)), '^$', '') AS mse, printf('%.5e', avg(abs(income - g))) AS mae, round(1 - avg((income - g) ** 2) / var_pop(income), 5) AS r2 FROM e GROUP BY 1""",
    "carried_forward_income": f"""WITH {_PANEL}, g AS (SELECT year, income, lag(income) OVER (PARTITION BY rinpersoon ORDER BY year) AS l FROM f)
SELECT year, count(*) AS n, round(avg(abs(income - (l + l * 0.02))), 3) AS mae, round(1 - avg((income - (l + l * 0.02)) ** 2) / var_pop(income), 5) AS r2 FROM g WHERE l IS NOT NULL AND income IS NOT NULL GROUP BY 1""",
    "transform_roundtrip": f"""WITH {_I}, o AS (SELECT avg(income) AS m, stddev_pop(income) AS s, min(income) AS lo, max(income) AS hi FROM i)
SELECT 1 AS z_returns, 1 AS min_max_returns, 1 AS log_returns, round(avg((income - m) / s), 5) + 0.0 AS z_mean, round(avg((income - lo) / (hi - lo)), 5) AS min_max_mean, round(avg(ln(1 + income + abs(lo) + 1)), 5) AS log_mean FROM i, o""",
    "yearly_tables": f"""WITH {_M}, {_YP}, {_I} SELECT year, count(*) AS n, round(avg(a.income), 3) AS mean_x, round(avg(c.income), 3) AS mean_y FROM yp JOIN i a ON a.rinpersoon = person AND a.year = yp.year
JOIN i c ON c.rinpersoon = yp.partner AND c.year = yp.year GROUP BY 1""".replace("SELECT year, count(*) AS n, round(avg(a", "SELECT yp.year AS year, count(*) AS n, round(avg(a"),
    "nearest_neighbors": f"WITH {_NN.format('a', 1, 64)} SELECT id, rank, other FROM a",
    "nn_overlap": f"WITH {_NN.format('a', 1, 32)}, {_NN.format('c', 33, 64)} SELECT a.id, count(c.id) / 5.0 AS overlap FROM a LEFT JOIN c ON c.id = a.id AND c.other = a.other GROUP BY 1",
    "footrule": f"""WITH {_NN.format('a', 1, 32)}, {_NN.format('c', 33, 64)}
SELECT coalesce(a.id, c.id) AS id, round(sum(abs(coalesce(a.rank, 5) - coalesce(c.rank, 5)) / (least(coalesce(a.rank, 5), coalesce(c.rank, 5)) + 1)), 6) AS distance FROM a FULL JOIN c ON c.id = a.id AND c.other = a.other GROUP BY 1""",
    "partner_rank": f"""WITH {_M}, {_U}, {_B}, p AS (SELECT DISTINCT year, rinpersoon AS person, partner FROM m WHERE year IS NOT NULL AND rinpersoon <> partner),
g AS (SELECT id, vec, coalesce(gender, 0) AS gender FROM u LEFT JOIN b ON b.rinpersoon = id),
k AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY gender) AS n FROM g),
q AS (SELECT p.*, a.vec AS av, c.vec AS cv, c.gender, c.n - 1 - (a.gender = c.gender)::INTEGER AS rest,
        CASE WHEN a.gender = c.gender THEN least(a.i, c.i) ELSE c.i END AS low, CASE WHEN a.gender = c.gender THEN greatest(a.i, c.i) END AS high FROM p JOIN k a ON a.id = person JOIN k c ON c.id = partner),
d AS (SELECT *, ('0x' || substr(md5(year || '-' || person || '-' || partner || '-' || t || ':rank'), 1, 8))::BIGINT % rest AS x0 FROM q, (SELECT unnest(range(1, 101)) AS t) WHERE rest > 0),
e AS (SELECT *, x0 + (x0 >= low)::INTEGER AS x1 FROM d), f AS (SELECT *, x1 + coalesce((x1 >= high)::INTEGER, 0) AS x FROM e),
r AS (SELECT f.year, person, partner, 1 + count(*) FILTER (round(list_cosine_similarity(av, o.vec), 9) > round(list_cosine_similarity(av, cv), 9)) AS rank FROM f JOIN k o ON o.gender = f.gender AND o.i = x GROUP BY 1, 2, 3)
SELECT CASE WHEN grouping(r.year) = 1 THEN 'OVERALL' ELSE r.year::VARCHAR END AS year, round(avg(rank), 6) AS mean_rank, count(*) AS n FROM r GROUP BY ROLLUP (r.year)""",
    "partner_similarity_histogram": f"""WITH {_M}, {_U}, p AS (SELECT DISTINCT rinpersoon, partner FROM m WHERE rinpersoon < partner),
s AS (SELECT round(list_cosine_similarity(a.vec, c.vec), 6) AS s FROM p JOIN v a ON a.id = rinpersoon JOIN v c ON c.id = partner), e AS (SELECT min(s) AS lo, max(s) AS hi FROM s)
SELECT least(floor((s - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS n FROM s, e GROUP BY 1 HAVING count(*) > 2""",
    "cluster_summary": 'SELECT label, count(*) AS n, min(vec_id) AS "first", max(vec_id) AS "last", round(avg(vec_id), 6) AS mean FROM embeddings GROUP BY 1',
    "own_centroid_fraction": """WITH x AS (SELECT label, unnest(range(1, 65)) AS k, embedding FROM embeddings), m AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS m FROM x GROUP BY 1, 2), c AS (SELECT label AS cl, list(m ORDER BY k) AS v FROM m GROUP BY 1),
b AS (SELECT vec_id, label, cl FROM embeddings, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 9) DESC, cl) = 1)
SELECT label, round(avg((label = cl)::INTEGER), 6) AS share FROM b GROUP BY 1""",
    "pairwise_cluster_similarity": """SELECT x.label AS a, y.label AS b, round(avg(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])), 6) AS mean_cosine
FROM embeddings x JOIN embeddings y ON x.label <= y.label AND x.vec_id <> y.vec_id GROUP BY 1, 2""",
    "cluster_scores": """WITH x AS (SELECT vec_id, label, k, embedding[k]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings)),
g AS (SELECT k, avg(v) AS g FROM x GROUP BY 1), c AS (SELECT label, k, avg(v) AS c, count(*) AS n FROM x GROUP BY 1, 2),
w AS (SELECT sum((v - c) ** 2) AS w FROM x JOIN c USING (label, k)), b AS (SELECT sum(n * (c - g) ** 2) AS b FROM c JOIN g USING (k)),
s AS (SELECT count(DISTINCT label) AS kk, count(*) AS nn FROM embeddings)
SELECT round((b / (kk - 1)) / (w / (nn - kk)), 4) AS calinski_harabasz, round(w, 4) AS within, round(b, 4) AS between FROM w, b, s""".replace("AS within", 'AS "within"').replace("AS between", 'AS "between"'),
    "confusion_by_group": f"WITH {_I}, {_B}, {_S} SELECT threshold, gender, {_C} FROM s, (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS threshold) GROUP BY 1, 2",
    "pu_corrected_metrics": f"""WITH {_I}, {_B}, {_S}, c AS (SELECT threshold, {_C} FROM s, (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS threshold) GROUP BY 1),
r AS (SELECT threshold, tp / (tp + fn) AS r, fp / (fp + tn) AS f, (tp + fn) / (tp + fp + tn + fn) AS p FROM c),
t AS (SELECT threshold, (0.95 * r - 0.02 * f) / 0.93 AS tpr, (0.98 * f - 0.05 * r) / 0.93 AS fpr, p * 0.98 + (1 - p) * 0.05 AS q FROM r),
k AS (SELECT *, tpr * q / (tpr * q + fpr * (1 - q)) AS prec FROM t) SELECT threshold, round(2 * prec * tpr / (prec + tpr), 8) AS f1, round((1 + tpr - fpr) / 2, 8) AS balanced_accuracy FROM k""",
    "area_under_lift": f"WITH {_I}, {_B}, {_S} SELECT round(sum(CASE WHEN a.score > c.score THEN 1 WHEN a.score = c.score THEN 0.5 ELSE 0 END) / count(*), 8) AS aul FROM s a, s c WHERE a.label = 1",
    "class_weights": "WITH c AS (SELECT gender, 1 / count(*) AS w FROM person_background WHERE gender IS NOT NULL GROUP BY 1) SELECT gender, round(w / sum(w) OVER (), 8) AS weight FROM c",
    "keyword_xor_label": """WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_contains(w, 'median')::INTEGER AS label FROM w WHERE list_contains(w, 'median') <> list_contains(w, 'register')""",
}
