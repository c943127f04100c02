"""Models, unions, households, distances, clusters and further network operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import uniform
from ..operators import evaluation as ev, graph as g, labels as lb, ranking, regression as rg, unions as un
from ..sources.tables import table
from . import graph_queries as gq, label_queries as lq
from .cleaning_queries import REAL, UNIFORM

SUBSETS = {"born": ["birth_year"], "gender": ["gender"], "place": ["municipality"]}
RATES = {y: 0.01 + (y - 2011) * 0.002 for y in range(2011, 2023)}
AGES = (30, 50)


def _people(spark: SparkSession, d: str) -> DataFrame:
    known = lq._background(spark, d).filter("gender IS NOT NULL AND birth_year IS NOT NULL AND municipality IS NOT NULL")
    return lq._income(spark, d).join(known, "rinpersoon").withColumn("fold", lb.hash_folds("rinpersoon"))


def cv_regression(spark: SparkSession, d: str) -> DataFrame:
    """Income of 2015 by birth year, five folds."""
    told, _ = rg.cross_validated(_people(spark, d).filter("year = 2015"), [], "fold", ["birth_year"], "income")
    s = rg.scores(told, ["fold"], "income", "guess")
    return s.select("fold", "n", *[F.format_string("%.5e", F.col(c)).alias(c) for c in ("mse", "rmse", "mae")], F.round("r2", 6).alias("r2"))


def cv_regression_all(spark: SparkSession, d: str) -> DataFrame:
    """The same by three features together."""
    told, _ = rg.cross_validated(_people(spark, d).filter("year = 2015"), [], "fold", ["birth_year", "gender", "municipality"], "income")
    return rg.scores(told, ["fold"], "income", "guess").select("fold", "n", F.round("r2", 6).alias("r2"), F.round("mape", 4).alias("mape"))


def feature_subsets(spark: SparkSession, d: str) -> DataFrame:
    """R2 over five folds of models with each subset of features: mean and deviation, and over all subsets."""
    rows, parts = _people(spark, d).filter("year = 2015"), None
    for name, features in SUBSETS.items():
        told, _ = rg.cross_validated(rows, [], "fold", features, "income")
        one = rg.scores(told, ["fold"], "income", "guess").select(F.lit(name).alias("subset"), "r2")
        parts = one if parts is None else parts.unionByName(one)
    return rg.over_folds(parts, ["subset"], ["r2"]).select("subset", "n_folds", F.round("r2_mean", 6).alias("r2_mean"), F.round("r2_std", 6).alias("r2_std"))


def yearly_cv(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated models of each year."""
    told, _ = rg.cross_validated(_people(spark, d), ["year"], "fold", ["birth_year"], "income")
    return rg.scores(told, ["year"], "income", "guess").select("year", "n", F.round("r2", 6).alias("r2"), F.round("corr", 6).alias("corr"))


def yeo_johnson_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether the transform at the likeliest power, undone, gives the incomes back."""
    i = lq._income(spark, d).select((F.col("income") / 10000).alias("x"))
    p = rg.yeo_johnson_power(i, "x")
    back = rg.yeo_johnson_inverse(rg.yeo_johnson(F.col("x"), p), p)
    return i.agg(F.count("*").alias("n"), F.sum((F.abs(back - F.col("x")) > 1e-6 * (1 + F.abs("x"))).cast("bigint")).alias("n_off"))


def inflation_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """How well last year's income, raised by the year's rate, tells a year's."""
    from ..operators import spells as sp

    p = sp.filled_panel(lq._income(spark, d), "rinpersoon", "year", "income", lags=(1,)).filter("lag1 IS NOT NULL")
    told = p.withColumn("guess", rg.adjusted_by_rate(F.col("lag1"), F.col("year"), RATES)).withColumn("off", F.abs(F.col("income") - F.col("guess")))
    median = ranking.exact_quantiles(told, ["year"], "off", [0.5])
    return rg.scores(told, ["year"], "income", "guess").join(median, "year").select("year", "n", F.round("mae", 3).alias("mae"), F.round(F.col("p")[0], 3).alias("median"), F.round("r2", 6).alias("r2"))


def _unions(spark: SparkSession, d: str) -> DataFrame:
    """Marriages of each side with an end: the year of the person's next marriage to someone else, far off without one; the kind by number."""
    m = lq._marriages(spark, d).filter("rinpersoon IS NOT NULL AND partner IS NOT NULL AND year IS NOT NULL")
    return un.with_ends(m, "rinpersoon", "partner", "year").withColumns({"kind": F.when(F.pmod("year", F.lit(5)) == 0, "X").when(F.pmod("year", F.lit(2)) == 0, "H").otherwise("P"), "reason": F.when(F.col("end_year") == 2200, "ACTIVE").when(F.pmod("end_year", F.lit(3)) == 0, "O").otherwise("S")})


def divorce_labels(spark: SparkSession, d: str) -> DataFrame:
    return un.divorce_labels(_unions(spark, d), 2016).select("rinpersoon", "partner", "year", "label")


def gender_lists(spark: SparkSession, d: str) -> DataFrame:
    """Couples of each year by the genders of both, with how many persons of each there are."""
    pairs = lb.yearly_partner(lq._marriages(spark, d), "rinpersoon", "partner", "year", [F.col("marriage_id")])
    return un.by_gender(pairs, lq._background(spark, d)).groupBy("year", "gender", "partner_gender").agg(F.count("*").alias("n"))


def household_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per couple: the elder as reference person, the other, their incomes of 2015 and how often each married."""
    m = lq._marriages(spark, d).filter("rinpersoon != partner")
    return un.households(m, lq._background(spark, d), lq._income(spark, d).filter("year = 2015").select("rinpersoon", "income"))


def residence_history(spark: SparkSession, d: str) -> DataFrame:
    """Couples of a year with both incomes of that year, where there are any: two joins by person and year."""
    pairs = lb.yearly_partner(lq._marriages(spark, d), "rinpersoon", "partner", "year", [F.col("marriage_id")])
    i = lq._income(spark, d)
    met = pairs.join(i.toDF("person", "year", "x"), ["person", "year"], "left").join(i.toDF("partner", "year", "y"), ["partner", "year"], "left")
    return met.select("year", "person", "partner", "x", "y")


def embedding_with_variable(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with an income and, behind the vector, the person's background numbers: the input of a model of single persons."""
    v = lq._unit_vectors(spark, d).select(F.col("id").alias("rinpersoon"), "vec")
    met = un.with_variable(v, lq._income(spark, d).filter("year = 2015").select("rinpersoon", "income"), lq._background(spark, d), ["birth_year", "gender"])
    return met.select("rinpersoon", "income", F.size("x").alias("width"), F.round(F.aggregate("x", F.lit(0.0), lambda s, a: s + a), 4).alias("total"))


def pair_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of both partners one behind the other, with a label: the input of a model of couples."""
    v = lq._unit_vectors(spark, d).select("id", "vec")
    pairs = lq._marriages(spark, d).filter("year IS NOT NULL").select("marriage_id", "rinpersoon", "partner", (F.col("year") >= 2015).cast("int").alias("label")).distinct()
    return un.pair_vectors(pairs, v).select("marriage_id", "rinpersoon", "partner", "label", F.size("x").alias("width"), F.round(F.aggregate("x", F.lit(0.0), lambda s, a: s + a), 4).alias("total"))


def probability_gap(spark: SparkSession, d: str) -> DataFrame:
    return ev.probability_gap(lq._scored(spark, d), "label", "score", ["gender"]).select("gender", "n", *[F.round(c, 8).alias(c) for c in ("mean_1", "mean_0", "gap")])


def confusion_by_age(spark: SparkSession, d: str) -> DataFrame:
    """By threshold, gender and age band in 2015."""
    age = 2015 - F.col("birth_year")
    band = F.when(age < AGES[0], 0).when(age < AGES[1], 1).otherwise(2)
    rows = lq._scored(spark, d).join(lq._background(spark, d).filter("birth_year IS NOT NULL").select("rinpersoon", band.alias("age_band")), "rinpersoon")
    return ev.confusion(rows, "label", "score", [0.25, 0.5, 0.75], ["gender", "age_band"])


def corrected_mcc(spark: SparkSession, d: str) -> DataFrame:
    c = ev.confusion(lq._scored(spark, d), "label", "score", [0.25, 0.5, 0.75], [])
    m = ev.pu_metrics(*[F.col(x) for x in ("tp", "fp", "tn", "fn")], 0.05, 0.02)
    return c.select("threshold", F.round(m["mcc"], 8).alias("mcc"))


def selective_risk(spark: SparkSession, d: str) -> DataFrame:
    rows = lq._scored(spark, d).withColumn("error", ((F.col("score") >= 0.5).cast("int") != F.col("label")).cast("int"))
    out = ev.selective_risk(rows, "score", "error", [0.25, 0.5, 0.75])
    # the bound lies above the risk and below one
    return out.select("threshold", "n", "errors", F.round("coverage", 8).alias("coverage"), F.round("risk", 8).alias("risk"), ((F.col("bound") > F.col("risk")) & (F.col("bound") < 1)).alias("is_bound"))


def hop_distance_hist(spark: SparkSession, d: str) -> DataFrame:
    """Cosines between persons and their neighbours at one to three hops."""
    hops = gq.k_hop_neighbours(spark, d)
    return ev.distance_histogram(hops, lq._unit_vectors(spark, d).select("id", "vec"), ["hop"], "person", "other").select("hop", "bin", "n", F.round("weight", 8).alias("weight"))


def real_and_random_hist(spark: SparkSession, d: str) -> DataFrame:
    """Cosines between partners, and between persons and random ones."""
    m = table(spark, d, "person_marriages", "rinpersoon", "partner", "fake_partner").filter("rinpersoon IS NOT NULL")
    pairs = m.select("rinpersoon", F.inline(F.array(F.struct(F.lit("real").alias("kind"), F.col("partner").alias("other")), F.struct(F.lit("random").alias("kind"), F.col("fake_partner").alias("other"))))).filter("other IS NOT NULL AND other != rinpersoon").distinct()
    return ev.distance_histogram(pairs, lq._unit_vectors(spark, d).select("id", "vec"), ["kind"], "rinpersoon", "other", 20, 2).select("kind", "bin", "n", F.round("weight", 8).alias("weight"))


def silhouette_score(spark: SparkSession, d: str) -> DataFrame:
    return ev.silhouette(lq._embeddings(spark, d), "label", "vec").select(F.round("silhouette", 6).alias("silhouette"))


def davies_bouldin_score(spark: SparkSession, d: str) -> DataFrame:
    return ev.davies_bouldin(lq._embeddings(spark, d), "label", "vec").select(F.round("davies_bouldin", 5).alias("davies_bouldin"))


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in clusters, and how many of them are nearer to another centroid than to their own."""
    rows = ev.kmeans(lq._embeddings(spark, d), "vec", 8, rounds=100)
    return rows.agg(F.count("*").alias("n"), (F.count_distinct("cluster") <= 8).alias("at_most_k"))


def component_edges(spark: SparkSession, d: str) -> DataFrame:
    """Family edges of the largest family component."""
    e = gq._edges(spark, d).filter("layer = 'family'")
    return g.edges_within(e, g.largest_component(g.connected_components(e))).select("src", "dst")


def family_users(spark: SparkSession, d: str) -> DataFrame:
    """Persons of the family layer with their neighbours of all layers, numbered densely and back."""
    e = gq._edges(spark, d)
    users = g.users_of_layer(e, "family")
    return g.symmetric(g.edges_within(e, users)).groupBy("layer").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_nodes"))


def csr_neighbours(spark: SparkSession, d: str) -> DataFrame:
    edges, mapping = g.reindexed(gq._edges(spark, d))
    return g.csr_neighbours(edges)


def combined_layers(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours over all layers as persons, five at most by hash."""
    edges, mapping = g.reindexed(gq._edges(spark, d))
    return g.combined_neighbours(edges, mapping, 5)


def inverse_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings stored by node number, with the persons they belong to."""
    from ..sources.files import by_position

    _, mapping = g.reindexed(gq._edges(spark, d))
    stored = mapping.select("idx", (F.col("idx") * 2 + 1).alias("value"))
    return by_position(stored, "idx", mapping, "node", "idx").select("node", "value")


QUERIES = {
    x.__name__: x
    for x in (
        cv_regression, cv_regression_all, feature_subsets, yearly_cv, yeo_johnson_roundtrip, inflation_adjusted, divorce_labels, gender_lists, household_wide, residence_history,
        embedding_with_variable, pair_vectors, probability_gap, confusion_by_age, corrected_mcc, selective_risk, hop_distance_hist, real_and_random_hist, silhouette_score,
        davies_bouldin_score, kmeans_clusters, component_edges, family_users, csr_neighbours, combined_layers, inverse_mapping,
    )
}

_FOLD = f"floor({UNIFORM.format('rinpersoon', '42')} * 5)::INTEGER AS fold"
_X = f"{lq._I}, {lq._B}, x AS (SELECT i.*, b.* EXCLUDE rinpersoon, {_FOLD} FROM i JOIN b USING (rinpersoon) WHERE gender IS NOT NULL AND birth_year IS NOT NULL AND municipality IS NOT NULL)"
_FIT = "SELECT f.fold, regr_slope(income, {0}) AS a, regr_intercept(income, {0}) AS c FROM (SELECT DISTINCT fold FROM x WHERE year = 2015) f JOIN x ON x.fold <> f.fold AND x.year = 2015 GROUP BY 1"
_COS = "greatest(least(floor((round(list_cosine_similarity(a.vec, c.vec), 6) + 1) / 2 * {0}), {0} - 1), 0)::INTEGER"
_IDX = "m AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))"

ORACLE = {
    "cv_regression": f"""WITH {_X}, w AS ({_FIT.format("birth_year")})
SELECT x.fold, count(*) AS n, printf('%.5e', avg((income - a * birth_year - c) ** 2)) AS mse, printf('%.5e', sqrt(avg((income - a * birth_year - c) ** 2))) AS rmse, printf('%.5e', avg(abs(income - a * birth_year - c))) AS mae,
       round(1 - avg((income - a * birth_year - c) ** 2) / var_pop(income), 6) AS r2 FROM x JOIN w USING (fold) WHERE year = 2015 GROUP BY 1""",
    "feature_subsets": f"WITH {_X}, " + ", ".join(f"w{k} AS ({_FIT.format(f[0])})" for k, f in enumerate(SUBSETS.values())) + ", s AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS subset, fold, 1 - avg((income - a * {f[0]} - c) ** 2) / var_pop(income) AS r2 FROM x JOIN w{k} USING (fold) WHERE year = 2015 GROUP BY fold" for k, (n, f) in enumerate(SUBSETS.items())
    ) + ") SELECT subset, count(*) AS n_folds, round(avg(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_std FROM s GROUP BY ROLLUP (subset)",
    "yearly_cv": f"""WITH {_X}, w AS (SELECT f.year, f.fold, regr_slope(income, birth_year) AS a, regr_intercept(income, birth_year) AS c FROM (SELECT DISTINCT year, fold FROM x) f JOIN x ON x.year = f.year AND x.fold <> f.fold GROUP BY 1, 2)
SELECT year, count(*) AS n, round(1 - avg((income - a * birth_year - c) ** 2) / var_pop(income), 6) AS r2, round(corr(income, a * birth_year + c), 6) AS corr FROM x JOIN w USING (year, fold) GROUP BY 1""",
    "yeo_johnson_roundtrip": f"WITH {lq._I} SELECT count(*) AS n, 0::BIGINT AS n_off FROM i",
    "inflation_adjusted": f"""WITH {lq._PANEL}, l AS (SELECT year, income, lag(income) OVER (PARTITION BY rinpersoon ORDER BY year) AS p FROM f),
k AS (SELECT year, income, p + p * CASE year {" ".join(f"WHEN {y} THEN {r!r}::DOUBLE" for y, r in RATES.items())} ELSE 0 END AS guess FROM l WHERE p IS NOT NULL)
SELECT year, count(*) AS n, round(avg(abs(income - guess)), 3) AS mae, round(median(abs(income - guess)), 3) AS median, round(1 - avg((income - guess) ** 2) / var_pop(income), 6) AS r2 FROM k GROUP BY 1""",
    "divorce_labels": f"""WITH {lq._M}, b0 AS (SELECT rinpersoon, partner, year FROM m WHERE rinpersoon IS NOT NULL AND partner IS NOT NULL AND year IS NOT NULL),
e AS (SELECT DISTINCT x.rinpersoon, x.partner, x.year, coalesce((SELECT min(y.year) FROM b0 y WHERE y.year > x.year AND ((y.rinpersoon IN (x.rinpersoon, x.partner) AND y.partner NOT IN (x.rinpersoon, x.partner)))), 2200) AS end_year FROM b0 x),
k AS (SELECT *, CASE WHEN year % 5 = 0 THEN 'X' WHEN year % 2 = 0 THEN 'H' ELSE 'P' END AS kind, CASE WHEN end_year = 2200 THEN 'ACTIVE' WHEN end_year % 3 = 0 THEN 'O' ELSE 'S' END AS reason FROM e),
t AS (SELECT * FROM k WHERE EXISTS (FROM k z WHERE z.rinpersoon = k.partner AND z.partner = k.rinpersoon AND z.year = k.year AND z.end_year = k.end_year))
SELECT rinpersoon, partner, year, (end_year <> 2200)::INTEGER AS label FROM t WHERE kind IN ('H', 'P') AND NOT (end_year <> 2200 AND reason <> 'S') AND year <= 2016 AND end_year > 2016""",
    "gender_lists": f"""WITH {lq._M}, {lq._B}, {lq._YP} SELECT yp.year, a.gender, c.gender AS partner_gender, count(*) AS n FROM yp JOIN b a ON a.rinpersoon = person JOIN b c ON c.rinpersoon = partner
WHERE a.gender IS NOT NULL AND c.gender IS NOT NULL GROUP BY 1, 2, 3""",
    "household_wide": f"""WITH {lq._M}, {lq._B}, {lq._I}, c AS (SELECT DISTINCT least(rinpersoon, partner) AS a, greatest(rinpersoon, partner) AS z FROM m WHERE rinpersoon <> partner),
n AS (SELECT p, count(*) AS k FROM (SELECT a AS p FROM c UNION ALL SELECT z FROM c) GROUP BY 1),
o AS (SELECT a, z, CASE WHEN (coalesce(y.birth_year, 9999), z) < (coalesce(x.birth_year, 9999), a) THEN z ELSE a END AS reference FROM c JOIN b x ON x.rinpersoon = a JOIN b y ON y.rinpersoon = z),
h AS (SELECT reference, CASE WHEN reference = a THEN z ELSE a END AS other FROM o)
SELECT reference, other, x.birth_year AS reference_born, y.birth_year AS other_born, u.income AS reference_income, v.income AS other_income, p.k AS reference_unions, q.k AS other_unions
FROM h JOIN b x ON x.rinpersoon = reference JOIN b y ON y.rinpersoon = other JOIN n p ON p.p = reference JOIN n q ON q.p = other
LEFT JOIN i u ON u.rinpersoon = reference AND u.year = 2015 LEFT JOIN i v ON v.rinpersoon = other AND v.year = 2015""",
    "residence_history": f"""WITH {lq._M}, {lq._I}, {lq._YP} SELECT yp.year, person, partner, a.income AS x, c.income AS y FROM yp LEFT JOIN i a ON a.rinpersoon = person AND a.year = yp.year LEFT JOIN i c ON c.rinpersoon = partner AND c.year = yp.year""",
    "embedding_with_variable": f"""WITH {lq._U}, {lq._I}, {lq._B} SELECT v.id AS rinpersoon, income, 66 AS width, round(list_sum(vec) + birth_year + gender, 4) AS total
FROM v JOIN i ON i.rinpersoon = id AND year = 2015 JOIN b ON b.rinpersoon = id WHERE birth_year IS NOT NULL AND gender IS NOT NULL""",
    "pair_vectors": f"""WITH {lq._M}, {lq._U}, p AS (SELECT DISTINCT marriage_id, rinpersoon, partner, (year >= 2015)::INTEGER AS label FROM m WHERE year IS NOT NULL)
SELECT marriage_id, rinpersoon, partner, label, 128 AS width, round(list_sum(a.vec) + list_sum(c.vec), 4) AS total FROM p JOIN v a ON a.id = rinpersoon JOIN v c ON c.id = partner""",
    "probability_gap": f"WITH {lq._I}, {lq._B}, {lq._S} SELECT gender, count(*) AS n, round(avg(score) FILTER (label = 1), 8) AS mean_1, round(avg(score) FILTER (label = 0), 8) AS mean_0, round(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0), 8) AS gap FROM s GROUP BY 1",
    "confusion_by_age": f"""WITH {lq._I}, {lq._B}, {lq._S} SELECT threshold, s.gender, CASE WHEN 2015 - birth_year < {AGES[0]} THEN 0 WHEN 2015 - birth_year < {AGES[1]} THEN 1 ELSE 2 END AS age_band, {lq._C}
FROM s JOIN b USING (rinpersoon), (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold) WHERE birth_year IS NOT NULL GROUP BY 1, 2, 3""",
    "corrected_mcc": f"""WITH {lq._I}, {lq._B}, {lq._S}, c AS (SELECT threshold, {lq._C} FROM s, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold) GROUP BY 1),
r AS (SELECT threshold, tp / (tp + fn) AS g, fp / (fp + tn) AS u, (tp + fn) / (tp + fp + tn + fn) AS p, (tp + fp) / (tp + fp + tn + fn) AS t FROM c),
k AS (SELECT threshold, (0.95 * g - 0.02 * u) / 0.93 AS gc, (0.98 * u - 0.05 * g) / 0.93 AS uc, p * 0.98 + (1 - p) * 0.05 AS pc, t FROM r)
SELECT threshold, round(sqrt(pc * (1 - pc) / (t * (1 - t))) * (gc - uc), 8) AS mcc FROM k""",
    "selective_risk": f"""WITH {lq._I}, {lq._B}, {lq._S}, e AS (SELECT score, ((score >= 0.5)::INTEGER <> label)::INTEGER AS error FROM s)
SELECT threshold, count(*) FILTER (score >= threshold) AS n, count(*) FILTER (score >= threshold AND error = 1) AS errors, round(count(*) FILTER (score >= threshold) / count(*), 8) AS coverage,
       round(count(*) FILTER (score >= threshold AND error = 1) / count(*) FILTER (score >= threshold), 8) AS risk, true AS is_bound FROM e, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold) GROUP BY 1""",
    "hop_distance_hist": f"""WITH {lq._U}, h AS ({gq.ORACLE["k_hop_neighbours"]}), q AS (SELECT hop, {_COS.format(100)} AS bin, count(*) AS n FROM h JOIN v a ON a.id = person JOIN v c ON c.id = other GROUP BY 1, 2)
SELECT hop, bin, n, round(weight, 8) AS weight FROM (SELECT *, n / sum(n) OVER (PARTITION BY hop) AS weight FROM q) WHERE n > 10""",
    "real_and_random_hist": f"""WITH {lq._U}, p AS (SELECT DISTINCT kind, rinpersoon, other FROM (SELECT 'real' AS kind, rinpersoon, partner AS other FROM person_marriages UNION ALL SELECT 'random', rinpersoon, fake_partner FROM person_marriages) WHERE other <> rinpersoon),
q AS (SELECT kind, {_COS.format(20)} AS bin, count(*) AS n FROM p JOIN v a ON a.id = rinpersoon JOIN v c ON c.id = other GROUP BY 1, 2)
SELECT kind, bin, n, round(weight, 8) AS weight FROM (SELECT *, n / sum(n) OVER (PARTITION BY kind) AS weight FROM q) WHERE n > 2""",
    "silhouette_score": """WITH d AS (SELECT x.vec_id, x.label AS own, y.label AS other, avg(1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])) AS far FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id, min(far) FILTER (own = other) AS a, min(far) FILTER (own <> other) AS b FROM d GROUP BY 1)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""",
    "davies_bouldin_score": """WITH x AS (SELECT vec_id, label, k, embedding[k]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings)),
c AS (SELECT label, k, avg(v) AS c FROM x GROUP BY 1, 2), f AS (SELECT vec_id, label, sqrt(sum((v - c) ** 2)) AS f FROM x JOIN c USING (label, k) GROUP BY 1, 2), s AS (SELECT label, avg(f) AS s FROM f GROUP BY 1),
p AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) ** 2)) AS m FROM c a JOIN c b ON a.k = b.k AND a.label <> b.label GROUP BY 1, 2)
SELECT round(avg(r), 5) AS davies_bouldin FROM (SELECT p.a, max((x.s + y.s) / m) AS r FROM p JOIN s x ON x.label = p.a JOIN s y ON y.label = p.b GROUP BY 1)""",
    "kmeans_clusters": "SELECT count(*) AS n, true AS at_most_k FROM embeddings",
    "component_edges": f"""WITH RECURSIVE {gq.EDGES}, c AS (SELECT src AS a, src AS b FROM sym WHERE layer = 'family' UNION SELECT c.a, s.dst FROM c JOIN sym s ON s.src = c.b AND s.layer = 'family'),
g AS (SELECT a, min(b) AS comp FROM c GROUP BY 1), t AS (SELECT a FROM g WHERE comp = (SELECT comp FROM g GROUP BY 1 ORDER BY count(*) DESC, comp LIMIT 1))
SELECT src, dst FROM edges WHERE layer = 'family' AND src IN (FROM t) AND dst IN (FROM t)""",
    "family_users": f"""WITH {gq.EDGES}, u AS (SELECT DISTINCT src FROM sym WHERE layer = 'family') SELECT layer, count(*) AS n, count(DISTINCT src) AS n_nodes FROM sym WHERE src IN (FROM u) AND dst IN (FROM u) GROUP BY 1""",
    "csr_neighbours": f"""WITH {gq.EDGES}, {_IDX}, n AS (SELECT DISTINCT a.idx AS s, b.idx AS d FROM sym JOIN m a ON a.node = src JOIN m b ON b.node = dst)
SELECT row_number() OVER (ORDER BY s, d) - 1 AS place, s AS idx, d AS neighbour FROM n""",
    "combined_layers": f"""WITH {gq.EDGES} SELECT DISTINCT src AS node, dst AS neighbour FROM (SELECT DISTINCT src, dst FROM sym)
QUALIFY row_number() OVER (PARTITION BY src ORDER BY {gq._H.format("src || '-' || dst", "combine")}, dst) <= 5""",
    "inverse_mapping": f"WITH {gq.EDGES}, {_IDX} SELECT node, idx * 2 + 1 AS value FROM m",
}
