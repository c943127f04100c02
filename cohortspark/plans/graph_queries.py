"""Networks of persons in layers, with their SQL.

Layers: marriages; persons who follow each other among the spells of a job type; persons who follow each other
among the versions of a municipality. Following ties keep every layer linear in its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import graph as g
from ..operators.spells import years_covered
from ..sources.tables import table

LAYERS = ("family", "neighbour", "work")
#: Elements of a walk.
STEPS = 40
STAY = 0.8
WEIGHTS = {"family": 0.6, "neighbour": 0.1, "work": 0.1}
SALT_BUCKETS = 32


def _edges(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "person_marriages", "rinpersoon", "partner").select(F.lit("family").alias("layer"), F.col("rinpersoon").alias("src"), F.col("partner").alias("dst"))

    def following(df: DataFrame, layer: str, person: str, group: str) -> DataFrame:
        # a large group is cut by a hash of the person, so that it is never ordered in one task
        bucket = F.pmod(F.col(person), F.lit(SALT_BUCKETS))
        rows = df.filter(F.col(person).isNotNull() & F.col(group).isNotNull()).select(F.col(person).alias("src"), F.col(group).alias("grp"), bucket.alias("b")).distinct()
        nxt = F.lead("src").over(W.partitionBy("grp", "b").orderBy("src"))
        return rows.select(F.lit(layer).alias("layer"), "src", nxt.alias("dst")).filter("dst IS NOT NULL")

    w = following(table(spark, d, "spolisbus", "RINPERSOON", "jobType"), "work", "RINPERSOON", "jobType")
    n = following(table(spark, d, "person_background", "rinpersoon", "municipality"), "neighbour", "rinpersoon", "municipality")
    known = table(spark, d, "person_background", "rinpersoon").distinct()
    both = m.unionByName(w).unionByName(n).distinct()
    return both.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").filter("src != dst").select("layer", "src", "dst")


def _persons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person_background", "rinpersoon").toDF("person").distinct()


def symmetric_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.symmetric(_edges(spark, d)).groupBy("layer").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_nodes"))


def reindexed_edges(spark: SparkSession, d: str) -> DataFrame:
    edges, _ = g.reindexed(_edges(spark, d))
    return edges


def largest_component(spark: SparkSession, d: str) -> DataFrame:
    return g.largest_component(g.connected_components(_edges(spark, d)))


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return g.connected_components(_edges(spark, d).filter("layer = 'family'")).groupBy("component").agg(F.count("*").alias("n"))


def layer_degree_stats(spark: SparkSession, d: str) -> DataFrame:
    out = g.layer_degrees(_edges(spark, d), _persons(spark, d), LAYERS)
    return out.select("layer", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def layer_intersections(spark: SparkSession, d: str) -> DataFrame:
    out = g.layer_intersections(_edges(spark, d), _persons(spark, d), LAYERS)
    return out.select("pair", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def node_features(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "person_marriages", "rinpersoon", "partner", "year").filter("rinpersoon IS NOT NULL AND partner IS NOT NULL").select(F.col("rinpersoon").alias("src"), F.col("partner").alias("dst"), F.pmod("year", F.lit(7)).alias("code"))
    return g.node_features(coded, [0, 1, 2, 3], _persons(spark, d))


def layered_walks(spark: SparkSession, d: str) -> DataFrame:
    return g.layered_walks(_edges(spark, d), STEPS, STAY).filter("step > 0")


def priority_walks(spark: SparkSession, d: str) -> DataFrame:
    return g.layered_walks(_edges(spark, d), STEPS, 0.0, seed="priority", weights=WEIGHTS).filter("step > 0")


def context_pairs(spark: SparkSession, d: str) -> DataFrame:
    return g.context_pairs(g.layered_walks(_edges(spark, d), STEPS, STAY), 2).select("center", "context", F.round("weight", 6).alias("weight"))


def k_hop_neighbours(spark: SparkSession, d: str) -> DataFrame:
    starts = _persons(spark, d)
    return g.hop_neighbourhood(_edges(spark, d), starts)


def csr_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Where each node's neighbours begin in one list of all, nodes on dense ids."""
    from ..operators.ranking import global_order

    edges, mapping = g.reindexed(_edges(spark, d))
    degree = g.symmetric(edges.select("src", "dst")).groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("degree"))
    full = mapping.select("idx").join(degree, "idx", "left").na.fill(0)
    return global_order(full, "idx", count="degree").select("idx", "degree", F.col("before").alias("ptr"))


def positive_negative_pairs(spark: SparkSession, d: str) -> DataFrame:
    return g.negative_samples(_edges(spark, d))


def area_residents(spark: SparkSession, d: str) -> DataFrame:
    """Edges by layer and year of persons who had a spell in the year in the area of municipalities below 20, both ends."""
    area = table(spark, d, "person_background", "rinpersoon", "municipality").filter("municipality < 20").select("rinpersoon").distinct()
    spells = table(spark, d, "spolisbus", "RINPERSOON", "begJob", "endJob").withColumnRenamed("RINPERSOON", "rinpersoon").join(area, "rinpersoon", "left_semi")
    live = years_covered(spells, "rinpersoon", F.year("begJob"), F.year("endJob"), (2005, 2015))
    a, b = live.toDF("src", "year"), live.toDF("dst", "year")
    return _edges(spark, d).join(a, "src").join(b, ["dst", "year"]).groupBy("layer", "year").agg(F.count("*").alias("n"))


QUERIES = {
    q.__name__: q
    for q in (
        symmetric_edges, reindexed_edges, largest_component, component_sizes, layer_degree_stats, layer_intersections, node_features, layered_walks, priority_walks,
        context_pairs, k_hop_neighbours, csr_degrees, positive_negative_pairs, area_residents,
    )
}

EDGES = f"""
p AS (SELECT DISTINCT rinpersoon AS person FROM person_background WHERE rinpersoon IS NOT NULL),
w0 AS (SELECT DISTINCT RINPERSOON AS s, jobType AS grp FROM spolisbus WHERE RINPERSOON IS NOT NULL AND jobType IS NOT NULL),
n0 AS (SELECT DISTINCT rinpersoon AS s, municipality AS grp FROM person_background WHERE municipality IS NOT NULL),
a0 AS (SELECT 'family' AS layer, rinpersoon AS src, partner AS dst FROM person_marriages
       UNION ALL SELECT 'work', s, lead(s) OVER (PARTITION BY grp, s % {SALT_BUCKETS} ORDER BY s) FROM w0
       UNION ALL SELECT 'neighbour', s, lead(s) OVER (PARTITION BY grp, s % {SALT_BUCKETS} ORDER BY s) FROM n0),
edges AS (SELECT DISTINCT layer, src, dst FROM a0 WHERE src <> dst AND src IN (FROM p) AND dst IN (FROM p)),
sym AS (SELECT layer, src, dst FROM edges UNION SELECT layer, dst, src FROM edges)"""

_STATS = "count(*) AS n, round(avg(degree), 6) AS mean, round(median(degree), 6) AS median, round(stddev_pop(degree), 6) AS std, round(quantile_cont(degree, 0.1), 6) AS p10, round(quantile_cont(degree, 0.9), 6) AS p90, round(avg((degree > 0)::INTEGER), 6) AS nonzero"
_H = "('0x' || substr(md5({0} || ':{1}'), 1, 8))::BIGINT"


def _walk(seed: str, stay: float, weights: dict[str, float] | None = None) -> str:
    key = "source || '-' || (step + 1)"
    drawn = f"layers[({_H.format(key, seed + '-layer')} % len(layers) + 1)::BIGINT]"
    if weights:
        w = "list_transform(layers, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + " END)"
        upto = f"list_transform(range(1, len(layers) + 1), lambda k: list_reduce(list_prepend(0.0::DOUBLE, {w}[1:k]), lambda a, b: a + b) / list_reduce(list_prepend(0.0::DOUBLE, {w}), lambda a, b: a + b))"
        drawn = f"layers[least(len(list_filter({upto}, lambda r: r <= {_H.format(key, seed + '-layer')} / 4294967296.0)) + 1, len(layers))]"
    return f"""
per AS (SELECT src AS node, layer, list(DISTINCT dst ORDER BY dst) AS around FROM sym GROUP BY 1, 2),
nl AS (SELECT node, list(layer ORDER BY layer) AS layers FROM per GROUP BY 1),
walk AS (SELECT node AS source, 0 AS step, NULL::VARCHAR AS layer, node FROM nl
  UNION ALL
  SELECT source, step, c.layer, around[({_H.format("source || '-' || step", seed + "-node")} % len(around) + 1)::BIGINT] FROM (
    SELECT source, step + 1 AS step, node, CASE WHEN layer IS NOT NULL AND list_contains(layers, layer) AND {_H.format(key, seed + "-stay")} / 4294967296.0 < {stay} THEN layer ELSE {drawn} END AS layer
    FROM walk JOIN nl USING (node) WHERE step < {STEPS - 1}) c JOIN per ON per.node = c.node AND per.layer = c.layer)"""


ORACLE = {
    "symmetric_edges": f"WITH {EDGES} SELECT layer, count(*) AS n, count(DISTINCT src) AS n_nodes FROM sym GROUP BY 1",
    "reindexed_edges": f"""WITH {EDGES}, m AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))
SELECT layer, a.idx AS src, b.idx AS dst FROM edges JOIN m a ON a.node = src JOIN m b ON b.node = dst""",
    "component_sizes": f"""WITH RECURSIVE {EDGES}, c AS (SELECT src AS a, src AS b FROM sym WHERE layer = 'family' UNION SELECT c.a, s.dst FROM c JOIN sym s ON s.src = c.b AND s.layer = 'family'),
g AS (SELECT a, min(b) AS component FROM c GROUP BY 1) SELECT component, count(*) AS n FROM g GROUP BY 1""",
    "largest_component": f"""WITH RECURSIVE {EDGES}, nb AS (SELECT DISTINCT src, dst FROM sym), c AS (SELECT src AS a, src AS b FROM nb UNION SELECT c.a, nb.dst FROM c JOIN nb ON nb.src = c.b),
g AS (SELECT a AS node, min(b) AS component FROM c GROUP BY 1)
SELECT node FROM g WHERE component = (SELECT component FROM g GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)""",
    "layer_degree_stats": f"""WITH {EDGES}, l AS (SELECT unnest({list(LAYERS)}) AS layer),
d AS (SELECT l.layer, person, count(dst) AS degree FROM p CROSS JOIN l LEFT JOIN sym s ON s.src = person AND s.layer = l.layer GROUP BY 1, 2)
SELECT layer, {_STATS} FROM d GROUP BY 1""",
    "layer_intersections": f"""WITH {EDGES}, l AS (SELECT a, b FROM (SELECT unnest({list(LAYERS)}) AS a), (SELECT unnest({list(LAYERS)}) AS b) WHERE a < b),
i AS (SELECT x.src, x.layer AS a, y.layer AS b FROM sym x JOIN sym y ON x.src = y.src AND x.dst = y.dst AND x.layer < y.layer),
d AS (SELECT l.a || '-' || l.b AS pair, person, count(i.src) AS degree FROM p CROSS JOIN l LEFT JOIN i ON i.src = person AND i.a = l.a AND i.b = l.b GROUP BY 1, 2)
SELECT pair, {_STATS} FROM d GROUP BY 1""",
    "node_features": """WITH p AS (SELECT DISTINCT rinpersoon AS person FROM person_background),
e AS (SELECT rinpersoon AS person, year % 7 AS code FROM person_marriages WHERE rinpersoon IS NOT NULL AND partner IS NOT NULL)
SELECT person, """ + ", ".join(f"CASE WHEN count(e.person) = 0 THEN -1 ELSE count(*) FILTER (code = {c}) END AS code_{c}" for c in range(4)) + """,
       CASE WHEN count(e.person) = 0 THEN -1 ELSE count(*) FILTER (code IS NULL OR code > 3) END AS other FROM p LEFT JOIN e USING (person) GROUP BY 1""",
    "layered_walks": f"WITH RECURSIVE {EDGES}, {_walk('walk', STAY)} SELECT source, step::INTEGER AS step, layer, node FROM walk WHERE step > 0",
    "context_pairs": f"""WITH RECURSIVE {EDGES}, {_walk('walk', STAY)}
SELECT a.node AS center, b.node AS context, round(sum(1 - (abs(a.step - b.step) - 1) / 2.0), 6) AS weight FROM walk a JOIN walk b ON a.source = b.source AND a.step <> b.step AND abs(a.step - b.step) <= 2 GROUP BY 1, 2""",
    "priority_walks": f"WITH RECURSIVE {EDGES}, {_walk('priority', 0.0, WEIGHTS)} SELECT source, step::INTEGER AS step, layer, node FROM walk WHERE step > 0",
    "positive_negative_pairs": f"""WITH {EDGES}, m AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT src AS node FROM sym)),
e AS (SELECT layer, src AS node, list(DISTINCT dst ORDER BY dst) AS around FROM sym GROUP BY 1, 2),
x AS (SELECT layer, nd AS node, list(idx ORDER BY idx) AS ex, any_value(n) AS n FROM (SELECT layer, src AS nd, dst AS o FROM sym UNION SELECT layer, src, src FROM sym) JOIN m ON m.node = o GROUP BY 1, 2) ,
r AS (SELECT layer, node, around[({_H.format("layer || '-' || node", "negative-p")} % len(around) + 1)::BIGINT] AS positive,
  CASE WHEN n > len(ex) THEN list_reduce(list_prepend({_H.format("layer || '-' || node", "negative")} % (n - len(ex)), ex), lambda a, b: a + (b <= a)::INTEGER) END AS idx FROM e JOIN x USING (layer, node))
SELECT layer, r.node, positive, m.node AS negative FROM r LEFT JOIN m ON m.idx = r.idx""",
    "csr_degrees": f"""WITH {EDGES}, m AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)),
d AS (SELECT idx, count(DISTINCT dst) AS degree FROM m LEFT JOIN sym ON src = node GROUP BY 1)
SELECT idx, degree, coalesce(sum(degree) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ptr FROM d""",
    "area_residents": f"""WITH {EDGES}, live AS (
  SELECT DISTINCT RINPERSOON AS x, unnest(range(greatest(year(begJob), 2005), least(year(endJob), 2015) + 1)) AS year FROM spolisbus
  WHERE RINPERSOON IN (SELECT rinpersoon FROM person_background WHERE municipality < 20) AND begJob IS NOT NULL AND endJob IS NOT NULL)
SELECT layer, a.year::INTEGER AS year, count(*) AS n FROM edges JOIN live a ON a.x = src JOIN live b ON b.x = dst AND b.year = a.year GROUP BY 1, 2""",
    "k_hop_neighbours": f"""WITH {EDGES}, nb AS (SELECT DISTINCT src, dst FROM sym),
h1 AS (SELECT DISTINCT person, dst AS other FROM p JOIN nb ON src = person),
f1 AS (SELECT * FROM h1 QUALIFY row_number() OVER (PARTITION BY person ORDER BY {_H.format("person || '-' || other", "hop")}, other) <= 2),
h2 AS (SELECT DISTINCT f.person, dst AS other FROM f1 f JOIN nb ON src = other WHERE dst <> f.person AND (f.person, dst) NOT IN (SELECT (person, other) FROM h1)),
f2 AS (SELECT * FROM h2 QUALIFY row_number() OVER (PARTITION BY person ORDER BY {_H.format("person || '-' || other", "hop")}, other) <= 2),
h3 AS (SELECT DISTINCT f.person, dst AS other FROM f2 f JOIN nb ON src = other WHERE dst <> f.person AND (f.person, dst) NOT IN (SELECT (person, other) FROM h1) AND (f.person, dst) NOT IN (SELECT (person, other) FROM h2))
SELECT person, 1 AS hop, other FROM h1 UNION ALL SELECT person, 2, other FROM h2 UNION ALL SELECT person, 3, other FROM h3""",
}
