"""Queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import Stage
from ..sources.tables import table
from . import leakage, packing, quantiles, splits
from .markov import Clustering
from .neighbours import close_pairs, neighbours
from .sentences import sentences


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of income for each year, with the largest rank error each can have."""
    income = table(spark, d, "person_income", "rinpersoon", "year", "income", "loaded_at")
    return quantiles.group_percentiles(income, "rinpersoon", "year", "income", "loaded_at").withColumnRenamed("grp", "year")


def p1_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile at a permitted error of 1 %, at which every year's summaries are thinned, has a true rank within its own bound, and the bound within the error."""
    eps = 0.01
    income = table(spark, d, "person_income", "rinpersoon", "year", "income", "loaded_at")
    changes = Stage(quantiles.in_force(income, "rinpersoon", "year", "income", "loaded_at"), "changes").df
    told = quantiles.percentiles(quantiles.combine(quantiles.daily_summaries(changes, eps), eps))
    asked = told.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("percentile", "amount", "n", "max_rank_error"))).alias("asked"))  # as many as percentiles
    counts = changes.groupBy("grp", "amount").agg(F.sum("sign").alias("k"))
    one = counts.join(asked, "grp").select("grp", "k", "amount", F.inline("asked").alias("percentile", "told", "n", "max_rank_error"))
    k = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    ranks = one.groupBy("grp", "percentile", "n", "max_rank_error").agg(k(F.col("amount") < F.col("told")).alias("below"), k(F.col("amount") <= F.col("told")).alias("upto"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("n") - 1e-9))
    error = F.greatest(F.lit(0), rank - F.col("upto"), F.col("below") + 1 - rank)
    # what later deliveries take away has an error of its own
    return ranks.select(F.col("grp").alias("year"), "percentile", "n", (error <= F.col("max_rank_error")).alias("within_bound"), (F.col("max_rank_error") <= 2 * eps * F.col("n") + 2).alias("within_error"))


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    persons = table(spark, d, "person_background", "rinpersoon").withColumnRenamed("rinpersoon", "entity")
    ties = table(spark, d, "person_marriages", "rinpersoon", "partner").toDF("a", "b")
    labelled = table(spark, d, "person_income", "rinpersoon", "is_eval").toDF("entity", "value")
    return persons, ties, labelled


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    persons, ties, labelled = _groups(spark, d)
    return splits.contested(splits.tied_groups(persons, ties), labelled).select(F.col("label").alias("group_key"), F.col("entity").alias("rinpersoon"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    persons, ties, labelled = _groups(spark, d)
    return splits.balanced_splits(splits.tied_groups(persons, ties), labelled)


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every person."""
    chosen = _splits(spark, d)
    return chosen.select(F.col("entity").alias("rinpersoon"), F.col("label").alias("group_key"), "split")


def p2_income_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of person_income by split and is_eval."""
    chosen = _splits(spark, d)
    rows = table(spark, d, "person_income", "rinpersoon", "is_eval")
    met = rows.join(chosen.select(F.col("entity").alias("rinpersoon"), "split"), "rinpersoon", "left")
    return met.groupBy("split", "is_eval").agg(F.count("*").alias("n_rows"))


def p2_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row of what has to hold: persons, persons repeated, groups torn, splits whose share of persons is off by more than a hundredth, of rows by is_eval by more than two."""
    chosen = Stage(_splits(spark, d), "splits").df
    persons = chosen.agg(F.count("*").alias("n_persons"), (F.count("*") - F.count_distinct("entity")).alias("n_repeated"))
    torn = chosen.groupBy("label").agg(F.count_distinct("split").alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias("n_torn"))
    want = F.element_at(F.create_map(*[x for name, share in splits.SPLITS for x in (F.lit(name), F.lit(share))]), F.col("split"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    off = chosen.groupBy("split").agg(F.count("*").alias("n")).select((F.abs(share - want) > 0.01).alias("off")).agg(F.sum(F.col("off").cast("long")).alias("n_off"))
    rows = table(spark, d, "person_income", "rinpersoon", "is_eval").filter("is_eval IN (0, 1)").withColumnRenamed("rinpersoon", "entity").join(chosen, "entity")
    part = F.col("n") / F.sum("n").over(W.partitionBy("is_eval"))
    rows_off = rows.groupBy("split", "is_eval").agg(F.count("*").alias("n")).select((F.abs(part - want) > 0.02).alias("off")).agg(F.sum(F.col("off").cast("long")).alias("n_rows_off"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(persons).join(one(torn), "k").join(one(off), "k").join(one(rows_off), "k").drop("k")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours(table(spark, d, "person_embeddings", "rinpersoon", "cls_emb"), "rinpersoon", "cls_emb", k=10, least=0.95)
    return close_pairs(near).toDF("rinpersoon_a", "rinpersoon_b")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar persons of every person whose number is divisible by 20, among all."""
    asked = F.col("rinpersoon") % 20 == 0
    near = neighbours(table(spark, d, "person_embeddings", "rinpersoon", "cls_emb"), "rinpersoon", "cls_emb", k=10, is_query=asked)
    return near.withColumnsRenamed({"id": "rinpersoon"})


def _clusters(spark: SparkSession, d: str) -> Clustering:
    return Clustering(table(spark, d, "person_embeddings", "rinpersoon", "mean_emb"), "rinpersoon", "mean_emb")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).joined(least=3).withColumnRenamed("id", "rinpersoon")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each Markov cluster with its size and most typical persons."""
    return _clusters(spark, d).summary()


def p4_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row of what has to hold: persons in clusters, those in more than one, clusters that reach beyond a group of :func:`p4_found`, typical persons outside their cluster, sizes summed."""
    c = _clusters(spark, d)
    members = c.members.select("id", "cluster")
    groups = c.joined(least=1).toDF("cluster_key", "id")
    within = members.join(groups, "id").groupBy("cluster").agg(F.count_distinct("cluster_key").alias("n")).filter("n > 1").agg(F.count("*").alias("n_torn"))
    persons = members.groupBy("id").agg(F.count_distinct("cluster").alias("n")).agg(F.count("*").alias("n_persons"), F.sum((F.col("n") > 1).cast("long")).alias("n_repeated"))
    summary = c.summary()
    sizes = summary.agg(F.sum("size").alias("n_members"))
    named = summary.select("cluster_key", F.explode(F.split("typical", ",")).alias("id"))
    own = members.groupBy("cluster").agg(F.min("id").alias("cluster_key")).join(members, "cluster").select("cluster_key", F.col("id").cast("string").alias("id"))
    strange = named.join(own, ["cluster_key", "id"], "left_anti").agg(F.count("*").alias("n_strange"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(persons).join(one(within), "k").join(one(strange), "k").join(one(sizes), "k").drop("k")


def _packed(spark: SparkSession, d: str) -> packing.Packing:
    sized = table(spark, d, "documents", "doc_id", "text").select("doc_id", packing.byt5_tokens("text").alias("size"))
    return packing.Packing(sized, table(spark, d, "pack_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.cut_texts(_packed(spark, d).containers())


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container, position and extent of every piece of every text."""
    return _packed(spark, d).containers().drop("capacity")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """For each target the tokens and pieces packed; with the containers used and the fewest there could be."""
    packed = _packed(spark, d)
    used = packed.containers().groupBy("target_id", "capacity").agg(F.sum("piece_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    return used.join(packed.report(), "target_id")


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each target what has to hold: tokens, pieces, containers over capacity, pieces that don't follow the one before, containers beyond 1 % (and one) above the bound."""
    packed = _packed(spark, d)
    pieces = packed.containers()
    in_container = W.partitionBy("target_id", "container_id").orderBy("position")
    before = F.coalesce(F.lag(F.col("token_offset") + F.col("piece_tokens")).over(in_container), F.lit(0))
    number = F.row_number().over(in_container) - 1
    placed = pieces.withColumns({"wrong": ((before != F.col("token_offset")) | (number != F.col("position"))).cast("long"), "over": (F.col("token_offset") + F.col("piece_tokens") > F.col("capacity")).cast("long")})
    sums = placed.groupBy("target_id").agg(F.sum("piece_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"), F.sum("over").alias("n_over"), F.sum("wrong").alias("n_misplaced"))
    beyond = F.greatest(F.col("n_containers") - F.floor(F.col("least_containers") * 1.01) - 1, F.lit(0)).cast("long")
    return sums.join(packed.report().select("target_id", beyond.alias("n_beyond")), "target_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text", "lang"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Of what the whole search finds, altered passages too, the documents that hold a passage word for word."""
    return _leaks(spark, d).filter("exact_windows > 0").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """All documents with passages of items, altered ones too, and how much of the item they hold."""
    return _leaks(spark, d)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "sent_start", "sent_end")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence with its place and text."""
    return sentences(table(spark, d, "documents", "doc_id", "text"))


#: White space, as a character class of both engines.
_SPACE = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    """One row of what has to hold: documents with units, their characters other than white space, units that overlap or have white space at an end."""
    units = sentences(table(spark, d, "documents", "doc_id", "text"))
    solid = F.length(F.regexp_replace("sentence", _SPACE, ""))
    loose = F.col("sentence").rlike(f"^{_SPACE}|{_SPACE}$")
    before = F.lag("sent_end").over(W.partitionBy("doc_id").orderBy("sent_start"))
    return units.select("doc_id", solid.alias("n"), loose.alias("loose"), (F.coalesce(before, F.lit(0)) > F.col("sent_start")).alias("overlap")).agg(
        F.count_distinct("doc_id").alias("n_documents"), F.sum("n").alias("n_characters"), F.sum(F.col("loose").cast("long")).alias("n_loose"), F.sum(F.col("overlap").cast("long")).alias("n_overlaps")
    )


QUERIES = {
    q.__name__: q
    for q in (
        p1_percentiles, p1_bounds, p2_found, p2_splits, p2_income_rows, p2_invariants, p3_found, p3_neighbours, p4_found, p4_clusters, p4_invariants,
        p8_found, p8_containers, p8_fill, p8_invariants, p9_found, p9_leaks, p10_found, p10_sentences, p10_coverage,
    )
}

def _folded(column: str) -> str:
    """SQL for :func:`leakage.plain`, from the Unicode tables: characters that fold to one other, to none, and (Latin, signs, ligatures) to several."""
    one, none, several = [], [], []
    for code in range(0x80, 0x10000):
        if 0xAC00 <= code < 0xE000:  # Hangul syllables fold to letters of their own, each to others; surrogates
            continue
        c = chr(code)
        to = leakage.plain(c)
        if len(to) == 1 and to != c and to.isalnum():
            one.append((c, to))
        elif not to:
            none.append(c)
        elif len(to) > 1 and (code < 0x250 or 0x1E00 <= code < 0x1F00 or 0x2000 <= code < 0x2150 or 0xFB00 <= code < 0xFB07) and to.isalnum():
            several.append((c, to))
    text = f"lower({column})"
    for c, to in several:
        text = f"replace({text}, '{c}', '{to}')"
    return f"translate({text}, '{''.join(c for c, _ in one)}{''.join(none)}', '{''.join(t for _, t in one)}')"


_LISTS = """regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+') AS words"""

_QS = ", ".join(map(str, quantiles.PERCENTILES))

_SOUND = "len({0}) = 64 AND len(list_filter({0}, lambda e: e IS NOT NULL AND isfinite(e))) = 64 AND len(list_filter({0}, lambda e: e <> 0)) > 0"

ORACLE = {
    # within the permitted error the driver's comparison table is small enough for summaries to be exact
    "p1_percentiles": f"""
WITH r AS (
  SELECT rinpersoon, year, income, loaded_at FROM person_income
  WHERE year IS NOT NULL AND loaded_at IS NOT NULL AND income IS NOT NULL AND NOT isnan(income) AND NOT isinf(income) AND income NOT IN (9999999999, 8888888888)),
k AS (
  SELECT year, income FROM r WHERE rinpersoon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rinpersoon, year ORDER BY loaded_at DESC, income DESC) = 1
  UNION ALL SELECT year, income FROM r WHERE rinpersoon IS NULL)
SELECT year, unnest([{_QS}]::DOUBLE[]) AS percentile, unnest(amounts) AS amount, 0::BIGINT AS max_rank_error, n
FROM (SELECT year, quantile_disc(income, [{_QS}]) AS amounts, count(*) AS n FROM k GROUP BY year)""",
    "p1_bounds": f"""
WITH r AS (
  SELECT rinpersoon, year, income, loaded_at FROM person_income
  WHERE year IS NOT NULL AND loaded_at IS NOT NULL AND income IS NOT NULL AND NOT isnan(income) AND NOT isinf(income) AND income NOT IN (9999999999, 8888888888)),
k AS (SELECT year, count(DISTINCT rinpersoon) + count(*) FILTER (rinpersoon IS NULL) AS n FROM r GROUP BY 1)
SELECT year, unnest([{_QS}]::DOUBLE[]) AS percentile, n, true AS within_bound, true AS within_error FROM k""",
    "p2_invariants": """
SELECT count(DISTINCT rinpersoon) AS n_persons, 0::BIGINT AS n_repeated, 0::BIGINT AS n_torn, 0::BIGINT AS n_off, 0::BIGINT AS n_rows_off FROM person_background""",
    "p2_found": """
WITH RECURSIVE p AS (SELECT DISTINCT rinpersoon AS x FROM person_background WHERE rinpersoon IS NOT NULL),
t AS (
  SELECT rinpersoon AS a, partner AS b FROM person_marriages WHERE rinpersoon <> partner AND rinpersoon IN (FROM p) AND partner IN (FROM p)
  UNION SELECT partner, rinpersoon FROM person_marriages WHERE rinpersoon <> partner AND rinpersoon IN (FROM p) AND partner IN (FROM p)),
c AS (SELECT x AS a, x AS b FROM p UNION SELECT c.a, t.b FROM c JOIN t ON t.a = c.b),
g AS (SELECT a AS rinpersoon, min(b) AS group_key FROM c GROUP BY 1),
k AS (SELECT group_key FROM g LEFT JOIN person_income i USING (rinpersoon) GROUP BY 1
      HAVING count(DISTINCT rinpersoon) >= 2 AND bool_or(i.is_eval = 1) AND bool_or(i.is_eval = 0))
SELECT group_key, rinpersoon FROM g WHERE group_key IN (FROM k)""",
    "p3_found": """
WITH v AS (SELECT DISTINCT rinpersoon AS id, cls_emb::DOUBLE[] AS x FROM person_embeddings WHERE rinpersoon IS NOT NULL AND """ + _SOUND.format("cls_emb") + """),
s AS (SELECT a.id AS q, b.id AS n, round(least(list_cosine_similarity(a.x, b.x), 1.0), 6) AS c FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, n) <= 10)
SELECT DISTINCT least(q, n) AS rinpersoon_a, greatest(q, n) AS rinpersoon_b FROM t WHERE c >= 0.95""",
    "p4_found": """
WITH RECURSIVE v AS (SELECT DISTINCT rinpersoon AS id, mean_emb::DOUBLE[] AS x FROM person_embeddings WHERE rinpersoon IS NOT NULL AND """ + _SOUND.format("mean_emb") + """),
s AS MATERIALIZED (SELECT a.id AS q, b.id AS n FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.x, b.x) >= 0.80),
c AS (SELECT id AS a, id AS b FROM v UNION SELECT c.a, s.n FROM c JOIN s ON s.q = c.b),
g AS (SELECT a AS rinpersoon, min(b) AS cluster_key FROM c GROUP BY 1)
SELECT cluster_key, rinpersoon FROM g WHERE cluster_key IN (SELECT cluster_key FROM g GROUP BY 1 HAVING count(*) >= 3)""",
    "p10_coverage": rf"""
WITH s AS (SELECT doc_id, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS n FROM documents WHERE text IS NOT NULL)
SELECT count(DISTINCT doc_id) AS n_documents, sum(n)::BIGINT AS n_characters, 0::BIGINT AS n_loose, 0::BIGINT AS n_overlaps FROM s WHERE n > 0""",
    "p4_invariants": """
WITH v AS (SELECT DISTINCT rinpersoon AS id FROM person_embeddings WHERE rinpersoon IS NOT NULL AND """ + _SOUND.format("mean_emb") + """)
SELECT count(*) AS n_persons, 0::BIGINT AS n_repeated, 0::BIGINT AS n_torn, 0::BIGINT AS n_strange, count(*) AS n_members FROM v""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_LISTS.format(_folded("text"))} FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, coalesce(lower(lang) = 'zh', false) AS letters, {_LISTS.format(_folded("text"))} FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT item_id, unnest(list_transform(range(1, len(words) - 10), lambda k: array_to_string(words[k:k + 11], ' '))) AS x FROM i WHERE NOT letters),
l AS (SELECT item_id, unnest(list_transform(range(1, length(array_to_string(words, '')) - 18), lambda k: substr(array_to_string(words, ''), k, 20))) AS x FROM i WHERE letters),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 10), lambda k: array_to_string(words[k:k + 11], ' '))) AS x FROM d),
dl AS (SELECT doc_id, unnest(list_transform(range(1, length(array_to_string(words, '')) - 18), lambda k: substr(array_to_string(words, ''), k, 20))) AS x FROM d)
SELECT doc_id, item_id FROM dw JOIN w USING (x) UNION SELECT doc_id, item_id FROM dl JOIN l USING (x)""",
    "p8_invariants": """
SELECT target_id, sum(octet_length(encode(text)) + 1)::BIGINT AS n_tokens, sum(octet_length(encode(text)) // capacity + 1)::BIGINT AS n_pieces,
       0::BIGINT AS n_over, 0::BIGINT AS n_misplaced, 0::BIGINT AS n_beyond
FROM documents, pack_targets WHERE text IS NOT NULL GROUP BY 1""",
    "p8_found": """
SELECT target_id, doc_id FROM documents, pack_targets WHERE text IS NOT NULL AND octet_length(encode(text)) + 1 > capacity""",
}
