"""Prefixes, masks, targets, augmentations and pooling of sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import encoding as en, labels as lb, sequences as sq
from ..sources.tables import table
from . import sequence_queries as q
from .cleaning_queries import UNIFORM

FIELDS = ("birth_city", "gender", "birth_month", "birth_year")
N_SEPARATORS, AFTER = 5, 12000


def _text(c):
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


def _people(spark: SparkSession, d: str) -> DataFrame:
    b = lb.first_row(table(spark, d, "person_background", "background_id", "rinpersoon", "birth_city", "gender", "birth_year"), ["rinpersoon"], [F.col("background_id")])
    return b.select(F.col("rinpersoon").alias("person"), "birth_city", "gender", F.lit(None).cast("int").alias("birth_month"), "birth_year")


def prefix_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _people(spark, d).select("person", F.concat_ws(" ", en.prefix_tokens(*FIELDS)).alias("prefix"))


def encode_cls(spark: SparkSession, d: str) -> DataFrame:
    """Sequences with the full prefix, which is a segment of its own; the last separators, and a target: whether the person has an event late in the data."""
    s = q._sequences(spark, d).join(_people(spark, d), "person")
    n = len(FIELDS) + 2
    tokens = sq.token_level(s, en.prefix_tokens(*FIELDS), n)
    late = s.select("person", (F.size(F.filter("events", lambda e: e["days"] >= 16000)) > 0).cast("int").alias("target_cls"))
    seg = F.transform("segment", lambda x, i: F.when(i < n, 1).otherwise(x))
    return tokens.join(late, "person").select(
        "person", F.size("tokens").alias("n_tokens"), _text(en.last_separators(F.col("tokens"), N_SEPARATORS)).alias("separators"),
        F.aggregate(seg, F.lit(0), lambda a, x: a + x).alias("segments"), F.concat_ws(" ", F.slice("tokens", 1, n)).alias("prefix"), "target_cls",
    )


def cyclic_segments(spark: SparkSession, d: str) -> DataFrame:
    return q._sequences(spark, d).select("person", _text(sq.cyclic_segments(F.size("events"))).alias("segments"))


def _coded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vocab = q._vocabulary(spark, d)
    return sq.encoded_in_place(q._tokens(spark, d).select("person", "tokens"), vocab).select("person", "ids"), vocab


def event_mask_apply(spark: SparkSession, d: str) -> DataFrame:
    masked = en.mask_events(_coded(spark, d)[0])
    return masked.select("person", _text("ids").alias("ids"), _text("target_pos").alias("target_pos"), _text("target_tokens").alias("target_tokens"))


def decode_targets(spark: SparkSession, d: str) -> DataFrame:
    coded, vocab = _coded(spark, d)
    return en.decoded_targets(en.mask_events(coded), vocab)


def padded_targets(spark: SparkSession, d: str) -> DataFrame:
    out = en.padded_targets(q.token_masking(spark, d))
    return out.select("person", _text("target_pos").alias("target_pos"), _text("target_tokens").alias("target_tokens"))


def smart_masking(spark: SparkSession, d: str) -> DataFrame:
    return en.smart_random(q.token_masking(spark, d), q._vocabulary(spark, d)).select("person", "pos", "target", F.col("id").cast("bigint").alias("id"))


def first_after_threshold(spark: SparkSession, d: str) -> DataFrame:
    return q._sequences(spark, d).select("person", en.first_after(F.col("events"), AFTER).alias("first_after"), en.clipped_from_end(F.transform("events", lambda e: F.size(e["sentence"]) + 1), 90).alias("n_clipped"))


def more_augmentation(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("events")
    left = F.aggregate(en.without_tokens(e), F.lit(0), lambda s, x: s + F.size(x["sentence"]))
    moved = F.aggregate(en.aligned(e, AFTER), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return q._sequences(spark, d).select("person", left.alias("n_tokens"), moved.alias("days_aligned"), F.size(en.cut_in_time(e)).alias("n_cut"), en.hidden(F.col("person")).isNull().alias("is_hidden"), _text(en.sentences_shuffled(e)).alias("shuffled"))


def pooled_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as four tokens of 16 numbers, of which the last is padding for one vector in three."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    tokens = F.array(*[F.slice("embedding", 16 * k + 1, 16) for k in range(4)])
    mean, first = en.pooled(tokens, F.when(F.col("vec_id") % 3 == 0, F.array(*[F.lit(x) for x in (1, 1, 1, 0)])).otherwise(F.array(*[F.lit(1)] * 4)), 16)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 5)
    return v.select("vec_id", total(mean).alias("mean_sum"), F.round(F.get(mean, F.lit(7)), 6).alias("mean_7"), total(first).alias("first_sum"))


def corpus_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "life_events", "event_code").filter("event_code IS NOT NULL").select(F.col("event_code").alias("token"), F.lit("event_code").alias("category"))
    return en.corpus_vocabulary(rows, least=20)


def corpus_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = q._sentences(spark, d).filter("person IS NOT NULL").select("person", "days", F.when(F.col("age").between(1, 120), F.col("age").cast("int")).alias("age"), "sentence")
    born = F.datediff(F.make_date("birth_year", F.lit(7), F.lit(1)), F.lit("1971-12-30").cast("date"))
    people = _people(spark, d).filter("birth_year IS NOT NULL").select("person", born.alias("birth_day"), "gender")
    halves = [rows.filter(F.col("days") % 2 == k) for k in (0, 1)]
    return en.corpus_sentences(halves, people, AFTER, 100).groupBy("gender", "after_threshold").agg(F.count("*").alias("n"), F.sum("age").alias("ages"), F.sum("days").cast("bigint").alias("days"))


def labels_after_split(spark: SparkSession, d: str) -> DataFrame:
    coded = q._sequences(spark, d).select("person", F.size("events").alias("n_events"))
    labels = table(spark, d, "person_marriages", "rinpersoon", "year").filter("year IS NOT NULL AND rinpersoon IS NOT NULL").groupBy(F.col("rinpersoon").alias("person")).agg((F.max("year") >= 2015).cast("int").alias("label"))
    return en.split_then_labels(coded, labels, 300)


QUERIES = {
    x.__name__: x
    for x in (
        prefix_sentences, encode_cls, cyclic_segments, event_mask_apply, decode_targets, padded_targets, smart_masking, first_after_threshold, more_augmentation, pooled_embeddings,
        corpus_vocabulary, corpus_sentences, labels_after_split,
    )
}

_P = """f AS (SELECT rinpersoon AS person, '[CLS] birth_city_' || coalesce(birth_city::VARCHAR, 'MISSING') || ' gender_' || coalesce(gender::VARCHAR, 'MISSING') || ' birth_month_MISSING birth_year_' || coalesce(birth_year::VARCHAR, 'MISSING') || ' [SEP]' AS prefix, birth_year, gender
  FROM person_background QUALIFY row_number() OVER (PARTITION BY rinpersoon ORDER BY background_id) = 1)"""
_MASKED = q._T + f""",
z AS (SELECT *, count(*) OVER (PARTITION BY person) AS len, (pos - 2) // 3 AS k, pos >= 2 AND (pos - 2) % 3 < 2 AS inner_ FROM d),
o AS (SELECT DISTINCT person, k, len FROM z WHERE pos >= 2),
c AS (SELECT person, k FROM o QUALIFY 2 * row_number() OVER (PARTITION BY person ORDER BY {q._H.format("person || '-' || k", "event")}, k) / len::DOUBLE <= 0.3 + 1e-12),
y AS (SELECT z.*, c.k IS NOT NULL AND inner_ AS hit FROM z LEFT JOIN c USING (person, k))"""
_RANDOM = q.ORACLE["token_masking"]

ORACLE = {
    "prefix_sentences": f"WITH {_P} SELECT person, prefix FROM f",
    "encode_cls": q._N + f""",
{_P}, x AS (SELECT * FROM n WHERE k - i <= (512 - 6 - 1) // 3),
l AS (SELECT person, count(*) AS m, sum(CASE WHEN rank_ > 1 AND same THEN 1 ELSE 2 END) AS seg FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY i) AS rank_ FROM x) GROUP BY 1),
t AS (SELECT DISTINCT person FROM p WHERE days >= 16000)
SELECT f.person, (6 + 3 * coalesce(m, 0))::INTEGER AS n_tokens,
       array_to_string(list_resize(list_slice(list_concat([5], list_transform(range(coalesce(m, 0)), lambda j: 8 + 3 * j)), greatest(coalesce(m, 0) + 1 - 5, 0) + 1, coalesce(m, 0) + 1), 5, 0), ',') AS separators,
       (6 + 3 * coalesce(seg, 0))::INTEGER AS segments, prefix, (t.person IS NOT NULL)::INTEGER AS target_cls FROM f LEFT JOIN l USING (person) LEFT JOIN t USING (person)""",
    "cyclic_segments": q._E + """
SELECT b.person, coalesce(array_to_string(list_transform(range(count(p.person)), lambda i: [2, 3, 1][i % 3 + 1]), ','), '') AS segments FROM b LEFT JOIN p USING (person) GROUP BY 1""",
    "event_mask_apply": _MASKED + """
SELECT person, string_agg(CASE WHEN hit THEN 3 ELSE id END, ',' ORDER BY pos) AS ids,
       coalesce(string_agg(pos, ',' ORDER BY pos) FILTER (hit), '') || CASE WHEN count(*) FILTER (hit) = 0 THEN substr(repeat(',511', 153), 2) ELSE repeat(',511', 153 - count(*) FILTER (hit)) END AS target_pos,
       coalesce(string_agg(id, ',' ORDER BY pos) FILTER (hit), '') || CASE WHEN count(*) FILTER (hit) = 0 THEN substr(repeat(',-1', 153), 2) ELSE repeat(',-1', 153 - count(*) FILTER (hit)) END AS target_tokens
FROM y GROUP BY 1""",
    "decode_targets": _MASKED + " SELECT person, pos::INTEGER AS pos, token FROM y WHERE hit",
    "padded_targets": f"""
SELECT person, string_agg(pos, ',' ORDER BY pos) || repeat(',511', 153 - count(*)) AS target_pos, string_agg(target, ',' ORDER BY pos) || repeat(',0', 153 - count(*)) AS target_tokens
FROM ({_RANDOM}) GROUP BY 1""",
    "smart_masking": f"""
WITH k AS ({_RANDOM}), vo AS ({q.ORACLE["vocabulary"]}), g AS (SELECT category, min(id) AS f, count(*) AS n FROM vo GROUP BY 1)
SELECT person, pos, target, CASE WHEN k.id <> target AND k.id <> 3 THEN f + {q._H.format("person || '-' || pos", "mask-token")} % n ELSE k.id END AS id
FROM k JOIN vo ON vo.id = target JOIN g USING (category)""",
    "first_after_threshold": q._N + f"""
SELECT b.person, coalesce(min(i) FILTER (days >= {AFTER}), -1)::INTEGER AS first_after, least(count(i), 30)::INTEGER AS n_clipped FROM b LEFT JOIN n USING (person) GROUP BY 1""",
    "more_augmentation": q._N + f""",
s AS (SELECT person, min(days) FILTER (days >= {AFTER}) AS start, count(*) AS k, list(days ORDER BY i) AS ds FROM n GROUP BY 1),
u AS (SELECT person, CASE WHEN k > 12 THEN ds[(12 + {q._H.format("person::VARCHAR", "cut")} % greatest(k - 12, 1))::BIGINT] END AS last_ FROM s)
SELECT b.person, coalesce(sum(({UNIFORM.format("(b.person || '-' || i || '-0')", "drop")} >= 0.1)::INTEGER + ({UNIFORM.format("(b.person || '-' || i || '-1')", "drop")} >= 0.1)::INTEGER), 0)::INTEGER AS n_tokens,
       coalesce(sum(days - coalesce(start, 0)), 0)::BIGINT AS days_aligned, count(*) FILTER (i IS NOT NULL AND (last_ IS NULL OR days <= last_))::INTEGER AS n_cut,
       {UNIFORM.format("b.person", "hide")} < 0.2 AS is_hidden, coalesce(string_agg(i, ',' ORDER BY days, {q._H.format("b.person || '-' || i", "shuffle")}, i), '') AS shuffled
FROM b LEFT JOIN n USING (person) LEFT JOIN s USING (person) LEFT JOIN u USING (person) GROUP BY b.person""",
    "pooled_embeddings": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 4 END AS m FROM embeddings),
w AS (SELECT vec_id, x, list_transform(range(1, 17), lambda i: list_sum(list_transform(range(m), lambda t: x[i + 16 * t])) / m) AS y FROM v)
SELECT vec_id, round(list_sum(y), 5) AS mean_sum, round(y[8], 6) AS mean_7, round(list_sum(x[1:16]), 5) AS first_sum FROM w""",
    "corpus_vocabulary": r"""
WITH h AS (SELECT -1 AS part, '' AS t, k, tok AS token, cat AS category FROM (
  SELECT unnest(range(5)) AS k, unnest(['[PAD]', '[CLS]', '[SEP]', '[MASK]', '[UNK]']) AS tok, 'GENERAL' AS cat UNION ALL
  SELECT unnest(range(5, 17)), unnest(list_transform(range(1, 13), lambda m: 'MONTH_' || m)), 'MONTH' UNION ALL SELECT unnest(range(17, 63)), unnest(list_transform(range(1946, 1992), lambda y: 'YEAR_' || y)), 'YEAR')),
c AS (SELECT 0, regexp_replace(event_code, '\d+$', ''), coalesce(TRY_CAST(nullif(regexp_extract(event_code, '(\d+)$', 1), '') AS BIGINT), -1), event_code, 'event_code' FROM life_events WHERE event_code IS NOT NULL GROUP BY event_code HAVING count(*) >= 20)
SELECT row_number() OVER (ORDER BY part, t, k, token) - 1 AS id, token, category FROM (FROM h UNION ALL FROM c)""",
    "corpus_sentences": q._E + f""",
{_P}, s AS (SELECT e.person, days - 100 AS days, coalesce(CASE WHEN age BETWEEN 1 AND 120 THEN age END, floor((days - (make_date(birth_year, 7, 1) - DATE '1971-12-30')) / 365.25)::INTEGER) AS age, (days >= {AFTER})::INTEGER AS after_threshold, gender
  FROM e JOIN f USING (person) WHERE birth_year IS NOT NULL)
SELECT gender, after_threshold, count(*) AS n, sum(age)::BIGINT AS ages, sum(days)::BIGINT AS days FROM s GROUP BY 1, 2""",
    "labels_after_split": q._E + """,
c AS (SELECT b.person, count(p.person)::INTEGER AS n_events FROM b LEFT JOIN p USING (person) GROUP BY 1),
r AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY person) <= 300 THEN 'val' ELSE 'train' END AS split FROM c),
l AS (SELECT rinpersoon AS person, (max(year) >= 2015)::INTEGER AS label FROM person_marriages WHERE year IS NOT NULL AND rinpersoon IS NOT NULL GROUP BY 1)
SELECT person, n_events, split, label FROM r JOIN l USING (person)""",
}
