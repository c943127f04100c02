"""Spells, life sequences, vocabularies, encodings and masks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrays, dates
from ..operators import sequences as sq, spells as sp
from ..sources.tables import table
from .cleaning_queries import UNIFORM

#: Length of encoded sequences.
LENGTH = sq.MAX_LENGTH
PREFIX = 2


def _background(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person_background", "rinpersoon").toDF("person").distinct()


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "life_events", "RINPERSOON", "daysSinceFirstEvent", "age", "source", "event_code").filter("daysSinceFirstEvent BETWEEN 0 AND 17999").distinct()
    return sq.event_sentences(rows, "RINPERSOON", "daysSinceFirstEvent", "age", ["source", "event_code"], 0)


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return sq.life_sequences(_sentences(spark, d), _background(spark, d))


def life_sequence_summary(spark: SparkSession, d: str) -> DataFrame:
    same = F.size(F.filter(sq.segments("events"), lambda s: s == 1))
    return _sequences(spark, d).select(
        "person", F.size("events").alias("n_events"), F.size(F.array_distinct(F.transform("events", lambda e: e["days"]))).alias("n_days"),
        F.get("events", F.lit(0))["days"].alias("first_abspos"), F.get("events", F.size("events") - 1)["days"].alias("last_abspos"), same.alias("n_same_day"),
    )


def life_sequence_tokens(spark: SparkSession, d: str) -> DataFrame:
    spells = sp.spells_to_events(table(spark, d, "spolisbus", "RINPERSOON", "contractType", "begJob", "endJob").distinct(), "begJob", "endJob", ["RINPERSOON", "contractType"])
    jobs = sq.event_sentences(spells, "RINPERSOON", "daysSinceFirstEvent", "age", ["eventType", "contractType"], 1)
    both = sq.life_sequences(_sentences(spark, d).unionByName(jobs), _background(spark, d))
    text = F.transform("events", lambda e: F.concat(e["days"].cast("string"), F.lit(":"), F.concat_ws(" ", e["sentence"])))
    return both.select("person", F.size("events").alias("n_events"), F.concat_ws("|", text).alias("sequence"))


def background_sentence(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "person_background", "background_id", "birth_year", "gender", "municipality")
    one = lambda c: F.concat(F.lit(f"{c}_"), F.coalesce(F.col(c).cast("string"), F.lit("MISSING"))).alias(c)
    return b.select("background_id", F.struct(one("birth_year"), one("gender"), one("municipality")).alias("b")).select("background_id", F.concat_ws(" ", "b.birth_year", "b.gender", "b.municipality").alias("background"))


def spells_to_events(spark: SparkSession, d: str) -> DataFrame:
    return sp.spells_to_events(table(spark, d, "spolisbus"), "begJob", "endJob", ["RINPERSOON", "IKVID"]).select("RINPERSOON", "IKVID", "eventType", "daysSinceFirstEvent", "age")


def melt_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spolisbus", "RINPERSOON", "contractType", "jobType", "begJob")
    return sp.melt_tokens(rows, "RINPERSOON", ["contractType", "jobType"], F.year("begJob"), (2005, 2015))


def spell_aggregate_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spolisbus", "RINPERSOON", "IKVID", "contractType", "begJob", "endJob", "nbHours").filter("RINPERSOON IS NOT NULL AND IKVID IS NOT NULL AND begJob IS NOT NULL").distinct()
    order = [F.col("begJob"), F.coalesce("endJob", F.lit("9999-12-31").cast("date")), F.coalesce("contractType", F.lit("")), F.coalesce("nbHours", F.lit(-1.0))]
    jobs = sp.job_spells(rows, "RINPERSOON", "IKVID", "begJob", "endJob", "nbHours", ["contractType"], order)
    return jobs.select("RINPERSOON", "IKVID", "beg", "end", F.round("hours", 4).alias("hours"), "contractType", "job_no", "n_jobs")


def age_at_event(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spolisbus", "begJob", "endJob").filter("begJob IS NOT NULL AND endJob IS NOT NULL AND year(endJob) < 3000")
    born = F.date_sub("begJob", 9000)
    return rows.select(
        "begJob", "endJob", dates.days_since_genesis("begJob").alias("days"), F.date_format(dates.date_of_day(dates.days_since_genesis("begJob") + 30), "yyyy-MM-dd").alias("later"),
        dates.integer_age("endJob", born).alias("age"), F.datediff("endJob", "begJob").alias("length"),
    )


def job_changes_by_year(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "life_events", "RINPERSOON", "daysSinceFirstEvent", "event_code").filter("event_code LIKE 'JOB%' AND daysSinceFirstEvent BETWEEN 0 AND 17999")
    year = F.year(dates.date_of_day("daysSinceFirstEvent"))
    return rows.select("RINPERSOON", year.alias("year")).filter("year > 2010").groupBy("year").agg(F.count_distinct("RINPERSOON").alias("n_persons"))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    tokens = s.select("source", F.posexplode("sentence").alias("ordinal", "token")).distinct().withColumn("category", F.element_at(F.array(F.lit("source"), F.lit("event_code")), F.col("ordinal") + 1))
    return sq.vocabulary(tokens, [("gender_1", "gender"), ("gender_2", "gender")])


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d)


def token_person_counts(spark: SparkSession, d: str) -> DataFrame:
    return sq.token_persons(_sentences(spark, d).filter("person IS NOT NULL"), 20)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return sq.token_level(_sequences(spark, d), F.array(F.lit(sq.CLS), F.lit(sq.SEP)), PREFIX, LENGTH)


def encode_sequences(spark: SparkSession, d: str) -> DataFrame:
    coded = sq.encoded_in_place(_tokens(spark, d), _vocabulary(spark, d))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return coded.select("person", text(arrays.pad_right("ids", LENGTH, 0)).alias("input_ids"), text("abspos").alias("abspos"), text("segment").alias("segment"), F.size("ids").alias("n_tokens"))


def time_slice_min_events(spark: SparkSession, d: str) -> DataFrame:
    cut = _sequences(spark, d).filter(F.size("events") >= sq.MIN_EVENTS).withColumn("events", sq.slice_time(9000, 14000)).filter(F.size("events") >= sq.MIN_EVENTS)
    return cut.select("person", F.size("events").alias("n_events"))


def token_masking(spark: SparkSession, d: str) -> DataFrame:
    vocab = _vocabulary(spark, d)
    coded = sq.encoded_in_place(_tokens(spark, d).select("person", "tokens"), vocab)
    return sq.random_mask(coded.select("person", F.posexplode("ids").alias("pos", "id")), vocab.count())


def event_masking(spark: SparkSession, d: str) -> DataFrame:
    return sq.masked_events(_sequences(spark, d), 0.3).groupBy("person").agg(F.sum(F.col("masked").cast("int")).alias("n_masked"), F.sum(F.when(F.col("masked"), F.col("n")).otherwise(0)).alias("n_tokens"), F.count("*").alias("n_events"))


def cls_permutation(spark: SparkSession, d: str) -> DataFrame:
    p = sq.permuted(_sequences(spark, d))
    return p.select("person", "target_cls", F.concat_ws(",", F.transform("order", lambda i: i.cast("string"))).alias("sentence_order"))


def augmentation(spark: SparkSession, d: str) -> DataFrame:
    s = _sequences(spark, d)
    moved = sq.time_noise(F.col("events"))
    return s.select("person", F.aggregate(moved, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("days_moved"), F.size(sq.resampled(F.col("events"))).alias("n_resampled"))


def train_val_test(spark: SparkSession, d: str) -> DataFrame:
    return _background(spark, d).select("person", sq.split_by_hash("person").alias("split"))


def sampled_persons(spark: SparkSession, d: str) -> DataFrame:
    ids = sq.sample_ids(_background(spark, d), "person", 0.25)
    return _sentences(spark, d).join(ids, "person", "left_semi").groupBy("person").agg(F.count("*").alias("n_rows"))


def bag_of_words(spark: SparkSession, d: str) -> DataFrame:
    words = _sentences(spark, d).join(_background(spark, d), "person", "left_semi").select("person", F.explode("sentence").alias("token"))
    counts = words.groupBy("person", "token").agg(F.count("*").alias("n"))
    totals = counts.groupBy("person").agg(F.sum("n").alias("total"))
    return counts.join(totals, "person").select("person", "token", F.round(F.col("n") / F.col("total"), 8).alias("share"))


QUERIES = {
    q.__name__: q
    for q in (
        life_sequence_summary, life_sequence_tokens, background_sentence, spells_to_events, melt_tokens, spell_aggregate_first, age_at_event, job_changes_by_year, vocabulary,
        token_person_counts, encode_sequences, time_slice_min_events, token_masking, event_masking, cls_permutation, augmentation, train_val_test, sampled_persons, bag_of_words,
    )
}

_E = """
WITH b AS (SELECT DISTINCT rinpersoon AS person FROM person_background),
e AS (SELECT DISTINCT RINPERSOON AS person, daysSinceFirstEvent AS days, age, 'source_' || coalesce(source, 'MISSING') AS t1, 'event_code_' || coalesce(event_code, 'MISSING') AS t2
      FROM life_events WHERE daysSinceFirstEvent BETWEEN 0 AND 17999),
p AS (SELECT e.* FROM e JOIN b USING (person))"""

_N = _E + """,
n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY person) AS k, coalesce(lag(days) OVER w = days, false) AS same
      FROM p WINDOW w AS (PARTITION BY person ORDER BY days, t1, t2, age NULLS FIRST))"""

_V = _N + """,
v0 AS (SELECT -2 AS s, unnest(range(5)) AS o, unnest(['[PAD]', '[CLS]', '[SEP]', '[MASK]', '[UNK]']) AS token, 'GENERAL' AS category
       UNION ALL SELECT -1, unnest(range(2)), unnest(['gender_1', 'gender_2']), 'gender'
       UNION ALL SELECT DISTINCT 0, 0, t1, 'source' FROM e UNION ALL SELECT DISTINCT 0, 1, t2, 'event_code' FROM e),
v AS (SELECT row_number() OVER (ORDER BY s, o, token) - 1 AS id, token, category FROM v0)"""

_T = _V + f""",
x AS (SELECT * FROM n WHERE k - i <= ({LENGTH} - {PREFIX} - 1) // 3),
l AS (SELECT person, {PREFIX} + 3 * (row_number() OVER (PARTITION BY person ORDER BY i) - 1) AS place, *EXCLUDE person FROM x),
w AS (SELECT person, 0 AS pos, '[CLS]' AS token, 0 AS abspos, 0 AS seg FROM b UNION ALL SELECT person, 1, '[SEP]', 0, 0 FROM b
      UNION ALL SELECT person, place + o, CASE o WHEN 0 THEN t1 WHEN 1 THEN t2 ELSE '[SEP]' END, days,
                CASE WHEN place > {PREFIX} AND same THEN 1 ELSE 2 END FROM l, (SELECT unnest([0, 1, 2]) AS o)),
d AS (SELECT w.*, coalesce(v.id, 4) AS id FROM w LEFT JOIN v USING (token))"""

_H = "('0x' || substr(md5({0} || ':{1}'), 1, 8))::BIGINT"

ORACLE = {
    "life_sequence_summary": _N + """
SELECT b.person, count(n.person)::INTEGER AS n_events, count(DISTINCT days)::INTEGER AS n_days, min(days) AS first_abspos, max(days) AS last_abspos,
       count(*) FILTER (same)::INTEGER AS n_same_day FROM b LEFT JOIN n USING (person) GROUP BY 1""",
    "life_sequence_tokens": _E + """,
j AS (SELECT DISTINCT RINPERSOON AS person, coalesce(contractType, 'MISSING') AS c, begJob, endJob, contractType FROM spolisbus),
u AS (SELECT person, days, 0 AS s, t1, t2, age::DOUBLE AS age FROM p
      UNION ALL SELECT person, (begJob - DATE '1971-12-30'), 1, 'eventType_beg', 'contractType_' || c, 0 FROM j JOIN b USING (person) WHERE begJob IS NOT NULL
      UNION ALL SELECT person, (endJob - DATE '1971-12-30'), 1, 'eventType_end', 'contractType_' || c, 0 FROM j JOIN b USING (person) WHERE endJob IS NOT NULL)
SELECT b.person, count(u.person)::INTEGER AS n_events, coalesce(string_agg(days || ':' || t1 || ' ' || t2, '|' ORDER BY days, s, t1, t2, age NULLS FIRST), '') AS sequence
FROM b LEFT JOIN u USING (person) GROUP BY 1""",
    "background_sentence": """
SELECT background_id, 'birth_year_' || coalesce(birth_year::VARCHAR, 'MISSING') || ' gender_' || coalesce(gender::VARCHAR, 'MISSING') || ' municipality_' || coalesce(municipality::VARCHAR, 'MISSING') AS background
FROM person_background""",
    "spells_to_events": """
SELECT RINPERSOON, IKVID, 'beg' AS eventType, (begJob - DATE '1971-12-30')::INTEGER AS daysSinceFirstEvent, 0 AS age FROM spolisbus WHERE begJob IS NOT NULL
UNION ALL SELECT RINPERSOON, IKVID, 'end', (endJob - DATE '1971-12-30')::INTEGER, 0 FROM spolisbus WHERE endJob IS NOT NULL""",
    "melt_tokens": """
SELECT RINPERSOON, year(begJob)::INTEGER AS year, 'contractType_' || contractType AS token FROM spolisbus WHERE year(begJob) BETWEEN 2005 AND 2015 AND contractType IS NOT NULL
UNION ALL SELECT RINPERSOON, year(begJob)::INTEGER, 'jobType_' || jobType FROM spolisbus WHERE year(begJob) BETWEEN 2005 AND 2015 AND jobType IS NOT NULL""",
    "spell_aggregate_first": """
WITH r AS (SELECT DISTINCT RINPERSOON, IKVID, contractType, begJob, endJob, nbHours FROM spolisbus WHERE RINPERSOON IS NOT NULL AND IKVID IS NOT NULL AND begJob IS NOT NULL),
j AS (SELECT RINPERSOON, IKVID, min(begJob) AS beg, max(endJob) AS "end", round(sum(nbHours), 4) AS hours,
             (list(contractType ORDER BY begJob, coalesce(endJob, DATE '9999-12-31'), coalesce(contractType, ''), coalesce(nbHours, -1)))[1] AS contractType FROM r GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY RINPERSOON ORDER BY beg, "end" DESC NULLS LAST, IKVID)::INTEGER AS job_no, count(*) OVER (PARTITION BY RINPERSOON) AS n_jobs FROM j""",
    "age_at_event": """
SELECT begJob, endJob, (begJob - DATE '1971-12-30')::INTEGER AS days, strftime(begJob + 30, '%Y-%m-%d') AS later,
       (year(endJob) - year(begJob - 9000) - (dayofyear(last_day(endJob + 1)) < dayofyear(begJob - 9000))::INTEGER)::INTEGER AS age, (endJob - begJob)::INTEGER AS length
FROM spolisbus WHERE begJob IS NOT NULL AND endJob IS NOT NULL AND year(endJob) < 3000""",
    "job_changes_by_year": """
SELECT year(DATE '1971-12-30' + daysSinceFirstEvent)::INTEGER AS year, count(DISTINCT RINPERSOON) AS n_persons FROM life_events
WHERE event_code LIKE 'JOB%' AND daysSinceFirstEvent BETWEEN 0 AND 17999 AND year(DATE '1971-12-30' + daysSinceFirstEvent) > 2010 GROUP BY 1""",
    "vocabulary": _V + "SELECT id, token, category FROM v",
    "token_person_counts": _E + """
SELECT token, count(DISTINCT person) AS n_persons FROM (SELECT person, t1 AS token FROM e UNION ALL SELECT person, t2 FROM e) GROUP BY 1 HAVING count(DISTINCT person) >= 20""",
    "encode_sequences": _T + f"""
SELECT person, string_agg(id, ',' ORDER BY pos) || repeat(',0', {LENGTH} - count(*)) AS input_ids, string_agg(abspos, ',' ORDER BY pos) AS abspos,
       string_agg(seg, ',' ORDER BY pos) AS segment, count(*)::INTEGER AS n_tokens FROM d GROUP BY 1""",
    "time_slice_min_events": _E + """
SELECT person, count(*) FILTER (days BETWEEN 9000 AND 14000)::INTEGER AS n_events FROM p GROUP BY 1
HAVING count(*) >= 5 AND count(*) FILTER (days BETWEEN 9000 AND 14000) >= 5""",
    "token_masking": _T + f""",
g AS (SELECT *, count(*) OVER (PARTITION BY person) AS length, pos > 0 AND id NOT IN (2, 4) AS legal FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY {_H.format("person || '-' || pos", "mask")}, pos) - 1 AS r, least(floor(length * 0.3), count(*) OVER (PARTITION BY person)) AS n FROM g WHERE legal)
SELECT person, pos::INTEGER AS pos, id AS target, CASE WHEN r < floor(n * 0.1) THEN id WHEN r >= n - floor(n * 0.1) THEN 5 + {_H.format("person || '-' || pos", "mask-token")} % ((SELECT count(*) FROM v) - 5) ELSE 3 END AS id
FROM r WHERE r < n""",
    "event_masking": _N + f""",
m AS (SELECT person, 2 * row_number() OVER (PARTITION BY person ORDER BY {_H.format("person || '-' || i", "event")}, i) / (2.0 * k) <= 0.3 AS masked FROM n)
SELECT person, count(*) FILTER (masked) AS n_masked, 2 * count(*) FILTER (masked) AS n_tokens, count(*) AS n_events FROM m GROUP BY 1""",
    "cls_permutation": _N + f""",
c AS (SELECT person, {UNIFORM.format("person", "cls")} AS u FROM b)
SELECT c.person, (CASE WHEN u < 0.05 THEN 1 WHEN u < 0.1 THEN 2 ELSE 0 END)::INTEGER AS target_cls,
       coalesce(string_agg(i, ',' ORDER BY CASE WHEN u < 0.05 THEN -i WHEN u < 0.1 THEN {_H.format("c.person || '-' || i", "cls")} ELSE i END, i), '') AS sentence_order
FROM c LEFT JOIN n USING (person) GROUP BY 1, 2""",
    "augmentation": _N + f"""
SELECT b.person, coalesce(sum(least(greatest(days + {_H.format("b.person || '-' || i", "noise")} % 11 - 5, 0), 17999)), 0)::BIGINT AS days_moved,
       count(*) FILTER ({_H.format("b.person || '-' || i", "resample-event")} / 4294967296.0 >= 0.25 + 0.25 * {_H.format("b.person", "resample")} / 4294967296.0)::INTEGER AS n_resampled
FROM b LEFT JOIN n USING (person) GROUP BY 1""",
    "train_val_test": f"""
SELECT person, CASE WHEN {UNIFORM.format("person", "123")} < 0.7 THEN 'train' WHEN {UNIFORM.format("person", "123")} < 0.85 THEN 'val' ELSE 'test' END AS split
FROM (SELECT DISTINCT rinpersoon AS person FROM person_background)""",
    "sampled_persons": _E + f""",
s AS (SELECT person, row_number() OVER (ORDER BY {_H.format("person", "1234")}, person) AS r, count(*) OVER () AS n FROM b)
SELECT person, count(*) AS n_rows FROM p JOIN s USING (person) WHERE r <= floor(n * 0.25) GROUP BY 1""",
    "bag_of_words": _E + """,
t AS (SELECT person, t1 AS token FROM p UNION ALL SELECT person, t2 FROM p)
SELECT person, token, round(count(*) / sum(count(*)) OVER (PARTITION BY person), 8) AS share FROM t GROUP BY 1, 2""",
}
