"""Life sequences: sentences of tokens per event, assembled per person, vocabularies and encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays
from ..functions.hashing import hash32
from .cleaning import fill_missing
from .ranking import global_order

PAD, CLS, SEP, MASK, UNK = "[PAD]", "[CLS]", "[SEP]", "[MASK]", "[UNK]"
GENERAL = (PAD, CLS, SEP, MASK, UNK)
MAX_LENGTH, MIN_EVENTS, MASK_RATIO = 512, 5, 0.3
#: Tokens of a vocabulary that a task may hold.
HELD_TOKENS = 1_000_000


def event_sentences(df: DataFrame, person: str, days: str, age: str, columns: Sequence[str], source: int) -> DataFrame:
    """``(person, days, age, source, sentence)``: one sentence of ``column_value`` tokens per event, missing values as ``MISSING``."""
    words = F.array(*[F.concat(F.lit(f"{c}_"), fill_missing(c)) for c in columns])
    return df.select(F.col(person).alias("person"), F.col(days).cast("int").alias("days"), F.col(age).cast("double").alias("age"), F.lit(source).alias("source"), words.alias("sentence"))


def life_sequences(events: DataFrame, background: DataFrame) -> DataFrame:
    """``(person, events)`` for every person of ``background``; ``events``: an array of ``(days, source, sentence, age)`` in time order.

    Events of others are left out before anything is gathered; a person without events has an empty array.
    Events without a day are left out. The array is as long as the person has events.
    """
    kept = events.filter("days IS NOT NULL").join(background.select("person").distinct(), "person", "left_semi")
    gathered = kept.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("days", "source", "sentence", "age"))).alias("events"))
    none = F.array().cast("array<struct<days:int,source:int,sentence:array<string>,age:double>>")
    return background.select("person").distinct().join(gathered, "person", "left").select("person", F.coalesce("events", none).alias("events"))


def segments(events: str | Column = "events") -> Column:
    """1 where an event has the day of the one before it, else 2."""
    e = F.col(events) if isinstance(events, str) else events
    before = F.concat(F.array(F.lit(None).cast("int")), F.transform(e, lambda x: x["days"]))
    return F.transform(e, lambda x, i: F.when(x["days"] == F.get(before, i), 1).otherwise(2))


def cyclic_segments(n: Column) -> Column:
    """2, 3, 1, 2, ... for n sentences."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(F.array(F.lit(2), F.lit(3), F.lit(1)), F.pmod(i, F.lit(3)).cast("int") + 1))


def slice_time(first: int, last: int, events: str = "events") -> Column:
    """Events from day ``first`` to ``last``, both included."""
    return F.filter(events, lambda x: x["days"].between(first, last))


def vocabulary(tokens: DataFrame, fixed: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """``(id, token, category)``: general tokens, the ``fixed`` ones, then ``tokens`` (``source, ordinal, token, category``) in their order.

    A token takes the place where it comes first. Ids are positions from 0.
    """
    spark = tokens.sparkSession
    head = [(-2, i, t, "GENERAL") for i, t in enumerate(GENERAL)] + [(-1, i, t, c) for i, (t, c) in enumerate(fixed)]
    given = spark.createDataFrame(head, "source int, ordinal int, token string, category string")
    first = given.unionByName(tokens.select("source", "ordinal", "token", "category")).groupBy("token").agg(F.min(F.struct("source", "ordinal", "category")).alias("f"))
    placed = first.select("f.source", "f.ordinal", "token", "f.category")
    return global_order(placed, "source", "ordinal", "token").select((F.col("position") - 1).alias("id"), "token", "category")


def token_persons(events: DataFrame, least: int = 1) -> DataFrame:
    """``(token, n_persons)`` from ``(person, sentence)``, tokens of fewer persons left out."""
    words = events.select("person", F.explode("sentence").alias("token")).distinct()
    return words.groupBy("token").agg(F.count("person").alias("n_persons")).filter(F.col("n_persons") >= least)


def truncated(events: Column, prefix_length: int, max_length: int = MAX_LENGTH) -> Column:
    """The most recent events whose sentences, each with its separator, fit behind the prefix below ``max_length``."""
    sizes = F.transform(events, lambda x: F.size(x["sentence"]) + 1)
    kept = arrays.keep_last_within(sizes, max_length - prefix_length)
    return F.slice(events, F.size(events) - kept + 1, kept)


def token_level(sequences: DataFrame, prefix: Column, prefix_length: int, max_length: int = MAX_LENGTH) -> DataFrame:
    """``(person, tokens, abspos, age, segment)``: prefix and sentences with their separators, positions repeated to the tokens."""
    cut = sequences.withColumn("events", truncated(F.col("events"), prefix_length, max_length))
    sizes = F.transform("events", lambda x: F.size(x["sentence"]) + 1)
    zeros = lambda v: F.array_repeat(F.lit(v), prefix_length)
    return cut.select(
        "person",
        F.concat(prefix, F.flatten(F.transform("events", lambda x: F.concat(x["sentence"], F.array(F.lit(SEP)))))).alias("tokens"),
        F.concat(zeros(0), arrays.repeat_each(F.transform("events", lambda x: x["days"]), sizes)).alias("abspos"),
        F.concat(zeros(0.0), arrays.repeat_each(F.transform("events", lambda x: x["age"]), sizes)).alias("age"),
        F.concat(zeros(0), arrays.repeat_each(segments("events"), sizes)).alias("segment"),
    )


def encode(tokens: DataFrame, vocab: DataFrame, unknown: int = GENERAL.index(UNK)) -> DataFrame:
    """``(person, pos, token, id)``: each token of each person with its id, those outside the vocabulary as ``unknown``."""
    words = tokens.select("person", F.posexplode("tokens").alias("pos", "token"))
    return words.join(vocab.select("id", "token"), "token", "left").select("person", "pos", "token", F.coalesce("id", F.lit(unknown)).cast("bigint").alias("id"))


def encoded_in_place(tokens: DataFrame, vocab: DataFrame, unknown: int = GENERAL.index(UNK), held: int = HELD_TOKENS) -> DataFrame:
    """``tokens`` with ``ids``: each person's tokens as ids of the vocabulary, without a shuffle.

    A vocabulary of at most ``held`` tokens travels in every task; a larger one is joined to the single tokens.
    """
    rows = vocab.select("token", "id").limit(held + 1).toArrow()
    if rows.num_rows > held:
        ids = encode(tokens, vocab, unknown).groupBy("person").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
        return tokens.join(ids.select("person", F.transform("x", lambda e: e["id"]).alias("ids")), "person")
    words, numbers = rows["token"].combine_chunks(), rows["id"].to_numpy()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            column = b.column("tokens")
            flat = pc.index_in(column.flatten(), value_set=words).fill_null(-1).to_numpy()
            ids = np.where(flat >= 0, numbers[flat], unknown) if len(numbers) else np.full(len(flat), unknown)
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64()))], [*b.schema.names, "ids"])

    schema = ", ".join(f"`{c}` {t}" for c, t in tokens.dtypes) + ", ids array<bigint>"
    return tokens.filter("tokens IS NOT NULL").mapInArrow(run, schema)


def padded_ids(encoded: DataFrame, length: int = MAX_LENGTH) -> DataFrame:
    """``(person, input_ids, padding_mask)`` of a fixed length; bounded by it, as sequences are cut before."""
    rows = encoded.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
    ids = F.transform("x", lambda e: e["id"])
    mask = F.concat(F.array_repeat(F.lit(1), F.size("x")), F.array_repeat(F.lit(0), length))
    return rows.select("person", arrays.pad_right(ids, length, 0).alias("input_ids"), F.slice(mask, 1, length).alias("padding_mask"))


def random_mask(encoded: DataFrame, n_vocab: int, seed: str = "mask", n_general: int = len(GENERAL), ratio: float = MASK_RATIO) -> DataFrame:
    """Mask ``floor(ratio * length)`` positions of each person: ``(person, pos, target, id)``.

    Legal are positions other than 0 without separator or unknown token; if there are fewer, all are chosen. By hash order the
    first tenth stays, the last tenth becomes a random token outside the general ones, the others become the mask.
    """
    by = W.partitionBy("person")
    legal = (F.col("pos") > 0) & ~F.col("id").isin(GENERAL.index(SEP), GENERAL.index(UNK))
    key = F.concat_ws("-", "person", "pos")
    ranked = encoded.withColumns({"length": F.count("*").over(by), "legal": legal}).filter("legal").withColumns(
        {"r": F.row_number().over(by.orderBy(hash32(key, seed), "pos")) - 1, "n": F.least(F.floor(F.col("length") * ratio), F.count("*").over(by))}
    ).filter("r < n")
    tenth = F.floor(F.col("n") * 0.1)
    other = F.lit(n_general) + F.pmod(hash32(key, seed + "-token"), F.lit(n_vocab - n_general))
    new = F.when(F.col("r") < tenth, F.col("id")).when(F.col("r") >= F.col("n") - tenth, other).otherwise(GENERAL.index(MASK))
    return ranked.select("person", "pos", F.col("id").alias("target"), new.cast("bigint").alias("id"))


def masked_events(sequences: DataFrame, share: float, seed: str = "event") -> DataFrame:
    """``(person, event_no, masked)``: events in hash order are masked while their tokens stay within ``share`` of all."""
    if not 0 < share < 1:
        raise ValueError("share has to lie between 0 and 1")
    e = sequences.select("person", F.posexplode("events").alias("event_no", "e")).select("person", "event_no", F.size("e.sentence").alias("n"))
    order = W.partitionBy("person").orderBy(hash32(F.concat_ws("-", "person", "event_no"), seed), "event_no")
    upto = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(W.partitionBy("person"))
    return e.select("person", "event_no", "n", (upto <= share).alias("masked"))


def permuted(sequences: DataFrame, seed: str = "cls") -> DataFrame:
    """``(person, target_cls, order)``: one person in twenty has its sentences reversed (1), another shuffled (2); positions stay where they are."""
    u = hash32("person", seed) / F.lit(4294967296.0)
    kind = F.when(u < 0.05, 1).when(u < 0.1, 2).otherwise(0)
    index = F.when(F.size("events") > 0, F.sequence(F.lit(0), F.size("events") - 1)).otherwise(F.array().cast("array<int>"))
    shuffled = F.transform(F.array_sort(F.transform(index, lambda i: F.struct(hash32(F.concat_ws("-", "person", i), seed).alias("h"), i.alias("i")))), lambda s: s["i"])
    return sequences.select("person", kind.alias("target_cls"), F.when(kind == 1, F.reverse(index)).when(kind == 2, shuffled).otherwise(index).alias("order"))


def time_noise(events: Column, person: str = "person", most: int = 5, last: int = 17999, seed: str = "noise") -> Column:
    """Each event moved by up to ``most`` days either way, kept within 0 and ``last``; a choice by hash."""
    moved = lambda x, i: F.least(F.greatest(x["days"] + (F.pmod(hash32(F.concat_ws("-", person, i), seed), F.lit(2 * most + 1)) - most).cast("int"), F.lit(0)), F.lit(last))
    return F.transform(events, moved)


def resampled(events: Column, person: str = "person", low: float = 0.25, high: float = 0.5, seed: str = "resample") -> Column:
    """Without a share of the events between ``low`` and ``high``, chosen per person; which ones is a choice by hash."""
    drop = low + (high - low) * hash32(person, seed) / F.lit(4294967296.0)
    return F.filter(events, lambda x, i: hash32(F.concat_ws("-", person, i), seed + "-event") / F.lit(4294967296.0) >= drop)


def split_by_hash(key: str, shares: Sequence[tuple[str, float]] = (("train", 0.7), ("val", 0.15), ("test", 0.15)), seed: str = "123") -> Column:
    """A split for each key, by hash."""
    u, upto, out = hash32(key, seed) / F.lit(4294967296.0), 0.0, None
    for name, share in shares[:-1]:
        upto = round(upto + share, 10)
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(shares[-1][0])


def sample_ids(df: DataFrame, key: str, share: float, seed: str = "1234") -> DataFrame:
    """``floor(n * share)`` of the distinct keys, the first by hash."""
    ids = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__h", hash32(key, seed))
    ranked = global_order(ids, "__h", key)
    total = ids.agg(F.count("*").alias("__n"))
    return ranked.join(F.broadcast(total)).filter(F.col("position") <= F.floor(F.col("__n") * share)).select(key)
