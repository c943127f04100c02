"""Prefixes, masks, targets and augmentations of encoded sequences.

Sequences are bounded by the context length, so a row is worked on as a whole; kernels run on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash32, uniform
from ..functions.strings import natural_parts
from .ranking import global_order
from .sequences import CLS, GENERAL, MASK, MASK_RATIO, MAX_LENGTH, SEP

#: Entry of targets beyond those there are.
NO_TARGET = -1


def prefix_tokens(*fields: str) -> Column:
    """``[CLS]``, the background's ``field_value`` tokens in order, ``[SEP]``; null values as ``MISSING``."""
    words = [F.concat(F.lit(f"{f}_"), F.coalesce(F.col(f).cast("string"), F.lit("MISSING"))) for f in fields]
    return F.array(F.lit(CLS), *words, F.lit(SEP))


def last_separators(tokens: Column, n: int, separator: str = SEP) -> Column:
    """Positions of the last n separators in order, on the left, 0 beyond those there are."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t == separator, i)), lambda i: i.isNotNull())
    last = F.slice(at, F.greatest(F.size(at) - n, F.lit(0)) + 1, n)
    return F.slice(F.concat(last, F.array_repeat(F.lit(0), n)), 1, n)


def sentence_boundaries(ids: np.ndarray, separator: int, ignore: Sequence[int] = ()) -> np.ndarray:
    """Where the prefix ends (-1 without one) and where each sentence has its separator.

    The prefix reaches to the last ignored id, and to a separator right behind it.
    """
    if not isinstance(ids, np.ndarray):
        raise TypeError("ids have to be an array")
    if not len(ids) or ids[-1] != separator:
        raise RuntimeError("a sequence has to end with a separator")
    ignored = np.flatnonzero(np.isin(ids, list(ignore)))
    first = int(ignored[-1]) if len(ignored) else -1
    if len(ignored) and first + 1 < len(ids) and ids[first + 1] == separator:
        first += 1
    ends = np.flatnonzero(ids == separator)
    return np.r_[first, ends[ends > first]]


def choose_sentences(ids: np.ndarray, boundaries: np.ndarray, share: float, order: np.ndarray) -> np.ndarray:
    """Sentences in the given order as long as their inner tokens stay within ``share`` of all; their numbers, ascending."""
    if not 0 < share < 1:
        raise ValueError("share has to lie between 0 and 1")
    inner = np.diff(boundaries)[order] - 1
    taken = int(np.searchsorted(np.cumsum(inner) / max(len(ids), 1), share + 1e-12, "right"))
    return np.sort(order[:taken])


def mask_sentences(ids: np.ndarray, boundaries: np.ndarray, chosen: Sequence[int], mask: int, target_length: int, fill_position: int = MAX_LENGTH - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ids with the inner tokens of chosen sentences masked, their positions, what stood there)``; targets padded to a length."""
    inner = [np.arange(boundaries[k] + 1, boundaries[k + 1]) for k in chosen]
    at = np.concatenate(inner).astype(np.int64) if inner else np.empty(0, np.int64)
    at = at[:target_length]
    masked = ids.copy()
    positions, tokens = np.full(target_length, fill_position, np.int64), np.zeros(target_length, np.int64)
    positions[: len(at)], tokens[: len(at)] = at, ids[at] if len(at) else []
    masked[at] = mask
    return masked, positions, tokens


def mask_events(coded: DataFrame, share: float = MASK_RATIO, prefix_length: int = 2, length: int = MAX_LENGTH, seed: str = "event") -> DataFrame:
    """``(person, ids, target_pos, target_tokens)`` from ``(person, ids)``: whole sentences masked, chosen in hash order while they stay within ``share``.

    Targets are padded to ``floor(share * length)`` with the last position and ``NO_TARGET``. A sequence without a sentence has none masked.
    """
    import hashlib

    most = int(share * length)
    if not 0 < share < 1:
        raise ValueError("share has to lie between 0 and 1")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for person, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.asarray(ids or [], np.int64)
                ends = np.flatnonzero(x == GENERAL.index(SEP))
                bounds = np.r_[prefix_length - 1, ends[ends >= prefix_length]]
                keys = [int(hashlib.md5(f"{person}-{k}:{seed}".encode()).hexdigest()[:8], 16) for k in range(len(bounds) - 1)]
                chosen = choose_sentences(x, bounds, share, np.argsort(keys, kind="stable").astype(np.int64)) if keys else []
                masked, pos, tok = mask_sentences(x, bounds, chosen, GENERAL.index(MASK), most, length - 1)
                n = int(sum(bounds[k + 1] - bounds[k] - 1 for k in chosen))
                tok[n:] = NO_TARGET
                out.append((person, masked.tolist(), pos.tolist(), tok.tolist()))
            cols = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["person", "ids", "target_pos", "target_tokens"])

    return coded.select("person", "ids").mapInArrow(run, "person long, ids array<long>, target_pos array<long>, target_tokens array<long>")


def padded_targets(masks: DataFrame, length: int = MAX_LENGTH, ratio: float = MASK_RATIO) -> DataFrame:
    """``(person, target_pos, target_tokens)`` from ``(person, pos, target)``: in order, padded to ``floor(ratio * length)`` with the last position and token 0."""
    most = int(ratio * length)
    rows = masks.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("pos", "target"))).alias("x"))
    fill = lambda f, v: F.slice(F.concat(F.transform("x", lambda e: e[f].cast("bigint")), F.array_repeat(F.lit(v).cast("bigint"), most)), 1, most)
    return rows.select("person", fill("pos", length - 1).alias("target_pos"), fill("target", 0).alias("target_tokens"))


def decoded_targets(masked: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(person, pos, token)`` of the targets there are."""
    pairs = masked.select("person", F.inline(F.arrays_zip("target_pos", "target_tokens"))).filter(F.col("target_tokens") != NO_TARGET)
    return pairs.join(vocab.select("id", "token"), pairs["target_tokens"] == F.col("id")).select("person", F.col("target_pos").cast("int").alias("pos"), "token")


def category_ranges(vocab: DataFrame) -> DataFrame:
    """``(category, first, n)``: ids of a category follow each other."""
    return vocab.groupBy("category").agg(F.min("id").alias("first"), F.count("*").alias("n"))


def smart_random(masks: DataFrame, vocab: DataFrame, seed: str = "mask") -> DataFrame:
    """Masks ``(person, pos, target, id)`` whose random tokens are of the target's own category."""
    of = vocab.select(F.col("id").alias("target"), "category").join(F.broadcast(category_ranges(vocab).filter("category IS NOT NULL")), "category")
    key = F.concat_ws("-", "person", "pos")
    drawn = F.col("first") + F.pmod(hash32(key, seed + "-token"), F.col("n"))
    is_random = (F.col("id") != F.col("target")) & (F.col("id") != GENERAL.index(MASK))
    return masks.join(of, "target", "left").select("person", "pos", "target", F.when(is_random & F.col("first").isNotNull(), drawn).otherwise(F.col("id")).alias("id"))


def first_after(events: Column, day: int) -> Column:
    """The number of the first event on or after a day, -1 if there is none."""
    return F.array_position(F.transform(events, lambda e: e["days"] >= day), True).cast("int") - 1


def clipped_from_end(sizes: Column, budget: int) -> Column:
    """How many of the last elements there are before their sizes first sum to more than ``budget``; the prefix isn't counted."""
    state = F.aggregate(
        F.reverse(sizes),
        F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("kept"), F.lit(True).alias("open")),
        lambda s, x: F.when(s["open"] & (s["total"] + x <= budget), F.struct((s["total"] + x).cast("bigint").alias("total"), (s["kept"] + 1).alias("kept"), F.lit(True).alias("open"))).otherwise(
            F.struct(s["total"].alias("total"), s["kept"].alias("kept"), F.lit(False).alias("open"))
        ),
    )
    return state["kept"]


def without_tokens(events: Column, person: str = "person", share: float = 0.1, seed: str = "drop") -> Column:
    """Events whose sentences have lost a share of their tokens; which ones is a choice by hash of person, event and place."""
    lost = lambda i, k: uniform(F.concat_ws("-", person, i, k), seed) < share
    kept = lambda e, i: F.filter(e["sentence"], lambda t, k: ~lost(i, k))
    return F.transform(events, lambda e, i: F.struct(e["days"].alias("days"), e["source"].alias("source"), kept(e, i).alias("sentence"), e["age"].alias("age")))


def aligned(events: Column, day: int) -> Column:
    """Days counted from the first event on or after ``day``; as they are if there is none."""
    at = first_after(events, day)
    start = F.when(at >= 0, F.get(events, at)["days"]).otherwise(0)
    return F.transform(events, lambda e: e["days"] - start)


def cut_in_time(events: Column, person: str = "person", least: int = 12, seed: str = "cut") -> Column:
    """Of more than ``least`` events those up to a random one and all of its day; fewer stay."""
    n = F.size(events)
    at = least + F.pmod(hash32(person, seed), F.greatest(n - least, F.lit(1))).cast("int") - 1
    last = F.get(events, at)["days"]
    return F.when(n > least, F.filter(events, lambda e: e["days"] <= last)).otherwise(events)


def hidden(value: Column, person: str = "person", share: float = 0.2, seed: str = "hide") -> Column:
    """The background, hidden for a share of persons."""
    return F.when(uniform(person, seed) >= share, value)


def pooled(vectors: Column, mask: Column, width: int) -> tuple[Column, Column]:
    """Mean of the token vectors where the mask is 1 (of at least one), and the first token's vector."""
    n = F.greatest(F.aggregate(mask, F.lit(0), lambda s, x: s + x), F.lit(1))
    used = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(used, F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / n), F.get(vectors, F.lit(0))


def corpus_vocabulary(tokens: DataFrame, years: tuple[int, int] = (1946, 1991), least: int = 1000) -> DataFrame:
    """``(id, token, category)``: general tokens, months, years, then tokens of at least ``least`` rows in natural order (C2 before C10), ids from 0."""
    spark = tokens.sparkSession
    fixed = [(t, "GENERAL") for t in GENERAL] + [(f"MONTH_{m}", "MONTH") for m in range(1, 13)] + [(f"YEAR_{y}", "YEAR") for y in range(years[0], years[1] + 1)]
    head = spark.createDataFrame([(-1, "", k, t, c) for k, (t, c) in enumerate(fixed)], "part int, text string, number bigint, token string, category string")
    frequent = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("category").alias("category")).filter(F.col("n") >= least)
    text, number = natural_parts("token")
    rest = frequent.select(F.lit(0).alias("part"), text.alias("text"), number.alias("number"), "token", "category").join(head.select("token"), "token", "left_anti")
    return global_order(head.unionByName(rest), "part", "text", "number", "token").select((F.col("position") - 1).alias("id"), "token", "category")


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """As parquet, or as one CSV file in order of ids where the path says so."""
    if path.endswith(".csv"):
        vocab.coalesce(1).sortWithinPartitions("id").write.mode("overwrite").option("header", True).csv(path)
    else:
        vocab.write.mode("overwrite").parquet(path)


def load_vocabulary(spark, path: str) -> DataFrame:
    df = spark.read.option("header", True).schema("id bigint, token string, category string").csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return df.select("id", "token", "category")


def corpus_sentences(sources: Sequence[DataFrame], population: DataFrame, threshold: int, reference: int = 0) -> DataFrame:
    """``(person, days, age, sentence, after_threshold, ...)``: sentences of all sources with the person's attributes.

    ``sources``: ``(person, days, age, sentence)``; ``population``: ``(person, birth_day, ...)``. An age that is missing comes from days and
    birth day; days count from ``reference``. Persons outside the population are left out.
    """
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    met = rows.join(population, "person")
    age = F.coalesce(F.col("age"), F.floor((F.col("days") - F.col("birth_day")) / 365.25)).cast("int")
    others = [c for c in population.columns if c not in ("person", "birth_day")]
    return met.select("person", (F.col("days") - reference).alias("days"), age.alias("age"), "sentence", (F.col("days") >= threshold).cast("int").alias("after_threshold"), *others)


def split_then_labels(coded: DataFrame, labels: DataFrame, n_val: int) -> DataFrame:
    """Encoded sequences with labels: the split is by position among all sequences, then those without a label drop out."""
    placed = global_order(coded.select("person"), "person").select("person", F.when(F.col("position") <= n_val, "val").otherwise("train").alias("split"))
    return coded.join(placed, "person").join(labels, "person")


def sentences_shuffled(events: Column, person: str = "person", seed: str = "shuffle") -> Column:
    """Numbers of the events in a random order by hash; only events of one day change places."""
    index = F.transform(events, lambda e, i: F.struct(e["days"].alias("d"), hash32(F.concat_ws("-", person, i), seed).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(index), lambda s: s["i"])


