"""Evaluation passages inside training texts (problem 9).

Texts become sequences of words (for languages written without spaces: of letters). Each window of a fixed
number of symbols, of a document as of a test item, goes through the CGK random walk, which turns edit distance
into Hamming distance: a pointer runs over the window and, at each of three times as many steps, writes the
symbol it stands at and advances or stays as a random function of step and symbol says. Keys of sampled
positions of what was written bring windows together, and the exact edit distance decides.

Equal windows have equal keys in every table, so a passage that a document holds word for word is never missed;
a pair of windows with an edit meets in one of the tables with probability RECALL at least, and an altered passage is
found through any of its many windows.

Two windows within MAX_EDIT edits have a run of symbols in common (half a window). A window of a document that has no run of any
item's windows is near none of them, so it needs no walk. Windows travel only where a bit map of the items' keys lets them through. Both maps,
of runs and of keys, have a fixed size whatever the number of items. Equal windows of documents, and of items, stand for one while windows are compared.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame, functions as F

from ..session import Stage

#: Symbols of a window: words, and letters or digits for the languages in LETTER_LANGUAGES.
WORDS, LETTERS = 12, 20
LETTER_LANGUAGES = ("zh",)
#: Largest edit distance of two windows that count as the same passage, altered. Which halves of them then agree (in :func:`leaks`) is so for 1 only.
MAX_EDIT = 1
#: Share of the pairs of windows within MAX_EDIT that meet in a table, at least, for symbols changed, put in and left out. What
#: follows from it (test_keys_reach_the_stated_recall): independent walks, tables of keys for each, positions sampled for a key.
RECALL = 0.98
WALKS, TABLES, SAMPLED = 8, 4, 6
#: The same where only equal windows are sought: they agree in every table, so one is enough.
EXACT = (1, 1, 20)
#: Bits (as a power of 2) of the maps of item runs and keys by which a task drops other windows before walk and shuffle. More of them than that only let more through.
MAP_BITS = 26
#: Parts of the rows of one window, so that a passage in a share of all documents meets its items in many tasks.
SALTS = 16
#: Characters that are embedded at once.
CHUNK = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile("[㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_PAD = np.uint64(0x243F6A8885A308D3)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Compatibility forms undone; without case, accents and format characters."""
    if text.isascii():
        return text.lower()
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return "".join(c for c in folded if c.isascii() or unicodedata.category(c) not in ("Mn", "Me", "Cf"))


def symbols(text: str, letters: bool) -> list[str]:
    words = _WORD.findall(plain(text))
    return list("".join(words)) if letters else words


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MULTIPLY
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def cgk_keys(sym: np.ndarray, starts: np.ndarray, width: int, walks: int = WALKS, tables: int = TABLES, sampled: int = SAMPLED, seed: int = 17) -> np.ndarray:
    """A key for each walk, table and window; ``sym``: hashed symbols, ``starts``: where windows begin.

    Each sampled position is from another stretch of the first two thirds of the steps, within which most walks end, so that
    keys depend on symbols all over the window.
    """
    walk = np.r_[sym, _PAD]
    end, pad = starts.astype(np.int64) + width, len(sym)
    keys = np.empty((walks * tables, len(starts)), np.uint64)
    for t in range(len(keys)):
        keys[t] = np.uint64(t + 1)
    bounds = np.linspace(0, 2 * width, sampled + 1).astype(int)
    with np.errstate(over="ignore"):
        for w in range(walks):
            rng = np.random.default_rng([seed + width, w])
            bits = _mix(walk ^ np.uint64(rng.integers(1 << 62)))
            samples = {t: {int(rng.integers(x, y)) for x, y in zip(bounds, bounds[1:])} for t in range(w * tables, (w + 1) * tables)}
            at = starts.astype(np.int64)
            for j in range(max(map(max, samples.values())) + 1):
                here = np.where(at < end, at, pad)
                used = [t for t in samples if j in samples[t]]
                if used:
                    symbol = walk[here]
                    for t in used:
                        keys[t] = _mix(keys[t] ^ symbol)
                at = at + ((bits[here] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return keys


def run_keys(sym: np.ndarray, width: int) -> np.ndarray:
    """A key for each run of symbols as long as two windows within MAX_EDIT edits have in common: at least ``width - MAX_EDIT`` symbols of
    one are symbols of the other, in at most MAX_EDIT + 1 runs."""
    length = run_length(width)
    keys = np.full(max(len(sym) - length + 1, 0), width, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            keys = _mix(keys ^ sym[j : j + len(keys)])
    return keys


def run_length(width: int) -> int:
    return -(-(width - MAX_EDIT) // (MAX_EDIT + 1))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int = MAX_EDIT, open_end: bool = False) -> np.ndarray:
    """Edit distance of each pair of rows, ``most + 1`` standing for more.

    ``open_end``: the last symbol of either row may be left out, as a symbol put in or left out within a window moves
    another one over its end.
    """
    n, width = a.shape if len(a) else (0, 0)
    big = most + 1
    before = np.full((n, 2 * most + 1), big, np.int8)  # cell d: row i, column i + d - most
    for d in range(most, 2 * most + 1):
        before[:, d] = d - most
    for i in range(1, width + 1):
        now = np.full_like(before, big)
        for d in range(2 * most + 1):
            j = i + d - most
            if j < 0 or j > width:
                continue
            best = np.full(n, i if j == 0 else big, np.int8)
            if j > 0:
                best = np.minimum(best, before[:, d] + (a[:, i - 1] != b[:, j - 1]))
                if d > 0:
                    best = np.minimum(best, now[:, d - 1] + 1)
            if d < 2 * most:
                best = np.minimum(best, before[:, d + 1] + 1)
            now[:, d] = np.minimum(best, big)
        last, before = before, now
    if not width:
        return np.zeros(n, np.int8)
    return np.minimum(before[:, most], np.minimum(before[:, most - 1], last[:, most + 1])) if open_end else before[:, most]


def _windows(ids: Sequence, texts: Sequence[str], letters: bool, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashed symbols, window starts, row of each window)``."""
    lists = [symbols(t, letters) for t in texts]
    lengths = np.array([len(x) for x in lists], np.int64)
    flat = [s for x in lists for s in x]
    if not flat:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    sym = pd.util.hash_array(unique.astype(object), categorize=False).astype(np.uint64)[codes]
    begin = np.cumsum(lengths) - lengths
    many = np.maximum(lengths - width + 1, 0)
    row = np.repeat(np.arange(len(lists)), many)
    start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + begin[row]
    return sym, start, row


_COMMON = "letters boolean, id long, window binary, r0 long, r1 long, r2 long, hits array<struct<tbl:int,key:long>>"
ITEM_ROW, DOC_ROW = f"{_COMMON}, han int", f"{_COMMON}, pos int"


def _han(text: str) -> bool:
    return not text.isascii() and bool(_HAN.search(text))


def _groups(texts: list) -> Iterator[list[int]]:
    """Rows with a text, in lots of bounded size."""
    rows, size = [], 0
    for k, text in enumerate(texts):
        if text:
            rows.append(k)
            size += len(text)
            if size > CHUNK:
                yield rows
                rows, size = [], 0
    yield rows


def _contents(sym: np.ndarray, starts: np.ndarray, width: int) -> pa.Array:
    content = np.ascontiguousarray(sym[starts[:, None] + np.arange(width)])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.arange(len(starts) + 1, dtype=np.int32) * width * 8), pa.py_buffer(content)])


def _batch(letters: bool, width: int, ids: np.ndarray, sym: np.ndarray, starts: np.ndarray, runs: np.ndarray, keys: np.ndarray, hit: np.ndarray, last: str, values: np.ndarray) -> pa.RecordBatch:
    """Windows with the runs at their start, one symbol before their end and at their end, and those of their keys (table, window) that ``hit`` (window, table) names."""
    r, t = np.nonzero(hit)
    hits = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(r, np.arange(len(starts) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(t.astype(np.int32)), pa.array(keys[t, r].view(np.int64))], ["tbl", "key"])
    )
    tail = starts + width - run_length(width)
    at = [pa.array(runs[x].view(np.int64)) for x in (starts, tail - 1, tail)]
    columns = [pa.array(np.full(len(starts), letters)), pa.array(ids.astype(np.int64)), _contents(sym, starts, width), *at, hits, pa.array(values.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["letters", "id", "window", "r0", "r1", "r2", "hits", last])


def _item_windows(batches: Iterator[pa.RecordBatch], plan: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """A row for each window, with its keys of all tables. ``han``: Han letters in a window of letters."""
    for batch in batches:
        ids, texts, kinds = (batch.column(k).to_pylist() for k in range(3))
        for rows in _groups(texts):
            for letters, width in ((False, WORDS), (True, LETTERS)):
                own = [k for k in rows if kinds[k] == letters]
                sym, start, row = _windows([ids[k] for k in own], [texts[k] for k in own], letters, width)
                if not len(start):
                    continue
                han = np.zeros(len(start), np.int32)
                if letters:
                    flat = np.array([bool(_HAN.match(c)) for k in own for c in symbols(texts[k], True)], np.int32)
                    upto = np.r_[0, np.cumsum(flat)]
                    han = (upto[start + width] - upto[start]).astype(np.int32)
                runs, of = run_keys(sym, width), np.array([ids[k] for k in own], np.int64)[row]
                for a in range(0, len(start), 20_000):
                    part = slice(a, a + 20_000)
                    keys = cgk_keys(sym, start[part], width, *plan)
                    yield _batch(letters, width, of[part], sym, start[part], runs, keys, np.ones(keys.T.shape, bool), "han", han[part])


def _item_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the runs in windows of items."""
    for batch in batches:
        texts, kinds = (batch.column(k).to_pylist() for k in (1, 2))
        for rows in _groups(texts):
            for letters, width in ((False, WORDS), (True, LETTERS)):
                own = [texts[k] for k in rows if kinds[k] == letters]
                sym, start, _ = _windows(own, own, letters, width)
                if len(start):
                    inside = np.unique(start[:, None] + np.arange(width - run_length(width) + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(run_keys(sym, width)[inside]).view(np.int64))], ["key"])


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the map for each key."""
    mask = np.uint64((1 << MAP_BITS) - 1)
    return (keys >> np.uint64(5)) & mask, (keys >> np.uint64(37)) & mask


def _key_map(keys: DataFrame) -> np.ndarray:
    """The bit map of ``(key)``. Bits are joined to words of 64 before they come to the driver: at most 2 ** (MAP_BITS - 6) rows."""
    mask = F.lit((1 << MAP_BITS) - 1)
    places = F.explode(F.array(F.shiftrightunsigned("key", 5).bitwiseAND(mask), F.shiftrightunsigned("key", 37).bitwiseAND(mask)))
    words = keys.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("bits")).toArrow()
    held = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    held[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return held


def _held(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for p in _places(keys):
        out &= (held[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return out


def _with_runs(held: np.ndarray, runs: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the windows in which a run of some item's window occurs; ``runs``: of the text, ``held``: the map of those of items."""
    upto = np.r_[0, np.cumsum(_held(held, runs))]
    return np.flatnonzero(upto[starts + width - run_length(width) + 1] > upto[starts])


def _doc_windows(batches: Iterator[pa.RecordBatch], held_runs: np.ndarray, held: np.ndarray, any_letters: bool, plain_letters: bool, plan: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """One row for each window with a run in the map ``held_runs`` and a key in the map ``held``, with those keys.

    ``any_letters``: items are searched by letters at all; ``plain_letters``: some window of theirs has so few Han letters that a text without any could come near it.
    """
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for rows in _groups(texts):
            for letters, width in ((False, WORDS), (True, LETTERS)):
                own = [k for k in rows if not letters or (any_letters and (plain_letters or _han(plain(texts[k]))))]
                sym, start, row = _windows(own, [texts[k] for k in own], letters, width)
                if not len(start):
                    continue
                first = np.searchsorted(row, row, "left")
                runs = run_keys(sym, width)
                met = _with_runs(held_runs, runs, start, width)
                for a in range(0, len(met), 200_000):
                    part = met[a : a + 200_000]
                    keys = cgk_keys(sym, start[part], width, *plan)
                    hit = np.stack([_held(held, k) for k in keys], 1)
                    w = np.flatnonzero(hit.any(1))
                    for b in range(0, len(w), 20_000):
                        k = w[b : b + 20_000]
                        own_ids, pos = ids[np.array(own)[row[part[k]]]], part[k] - first[part[k]]
                        yield _batch(letters, width, own_ids, sym, start[part[k]], runs, keys[:, k], hit[k], "pos", pos)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for letters, width in ((False, WORDS), (True, LETTERS)):
            part = pa.Table.from_batches([batch]).filter(pa.compute.equal(batch.column("letters"), letters)).combine_chunks()
            if part.num_rows:
                d = edit_distance(_rows(part["w1"], width), _rows(part["w2"], width), open_end=True)
                kept = part.append_column("distance", pa.array(d.astype(np.int32))).filter(pa.array(d <= MAX_EDIT))
                yield from kept.to_batches()


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", lang: str = "lang", exact: bool = False) -> DataFrame:
    """``(doc_id, item_id, windows, exact_windows, first_window)``: items of which a document holds a passage.

    ``windows``: windows of the document within MAX_EDIT edits of one of the item, whose last symbol may be missing; ``exact_windows``: those that are equal to
    one, so at least one means a run of WORDS words (LETTERS letters or digits for items in LETTER_LANGUAGES, whatever stands between
    them); ``first_window``: the symbol at which the first begins. Compared after :func:`plain`. Whole texts are
    searched; by letters where an item told by letters could be met: a text without Han letters is left out only if every window of such
    items has more than MAX_EDIT of them. Null, empty and blank texts hold nothing, an item shorter than a window can't be held; rows without
    an id are left out. ``exact``: only equal windows are sought, at a fraction of the cost. Repeated texts are each reported. Empty tables give no rows.
    """
    plan = EXACT if exact else (WALKS, TABLES, SAMPLED)
    by_letters = F.coalesce(F.lower(F.col(lang)).isin(list(LETTER_LANGUAGES)), F.lit(False))
    item_rows = items.filter(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("id"), F.col(text).alias("text"), by_letters.alias("letters")).distinct()
    windows = Stage(item_rows.mapInArrow(lambda b: _item_windows(b, plan), ITEM_ROW), "items").df
    told = windows.filter("letters").agg(F.count("*").alias("n"), F.min("han").alias("han")).first()
    send = items.sparkSession.sparkContext.broadcast
    held, runs = send(_key_map(windows.select(F.explode("hits.key").alias("key")))), send(_key_map(item_rows.mapInArrow(_item_runs, "key long")))
    any_letters, plain_letters = told["n"] > 0, told["n"] > 0 and told["han"] <= (0 if exact else MAX_EDIT + 1)
    doc_rows = documents.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    found = Stage(doc_rows.mapInArrow(lambda b: _doc_windows(b, runs.value, held.value, any_letters, plain_letters, plan), DOC_ROW), "windows").df
    # each window of documents once, each of items once, told by its two halves until the edit check
    own, theirs = (df.select("letters", *[F.col(f"r{k}").alias(f"{c}{k}") for k in range(3)], F.inline("hits")).distinct() for df, c in ((found, "a"), (windows, "b")))
    met = own.join(theirs, ["letters", "tbl", "key"]).filter("a0 = b0 or a2 = b2 or a1 = b2 or a2 = b1").select("letters", "a0", "a2", "b0", "b2").distinct()
    full1, full2 = (df.select("letters", F.col("r0").alias(f"{c}0"), F.col("r2").alias(f"{c}2"), F.col("window").alias(w)).distinct() for df, c, w in ((found, "a", "w1"), (windows, "b", "w2")))
    pairs = met.join(full1, ["letters", "a0", "a2"]).join(full2, ["letters", "b0", "b2"]).select("letters", "w1", "w2")
    near = pairs.mapInArrow(_verify, "letters boolean, w1 binary, w2 binary, distance int")
    near = near.filter("distance = 0") if exact else near
    held_by = windows.select("letters", F.col("id").alias("item_id"), F.col("window").alias("w2")).distinct()
    answers = near.join(held_by, ["letters", "w2"]).groupBy("letters", "w1", "item_id").agg(F.min("distance").alias("distance"))
    spread = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = found.select("letters", F.col("window").alias("w1"), F.col("id").alias("doc_id"), "pos").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    once = places.join(spread, ["letters", "w1", "salt"]).groupBy("doc_id", "item_id", "letters", "pos").agg(F.min("distance").alias("distance"))
    return once.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("windows"), F.sum((F.col("distance") == 0).cast("long")).alias("exact_windows"), F.min("pos").alias("first_window")
    )
