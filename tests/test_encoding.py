import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import encoding as en, sequences as sq

A = np.array
EVENTS = "array<struct<days:int,source:int,sentence:array<string>,age:double>>"


def test_boundaries():
    assert en.sentence_boundaries(A([1, 2, 3, 4, 5, 6, 7, 5, 8, 9, 5]), 5, [1, 2, 3]).tolist() == [2, 4, 7, 10]
    assert en.sentence_boundaries(A([1, 2, 3, 4, 5, 6, 7, 5, 8, 9, 5]), 5, [1, 2, 3])[0] == 2
    for ids in ([1, 5, 2, 3, 4, 5, 6, 7, 5], [5, 1, 2, 3, 4, 5, 6, 7, 5]):
        assert en.sentence_boundaries(A(ids), 5, [1]).tolist() == [1, 5, 8]
    assert en.sentence_boundaries(A([1, 2, 3, 5, 8, 2, 5, 10, 15, 3, 5]), 5).tolist() == [-1, 3, 6, 10]
    with pytest.raises(TypeError):
        en.sentence_boundaries([1, 2, 5], 5)
    with pytest.raises(RuntimeError):
        en.sentence_boundaries(A([1, 5, 2]), 5)


def test_choice_of_sentences():
    ids = A([1, 2, 3, 5, 6, 7, 5, 8, 9, 5])
    b = en.sentence_boundaries(ids, 5, [1])
    order = np.arange(3)
    assert en.choose_sentences(ids, b, 0.99, order).tolist() == [0, 1, 2] and en.choose_sentences(ids, b, 0.1, order).tolist() == []
    ids = A([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 5])
    b = en.sentence_boundaries(ids, 5, [1])
    for order in ([0, 1], [1, 0]):
        assert len(en.choose_sentences(ids, b, 0.5, A(order))) >= 1
    ids = A([1, 2, 3, 4, 5])
    assert len(en.choose_sentences(ids, en.sentence_boundaries(ids, 5, [1]), 0.5, A([0]))) == 0
    for share in (0, 1):
        with pytest.raises(ValueError):
            en.choose_sentences(ids, A([0, 4]), share, A([0]))


def test_masks_and_targets():
    ids, b = A([1, 2, 3, 5, 8, 2, 5, 10, 15, 3, 5]), A([-1, 3, 6, 10])
    x, pos, tok = en.mask_sentences(ids, b, [1], 99, 10)
    assert x.tolist() == [1, 2, 3, 5, 99, 99, 5, 10, 15, 3, 5] and pos.tolist() == [4, 5] + [511] * 8 and tok.tolist() == [8, 2] + [0] * 8
    x, pos, tok = en.mask_sentences(ids, b, [0, 2], 99, 10)
    assert x.tolist() == [99, 99, 99, 5, 8, 2, 5, 99, 99, 99, 5] and pos.tolist() == [0, 1, 2, 7, 8, 9] + [511] * 4 and tok.tolist() == [1, 2, 3, 10, 15, 3] + [0] * 4
    x, pos, tok = en.mask_sentences(A([1, 2, 3, 4, 5]), A([0, 4]), [], 99, 10)
    assert x.tolist() == [1, 2, 3, 4, 5] and pos.tolist() == [511] * 10 and tok.tolist() == [0] * 10
    x, pos, tok = en.mask_sentences(A([1, 2, 3, 4, 2, 5]), A([0, 5]), [0], 99, 10)
    assert x.tolist() == [1, 99, 99, 99, 99, 5] and pos.tolist() == [1, 2, 3, 4] + [511] * 6 and tok.tolist() == [2, 3, 4, 2] + [0] * 6
    assert len(en.mask_sentences(A([], dtype=int), A([-1]), [], 99, 10)[1]) == 10


def test_masks_of_empty_and_short_sequences(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None), (4, [1, 2, 7, 8, 2, 9, 9, 2])], "person long, ids array<long>")
    got = {r["person"]: r for r in en.mask_events(df, 0.3).collect()}
    assert all(len(r["target_pos"]) == 153 for r in got.values())
    assert got[1]["ids"] == [1, 2] and got[2]["ids"] == [] and got[3]["ids"] == [] and set(got[1]["target_tokens"]) == {-1}
    assert got[4]["ids"].count(3) == 2
    with pytest.raises(ValueError):
        en.mask_events(df, 1.0)


def test_augmentations_of_nothing(spark):
    df = spark.createDataFrame([(1, [])], f"person long, events {EVENTS}")
    e = F.col("events")
    r = df.select(en.first_after(e, 3), en.aligned(e, 3), en.cut_in_time(e), en.without_tokens(e), en.sentences_shuffled(e), en.clipped_from_end(F.transform(e, lambda x: F.size(x["sentence"])), 3)).first()
    assert list(r) == [-1, [], [], [], [], 0]
    assert en.last_separators(F.array(F.lit("a")), 2) is not None


def test_clip_stops_at_the_first_overflow(spark):
    r = spark.range(1).select(en.clipped_from_end(F.array(F.lit(1), F.lit(9), F.lit(2), F.lit(2)), 5).alias("n")).first()
    assert r["n"] == 2


def test_vocabulary_round_trip_and_large_vocabularies(spark, tmp_path):
    tokens = spark.createDataFrame([("C10", "c")] * 3 + [("C2", "c")] * 3 + [("B", "c")], "token string, category string")
    v = en.corpus_vocabulary(tokens, least=2)
    rows = [tuple(r) for r in v.orderBy("id").collect()]
    assert [r[1] for r in rows[-2:]] == ["C2", "C10"] and rows[5][1] == "MONTH_1" and len(rows) == 5 + 12 + 46 + 2
    for name in ("v.parquet", "v.csv"):
        en.save_vocabulary(v, f"file://{tmp_path}/{name}")
        assert [tuple(r) for r in en.load_vocabulary(spark, f"file://{tmp_path}/{name}").orderBy("id").collect()] == rows
    seq = spark.createDataFrame([(1, ["C2", "what", "C10"]), (2, ["B"])], "person long, tokens array<string>")
    here, joined = (sorted((r["person"], tuple(r["ids"])) for r in sq.encoded_in_place(seq, v, held=n).collect()) for n in (10**6, 3))
    assert here == joined == [(1, (63, 4, 64)), (2, (4,))]
