import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import arrays
from cohortspark.operators import cleaning, evaluation, graph, labels, ranking, sequences
from cohortspark.sources import files


def test_percentile_buckets_equal_pandas(spark):
    rng = random.Random(1)
    values = [float(rng.randrange(40)) for _ in range(500)] + [None] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    got = {r["id"]: r["b"] for r in ranking.percentile_buckets(df, "v", "b").collect()}
    s = pd.Series(values[:500])
    want = np.minimum(np.floor(s.rank() / 500 * 100), 99)
    assert [got[i] for i in range(500)] == want.tolist() and got[500] is None


def test_top_or_other_and_labels(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), (None,)], "x string")
    got = {r["x"]: r["n"] for r in cleaning.top_or_other(df, "x", 2).groupBy("x").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 3, "b": 2, "Others": 1, "MISSING": 1}
    one = spark.createDataFrame([("{1: 'yes', 2: 'no'}", 1.0), ("{}", 0.0), (None, 3.0)], "l string, v double")
    out = [r[0] for r in one.select(cleaning.substitute_special("v", cleaning.parse_labels("l"), F.lit(True))).collect()]
    assert out == ["yes", "SPECIAL_NUMERIC_ZERO", "3"]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_event_masking_edges(spark):
    seq = spark.createDataFrame([(1, [(1, 0, ["a", "b"], 1.0), (2, 0, ["c", "d"], 1.0)]), (2, [])], "person long, events array<struct<days:int,source:int,sentence:array<string>,age:double>>")
    assert sequences.masked_events(seq, 0.99).filter("masked").count() == 1
    assert sequences.masked_events(seq, 0.1).filter("masked").count() == 0
    with pytest.raises(ValueError):
        sequences.masked_events(seq, 1)
    assert [r["s"] for r in seq.orderBy("person").select(sequences.segments("events").alias("s")).collect()] == [[2, 2], []]


def test_truncation_keeps_the_most_recent(spark):
    seq = spark.createDataFrame([(1, [(d, 0, ["x"] * 3, 1.0) for d in range(5)])], "person long, events array<struct<days:int,source:int,sentence:array<string>,age:double>>")
    kept = seq.select(sequences.truncated(F.col("events"), 2, 11).alias("e")).first()["e"]
    assert [x["days"] for x in kept] == [3, 4]


def test_transforms_return(spark):
    df = spark.createDataFrame([(x,) for x in (-1e9, -10.0, 0.0, 10.0, 1e9)], "income double")
    one = df.agg(F.avg("income").alias("m"), F.stddev_pop("income").alias("s"), F.min("income").alias("lo"), F.max("income").alias("hi"))
    for there, back in labels.transforms("income", F.col("m"), F.col("s"), F.col("lo"), F.col("hi")).values():
        got = df.crossJoin(one).select(F.max(F.abs(back - F.col("income")))).first()[0]
        assert got < 1e-3


def test_hops_of_a_triangle(spark):
    edges = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("a", 3, 1)], "layer string, src long, dst long")
    got = graph.hop_neighbourhood(edges, spark.createDataFrame([(1,)], "person long")).collect()
    assert {(r["hop"], r["other"]) for r in got} == {(1, 2), (1, 3)}


def test_top_k_and_scores_on_ties_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(6)] + [(9, [0.0, 0.0]), (10, None)], "id long, vec array<double>")
    got = evaluation.top_k(df, df, 2, 2).filter("id = 0").orderBy("rank").collect()
    assert [(r["other"], r["similarity"]) for r in got] == [(2, 1.0), (4, 1.0)]
    assert evaluation.top_k(df.limit(0), df, 2, 2).count() == 0


def test_arrays(spark):
    r = spark.createDataFrame([([3.0, 4.0], [float("nan"), None], [1, 2, 3])], "a array<double>, b array<double>, c array<int>").select(
        arrays.l2_normalise("a"), arrays.finite_or_zero("b"), arrays.pad_right("c", 5, 0), arrays.digitize(F.lit(2.0), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    ).first()
    assert list(r) == [[0.6, 0.8], [0.0, 0.0], [1, 2, 3, 0, 0], 2]


def test_files(spark, tmp_path):
    pairs, orphans = files.data_and_meta(["d/a.parquet", "d/a_meta.parquet", "d/b_meta.parquet", "d/c.parquet"])
    assert pairs == [("d/a.parquet", "d/a_meta.parquet"), ("d/c.parquet", None)] and orphans == ["d/b_meta.parquet"]
    df = spark.createDataFrame([(1, 2010, [1.0, 2.0]), (2, 2011, [3.0, 4.0])], "SOURCE long, year int, emb array<double>")
    files.write_partitioned(df, f"file://{tmp_path}/w", ["year"])
    assert files.read_walks(spark, f"file://{tmp_path}/w", year=2011).first()["SOURCE"] == 2
    with pytest.raises(ValueError):
        files.read_walks(spark, f"file://{tmp_path}/w", year=1999)
    assert files.wide_embedding(df, "emb", 2).columns == ["SOURCE", "year", "emb0", "emb1"]
    assert cleaning.year_in_name("yearly2011file.csv") == 2011


def test_stream(spark, tmp_path):
    from cohortspark.streaming.event_counts import windowed_counts

    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 02:10:00", "b")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    df.write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "t", "k")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["kind"], r["n"]) for r in spark.sql("SELECT kind, n FROM counted").collect()} == {("a", 2), ("b", 1)}
