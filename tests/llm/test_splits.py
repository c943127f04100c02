import random

from pyspark.sql import functions as F

from cohortspark.llm import splits as s


def test_groups_chains_and_nulls(spark):
    entities = spark.createDataFrame([(i,) for i in range(200)] + [(None,), (5,)], "entity long")
    ties = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 1), (3, 3), (None, 4), (7, 999)]
    groups = s.tied_groups(entities, spark.createDataFrame(ties, "a long, b long"))
    got = {r["entity"]: r["label"] for r in groups.collect()}
    assert len(got) == 200
    assert all(got[i] == 100 for i in range(100, 161)) and got[2] == 1 and got[3] == 3 and got[4] == 4 and got[7] == 7


def test_balance_and_togetherness(spark):
    rng = random.Random(2)
    group = [rng.choice([i, 5, 6, 7]) if rng.random() < 0.2 else i for i in range(3000)]
    groups = spark.createDataFrame([(i, g) for i, g in enumerate(group)], "entity long, label long")
    rows = spark.createDataFrame([(i, rng.choice([0, 0, 0, 1, None])) for i in range(3000) for _ in range(rng.randrange(3))], "entity long, value int")
    out = s.balanced_splits(groups, rows)
    assert out.count() == 3000
    assert out.groupBy("label").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    share = {r["split"]: r["n"] / 3000 for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    ones = {r["split"]: r["n"] for r in out.join(rows.filter("value = 1"), "entity").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(ones["train"] / sum(ones.values()) - 0.8) < 0.02


def test_empty(spark):
    none = spark.createDataFrame([], "entity long")
    groups = s.tied_groups(none, spark.createDataFrame([], "a long, b long"))
    assert s.balanced_splits(groups, spark.createDataFrame([], "entity long, value int")).count() == 0
