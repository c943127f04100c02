import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import strings as st
from cohortspark.operators import evaluation as ev, graph, ranking, regression as rg, unions
from cohortspark.sources import files


def test_regression_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 1000, 0.01] + [0, 5000, 1]
    y = x @ [2, 0.5, -30] + 7 + rng.normal(size=200)
    fold = rng.integers(0, 4, 200)
    df = spark.createDataFrame([(int(f), *map(float, r), float(v)) for f, r, v in zip(fold, x, y)] + [(0, None, 1.0, 1.0, 1.0)], "fold int, a double, b double, c double, y double")
    told, coef = rg.cross_validated(df, [], "fold", ["a", "b", "c"], "y")
    for f in range(4):
        want = np.linalg.lstsq(np.c_[np.ones((fold != f).sum()), x[fold != f]], y[fold != f], rcond=None)[0]
        assert np.allclose(coef[(f,)], want, rtol=1e-4, atol=1e-3)
    assert told.filter("guess IS NULL").count() == 1
    s = {r["fold"]: r for r in rg.scores(told, ["fold"], "y", "guess").collect()}
    assert all(r["r2"] > 0.9 and math.isclose(r["rmse"] ** 2, r["mse"]) for r in s.values())


@pytest.mark.parametrize("power", [0.0, 0.4, 1.0, 2.0, 2.5])
def test_yeo_johnson_returns(spark, power):
    values = [-1e9, -10.0, 0.0, 10.0, 1e9] if power in (0.4, 1.0) else [-900.0, -10.0, 0.0, 10.0, 900.0]
    df = spark.createDataFrame([(v,) for v in values + [None]], "x double")
    t = rg.yeo_johnson(F.col("x"), power)
    got = df.select("x", rg.yeo_johnson_inverse(t, power).alias("y")).collect()
    assert all((r["x"] is None and r["y"] is None) or abs(r["x"] - r["y"]) <= 1e-6 * (1 + abs(r["x"])) for r in got)


def test_yeo_johnson_power_is_the_likeliest(spark):
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(size=800)) - 1
    p = rg.yeo_johnson_power(spark.createDataFrame([(float(v),) for v in x], "x double"), "x")

    def like(q):
        y = np.where(x >= 0, ((np.abs(x) + 1) ** q - 1) / q, -((np.abs(x) + 1) ** (2 - q) - 1) / (2 - q))
        return -len(x) / 2 * np.log(y.var()) + (q - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

    grid = np.arange(-1.5, 1.5, 0.01) + 0.0001
    assert abs(p - grid[np.argmax([like(q) for q in grid])]) < 0.02
    assert rg.yeo_johnson_power(spark.createDataFrame([], "x double"), "x") == 1.0


def test_binomial_bound():
    for n, k, delta in ((50, 3, 0.05), (200, 0, 0.1), (10, 9, 0.01)):
        p = ev.binomial_bound(n, k, delta)
        assert abs(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - delta) < 1e-6
    assert ev.binomial_bound(0, 0, 0.1) == 1.0 and ev.binomial_bound(5, 5, 0.1) == 1.0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in (1, 2, None) for v in rng.integers(0, 20, 50)] + [(3, None)]
    got = {r["g"]: r["p"] for r in ranking.exact_quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [0.0, 0.1, 0.5, 1.0]).collect()}
    for g in (1, 2, None):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], [0.0, 0.1, 0.5, 1.0]))
    assert 3 not in got


def test_negatives_are_no_neighbours_and_none_is_lost(spark):
    edges = [("a", 0, i) for i in range(1, 12)] + [("a", 1, 2), ("b", 3, 4)] + [("c", i, j) for i in range(12) for j in range(i)]
    got = graph.negative_samples(spark.createDataFrame(edges, "layer string, src long, dst long")).collect()
    near = {(x, a) for layer, s, t in edges for x, a in ((f"{layer}{s}", t), (f"{layer}{t}", s))}
    assert len(got) == 12 + 2 + 12
    for r in got:
        assert (f"{r['layer']}{r['node']}", r["positive"]) in near
        if r["layer"] == "c" or (r["layer"], r["node"]) == ("a", 0):
            assert r["negative"] is None  # all others are neighbours
        else:
            assert r["negative"] != r["node"] and (f"{r['layer']}{r['node']}", r["negative"]) not in near


def test_strings_and_paths(spark):
    df = spark.createDataFrame([("some-class--0.4",), ("abc--0.5",), ("----0.1",), ("none",), (None,)], "t string")
    name, p = st.class_and_probability("t")
    assert [tuple(r) for r in df.select(name, p).collect()] == [("some-class", 0.4), ("abc", 0.5), ("--", 0.1), (None, None), (None, None)]
    assert st.with_year("a/yearly2011file.csv", 0, 2015) == "a/yearly2015file.csv" and st.with_year("x/in2011/f.csv", 1, 2015) == "x/in2015/f.csv"
    for path, level in (("x2011/f.csv", 0), ("f2011.csv", 3)):
        with pytest.raises(ValueError):
            st.with_year(path, level, 2015)
    r = spark.createDataFrame([(None, None), ("a", None)], "a string, b int").select(st.joined_fields("a", "b")).collect()
    assert [x[0] for x in r] == [None, "a"]


def test_files_are_routed_cut_cached_and_listed(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(3).selectExpr("id", *[f"id AS c{k}" for k in range(25)]).write.parquet(f"{root}/in/wide.parquet")
    spark.range(3).selectExpr("id", "id AS a", "id AS b").write.parquet(f"{root}/in/thin.parquet")
    spark.createDataFrame([("id", "Numeric"), ("b", "String")], "Name string, Type string").write.parquet(f"{root}/in/thin_meta.parquet")
    assert sorted(v.split("/")[-2] for v in files.route_by_width(spark, [f"{root}/in/wide.parquet", f"{root}/in/thin.parquet"], f"{root}/out").values()) == ["good", "huge"]
    files.subset_files(spark, [f"{root}/in/thin.parquet", f"{root}/in/thin_meta.parquet"], ["id", "a"], "/in/", "/cut/")
    assert spark.read.parquet(f"{root}/cut/thin.parquet").columns == ["id", "a"] and spark.read.parquet(f"{root}/cut/thin_meta.parquet").count() == 1
    assert files.subset_columns(spark.range(1), ["id", "x", "x"])[1] == ["x"]
    calls = []
    compute = lambda: calls.append(1) or spark.range(4)
    for _ in range(2):
        assert files.cached_stage(spark, f"{root}/stage", {"n": 4}, compute).count() == 4
    assert len(calls) == 1
    with pytest.raises(ValueError):
        files.cached_stage(spark, f"{root}/stage", {"n": 5}, compute)
    files.cached_stage(spark, f"{root}/stage", {"n": 5}, compute, on_change="recompute")
    assert len(calls) == 2
    steps = [("one", {"n": 2}, lambda _: spark.range(2)), ("two", {}, lambda done: done["one"].selectExpr("id + 1 AS id"))]
    assert files.staged(spark, f"{root}/steps", steps)["two"].agg(F.sum("id")).first()[0] == 3
    sets = [{"name": "a", "year": 2010, "type": "x"}, {"name": "a", "year": 2011}]
    assert files.catalogue(spark, sets).count() == 2
    with pytest.raises(ValueError):
        files.catalogue(spark, sets + sets[:1])
    files.write_json_rows(spark.range(5), f"{root}/json", "id", shuffled=True)
    assert files.read_json_rows(spark, f"{root}/json", "id long").count() == 5
    assert files.merge_chunks(spark, [f"{root}/in/thin.parquet", f"{root}/in/wide.parquet"]).count() == 6
    with pytest.raises(ValueError):
        files.by_position(spark.createDataFrame([(0, 1.0), (7, 2.0)], "idx long, v double"), "idx", spark.createDataFrame([(5, 0)], "node long, idx long"), "node", "idx")
    files.write_subsets(spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, v double"), f"{root}/sets", spark.createDataFrame([(1, "eval")], "id long, subset string"), "id")
    assert spark.read.parquet(f"{root}/sets").filter("subset = 'eval'").count() == 1


def test_unions_of_nobody(spark):
    none = spark.createDataFrame([], "rinpersoon long, partner long, year int")
    assert unions.with_ends(none, "rinpersoon", "partner", "year").count() == 0
    one = spark.createDataFrame([(1, 2, 2000), (2, 1, 2000), (1, 3, 2010), (4, None, 2000)], "rinpersoon long, partner long, year int").dropna()
    got = {(r["rinpersoon"], r["partner"]): r["end_year"] for r in unions.with_ends(one, "rinpersoon", "partner", "year").collect()}
    assert got == {(1, 2): 2010, (2, 1): 2010, (1, 3): 2200}


def test_silhouette_of_few(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (2, [0.1, 1.0]), (3, [-1.0, 0.0]), (1, [0.0, 0.0])], "c int, v array<double>")
    x, c = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1], [-1, 0]], float), np.array([1, 1, 2, 2, 3])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    far, s = 1 - u @ u.T, []
    for i in range(5):
        own = (c == c[i]) & (np.arange(5) != i)
        b = min(far[i, c == k].mean() for k in set(c) - {c[i]})
        s.append((b - far[i, own].mean()) / max(b, far[i, own].mean()) if own.any() else 0.0)
    assert abs(ev.silhouette(df, "c", "v", 2).first()[0] - np.mean(s)) < 1e-9
