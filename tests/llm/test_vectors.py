import numpy as np
import pytest

from cohortspark.llm import learned_index as li
from cohortspark.llm.markov import Clustering
from cohortspark.llm.neighbours import close_pairs, neighbours
from cohortspark.llm.vectors import in_cells, to_cells

SCHEMA = "id long, v array<float>, neighbour long"


def _rows(x):
    return [(i, [float(a) for a in r], 0) for i, r in enumerate(x)]


def test_dirty_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 64))
    x[20:40] = x[0]  # more copies than neighbours asked for
    bad = [(100, None, 0), (101, [1.0] * 63, 0), (102, [float("nan")] * 64, 0), (103, [0.0] * 64, 0), (104, [float("inf")] * 64, 0), (None, [1.0] * 64, 0), (105, [None] + [1.0] * 63, 0)]
    df = spark.createDataFrame(_rows(x) + _rows(x[:3]) + bad, SCHEMA)
    near = neighbours(df, "id", "v", k=5)
    got = {}
    for r in near.collect():
        got.setdefault(r["id"], []).append((-r["similarity"], r["neighbour"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(np.minimum((u.astype(np.float32) @ u.astype(np.float32).T).astype(float), 1), 6)
    assert set(got) == set(range(40))
    for i in range(40):
        want = sorted((-sim[i, j], j) for j in range(40) if j != i)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    pairs = {tuple(r) for r in close_pairs(neighbours(df, "id", "v", k=5, least=0.95)).collect()}
    assert (0, 20) in pairs and (20, 39) in pairs and all(a < b for a, b in pairs)
    assert neighbours(df.limit(0), "id", "v").count() == 0


def test_recall_of_the_learned_index():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(300, 64))
    x = (centres[rng.integers(300, size=9000)] + 0.7 * rng.normal(size=(9000, 64))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = li.LearnedPartition.fit(x[:4000], 8)
    parts = model.route(x, 3)
    assert model.parts == 8 and np.bincount(parts[:, 0], minlength=8).max() < 9000 / 8 * 2
    _, near = li.nearest(x[:500], x, 10, np.arange(500))
    assert (parts[:500][:, None, :] == parts[near][:, :, :1]).any(2).mean() > 0.9


def test_tree_routes_to_its_leaves():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    root = li.LearnedPartition.fit(x, 4)
    tree = li.RoutingTree(root, {p: li.LearnedPartition.fit(x[root.route(x, 1)[:, 0] == p], 3) for p in range(4)})
    got = tree.route(x, 3)
    assert tree.leaves == 12 and got.shape == (4000, 3) and got[:, 0].min() >= 0 and got.max() < 12
    assert np.isclose(tree.load.sum(), 1)


def test_grid_of_cells_meets_every_pair_once(spark):
    from pyspark.sql import functions as F

    from cohortspark.llm.vectors import sound_vectors

    x = np.random.default_rng(4).normal(size=(90, 64))
    v = sound_vectors(spark.createDataFrame(_rows(x), SCHEMA), "id", "v").select("id", F.col("id").alias("tag"), "vec", F.lit(True).alias("is_index"), F.lit(True).alias("is_query"))
    cells = to_cells(v, li.RoutingTree(li.LearnedPartition(1, None, np.ones(1))), 90, 1, cell_rows=30)
    assert cells.select("ci", "qi").distinct().count() == 16
    meet = lambda i, it, ix, q, qt, qx: (np.repeat(q, len(i)), np.tile(i, len(q)))
    got = in_cells(cells, meet, "q long, i long", ["q", "i"])
    assert got.count() == 8100 and got.distinct().count() == 8100


def test_clusters_of_separate_blobs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.05 * rng.normal(size=(n, 64)) for c, n in zip(rng.normal(size=(4, 64)), (30, 5, 2, 1))])
    df = spark.createDataFrame(_rows(x) + [(900, [float(a) for a in x[0]], 0), (901, None, 0)], SCHEMA)
    c = Clustering(df, "id", "v")
    assert {(r["cluster_key"], r["size"]) for r in c.summary().collect()} == {(0, 31), (30, 5), (35, 2), (37, 1)}
    got = {}
    for r in c.joined(3).collect():
        got.setdefault(r["cluster_key"], set()).add(r["id"])
    assert got == {0: {*range(30), 900}, 30: set(range(30, 35))}


def test_typical_members_are_the_nearest_to_all(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([c + 0.2 * rng.normal(size=(n, 64)) for c, n in zip(rng.normal(size=(2, 64)), (40, 12))])
    x[5] = x[6]  # an entity with a copy counts twice
    got = {r["cluster_key"]: r["typical"] for r in Clustering(spark.createDataFrame(_rows(x), SCHEMA), "id", "v").summary().collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for own in (np.arange(40), np.arange(40, 52)):
        near = np.round(u[own] @ u[own].sum(0) / len(own), 6)
        want = own[np.lexsort((own, -near))[:3]]
        assert got[own[0]] == ",".join(map(str, want))
        assert own[0] not in want  # the leader, the only typical one before


def test_chain_is_joined_over_markov_cuts(spark):
    angle = np.arange(12) * np.pi / 9  # neighbours at cosine 0.94, the ends far apart
    x = np.zeros((12, 64))
    x[:, 0], x[:, 1], x[:, 2] = np.cos(angle), np.sin(angle), 0.2 * np.arange(12)
    got = Clustering(spark.createDataFrame(_rows(x), SCHEMA), "id", "v").joined(3).collect()
    assert len(got) == 12 and {r["cluster_key"] for r in got} == {0}


def test_links_between_members_that_lead_nothing(spark):
    """Unit vectors in a plane; those at most 36.87 degrees apart are linked, so all six are one group, whichever become leaders."""
    degrees = np.array([0, 1, 25, 61, 85, 86])
    orders = [(0, 1, 2, 3, 4, 5), (1, 0, 5, 4, 3, 2), (3, 5, 1, 4, 0, 2)]
    x = np.zeros((18, 64))
    for k, order in enumerate(orders):  # three groups of six in planes of their own
        a = np.deg2rad(degrees[list(order)])
        x[6 * k : 6 * k + 6, 2 * k], x[6 * k : 6 * k + 6, 2 * k + 1] = np.cos(a), np.sin(a)
    got = {}
    for r in Clustering(spark.createDataFrame(_rows(x), SCHEMA), "id", "v").joined(3).collect():
        got.setdefault(r["cluster_key"], set()).add(r["id"])
    assert got == {6 * k: set(range(6 * k, 6 * k + 6)) for k in range(3)}


def test_members_are_compared_in_blocks(spark):
    from cohortspark.llm import markov

    rng = np.random.default_rng(8)
    u = rng.normal(size=(40, 64)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    u[39] = u[3]
    rows = [(i, i // 20 * 20, bytes(np.r_[u[i], 1].astype(np.float32).tobytes())) for i in range(40)]
    gathered = spark.createDataFrame(rows, "id long, leader long, vec binary")
    pairs = spark.createDataFrame([(0, 20)], "a long, b long")
    (got,) = markov.member_links(pairs, gathered, block_rows=6).collect()
    s = u[:20] @ u[20:].T
    assert (got["a"], got["b"], got["members"]) == (0, 20, int((s >= 0.8).sum())) and abs(got["strongest"] - 1) < 1e-5


def test_random_groups_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 64))  # a sphere in three dimensions: long thin groups
    x = x[np.r_[0:60]]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(60)
    linked = u @ u.T >= 0.8
    for _ in range(60):
        label = np.array([label[linked[i]].min() for i in range(60)])
    want = {(int(k), i) for i, k in enumerate(label) if (label == k).sum() >= 3}
    got = {(r["cluster_key"], r["id"]) for r in Clustering(spark.createDataFrame(_rows(x), SCHEMA), "id", "v").joined(3).collect()}
    assert got == want


def test_attractor_rows_define_clusters(spark):
    from cohortspark.llm import markov

    # two triangles joined by one weak link: flow separates them
    edges = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (3, 4, 0.2)]
    links = spark.createDataFrame(edges, "a long, b long, weight double")
    comp = spark.createDataFrame([(i, 1) for i in range(1, 7)], "leader long, comp long")
    flow = markov.markov_flow(links, comp)
    assert {(r["leader"], r["cluster"]) for r in markov.attractor_clusters(flow).collect()} in (
        {(1, a), (2, a), (3, a), (4, b), (5, b), (6, b)} for a in (1, 2, 3) for b in (4, 5, 6)
    )
    assert all(abs(r["s"] - 1) < 1e-9 for r in flow.groupBy("j").agg({"w": "sum"}).toDF("j", "s").collect())
    with pytest.raises(RuntimeError):
        markov.markov_flow(links, comp, max_rounds=1)


def test_what_follows_the_flow_works_on_its_clusters(spark, monkeypatch):
    from cohortspark.llm import markov

    degrees = np.deg2rad([0, 30, 60, 2, 32, 62])  # three leaders in a row, which the flow makes one cluster, and a member of each
    x = np.zeros((6, 64))
    x[:, 0], x[:, 1] = np.cos(degrees), np.sin(degrees)
    joined, compared, components, member_links = [], [], markov.components, markov.member_links
    monkeypatch.setattr(markov, "components", lambda ties: joined.append(ties.count()) or components(ties))
    monkeypatch.setattr(markov, "member_links", lambda pairs, *a: compared.append(pairs.count()) or member_links(pairs, *a))
    c = Clustering(spark.createDataFrame(_rows(x), SCHEMA), "id", "v")
    assert {(r["cluster_key"], r["id"]) for r in c.joined(3).collect()} == {(0, i) for i in range(6)}
    assert c.clusters.count() == 3 and c.clusters.select("cluster").distinct().count() == 1
    # nothing is left to join or compare: before, the leaders were joined without the flow
    assert joined == [0] and compared == [0]


def test_empty_clustering(spark):
    c = Clustering(spark.createDataFrame([], SCHEMA), "id", "v")
    assert c.summary().count() == 0 and c.joined().count() == 0


def test_second_level_is_fitted_where_one_model_has_too_few_parts(spark):
    from cohortspark.llm.vectors import Copies, fit_tree, matrix, sound_vectors

    x = np.random.default_rng(6).normal(size=(2000, 64))
    reps = Copies(sound_vectors(spark.createDataFrame(_rows(x), SCHEMA), "id", "v")).reps
    tree = fit_tree(reps, fit_rows=400, part_rows=50, max_parts=4)
    # a part that the classifier gives to no vector has no model of its own and stays one leaf
    assert tree.root.parts == 4 and tree.children and tree.leaves > tree.root.parts
    parts = tree.route(matrix(reps.select("vec").toArrow()["vec"], 64), 3)
    assert parts[:, 0].min() >= 0 and parts.max() < tree.leaves
    assert len(np.unique(parts[:, 0])) > tree.root.parts
