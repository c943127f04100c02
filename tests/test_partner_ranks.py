import hashlib

import numpy as np

from cohortspark.operators import evaluation


def _vectors(x, genders):
    order = sorted(range(len(x)), key=lambda i: (genders[i] or 0, i))
    return [(order.index(i), i, genders[i], [float(a) for a in x[i]]) for i in range(len(x))]


def test_ranks_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x, genders = rng.normal(size=(60, 8)), [(1, 2, 2, None)[i % 4] for i in range(60)]
    pairs = [(2000 + i % 3, i, (i * 7 + 5) % 60) for i in range(60) if i != (i * 7 + 5) % 60]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for y, p, q in pairs:
        others = [i for i in range(60) if genders[i] == genders[q] and i not in (p, q)]
        drawn = [others[int(hashlib.md5(f"{y}-{p}-{q}-{t}:rank".encode()).hexdigest()[:8], 16) % len(others)] for t in range(1, 101)]
        want[y, p] = 1 + sum(u[p] @ u[i] > u[p] @ u[q] for i in drawn)
    vectors = spark.createDataFrame(_vectors(x, genders), "idx long, id long, gender int, vec array<double>")
    got = evaluation.partner_ranks(spark.createDataFrame(pairs, "year int, person long, partner long"), vectors).collect()
    assert {(r["year"], r["person"]): r["rank"] for r in got} == want


def test_a_hundred_others_of_the_partners_gender(spark):
    # of the partner's gender all are nearer than partner 1; of the person's gender none is
    x, genders = [[1, 0], [0, 1], [1, 0.1], [1, 0.2], [-1, 0], [-1, 1]], [1, 2, 2, 2, 1, 1]
    vectors = spark.createDataFrame(_vectors(x, genders), "idx long, id long, gender int, vec array<double>")
    got = evaluation.partner_ranks(spark.createDataFrame([(2000, 0, 1)], "year int, person long, partner long"), vectors).collect()
    assert [r["rank"] for r in got] == [101]
