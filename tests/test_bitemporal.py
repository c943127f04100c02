import datetime as dt
import random

from pyspark.sql import functions as F

from cohortspark.operators.bitemporal import as_known


def test_against_brute_force(spark):
    rng, base = random.Random(5), dt.date(1990, 1, 1)
    day = lambda: None if rng.random() < 0.1 else base + dt.timedelta(rng.randrange(9000))
    versions = [(i, rng.choice([1, 2, 3, None]), day(), day(), 7) for i in range(60)] + [(100, 1, base, base, 7), (101, 1, base, base, 7)]
    events = [(i, rng.choice([1, 2, 3, 4, None]), None if i % 9 == 0 else 7300 + rng.randrange(9500), "x") for i in range(120)]
    v = spark.createDataFrame(versions, "vid long, p long, valid date, known date, period int")
    e = spark.createDataFrame(events, "eid long, p long, d int, state string")
    got = {r["eid"]: r["as_known_id"] for r in as_known(e, v, "p", F.col("d"), "p", "vid", "valid", "known", period=700).collect()}
    for eid, p, d, _ in events:
        best = None
        if p is not None and d is not None:
            at = dt.date(1970, 1, 1) + dt.timedelta(d)
            usable = [(a, k, i) for i, q, a, k, _ in versions if q == p and a and k and a <= at and k <= at]
            best = max(usable)[2] if usable else None
        assert got[eid] == best, (eid, p, d)
    assert len(got) == len(events)
    assert as_known(e, v.limit(0), "p", F.col("d"), "p", "vid", "valid", "known").filter("as_known_id is not null").count() == 0
