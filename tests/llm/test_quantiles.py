import datetime as dt

import numpy as np
from hypothesis import given, settings, strategies as st

from cohortspark.llm import quantiles as q


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-40, 40), min_size=0, max_size=300), min_size=1, max_size=6), st.sampled_from([0.0, 0.01, 0.05]))
def test_error_stays_within_the_bound(parts, eps):
    summaries = [q.thin(q.exact(np.array(p, float)), eps) for p in parts if p]
    if not summaries:
        return
    whole = q.merge(summaries)
    x = np.sort(np.concatenate([np.array(p, float) for p in parts if p]))
    assert whole[4] == len(x)
    for p in (0.0, 0.01, 0.3, 0.5, 0.9, 1.0):
        value, bound = q.query(whole, p)
        rank = max(1, int(np.ceil(p * len(x) - 1e-9)))
        error = max(0, rank - np.searchsorted(x, value, "right"), np.searchsorted(x, value, "left") + 1 - rank)
        assert error <= bound <= eps * len(x) + 1


def test_days_combine_and_later_deliveries_replace(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    rows = [(1, 2011, 10.0, t(1)), (2, 2011, 20.0, t(1)), (1, 2011, 30.0, t(2)), (1, 2011, 30.0, t(3)), (3, 2011, 9999999999.0, t(1)), (2, 2011, None, t(5)), (None, 2011, 5.0, t(1)), (4, None, 1.0, t(1)), (5, 2012, float("nan"), t(1)), (6, 2012, -5.0, None)]
    df = spark.createDataFrame(rows, "e long, year int, x double, t timestamp")
    got = {(r["grp"], r["percentile"]): (r["amount"], r["n"], r["max_rank_error"]) for r in q.group_percentiles(df, "e", "year", "x", "t", [0.0, 0.5, 1.0]).collect()}
    assert got == {(2011, 0.0): (5.0, 3, 0), (2011, 0.5): (20.0, 3, 0), (2011, 1.0): (30.0, 3, 0)}
    assert q.group_percentiles(df.limit(0), "e", "year", "x", "t").count() == 0
