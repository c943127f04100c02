import datetime as dt

import numpy as np
from hypothesis import given, settings, strategies as st

from cohortspark.operators import intervals as iv


def brute(rows):
    out = []
    for e in sorted({r[0] for r in rows}):
        days = sorted({d for x, a, b in rows if x == e for d in range(a, b + 1)})
        for d in days:
            if out and out[-1][0] == e and out[-1][2] == d - 1:
                out[-1][2] = d
            else:
                out.append([e, d, d])
    return [tuple(x) for x in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 70), st.integers(0, 25)), max_size=25))
def test_merge_is_the_union_of_days(rows):
    rows = [(e, a, a + n) for e, a, n in rows]
    got = iv.merge_intervals(*(np.array([r[k] for r in rows], np.int64) for k in range(3)))
    assert [tuple(map(int, x)) for x in zip(*got)] == brute(rows)


def test_dirty_rows_and_gaps(spark):
    d = dt.date
    rows = [
        (1, d(2000, 1, 1), d(2000, 1, 5), "x"), (1, d(2000, 1, 4), d(2000, 1, 9), "x"), (1, d(2000, 1, 10), d(2000, 1, 10), "x"), (1, d(2000, 2, 1), None, "x"),
        (1, d(2001, 1, 1), d(2000, 1, 1), "x"), (1, None, d(2000, 1, 1), "x"), (None, d(2000, 1, 1), d(2000, 1, 2), "x"), (2, d(2000, 1, 1), d(9999, 12, 31), "x"),
        (1, d(2000, 1, 1), d(2000, 1, 5), "x"), (3, d(1999, 1, 1), d(1999, 1, 1), "x"), (3, d(1999, 1, 3), d(1999, 1, 3), "x"),
    ]
    df = spark.createDataFrame(rows, "p long, a date, b date, entity string")
    got = {(r["entity"], r["x"], r["y"]) for r in iv.gaps(df, "p", "a", "b").select("entity", iv.day_text("beg").alias("x"), iv.day_text("end").alias("y")).collect()}
    assert got == {(1, "2000-01-11", "2000-01-31"), (3, "1999-01-02", "1999-01-02")}
    assert iv.periods(df.limit(0), "p", "a", "b").count() == 0
