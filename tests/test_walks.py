import duckdb
import pytest

from cohortspark.plans import graph_queries as q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A ring of marriages, two job types and three municipalities."""
    d = str(tmp_path_factory.mktemp("walks"))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    write([(i, i % 3) for i in range(12)], "rinpersoon long, municipality int", "person_background")
    write([(i, (i + 1) % 12) for i in range(0, 12, 2)], "rinpersoon long, partner long", "person_marriages")
    write([(i, f"j{i % 2}") for i in range(0, 320, 32)] + [(i, "j0") for i in range(12)], "RINPERSOON long, jobType string", "spolisbus")
    return d


@pytest.mark.parametrize("name", ["layered_walks", "context_pairs"])
def test_walks_have_forty_elements(spark, tables, name):
    """Against the query's SQL."""
    db = duckdb.connect()
    for t in ("person_background", "person_marriages", "spolisbus"):
        db.execute(f"CREATE VIEW {t} AS FROM '{tables}/{t}.parquet/*.parquet'")
    sql = q.ORACLE[name]
    assert sql.count("WHERE step < 39") == 1
    want = sorted(db.execute(sql).fetchall())
    got = sorted(tuple(r) for r in q.QUERIES[name](spark, tables).collect())
    assert got == want and len(want) > 0
    if name == "layered_walks":
        assert max(r[1] for r in got) == 39


def test_priority_walks_have_forty_elements(spark, tables):
    rows = q.priority_walks(spark, tables).collect()
    assert len(rows) == 39 * len({r["source"] for r in rows}) and max(r["step"] for r in rows) == 39
