import duckdb
import pytest

from cohortspark.operators import sequences as sq
from cohortspark.plans import sequence_queries as q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Person 1 has more events than fit into 512 tokens, person 2 more than into 64, person 3 none; 300 codes."""
    d = str(tmp_path_factory.mktemp("sequences"))
    events = [(p, 10 * i, 30, "s", f"code{i % 300:03d}") for p, n in ((1, 400), (2, 40)) for i in range(n)]
    spark.createDataFrame(events, "RINPERSOON long, daysSinceFirstEvent int, age int, source string, event_code string").coalesce(1).write.parquet(f"{d}/life_events.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "rinpersoon long").coalesce(1).write.parquet(f"{d}/person_background.parquet")
    return d


def _sql(tables, name):
    """The query's SQL and the size of the vocabulary."""
    db = duckdb.connect()
    for t in ("life_events", "person_background"):
        db.execute(f"CREATE VIEW {t} AS FROM '{tables}/{t}.parquet/*.parquet'")
    (size,) = db.execute(f"SELECT count(*) FROM ({q.ORACLE['vocabulary']})").fetchone()
    assert "(512 - 2 - 1)" in q.ORACLE[name]
    return sorted(db.execute(q.ORACLE[name]).fetchall()), size


def test_encoding_has_the_full_length(spark, tables):
    got = sorted(tuple(r) for r in q.encode_sequences(spark, tables).collect())
    assert [len(r[1].split(",")) for r in got] == [512] * 3
    assert [r[4] for r in got] == [2 + 3 * 169, 2 + 3 * 40, 2]
    assert got == _sql(tables, "encode_sequences")[0]


def test_masks_draw_from_the_whole_vocabulary(spark, tables):
    got = sorted(tuple(r) for r in q.token_masking(spark, tables).collect())
    want, size = _sql(tables, "token_masking")
    assert size == 308 and got == want
    drawn = {r[3] for r in got if r[3] not in (r[2], sq.GENERAL.index(sq.MASK))}
    assert max(drawn) >= 200 and max(r[1] for r in got) >= 64
