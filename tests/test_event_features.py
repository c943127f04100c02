from cohortspark.operators import event_features as ef

SCHEMA = "RINPERSOON long, daysSinceFirstEvent int, age int, source string, event_code string, amount double, entity string"


def test_cleaning_windows_and_recency(spark):
    rows = [
        (1, 10, 20, "s", " abc", 5.0, "x"), (1, 10, None, "s", "ABC", 5.0, "x"), (1, 10, 999, "s", "Abc ", None, "x"), (1, 20, 21, "s", "ABC", 9999999999.0, "x"),
        (1, 30, 0, "s", "B", 2.5, "x"), (None, 1, 1, "s", "A", 1.0, "x"), (1, None, 1, "s", "A", 1.0, "x"), (1, 18000, 1, "s", "A", 1.0, "x"), (2, 0, 1, "s", None, 1.0, "x"), (2, 0, 3, "s", "", -1.0, "x"),
    ]
    store = ef.cumulative_store(ef.clean_events(spark.createDataFrame(rows, SCHEMA)))
    last = {(r["entity"], r["code"]): (r["n"], r["total"], r["last_day"], r["age"]) for r in ef.latest(store).collect()}
    assert last == {(1, "ABC"): (3, 5.0, 20, 21), (1, "B"): (1, 2.5, 30, None), (2, ""): (1, -1.0, 0, 3)}
    wide = {(r["entity"], r["code"]): r for r in ef.window_features(store, 20, [10, 15]).collect()}
    assert (wide[1, "ABC"]["n_10"], wide[1, "ABC"]["n_15"], wide[1, "ABC"]["days_since_last"]) == (1, 3, 0)
    assert (1, "B") not in wide
    one = {r["entity"]: r for r in ef.entity_table(store).collect()}
    assert one[1]["n_events"] == 4 and one[1]["age"] is None and [f["code"] for f in one[1]["features"]] == ["ABC", "B"]


def test_empty(spark):
    assert ef.cumulative_store(ef.clean_events(spark.createDataFrame([], SCHEMA))).count() == 0
