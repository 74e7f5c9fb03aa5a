"""What the findings of round 3 were about: each failed before its change."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import pytest
from pyspark.sql import functions as F

from tidemark.operators.pipeline import Pipeline
from tidemark.plans.statistics import period_start, statistics
from tidemark.queries import BINS, ORACLE_SQL, QUERIES, box_documents, event_documents


def against_sql(spark, folder, name, table, columns):
    """Rows of a query and of its SQL over one table; zeros keep their signs."""
    pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    return sorted(str(tuple(r)) for r in got), sorted(str(r) for r in want.fetchall())


def test_best_split_of_scores_that_round_alike(spark, tmp_path):
    # Six equal days but for one event of the fourth: every score rounds to 0, none is 0.
    ts = [datetime(2024, 1, 1 + d, 1) for d in range(6) for _ in range(2000)]
    value = [55.0 if i % 2 else 5.0 for i in range(12000)]
    value[3 * 2000] = 55.0
    got, want = against_sql(spark, tmp_path, "best_split", "events", {
        "event_id": list(range(12000)), "ts": pa.array(ts, pa.timestamp("us")), "user_id": list(range(12000)),
        "event_type": ["view"] * 12000, "value": value, "props": ["{}"] * 12000})
    assert got == want == ["(2, 0.0)"]


def test_statistics_keep_no_group_sized_state(spark, sf_dir):
    plan = event_documents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_statistics_rank_rows_once_and_count_inspections_once(spark, sf_dir):
    # No row is copied for each level before inspections are told apart, and no level's values are counted again before they are ranked.
    plan = event_documents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and ", kind#" in line.split("], [")[0] and "g#" in line.split("], [")[0]
                and ", v#" in line.split("], [")[0]]


def test_statistics_read_rows_twice(spark, sf_dir):
    # Once to count them, for cells and quantiles alike, and once for inspections; no time zone is asked.
    df = event_documents(spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    reads = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(reads) == 2 and "ReusedExchange" in plan and "trunctimestamp" not in plan
    assert "distinct" not in plan and "percentile" not in plan


@pytest.mark.parametrize("granularity, unit", [("hourly", "hour"), ("daily", "day"), ("weekly", "week"), ("shift", None)])
def test_periods_start_as_truncated(spark, granularity, unit):
    """Before and after the epoch, on borders and beside them; in other zones by their own midnight."""
    days = [datetime(1899, 12, 31), datetime(1969, 12, 29), datetime(1970, 1, 1), datetime(1970, 1, 5), datetime(2024, 3, 10), datetime(2024, 2, 29)]
    steps = [timedelta(microseconds=m) for m in (-1, 0, 1)] + [timedelta(hours=h, microseconds=m) for h in (1, 12, 13, 23) for m in (-1, 0)]
    made = ", ".join(f"TIMESTAMP_NTZ '{d + s}'" for d in days for s in steps)

    def differing():
        df = spark.sql(f"SELECT CAST(x AS timestamp) AS ts FROM (SELECT explode(array({made}, null)) AS x)")
        day = F.date_trunc("day", "ts")
        want = F.date_trunc(unit, "ts") if unit else F.when(F.hour("ts") >= 12, day + F.expr("INTERVAL 12 HOURS")).otherwise(day)
        return df.where(~period_start(F.col("ts"), granularity).eqNullSafe(want)).collect()

    assert not differing()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
    try:
        assert not differing()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_deviation_of_small_variances(spark):
    # About a large mean, in counts of equal values, in several cells; and none in a cell of one value.
    rng = np.random.default_rng(9)
    rows = [(datetime(2024, 1, 1), f"e{i % 3}", f"c{i % 2}", 1e9 + float(rng.integers(4)) / 1024) for i in range(999)] + [(datetime(2024, 1, 1), "e0", "one", 0.1)] * 7
    df = spark.createDataFrame(rows, "ts timestamp, equipment string, class string, confidence double").selectExpr(
        "*", "'m' AS k", "0.5D AS threshold", "1D AS elapsed", "'cpu' AS backend", "1 AS inspection")
    total = statistics(df.where("class <> 'one'"), ["k"], "daily", BINS).first()["total"]
    assert np.isclose(total["confidence"]["std"], np.std([r[3] for r in rows if r[2] != "one"]), rtol=1e-6)
    one = statistics(df, ["k"], "daily", BINS).first()["total"]["perClass"]["one"]
    assert one["count"] == 7 and one["std"] < 1e-16 and np.isclose(one["sum"], 0.7) and one["histogram"][1] == 7


def test_boxes_are_joined_once(spark, sf_dir):
    plan = box_documents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" not in plan and "o_orderdate" in plan


def test_inspections_are_counted_apart(spark):
    """Inspections of several equipments, of none, unknown ones, and periods without a known one."""
    rows = [(datetime(2024, 1, day), e, i) for day, e, i in [
        (1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (1, None, "x"), (1, None, "y"), (1, "a", None), (1, "c", None), (2, "a", "x"), (2, "b", "z"), (3, "a", None)]]
    df = spark.createDataFrame(rows, "ts timestamp, equipment string, inspection string").selectExpr(
        "*", "'m' AS k", "'c' AS class", "0.5D AS confidence", "0.5D AS threshold", "1D AS elapsed", "'cpu' AS backend")
    docs = {d["startDate"].day: d for d in statistics(df, ["k"], "daily", BINS).collect()}
    assert {d: doc["total"]["inspectionCount"] for d, doc in docs.items()} == {1: 2, 2: 2, 3: 0}
    assert {e["equipmentId"]: e["inspectionCount"] for e in docs[1]["equipments"]} == {None: 2, "a": 1, "b": 1, "c": 0}
    assert [e["inspectionCount"] for d in (2, 3) for e in docs[d]["equipments"]] == [1, 1, 0]


def test_quantiles_of_values_that_every_cell_has(spark):
    # Equal values of several cells are one run: ranks fall inside it, before it and after it.
    rng = np.random.default_rng(7)
    rows = [(datetime(2024, 1, 1), f"e{rng.integers(5)}", f"c{rng.integers(4)}", float(rng.integers(6)) / 8) for _ in range(997)]
    df = spark.createDataFrame(rows, "ts timestamp, equipment string, class string, confidence double").selectExpr(
        "*", "'m' AS k", "0.5D AS threshold", "confidence AS elapsed", "'cpu' AS backend", "1 AS inspection")
    total = statistics(df, ["k"], "daily", BINS).first()["total"]
    values = [r[3] for r in rows]
    assert list(total["confidence"]["quantiles"]) == list(np.percentile(values, [5, 10, 25, 50, 75, 90, 95]))
    assert [total["elapsedTime"]["p50"], total["elapsedTime"]["p90"]] == list(np.percentile(values, [50, 90]))


def test_statistics_at_every_level(spark):
    """Quantiles, moments and different inspections of groups with nulls, against numpy."""
    rng = np.random.default_rng(5)
    n = 3000
    rows = [("m", datetime(2024, 1, 1) + timedelta(minutes=int(i)), [None, "a", "b"][i % 3], [None, "x", "y", "z"][rng.integers(4)],
             None if i % 7 == 0 else float(np.round(rng.random(), 2)), [None, 0.5][i % 2], float(rng.random()), ["cpu", "gpu"][i > 2000],
             None if i % 11 == 0 else i // 2) for i in range(n)]
    names = ["k", "ts", "equipment", "class", "confidence", "threshold", "elapsed", "backend", "inspection"]
    types = "k string, ts timestamp, equipment string, class string, confidence double, threshold double, elapsed double, backend string, inspection long"
    docs = statistics(spark.createDataFrame(rows, types), ["k"], "daily", BINS).collect()
    assert len(docs) == 3

    def agrees(block, own):
        col = lambda name: [r[names.index(name)] for r in own if r[names.index(name)] is not None]
        conf, elapsed = col("confidence"), col("elapsed")
        c, e = block["confidence"], block["elapsedTime"]
        assert block["predictionCount"] == len(own) and block["inspectionCount"] == len(set(col("inspection")))
        assert (c["count"], c["min"], c["max"]) == (len(conf), min(conf), max(conf)) and sum(c["histogram"]) == len(conf)
        assert np.allclose([c["mean"], c["std"], e["sum"]], [np.mean(conf), np.std(conf), sum(elapsed)])
        assert np.allclose(list(c["quantiles"]), np.percentile(conf, [5, 10, 25, 50, 75, 90, 95]))
        assert np.allclose([e["p50"], e["p90"]], np.percentile(elapsed, [50, 90]))
        for name, one in block["perClass"].items():
            some = [r[4] for r in own if r[3] == name and r[4] is not None]
            assert one["count"] == len(some) and np.allclose(list(one["quantiles"]), np.percentile(some, [5, 10, 25, 50, 75, 90, 95]))
            assert np.allclose(one["std"], np.std(some))

    for doc in docs:
        day = [r for r in rows if r[1].date() == doc["startDate"].date()]
        agrees(doc["total"], day)
        assert {e["equipmentId"] for e in doc["equipments"]} == {None, "a", "b"}
        for e in doc["equipments"]:
            own = [r for r in day if r[2] == e["equipmentId"]]
            agrees(e, own)
            assert e["backend"] == max(own, key=lambda r: r[1])[7]


def test_sums_of_pairs_round_as_the_sql_rounds(spark, tmp_path):
    # Halves (2**-7 is 0.0078125), and sums that round to zero from either side.
    pairs = [0.0078125, 0.0, -0.0078125, 0.0, -2e-7, 1e-7, 1e-7, 0.5, float("inf"), float("nan")]
    for name in ("zip_sum_arrays_whole", "zip_sum_arrays"):
        got, want = against_sql(spark, tmp_path, name, "embeddings", {"vec_id": [1], "embedding": pa.array([pairs], pa.list_(pa.float32()))})
        assert got == want
    assert "-0.0" in str(QUERIES["zip_sum_arrays_whole"](spark, str(tmp_path)).collect())


def test_round_keeps_the_sign_of_zero(spark):
    df = spark.createDataFrame([(-0.2, -3), (0.2, 3), (-2.5, -(2**63))], "d double, n long")
    got = Pipeline().run(df, [{"$project": {"d": {"$round": ["$d", 0]}, "n": {"$round": ["$n", 0]}}}])
    assert [str(tuple(r)) for r in got.collect()] == ["(-0.0, -3)", "(0.0, 3)", "(-2.0, -9223372036854775808)"]
    assert dict(got.dtypes) == {"d": "double", "n": "bigint"}
