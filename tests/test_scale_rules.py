"""Cases the sample tables do not show: the date line, the poles, deep keys, size guards."""

import json

from pyspark.sql import functions as F

from beaconry import session
from beaconry.operators import geo, records, trade
from beaconry.sinks import tables


def test_neighbours_meet_across_the_date_line_and_at_the_pole(spark):
    rows = [(1, 179.99, 10.0, 1), (2, -179.99, 10.0, 2), (3, 0.0, 89.95, 3), (4, 180.0, 89.95, 4), (5, 90.0, 10.0, 5)]
    table = spark.createDataFrame(rows, "id int, lon double, lat double, at int")
    pairs = {(r["id"], r["other"]) for r in geo.nearby(table).collect()}
    assert pairs == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_nearest_sets_cross_the_date_line_and_the_pole(spark):
    nodes = spark.createDataFrame([(1, 179.99, 10.0), (2, 100.0, 89.9), (3, 0.0, 0.0)], "id int, lon double, lat double")
    sets = {"a": spark.createDataFrame([(-179.99, 10.0)], "lon double, lat double"), "b": spark.createDataFrame([(-80.0, 89.9)], "lon double, lat double")}
    got = {r["id"]: r for r in geo.nearest_set(nodes, sets, 120.0).collect()}
    assert abs(got[1]["km_a"] - 2.19) < 0.01 and got[1]["nearest"] == "a"
    assert abs(got[2]["km_b"] - 22.24) < 0.01 and got[2]["nearest"] == "b"
    assert got[3]["nearest"] is None


def test_keys_are_found_at_any_depth(spark):
    deep = {"x": 1}
    for i in range(9):
        deep = {f"k{i}": [deep]}
    deep["troops"] = 2
    rows = spark.createDataFrame([(json.dumps(deep),), (None,), ("[]",), ("{}",)], "p string")
    got = {(r["path"], r["verdict"]): r["n"] for r in records.key_audit(rows, "p", ["k8"], "troop|^x$").collect()}
    path = ".".join(f"k{i}" for i in range(8, -1, -1))
    assert got[path + ".x", "forbidden"] == 1 and got["troops", "forbidden"] == 1 and got["k8", "ok"] == 1 and len(got) == 11


def test_trade_windows_keep_flows_and_partners_apart(spark):
    stats = spark.createDataFrame(
        [("r", p, f, "200001", "10", "1000", "0", "C00", "0", v) for p, f, v in (("p", "M", 5.0), ("p", "X", 7.0), ("q", "M", 11.0))],
        "reporter string, partner string, flow string, period string, chapter string, heading string, mot string, customs string, partner2 string, value double",
    )
    windows = spark.createDataFrame([("r", "200001", "before")], "reporter string, period string, label string")
    got = {(r["partner"], r["flow"]): r["before"] for r in trade.chapter_windows(stats, windows).collect()}
    assert got == {("p", "M"): 5.0, ("p", "X"): 7.0, ("q", "M"): 11.0}


def test_spread_sides_are_broadcast_by_their_real_size(spark):
    edges = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0), (1, 1, 5.0, 5.0, 0.0, 5.0), (1, 1, 0.0, 5.0, 0.0, 0.0)], "poly_id int, ring_id int, x1 double, y1 double, x2 double, y2 double")
    cells = geo.ring_cells(edges, 0.1)
    points = spark.range(5).select(F.col("id").alias("_ix"), F.col("id").alias("_iy"))

    def joined(limit):
        return points.join(session.small_side(cells, limit), ["_ix", "_iy"], "left")._jdf.queryExecution().sparkPlan().toString()

    # a side over the limit is shuffled, whatever the optimizer takes it for
    assert "BroadcastHashJoin" in joined(session.BROADCAST_LIMIT_BYTES)
    assert "ShuffledHashJoin" in joined(10_000) and "Broadcast" not in joined(10_000)
    small = session.small_side(spark.range(3).select(F.col("id")))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in small


def test_a_rerun_replaces_its_day_only(spark, tmp_path):
    path = str(tmp_path / "run")
    for day, status, n in (("2024-01-01", "new", 3), ("2024-01-02", "new", 4), ("2024-01-02", "dropped", 2)):
        tables.write_run(spark.range(n).select("id", F.lit(status).alias("status"), F.lit(day).alias("run_day")), path)
    got = {(str(r["run_day"]), r["status"]): r["count"] for r in spark.read.parquet(path).groupBy("run_day", "status").count().collect()}
    assert got == {("2024-01-01", "new"): 3, ("2024-01-02", "dropped"): 2}
