"""Spatial operators against brute force, table updates, published batches and the streaming gate."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from beaconry.operators import geo
from beaconry.operators import review_queue as rq
from beaconry.session import scratch_path
from beaconry.sinks import tables
from beaconry.sources import files
from beaconry.streaming import jobs

RINGS = [(1, 0, [(20.0, 35.0), (24.0, 35.5), (23.0, 39.0), (21.0, 38.0)]), (2, 0, [(30.0, -2.0), (33.0, -1.0), (31.0, 2.0)]), (3, 0, [(10.0, 68.0), (18.0, 69.0), (14.0, 71.0)])]


def polygons(spark):
    return geo.edges_of(spark.createDataFrame(RINGS, "poly_id int, ring_id int, points array<struct<lon:double,lat:double>>"))


def segment(lon, lat, a, b):
    kx, ky = 111.320 * math.cos(math.radians(lat)), 110.574
    ax, ay, bx, by = (a[0] - lon) * kx, (a[1] - lat) * ky, (b[0] - lon) * kx, (b[1] - lat) * ky
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
    return math.hypot(ax + t * dx, ay + t * dy)


def test_distance_and_fence_equal_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(15, 36), rng.uniform(-6, 72)) for i in range(400)]
    sides = [(r[2][i], r[2][(i + 1) % len(r[2])]) for r in RINGS for i in range(len(r[2]))]
    table = spark.createDataFrame(pts, "id int, lon double, lat double")
    got = {r.id: r.km for r in geo.nearest(table, polygons(spark), 150.0).collect()}
    fenced = {r.id: r.in_fence for r in geo.in_fence(table, polygons(spark), 30.0).collect()}
    inside = {r.id: r.polygons for r in geo.polygons_at(table, polygons(spark)).collect()}
    for i, lon, lat in pts:
        best = min(segment(lon, lat, a, b) for a, b in sides)
        assert (got[i] is None) == (best > 150.0) and (got[i] is None or abs(got[i] - best) < 1e-6)
        assert fenced[i] == (bool(inside[i]) or best <= 30.0)


def test_nearby_with_a_crowded_place_equals_brute_force(spark):
    rng = random.Random(4)
    spots = [(25.0, 38.0)] * 40 + [(25.0 + rng.random() * 0.002, 38.0 + rng.random() * 0.002) for _ in range(80)] + [(24 + rng.random() * 3, 37 + rng.random() * 3) for _ in range(60)]
    rows = [(i, x, y, i * 7 % 50) for i, (x, y) in enumerate(spots)]
    got = {}
    for r in geo.nearby(spark.createDataFrame(rows, "id int, lon double, lat double, at int")).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))

    def km(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return round(2 * 6371.0 * math.asin(math.sqrt(h)), 3)

    for a in rows:
        ranked = sorted((km(a, b), -b[3], b[0]) for b in rows if b[0] != a[0] and km(a, b) <= 60)[:8]
        assert [o for _, o in sorted(got.get(a[0], []))] == [o for _, _, o in ranked]


def test_state_upsert_keeps_the_cursor(spark):
    state = spark.createDataFrame([("a", "c1", 3), ("b", "c2", 1)], "job string, cursor string, failures bigint").withColumn("last_run_at", F.lit("t0")).withColumn("last_error", F.lit("e"))
    results = spark.createDataFrame([("a", True, None), ("b", False, "zz"), ("n", False, None)], "job string, ok boolean, cursor string").withColumn("ran_at", F.lit("t1")).withColumn("error", F.lit("boom"))
    got = {r.job: (r.cursor, r.failures, r.last_error) for r in tables.upsert_state(state, results).collect()}
    assert got == {"a": ("c1", 0, None), "b": ("c2", 2, "boom"), "n": (None, 1, "boom")}


def test_insert_absent_is_replay_safe_and_first_wins(spark):
    path = scratch_path(spark, "t")
    batch = spark.createDataFrame([("k1", 2, "b"), ("k1", 1, "a"), ("k2", 3, "c")], "k string, o int, v string")
    for _ in range(2):
        tables.insert_absent(spark, path, batch, ["k"], ["o"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("k1", 1, "a"), ("k2", 3, "c")]


def test_published_batch_round_trip_and_refusals(spark):
    names = [f.split(":")[0] for f in files.BATCH_ROW[7:-1].split(",")]
    row = {n: None for n in names} | {"content_hash": "h1", "triage_status": "queued", "triage_score": 0.5}
    rows = spark.createDataFrame([tuple(row[n] for n in names) + (0,)], ", ".join(f"{n} {'double' if n == 'triage_score' else 'string'}" for n in names) + ", ord int")
    document = tables.batch_document(rows, "2024-01-31-r1", "2024-01-31T00:00:00Z", "ord")
    path = scratch_path(spark, "b")
    document.select(F.lit("/2024-01-31-r1.json").alias("path"), F.length(F.encode("value", "UTF-8")).cast("bigint").alias("length"), F.encode("value", "UTF-8").alias("content")).write.parquet(path)
    content = spark.read.parquet(path)
    good = tables.pointer(document, "2024-01-31-r1")
    taken, refused = files.read_batch(content, good)
    assert [r.content_hash for r in taken.collect()] == ["h1"] and refused.isEmpty()
    for change, why in (({"sha256": F.lit("0" * 64)}, "digest"), ({"rows": F.lit(2).cast("bigint")}, "row-count"), ({"file": F.lit("x.json")}, "missing")):
        taken, refused = files.read_batch(content, good.withColumns(change))
        assert taken.isEmpty() and [r.reason for r in refused.collect()] == [why]


def test_queue_cap_and_off_topic(spark):
    rows = [(i, f"f{i % 2}", f"q{i}", i % 3 != 0) for i in range(20)]
    items = spark.createDataFrame(rows, "id int, feed string, queue_id string, relevant boolean").withColumn("published", F.expr("timestampadd(DAY, id, timestamp'2024-01-01')")).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    got = {r.id: r.status for r in rq.select_newest(items, 4, "id").collect()}
    assert [i for i, s in got.items() if s == "queued"] == [19, 17, 16, 14] or sorted(i for i, s in got.items() if s == "queued") == [14, 16, 17, 19]
    assert all(got[i] == "off-topic" for i in range(0, 20, 3))


def sequential(posts, per_hour, per_day):
    out, times = {}, {}
    for channel, post, second, paused in sorted(posts, key=lambda p: (p[2], p[1])):
        mine = times.setdefault(channel, [])
        hour, day = sum(second - t < 3600 for t in mine), sum(t // 86400 == second // 86400 for t in mine)
        out[(channel, post)] = "blocked" if paused else "held" if hour >= per_hour or day >= per_day else "ready"
        if out[(channel, post)] == "ready":
            mine.append(second)
    return out


def test_stream_gate_equals_the_sequential_gate(spark):
    rng = random.Random(9)
    posts = [(f"c{rng.randrange(3)}", i, 1_700_000_000 + i * 400 + rng.randrange(300), rng.random() < 0.1) for i in range(300)]
    schema = "channel string, post_id bigint, second bigint, paused boolean"
    path = scratch_path(spark, "posts")
    for start in (0, 150):
        spark.createDataFrame(pd.DataFrame(posts[start : start + 150], columns=["channel", "post_id", "second", "paused"]), schema).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "out")
    jobs.rate_limit_stream(stream, 4, 30).writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "s")).trigger(availableNow=True).start(out).awaitTermination()
    got = {(r.channel, r.post_id): r.state for r in spark.read.parquet(out).collect()}
    assert got == sequential(posts, 4, 30)


def test_a_position_is_searched_once(spark):
    seen = []

    def look(places):
        seen.append(sorted((r.lon, r.lat) for r in places.collect()))
        return places.where("lon < 22").withColumn("found", F.col("lon") * 2)

    rows = [(i, [21.0, 22.5, None][i % 3], 36.0) for i in range(12)] + [(12, 21.0, None)]
    got = {r.id: r.found for r in geo.at_places(spark.createDataFrame(rows, "id int, lon double, lat double"), look).collect()}
    assert seen == [[(21.0, 36.0), (22.5, 36.0)]]
    assert got == {i: 42.0 if i < 12 and i % 3 == 0 else None for i in range(13)}


def test_points_that_repeat_keep_every_pair(spark):
    rows = [(i, 22.0, 36.5) for i in range(5)] + [(5, 50.0, 50.0), (6, None, 36.5)]
    table = spark.createDataFrame(rows, "id int, lon double, lat double")
    assert sorted((r.id, r.poly_id) for r in geo.points_in_poly(table, polygons(spark)).collect()) == [(i, 1) for i in range(5)]
    ref = spark.createDataFrame([(i, 22.00001, 36.5) for i in range(3)], "ref_id int, lon double, lat double")
    assert sorted((r.id, r.ref_id) for r in geo.coincident(table, ref, 5.0).select("id", "ref_id").collect()) == [(i, j) for i in range(5) for j in range(3)]
