"""Ordered and near-duplicate operators against brute force on small random tables."""

import random
import re
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from beaconry.operators import dedup, scan
from beaconry.session import scratch_path
from beaconry.sinks.keyed_store import KeyedStore


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def clustered(n, seed):
    """Signatures in tight clusters, so that both near and exact pairs are frequent."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = []
    for _ in range(n):
        value = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            value ^= 1 << rng.randrange(64)
        out.append(signed(value))
    return out


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def near_set(values, limit):
    return {(a, b) for a in values for b in values if a < b and distance(a, b) <= limit}


def test_near_pairs_equal_brute_force_with_and_without_crowded_buckets(spark):
    values = sorted(set(clustered(150, 1)))
    table = spark.createDataFrame([(v,) for v in values], "hash bigint")
    for limit in (1, 3):
        for crowded in (1000, 4):
            got = {tuple(r) for r in dedup.near_pairs(table, distance=limit, crowded=crowded).collect()}
            assert got == near_set(values, limit)


def stored_ledger(spark, rows):
    ledger = KeyedStore(spark, scratch_path(spark, "ledger"), dedup.LEDGER, buckets=16)
    for batch, part in enumerate(rows):
        table = spark.createDataFrame(part, "queue_id string, simhash bigint, day string").withColumn("seen", F.to_date("day"))
        ledger.add(dedup.ledger_rows(table), batch)
    return ledger


def test_the_ledger_ignores_zero_and_negative_distance(spark):
    items = spark.createDataFrame([(1, "a", 0), (2, "b", 7), (3, "c", 0x5555 << 32), (4, "y", 1 << 60)], "ord bigint, queue_id string, simhash bigint")
    ledger = stored_ledger(spark, [[("x", 0, "2024-01-01"), ("y", 6, "2024-01-02")]])
    assert {r.ord for r in dedup.unlisted(items, ledger).collect()} == {1, 3}
    assert {r.ord for r in dedup.unlisted(items, ledger, distance=-1).collect()} == {1, 2, 3}


def test_a_grown_ledger_is_read_in_touched_buckets(spark):
    values = sorted(set(clustered(120, 4)))
    first, second = values[::2], values[1::2]
    ledger = stored_ledger(spark, [[(f"f{v}", v, "2024-01-01") for v in first], [(f"s{v}", v, "2024-01-05") for v in second]])
    items = spark.createDataFrame([(f"n{v}", v ^ 5) for v in values] + [("far", 0x7777 << 20)], "queue_id string, simhash bigint")
    assert {r.queue_id for r in dedup.unlisted(items, ledger).collect()} == {f"n{v}" for v in values if not any(distance(v ^ 5, w) <= 3 for w in values)} | {"far"}
    # what a batch added itself is out of its sight
    own = {r.queue_id for r in dedup.unlisted(items, ledger, but=1).collect()}
    assert own == {f"n{v}" for v in values if not any(distance(v ^ 5, w) <= 3 for w in first)} | {"far"}
    # a lookup of few keys opens the files of their buckets only: all others may be broken
    row = ledger.rows().withColumn("file", F.input_file_name()).where("choice = -1").first()
    bucket = row.file.rsplit("_", 1)[1]
    few = ledger.matching(spark.createDataFrame([(row.key,)], "key bigint"))
    others = [f for f in Path(ledger.path.removeprefix("file:")).rglob("part-*.parquet") if not f.name.endswith(f"_{bucket}")]
    assert len(others) > 10
    for file in others:
        file.write_bytes(b"broken")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert [r.queue_id for r in few.where("choice = -1").collect()] == [row.queue_id]
    many = ledger.matching(spark.range(1000).select(F.xxhash64("id").alias("key")))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2, "the new side is made distinct and dealt; the stored side stays where it is"


def test_old_days_leave_the_ledger_as_folders(spark):
    ledger = stored_ledger(spark, [[("a", 1, "2024-01-01"), ("b", 1 << 30, "2024-01-09")], [("c", 1 << 50, "2024-01-02")]])
    assert ledger.expire(date(2024, 1, 5)) == [date(2024, 1, 1), date(2024, 1, 2)]
    assert ledger.expire(date(2024, 1, 5)) == []
    assert {r.queue_id for r in ledger.rows().where("choice = -1").collect()} == {"b"}
    assert [x.name for x in Path(ledger.path.removeprefix("file:")).glob("seen=*")] == ["seen=2024-01-09"]
    again = KeyedStore(spark, ledger.path, dedup.LEDGER, buckets=16)
    assert again.rows().where("choice = -1").count() == 1


def test_near_dedup_equals_the_sequential_loop(spark):
    rng = random.Random(5)
    rows = [(i, f"id{rng.randrange(90)}", 0 if rng.random() < 0.05 else v) for i, v in enumerate(clustered(160, 2))]
    kept, ids, hashes = [], set(), []
    for order, name, value in rows:
        if name in ids or (value and any(distance(value, h) <= 3 for h in hashes)):
            continue
        kept.append(order)
        ids.add(name)
        if value:
            hashes.append(value)
    table = spark.createDataFrame(rows, "ord bigint, queue_id string, simhash bigint")
    assert sorted(r.ord for r in dedup.near_dedup(table, crowded=20).collect()) == kept


def test_a_dropped_item_suppresses_nothing(spark):
    # 0 - 3 bits - 7 - 3 bits - 63: the middle goes, the last is six bits from the first and stays.
    rows = [(1, "a", 1 << 20), (2, "b", (1 << 20) | 7), (3, "c", (1 << 20) | 63)]
    table = spark.createDataFrame(rows, "ord bigint, queue_id string, simhash bigint")
    assert sorted(r.ord for r in dedup.near_dedup(table).collect()) == [1, 3]


def test_number_rows_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 1009) for i in range(1009)]
    table = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = {(r.g, r.v): r.n for r in scan.number_rows(table, [F.col("v")], ["g"]).collect()}
    for group in {g for g, _ in rows}:
        for rank, value in enumerate(sorted(v for g, v in rows if g == group), start=1):
            assert got[(group, value)] == rank
    assert sorted(r.n for r in scan.number_rows(table, [F.col("v").desc(), F.col("g")]).collect()) == list(range(1, 1010))


def test_running_sums_cross_buckets(spark):
    table = spark.createDataFrame([("k", i, i % 5) for i in range(97)], "k string, i int, v int")
    got = {r.i: r.s for r in scan.running_sums(table, ["k"], ["i"], F.floor(F.col("i") / 10), {"s": F.col("v")}).collect()}
    total = 0
    for i in range(97):
        total += i % 5
        assert got[i] == total


def test_keys_are_never_broadcast(spark, tmp_path):
    """Rows are many keys each, which size estimates do not see: a small-looking side may be millions of keys."""
    values = spark.range(100).select(F.xxhash64("id").alias("hash"))
    ledger = KeyedStore(spark, str(tmp_path / "ledger"), dedup.LEDGER, buckets=4)
    ledger.add(dedup.ledger_rows(values.select(F.hex("hash").alias("queue_id"), F.col("hash").alias("simhash"), F.to_date(F.lit("2024-01-01")).alias("seen"))), 0)
    for frame in (dedup.near_pairs(values), dedup.near_pairs(values, values), ledger.matching(dedup.keyed(values))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
