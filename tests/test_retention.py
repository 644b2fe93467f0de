"""Retention deletes: old days are gone, the boundary day is rewritten, and a stopped run is taken up."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from beaconry.sinks import retention

CUTOFF = "2024-01-03 12:00:00"


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.range(120).select("id", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id)").alias("created_at"))
    rows = rows.withColumn("created_date", F.to_date("created_at"))
    for part in range(3):  # several files a day
        rows.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").partitionBy("created_date").parquet(path)
    return path, rows


def left(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_old_days_go_and_a_rerun_does_nothing(spark, table):
    path, rows = table
    did = retention.expire(spark, path, CUTOFF)
    assert did.days == ["2024-01-01", "2024-01-02"] and len(did.files) == 3 and not did.resumed
    assert left(spark, path) == list(range(60, 120))
    assert sorted(p.name for p in Path(path).glob("created_date=*")) == ["created_date=2024-01-03", "created_date=2024-01-04", "created_date=2024-01-05"]
    before = sorted((p.name, p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet"))
    again = retention.expire(spark, path, CUTOFF)
    assert again == retention.Expired()
    assert sorted((p.name, p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet")) == before
    assert retention.surviving(spark, path, rows.schema).count() == 60


def test_files_are_rewritten_in_chunks_and_untouched_ones_stay(spark, table):
    path, _ = table
    late = spark.createDataFrame([(500,)], "id long").select("id", F.lit("2024-01-03 20:00:00").cast("timestamp").alias("created_at"), F.lit("2024-01-03").cast("date").alias("created_date"))
    late.write.mode("append").partitionBy("created_date").parquet(path)
    did = retention.expire(spark, path, CUTOFF, chunk_bytes=1)
    assert len(did.files) == 3
    assert left(spark, path) == [*range(60, 120), 500]


@pytest.mark.parametrize("stop", ["before", "between", "after"])
def test_a_stopped_run_is_taken_up(spark, table, monkeypatch, stop):
    path, _ = table
    whole = retention._move_in

    def broken(spark, store, folder, staged):
        if stop == "between":  # some of the old files are gone, nothing has moved in
            for r in spark.read.text(f"{staged}/replaced.names").collect()[:2]:
                store.remove(f"{folder}/{r.value}")
        if stop == "after":
            whole(spark, store, folder, staged)
        raise RuntimeError("lost")

    monkeypatch.setattr(retention, "_move_in", broken)
    with pytest.raises(RuntimeError):
        retention.expire(spark, path, CUTOFF)
    monkeypatch.setattr(retention, "_move_in", whole)
    did = retention.expire(spark, path, CUTOFF)
    assert did.resumed == (stop != "after")
    assert left(spark, path) == list(range(60, 120))
    assert not [p for p in Path(path).iterdir() if p.name.startswith(".expire")]
