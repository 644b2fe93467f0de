"""Streaming queries: the sample tables are landed as files, streamed once with ``availableNow``, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import dims
from beaconry.operators import review_queue as rq
from beaconry.operators import text
from beaconry.plans.common import RUN_TS, SIGNALS, read, signals, squash_sql, stamp, stamp_sql
from beaconry.plans.io_plans import CHUNK, bundle_of, published
from beaconry.plans.queue_plans import STORE
from beaconry.plans.text_plans import NEAR_DEDUP_SQL, signed_docs
from beaconry.session import scratch_path
from beaconry.sinks import retention as expiry
from beaconry.sinks import tables
from beaconry.sources import files
from beaconry.streaming import jobs

ROW_RULES = {
    "url_shape": "url rlike '^https?://.'",
    "status_enum": "triage_status in ('pending', 'scored', 'queued')",
    "title_length": "length(title) <= 300",
}


def _land(spark, df, name: str, parts: int = 3):
    """Write ``df`` as a few files and open them as a file stream, one file per trigger batch."""
    path = scratch_path(spark, name)
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _land_in_order(spark, df, name: str, by: list[str], slices: int):
    """Write ``df`` as one file per slice of ``by``, one after the other, and open them as a file stream that takes them in this order."""
    parted, path = scratch_path(spark, f"{name}-slices"), scratch_path(spark, name)
    df.repartitionByRange(slices, *by).withColumn("slice", F.spark_partition_id()).write.partitionBy("slice").parquet(parted)
    for number in range(slices):
        rows = tables.table_or_empty(spark, f"{parted}/slice={number}", df.schema)
        rows.coalesce(1).write.mode("append").parquet(path)
    tables.remove_folder(spark, parted)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _ingested(spark, sf, max_rows: int, max_writes: int):
    path, store = scratch_path(spark, "published"), scratch_path(spark, "store")
    documents, _ = published(spark, sf, path)
    arrivals = spark.readStream.schema(files.POINTER).json(f"{path}/pointers")
    checkpoint = scratch_path(spark, "ingest-state")

    def opened(pointers):
        return documents.join(pointers.select(bundle_of(F.col("batch_id")).alias("bundle")), "bundle", "left_semi")

    jobs.ingest_stream(spark, arrivals, opened, store, checkpoint, ROW_RULES, max_rows, max_writes).awaitTermination()
    return store


def stream_ingest(spark, sf):
    """Stored signals and promoted reviews after the stream has taken every published batch."""
    store = _ingested(spark, sf, 1000, 20_000)
    stored = spark.read.parquet(f"{store}/signals").select("content_hash", F.lit("signal").alias("table"))
    return stored.unionByName(spark.read.parquet(f"{store}/reviews").select("content_hash", F.lit("review").alias("table")))


def stream_budget(spark, sf):
    """Refused batches by reason when a tick takes at most 8 rows or 24 writes."""
    store = _ingested(spark, sf, 8, 24)
    return spark.read.parquet(f"{store}/refused").groupBy("reason").agg(F.count(F.lit(1)).alias("batches"))


#: Fixture damage by the number in a batch id, and the row rules, in SQL: one row per stored row with its batch.
_BATCHES = f"""{STORE}, b AS (SELECT content_hash, triage_status, title, url, doc_id // {CHUNK} AS c, CAST('0x' || content_hash[8:9] AS INTEGER) AS k FROM stored),
in_batches AS (SELECT *, '2024-01-31-r' || k || 'x' || c AS batch_id FROM b),
sizes AS (SELECT batch_id, any_value(k) AS k, count(*) AS n, count(*) + CASE WHEN any_value(k) % 7 = 0 THEN 1 ELSE 0 END AS announced, count(*) FILTER (WHERE triage_status = 'queued') AS q,
  bool_or(NOT regexp_matches(url, '^https?://.') OR triage_status NOT IN ('pending', 'scored', 'queued') OR length(title) > 300) AS bad FROM in_batches GROUP BY 1),
opened AS (SELECT batch_id, n, q, announced, CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 5 = 0 THEN 'digest' WHEN k % 7 = 0 THEN 'row-count' END AS damage, bad FROM sizes)"""


def _verdicts_sql(max_rows: int, max_writes: int) -> str:
    held = f"CASE WHEN damage IS NOT NULL THEN damage WHEN bad THEN 'bad-row' WHEN n > {max_rows} THEN 'too-many-rows' WHEN (n + q) * {rq.WRITES_PER_ROW} > {max_writes} THEN 'write-budget' END"
    return f"verdicts AS (SELECT batch_id, CASE WHEN announced > {max_rows} THEN 'too-many-rows' ELSE {held} END AS reason FROM opened)"


STREAM_INGEST_SQL = f"""{_BATCHES}, {_verdicts_sql(1000, 20_000)}, good AS (SELECT * FROM in_batches JOIN verdicts USING (batch_id) WHERE reason IS NULL)
SELECT DISTINCT content_hash, 'signal' AS "table" FROM good UNION ALL SELECT DISTINCT content_hash, 'review' FROM good WHERE triage_status = 'queued'"""
STREAM_BUDGET_SQL = f"{_BATCHES}, {_verdicts_sql(8, 24)} SELECT reason, count(*) AS batches FROM verdicts WHERE reason IS NOT NULL GROUP BY 1"


def stream_dedup(spark, sf):
    """Distinct content keys through the 90-day dedup state; the batch twin is a plain distinct."""
    docs = text.content_keys(signals(spark, sf).withColumn("url", F.lit("https://one.example.org/")), "url", "text").select("queue_id", "published")
    out = scratch_path(spark, "dedup")
    unique = jobs.exact_dedup(_land(spark, docs, "dedup-in"), "queue_id", "published")
    query = unique.select("queue_id").writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "dedup-state")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema("queue_id string").parquet(out)


STREAM_DEDUP_SQL = f"SELECT DISTINCT substr(sha256('https://one.example.org/' || chr(10) || {squash_sql('text')}), 1, 12) AS queue_id FROM documents"


def stream_near_dedup(spark, sf):
    """Documents in order of arrival, in four batches against a ledger that grows; the batch twin decides one after the other."""
    signed = signed_docs(spark, sf).select(F.col("doc_id").alias("ord"), "queue_id", "simhash", F.to_date(F.lit(RUN_TS)).alias("seen"))
    ledger, kept = scratch_path(spark, "ledger"), scratch_path(spark, "kept")
    arrivals = _land_in_order(spark, signed, "near-in", ["ord"], 4)
    jobs.near_dedup_stream(spark, arrivals, ledger, kept, scratch_path(spark, "near-state")).awaitTermination()
    return spark.read.parquet(kept).select(F.col("ord").alias("doc_id"))


def stream_late(spark, sf):
    docs = signals(spark, sf).select("doc_id", "published")
    out = scratch_path(spark, "late")
    marked = jobs.counted(jobs.late_and_future(_land(spark, docs, "late-in"), text.run_instant("2024-02-10 00:00:00")), "late")
    marked.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "late-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("doc_id bigint, published timestamp, stale boolean").parquet(out).withColumn("published", stamp("published"))


STREAM_LATE_SQL = f"""WITH {SIGNALS}, d AS (SELECT doc_id, CASE WHEN published <= TIMESTAMP '2024-02-11' THEN published END AS published FROM signals)
SELECT doc_id, {stamp_sql('published')} AS published, coalesce(published < TIMESTAMP '2024-01-11', FALSE) AS stale FROM d"""


def retention(spark, sf):
    """What is left of a day-partitioned table of events after a retention run on the fifteenth at noon, read back from the table."""
    path = scratch_path(spark, "retention")
    rows = read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.to_date("ts").alias("created_date"))
    rows.repartition("created_date").write.partitionBy("created_date").parquet(path)
    expiry.expire(spark, path, "2024-01-15 12:00:00")
    return expiry.surviving(spark, path, rows.schema).select("event_id")


RETENTION_SQL = "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'"


def posts(spark, sf):
    """Events as posts; a third of all belong to one channel."""
    busy = F.when(F.col("event_id") % 3 == 0, F.lit("ch0"))
    return read(spark, sf, "events").select(
        F.coalesce(busy, F.concat(F.lit("ch"), (F.col("user_id") % 30).cast("string"))).alias("channel"), F.col("event_id").alias("post_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), (F.col("event_id") % 40 == 0).alias("paused"),
    )


#: A slice is a batch, and a batch starts a worker for each part of the state whatever it holds; a million posts are some 30 MB.
POSTS_OF_A_SLICE, LEAST_SLICES = 1_000_000, 12


def _start_with_parts(spark, writer, out: str, parts: int):
    """Start a stream whose state has at most ``parts`` parts; they are fixed at its start, and the session keeps its own number."""
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(int(own), parts)))
    try:
        return writer.start(out)
    finally:
        spark.conf.set(name, own)


def stream_rate_limit(spark, sf):
    """The posts in slices of time of bounded size, twelve at least, through the gate of their channel."""
    out = scratch_path(spark, "gate")
    waiting = posts(spark, sf)
    slices = max(LEAST_SLICES, -(-waiting.count() // POSTS_OF_A_SLICE))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    decided = jobs.rate_limit_stream(_land_in_order(spark, waiting, "gate-in", ["second", "post_id"], slices), *dims.CHANNEL_LIMITS)
    writer = decided.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch_path(spark, "gate-state")).trigger(availableNow=True)
    _start_with_parts(spark, writer, out, spark.sparkContext.defaultParallelism).awaitTermination()
    return spark.read.schema("channel string, post_id bigint, state string").parquet(out)


_HOUR_LIMIT, _DAY_LIMIT = dims.CHANNEL_LIMITS
STREAM_RATE_LIMIT_SQL = f"""WITH RECURSIVE posts AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'ch0' ELSE 'ch' || (user_id % 30) END AS channel, event_id AS post_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, event_id % 40 = 0 AS paused FROM events),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY second, post_id) AS i FROM posts),
walk AS (
  SELECT DISTINCT channel, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS post_id, CAST([] AS BIGINT[]) AS times, CAST(NULL AS VARCHAR) AS state FROM p
  UNION ALL
  SELECT channel, i, post_id, CASE WHEN state = 'ready' THEN list_append(times, second) ELSE times END, state FROM (
    SELECT p.channel, p.i, p.post_id, p.second, list_filter(w.times, lambda t: p.second - t < 3600 OR t // 86400 = p.second // 86400) AS times,
      CASE WHEN p.paused THEN 'blocked' WHEN len(list_filter(w.times, lambda t: p.second - t < 3600)) >= {_HOUR_LIMIT}
        OR len(list_filter(w.times, lambda t: t // 86400 = p.second // 86400)) >= {_DAY_LIMIT} THEN 'held' ELSE 'ready' END AS state
    FROM walk AS w JOIN p ON p.channel = w.channel AND p.i = w.i + 1))
SELECT channel, post_id, state FROM walk WHERE i > 0"""


QUERIES = {
    "stream_ingest": stream_ingest, "stream_budget": stream_budget, "stream_dedup": stream_dedup, "stream_near_dedup": stream_near_dedup,
    "stream_late": stream_late, "retention": retention, "stream_rate_limit": stream_rate_limit,
}
ORACLES = {
    "stream_ingest": STREAM_INGEST_SQL, "stream_budget": STREAM_BUDGET_SQL, "stream_dedup": STREAM_DEDUP_SQL, "stream_near_dedup": NEAR_DEDUP_SQL, "stream_late": STREAM_LATE_SQL, "retention": RETENTION_SQL, "stream_rate_limit": STREAM_RATE_LIMIT_SQL,
}
