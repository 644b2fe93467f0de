"""Idempotent writers on Parquet tables: partitioned artifacts, insert-if-absent, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.operators.scan import first_by
from beaconry.session import cut_lineage


def write_run(candidates: DataFrame, path: str) -> None:
    """The whole run, one folder per day; nothing collected is lost, and a rerun replaces its day."""
    candidates.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_day").parquet(path)


def absent_rows(table: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch whose key is new, the first per key; existing rows are never changed."""
    fresh = batch.join(table.select(*key).distinct(), key, "left_anti")
    return first_by(fresh, key, order).select(*batch.columns)


def table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored table, or an empty one before the first write."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store; one that is gone already is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def insert_absent(spark: SparkSession, path: str, batch: DataFrame, key: list[str], order: list[str]) -> None:
    """Append the new keys of the batch; replaying the batch writes nothing."""
    rows = absent_rows(table_or_empty(spark, path, batch.schema), batch, key, order)
    cut_lineage(rows).write.mode("append").parquet(path)


def add_usage(table: DataFrame, delta: DataFrame) -> DataFrame:
    """Additive upsert per (day, service): units add up, the newest limit stays."""
    both = table.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    limit = F.max_by("daily_limit", F.when(F.col("daily_limit").isNotNull(), F.col("_new")))
    return both.groupBy("day", "service").agg(F.sum("units").alias("units"), limit.alias("daily_limit"))


def overwrite_days(table: DataFrame, path: str, day: str = "day") -> None:
    """Replace only the day folders the rows touch."""
    cut_lineage(table).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def upsert_state(state: DataFrame, results: DataFrame) -> DataFrame:
    """Job state after one result per job: success keeps the old cursor when it brings none and clears
    the failures; a failure counts up and keeps the cursor."""
    s, r = state.alias("s"), results.alias("r")
    joined = s.join(r, "job", "full_outer")
    ok, ran = F.col("r.ok"), F.col("r.ok").isNotNull()

    def pick(on_success: Column, on_failure: Column, untouched: str) -> Column:
        return F.when(~ran, F.col(untouched)).when(ok, on_success).otherwise(on_failure)

    return joined.select(
        "job",
        F.coalesce("r.ran_at", "s.last_run_at").alias("last_run_at"),
        pick(F.coalesce("r.cursor", "s.cursor"), F.col("s.cursor"), "s.cursor").alias("cursor"),
        pick(F.lit(0).cast("bigint"), F.coalesce("s.failures", F.lit(0)) + 1, "s.failures").cast("bigint").alias("failures"),
        pick(F.lit(None), F.col("r.error"), "s.last_error").alias("last_error"),
    )


def fan_out(messages: DataFrame, posted: DataFrame) -> DataFrame:
    """One row per (message, channel); a pair already in the log or repeated in the batch is not repeated."""
    rows = messages.select("idempotency_key", "text", "message_id", F.explode("channels").alias("channel"))
    return absent_rows(posted.select("idempotency_key", "channel"), rows, ["idempotency_key", "channel"], ["message_id"])


def write_grains(detail: DataFrame, path: str, group: str) -> None:
    """One run, several outputs: the detail table, its totals per group, and a summary without detail."""
    stored = f"{path}/detail"
    detail.write.mode("overwrite").parquet(stored)
    again = detail.sparkSession.read.parquet(stored)
    per_group = again.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    per_group.write.mode("overwrite").parquet(f"{path}/by_{group}")
    again.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups")).write.mode("overwrite").json(f"{path}/summary")


def batch_document(rows: DataFrame, batch_id: str, created_at: str, order: str) -> DataFrame:
    """One text row: the batch as JSON with sorted keys. ``rows`` are already capped, so one task holds them."""
    fields = sorted(c for c in rows.columns if c != order)
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("row")))).alias("r"))
    body = F.transform("r", lambda x: x["row"])
    document = F.struct(F.lit(batch_id).alias("batch_id"), F.lit(created_at).alias("created_at"), body.alias("rows"), F.lit("batch/1").alias("schema"))
    text = F.to_json(document, {"ignoreNullFields": "false"})
    return listed.select(F.concat(text, F.lit("\n")).alias("value"), F.size("r").alias("rows"))


def pointer(document: DataFrame, batch_id: str) -> DataFrame:
    """What a reader checks first: the file's name, digest and row count."""
    return document.select(F.lit(batch_id).alias("batch_id"), F.lit(f"{batch_id}.json").alias("file"), F.sha2("value", 256).alias("sha256"), F.col("rows").cast("bigint").alias("rows"))
