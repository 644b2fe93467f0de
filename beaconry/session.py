"""Session settings and the few helpers that depend on the cluster the session runs on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when the optimizer's size estimate stays below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("beaconry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Every operator reads and prints timestamps in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``; unset, a temporary one on one machine only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None and context.getCheckpointDir() is None and not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="beaconry-"))
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for a table this run writes."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of an executor and the plan restarts here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def size_estimate(df: DataFrame) -> int:
    """The optimizer's size estimate in bytes; large when it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` when its estimated size allows it, otherwise leave the join to shuffle.

    Estimates do not see how far generators and collected arrays spread or pack rows, so sides with any are run and measured.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(word in plan for word in ("Generate", "collect_list", "collect_set")):
        return measured_side(df, limit)
    return F.broadcast(df) if size_estimate(df) <= limit else df


def measured_bytes(df: DataFrame) -> int:
    """The size of all rows as text, for tables whose estimate means nothing."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0


def measured_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``df``, run and checkpointed, with the join strategy its real size asks for.

    A side within ``limit`` is broadcast; any other one is hashed after a shuffle, which also keeps
    the optimizer from a broadcast of its own on an estimate that knows nothing of generators and arrays.
    """
    rows = cut_lineage(df)
    return F.broadcast(rows) if measured_bytes(rows) <= limit else rows.hint("shuffle_hash")


def spread(df: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """Use all cores when the input has fewer splits than cores; many-file inputs pass unchanged.

    With ``rows_a_task`` the rows are counted and dealt evenly, at most so many to a task and at least one task a core: the
    splits of a file follow its bytes, so that its tasks grow with it, and its row groups fill them unevenly.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows_a_task:
        return df.repartition(max(cores, -(-df.count() // rows_a_task)))
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df
