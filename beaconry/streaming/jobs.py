"""Streaming jobs: incremental ingest, deduplication, late data, rate limiting, retention.

Every job takes an input stream and a sink path under a shared folder; state and offsets live in the
checkpoint folder the caller names, so a restarted job continues where it stopped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from beaconry.operators import dedup, rules
from beaconry.operators import review_queue as rq
from beaconry.session import cut_lineage
from beaconry.sinks import tables
from beaconry.sinks.keyed_store import KeyedStore
from beaconry.sources import files

LEDGER_DAYS = 90
HOUR, DAY = 3600, 86400


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Refusal(ValueError):
    """A published batch the tick will not take."""


def budget_reason(rows: Column, reviews: Column, max_rows: int, max_writes: int) -> Column:
    """Why a batch is too large for one tick: announced rows first, then the estimated writes."""
    writes = (rows + reviews) * rq.WRITES_PER_ROW
    return F.when(rows > max_rows, "too-many-rows").when(writes > max_writes, "write-budget")


def ingest_batch(
    spark: SparkSession, documents: DataFrame, pointers: DataFrame, store: str, rule_set: dict[str, str], max_rows: int, max_writes: int
) -> DataFrame:
    """Published batches into the signals and reviews tables; returns (batch_id, reason) of the refused ones.

    A batch that announces too many rows is refused before its file is opened; any other one is refused as a whole when it
    disagrees with its pointer, holds a bad row, or is over budget. Signals are written before reviews, both only where
    the key is new, so a replay is a no-op.
    """
    announced = F.coalesce(F.col("rows") > max_rows, F.lit(False))
    pointers = cut_lineage(pointers.withColumn("_over", announced))
    rows, refused = files.read_batch(documents, pointers.where("NOT _over").drop("_over"))
    refused = refused.unionByName(pointers.where("_over").select("batch_id", F.lit("too-many-rows").alias("reason")))
    rows = cut_lineage(rows)
    sizes = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("triage_status") == "queued").alias("q"))
    over = sizes.select("batch_id", budget_reason(F.col("n"), F.col("q"), max_rows, max_writes).alias("reason")).where("reason IS NOT NULL")
    broken = rules.validate(rows.withColumn("row_key", F.concat_ws("/", "batch_id", "content_hash")), "row_key", rule_set)
    bad = broken.select(F.substring_index("row_key", "/", 1).alias("batch_id"), F.lit("bad-row").alias("reason")).distinct()
    refused = cut_lineage(refused.unionByName(over).unionByName(bad).groupBy("batch_id").agg(F.min("reason").alias("reason")))
    good = rows.join(refused.select("batch_id"), "batch_id", "left_anti").drop("batch_id")
    tables.insert_absent(spark, f"{store}/signals", good, ["content_hash"], ["fetched_at"])
    promoted = rq.promote(good).withColumn("status", F.lit("queued"))
    tables.insert_absent(spark, f"{store}/reviews", promoted, ["content_hash"], ["status"])
    return refused


def ingest_stream(
    spark: SparkSession, arrivals: DataFrame, read_files: Callable[[DataFrame], DataFrame], store: str, checkpoint: str,
    rule_set: dict[str, str], max_rows: int = 1000, max_writes: int = 20_000,
) -> StreamingQuery:
    """Pointers arriving as a stream; each names a batch file that ``read_files`` opens."""

    def each(pointers: DataFrame, _: int) -> None:
        pointers = cut_lineage(pointers.dropDuplicates(["batch_id"]))
        refused = ingest_batch(spark, read_files(pointers), pointers, store, rule_set, max_rows, max_writes)
        tables.insert_absent(spark, f"{store}/refused", refused, ["batch_id"], ["reason"])

    return start(arrivals, each, checkpoint)


def exact_dedup(stream: DataFrame, key: str, at: str, days: int = LEDGER_DAYS) -> DataFrame:
    """First event per key with a memory of ``days``; state older than the watermark is dropped."""
    return stream.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark([key])


def near_dedup_stream(spark: SparkSession, items: DataFrame, ledger: str, kept: str, checkpoint: str, distance: int = dedup.NEAR_BITS) -> StreamingQuery:
    """Per micro-batch of (ord, queue_id, simhash, seen): exact and near exclusion against the stored ledger, first-wins inside
    the batch, then both outputs grow. A replayed batch does not see what it added itself, so it decides as before."""
    store = KeyedStore(spark, ledger, dedup.LEDGER)

    def each(batch: DataFrame, number: int) -> None:
        fresh = dedup.unlisted(cut_lineage(batch), store, distance, but=number)
        picked = cut_lineage(dedup.near_dedup(fresh, distance).select("ord", "queue_id", "simhash", "seen"))
        tables.insert_absent(spark, kept, picked.select("ord", "queue_id", "simhash"), ["queue_id"], ["ord"])
        store.add(dedup.ledger_rows(picked, distance), number)

    return start(items, each, checkpoint)


def late_and_future(items: DataFrame, now: Column, stale_days: int = 30, future_days: int = 1) -> DataFrame:
    """Stateless: implausible future dates become NULL, then items older than the window are marked stale."""
    published = F.when(F.col("published") <= now + F.make_dt_interval(F.lit(future_days)), F.col("published"))
    dated = items.withColumn("published", published)
    stale = F.coalesce(F.col("published") < now - F.make_dt_interval(F.lit(stale_days)), F.lit(False))
    return dated.withColumn("stale", stale)


def counted(items: DataFrame, name: str) -> DataFrame:
    """Counts per micro-batch come with the run's own metrics, at no extra pass."""
    return items.observe(name, F.count(F.lit(1)).alias("items"), F.count_if("stale").alias("stale"), F.count_if(F.col("published").isNull()).alias("undated"))


class ChannelGate(StatefulProcessor):
    """Sequential decision per channel: a post is released unless the released posts of the last hour or
    of its UTC day have reached the limit, or the channel is paused. Held posts do not count.

    Batches are slices of time, so a channel's rows of a batch are sorted and the state carries on from batch to batch: the
    release times that can still count, at most ``per_day`` of the day and ``per_hour`` of the hour before midnight. A
    timer at the moment the last of them stops counting clears the state of a channel that has fallen silent.
    """

    def __init__(self, per_hour: int, per_day: int) -> None:
        self.per_hour, self.per_day = per_hour, per_day

    def init(self, handle) -> None:
        from pyspark.sql.types import ArrayType, LongType, StructField, StructType

        self.handle = handle
        self.released = handle.getValueState("released", StructType([StructField("at", ArrayType(LongType()))]))

    @staticmethod
    def counts_until(second: int) -> int:
        """The first second at which a release no longer counts, neither in its hour nor in its day."""
        return max(second + HOUR, (second // DAY + 1) * DAY)

    def free_from(self, times, second: int) -> int:
        """The first second from ``second`` on at which one more release is within both limits, if none comes in between."""
        lately, today = sorted(t for t in times if second - t < HOUR), sum(1 for t in times if t // DAY == second // DAY)
        free = second
        if len(lately) >= self.per_hour:
            free = lately[len(lately) - self.per_hour] + HOUR
        return max(free, (second // DAY + 1) * DAY) if today >= self.per_day else free

    def decide(self, seconds, paused, times: deque) -> list[str]:
        """States of posts in their order; ``times`` is carried on. Posts up to the next free second are held without a look at each."""
        import numpy as np

        states = np.where(paused, "blocked", "held").astype(object)
        waiting = np.flatnonzero(~paused) if min(self.per_hour, self.per_day) > 0 else np.array([], dtype="int64")
        at, i = seconds[waiting], 0

        def forget(second: int) -> None:
            while times and self.counts_until(times[0]) <= second:
                times.popleft()

        while i < len(at):
            second = int(at[i])
            forget(second)
            free = self.free_from(times, second)
            if free > second:
                i += int(np.searchsorted(at[i:], free))
                continue
            states[waiting[i]] = "ready"
            times.append(second)
            i += 1
        if len(seconds):
            forget(int(seconds[-1]))
        return states.tolist()

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        posts = pd.concat([part[["post_id", "second", "paused"]] for part in rows], ignore_index=True).sort_values(["second", "post_id"])
        times = deque(self.released.get()[0] if self.released.exists() else ())
        before = len(times) and times[-1]
        states = self.decide(posts["second"].to_numpy(), posts["paused"].to_numpy(dtype=bool), times)
        self.released.update((list(times),))
        if times and times[-1] != before:
            self.handle.registerTimer(self.counts_until(times[-1]) * 1000)
        yield pd.DataFrame({"channel": key[0], "post_id": posts["post_id"].tolist(), "state": states})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        times = self.released.get()[0] if self.released.exists() else []
        if times and self.counts_until(times[-1]) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.released.clear()
        yield pd.DataFrame({"channel": [], "post_id": [], "state": []}).astype({"channel": str, "post_id": "int64", "state": str})

    def close(self) -> None:
        pass


def rate_limit_stream(posts: DataFrame, per_hour: int, per_day: int, late: str = "1 hour") -> DataFrame:
    """Posts (channel, post_id, second, paused), in slices of time, to (channel, post_id, state); the channel is the unit of work.

    Posts more than ``late`` behind the newest of an earlier slice are dropped, as the decisions after them are made.
    """
    timed = posts.withColumn("at", F.timestamp_seconds("second")).withWatermark("at", late)
    return timed.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=ChannelGate(per_hour, per_day), outputStructType="channel string, post_id bigint, state string", outputMode="Append", timeMode="EventTime"
    )
