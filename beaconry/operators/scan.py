"""Ordered operators without a single-task sort: numbering, running sums, first rows, newest rows.

A window over one hot key would put that key into one task. Here the order is cut into ranges or
buckets first, each piece is worked on alone, and only one small row per piece is combined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beaconry.session import cut_lineage, small_side

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order`` plus ``copies``; a partial aggregate runs before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), rank).alias("_row"), F.count(F.lit(1)).alias("copies")
    )
    return picked.select(*keys, "_row.*", "copies")


def mark_newest(df: DataFrame, order: list[Column], key: str, limit: int, column: str) -> DataFrame:
    """Boolean ``column``: is the row among the first ``limit`` rows in this order?

    The chosen keys are at most ``limit`` rows, so they are a bounded side of the join.
    """
    chosen = df.orderBy(*order).limit(limit).select(F.col(key), F.lit(True).alias(column))
    return df.join(small_side(chosen), key, "left").withColumn(column, F.coalesce(F.col(column), F.lit(False)))


def number_rows(df: DataFrame, order: list[Column], by: list[str] | None = None, column: str = "n") -> DataFrame:
    """``column`` = 1, 2, 3 … in ``order``, over the whole table or within each ``by`` group.

    The rows are range-partitioned on (by, order), so a hot group spreads over many tasks. The
    sorted rows are checkpointed: range bounds are sampled, and both reads must see the same ones.
    """
    by = by or []
    keys = [F.col(c) for c in by]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    tagged = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    runs = tagged.groupBy("_part", *by).agg(F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    same = reduce(
        lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["_part", *by]]
    )
    return (
        tagged.alias("t")
        .join(runs.alias("r"), same)
        .select(*[F.col(f"t.{c}") for c in df.columns], (F.col("_row") - F.col("_start") + F.col("_before") + 1).alias(column))
    )


def running_sums(
    df: DataFrame, by: list[str], order: list[str], bucket: Column, values: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums per ``by`` key in ``order``; ``bucket`` must not decrease along it.

    Each (key, bucket) is summed on its own; the totals of earlier buckets are added as a carry.
    """
    tagged = df.withColumn("_bucket", bucket)
    for name, value in values.items():
        tagged = tagged.withColumn(name, value)
    totals = tagged.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(n) for n in values])
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *by, "_bucket", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in values]
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(n).over(inside).alias(f"_local_{n}") for n in values]).drop(*values)
    joined = local.join(carry, [*by, "_bucket"])
    return joined.select(*df.columns, *[(F.col(f"_local_{n}") + F.col(f"_carry_{n}")).alias(n) for n in values])
