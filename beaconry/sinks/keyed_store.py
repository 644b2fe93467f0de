"""A stored table that grows by appends and is looked up by key, without reading or shuffling it as a whole.

Rows are bucketed by ``key`` and partitioned by the day they were seen. A lookup of few keys names them, so that only their
buckets are read; a lookup of many joins the buckets where they lie, and only the new side is shuffled. Rows carry the number of
the batch that brought them: a batch that is replayed leaves its own rows out of sight and decides as it did before. Old
days go as whole folders.
"""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.sinks.tables import remove_folder

#: Keys up to which a lookup names them.
NAMED_KEYS = 400


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = 64) -> None:
        """``columns`` in DDL, beside ``key bigint``, ``batch bigint`` and ``seen date``."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = f"keyed_{hashlib.md5(self.path.encode()).hexdigest()}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (key BIGINT, {columns}, batch BIGINT, seen DATE) USING parquet "
            f"OPTIONS (path '{self.path}') PARTITIONED BY (seen) CLUSTERED BY (key) INTO {buckets} BUCKETS"
        )
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def rows(self, but: int | None = None) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)  # another session, that of a stream, may have added files
        table = self.spark.table(self.name)
        return table if but is None else table.where(F.col("batch") != but)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Append ``rows`` (all columns but ``batch``); each bucket of a day gets one file."""
        numbered = rows.withColumn("batch", F.lit(batch).cast("long")).select(*self.rows().columns)
        numbered.repartition(self.buckets, "key").write.insertInto(self.name)

    def matching(self, keys: DataFrame, but: int | None = None) -> DataFrame:
        """Stored rows whose key is among ``keys`` (key), leaving out batch ``but``."""
        wanted = keys.select("key").distinct()
        few = [r["key"] for r in wanted.limit(NAMED_KEYS + 1).collect()]
        if len(few) <= NAMED_KEYS:
            return self.rows(but).where(F.col("key").isin(few))
        return self.rows(but).join(wanted.hint("merge"), "key", "left_semi")  # keys made from rows are more than size estimates say

    def expire(self, before: date) -> list[date]:
        """Drop the days before ``before``; the days dropped. A rerun finds none."""
        days = [r[0].split("=")[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]
        old = sorted(date.fromisoformat(d) for d in days if d[:1].isdigit() and date.fromisoformat(d) < before)
        for day in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (seen = DATE '{day}')")
            remove_folder(self.spark, f"{self.path}/seen={day}")
        return old
