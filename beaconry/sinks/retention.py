"""Retention on a table partitioned by day: whole days go as folders, the boundary day is rewritten file by file.

Only files of the boundary day that hold rows before the cutoff are touched, in chunks of bounded size. A chunk's remaining rows
are written to a hidden folder beside the day together with the names of the files they replace; then those files go and the
new ones move in. A run that was stopped anywhere is taken up by the next: finished chunks are moved in, unfinished ones are
written anew. A run that finds nothing to do changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files rewritten together.
CHUNK_BYTES = 1 << 30
_STAGED, _REPLACED, _DONE = ".expire-", "replaced.names", "_SUCCESS"


@dataclass
class Expired:
    """What a run did: days dropped, files of the boundary day replaced, chunks taken up from an earlier run."""

    days: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    resumed: int = 0


class _Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def listed(self, path: str) -> dict[str, int]:
        """Names and sizes of what lies in a folder, none if it is not there."""
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self.at(path))} if self.fs.exists(self.at(path)) else {}

    def remove(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def note(self, path: str, lines: list[str]) -> None:
        out = self.fs.create(self.at(path), True)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()


def _move_in(spark: SparkSession, store: _Store, folder: str, staged: str) -> list[str]:
    """Replace files of a day by a finished chunk; safe to repeat from any point."""
    replaced = [r.value for r in spark.read.text(f"{staged}/{_REPLACED}").collect()]
    for name in replaced:
        store.remove(f"{folder}/{name}")
    for name in store.listed(staged):
        if name.startswith("part-"):
            store.fs.rename(store.at(f"{staged}/{name}"), store.at(f"{folder}/{name}"))
    store.remove(staged)
    return replaced


def _chunks(files: dict[str, int], limit: int) -> list[list[str]]:
    out, size = [], limit
    for name, length in sorted(files.items()):
        if size + length > limit:
            out, size = [*out, []], 0
        out[-1].append(name)
        size += length
    return out


def expire(spark: SparkSession, path: str, cutoff: str, day: str = "created_date", at: str = "created_at", chunk_bytes: int = CHUNK_BYTES) -> Expired:
    """Delete the rows of a table partitioned by ``day`` that are older than the instant ``cutoff`` (yyyy-MM-dd HH:mm:ss)."""
    path, store, did, boundary = path.rstrip("/"), _Store(spark, path), Expired(), cutoff[:10]
    names = store.listed(path)
    for staged in sorted(n for n in names if n.startswith(_STAGED)):
        inside, of_day = store.listed(f"{path}/{staged}"), staged.removeprefix(_STAGED)[:10]
        if _DONE in inside and _REPLACED in inside:
            did.files += _move_in(spark, store, f"{path}/{day}={of_day}", f"{path}/{staged}")
            did.resumed += 1
        else:
            store.remove(f"{path}/{staged}")
    for name in sorted(n for n in names if n.startswith(f"{day}=")):
        if name.split("=")[1] < boundary:
            store.remove(f"{path}/{name}")
            did.days.append(name.split("=")[1])
    folder = f"{path}/{day}={boundary}"
    files = {n: size for n, size in store.listed(folder).items() if n.startswith("part-")}
    if not files:
        return did
    limit = F.lit(cutoff).cast("timestamp")
    rows = spark.read.parquet(folder)
    old = rows.where(F.col(at) < limit).select(F.substring_index(F.input_file_name(), "/", -1).alias("file")).distinct()
    touched = {r.file: files[r.file] for r in old.collect()}
    for number, chunk in enumerate(_chunks(touched, chunk_bytes)):
        staged = f"{path}/{_STAGED}{boundary}-{number}"
        kept = spark.read.schema(rows.schema).parquet(*(f"{folder}/{n}" for n in chunk)).where(F.col(at) >= limit)
        kept.write.mode("overwrite").parquet(staged)
        store.note(f"{staged}/{_REPLACED}", chunk)
        did.files += _move_in(spark, store, folder, staged)
    return did


def surviving(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as it is now."""
    return spark.read.schema(schema).parquet(path)
