"""Uniform shuffle into shards of exact sizes (operator 4) by a hypergeometric communication matrix.

Law ``rows``: shard sizes differ by one row at most. The matrix says how many rows each input partition sends to each
cell, a cell being a slice of a shard small enough to order in one task. It is the exact multivariate hypergeometric
draw of a uniform permutation: partitions form a binary tree and each node splits its cell counts between its two
halves by a draw seeded with the node alone. So no task and no driver holds the matrix: a task walks from the root to
its own leaf and gets its row. It then permutes its rows locally, deals them to cells by the drawn counts, and after the
exchange each cell orders its rows, whole with all columns, by a second random key. Cells are small enough in rows and, on
average, in bytes; a single row may be longer. A retried task draws the same numbers, and its input is a
checkpoint, so lost executors change nothing.

Defined cases: a null text has no bytes; null ids, repeated rows and ties are rows like any other; fewer rows than
shards leave shards empty; an empty table gives an empty result; the operator keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.session import cut_lineage

SHARDS, SEED = 40, 2024
#: Rows that one task orders at once: cells are slices of shards with at most this many rows.
CELL_ROWS = 50_000
#: Bytes that a cell may hold on average.
CELL_BYTES = 32 * 1024 * 1024
#: Numpy draws exactly below this population; above it the draw inverts the distribution around its mode.
_NUMPY_POPULATION = 10**9


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """Stirling's series shifted by 8, so that small numbers are exact to double precision."""
    n = np.asarray(n, np.float64)
    x = n + 8
    series = (x + 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return series - sum(np.log(n + i) for i in range(1, 9))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good."""
    if good == 0 or drawn == 0:
        return 0
    if bad == 0:
        return drawn
    if good + bad < _NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, drawn))
    n = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    mean = drawn * (good / n)
    width = int(12 * (mean * (bad / n) * ((n - drawn) / (n - 1))) ** 0.5) + 30
    k = np.arange(max(low, int(mean) - width), min(high, int(mean) + width) + 1)
    logs = -(_log_factorial(k) + _log_factorial(good - k) + _log_factorial(drawn - k) + _log_factorial(bad - drawn + k))
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1])])


def split_counts(rng: np.random.Generator, cells: np.ndarray, drawn: int) -> np.ndarray:
    """Draw ``drawn`` rows without replacement from cells of the given sizes: a count for each cell."""
    out, rest = np.zeros_like(cells), int(cells.sum())
    for i in np.flatnonzero(cells):
        rest -= int(cells[i])
        out[i] = hypergeometric(rng, int(cells[i]), rest, drawn)
        drawn -= int(out[i])
        if drawn == 0:
            break
    return out


def matrix_row(partition: int, before: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """The partition's row of the matrix; ``before`` holds running row counts of all partitions, zero first."""
    low, high, mine = 0, len(before) - 1, cells.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = split_counts(np.random.default_rng([seed, low, high]), mine, int(before[middle] - before[low]))
        mine, low, high = (left, low, middle) if partition < middle else (mine - left, middle, high)
    return mine


def cell_sizes(rows: int, shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, shard, first slot) of every cell: shards at most one row apart, cut into near-equal cells."""
    size = np.full(shards, rows // shards, np.int64)
    size[: rows % shards] += 1
    parts = max(1, -(-int(size.max(initial=0)) // cell_rows))
    cells = (size[:, None] + np.arange(parts)[None, ::-1]) // parts
    return cells.ravel(), np.repeat(np.arange(shards), parts), (np.cumsum(cells, axis=1) - cells).ravel()


def row_bytes(rows: DataFrame):
    """About how many bytes a row has."""
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))]
    other = [F.col(f"`{c}`") if isinstance(rows.schema[c].dataType, T.BinaryType) else F.col(f"`{c}`").cast("string") for c in rows.columns if c not in plain]
    return sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in other), F.lit(8 * (1 + len(plain))).cast("long"))


def rows_of_cells(rows: int, size: int, cell_rows: int, cell_bytes: int) -> int:
    """Most rows of a cell when ``rows`` rows have ``size`` bytes together."""
    return max(1, min(cell_rows, rows * cell_bytes // max(1, size)))


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """All rows with two more columns, ``shard`` and ``slot``: a uniform permutation into exact shard sizes."""
    fixed = cut_lineage(rows)
    counted = fixed.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(fixed)).alias("size")).collect()  # two numbers per partition
    counts = np.zeros(max((r["p"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["p"]] = r["n"]
    before = np.concatenate([[0], np.cumsum(counts)])
    most = rows_of_cells(int(before[-1]), sum(r["size"] for r in counted), cell_rows, cell_bytes)
    cells, cell_shard, cell_slot = cell_sizes(int(before[-1]), shards, most)
    total = len(cells)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        if partition >= len(counts) or not counts[partition]:
            return
        row = matrix_row(partition, before, cells, seed)
        rng = np.random.default_rng([seed, partition])
        labels = rng.permutation(np.repeat(np.arange(total, dtype=np.int32), row))
        at = 0
        for batch in batches:
            mine = labels[at : at + batch.num_rows]
            at += batch.num_rows
            extra = [pa.array(mine), pa.array(cell_shard[mine].astype(np.int32)), pa.array(cell_slot[mine]), pa.array(rng.integers(0, 2**62, len(mine)))]
            yield pa.record_batch([*batch.columns, *extra], [*batch.schema.names, *new])

    new = [f"__{n}" for n in ("cell", "shard", "first", "key")]
    schema = T.StructType([*fixed.schema.fields, *(T.StructField(n, t) for n, t in zip(new, (T.IntegerType(), T.IntegerType(), T.LongType(), T.LongType()), strict=True))])
    sent = fixed.mapInArrow(dealt, schema)
    within = Window.partitionBy("__cell").orderBy("__key")
    slot = F.col("__first") + F.row_number().over(within) - 1
    keep = [F.col(f"`{c}`") for c in fixed.columns if c not in ("shard", "slot")]
    return sent.select(*keep, F.col("__shard").alias("shard"), slot.cast("long").alias("slot"))
