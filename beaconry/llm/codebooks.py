"""Vector code compression (operator 12): product codebooks by Lloyd rounds that look at active entries only.

A vector is cut into equal parts; every part position has a codebook, and a part's code is the index of its nearest entry.
A round assigns all parts, then moves every entry to the floor of the mean of its parts. After the first round a part whose
entry stayed where it was knows its exact distance already: it can only change to an entry that moved, so it is compared
with the moved entries alone. Parts whose entry moved are compared with all. Ties go to the lower index in both cases, so the
codes are those of complete scans.

The state of a round (vector, codes, exact distances) is a table in the shared folder, so a round is one map over it, a lost
task repeats its own rows, and the plan never grows. Sums per part position and entry are added up inside tasks first; the
driver sees one row for each entry of the codebooks, a number that parameters fix.

Defined cases: vectors that are null or hold null or non-finite components are left out; equal vectors and repeated ids are
rows like any other; among the smallest ids, rows without an id come last and rows of one id follow each other by their
components; fewer rows than entries make smaller codebooks; vectors whose length is not that of the longest, or not a
multiple of the number of parts, count as filled up with zeros; a scaled component of 2^28 or more, whose errors a long
could not hold, raises; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import looked_up
from beaconry.session import scratch_path

#: Parts of a vector, entries of a codebook, rounds, and what components are multiplied by before they are floored.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors handled at once, and the components that are too large.
BLOCK, TOO_LARGE = 4096, 1 << 28
STATE = "vec_id long, label string, v binary, codes binary, errors binary"


def whole_vectors(rows: DataFrame, scale: int, column: str = "embedding") -> DataFrame:
    """``rows`` with the floored multiple of every component as ``v``, without vectors that are null or hold null or non-finite components."""
    x = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    floored = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return rows.where(x.isNotNull() & finite).withColumn("v", floored)


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, index and component; ``moved`` marks those that the last update moved."""

    entries: np.ndarray
    moved: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of every part, the lower index among equals."""
    best, index = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
    for i, entry in enumerate(entries):
        distance = ((parts - entry) ** 2).sum(axis=1)
        closer = distance < best
        best[closer], index[closer] = distance[closer], i
    return index, best


def reassigned(parts: np.ndarray, codes: np.ndarray, errors: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and errors after entries moved; parts whose entry did not move meet the moved entries only."""
    codes, errors = codes.copy(), errors.copy()
    lost = moved[codes]
    if lost.any():
        codes[lost], errors[lost] = nearest(parts[lost], entries)
    kept = np.flatnonzero(~lost)
    if len(kept):
        own, code, error = parts[kept], codes[kept], errors[kept]
        for i in np.flatnonzero(moved).tolist():
            distance = ((own - entries[i]) ** 2).sum(axis=1)
            closer = (distance < error) | ((distance == error) & (i < code))
            code[closer], error[closer] = i, distance[closer]
        codes[kept], errors[kept] = code, error
    return codes, errors


def first_codebooks(kept: DataFrame, width: int, parts: int, entries: int) -> Codebooks:
    """The vectors of the smallest ids, as many as a codebook has entries."""
    least = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    filled = np.zeros((len(least), width), np.int64)
    for i, row in enumerate(least):
        filled[i, : len(row["v"])] = row["v"]
    return Codebooks(filled.reshape(len(least), parts, width // parts).transpose(1, 0, 2).copy(), np.ones((parts, len(least)), bool))


def filled(column: pa.Array, width: int, too_large: int = TOO_LARGE) -> np.ndarray:
    """Lists of long as the rows of a matrix, filled up with zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values[offsets[0] : offsets[-1]]
    if len(values) and max(out.max(initial=0), -out.min(initial=0)) >= too_large:
        raise ValueError(f"a scaled component of {too_large} or more: sums of its products do not fit in a long")
    return out


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.dtype.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary()) if width else pa.array([b""] * len(rows), pa.binary())


def _coded(rows: DataFrame, books: Codebooks, width: int, fresh: bool) -> DataFrame:
    """The state after one assignment; ``rows`` are vectors when ``fresh``, else the state before."""
    parts = books.entries.shape[0]
    per_part = width // parts

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                block = batch.slice(start, BLOCK)
                v = filled(block.column("v"), width) if fresh else _matrix(block.column("v"), "<i4").astype(np.int64)
                codes, errors = np.zeros((len(v), parts), np.int64), np.zeros((len(v), parts), np.int64)
                if not fresh:
                    codes, errors = _matrix(block.column("codes"), "u1").astype(np.int64), _matrix(block.column("errors"), "<i8").copy()
                for p in range(parts):
                    own = v[:, p * per_part : (p + 1) * per_part]
                    known = (own, codes[:, p], errors[:, p], books.entries[p], books.moved[p])
                    codes[:, p], errors[:, p] = nearest(own, books.entries[p]) if fresh else reassigned(*known)
                yield pa.record_batch([block.column("vec_id"), block.column("label"), _binary(v.astype("<i4")), _binary(codes.astype("u1")), _binary(errors)], [f.split()[0] for f in STATE.split(", ")])

    return rows.mapInArrow(of_batches, STATE)


def moved_to_means(state: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the floor of the mean of its parts; entries without a part stay."""
    parts, entries, per_part = books.entries.shape

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, per_part), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                v, codes = _matrix(batch.column("v"), "<i4"), _matrix(batch.column("codes"), "u1").astype(np.int64)
                for p in range(parts):
                    at, own = p * entries + codes[:, p], v[:, p * per_part : (p + 1) * per_part]
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    sums[at[order][first]] += np.add.reduceat(own[order].astype(np.int64), first, axis=0)
                counts += np.bincount((codes + np.arange(parts) * entries).ravel(), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["entry", "n", "sums"])

    partial = state.mapInArrow(of_batches, "entry int, n long, sums array<long>")
    totals = partial.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(per_part)))
    fresh = books.entries.reshape(parts * entries, per_part).copy()
    for row in totals.collect():
        fresh[row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(per_part)]
    fresh = fresh.reshape(books.entries.shape)
    return Codebooks(fresh, (fresh != books.entries).any(axis=2))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read again."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes, error) of every kept row, and the final codebooks."""
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    kept = stored(whole_vectors(chosen, scale).select("vec_id", "label", "v"), "vectors")
    longest = kept.agg(F.max(F.size("v")).alias("n")).first()["n"]
    width = -(-max(longest or 0, 1) // parts) * parts
    books = first_codebooks(kept, width, parts, entries)
    state = stored(_coded(kept, books, width, True), "codes") if longest is not None else _coded(kept, books, width, True)
    for _ in range(rounds if longest is not None else 0):
        books = moved_to_means(state, books)
        state = stored(_coded(state, books, width, False), "codes")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error = _matrix(batch.column("errors"), "<i8").sum(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), batch.column("codes"), pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    return state.mapInArrow(summed, "vec_id long, label string, codes binary, error long"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the error of all rows of its label; a label of very many rows meets its sum in several tasks."""
    rows = stored(coded.withColumns({"unlabelled": F.col("label").isNull(), "named": F.coalesce("label", F.lit(""))}), "errors")
    sums = rows.groupBy("unlabelled", "named").agg(F.sum("error").alias("label_error"))
    return looked_up(rows, sums, ["unlabelled", "named"], F.xxhash64("vec_id", "codes"))
