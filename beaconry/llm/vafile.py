"""Exact top-k search (operator 11): a vector-approximation file.

Every distinct vector is kept twice: exactly, and as one cell number a dimension. Cells of a dimension hold about equally many
of its values, and the first and last reach to the extremes met, so every component lies in its cell. A cell bounds what a
component can add to an inner product, hence the cells of a vector bound its score from both sides.

1. Equal vectors become one, with the smallest ids that bear them (one more than the results asked for suffice), so copies
   are searched once however many there are.
2. Queries and approximations meet in blocks. Each unit of work scans its cells in a stream and keeps, per query, what can
   still be among the best: an upper bound not below the k-th best lower bound seen. The k-th best lower bound over all
   units then drops the rest.
3. Exact vectors are read in order of their upper bounds (the nearest possible first): the first few per query settle a score that
   the k-th result has at least, and only vectors whose upper bound reaches it are read after that. None of the others can
   be a result, so the search is exact.

Bounds are sums of products of whole numbers, exact in floating point below 2^53 (2^24 where single precision is used).
Queries are a stated set met in blocks; no pair of a query and a vector becomes a row before its bound is known.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of unequal length are compared
as if filled up with zeros; ids that are null are no queries and, as results, come after other ids of the same score; a
repeated row is a candidate for its twin; a query with fewer other rows than asked for gets them all; scaled components of
2^24 or more raise, as a long could not hold their products for certain; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.codebooks import filled, stored, whole_vectors
from beaconry.llm.common import looked_up

#: Results of a query, what components are multiplied by before they are floored, and bits of a cell number.
BEST, SCALE, BITS = 20, 64, 6
#: Queries and approximations of a block, approximations that one unit of work scans, and survivors held before they are given out.
QUERIES, CELLS, SCANNED, HELD = 1024, 4096, 1 << 20, 1 << 21
#: Exact vectors read first, as a multiple of the results.
FIRST_READ = 2
#: Scaled components from here on are too large.
TOO_LARGE = 1 << 24


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(num, key, v, ids): every vector once, with its k + 1 smallest ids. ``num`` numbers the rows of the stored table."""
    by_id = Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last())
    least = rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda s: s["vec_id"])
    once = least.groupBy("key").agg(F.first("v").alias("v"), ids.alias("ids"))
    return stored(once.select(F.monotonically_increasing_id().alias("num"), "key", "v", "ids"), "distinct-vectors")


def cell_edges(vectors: DataFrame, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) value of every cell by dimension: cells of about equally many values that together cover all.

    The driver sees one row a dimension.
    """
    cells = 1 << bits
    marks = F.percentile_approx("x", F.array(*(F.lit(i / cells) for i in range(1, cells))), F.lit(1000))
    values = vectors.select(F.posexplode("v").alias("d", "x"))
    least, greatest = np.zeros((width, cells), np.int64), np.zeros((width, cells), np.int64)
    for row in values.groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"), marks.alias("marks")).collect():
        # zeros that fill up shorter vectors are values too
        marks_ = np.unique(np.array(row["marks"], np.int64))
        starts = np.concatenate([[min(row["low"], 0)], marks_ + 1, np.full(cells - 1 - len(marks_), max(row["high"], 0) + 1)])
        least[row["d"]], greatest[row["d"]] = starts, np.concatenate([starts[1:] - 1, [max(row["high"], 0)]])
    return least, greatest


def _packed(cells: np.ndarray, bits: int) -> np.ndarray:
    """Two cell numbers a byte where they fit."""
    if bits > 4:
        return cells.astype("u1")
    even = np.pad(cells, ((0, 0), (0, cells.shape[1] % 2)))
    return (even[:, ::2] << 4 | even[:, 1::2]).astype("u1")


def _unpacked(packed: np.ndarray, width: int, bits: int) -> np.ndarray:
    if bits > 4:
        return packed
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :width]


def approximations(vectors: DataFrame, least: np.ndarray, bits: int) -> DataFrame:
    """(nums, cells) blocks: what is scanned instead of the vectors."""
    width = len(least)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CELLS):
                block = batch.slice(start, CELLS)
                v = filled(block.column("v"), width, TOO_LARGE)
                cells = np.stack([np.searchsorted(least[d], v[:, d], "right") - 1 for d in range(width)], axis=1)
                nums = block.column("num").to_numpy().astype("<i8")
                yield pa.record_batch([pa.array([nums.tobytes()], pa.binary()), pa.array([_packed(cells, bits).tobytes()], pa.binary())], ["nums", "cells"])

    return stored(vectors.select("num", "v").mapInArrow(of_batches, "nums binary, cells binary"), "approximations")


def _greatest(values: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of every row, in any order."""
    return values if values.shape[1] <= k else np.partition(values, values.shape[1] - k, axis=1)[:, -k:]


class Scan:
    """The queries of one unit and the best lower bounds they have met."""

    def __init__(self, nums: list[int], v: np.ndarray, k: int, kind):
        self.nums, self.k = np.array(nums, np.int64), k
        self.q, self.size = v.astype(kind), np.abs(v).astype(kind)
        self.best = np.zeros((len(v), 0), kind)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def floor(self) -> np.ndarray:
        """What a vector's upper bound must reach, by query."""
        return self.best.min(axis=1) if self.best.shape[1] == self.k else np.full(len(self.q), -np.inf)

    def meet(self, nums: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Twice the bounds: the middle of a cell's range, and its width, times the query."""
        middle, spread = self.q @ (low + high).T, self.size @ (high - low).T
        lower, upper = middle - spread, middle + spread
        self.best = _greatest(np.concatenate([self.best, _greatest(lower, self.k)], axis=1), self.k)
        query, at = np.nonzero(upper >= self.floor()[:, None])
        self.parts.append((query, nums[at], lower[query, at], upper[query, at]))
        self.held += len(query)

    def survivors(self) -> pa.RecordBatch:
        """What was held and still may be a result."""
        query, nums, lower, upper = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        open_ = upper >= self.floor()[query]
        self.parts, self.held = [], 0
        columns = (self.nums[query], nums, lower.astype(np.int64), upper.astype(np.int64))
        return pa.record_batch([pa.array(c[open_], pa.int64()) for c in columns], ["q", "c", "lower", "upper"])

    def settle(self) -> None:
        """Forget what a later floor has dropped."""
        query, _, _, upper = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        open_ = upper >= self.floor()[query]
        self.parts = [tuple(np.concatenate(c)[open_] for c in zip(*self.parts, strict=True))]
        self.held = int(open_.sum())


def survivors(queries: DataFrame, blocks: DataFrame, least: np.ndarray, greatest: np.ndarray, k: int, bits: int, sizes: tuple[int, int]) -> DataFrame:
    """(q, c, lower, upper): the vectors that may be among the k best of a query, with twice their bounds.

    ``sizes`` are the numbers of queries and of vectors. A unit is a block of queries and a group of approximations.
    """
    width, cores = len(least), queries.sparkSession.sparkContext.defaultParallelism
    of_queries = max(1, -(-sizes[0] // QUERIES))
    groups = max(-(-sizes[1] // SCANNED), min(-(-sizes[1] // CELLS), -(-2 * cores // of_queries)))
    limit = 2 * width * max(1, int(np.abs(least).max(initial=0)), int(np.abs(greatest).max(initial=0))) ** 2 * 2
    kind = np.float32 if limit < 1 << 24 else np.float64
    if limit >= 1 << 53:
        raise ValueError("inner products of these vectors are not exact in floating point")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nums, vectors, scan = None, [], [], None
        for batch in batches:
            kinds, units = batch.column("cells").is_valid().to_pylist(), list(zip(batch.column("block").to_pylist(), batch.column("share").to_pylist(), strict=True))
            for i, (is_cells, own) in enumerate(zip(kinds, units, strict=True)):
                if own != unit:
                    if scan is not None and scan.parts:
                        yield scan.survivors()
                    unit, nums, vectors, scan = own, [], [], None
                if not is_cells:
                    nums.append(batch.column("num")[i].as_py())
                    vectors.append(batch.column("v")[i].values.to_numpy())
                    continue
                if scan is None:
                    v = np.zeros((len(nums), width))
                    for row, x in zip(v, vectors, strict=True):
                        row[: len(x)] = x
                    scan = Scan(nums, v, k, kind)
                if not len(scan.nums):
                    continue
                met = np.frombuffer(batch.column("nums")[i].as_py(), "<i8")
                cells = _unpacked(np.frombuffer(batch.column("cells")[i].as_py(), "u1").reshape(len(met), -1), width, bits)
                for start in range(0, len(met), 1024):
                    some = cells[start : start + 1024]
                    d = np.arange(width)
                    scan.meet(met[start : start + 1024], least[d, some].astype(kind), greatest[d, some].astype(kind))
                    if scan.held > HELD:
                        scan.settle()
                        if scan.held > HELD // 2:
                            yield scan.survivors()
        if scan is not None and scan.parts:
            yield scan.survivors()

    shares = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("share")
    none = F.lit(None)
    asked = queries.select(F.pmod(F.xxhash64("num"), F.lit(of_queries)).cast("int").alias("block"), shares, "num", "v", none.cast("binary").alias("nums"), none.cast("binary").alias("cells"))
    dealt = blocks.withColumn("share", F.pmod(F.xxhash64("nums"), F.lit(groups)).cast("int"))
    scanned = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(of_queries - 1))).alias("block"), "share", none.cast("long").alias("num"), none.cast("array<int>").alias("v"), "nums", "cells")
    units = asked.unionByName(scanned).repartition(min(max(of_queries * groups, 1), 10_000), "block", "share")
    # queries of a unit come before its cells
    ordered = units.sortWithinPartitions("block", "share", F.col("cells").isNotNull())
    return ordered.mapInArrow(of_batches, "q long, c long, lower long, upper long")


def _scored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q, c, score): exact vectors are read for these pairs."""
    exact = vectors.select("num", "v")
    left = looked_up(pairs, exact.toDF("c", "vc"), ["c"], F.xxhash64("q"), 4)
    both = looked_up(left, exact.toDF("q", "vq"), ["q"], F.xxhash64("c"))
    n = F.least(F.size("vq"), F.size("vc"))
    product = F.zip_with(F.slice("vq", F.lit(1), n), F.slice("vc", F.lit(1), n), lambda x, y: x.cast("long") * y)
    return both.select("q", "c", F.aggregate(product, F.lit(0).cast("long"), lambda total, x: total + x).alias("score"))


def _place(by: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, bits: int = BITS) -> DataFrame:
    """(q, c, score) that hold the k best rows of every query vector; all of ``num``, stored ``vectors`` (num, v, ids)."""
    sizes = queries.count(), vectors.count()
    width = max(vectors.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0, 1)
    least, greatest = cell_edges(vectors, width, bits)
    blocks = approximations(vectors, least, bits)
    found = survivors(queries, blocks, least, greatest, k, bits, sizes)
    floors = found.withColumns({"by_lower": _place("q", F.col("lower").desc(), F.col("c"))})
    floor = F.coalesce(F.max(F.when(F.col("by_lower") == k, F.col("lower"))).over(Window.partitionBy("q")), F.lit(-(2**62)))
    open_ = floors.withColumn("floor", floor).where("upper >= floor").select("q", "c", "upper")
    ranked = stored(open_.withColumn("read", _place("q", F.col("upper").desc(), F.col("c"))), "survivors")
    early = F.col("read") <= FIRST_READ * k
    first = stored(_scored(ranked.where(early).select("q", "c"), vectors), "first-read")
    sure = first.withColumn("place", _place("q", F.col("score").desc(), F.col("c"))).where(F.col("place") == k).select("q", (F.col("score") * 2).alias("sure"))
    rest = looked_up(ranked.where(~early), sure, ["q"], F.xxhash64("c")).where("upper >= sure").select("q", "c")
    return first.unionByName(_scored(rest, vectors))


def best_of_each(vectors: DataFrame, every: int = 20, k: int = BEST, scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row whose id is divisible by ``every``."""
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = whole_vectors(chosen, scale).select("vec_id", F.col("v").cast("array<int>").alias("v"), F.md5(F.concat_ws(",", F.col("v").cast("array<string>"))).alias("key"))
    rows = stored(rows, "vectors")
    once = distinct_vectors(rows, k)
    asking = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key")
    asked = stored(once.join(asking.select("key").distinct(), "key", "left_semi").select("num", "v", "key"), "queries")
    # a query's own row takes one of the places
    best = nearest_vectors(asked.select("num", "v"), once, k + 1, bits)
    with_ids = looked_up(best, once.select(F.col("num").alias("c"), "ids"), ["c"], F.xxhash64("q")).select("q", "score", F.explode("ids").alias("vec_id"))
    top = with_ids.withColumn("place", _place("q", F.col("score").desc(), F.col("vec_id").asc_nulls_last())).where(F.col("place") <= k + 1)
    lists = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    lists = lists.join(asked.select(F.col("num").alias("q"), "key"), "q").select("key", "q", "found")
    answers = looked_up(asking, lists, ["key"], F.xxhash64("query_id"))
    own = looked_up(answers, once.select(F.col("num").alias("q"), F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + x.cast("long") * x).alias("norm")), ["q"], F.xxhash64("query_id"))
    # the row itself: its id, and the score of its vector with itself; a twin of both is as good, and just as high
    itself = F.filter("found", lambda s: (s["vec_id"] == F.col("query_id")) & (s["score"] == F.col("norm")))
    without = F.filter("found", lambda s: F.coalesce(s["place"] != F.get(itself, F.lit(0))["place"], F.lit(True)))
    listed = own.select("query_id", F.posexplode(F.slice(without, 1, k)).alias("at", "s"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))
