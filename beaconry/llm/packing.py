"""Mixture-controlled packing (operator 6): source queues fill every window to target token proportions.

A queue holds its source's documents in a fixed order, as one stream of tokens. Queues are served in deficit round-robin
at token grain: the next token goes to the queue whose deficit (target so far minus served so far, relative to its
weight) is largest, so every window of ``window`` sequences receives each queue's share to within about one token and what
rounding leaves is carried to the next window. Queues of equal weight are due at the same time: with very many of them, a heavy
queue runs up to half a turn of all queues ahead or behind before deficits make up for it. The state after w windows, tokens served by each queue, has a closed form
(a divisor method with ties by queue order; an empty queue leaves its share to the others). A task that knows where its
documents lie in their queues therefore computes every window it touches alone: deficits carry across windows and
partitions without a sequential pass. Inside a window queues follow each other, and sequences are cut every ``length``
tokens; only the last sequence is short. Targets default to the sources' shares of all tokens, with which all queues run
dry together.

Tokenizing is one map whose ids are written once; offsets come from one small count per (partition, source). Every source
has a queue of its own. Up to ``MOST_QUEUES`` of them every task works out the states it needs; above, the states are a table of
what each window takes from each queue, and documents meet it by queue and block of tokens. Both ways give the same pieces.
The totals of the queues, two numbers per source, reach the driver.

Defined cases: a null or empty text is its end token; a null source is a queue of its own; repeated rows and null ids are
documents like any other; a text of any length is cut freely; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beaconry.operators.scan import number_rows
from beaconry.session import scratch_path

#: Tokens of a sequence, sequences of a window, and the id that ends a document.
LENGTH, WINDOW, END = 1024, 64, 0
#: Queues whose states every task works out itself; for more, states are a table.
MOST_QUEUES = 4096
#: Rows of the offset table (partitions times sources) that may be broadcast; above, the join is by shuffle.
MOST_BROADCAST = 500_000
#: Blanks in a row that the rank encoder is not given.
LONG_RUN = 100_000
_LONG_RUN = re.compile(r"\s{%d}" % LONG_RUN)
#: Numbers that a task remembers of the states it has worked out.
MOST_STATES = 2_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or the next character from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of every token of a byte-level BPE file, by id."""
    content = json.loads(Path(path).read_text())
    stand_in, added = _byte_characters(), {t["content"] for t in content.get("added_tokens", ())}
    vocabulary = content["model"]["vocab"] | {t["content"]: t["id"] for t in content.get("added_tokens", ())}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = token.encode() if token in added else bytes(stand_in[c] for c in token)
    return out


class Encoder:
    """The ids of a byte-level BPE file.

    When ids follow the order of merges, as in the public files, a rank encoder gives the same ids several times faster.
    Texts with the string of an added token, texts with a very long run of blanks, on which the rank encoder's pattern
    runs out of stack, and files of another kind go through the tokenizer itself.
    """

    def __init__(self, path: str, pattern: str, plain: bool = False):
        """With ``plain`` the strings of added tokens are text like any other."""
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        content = json.loads(Path(path).read_text())
        added = [t["content"] for t in content.get("added_tokens", ())]
        self.added = [] if plain else added
        vocabulary, merges = dict(content["model"]["vocab"]), content["model"].get("merges", [])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        order = [vocabulary[a + b] for a, b in pairs]
        self.fast = None
        if order == sorted(order) and content.get("pre_tokenizer", {}).get("type") == "ByteLevel" and not content.get("normalizer"):
            stand_in = _byte_characters()
            ranks = {bytes(stand_in[c] for c in token): i for token, i in vocabulary.items() if token not in added}
            if len(ranks) == 256 + len(order):
                self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added) or (len(text) > LONG_RUN and _LONG_RUN.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def tokenized(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """(doc_id, source, ids, n, part, at): ids with the end token, and the document's place in its partition's queue.

    ``at`` counts the tokens of the same source before it in the partition.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault((tokenizer, pattern), None) or Encoder(tokenizer, pattern)
        _ENCODERS[tokenizer, pattern] = encoder
        part, queued = TaskContext.get().partitionId(), {}
        for batch in batches:
            packed, counts, places = [], [], []
            for text, source in zip(batch.column("text"), batch.column("source").to_pylist(), strict=True):
                ids = np.append(encoder.ids(text.as_py()), END)
                packed.append(_pack(ids))
                counts.append(len(ids))
                places.append(queued.get(source, 0))
                queued[source] = places[-1] + len(ids)
            columns = [batch.column("doc_id"), batch.column("source"), pa.array(packed, pa.binary()), pa.array(counts, pa.int64()), pa.array([part] * len(counts), pa.int32()), pa.array(places, pa.int64())]
            yield pa.record_batch(columns, ["doc_id", "source", "ids", "n", "part", "at"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    return whole.mapInArrow(of_batches, "doc_id long, source string, ids binary, n long, part int, at long")


def _pack(ids: np.ndarray) -> bytes:
    """Two bytes an id where they suffice; the first byte says how many."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\4" + ids.astype("<u4").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype("<u4")


class Rounds:
    """How many tokens each queue has been served after any number of tokens.

    Token k of a queue with weight p is due at (2k + 1) / 2p; tokens are served by due time, then queue order, until a queue
    is dry. ``served`` finds the time in floating point and corrects the counts in exact arithmetic.
    """

    def __init__(self, totals: list[int], weights: list[int]):
        self.totals, self.weights = np.asarray(totals, np.int64), np.asarray(weights, np.int64)
        self.all = int(self.totals.sum())
        n, self.p = self.totals.astype(np.float64), self.weights.astype(np.float64)
        order = np.argsort(n / self.p, kind="stable")
        self.dry = (n / self.p)[order]
        self.done = np.concatenate([[0.0], np.cumsum(n[order])[:-1]])
        self.open_weight = np.cumsum(self.p[order][::-1])[::-1]
        self.served = lru_cache(max(256, MOST_STATES // max(1, len(n))))(lambda tokens: tuple(self.counts(tokens).tolist()))

    def counts(self, tokens: int) -> np.ndarray:
        if tokens >= self.all:
            return self.totals.copy()
        time = (tokens - self.done) / self.open_weight  # were all before dry and none after
        i = int(np.argmax(time <= self.dry)) if (time <= self.dry).any() else len(time) - 1
        counts = np.clip(np.floor(self.p * time[i] + 0.5).astype(np.int64), 0, self.totals)
        missing = tokens - int(counts.sum())
        if missing:
            self._correct(counts, missing)
        return counts

    def _correct(self, counts: np.ndarray, missing: int) -> None:
        """Serve the ``missing`` next tokens, or take back the last ones: exactly, among the queues that can hold them."""
        step, n = (1 if missing > 0 else -1), abs(missing)
        able = np.flatnonzero(counts < self.totals if step > 0 else counts > 0)
        due = step * (2 * counts[able] + step) / self.p[able]
        if len(able) > n:
            last = np.partition(due, n - 1)[n - 1]
            able = able[due <= last + abs(last) * 1e-12]

        def place(q: int) -> tuple[Fraction, int]:
            return step * Fraction(2 * int(counts[q]) + step, int(self.weights[q])), step * q

        heap = [place(q) for q in able.tolist()]
        heapq.heapify(heap)
        for _ in range(n):
            q = step * heapq.heappop(heap)[1]
            counts[q] += step
            if counts[q] < self.totals[q] if step > 0 else counts[q] > 0:
                heapq.heappush(heap, place(q))


def pieces_of(queue: int, first: int, last: int, rounds: Rounds, length: int, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, length, sequence, offset, window) of the stream range [first, last) of a queue."""
    size, at = length * window, first
    low, high = 0, -(-rounds.all // size)
    while high - low > 1:  # the window that serves token ``first``
        middle = (low + high) // 2
        low, high = (middle, high) if rounds.served(middle * size)[queue] <= first else (low, middle)
    w = low
    while at < last:
        before, after = rounds.served(w * size), rounds.served((w + 1) * size)
        end = min(last, after[queue])
        place = sum(after[:queue]) - sum(before[:queue]) + at - before[queue]
        while at < end:
            sequence, offset = divmod(place, length)
            n = min(end - at, length - offset)
            yield at - first, n, w * window + sequence, offset, w
            at, place = at + n, place + n
        w += 1


def states(spark: SparkSession, totals: np.ndarray, weights: np.ndarray, size: int) -> DataFrame:
    """(queue, block, lo, hi, place, window): tokens ``lo`` to ``hi`` of a queue start at ``place`` of a window of ``size`` tokens.

    ``block`` is that of ``lo``; only queues that the window serves have a row, so a window has at most ``size``.
    """
    windows = -(-int(totals.sum()) // size)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, at, now = Rounds(totals, weights), None, None
        for batch in batches:
            for w in batch.column("id").to_pylist():
                low = now if at == w else rounds.counts(w * size)
                at, now = w + 1, rounds.counts((w + 1) * size)
                queue = np.flatnonzero(now > low)
                lo, hi = low[queue], now[queue]
                columns = [queue, lo // size, lo, hi, np.cumsum(hi - lo) - (hi - lo), np.full(len(queue), w)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["queue", "block", "lo", "hi", "place", "window"])

    tasks = max(1, min(windows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, windows, 1, tasks).mapInArrow(of_batches, "queue long, block long, lo long, hi long, place long, window long")


def _met(placed: DataFrame, served: DataFrame, length: int, window: int) -> DataFrame:
    """The pieces of documents that meet the states of their queues block by block of tokens.

    What a window takes lies in its block and the next, so a document goes to its blocks and the one before, each time with
    no more ids than these two blocks hold.
    """
    size = length * window
    block = F.explode(F.sequence(F.greatest(F.lit(0), F.expr(f"first div {size} - 1")), F.expr(f"(first + n - 1) div {size}"))).alias("block")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, skipped = [], []
            for ids, first, n, b in zip(batch.column("ids"), *(batch.column(c).to_pylist() for c in ("first", "n", "block")), strict=True):
                a, z = max(0, b * size - first), max(0, min(n, (b + 2) * size - first))
                skipped.append(a)
                parts.append(_unpack(ids.as_py())[a:z].tobytes())
            columns = [batch.column(c) for c in ("doc_id", "source", "queue", "first", "n", "block")]
            yield pa.record_batch([*columns, pa.array(skipped, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "source", "queue", "first", "n", "block", "skipped", "part"])

    def cut(docs: pa.Table, taken: pa.Table) -> pa.Table:
        taken, rows = taken.sort_by("lo"), []
        lo, hi, place, number = (taken[c].to_numpy() for c in ("lo", "hi", "place", "window"))
        for doc, source, first, n, skipped, part in zip(*(docs[c].to_pylist() for c in ("doc_id", "source", "first", "n", "skipped", "part")), strict=True):
            ids = np.frombuffer(part, "<u4")
            for k in range(int(np.searchsorted(hi, first, "right")), int(np.searchsorted(lo, first + n, "left"))):
                at, end, w = max(first, int(lo[k])), min(first + n, int(hi[k])), int(number[k])
                spot = int(place[k]) + at - int(lo[k])
                while at < end:
                    sequence, offset = divmod(spot, length)
                    m = min(end - at, length - offset)
                    start = at - first
                    rows.append((doc, start, m, zlib.crc32(ids[start - skipped : start - skipped + m]), n, w * window + sequence, offset, source, w))
                    at, spot = at + m, spot + m
        columns = zip(*rows, strict=True) if rows else [[]] * 9
        return pa.table([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(columns)], names=[f.split()[0] for f in PIECES.split(", ")])

    parts = placed.select("*", block).mapInArrow(sliced, "doc_id long, source string, queue long, first long, n long, block long, skipped long, part binary")
    return parts.groupBy("queue", "block").cogroup(served.groupBy("queue", "block")).applyInArrow(cut, PIECES)


def packed(docs: DataFrame, tokenizer: str, pattern: str, targets: dict[str, int] | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Every piece of every document with its sequence and offset; ``targets`` are whole-number weights by source."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    tokenized(docs, tokenizer, pattern).write.mode("overwrite").option("compression", "zstd").parquet(path)
    tokens = spark.read.parquet(path)
    counts_path, queues_path = scratch_path(spark, "counts"), scratch_path(spark, "queues")
    tokens.groupBy("part", "source").agg(F.sum("n").alias("n")).write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    queues = number_rows(counts.groupBy("source").agg(F.sum("n").alias("n")), [F.col("source").asc_nulls_last()], column="queue")
    weight = F.col("n")
    if targets:
        wanted = spark.createDataFrame([(s, max(1, int(w))) for s, w in targets.items()], "w_source string, weight long")
        queues, weight = queues.join(wanted, F.col("source").eqNullSafe(F.col("w_source")), "left"), F.coalesce("weight", F.lit(1))
    queues.select("source", (F.col("queue") - 1).cast("long").alias("queue"), "n", weight.cast("long").alias("weight")).write.parquet(queues_path)
    queues = spark.read.parquet(queues_path)
    known = queues.select("queue", "n", "weight").toArrow().sort_by("queue")  # two numbers per source
    rounds = known["n"].to_numpy(), known["weight"].to_numpy()
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = base.join(queues.select(F.col("source").alias("q_source"), "queue"), F.col("source").eqNullSafe(F.col("q_source")))
    base = base.select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "queue", "base")
    if counts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        base = F.broadcast(base)
    placed = tokens.join(base, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source")))
    placed = placed.select("doc_id", "source", "queue", (F.col("base") + F.col("at")).alias("first"), "n", "ids")
    if len(known) > MOST_QUEUES:
        return _met(placed, states(spark, *rounds, length * window), length, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Rounds(*rounds)
        for batch in batches:
            rows = []
            ids_column = batch.column("ids")
            for i, (doc, source, q, first, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "queue", "first", "n")), strict=True)):
                ids = _unpack(ids_column[i].as_py())
                for start, size, sequence, offset, w in pieces_of(q, first, first + n, state, length, window):
                    rows.append((doc, start, size, zlib.crc32(ids[start : start + size]), n, sequence, offset, source, w))
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            yield pa.record_batch([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(columns)], [f.split()[0] for f in PIECES.split(", ")])

    return placed.mapInArrow(cut, PIECES)
