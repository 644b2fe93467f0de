"""Cross-tokenizer alignment (operator 13): which tokens of two tokenizers cover the same bytes of a text?

Both token sequences tile the bytes of a text, so their ends are two ascending lists, and merging them visits every pair of
overlapping tokens once. The merge path is cut into pieces of equal work: on every ``WORK``-th diagonal a binary search finds
how many ends of either list come before it. A piece is a row of its own, so a very long text is aligned by many tasks.

1. A map encodes every text with both tokenizers, compares the joined token bytes with the text, cuts the merge path and
   writes the pieces: their token ids, where they start, and the token of either side that is open at their end.
2. Pieces emit their overlaps. They are counted in tasks first, then by a shuffle on the id pair; counts are written as sorted
   arrays to the shared folder, at most one entry for each pair of vocabulary entries.
3. Pieces meet the counts, which workers memory-map, and render their groups. A text of one piece is done; pieces of longer
   texts carry what is open at their two edges and are stitched in order.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens, zeros and
an empty digest; null ids and repeated rows are documents like any other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm import mapped
from beaconry.llm.common import id_and_text, utf8_blocks
from beaconry.llm.packing import Encoder, byte_tokens
from beaconry.session import scratch_path

#: Merge steps of a piece, merge steps handled at once, pair counts a task gathers, files of the counts.
WORK, BLOCK, GATHERED, SHARDS = 1 << 18, 1 << 19, 2_000_000, 64
#: Bytes of text encoded at once.
TEXT_BLOCK = 1 << 20
PIECES = "key long, doc_id long, piece int, pieces int, a binary, b binary, a_next int, b_next int, lead int, tied boolean"


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, pattern: str, b_path: str):
        self.a = Encoder(a_path, pattern, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = byte_tokens(a_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of either side for every text; none where the joined bytes are not those of space and text."""
        nothing = np.zeros(0, np.int64)
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            if not text:
                yield nothing, nothing
                continue
            whole = " " + text
            a, raw = self.a.ids(whole), whole.encode()
            same = b"".join(map(self.b_bytes.__getitem__, b)) == raw and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw
            yield (a.astype(np.int64), np.array(array("i", b), np.int64)) if same else (nothing, nothing)


@lru_cache(1)
def _tokenizers(a_path: str, pattern: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, pattern, b_path)


def on_diagonal(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[int, int]:
    """How many entries of either ascending list are among the first ``steps`` of their merge; of equal ones a's is first."""
    low, high = max(0, steps - len(b)), min(steps, len(a))
    while low < high:
        middle = (low + high) // 2
        if a[middle] <= b[steps - 1 - middle]:
            low = middle + 1
        else:
            high = middle
    return low, steps - low


def cut_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> list[tuple[int, int]]:
    """Where the pieces of the merge of two lists of ends start, and the end of both."""
    total = len(a) + len(b)
    return [*(on_diagonal(a, b, s) for s in range(0, total, work)), (len(a), len(b))] if total else [(0, 0), (0, 0)]


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, a_path: str, pattern: str, b_path: str, work: int = WORK) -> DataFrame:
    """The pieces of every text.

    ``lead`` is how many bytes later the open token of side a starts than that of side b (negative: earlier); ``a_next`` and
    ``b_next`` are the tokens after the piece's own, -1 at the end; ``tied`` says that the piece before ends with a token
    of side a whose end the first token of side b shares.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(a_path, pattern, b_path)
        a_kind, b_kind = _kind(len(both.a_bytes)), _kind(len(both.b_bytes))
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
            for row, _, offsets in utf8_blocks(batch, "text", TEXT_BLOCK):
                texts = batch.column("text").slice(row, len(offsets) - 1).to_pylist()
                rows = []
                for i, (a, b) in enumerate(both.encoded(texts)):
                    a_ends, b_ends = np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b])
                    bounds = cut_path(a_ends, b_ends, work)
                    for n, ((i0, j0), (i1, j1)) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        lead = (a_ends[i0 - 1] if i0 else 0) - (b_ends[j0 - 1] if j0 else 0)
                        tied = bool(i0 and j0 < len(b) and a_ends[i0 - 1] == b_ends[j0])
                        following = (int(a[i1]) if i1 < len(a) else -1, int(b[j1]) if j1 < len(b) else -1)
                        rows.append((keys[row + i], ids[row + i], n, len(bounds) - 1, a[i0:i1].astype(a_kind).tobytes(), b[j0:j1].astype(b_kind).tobytes(), *following, int(lead), tied))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PIECE_KINDS, strict=True)], _PIECE_NAMES)

    keyed = id_and_text(docs).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    return keyed.mapInArrow(of_batches, PIECES)


_PIECE_NAMES = [f.split()[0] for f in PIECES.split(", ")]
_PIECE_KINDS = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[f.split()[1]] for f in PIECES.split(", ")]


class Merged:
    """Some pieces side by side, each on a byte line of its own: their overlaps, cuts and groups.

    ``first``/``second`` are the ids of every overlap, ``links_to`` and ``cuts_to`` count overlaps and common ends up to the end
    of each piece; ``side``, ``piece`` and ``cut`` run along the merged ends.
    """

    def __init__(self, batch: pa.RecordBatch, a_sizes: np.ndarray, b_sizes: np.ndarray):
        n = batch.num_rows
        self.a, a_counts = _ids(batch.column("a"), _kind(len(a_sizes)))
        self.b, b_counts = _ids(batch.column("b"), _kind(len(b_sizes)))
        lead = batch.column("lead").to_numpy().astype(np.int64)
        tied = batch.column("tied").to_numpy(zero_copy_only=False)
        self.a_to, self.b_to = np.cumsum(a_counts), np.cumsum(b_counts)
        a_long, b_long = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        a_before, b_before = _up_to(a_long, self.a_to), _up_to(b_long, self.b_to)
        a_start, b_start = np.maximum(lead, 0), np.maximum(-lead, 0)
        span = np.maximum(a_start + np.diff(a_before), b_start + np.diff(b_before)) + 1
        base = np.cumsum(span) - span
        self.a_piece, self.b_piece = np.repeat(np.arange(n), a_counts), np.repeat(np.arange(n), b_counts)
        self.a_ends = a_long + (base + a_start - a_before[:-1])[self.a_piece]
        self.b_ends = b_long + (base + b_start - b_before[:-1])[self.b_piece]
        # one line of ends: equal ends are neighbours, side a first; two ascending runs merge in linear time
        line = np.concatenate([self.a_ends * 2, self.b_ends * 2 + 1])
        line.sort(kind="stable")
        self.side, ends = line & 1, line >> 1
        of_a = 1 - self.side
        # the first end of a tied piece was merged with its equal by the piece before: a cut, and no overlap of its own
        early = np.searchsorted(line, self.b_ends[(self.b_to - b_counts)[tied & (b_counts > 0)]] * 2 + 1)
        twice = np.zeros(len(line), bool)
        twice[1:] = ends[1:] == ends[:-1]
        twice[early] = True
        fresh = ~twice
        to = self.a_to + self.b_to
        self.piece = np.repeat(np.arange(n), np.diff(to, prepend=0))
        piece = self.piece[fresh]
        self.first = _open(self.a, (np.cumsum(of_a) - of_a)[fresh], self.a_to, piece, batch.column("a_next").to_numpy())
        self.second = _open(self.b, (np.cumsum(self.side) - self.side)[fresh], self.b_to, piece, batch.column("b_next").to_numpy())
        self.links_to, self.cut = _up_to(np.cumsum(fresh), to)[1:], twice
        self.cuts_to = _up_to(np.cumsum(twice), to)[1:]

    def in_groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group, side, id, number up to each piece's end) of all tokens: by group, side a first; groups count from 0 in a piece."""
        before = np.concatenate([[0], self.cuts_to[:-1]])
        total = np.cumsum(self.cut) - self.cut + self.piece
        first = np.diff(total, prepend=-1) > 0
        start = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        a_before, b_before = np.cumsum(1 - self.side) - (1 - self.side), np.cumsum(self.side) - self.side
        of_a = np.add.reduceat(1 - self.side, start) if len(start) else start
        place = np.where(self.side == 0, a_before - a_before[start][number], of_a[number] + b_before - b_before[start][number]) + start[number]
        group, side, ids = (np.empty(len(place), np.int64) for _ in range(3))
        group[place], side[place] = total - (before + np.arange(len(before)))[self.piece], self.side
        ids[place[self.side == 0]], ids[place[self.side == 1]] = self.a, self.b
        return group, side, ids, self.a_to + self.b_to


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows in order, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind).astype(np.int64), np.diff(offsets).astype(np.int64) // width


def _up_to(sums: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Running sums before each piece, and at the end."""
    return np.concatenate([[0], sums])[np.concatenate([[0], to])]


def _open(ids: np.ndarray, at: np.ndarray, to: np.ndarray, piece: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The id of the token that is open at every end: the piece's own or the one after it."""
    beyond = at >= to[piece]
    out = following[piece].astype(np.int64)
    out[~beyond] = ids[at[~beyond]]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about BLOCK ids, and one piece at least."""
    for batch in batches:
        sizes = sum(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) for c in (batch.column("a"), batch.column("b")))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(sizes, sizes[row] + 2 * BLOCK, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def pair_counts(found: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """(pair, n): in how many overlaps two ids meet; a pair is the id of side a times the size of vocabulary b, plus the other."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(a_path, pattern, b_path)
        gathered: list[tuple[np.ndarray, np.ndarray]] = []

        def given(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["pair", "n"])

        for block in _blocks(batches):
            links = Merged(block, both.a_sizes, both.b_sizes)
            gathered.append(np.unique(links.first * len(both.b_sizes) + links.second, return_counts=True))
            if sum(len(k) for k, _ in gathered) > GATHERED:
                gathered = [_summed(gathered)]
                if len(gathered[0][0]) > GATHERED // 2:
                    yield given(*gathered.pop())
        if gathered:
            yield given(*_summed(gathered))

    return found.mapInArrow(of_batches, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Counts:
    """The counts of all pairs, in files by id of side a, and the highest count of every id of side b."""

    def __init__(self, folder: str, width: int, best: np.ndarray):
        self.folder, self.width, self.best = folder, width, best

    @staticmethod
    def _slots(pairs: np.ndarray, size: int) -> np.ndarray:
        return (pairs * 0x9E3779B97F4A7 >> 20) & (size - 1)

    def of(self, pairs: np.ndarray) -> np.ndarray:
        keys, values = _memo(self.folder)
        slots = self._slots(pairs, len(keys))
        out = values[slots]
        missed = np.flatnonzero(keys[slots] != pairs)
        if len(missed):
            distinct, back = np.unique(pairs[missed], return_inverse=True)
            found, shard = np.zeros(len(distinct), np.int64), distinct // self.width % SHARDS
            for s in np.unique(shard).tolist():
                mine = shard == s
                found[mine] = _shard(self.folder, s, "n")[np.searchsorted(_shard(self.folder, s, "pair"), distinct[mine])]
            out[missed] = found[back]
            # of pairs of one slot one is remembered
            slot, at = np.unique(self._slots(distinct, len(keys)), return_index=True)
            keys[slot], values[slot] = distinct[at], found[at]
        return out


@lru_cache(1)
def _memo(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a worker met lately and their counts, one for each slot."""
    return np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, np.int64)


@lru_cache(4 * SHARDS)
def _shard(folder: str, shard: int, name: str) -> np.ndarray:
    return mapped.get(folder, f"{shard}.{name}", "<i8")


def stored_counts(counts: DataFrame, width: int) -> Counts:
    """The counts as sorted arrays in the shared folder; the driver sees one number per entry of vocabulary b."""
    spark, folder = counts.sparkSession, scratch_path(counts.sparkSession, "pairs")
    path = scratch_path(spark, "pair-counts")
    counts.write.parquet(path)
    counts = spark.read.parquet(path)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def put() -> pa.RecordBatch:
            for name, column in zip(("pair", "n"), map(np.concatenate, zip(*parts, strict=True)), strict=True):
                mapped.put(folder, f"{shard}.{name}", column)
            return pa.record_batch([pa.array([shard], pa.int32())], ["shard"])

        for batch in batches:
            shards, pair, n = (batch.column(c).to_numpy() for c in ("shard", "pair", "n"))
            at = np.flatnonzero(np.diff(shards, prepend=-1)) if len(shards) else []
            for lo, hi in zip(at, [*at[1:], len(shards)], strict=False):
                if shards[lo] != shard and parts:
                    yield put()
                    parts = []
                shard = int(shards[lo])
                parts.append((pair[lo:hi], n[lo:hi]))
        if parts:
            yield put()

    sharded = counts.withColumn("shard", (F.floor(F.col("pair") / width) % SHARDS).cast("int"))
    sharded.repartition(SHARDS, "shard").sortWithinPartitions("shard", "pair").mapInArrow(of_batches, "shard int").count()
    best = np.zeros(width, np.int64)
    for row in counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("n")).toLocalIterator():
        best[row["b"]] = row["n"]
    return Counts(folder, width, best)


PART = "key long, doc_id long, piece int, pieces int, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, edges array<string>"
RESULT = [("doc_id", "long"), *((c, "long") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]
_SUMS = [c for c, k in RESULT[1:] if k == "long"]


@lru_cache(1)
def _spelled(size: int) -> list[str]:
    """Every id below ``size`` as text, followed by each of the separators in turn."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(size)]


def rendered(group: np.ndarray, side: np.ndarray, ids: np.ndarray) -> str:
    """Whole groups as text."""
    if not len(ids):
        return ""
    last = np.ones(len(ids), bool)
    last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    spelled = _spelled(1 << max(16, int(ids.max()).bit_length()))
    flat = ids + np.where(last, side + 1, 0) * (len(spelled) // 3)
    return "".join([spelled[i] for i in flat.tolist()])[:-1]


def edges(group: np.ndarray, side: np.ndarray, ids: np.ndarray, cuts: int) -> list[str]:
    """A piece of a longer text: both sides of its first group, its whole groups, both sides of its last; without a cut the first is the last."""
    def plain(which: np.ndarray) -> str:
        return ",".join(map(str, ids[which].tolist()))

    head = [plain((group == 0) & (side == s)) for s in (0, 1)]
    if not cuts:
        return head
    inner = (group > 0) & (group < cuts)
    return [*head, rendered(group[inner], side[inner], ids[inner]), *(plain((group == cuts) & (side == s)) for s in (0, 1))]


def stitched(parts: list[list[str]]) -> str:
    """The groups of a text from the edges of its pieces, in order."""
    done: list[str] = []
    a, b = [], []
    for part in parts:
        a += [part[0]] if part[0] else []
        b += [part[1]] if part[1] else []
        if len(part) > 2:
            done.append(f"{','.join(a)}|{','.join(b)}")
            done += [part[2]] if part[2] else []
            a, b = [part[3]] if part[3] else [], [part[4]] if part[4] else []
    return ";".join(done)


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest()


def described(found: DataFrame, counts: Counts, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """Sums and groups of every piece; the digest where the piece is a whole text, its edges where it is not."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(a_path, pattern, b_path)
        for block in _blocks(batches):
            links = Merged(block, both.a_sizes, both.b_sizes)
            n = counts.of(links.first * counts.width + links.second)
            best = n == counts.best[links.second]
            sums = [np.diff(_up_to(np.cumsum(x), links.links_to)) for x in (best.astype(np.int64), n)]
            group, side, ids, to = links.in_groups()
            cuts = np.diff(links.cuts_to, prepend=0)
            digests, fragments, start = [], [], 0
            for whole, end, c in zip((block.column("pieces").to_numpy() == 1).tolist(), to.tolist(), cuts.tolist(), strict=True):
                part = (group[start:end], side[start:end], ids[start:end])
                digests.append((_digest(rendered(*part)) if end > start else "") if whole else None)
                fragments.append(None if whole else edges(*part, c))
                start = end
            numbers = [np.diff(links.a_to, prepend=0), np.diff(links.b_to, prepend=0), cuts, np.diff(links.links_to, prepend=0), *sums]
            yield pa.record_batch([*(block.column(c) for c in ("key", "doc_id", "piece", "pieces")), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string()), pa.array(fragments, pa.list_(pa.string()))], [f.split()[0] for f in PART.split(", ")])

    return found.mapInArrow(of_batches, PART)


def _joined(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    parts = parts.sort_values("piece")
    return pd.DataFrame([{"doc_id": parts["doc_id"].iloc[0], **{c: int(parts[c].sum()) for c in _SUMS}, "groups_sha256": _digest(stitched(list(parts["edges"])))}]).astype({"doc_id": "Int64"})


def aligned(docs: DataFrame, a_path: str, pattern: str, b_path: str, work: int = WORK) -> DataFrame:
    """Per document: tokens of either side, groups, overlaps, overlaps of the highest count of their b id, and the digest of the groups."""
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned-pieces")
    pieces(docs, a_path, pattern, b_path, work).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    counts = stored_counts(pair_counts(found, a_path, pattern, b_path), width)
    names = [c for c, _ in RESULT]
    whole = described(found.where("pieces = 1"), counts, a_path, pattern, b_path).select(*names)
    cut = described(found.where("pieces > 1"), counts, a_path, pattern, b_path)
    long_texts = cut.groupBy("key").applyInPandas(_joined, ", ".join(f"{c} {k}" for c, k in RESULT))
    return whole.unionByName(long_texts)
