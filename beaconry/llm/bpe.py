"""Byte-level BPE encoding and decoding (operator 8) with a two-tier lookup.

Every match of the pre-token pattern is looked up whole in a minimal perfect hash over the vocabulary; a miss is merged
by a heap over linked bytes, lowest rank first and leftmost among equals. The tables are built on the driver from the
vocabulary file and broadcast: their size is that of the vocabulary, whatever the corpus. Workers remember pre-tokens
they resolved lately in a memo of bounded size, so the tiers run once per distinct pre-token and generation.

Defined cases: a null or empty text has no ids; very long texts are matched piece by piece; a long run without a break
costs n log n; repeated rows give repeated results; ids may be null; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from pathlib import Path

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from beaconry.llm.common import id_and_text

#: Pre-tokens a worker remembers before it starts over; texts longer than this are matched in slices of matches.
MEMO, LONG_TEXT, SLICE = 1_000_000, 2_000_000, 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of a base64 token and its rank."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class PerfectHash:
    """A minimal perfect hash by displacement: n keys fill n slots, and a stored key tells members from strangers.

    Keys fall into buckets; the fullest bucket first, each takes the smallest displacement that sends its keys to free
    slots. A bucket of one key stores its slot itself, as a negative number.
    """

    def __init__(self, values: dict[bytes, int]):
        self.n, self.buckets = len(values), max(1, len(values) // 3)
        groups: dict[int, list[bytes]] = {}
        for key in values:
            groups.setdefault(self._hash(key) % self.buckets, []).append(key)
        self.shift, self.keys, self.values = [0] * self.buckets, [b""] * self.n, [-1] * self.n
        taken, first_free = bytearray(self.n), 0
        for bucket, keys in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(keys) == 1:
                first_free = taken.find(0, first_free)
                slots, self.shift[bucket] = [first_free], -first_free - 1
            else:
                step = 0
                while True:
                    slots = [self._slot(self._hash(k), step) for k in keys]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    step += 1
                self.shift[bucket] = step
            for slot, key in zip(slots, keys, strict=True):
                taken[slot], self.keys[slot], self.values[slot] = 1, key, values[key]

    @staticmethod
    def _hash(key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key)

    def _slot(self, h: int, step: int) -> int:
        x = (h ^ (step * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
        return (x >> 24) % self.n

    def get(self, key: bytes) -> int | None:
        """The value of a member, None for any other key."""
        if not self.n:
            return None
        h = self._hash(key)
        step = self.shift[h % self.buckets]
        slot = -step - 1 if step < 0 else self._slot(h, step)
        return self.values[slot] if self.keys[slot] == key else None


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id, right id) packed in one number, to the id of the two together."""
    return {ranks[token[:i]] << 32 | ranks[token[i:]]: rank for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}


def merged(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge the ids of single bytes: lowest rank first, leftmost among equals.

    Parts are a linked list over byte places. The heap holds rank * n + place; an entry is stale unless its rank is the
    present rank of the pair that starts at its place.
    """
    n, look = len(ids), pairs.get
    rank_at = [look(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]  # noqa: B905 - one shorter
    heap = [rank * n + i for i, rank in enumerate(rank_at) if rank >= 0]
    if not heap:
        return ids
    heapify(heap)
    rank_at.append(-1)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        rank, i = divmod(heappop(heap), n)
        if rank_at[i] != rank:
            continue
        j = after[i]
        k = after[j]
        ids[i], ids[j], rank_at[j], after[i] = rank, -1, -1, k
        if k < n:
            before[k] = i
            rank_at[i] = new = look(rank << 32 | ids[k], -1)
            if new >= 0:
                heappush(heap, new * n + i)
        else:
            rank_at[i] = -1
        p = before[i]
        if p >= 0:
            rank_at[p] = new = look(ids[p] << 32 | rank, -1)
            if new >= 0:
                heappush(heap, new * n + p)
    return [i for i in ids if i >= 0]


class Codec(dict):
    """Pre-token to packed ids: a memo in front of the two tiers, and the way back."""

    def __init__(self, table: PerfectHash, pattern: str):
        super().__init__()
        self.table, self.find = table, regex.compile(pattern)
        ranks = dict(zip(table.keys, table.values, strict=True))
        self.pairs, self.tokens = pair_ranks(ranks), {rank: token for token, rank in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]

    def __missing__(self, pre_token: str) -> bytes:
        raw = pre_token.encode()
        whole = self.table.get(raw)
        packed = array("I", [whole] if whole is not None else merged([self.byte_ids[b] for b in raw], self.pairs)).tobytes()
        if len(self) >= MEMO:
            self.clear()
        self[pre_token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers in the byte order of the machine, little-endian on all Spark runs on."""
        if len(text) <= LONG_TEXT:
            return b"".join([self[w] for w in self.find.findall(text)])
        matches, out = self.find.finditer(text), []
        while some := [self[m.group()] for m in islice(matches, SLICE)]:
            out.append(b"".join(some))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in array("I", packed)])


#: Codecs of this Python worker by broadcast value, so that tasks of one query share a memo.
_CODECS: dict[int, Codec] = {}


def encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, packed as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast((PerfectHash(read_ranks(vocabulary)), pattern))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(of_batches, "doc_id long, ids binary")


def _codec(shared) -> Codec:
    table = shared.value  # one object per worker and broadcast
    if id(table) not in _CODECS:
        _CODECS.clear()
        _CODECS[id(table)] = Codec(*table)
    return _CODECS[id(table)]


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids alone."""
    shared = docs.sparkSession.sparkContext.broadcast((PerfectHash(read_ranks(vocabulary)), pattern))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            counts, ids, back = [], [], []
            for text in batch.column("text"):
                packed = codec.encode(text.as_py())
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(codec.decode(packed)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(of_batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
