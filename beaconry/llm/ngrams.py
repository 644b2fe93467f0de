"""Language-model scoring (operator 5): an interpolated modified Kneser-Ney bigram model.

Three Spark jobs count: words, then pairs of word numbers, then in how many contexts a word occurs. Each map task counts
its own texts first and sends sorted runs, delta-coded and compressed, one per shard; so a frequent word or pair crosses
the shuffle once per task, and a shard is merged with vector operations. The model is a set of sorted arrays in the
shared folder (hashes of words, pairs of word numbers, counts), a file per shard and kind. Scoring is one map over all
texts whose workers memory-map the files and look up the distinct words and pairs of a block by binary search: pages that
are used stay in the page cache of the machine, shared by its workers, and none of the model passes through the driver,
which sees one row of totals per shard.

Words are known by 64-bit hashes and numbered by their order. Discounts follow from the counts of counts of each order; the
lower order counts contexts and is interpolated with the uniform distribution over the vocabulary and one unknown word.

Defined cases: a null or empty text is one end token, after a context that stands for the start; unknown words have the
probability of the unknown word; without any training text every token has probability one; repeated rows train and
score once each; null ids count as the empty text for the fold; an empty table gives an empty result; other columns are
ignored. A text is handled as a whole, with about 60 bytes of working memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm import mapped
from beaconry.llm.common import id_and_text, id_remainder, utf8_blocks
from beaconry.session import scratch_path

#: Bytes of text handled at once, and counts a task gathers before it sends them.
BLOCK, GATHERED = 1 << 21, 4_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = 0x9E3779B97F4A7C15
#: Distinct words that fit in half of a pair; more raise.
MOST_WORDS = 1 << 32
#: The hash of the end token: no word has it, as words hash to even numbers.
END = np.uint64(1)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2^64."""
    inverse = pow(_FACTOR, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, f, np.uint64)]), dtype=np.uint64) for f in (_FACTOR, inverse))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(32)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts in order, their number up to each text's end); each text ends with END."""
    n = len(data)
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]]) if n else word
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.concatenate([word[1:], [False]]) if n else word
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    size = max(1 << 21, 1 << int(n).bit_length())
    up, down = (p[: n + 1] for p in _powers(size))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    hashes = _mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) & ~np.uint64(1)
    words_to = np.searchsorted(first, offsets[1:], "left")  # words up to the end of each text
    tokens = np.insert(hashes, words_to, END) if len(words_to) else hashes
    return tokens, words_to + np.arange(1, len(words_to) + 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys become one with the sum of their counts, in ascending order."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _coded(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as deltas and their counts, byte planes apart, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = [a.view(np.uint8).reshape(-1, 8).T.tobytes() for a in (steps, counts.astype("<u8"))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _decoded(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    steps, counts = (np.ascontiguousarray(half.reshape(8, -1).T).view("<u8").ravel() for half in np.split(raw, 2))
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


RUNS = "shard int, run binary"


def _runs(keys: np.ndarray, counts: np.ndarray, shard_of: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    shards = shard_of(keys)
    at = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = [*at[1:].tolist(), len(keys)]
    runs = [_coded(keys[a:b], counts[a:b]) for a, b in zip(at.tolist(), ends, strict=False)]
    return pa.record_batch([pa.array(shards[at], pa.int32()), pa.array(runs, pa.binary())], ["shard", "run"])


def _counted(batches: Iterator[pa.RecordBatch], keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], shard_of) -> Iterator[pa.RecordBatch]:
    """Counts of ``keys_of(tokens, ends)`` over all texts, as runs; what is gathered stays bounded."""
    gathered: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for _, data, offsets in utf8_blocks(batch, "text", BLOCK):
            gathered.append(np.unique(keys_of(*tokens_of(data, offsets)), return_counts=True))
            if sum(len(k) for k, _ in gathered) > GATHERED:
                gathered = [_summed(*map(np.concatenate, zip(*gathered, strict=True)))]
                if len(gathered[0][0]) > GATHERED // 2:
                    yield _runs(*gathered.pop(), shard_of)
    if gathered:
        yield _runs(*_summed(*map(np.concatenate, zip(*gathered, strict=True))), shard_of)


def _merged(runs: DataFrame, shards: int, finish: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """All runs of a shard meet in one task and become one run, which ``finish`` takes."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            for number, run in zip(batch.column("shard").to_pylist(), batch.column("run"), strict=True):
                if number != shard and parts:
                    yield from finish(shard, *_summed(*map(np.concatenate, zip(*parts, strict=True))))
                    parts = []
                shard = number
                parts.append(_decoded(run.as_py()))
        if parts:
            yield from finish(shard, *_summed(*map(np.concatenate, zip(*parts, strict=True))))

    return runs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(of_batches, schema)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals: shard s holds word numbers from starts[s] on."""

    folder: str
    bits: int
    starts: tuple[int, ...]
    tokens: int
    of_pairs: tuple[float, float, float]
    of_words: tuple[float, float, float]
    pairs: int
    spare: float

    @property
    def words(self) -> int:
        return self.starts[-1]


_FILES: dict[tuple[str, str], np.ndarray] = {}


def _file(folder: str, name: str, kind: str) -> np.ndarray:
    if (folder, name) not in _FILES:
        if any(f != folder for f, _ in _FILES):
            _FILES.clear()
        _FILES[folder, name] = mapped.get(folder, name, kind)
    return _FILES[folder, name]


def _by_shard(shards: np.ndarray) -> Iterator[tuple[int, slice]]:
    at = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
    for a, b in zip(at, [*at[1:], len(shards)], strict=False):
        yield int(shards[a]), slice(a, b)


def _numbers(hashes: np.ndarray, folder: str, bits: int, starts) -> np.ndarray:
    """Word numbers of ascending hashes, -1 for unknown words."""
    out = np.full(len(hashes), -1, np.int64)
    for shard, part in _by_shard(hashes >> np.uint64(64 - bits)):
        if starts[shard] == starts[shard + 1]:
            continue
        table, mine = _file(folder, f"{shard}.hash", "<u8"), hashes[part]
        at = np.minimum(np.searchsorted(table, mine), len(table) - 1)
        out[part] = np.where(table[at] == mine, at + starts[shard], -1)
    return out


def _per_word(numbers: np.ndarray, model: Model, name: str, kind: str) -> np.ndarray:
    """The values of ascending word numbers; zero for -1."""
    out = np.zeros(len(numbers), kind)
    for shard, part in _by_shard(np.searchsorted(model.starts, numbers, "right") - 1):
        if shard >= 0:
            out[part] = _file(model.folder, f"{shard}.{name}", kind)[numbers[part] - model.starts[shard]]
    return out


def _pair_counts(pairs: np.ndarray, model: Model) -> np.ndarray:
    """Counts of ascending pairs, zero for unseen ones. Single pairs are a set, others an array with counts."""
    out = np.zeros(len(pairs), np.int64)
    for shard, part in _by_shard(np.searchsorted(model.starts, (pairs >> np.uint64(32)).astype(np.int64), "right") - 1):
        mine = pairs[part]
        found = np.zeros(len(mine), np.int64)
        for name in ("once", "often"):
            table = _file(model.folder, f"{shard}.{name}", "<u8")
            if len(table):
                at = np.minimum(np.searchsorted(table, mine), len(table) - 1)
                hit = table[at] == mine
                found[hit] = 1 if name == "once" else _file(model.folder, f"{shard}.times", "<i8")[at[hit]]
        out[part] = found
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many entries were counted once, twice, three and four times."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _pairs_of(tokens: np.ndarray, ends: np.ndarray, numbers: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and word number of every token; texts start in the context of the end token."""
    context = np.concatenate([[start], numbers[:-1]])
    context[ends[:-1]] = start
    return context, numbers


def _spread(runs: DataFrame) -> int:
    return max(8, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def trained(docs: DataFrame) -> Model:
    """Count, write the arrays and return where they are; ``docs`` has doc_id and text."""
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "ngrams")
    texts = docs.select("text")
    shards = 1 << (_spread(docs) - 1).bit_length()
    bits = shards.bit_length() - 1

    def by_hash(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - bits)).astype(np.int32)

    def word_files(shard: int, hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        mapped.put(folder, f"{shard}.hash", hashes)
        mapped.put(folder, f"{shard}.count", counts)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(hashes)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["shard", "n", "tokens"])

    words = texts.mapInArrow(lambda batches: _counted(batches, lambda tokens, ends: tokens, by_hash), RUNS)
    written = {r["shard"]: r for r in _merged(words, shards, word_files, "shard int, n long, tokens long").collect()}
    starts = (0, *np.cumsum([written[s]["n"] if s in written else 0 for s in range(shards)]).tolist())
    total = sum(r["tokens"] for r in written.values())
    if starts[-1] > MOST_WORDS:
        raise ValueError(f"{starts[-1]} distinct words: pairs of word numbers hold {MOST_WORDS} at most")

    def numbered(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(tokens, return_inverse=True)
        numbers = _numbers(distinct, folder, bits, starts)
        context, word = _pairs_of(tokens, ends, numbers[inverse], int(numbers[0]))  # END is the smallest hash
        return context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)

    def by_context(pairs: np.ndarray) -> np.ndarray:
        return (np.searchsorted(starts, (pairs >> np.uint64(32)).astype(np.int64), "right") - 1).astype(np.int32)

    def by_number(numbers: np.ndarray) -> np.ndarray:
        return (np.searchsorted(starts, numbers.astype(np.int64), "right") - 1).astype(np.int32)

    def pair_files(shard: int, pairs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        mapped.put(folder, f"{shard}.once", pairs[counts == 1])
        mapped.put(folder, f"{shard}.often", pairs[counts > 1])
        mapped.put(folder, f"{shard}.times", counts[counts > 1])
        size, local = starts[shard + 1] - starts[shard], (pairs >> np.uint64(32)).astype(np.int64) - starts[shard]
        mapped.put(folder, f"{shard}.total", np.bincount(local, counts, size))
        for name, which in (("n1", counts == 1), ("n2", counts == 2), ("n3", counts > 2)):
            mapped.put(folder, f"{shard}.{name}", np.bincount(local[which], minlength=size).astype("<u4"))
        after = _runs(*np.unique(pairs & np.uint64(0xFFFFFFFF), return_counts=True), by_number)
        of_counts = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()
        stats = pa.array([[*of_counts, len(pairs)]] + [None] * (after.num_rows - 1), pa.list_(pa.int64()))
        yield pa.record_batch([*after.columns, stats], ["shard", "run", "stats"])

    pairs = texts.mapInArrow(lambda batches: _counted(batches, numbered, by_context), RUNS)
    path = scratch_path(spark, "contexts")
    _merged(pairs, shards, pair_files, f"{RUNS}, stats array<long>").write.parquet(path)
    followed = spark.read.parquet(path)
    of_pairs = _totals(followed)

    def context_files(shard: int, numbers: np.ndarray, contexts: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = np.zeros(starts[shard + 1] - starts[shard], "<u4")
        values[numbers.astype(np.int64) - starts[shard]] = contexts
        mapped.put(folder, f"{shard}.contexts", values)
        of_counts = np.bincount(np.minimum(contexts, 5), minlength=6)[1:5].tolist()
        yield pa.record_batch([pa.array([[*of_counts, len(numbers) - sum(of_counts)]], pa.list_(pa.int64()))], ["stats"])

    of_words = _totals(_merged(followed.select("shard", "run"), shards, context_files, "stats array<long>"))
    d_pairs, d_words = discounts(of_pairs[:4]), discounts(of_words[:4])
    removed = d_words[0] * of_words[0] + d_words[1] * of_words[1] + d_words[2] * sum(of_words[2:])
    spare = removed / of_pairs[4] if of_pairs[4] else 1.0
    return Model(folder, bits, starts, total, d_pairs, d_words, of_pairs[4], spare / (starts[-1] + 1))


def _totals(rows: DataFrame) -> list[int]:
    sums = rows.where("stats IS NOT NULL").select(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(5))).first()
    return [x or 0 for x in sums]


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text, held_out): a map whose workers map the model's files."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in utf8_blocks(batch, "text", BLOCK):
                tokens, ends = tokens_of(data, offsets)
                columns = _block_scores(tokens, ends, model)
                n = len(ends)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(row, n), batch.column("held_out").slice(row, n), *(pa.array(c) for c in columns)],
                    [f.split()[0] for f in RESULT.split(", ")],
                )

    return docs.mapInArrow(of_batches, RESULT)


def _block_scores(tokens: np.ndarray, ends: np.ndarray, model: Model) -> list[np.ndarray]:
    first = np.concatenate([[0], ends[:-1]])
    if not model.words:
        nothing = np.zeros(len(ends))
        return [ends - first, nothing.astype(np.int64), nothing.astype(np.int64), nothing, nothing]
    distinct, inverse = np.unique(tokens, return_inverse=True)
    numbers = _numbers(distinct, model.folder, model.bits, model.starts)
    counts = np.zeros(len(numbers), np.int64)
    order = np.argsort(numbers, kind="stable")
    counts[order] = _per_word(numbers[order], model, "count", "<i8")
    lower, total, left = np.zeros(len(numbers)), np.zeros(len(numbers)), np.zeros(len(numbers))
    contexts = _per_word(numbers[order], model, "contexts", "<u4").astype(np.int64)
    lower[order] = np.maximum(contexts - _discount(contexts, model.of_words), 0) / max(model.pairs, 1) + model.spare
    total[order] = _per_word(numbers[order], model, "total", "<f8")
    left[order] = sum(d * _per_word(numbers[order], model, n, "<u4") for d, n in zip(model.of_pairs, ("n1", "n2", "n3"), strict=True))
    own = numbers[inverse]
    # positions among the distinct words of the block; END is the smallest hash
    context, word = _pairs_of(tokens, ends, inverse.astype(np.int64), 0)
    local = context << 32 | word
    pair, back = np.unique(local, return_inverse=True)
    h, w = pair >> 32, pair & 0xFFFFFFFF
    known = (numbers[h] >= 0) & (numbers[w] >= 0)
    seen = np.zeros(len(pair), np.int64)
    keys = numbers[h[known]].astype(np.uint64) << np.uint64(32) | numbers[w[known]].astype(np.uint64)
    seen[known] = _pair_counts(keys, model)  # ascending: numbers follow the order of hashes
    base_of = np.maximum(total[h], 1)
    p = np.where(total[h] > 0, np.maximum(seen - _discount(seen, model.of_pairs), 0) / base_of + left[h] / base_of * lower[w], lower[w])
    logs = np.log10(p)[back]
    base = np.log10((counts + 1) / (model.tokens + model.words + 1))[inverse]
    sums = [np.add.reduceat(x, first) for x in ((own >= 0).astype(np.int64), base, logs)]
    return [ends - first, sums[0], np.full(len(ends), model.tokens, np.int64), sums[1], sums[2]]


def scored_by_own_model(docs: DataFrame) -> DataFrame:
    """Train on the rows whose id has a remainder other than 2 modulo 7, score all rows."""
    rows = id_and_text(docs).withColumn("held_out", id_remainder(7) == 2)
    return scored(rows, trained(rows.where(~F.col("held_out"))))
