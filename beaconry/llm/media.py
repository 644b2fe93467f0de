"""Media columns (operator 3): content-defined chunks, stored once, from which verified media are rebuilt.

A payload is the UTF-8 text padded with zero bytes to a positive multiple of 64, held as the 8-bit samples of a mono WAV
file. A rolling gear hash over the last 32 bytes cuts it where its low bits vanish, so copies and near copies cut
alike. The manifest (length and chunk digests in order) is one slim row per distinct media. Digests that occur more than
once are found by an aggregation over the manifests and joined back; each is stored once, as a chunk of its own, while
runs of unshared chunks stay with their media. So only media with shared chunks move: a Bloom filter of fixed size keeps
the others, usually most, out of every shuffle of bytes. Where the filter fills up more rows take the joined way, with
the same result. Rebuilt media are checked against the digest in the manifest and features are computed from what was
read back; a mismatch fails the job.

Defined cases: null and empty texts are 64 zero bytes; equal texts share one media and all values; a very frequent
chunk is one stored row, joined to its many references by a join that Spark may split; repeated rows and null ids give
rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.bloom import Filter, possible_members
from beaconry.llm.common import id_and_text
from beaconry.session import scratch_path

ALIGN, RATE = 64, 8000
#: Shortest and longest chunk; a cut needs this many low bits of the hash at zero, about one place in 2048.
LEAST, MOST, CUT_BITS = 512, 16_384, 11
DIGEST = 16
_GEAR = np.random.default_rng(20_240_101).integers(0, 2**32, 256, dtype=np.uint32)
RESULT = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def wav_header(n: int) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + n) % 2**32, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n % 2**32)


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw))


def cuts(payload: bytes) -> list[int]:
    """Chunk ends. The hash of the last 32 bytes is summed by doubling: h(2w) = h(w) + (h(w), w places before) << w."""
    n = len(payload)
    places: list[int] = []
    if n > LEAST:
        h = _GEAR[np.frombuffer(payload, np.uint8)]
        for w in (1, 2, 4, 8, 16):
            earlier = h[:-w] << np.uint32(w)
            h = h.copy()
            h[w:] += earlier
        places = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0).tolist()
    ends, start, k = [], 0, 0
    while start < n:
        while k < len(places) and places[k] + 1 < start + LEAST:
            k += 1
        end = min(places[k] + 1 if k < len(places) else n, start + MOST, n)
        ends.append(end)
        start = end
    return ends


def _chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def _media(payload: bytes) -> bytes:
    return hashlib.sha256(wav_header(len(payload)) + payload).digest()


def features(payload: bytes) -> str:
    """Level, loudness and sign changes of the samples, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.mean():.3f};rms={np.sqrt((x * x).mean()):.3f};crossings={crossings}"


def _described(media: bytes, payload: bytes) -> tuple:
    if _media(payload) != media:
        raise ValueError(f"rebuilt media differs from its manifest: {media.hex()}")
    return media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(payload) + 44, media.hex(), features(payload)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in RESULT.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def manifests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, digests): a map over the whole texts; ``digests`` holds the chunk digests end to end."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media, digests = [], [], []
            for text in batch.column("text"):
                n, payload = payload_of(text.as_py())
                sizes.append(n)
                media.append(_media(payload))
                digests.append(b"".join(map(_digest, _chunks(payload))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(digests, pa.binary())], ["doc_id", "n_bytes", "media", "digests"])

    return id_and_text(docs).mapInArrow(of_batches, "doc_id long, n_bytes long, media binary, digests binary")


def _keyed(media: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first two runs of five bytes of each digest as numbers, for the filter."""
    return tuple(np.array([int.from_bytes(m[i : i + 5]) for m in media], np.int64) for i in (0, 5))


def payloads(docs: DataFrame, special: Filter, wanted: bool) -> DataFrame:
    """(media, payload) of the documents whose media the filter passes, or of those it refuses."""
    shared = docs.sparkSession.sparkContext.broadcast(special)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [payload_of(t.as_py())[1] for t in batch.column("text")]
            media = [_media(p) for p in found]
            hits = shared.value.hits(*_keyed(media)) if media else []
            rows = [(m, p) for m, p, hit in zip(media, found, hits, strict=True) if bool(hit) == wanted]
            yield pa.record_batch([pa.array([m for m, _ in rows], pa.binary()), pa.array([p for _, p in rows], pa.binary())], ["media", "payload"])

    return id_and_text(docs).select("text").mapInArrow(of_batches, "media binary, payload binary")


def _described_whole(container: DataFrame) -> DataFrame:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _result([_described(m.as_py(), p.as_py()) for m, p in zip(batch.column("media"), batch.column("payload"), strict=True)])

    return container.mapInArrow(of_batches, RESULT)


def _split(special: DataFrame) -> DataFrame:
    """Each payload as its unshared bytes, and its shared chunks with the place they have."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media, payload, places in zip(*(batch.column(c).to_pylist() for c in ("media", "payload", "places")), strict=True):
                chunks, taken = _chunks(payload), {p["idx"]: p["own"] for p in places or ()}
                rest = b"".join(c for i, c in enumerate(chunks) if i not in taken)
                ends = np.cumsum([len(c) for c in chunks])
                refs = [{"idx": i, "at": int(ends[i]) - len(chunks[i]), "digest": _digest(chunks[i]), "data": chunks[i] if own else None} for i, own in sorted(taken.items())]
                rows.append({"media": media, "rest": rest, "refs": refs})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("media", pa.binary()), ("rest", pa.binary()), ("refs", pa.list_(pa.struct([("idx", pa.int32()), ("at", pa.int64()), ("digest", pa.binary()), ("data", pa.binary())])))]))

    return special.mapInArrow(of_batches, "media binary, rest binary, refs array<struct<idx int, at long, digest binary, data binary>>")


def _rebuilt(stored: DataFrame) -> DataFrame:
    """Unshared bytes and fetched chunks put together in the order of the manifest."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media, rest, fetched in zip(*(batch.column(c).to_pylist() for c in ("media", "rest", "fetched")), strict=True):
                parts, used, at = [], 0, 0
                for chunk in sorted(fetched or (), key=lambda f: f["at"]):
                    gap = chunk["at"] - at
                    parts += [rest[used : used + gap], chunk["data"]]
                    used, at = used + gap, chunk["at"] + len(chunk["data"])
                rows.append(_described(media, b"".join([*parts, rest[used:]])))
            yield _result(rows)

    return stored.mapInArrow(of_batches, RESULT)


def stored_media(docs: DataFrame) -> DataFrame:
    """One row per document: its payload, media and feature values, computed from what the store gave back."""
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"media-{name}")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    index = kept(manifests(docs), "manifests")
    copies = index.groupBy("media").agg(F.first("digests").alias("digests"), F.count(F.lit(1)).alias("n"))
    number = F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1)
    chunks = copies.select("media", "n", F.explode(number).alias("idx"), "digests").select("media", "idx", F.substring("digests", F.col("idx") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))
    among = chunks.join(chunks.groupBy("digest").count().where("count > 1"), "digest")
    first = among.groupBy("digest").agg(F.min(F.struct("media", "idx")).alias("f"))
    shared = kept(among.join(first, "digest").select("media", "idx", ((F.col("media") == F.col("f.media")) & (F.col("idx") == F.col("f.idx"))).alias("own")), "shared")
    several = copies.where("n > 1").select("media")
    special_ids = shared.select("media").unionByName(several).distinct()
    special = possible_members(special_ids, tuple(F.conv(F.hex(F.substring("media", i, 5)), 16, 10).cast("long") for i in (1, 6)))

    plain = kept(payloads(docs, special, wanted=False), "whole")
    places = shared.groupBy("media").agg(F.collect_list(F.struct("idx", "own")).alias("places"))  # a media's own chunks
    once = payloads(docs, special, wanted=True).dropDuplicates(["media"])
    store = kept(_split(once.join(places, "media", "left")), "split")
    refs = store.select("media", F.explode("refs").alias("r"))
    chunk_store = kept(refs.where("r.data IS NOT NULL").select("r.digest", "r.data"), "chunks")
    fetched = refs.select("media", "r.at", "r.digest").join(chunk_store, "digest").groupBy("media").agg(F.collect_list(F.struct("at", "data")).alias("fetched"))
    described = _described_whole(plain).unionByName(_rebuilt(store.select("media", "rest").join(fetched, "media", "left")))
    return index.select("doc_id", "n_bytes", "media").join(described, "media").drop("media")

