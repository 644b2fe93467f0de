"""Suffix-array dedup (operator 1): remove every byte covered by a long string that also starts earlier.

Equal strings must meet in one shard for a suffix array to find them. A string's anchor is the first of its substrings of
``GRAM`` bytes with the smallest hash: it depends on the string alone, so all its appearances share it. A document's
starts fall into runs with one anchor; a run's segment is the text its strings cover, and segments are dealt by anchor.

1. A map lists the segments (anchor hash, segment hash, document, place); no text leaves it. Sorted by anchor, a stream
   drops anchors met once, nearly all. An anchor's segments that are equal as a whole are one text with several
   appearances: only the earliest goes on, every string of the others starts earlier there.
2. The text of the segments left goes to shards. Each shard's suffix array is induced and its permuted common prefixes
   computed; neighbours that share at least ``length`` bytes start equal strings, and all but the earliest are marked.
3. Marked stretches are joined back to the documents, united and cut out.

Documents without a stretch, usually most, are kept out of the shuffles of texts by Bloom filters of fixed size; where
those fill up more rows take the joined way, with the same result. An anchor with over ``HOT`` different segments (a
phrase in very many contexts) has each of its strings dealt by its own hash, equal ones streaming past the first, so no
anchor has to fit a task. All equality is on the input, never on what is left.

Defined cases: null and empty texts, and texts shorter than ``length``, keep all bytes; overlaps inside one document count;
a null id is smaller than all numbers; rows that share an id are one place in the order, so of repeated rows neither is
earlier than the other; an empty table gives an empty result; other columns are kept by ``cut_out``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.llm.bloom import hash_pair, passing, possible_members
from beaconry.llm.common import utf8_blocks
from beaconry.llm.suffixes import permuted_prefixes, suffix_array
from beaconry.session import scratch_path

LENGTH, GRAM = 100, 24
#: Bytes of text listed at once, bytes of a shard's array, different segments of an anchor that share a shard.
BLOCK, ARRAY, HOT = 1 << 20, 3 << 20, 4096
_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
#: Stands for a null id in the order of documents.
_NULL = -(2**63)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling the width; the last GRAM - 1 places have none."""
    def joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        n = len(right) - width
        return left[:n] * np.uint64(pow(_FACTOR, width, 1 << 64)) + right[width:]

    one = _TABLE[data]
    two = joined(one, one, 1)
    four = joined(two, two, 2)
    eight = joined(four, four, 4)
    sixteen = joined(eight, eight, 8)
    all_ = sixteen[: len(data) - 23] * np.uint64(pow(_FACTOR, 8, 1 << 64)) + eight[16 : len(data) - 7]
    all_ = (all_ ^ all_ >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return all_ ^ all_ >> np.uint64(31)


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor hash) of every segment; starts are places in ``data``."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64)
    hashes = _gram_hashes(data)
    lowest = hashes >> np.uint64(32) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    window, width = length - GRAM + 1, 1
    while 2 * width <= window:
        lowest = np.minimum(lowest[:-width], lowest[width:])
        width *= 2
    rest = window - width
    if rest:
        lowest = np.minimum(lowest[:-rest], lowest[rest:])
    anchors = lowest.astype(np.uint32)  # the place is the lower half
    starts = np.ones(len(anchors) + 2, bool)  # a string starts here and ends in the same text; False on either side
    starts[0] = starts[-1] = False
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        starts[1 + max(begin, end - length + 1) : 1 + end] = False
    starts[-1] = False
    changed = np.ones(len(anchors) + 1, bool)
    changed[1:-1] = anchors[1:] != anchors[:-1]
    own = starts[1:-1]
    first = np.flatnonzero(own & (changed[:-1] | ~starts[:-2]))
    last = np.flatnonzero(own & (changed[1:] | ~starts[2:]))
    text_of = np.searchsorted(offsets, first, "right") - 1
    return text_of, first, last, hashes[anchors[first]]


LISTED = "anchor long, segment long, doc long, at int, tag long, extra int, copy boolean"


def _listed(rows: DataFrame, length: int) -> DataFrame:
    """Segments of every text; ``extra`` is how many starts follow the first.

    Segments met twice in a block are decided there: the later one is a copy. Repeated rows leave one place.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            doc, tag = (batch.column(c).to_numpy() for c in ("doc", "tag"))
            for row, data, offsets in _pieces(batch, length):
                text, first, last, anchor = segments(data, offsets[0], length)
                raw = data.tobytes()
                whole = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
                at = first - offsets[0][text] + offsets[1][text]
                table = [anchor.view(np.int64), whole.view(np.int64), doc[row + text], at, tag[row + text], last - first]
                yield _batch(LISTED, *_first_and_copies(table))

    return rows.mapInArrow(of_batches, LISTED)


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of texts; a text longer than a block comes in pieces that overlap by length - 1 bytes.

    With each block come its offsets and, per text, the place in the text where the piece starts.
    """
    for row, data, offsets in utf8_blocks(batch, "text", BLOCK):
        if len(offsets) == 2 and len(data) > 2 * BLOCK:
            for start in range(0, len(data) - length + 1, BLOCK):
                part = data[start : start + BLOCK + length - 1]
                yield row, part, (np.array([0, len(part)]), np.array([start]))
        else:
            yield row, data, (offsets, np.zeros(len(offsets) - 1, np.int64))


def _first_and_copies(table: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    anchor, whole, doc, at, tag, extra = table
    order = np.lexsort((at, doc, whole, anchor))
    anchor, whole, doc, at, tag, extra = (c[order] for c in table)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    again = np.zeros(len(order), bool)
    again[1:] = ~fresh[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]) & (tag[1:] == tag[:-1])
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) if len(order) else order
    copy = (doc != doc[lead]) | (at != at[lead])
    return tuple(c[~again] for c in (anchor, whole, doc, at, tag, extra, copy))


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [pa.array(c, kinds[k]) if not isinstance(c, np.ndarray) else pa.array(c).cast(kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.record_batch(arrays, [n for n, _ in fields])


def _repeated(listed: DataFrame) -> DataFrame:
    """Of the listed segments, sorted by anchor, segment and place: copies, and firsts of anchors with several segments.

    A first is held back until its anchor shows another segment, so memory is a batch and one row.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last first, not given out
        lead = None  # the last first, given out or not
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            shown = 0 if held is None else 1
            known = 0 if lead is None else 1
            full = [np.concatenate([p, c]) for p, c in zip(lead, columns, strict=True)] if known else columns
            anchor, whole, doc, at = full[:4]
            n = len(anchor)
            new_anchor, fresh = np.ones(n, bool), np.ones(n, bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            fresh[1:] = new_anchor[1:] | (whole[1:] != whole[:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            copy = (doc != doc[first]) | (at != at[first])
            group = np.cumsum(new_anchor) - 1
            kinds = np.bincount(group, fresh)
            if known and not shown:  # the lead was given out: its anchor has several segments already
                kinds[0] += 1
            several = kinds[group] > 1
            give = copy | (several & fresh) | ~fresh  # places that tie with their first, an id with two texts, go on too
            if known and not shown:
                give[0] = False
            yield _batch(LISTED, *(c[give] for c in full), copy[give])
            tail = int(first[-1])
            lead = [c[tail : tail + 1] for c in full]
            held = None if several[-1] else lead

    parted = listed.repartition("anchor").sortWithinPartitions("anchor", "segment", "doc", "at")
    return parted.mapInArrow(of_batches, LISTED)


def _tagged(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the id as a number that is never null, the text, and a tag that tells texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), text.alias("text"), F.xxhash64(text).bitwiseAND(F.lit(2**32 - 1)).alias("tag"))


def _pair() -> tuple[Column, Column]:
    return hash_pair(F.struct("doc", "tag"), 0)


SHIPPED = "key long, doc long, at int, tag long, single boolean, data binary"


def _shipped(texts: DataFrame, length: int) -> DataFrame:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tag, text, places in zip(*(batch.column(c) for c in ("doc", "tag", "text", "places")), strict=True):
                raw, doc, tag = text.as_py().encode(), doc.as_py(), tag.as_py()
                for p in places.as_py():
                    at, end = p["at"], p["at"] + p["extra"] + length
                    if p["hot"]:
                        for i in range(at, end - length + 1):
                            data = raw[i : i + length]
                            rows.append((xxhash.xxh3_64_intdigest(data) - 2**63, doc, i, tag, True, data))
                    else:
                        rows.append((p["anchor"], doc, at, tag, False, raw[at:end]))
                if len(rows) > 20_000:
                    yield _batch(SHIPPED, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield _batch(SHIPPED, *zip(*rows, strict=True))

    return texts.mapInArrow(of_batches, SHIPPED)


STRETCHES = "doc long, tag long, start int, stop int"


def stretches(rows: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """Marked stretches of some segments (key, doc, at, tag, single, data), by their suffix array.

    Symbols are bytes plus two; one parts the segments and zero ends the text, so no common prefix of two marked starts
    reaches over an end.
    """
    sizes = np.array([len(r[5]) for r in rows])
    ends = np.cumsum(sizes + 1)
    first = ends - sizes - 1
    text = np.frombuffer(b"\0".join([r[5] for r in rows]) + b"\0\0", np.uint8).astype(np.int64) + 2
    text[ends - 1], text[-1] = 1, 0
    order = suffix_array(text)
    common, _ = permuted_prefixes(text, order, length)
    place = np.arange(len(text) - 1)
    row_of = np.repeat(np.arange(len(rows)), sizes + 1)
    starts = np.zeros(len(text), bool)
    starts[:-1] = place - first[row_of] + length <= sizes[row_of]
    ordered = order[starts[order]]
    # starts of equal strings are neighbours in the array: a run ends where the common prefix falls short
    fresh = common[ordered] < length
    several = ~fresh
    several[:-1] |= ~fresh[1:]
    runs, ordered = np.cumsum(fresh)[several], ordered[several]
    row = row_of[ordered]
    doc = np.array([r[1] for r in rows], np.int64)[row]
    at = np.array([r[2] for r in rows], np.int64)[row] + ordered - first[row]
    by = np.lexsort((at, doc, runs))
    runs, doc, at, ordered = runs[by], doc[by], at[by], ordered[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = runs[1:] != runs[:-1]
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0)) if len(by) else by
    later = np.sort(ordered[(doc != doc[lead]) | (at != at[lead])])
    if not len(later):
        return (np.zeros(0, np.int64),) * 4
    row = row_of[later]
    new = np.ones(len(later), bool)
    new[1:] = (row[1:] != row[:-1]) | (later[1:] - later[:-1] > length)
    begin = np.flatnonzero(new)
    stop = np.concatenate([begin[1:], [len(later)]]) - 1
    row = row[begin]
    shift = np.array([r[2] for r in rows], np.int64)[row] - first[row]
    return np.array([r[1] for r in rows], np.int64)[row], np.array([r[3] for r in rows], np.int64)[row], later[begin] + shift, later[stop] + shift + length


def _marked(shipped: DataFrame, length: int) -> DataFrame:
    """A suffix array for every few megabytes of a shard; a key of many segments is never cut, single strings are.

    Where single strings of one key are cut, the earliest goes along into the next array.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size >= ARRAY and (row[4] or row[0] != rows[-1][0]):
                    yield _batch(STRETCHES, *stretches(rows, length))
                    lead = next(r for r in rows if r[0] == row[0]) if row[0] == rows[-1][0] else None
                    rows = [lead] if lead else []
                    size = sum(len(r[5]) for r in rows)
                rows.append(row)
                size += len(row[5])
        if rows:
            yield _batch(STRETCHES, *stretches(rows, length))

    parted = shipped.repartition("key").sortWithinPartitions("key", "doc", "at")
    return parted.mapInArrow(of_batches, STRETCHES)


def repeated_stretches(rows: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc, tag, start, stop) of what is to be removed; ``rows`` as from ``_tagged``."""
    spark = rows.sparkSession
    path = scratch_path(spark, "segments")
    listed = _listed(rows.select("doc", "text", "tag"), length)
    path_copies = scratch_path(spark, "listed")
    listed.write.option("compression", "zstd").parquet(path_copies)
    listed = spark.read.parquet(path_copies)
    _repeated(listed.where("NOT copy")).write.option("compression", "zstd").parquet(path)
    repeated = spark.read.parquet(path)
    firsts = repeated.where("NOT copy")
    crowded = firsts.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("hot"))
    places = firsts.join(crowded, "anchor", "left").groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "at", "extra", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))
    members = possible_members(firsts, _pair())
    texts = passing(rows.select("doc", "tag", "text"), members, _pair(), wanted=True).dropDuplicates(["doc", "tag"]).join(places, ["doc", "tag"])
    marked = _marked(_shipped(texts, length), length)
    copies = listed.where("copy").unionByName(repeated.where("copy")).select("doc", "tag", F.col("at").alias("start"), (F.col("at") + F.col("extra") + length).alias("stop"))
    return marked.unionByName(copies)


def united(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches as disjoint, non-touching spans in order."""
    out: list[list[int]] = []
    for start, stop in sorted(places):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(s) for s in out]


def cut_out(docs: DataFrame, length: int = LENGTH, hot: int = HOT, whole_characters: bool = False) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with n_bytes, n_removed, n_spans and the kept bytes.

    With ``whole_characters`` what is left of a cut character goes too, so that the kept bytes are a text.
    """
    spark = docs.sparkSession
    rows = _tagged(docs)
    path = scratch_path(spark, "stretches")
    repeated_stretches(rows, length, hot).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    members = possible_members(found, _pair())
    raw = F.col("text").cast("binary")
    untouched = passing(rows, members, _pair(), wanted=False).select("row", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), raw.alias("kept"))
    lists = found.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("places"))
    touched = passing(rows, members, _pair(), wanted=True).join(lists, ["doc", "tag"], "left").select("row", raw.alias("raw"), "places")
    number = T.LongType()
    schema = T.StructType([touched.schema["row"], T.StructField("n_bytes", number), T.StructField("n_removed", number), T.StructField("n_spans", number), T.StructField("kept", T.BinaryType())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, places in zip(batch.column("raw"), batch.column("places"), strict=True):
                raw, cuts = text.as_py(), united([(p["start"], p["stop"]) for p in places.as_py() or ()])
                edges = [0, *(x for cut in cuts for x in cut), len(raw)]
                rest = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                kept.append(rest.decode(errors="ignore").encode() if whole_characters else rest)
                spans.append(len(cuts))
            numbers = [pa.array(c, pa.int64()) for c in (sizes, removed, spans)]
            yield pa.record_batch([batch.column("row"), *numbers, pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return untouched.unionByName(touched.mapInArrow(of_batches, schema))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with what repeats cut out of their texts, as whole characters; n_chars follows."""
    kept = cut_out(docs, length, whole_characters=True)
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept").cast("string"))
    out = kept.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
