"""SimHash near-duplicates (operator 10) by meet-in-the-middle ball hashing.

A fingerprint has one bit per position: set when it is set in over half of the shingles' XXH64 values. Equal
fingerprints collapse first, so copies cost nothing below. Then every distinct fingerprint emits the variants of a ball
of half the radius and pairs meet at a shared variant. With radius 3 the two halves are 1 and 2 bits:

* two fingerprints of equal parity within 3 bits differ in 2 bits and share a 1-bit variant;
* of unequal parity they differ in 1 or 3 bits. Of any three positions two lie in the same half of the word, so the even
  one needs only itself and its 2-bit flips inside either half (992, not 2016) to meet a 1-bit flip of the odd one.

Every variant is met by a bounded number of distinct fingerprints (those of its own ball), so no shuffle key is hot. At
a variant all members link to its smallest 1-bit member: at most one link per emitted variant, none of all pairs. Each
link is verified by counting bits. Components come from contraction rounds with reliable checkpoints.

Defined cases: null or empty texts, and texts without words, have fingerprint zero and link like any other; texts of
fewer words than a shingle hash their whole word sequence; equal texts share a component; repeated rows give repeated
result rows; a null id counts as larger than every number when the smallest is sought; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import id_and_text, one_of_equals, told_apart
from beaconry.session import cut_lineage

#: Words per shingle, most differing bits, and the hash seed of the contract.
SHINGLE, RADIUS, SEED = 3, 3, 42
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    last = max(len(words) - shingle, 0)
    starts = [0, *ends[:last].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=">u8")
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS_OF_BYTE for i in range(8)])
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tag, fp): one map over the whole texts; ``tag`` is a hash of the text."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("tag"), fps], ["doc_id", "tag", "fp"])

    tagged = id_and_text(docs).withColumn("tag", F.xxhash64("text"))
    return tagged.mapInArrow(of_batches, "doc_id long, tag long, fp long")


def _masks() -> tuple[list[int], list[int]]:
    """Signed masks: the 64 single bits, and nothing plus all pairs of bits inside one half."""
    signed = np.array([1 << i for i in range(64)], np.uint64).view(np.int64).tolist()
    pairs = [signed[i] | signed[j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    return signed, [0, *pairs]


def _variants(points: DataFrame, masks: list[int]) -> DataFrame:
    return points.select("fp", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))


def ball_links(points: DataFrame) -> DataFrame:
    """(a, b): verified links that connect what lies within three bits among the distinct ``fp`` of ``points``."""
    one, two = _masks()
    # few bytes make many variants: more tasks than their size asks for
    points = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    near = _variants(points, one)
    middle = near.groupBy("variant").agg(F.min("fp").alias("root"), F.count(F.lit(1)).alias("n"))
    even = points.where(F.bit_count("fp") % 2 == 0)
    among = near.join(middle.where("n > 1").hint("shuffle_hash"), "variant")
    across = _variants(even, two).join(middle.where(F.bit_count("variant") % 2 == 0).hint("shuffle_hash"), "variant")
    links = among.select("fp", "root").unionByName(across.select("fp", "root"))
    verified = links.where((F.col("fp") != F.col("root")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("root"))) <= RADIUS))
    return verified.select(F.least("fp", "root").alias("a"), F.greatest("fp", "root").alias("b")).distinct()


def contracted(links: DataFrame) -> DataFrame:
    """(node, label): one label per connected component of the undirected ``links`` (a, b).

    Each round every node takes its smallest neighbour as parent, jumps once to the parent's parent, and the links move
    to the parents; loops and doubles go. Neighbours are folded by ``min`` map-side, never collected.
    """
    links, labels = cut_lineage(links), None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        above = parents.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parents = cut_lineage(parents.join(above, "p").select("node", F.col("pp").alias("label")))
        if labels is None:
            labels = parents
        else:
            moved = parents.select(F.col("node").alias("label"), F.col("label").alias("moved"))
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label"))
        left, right = parents.toDF("a", "pa"), parents.toDF("b", "pb")
        links = links.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        links = cut_lineage(links)
        labels = cut_lineage(labels)
    return links.toDF("node", "label") if labels is None else labels


def labelled(marked: DataFrame) -> DataFrame:
    """(fp, label): the component of every distinct fingerprint of ``marked``."""
    points = cut_lineage(marked.select("fp").distinct())
    labels = contracted(ball_links(points)).withColumnRenamed("node", "fp")
    return points.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links of three bits or fewer."""
    marked = cut_lineage(fingerprints(docs, shingle))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = cut_lineage(labelled(marked).join(first, "fp"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(smallest, "label").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one that gives the component its id.

    Components without any id keep the text of the smallest hash; of rows equal in id and text one stays.
    """
    marked = cut_lineage(fingerprints(docs))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tag")
    firsts = marked.groupBy("fp").agg(F.min(place).alias("first"))
    chosen = labelled(marked).join(firsts, "fp").groupBy("label").agg(F.min("first").alias("first")).select("first.*")
    chosen = chosen.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), F.col("tag").alias("__tag"))
    return one_of_equals(told_apart(docs).join(chosen, ["__id", "__tag"], "left_semi"))
