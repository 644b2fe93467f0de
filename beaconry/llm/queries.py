"""The numbered queries over the sample tables, with production parameters and over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm import alignment, bloom, bpe, codebooks, media, ngrams, packing, quality, shards, simhash, substrings, toxicity, twins, vafile
from beaconry.session import use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document starts earlier elsewhere, and the digest of what is left?"""
    cut = substrings.cut_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely is each document marked toxic?"""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as stored and rebuilt media."""
    return media.stored_media(table(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into 40 shards."""
    placed = shards.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size, digest = (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    return placed.select("doc_id", size, digest, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under the bigram model of the training documents."""
    return ngrams.scored_by_own_model(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, each window mixed like the whole."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages does the filter cascade block?"""
    return bloom.judged(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document and the digest of the bytes they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents pass the quality rules?"""
    return quality.judged(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the near-duplicate component of every document."""
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every twentieth vector."""
    return vafile.best_of_each(table(spark, sf_dir, "embeddings"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compressed code of every vector and how far it is from what the code stands for."""
    coded, books = codebooks.compressed(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.hex("codes")).alias("code")
    return codebooks.with_label_errors(coded).select("vec_id", code, "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens of two tokenizers cover the same bytes of every document?"""
    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.aligned(table(spark, sf_dir, "documents"), a_path, public_tokenizers.PATTERN, b_path)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_media, op4_shards, op5_ngram_scores, op6_packing, op7_url_cascade, op8_bpe, op9_quality, op10_simhash, op11_nearest, op12_codes, op13_alignment)}
ORACLES = twins.oracles()
