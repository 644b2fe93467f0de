"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns the operators need; a missing text is empty, other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__id`` and ``__tag``, never null: rows that agree in both have the same id and text.

    A null id shares the place of the smallest number, so rows without an id are told apart by their texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__tag": F.xxhash64(text)})


def one_of_equals(rows: DataFrame) -> DataFrame:
    """One row for each ``__id`` and ``__tag``, that of the smallest row hash, without these two columns."""
    names = [c for c in rows.columns if c not in ("__id", "__tag")]
    hashed = [F.col(f"`{c}`") for c in names if "map<" not in rows.schema[c].dataType.simpleString()]
    least = F.min_by(F.struct(*(F.col(f"`{c}`") for c in names)), F.xxhash64(*hashed))
    return rows.groupBy("__id", "__tag").agg(least.alias("__row")).select("__row.*")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], spread_by: Column, salts: int = 16) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each value of ``keys``; rows without an entry are left out.

    A key of very many rows is dealt over ``salts`` tasks by ``spread_by``. An entry is repeated for the salts that occur with
    its key only, so entries of rare keys are not multiplied.
    """
    salted = rows.withColumn("__salt", F.pmod(spread_by, F.lit(salts)).cast("int"))
    entries = salted.select(*keys, "__salt").distinct().join(table, keys)
    return salted.join(entries, [*keys, "__salt"]).drop("__salt")


def id_remainder(of: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``of``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def utf8_blocks(batch: pa.RecordBatch, column: str, block_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes of some whole texts, their offsets): blocks of about ``block_bytes`` and at least one text.

    The bytes are views of the Arrow buffer, so a block costs no copy.
    """
    texts = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column over ``data`` cut at ``offsets``."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
