"""The texts themselves go through the shards, in cells bounded by rows and bytes."""

import zlib
from collections import Counter, defaultdict

from beaconry.llm import queries, shards

TEXTS = [None, "", "wört", *(f"text {i} " * (1 + i % 9) for i in range(150)), "long " * 60_000, "text 5 " * 6, "text 5 " * 6]


def test_texts_are_dealt_and_digests_come_from_the_dealt_rows(spark, tmp_path, monkeypatch):
    table = [(i if i % 40 else None, t, "s") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(table, "doc_id long, text string, source string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    dealt, whole = [], shards.shuffled
    monkeypatch.setattr(shards, "shuffled", lambda rows: dealt.append(rows.columns) or whole(rows))
    placed = queries.op4_shards(spark, str(tmp_path))
    assert dealt == [["doc_id", "text"]]
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in table)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in placed.collect()) == want


def test_cells_are_bounded_by_bytes(spark):
    assert shards.rows_of_cells(1000, 10**6, 50_000, 10**5) == 100
    assert shards.rows_of_cells(1000, 10**6, 50, 10**5) == 50
    assert shards.rows_of_cells(10, 10**9, 50, 10**5) == 1 and shards.rows_of_cells(0, 0, 50, 10) == 1
    table = [(i, t, [t, t]) for i, t in enumerate(TEXTS)]
    rows = spark.createDataFrame(table, "doc_id long, text string, shard array<string>").repartition(6, "doc_id").withColumnRenamed("shard", "words")
    got = shards.shuffled(rows, 4, 9, cell_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"], tuple(r["words"])) for r in got) == Counter((i, t, tuple(w)) for i, t, w in table)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 4
