"""The published batch: its bytes, counts and pointer against plain Python, and a reader that accepts it."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from beaconry.operators import review_queue as rq
from beaconry.sources import files

SCHEMA = ", ".join(f"{c} {'bigint' if c == 'simhash' else 'double' if c == 'triage_score' else 'string'}" for c in rq.STORE_COLUMNS)
ID, AT = "2024-01-31-a1", "2024-01-31T00:00:00Z"


def stored(n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        row = {c: rng.choice([None, "plain", 'a "quoted"\\ line\n\tand ü €', "x/y"]) for c in rq.STORE_COLUMNS}
        row |= {"content_hash": f"sha256:{rng.getrandbits(60):x}", "triage_status": rng.choice(["scored", "pending", "queued", "odd"])}
        rows.append(row | {"simhash": rng.choice([None, -1, 5, -(2**63), 2**63 - 1]), "triage_score": rng.choice([None, 0.0, 0.45, 1.0])})
    return rows


def dumped(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n"


def published_by_hand(rows, limit):
    place = {"queued": 0, "pending": 1, "scored": 2}
    chosen = sorted(rows, key=lambda r: (place.get(r["triage_status"], 9), r["content_hash"]))[:limit]
    chosen = [r | {"simhash": None if r["simhash"] is None else f"{r['simhash'] % 2**64:016x}"} for r in chosen]
    statuses = [r["triage_status"] for r in chosen]
    counts = {"rows": len(chosen), "reviews": statuses.count("queued"), "truncated": len(rows) - len(chosen), "by_triage_status": {s: statuses.count(s) for s in statuses}}
    body = dumped({"schema": "batch/1", "batch_id": ID, "created_at": AT, "run_url": None, "counts": counts, "rows": chosen})
    digest = hashlib.sha256(body.encode()).hexdigest()
    pointer = dumped({"schema": "batch-pointer/1", "batch_id": ID, "file": f"{ID}.json", "sha256": digest, "rows": len(chosen), "created_at": AT})
    return (ID, f"{ID}.json", digest, len(chosen), counts["reviews"], counts["truncated"], body, pointer)


@pytest.mark.parametrize(("n", "limit"), [(90, 40), (30, 40), (40, 40), (90, 1), (0, 5)])
def test_document_and_pointer_equal_plain_python(spark, n, limit):
    rows = stored(n)
    table = spark.createDataFrame([tuple(r[c] for c in rq.STORE_COLUMNS) for r in rows], SCHEMA)
    got = [tuple(r) for d in (table, table.repartition(5)) for r in rq.publish_batch(d, "content_hash", limit, ID, AT).collect()]
    assert got == [published_by_hand(rows, limit)] * 2


def test_a_reader_takes_the_batch_and_sees_a_changed_one(spark):
    table = spark.createDataFrame([tuple(r[c] for c in rq.STORE_COLUMNS) for r in stored(20)], SCHEMA)
    batch = rq.publish_batch(table, "content_hash", 12, ID, AT, "https://runs.example.org/1")
    pointers = batch.select(F.from_json("pointer", files.POINTER).alias("p")).select("p.*")
    for change, accepted in ((F.col("body"), 12), (F.replace("body", F.lit("plain"), F.lit("PLAIN")), 0)):
        content = F.encode(change, "UTF-8")
        found = batch.select(F.concat(F.lit("/"), "file").alias("path"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
        rows, refused = files.read_batch(found, pointers)
        assert rows.count() == accepted and [r.reason for r in refused.collect()] == ["digest"] * (accepted == 0)


def test_what_cannot_be_published_is_refused(spark):
    table = spark.createDataFrame([], SCHEMA)
    for wrong in ({"limit": 0}, {"batch_id": "2024-01-31"}, {"batch_id": "../x"}, {"run_url": "http://runs.example.org"}, {"rows": table.drop("url")}):
        with pytest.raises(ValueError):
            rq.publish_batch(**({"rows": table, "order": "content_hash", "limit": 5, "batch_id": ID, "created_at": AT} | wrong))
