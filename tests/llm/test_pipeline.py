"""The stages of the pipeline one after the other, each against brute force on what the stage before it kept."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_near import kept_by_force
from tokenizers import Tokenizer

import corpus_pipeline
from beaconry.llm import toxicity, twins

SF = "/root/testdata/sf0.001"
LENGTH = 100


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    kept["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        kept[name] = docs = spark.read.parquet(path)
    return kept


def rows_of(frame):
    return sorted((r["doc_id"], r["text"]) for r in frame.collect())


def without_repeats(rows):
    """Every byte covered by a string of LENGTH bytes that starts earlier goes, and what is left of a cut character."""
    first, out = {}, []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - LENGTH + 1):
            if first.setdefault(raw[i : i + LENGTH], (doc, i)) != (doc, i):
                gone[i : i + LENGTH] = True
        out.append((doc, bytes(np.frombuffer(raw, np.uint8)[~gone]).decode(errors="ignore")))
    return out


def test_filters_keep_what_their_rules_say(spark, stages):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({twins.quality_sql()}) WHERE kept").fetchall()}
    whole = rows_of(stages["documents"])
    assert rows_of(stages["quality"]) == [r for r in whole if r[0] in good] and 0 < len(good) < len(whole)
    judged = toxicity.scored(stages["quality"], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    bad = {r["doc_id"] for r in judged if r["predicted"] == 1}
    assert rows_of(stages["toxicity"]) == [r for r in rows_of(stages["quality"]) if r[0] not in bad]


def test_near_duplicates_and_passages(stages):
    before = rows_of(stages["toxicity"])
    assert rows_of(stages["near_dedup"]) == sorted(kept_by_force(before), key=lambda r: r[0])
    assert rows_of(stages["suffix_dedup"]) == without_repeats(rows_of(stages["near_dedup"]))
    assert all(r["n_chars"] == len(r["text"]) for r in stages["suffix_dedup"].collect())
    for name in ("quality", "toxicity", "near_dedup", "suffix_dedup"):
        assert stages[name].columns == stages["documents"].columns


def test_run_gives_the_pieces_of_the_last_texts(spark, stages):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {doc: len(whole.encode(text, add_special_tokens=False).ids) + 1 for doc, text in rows_of(stages["suffix_dedup"])}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == tokens
    assert sum(r["length"] for r in pieces) == sum(tokens.values())
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, stages["packing"].collect()))
