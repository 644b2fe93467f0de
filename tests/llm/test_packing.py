"""Every source keeps a queue of its own, however many there are."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from beaconry.llm import packing

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string"


def made_rows():
    rng = random.Random(5)
    words = ["the", "of", "wört", "日本", "alpha", "beta\n"] + ["".join(rng.choices("abcde", k=5)) for _ in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90))), rng.choice([None, "#1", "a", "b", *(f"host{k}" for k in range(30))])) for i in range(250)]
    return [*rows, (900, " ".join(rng.choices(words, k=3000)), "a"), (None, None, "b"), rows[3]]


@pytest.mark.parametrize(("length", "window", "targets"), [(1024, 64, None), (64, 2, None), (64, 3, {"a": 50, "#1": 7})])
def test_a_table_of_states_gives_the_same_pieces(spark, monkeypatch, length, window, targets):
    docs = spark.createDataFrame(made_rows(), SCHEMA).repartition(5, "text")
    want = packing.packed(docs, BPE_JSON, public_tokenizers.PATTERN, targets, length, window).collect()
    monkeypatch.setattr(packing, "MOST_QUEUES", 1)
    got = packing.packed(docs, BPE_JSON, public_tokenizers.PATTERN, targets, length, window).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_a_target_holds_among_more_sources_than_queues_in_a_task(spark):
    """A tenth of the open weight goes to one source of 4,201; pooled queues gave it the weight of one of 4,096."""
    rows = [(i, "one two three four " * 4, f"host{i}") for i in range(4200)] + [(9000 + i, "alpha beta " * 40, "big") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6, "doc_id")
    got = packing.packed(docs, BPE_JSON, public_tokenizers.PATTERN, {"big": 467}, 64, 64).where("window < 4").groupBy("window", (packing.F.col("source") == "big").alias("big")).sum("length").collect()
    tokens = {(r[0], r[1]): r[2] for r in got}
    assert all(tokens[w, True] + tokens[w, False] == 4096 for w in range(4))
    # the equal sources are all due at once, so the target runs at most half a turn (467 / 2) ahead or behind
    assert all(abs(sum(tokens[v, True] for v in range(w + 1)) - (w + 1) * 4096 * 467 / 4667) <= 467 / 2 + 1 for w in range(4))


def test_rounds_of_many_queues_are_exact():
    """Token by token, ties by queue order."""
    rng = np.random.default_rng(2)
    for totals, weights in ((rng.integers(1, 9, 60), np.ones(60, int)), (rng.integers(1, 40, 60), rng.integers(1, 6, 60)), (t := rng.integers(1, 30, 50), t)):
        from fractions import Fraction

        line = sorted((Fraction(2 * k + 1, int(p)), q) for q, (n, p) in enumerate(zip(totals, weights, strict=True)) for k in range(n))
        rounds = packing.Rounds(totals, weights)
        for tokens in range(0, len(line) + 3, 7):
            assert rounds.counts(tokens).tolist() == np.bincount([q for _, q in line[:tokens]], minlength=len(totals)).tolist()
