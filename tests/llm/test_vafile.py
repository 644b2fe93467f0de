"""Exact top-k search against all inner products, with ties, copies, nulls and hot vectors."""

import random
from collections import Counter

import numpy as np
import pytest

from beaconry.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, label int, key string, num int, v int, ids string, score int"


def made_rows(n, width, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        kind = rng.random()
        v = centre if kind < 0.3 else [x + rng.gauss(0, 0.1) for x in centre] if kind < 0.9 else [rng.choice([-1.0, 0.0, 0.5]) for _ in range(width)]
        rows.append((None if i % 41 == 7 else i // 2 if i % 5 == 0 else i, v[: width - 2] if i % 13 == 0 else v))
    nothing = [(20, None), (40, [None] * width), (60, [float("nan")] * width), (80, [float("-inf")] * width)]
    return [(*r, 1, "k", 1, 1, "", 1) for r in [*rows, *nothing, rows[0], rows[10], rows[10]]]


def by_hand(rows, every, k):
    kept = [(r[0], [int(np.floor(64 * float(np.float32(x)))) for x in r[1]]) for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for i, (vec_id, q) in enumerate(kept):
        if vec_id is not None and vec_id % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), c is None, c or 0) for j, (c, v) in enumerate(kept) if j != i)
            out += [(vec_id, rank + 1, None if none else c, -s) for rank, (s, none, c) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize(("n", "width", "bits", "every", "k"), [(700, 16, 4, 20, 20), (400, 9, 2, 3, 5), (15, 4, 4, 2, 20), (300, 12, 6, 7, 1)])
def test_search_finds_the_best_of_all(spark, n, width, bits, every, k):
    rows = made_rows(n, width, n)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = vafile.best_of_each(frame, every, k, bits=bits).collect()
    assert Counter(map(tuple, got)) == Counter(by_hand(rows, every, k))


def test_units_that_give_out_early(spark, monkeypatch):
    rows = made_rows(300, 8, 9)
    monkeypatch.setattr(vafile, "HELD", 50)
    monkeypatch.setattr(vafile, "QUERIES", 7)
    monkeypatch.setattr(vafile, "CELLS", 16)
    got = vafile.best_of_each(spark.createDataFrame(rows, SCHEMA), 10, 6).collect()
    assert Counter(map(tuple, got)) == Counter(by_hand(rows, 10, 6))


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-30, 30, (200, 5)), rng.integers(-30, 30, (3, 5))
    scan = vafile.Scan([1, 2, 3], q, 4, np.float64)
    low, high = v - rng.integers(0, 4, v.shape), v + rng.integers(0, 4, v.shape)
    scan.meet(np.arange(200), low, high)
    got, scores = scan.survivors().to_pandas(), q @ v.T
    assert ((got["lower"] <= 2 * scores[got["q"] - 1, got["c"]]) & (2 * scores[got["q"] - 1, got["c"]] <= got["upper"])).all()
    for i in range(3):
        assert set(np.argsort(-scores[i], kind="stable")[:4]) <= set(got["c"][got["q"] == i + 1])


def test_tables_without_vectors(spark):
    assert vafile.best_of_each(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vafile.best_of_each(spark.createDataFrame([(20, None, 1, "", 1, 1, "", 1)], SCHEMA)).collect() == []
