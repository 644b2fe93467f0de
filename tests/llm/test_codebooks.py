"""Vector codes against complete scans, on made vectors with ties, repeats, nulls and non-finite components."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, named int, v int"


def made_rows(n, width, seed=3):
    rng = random.Random(seed)
    some = [[rng.choice([-1, -0.5, 0, 0.25, 0.3, 1]) + rng.gauss(0, 0.05) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = rng.choice(some) if rng.random() < 0.3 else [rng.gauss(0, 0.4) for _ in range(width)]
        rows.append((i * 3 % 97 if i % 10 else None, v, rng.choice([None, 1, 2, 2, 2]), "x", 1, 2))
    nothing = [(5, None, 1), (6, [None] * width, 1), (7, [float("nan")] * width, 2), (8, [float("inf")] + [0.0] * (width - 1), 2)]
    return [*rows, *((*r, "x", 1, 2) for r in nothing)]


def by_hand(rows, parts, entries, rounds):
    kept = [(r[0], [int(np.floor(codebooks.SCALE * float(np.float32(x)))) for x in r[1]], r[2]) for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = -(-max(len(r[1]) for r in kept) // parts) * parts
    cut = [np.array(r[1] + [0] * (width - len(r[1]))).reshape(parts, -1).tolist() for r in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(v[p], e, strict=True)), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            mine = defaultdict(list)
            for v, code in zip(cut, codes, strict=True):
                mine[code[p][1]].append(v[p])
            for i, members in mine.items():
                books[p][i] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    codes = assign()
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in code) for code in codes]
    by_label = Counter()
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    return [(r[0], "".join(f"{i:02x}" for _, i in code), e, by_label[r[2]], digest) for r, code, e in zip(kept, codes, errors, strict=True)]


def result(frame, **parameters):
    coded, books = codebooks.compressed(frame, **parameters)
    rows = codebooks.with_label_errors(coded).select("vec_id", F.lower(F.hex("codes")), "error", "label_error").collect()
    return Counter((*r, books.digest()) for r in rows)


@pytest.mark.parametrize(("n", "width", "parts", "entries", "rounds"), [(300, 64, 16, 64, 2), (300, 12, 4, 8, 5), (20, 16, 16, 64, 2), (90, 10, 4, 16, 3)])
def test_codes_are_those_of_complete_scans(spark, n, width, parts, entries, rounds):
    rows = made_rows(n, width)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(frame, parts=parts, entries=entries, rounds=rounds) == Counter(by_hand(rows, parts, entries, rounds))


def test_active_entries_give_what_a_scan_gives():
    rng = np.random.default_rng(1)
    parts, entries = rng.integers(-4, 5, (500, 3)), rng.integers(-4, 5, (12, 3))
    codes, errors = codebooks.nearest(parts, entries)
    moved = rng.random(12) < 0.4
    entries = entries + moved[:, None] * rng.integers(-2, 3, (12, 3))
    got, want = codebooks.reassigned(parts, codes, errors, entries, moved), codebooks.nearest(parts, entries)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_tables_without_vectors(spark):
    assert not result(spark.createDataFrame([], SCHEMA))
    assert not result(spark.createDataFrame([(1, None, 1, "", 1, 1)], SCHEMA))


def test_components_too_large_for_a_long_raise(spark):
    with pytest.raises(Exception, match="do not fit"):
        result(spark.createDataFrame([(1, [1e12] * 16, 1, "", 1, 1)], SCHEMA))
