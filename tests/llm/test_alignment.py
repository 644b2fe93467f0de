"""Cross-tokenizer alignment against a pairwise comparison of token byte ranges, whole and in small pieces."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from beaconry.llm import alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, key string, piece int, a binary, edges string"


def made_texts():
    rng = random.Random(11)
    words = ["the", "of", "wört", "ción", "日本", "naïve", "x" * 30, "<s>", "<|endoftext|>", "\t", "\n\n", "0123456789", "!?", "🙂"] + ["".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    return [None, "", " ", "\n", "▁x", "a ▁", "\0", "  two", *texts, texts[3], " ".join(rng.choices(words, k=700)), " " * 3000 + "x"]


def by_hand(texts):
    whole = Tokenizer.from_file(A_PATH)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_bytes = alignment.byte_tokens(A_PATH)
    rows, counts = [], Counter()
    for text in texts:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(b_bytes) != (" " + text).encode() or b"".join(a_bytes[i] for i in a) != (" " + text).encode():
            rows.append(None)
            continue
        a_ends, b_ends = np.cumsum([len(a_bytes[i]) for i in a]), np.cumsum([len(x) for x in b_bytes])
        a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
        links = [(a[i], b[j]) for i, j in zip(*np.nonzero((a_starts[:, None] < b_ends) & (b_starts < a_ends[:, None])), strict=True)]
        cuts = np.intersect1d(a_ends, b_ends)
        parts = [f"{','.join(str(t) for t, e in zip(a, a_ends, strict=True) if lo < e <= hi)}|{','.join(str(t) for t, e in zip(b, b_ends, strict=True) if lo < e <= hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False)]
        counts.update(links)
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in rows]


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.mark.parametrize("work", [alignment.WORK, 37, 1])
def test_alignment_is_that_of_all_pairs(spark, texts, work):
    texts = texts if work > 1 else texts[:40]
    rows = [(None if i == 9 else i, t, "k", 1, b"", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = alignment.aligned(docs, A_PATH, public_tokenizers.PATTERN, B_PATH, work).collect()
    want = [(r[0], *values) for r, values in zip(rows, by_hand(texts), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_pieces_are_of_equal_work():
    a, b = np.arange(3, 3000, 3), np.arange(5, 3000, 5)
    bounds = alignment.cut_path(a, b, 100)
    steps = [sum(p) for p in bounds]
    assert steps[:-1] == list(range(0, steps[-1], 100))
    assert all(set(a[:i]) | set(b[:j]) == set(np.sort(np.concatenate([a, b]))[: i + j]) for i, j in bounds)


def test_an_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA), A_PATH, public_tokenizers.PATTERN, B_PATH).collect() == []
