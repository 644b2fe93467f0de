"""Terms as a table give what one regular expression per code gives."""

import random
from collections import Counter

from pyspark.sql import functions as F

from beaconry.operators import relevance, term_join

WEIGHTS = {"region": 0.5, "topic": 0.5, "title": 1.0, "text": 0.4, "feed_region": 0.5, "threshold": 0.5, "margin": 0.1}
VOCABULARY = "kind string, code string, term string, is_prefix boolean"


def both_ways(spark, rows, terms, exclude):
    items = spark.createDataFrame(rows, "id bigint, title string, text string")
    listed = [(k, c, 0, t) for k, c, t in terms]
    vocabulary = relevance.Vocabulary.from_rows(listed, WEIGHTS, exclude)
    want = Counter(map(tuple, relevance.term_hits(items, "id", vocabulary).select("id", "kind", "code", "term", "in_title").collect()))
    table = [(k, c, t.removesuffix("*"), t.endswith("*")) for k, c, t in [*terms, *(("exclude", "", t) for t in exclude)]]
    got = term_join.term_hits(items, "id", spark.createDataFrame(table, VOCABULARY))
    return Counter(map(tuple, got.select("id", "kind", "code", "term", "in_title").collect())), want


def test_overlaps_prefixes_and_false_friends(spark):
    terms = [
        ("region", "a", "new north"), ("region", "a", "north port"), ("region", "a", "port"), ("region", "a", "nor*"), ("region", "b", "south sudan*"),
        ("region", "b", "u-boat"), ("region", "b", "sudan"), ("topic", "t", "north"), ("topic", "t", "the nor*"), ("topic", "t", "Straße"), ("topic", "u", "été"),
    ]
    texts = [
        "new north port north", "New  North\nPort", "the north port, the northern port", "south sudanese sudan", "not south sudan but sudan", "u-boat u boat U-BOAT", "uu-boat",
        "a strasse, une ete", "old sudan here", "old sudan sudan old", "x", "", "north-port", "new north portnorth", "sudan old  sudan", "... north", "north.",
    ]
    rows = [(i, t, texts[(i * 7 + 3) % len(texts)]) for i, t in enumerate(texts)] + [(99, None, "north"), (100, "sudan", None)]
    got, want = both_ways(spark, rows, terms, ["old sudan", "sudan old"])
    assert got == want and len(want) > 20


def test_ten_thousand_terms(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(900)]
    terms = {(rng.choice(["region", "topic"]), f"c{rng.randrange(3)}", " ".join(rng.choices(words, k=rng.randint(1, 3))) + rng.choice(["", "", "", "*"])) for _ in range(10_000)}
    rows = [(i, " ".join(rng.choices(words, k=6)), " ".join(rng.choices(words, k=rng.randint(0, 120)))) for i in range(40)]
    got, want = both_ways(spark, rows, sorted(terms), ["abc de", "de"])
    assert got == want and sum(want.values()) > 500


def test_terms_that_words_cannot_hold_are_reported(spark):
    table = spark.createDataFrame([("topic", "t", "c++", False), ("topic", "t", "plain", False), ("topic", "t", "(a) b", False)], VOCABULARY)
    assert {r.term for r in term_join.unfit_terms(table).collect()} == {"c++", "(a) b"}


def test_runs_are_not_shuffled_when_the_vocabulary_is_small(spark):
    items = spark.range(10).select("id", F.lit("a b").alias("title"), F.lit("c").alias("text"))
    table = spark.createDataFrame([("topic", "t", "a b", False), ("region", "r", "c", False)], VOCABULARY)
    plan = term_join.term_hits(items, "id", table)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
