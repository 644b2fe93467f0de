"""Dictionary relevance: term hits, score, outcome, replay. All of it is a map over the rows.

A vocabulary is compiled to one expression per code, so scoring needs neither a join nor a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.text import WORD, _fold, fold, squash

EPSILON = 1e-9
WEIGHT_NAMES = ("region", "topic", "title", "text", "feed_region")


@dataclass(frozen=True)
class Vocabulary:
    """Ordered codes with their terms, the phrases blanked before region matching, and the weights."""

    regions: dict[str, list[str]]
    topics: dict[str, list[str]]
    weights: dict[str, float]
    threshold: float
    margin: float
    exclude: tuple[str, ...] = ()

    @classmethod
    def from_rows(cls, rows, weights: dict[str, float], exclude=()) -> Vocabulary:
        groups: dict[str, dict[str, list[str]]] = {"region": {}, "topic": {}}
        for kind, code, _, term in sorted(rows, key=lambda r: (r[0], r[2])):
            groups[kind].setdefault(code, []).append(term)
        return cls(
            groups["region"], groups["topic"], {k: weights[k] for k in WEIGHT_NAMES},
            weights["threshold"], weights["margin"], tuple(exclude),
        )

    def with_threshold(self, threshold: float) -> Vocabulary:
        return replace(self, threshold=threshold, margin=min(self.margin, threshold))


def pattern(terms) -> str:
    """One regular expression for a term list: whole words, longest first, ``*`` marks a prefix."""
    folded = sorted({_fold(" ".join(t.split())) for t in terms}, key=lambda t: (-len(t), t))
    branches = [rf"\Q{t[:-1]}\E{WORD}*" if t.endswith("*") else rf"\Q{t}\E(?!{WORD})" for t in folded]
    return f"(?<!{WORD})(?:" + "|".join(branches) + ")"


def _hits(text: Column, terms) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern(terms)), 0))


def fold_items(items: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds the folded title and text, and the forms with the excluded phrases blanked out."""
    for field in ("title", "text"):
        items = items.withColumn(f"_{field}", fold(squash(F.col(field))))
    for field in ("title", "text"):
        blanked = F.regexp_replace(f"_{field}", pattern(vocabulary.exclude), " ") if vocabulary.exclude else F.col(f"_{field}")
        items = items.withColumn(f"_region_{field}", blanked)
    return items


def term_hits(items: DataFrame, key: str, vocabulary: Vocabulary) -> DataFrame:
    """Distinct matched strings: (key, kind, code, term, in_title)."""
    folded = fold_items(items, vocabulary)
    found = []
    for kind, codes, prefix in (("region", vocabulary.regions, "_region_"), ("topic", vocabulary.topics, "_")):
        for code, terms in codes.items():
            in_title, in_text = _hits(F.col(f"{prefix}title"), terms), _hits(F.col(f"{prefix}text"), terms)
            found.append(F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), in_title.alias("t"), in_text.alias("x")))
    codes = folded.select(key, F.explode(F.array(*found)).alias("c")).select(key, "c.*")
    terms = codes.select(key, "kind", "code", "t", F.explode(F.array_union("t", "x")).alias("term"))
    return terms.select(key, "kind", "code", "term", F.array_contains("t", F.col("term")).alias("in_title"))


def _matched(items: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Items with their region hits and topic weights as plain columns.

    The hits leave through a one-row generator: a filter on the score then stays above it, instead of
    being pushed down as a copy of every pattern match.
    """
    w = vocabulary.weights
    folded = fold_items(items, vocabulary)
    for i, terms in enumerate(vocabulary.regions.values()):
        folded = folded.withColumn(f"_t{i}", _hits(F.col("_region_title"), terms))
        folded = folded.withColumn(f"_a{i}", F.array_union(f"_t{i}", _hits(F.col("_region_text"), terms)))
    for code, terms in vocabulary.topics.items():
        matcher = pattern(terms)
        weight = F.when(F.col("_title").rlike(matcher), w["title"]).when(F.col("_text").rlike(matcher), w["text"])
        folded = folded.withColumn(f"_topic_{code}", weight)
    hits = [c for c in folded.columns if c.startswith(("_t", "_a", "_topic_")) and c not in ("_title", "_text")]
    return folded.select(*items.columns, F.inline(F.array(F.struct(*hits))))


def score(items: DataFrame, vocabulary: Vocabulary, prior: str = "feed_region") -> DataFrame:
    """Adds region, terms, topics, region_score, topic_score and score to (title, text, prior region)."""
    w = vocabulary.weights
    scored = _matched(items, vocabulary)
    entries = []
    for i, code in enumerate(vocabulary.regions):
        total = F.size(f"_t{i}") * w["title"] + (F.size(f"_a{i}") - F.size(f"_t{i}")) * w["text"]
        entry = F.struct(F.least(F.lit(1.0), total).alias("score"), F.lit(-i).alias("rank"), F.lit(code).alias("code"), F.array_sort(f"_a{i}").alias("terms"))
        entries.append(F.when(F.size(f"_a{i}") > 0, entry))
    scored = scored.withColumn("_best", F.array_max(F.array_compact(F.array(*entries))))
    known_prior = F.when(F.col(prior).isin(*vocabulary.regions), F.col(prior))
    scored = scored.withColumn("region", F.coalesce(F.col("_best.code"), known_prior))
    raised = F.when(F.col("region") == known_prior, F.greatest(F.coalesce(F.col("_best.score"), F.lit(0.0)), F.lit(w["feed_region"])))
    scored = scored.withColumn("_region", F.coalesce(raised, F.col("_best.score"), F.lit(0.0)))

    weights, topics = [], []
    for code in vocabulary.topics:
        weights.append(F.coalesce(F.col(f"_topic_{code}"), F.lit(0.0)))
        topics.append(F.when(F.col(f"_topic_{code}").isNotNull(), F.lit(code)))
    scored = scored.withColumn("_topic", F.least(F.lit(1.0), sum(weights, F.lit(0.0))))
    both = (F.col("_region") > 0) & (F.col("_topic") > 0)
    total = F.when(both, w["region"] * F.col("_region") + w["topic"] * F.col("_topic")).otherwise(0.0)
    return scored.select(
        *items.columns,
        "region",
        F.coalesce(F.col("_best.terms"), F.array().cast("array<string>")).alias("terms"),
        F.array_compact(F.array(*topics)).alias("topics"),
        F.round("_region", 3).alias("region_score"),
        F.round("_topic", 3).alias("topic_score"),
        F.round(total, 3).alias("score"),
    )


def outcome(scored: DataFrame, threshold: float, margin: float) -> DataFrame:
    """``relevant`` at threshold - margin, ``borderline`` when relevant but below the threshold."""
    relevant = F.col("score") + EPSILON >= threshold - margin
    return scored.withColumn("relevant", relevant).withColumn("borderline", relevant & (F.col("score") + EPSILON < threshold))


def replay_diff(items: DataFrame, key: str, before: Vocabulary, after: Vocabulary) -> DataFrame:
    """Rows whose outcome changes between two vocabularies. Both scores are columns of one pass."""
    first = outcome(score(items, before), before.threshold, before.margin)
    first = first.select(*items.columns, F.col("score").alias("score_before"), F.col("relevant").alias("relevant_before"), F.col("borderline").alias("borderline_before"))
    second = outcome(score(first, after), after.threshold, after.margin)
    changed = (F.col("relevant") != F.col("relevant_before")) | (F.col("borderline") != F.col("borderline_before"))
    return second.where(changed).select(
        key, "score_before", F.col("score").alias("score_after"), "relevant_before", F.col("relevant").alias("relevant_after"),
        "borderline_before", F.col("borderline").alias("borderline_after"),
    )
