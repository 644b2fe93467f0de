"""Toxicity (operator 2): gradient-boosted trees over dense features, calibrated by isotonic regression.

Features come from one map over the whole texts: densities of a fixed lexicon and of word beginnings learned from the
training rows, lexicon words near the second person, capitals, punctuation, and obfuscation (lexicon words that show only
after digits and signs are read as letters). Stems, trees and calibration learn from a bounded sample of labelled rows
(``MOST_TRAINED``), the calibration from rows that neither stems nor trees have seen. The models are small, whatever the
corpus, and score every row on the JVM.

Labels come only from rows that are not held out; labels, lang, source and doc_id are no input of a score.

Defined cases: a null or empty text has the features zero and gets the score those get; labels that are null or of
unknown documents teach nothing; a document counts once however often it is labelled, as toxic if half of its labels say
so, and of texts that share an id the smallest teaches; where either part of the sample lacks a class both learn from all
of it; without two classes to learn from the score is the share of toxic labels, zero without any; repeated rows and null
ids are scored like any other; an empty table gives an empty result; the operator keeps no other columns, ``drop_toxic``
keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import id_and_text, id_remainder, told_apart
from beaconry.session import cut_lineage

#: Labelled rows that the models learn from at most, the smallest by a hash of the id.
MOST_TRAINED = 20_000
THRESHOLD = 0.7
#: Insults, and the second person in four languages.
LEXICON = frozenset(
    b"idiot idiots moron morons stupid scum loser losers pathetic disgusting worthless clown clowns trash dumb fool fools jerk liar "
    b"pig vermin filth garbage imbecile idiotic moronic freak creep coward parasite brainless vile hate kill ugly shut "
    b"idioten dumm trottel abschaum verlierer widerlich dreck wertlos ekelhaft idiota estupido basura asqueroso inutil payaso "
    b"imbecil perdedor escoria idiote stupide ordure minable nul clochard degoutant pathetique crapule".split()
)
SECOND_PERSON = frozenset(b"you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tus ti vosotros".split())
#: Words between a lexicon word and a second person that still count as near.
NEAR = 4
FEATURES = ("per_word", "hits", "kinds", "near_second", "second_person", "capitals", "capital_words", "marks", "punctuation", "obfuscated", "digits", "long_runs", "words", "stem_per_word", "stem_hits", "stem_kinds")
#: Learned stems: their bytes, and how much more often at least a toxic training row has one, in how many at least.
STEM_BYTES, STEM_RATIO, STEM_LEAST, MOST_STEMS = (4, 5, 6), 20.0, 4, 1000

_LETTERS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
#: Digits and signs read as the letters they stand for; all other signs are dropped with the blanks.
_READ_AS = {ord(a): ord(b) for a, b in zip("013457@$!|", "oieastasii", strict=True)}
_REVEALED = bytes(_READ_AS.get(c, c if chr(c).isalnum() or c >= 128 or chr(c).isspace() else 32) for c in range(256))
_KEEP_ONLY = {name: bytes(c for c in range(256) if chr(c) not in kept) for name, kept in {"capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "marks": "!?", "digits": "0123456789", "punctuation": ".,;:!?-\"'()*#&%$@|<>/_"}.items()}


def _found(words: list[bytes]) -> list[int]:
    return [i for i, w in enumerate(words) if w in LEXICON]


def _words(text: bytes) -> list[bytes]:
    return text.lower().translate(_LETTERS).split()


def features(text: bytes, stems: frozenset[bytes] = frozenset()) -> tuple[float, ...]:
    """The dense features of one text, in the order of ``FEATURES``; ``stems`` are learned word beginnings."""
    lower, words = text.lower(), _words(text)
    stemmed = [w for w in words if w[:4] in stems or w[:5] in stems or w[:6] in stems] if stems else []
    n, size = max(len(words), 1), max(len(text), 1)
    hits = _found(words)
    # signs inside a word vanish here (i-d.i*o_t), digits and look-alikes become letters
    shown = [w.translate(None, b"-_.*'~") for w in lower.split() if not w.isalpha()]
    hidden = sum(w.translate(_REVEALED).strip() in LEXICON for w in shown if w.translate(_LETTERS).strip() not in LEXICON)
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    second = sum(map(SECOND_PERSON.__contains__, words))
    count = {name: len(text.translate(None, dropped)) for name, dropped in _KEEP_ONLY.items()}
    shouted = sum(map(bytes.isupper, text.split()))
    return (
        1000 * len(hits) / n, float(len(hits)), float(len({words[i] for i in hits})), 1000 * near / n, 1000 * second / n, count["capitals"] / size, shouted / n,
        1000 * count["marks"] / size, 1000 * count["punctuation"] / size, 1000 * hidden / n, 1000 * count["digits"] / size, 1000 * (text.count(b"!!") + text.count(b"??")) / n, float(n),
        1000 * len(stemmed) / n, float(len(stemmed)), float(len(set(stemmed))),
    )


def featured(docs: DataFrame, stems: frozenset[bytes] = frozenset()) -> DataFrame:
    """(doc_id, tag, held_out, one column per feature): a map; ``tag`` is a hash of the text."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), stems) for t in batch.column("text").cast(pa.binary())]
            columns = zip(*rows, strict=True) if rows else [[]] * len(FEATURES)
            yield pa.record_batch([batch.column("doc_id"), batch.column("tag"), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", "tag", *FEATURES])

    tagged = id_and_text(docs).withColumn("tag", F.xxhash64("text"))
    measured = tagged.mapInArrow(of_batches, "doc_id long, tag long, " + ", ".join(f"{f} double" for f in FEATURES))
    return measured.select("doc_id", "tag", (id_remainder(3) == 1).alias("held_out"), *FEATURES)


def learned_stems(texts: DataFrame) -> frozenset[bytes]:
    """Word beginnings that mark the toxic rows of ``texts`` (text, label); at most ``MOST_STEMS`` reach the driver."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, list[int]] = {}
            for text, label in zip(batch.column("text").cast(pa.binary()), batch.column("label").to_pylist(), strict=True):
                for stem in {w[:n] for w in _words(text.as_py()) for n in STEM_BYTES if len(w) >= n}:
                    counts.setdefault(stem, [0, 0])[int(label)] += 1
            columns = [list(counts), [c[1] for c in counts.values()], [c[0] for c in counts.values()]]
            yield pa.record_batch([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["stem", "toxic", "clean"])

    rows = texts.groupBy("label").count().collect()
    size = {int(r["label"]): r["count"] for r in rows}
    if len(size) < 2:
        return frozenset()
    found = texts.select("text", "label").mapInArrow(of_batches, "stem binary, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") / size[1]) / ((F.col("clean") + 0.5) / size[0])
    marks = found.where((F.col("toxic") >= STEM_LEAST) & (ratio >= STEM_RATIO)).orderBy(F.desc("toxic"), "stem").limit(MOST_STEMS)
    return frozenset(bytes(r["stem"]) for r in marks.collect())


def scored(docs: DataFrame, labels: DataFrame, most_trained: int = MOST_TRAINED) -> DataFrame:
    """(doc_id, held_out, score, predicted, tag) for every row of ``docs``."""
    given = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
    known = given.where(id_remainder(3) != 1).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("label"))
    bounded = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most_trained)
    bounded = F.broadcast(cut_lineage(bounded.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0)))  # most_trained slim rows
    texts = cut_lineage(id_and_text(docs).join(bounded, "doc_id").groupBy("doc_id", "label", "calibrates").agg(F.min("text").alias("text")))
    seen = {(r["calibrates"], r["label"]): r["count"] for r in texts.groupBy("calibrates", "label").count().collect()}
    total, apart = sum(seen.values()), len(seen) == 4
    learning, calibrating = ("NOT calibrates", "calibrates") if apart else ("true", "true")
    stems = learned_stems(texts.where(learning))
    sample = cut_lineage(featured(texts, stems).join(bounded, "doc_id"))
    table = featured(docs, stems)
    if len({label for _, label in seen}) < 2:
        prior = sum(n for (_, label), n in seen.items() if label == 1) / total if total else 0.0
        return _decided(table.withColumn("score", F.lit(prior)))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=1, minInstancesPerNode=5)
    spread = max(1, min(8, total // 2500))
    model = trees.fit(assembler.transform(sample.where(learning)).select("features", "label").coalesce(spread))

    def raw(rows: DataFrame) -> DataFrame:
        return model.transform(assembler.transform(rows)).withColumn("raw", vector_to_array("probability")[1])

    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw(sample.where(calibrating)).select("raw", "label").coalesce(1))
    return _decided(isotonic.transform(raw(table)))


def _decided(rows: DataFrame) -> DataFrame:
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return rows.select("doc_id", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "tag")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with all their columns; of rows that share an id each is judged by its own text."""
    bad = scored(docs, labels).where("predicted = 1").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), F.col("tag").alias("__tag")).distinct()
    return told_apart(docs).join(bad, ["__id", "__tag"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
