"""Quality rules (operator 9): a table of thresholds compiled into one projection.

Measures are column expressions over the whole text; ``compiled`` turns a table of (measure, least, most) into one
boolean column, so adding a rule adds a row to the table and no pass over the data. There is no user function, no
shuffle and no join: one map over the scan.

Defined cases: a null text has no words and no lines, so it fails the base rule; ties and repeated rows are judged one
by one and alike; an empty table gives an empty result; other columns pass ``keep_good`` untouched and are ignored by
``judged``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import SPACE, WORD

#: Words of a window whose second appearance in a text makes its words repeated.
WINDOW = 8
#: Base rule: fewer words fail; so does a larger share of repeated words, in percent.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "on", "was", "with", "be", "as", "by", "this", "are", "at", "from",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "im", "dem", "ist", "nicht", "eine", "ein",
    "le", "la", "et", "les", "des", "en", "un", "du", "que", "une", "est", "pour", "qui", "dans", "au", "par", "sur",
    "de", "el", "y", "los", "se", "del", "las", "por", "con", "una", "no", "para", "su", "es", "al", "lo",
)
#: (measure, least, most): a text is kept when every measure lies within its bounds; None leaves a side open.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", LEAST_WORDS, None),
    ("mean_word_chars", 2.0, 20.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_share", 0.02, None),
    ("dup_line_share", None, 0.5),
    ("bar_share", None, 0.3),
    ("exclaimed_share", None, 0.5),
)


def _windows(words: DataFrame) -> DataFrame:
    """``words`` with a hash of every window of WINDOW words as ``k``: words are hashed once, then neighbours joined by doubling."""
    hashed = words.withColumn("k", F.transform("w", lambda w: F.xxhash64(w)))
    width = 1
    while width < WINDOW:
        behind = F.slice("k", width + 1, F.greatest(F.size("k"), F.lit(1)))
        hashed = hashed.withColumn("k", F.zip_with("k", behind, lambda a, b: F.xxhash64(a, b)))
        width *= 2
    return hashed.withColumn("k", F.slice("k", F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))))


def _repeated_words(k: Column) -> Column:
    """How many words lie in a window that the text holds twice, from the hashes of all windows.

    Texts without a double, nearly all, stop at a size comparison. The others sort (hash, place), keep the places of equal
    neighbours and add up the part each window adds to the cover.
    """
    places = F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    n = F.size(k)
    pairs = F.filter(F.arrays_zip(F.slice(places, 1, n - 1).alias("a"), F.slice(places, 2, n - 1).alias("b")), lambda p: p["a"]["h"] == p["b"]["h"])
    twice = F.array_sort(F.array_distinct(F.concat(F.transform(pairs, lambda p: p["a"]["i"]), F.transform(pairs, lambda p: p["b"]["i"]))))

    def covered(one: Column) -> Column:
        # a one-element array stands for a variable: the places are computed once and read several times
        def gaps(p: Column) -> Column:
            return F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))

        return F.transform(one, lambda p: F.aggregate(gaps(p), F.lit(WINDOW), lambda total, gap: total + gap))[0]

    return F.when(F.size(F.array_distinct(k)) == n, F.lit(0)).otherwise(covered(F.array(twice)))


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of each document as the struct ``row``, its counts, and the ratios the rules speak of."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(" \t\n\x0b\x0c\r"))
    listed = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))
    words = whole.select("row", "t", listed.alias("w"), F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("l"))
    longest = max(map(len, STOP_WORDS))

    def of_words(mark: str, wanted) -> Column:
        """How many words ``wanted`` holds of; texts without ``mark`` are not looked through."""
        return F.when(F.contains("t", F.lit(mark)), F.size(F.filter("w", wanted))).otherwise(F.lit(0)).cast("long")

    counts = _windows(words).select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("k")).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        # the list is plain ASCII, and lower-casing makes no longer word of these letters
        F.size(F.filter("w", lambda w: (F.octet_length(w) <= longest) & F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        of_words("|", lambda w: w == "|").alias("n_bars"),
        of_words("!!", lambda w: w.endswith("!!")).alias("n_exclaimed"),
    )
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / per_word,
            "symbols_per_word": F.col("n_symbols") / per_word,
            "stop_word_share": F.col("n_stop_words") / per_word,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "bar_share": F.col("n_bars") / per_word,
            "exclaimed_share": F.col("n_exclaimed") / per_word,
        }
    )


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean expression."""
    verdict = F.lit(True)
    for measure, least, most in rules:
        if least is not None:
            verdict = verdict & (F.col(measure) >= F.lit(least))
        if most is not None:
            verdict = verdict & (F.col(measure) <= F.lit(most))
    return verdict


def _verdicts(docs: DataFrame, carry: list[str], rules) -> DataFrame:
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured(docs, carry).withColumns({"base_failed": base, "kept": ~base & compiled(rules)})


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """Measures and verdicts: doc_id, the five counts, base_failed and kept."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return _verdicts(docs, ["doc_id"], rules).select(F.col("row.doc_id").cast("long").alias("doc_id"), *counts, "base_failed", "kept")


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that pass, with all their columns.

    The verdict leaves through a one-row generator; a filter on a plain column would be pushed down as a second copy of
    every measure.
    """
    verdicts = _verdicts(docs, docs.columns, rules).select("row", F.explode(F.array("kept")).alias("kept"))
    return verdicts.where("kept").select("row.*")
