"""Dictionary matching for large vocabularies: terms are a table, texts meet it by token n-grams.

Gives the rows of ``relevance.term_hits``: whole words, longest term first at every place, no overlap inside a code. A text is
cut into words and what lies between them; every run of as many words as a term has is one row, keyed by its own
characters, so a term is found by equality. Prefix terms are met by the run with its last word cut to the lengths that
prefixes of the vocabulary have. A hit that overlaps no other of its code is taken; the others form short chains, which a fold
walks from the left.

The vocabulary may be of any size: its rows are broadcast when their measured size allows it and shuffled otherwise. Terms
have to begin and end with a word character; others are reported by ``unfit_terms`` and match nothing here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.text import WORD, fold, squash, words
from beaconry.session import measured_side

_PARTS = rf"({WORD}+)([^{WORD[1:]}*)"


def prepared(terms: DataFrame) -> DataFrame:
    """(kind, code, term, is_prefix, n, rank) of vocabulary rows (kind, code, term, is_prefix): folded, each once."""
    folded = terms.select("kind", "code", "is_prefix", fold(squash(F.col("term"))).alias("term")).distinct()
    marked = F.concat("term", F.when(F.col("is_prefix"), F.lit("*")).otherwise(F.lit("")))
    rank = F.struct((-F.length(marked)).alias("size"), marked.alias("marked"))
    return folded.select("kind", "code", "term", "is_prefix", F.size(words(F.col("term"))).alias("n"), rank.alias("rank"))


def fits() -> Column:
    return F.col("term").rlike(rf"(?s)^{WORD}(.*{WORD})?$")


def unfit_terms(terms: DataFrame) -> DataFrame:
    """Terms that do not begin and end with a word character."""
    return prepared(terms).where(~fits())


def tokens(items: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, words, gaps) of the folded fields; ``gaps`` is what follows each word."""
    both = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), fold(squash(F.col(f))).alias("x")) for f in fields)))
    cut = items.select(key, both.alias("f")).select(key, "f.field", F.col("f.x").alias("x"))
    found = [F.regexp_extract_all("x", F.lit(_PARTS), F.lit(i)).alias(name) for i, name in ((1, "words"), (2, "gaps"))]
    return cut.select(key, "field", *found)


def runs(texts: DataFrame, key: str, longest: int, prefix_sizes: list[int]) -> DataFrame:
    """(key, field, at, n, is_prefix, term, text): every run of up to ``longest`` words under the terms it may stand for."""
    each = texts.select(key, "field", "words", "gaps", F.posexplode("words").alias("at", "word"))
    options = []
    for n in range(1, longest + 1):
        inside = [p for i in range(n - 1) for p in (F.get("words", F.col("at") + i), F.get("gaps", F.col("at") + i))]
        last = F.get("words", F.col("at") + (n - 1))
        head = F.concat(*inside) if inside else F.lit("")
        text = F.concat(head, last)
        options.append(F.struct(F.lit(n).alias("n"), F.lit(False).alias("is_prefix"), text.alias("term"), text.alias("text")))
        for size in prefix_sizes:
            cut = F.when(F.length(last) >= size, F.concat(head, F.left(last, F.lit(size))))
            options.append(F.struct(F.lit(n).alias("n"), F.lit(True).alias("is_prefix"), cut.alias("term"), text.alias("text")))
    return each.select(key, "field", "at", F.inline(F.array(*options))).where("term IS NOT NULL")


def taken(hits: DataFrame, by: list[str]) -> DataFrame:
    """Of hits (at, n, text) the ones a scan from the left takes: none begins before the one taken last has ended."""
    line = Window.partitionBy(*by).orderBy("at")
    reach = F.max(F.col("at") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    chained = hits.withColumn("chain", F.sum(F.when(F.col("at") < reach, 0).otherwise(1)).over(line))
    chains = chained.groupBy(*by, "chain").agg(F.array_sort(F.collect_list(F.struct("at", "n", "text"))).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("texts"))

    def step(state: Column, hit: Column) -> Column:
        free = hit["at"] >= state["end"]
        end = F.when(free, hit["at"] + hit["n"]).otherwise(state["end"])
        return F.struct(end.alias("end"), F.when(free, F.array_append(state["texts"], hit["text"])).otherwise(state["texts"]).alias("texts"))

    walked = F.when(F.size("hits") == 1, F.array(F.col("hits")[0]["text"])).otherwise(F.aggregate("hits", start, step, lambda s: s["texts"]))
    return chains.select(*by, F.explode(walked).alias("text"))


def _hits(texts: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """The best hit of every place and code: (key, field, kind, code, at, n, text)."""
    stored = measured_side(terms.where(fits()))
    shape = stored.agg(F.max("n").alias("longest"), F.collect_set(F.when(F.col("is_prefix"), F.length(F.element_at(words(F.col("term")), -1)))).alias("sizes")).first()
    found = runs(texts, key, shape["longest"] or 1, sorted(shape["sizes"]))
    met = found.join(stored, ["n", "is_prefix", "term"])
    best = F.min_by(F.struct("n", "text"), "rank")
    return met.groupBy(key, "field", "kind", "code", "at").agg(best.alias("best")).select(key, "field", "kind", "code", "at", "best.*")


def term_hits(items: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """Distinct matched strings (key, kind, code, term, in_title) of items (key, title, text).

    ``terms`` has (kind, code, term, is_prefix); terms of the kind ``exclude`` are blanked out before regions are matched.
    """
    known, texts = prepared(terms), tokens(items, key, ("title", "text"))
    by = [key, "field", "kind", "code"]
    taken_topics = taken(_hits(texts, key, known.where("kind = 'topic'")), by)
    false_friends = _spans(_hits(texts, key, known.where("kind = 'exclude'")), [key, "field"])
    # a blanked word is no word of a region term, and what stood around it is no neighbour
    blanked = texts.join(false_friends, [key, "field"], "left")
    gone = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    parts = F.transform("words", lambda w, i: F.when(~F.array_contains(gone, i), w))
    whole = blanked.select(key, "field", parts.alias("words"), "gaps")
    taken_regions = taken(_hits(whole, key, known.where("kind = 'region'")), by)
    found = taken_regions.unionByName(taken_topics)
    return found.groupBy(key, "kind", "code", F.col("text").alias("term")).agg(F.bool_or(F.col("field") == "title").alias("in_title"))


def _spans(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, gone): the places of all words inside the hits that a scan takes."""
    places = hits.select(*by, "at", "n", F.concat_ws(":", F.col("at"), F.col("n")).alias("text"))
    kept = taken(places, by).select(*by, F.split("text", ":").alias("s"))
    inside = kept.select(*by, F.explode(F.sequence(F.col("s")[0].cast("int"), F.col("s")[0].cast("int") + F.col("s")[1].cast("int") - 1)).alias("at"))
    return inside.groupBy(*by).agg(F.collect_set("at").alias("gone"))
