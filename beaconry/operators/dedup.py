"""Exact and near-duplicate exclusion.

Near means a Hamming distance of at most ``distance`` bits between 64-bit signatures. The word is
cut into ``distance + 3`` blocks; two near values agree on at least three of them, so an equi-join
on every choice of three blocks loses nothing. Choices whose bucket is crowded are joined through
shared neighbours instead: values at distance d meet at a point within d//2 of one and d - d//2 of
the other, so no bucket ever emits all of its pairs.

A value has one key for each choice, and size estimates do not see that: joins of keys ask for a merge, or the optimizer
takes millions of keys for a small table and broadcasts them through the driver.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.hashing import BITS
from beaconry.operators.scan import first_by
from beaconry.session import cut_lineage

NEAR_BITS = 3
AGREEING_BLOCKS = 3
CROWDED = 1000


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _masks(distance: int) -> list[int]:
    blocks = distance + AGREEING_BLOCKS
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(block, AGREEING_BLOCKS)]


def keyed(values: DataFrame, distance: int = NEAR_BITS, *carried: str) -> DataFrame:
    """(hash, choice, key) of every ``hash``: one key for each choice of blocks, numbers of different choices apart."""
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("choice"), F.xxhash64(F.lit(i), F.col("hash").bitwiseAND(F.lit(_signed(m)))).alias("key"))
            for i, m in enumerate(_masks(distance))
        ]
    )
    return values.select("hash", *carried, F.explode(keys).alias("k")).select("hash", *carried, "k.choice", "k.key")


def _flips(spark, masks: list[int], radius: int) -> DataFrame:
    """Bit patterns of at most ``radius`` ones outside each mask: fixed in size by the word length."""
    rows = []
    for choice, mask in enumerate(masks):
        free = [1 << b for b in range(BITS) if not mask >> b & 1]
        for r in range(radius + 1):
            rows += [(choice, _signed(sum(bits))) for bits in combinations(free, r)]
    return spark.createDataFrame(rows, "choice int, flip bigint")


def near_pairs(left: DataFrame, right: DataFrame | None = None, distance: int = NEAR_BITS, crowded: int = CROWDED) -> DataFrame:
    """Distinct (a, b) of distinct ``hash`` values within ``distance``: a < b inside one table,
    a from ``left`` and b from ``right`` for two. Equal values are a pair only across two tables."""
    a = keyed(left.select("hash").distinct(), distance)
    return near_keyed(a, None if right is None else keyed(right.select("hash").distinct(), distance), distance, crowded)


def near_keyed(a: DataFrame, b: DataFrame | None, distance: int = NEAR_BITS, crowded: int = CROWDED) -> DataFrame:
    """As ``near_pairs``, of tables that are keyed already (hash, choice, key)."""
    spark, own, masks = a.sparkSession, b is None, _masks(distance)
    b = a if own else b
    load = a.select("key") if own else a.select("key").unionByName(b.select("key"))
    full = load.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).drop("n")
    full = cut_lineage(full)
    x, y = F.col("x.hash"), F.col("y.hash")
    # A pair agrees on several choices; it is emitted by the first of them only.
    apart = x.bitwiseXOR(y)
    agreeing = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)])
    valid = (F.bit_count(apart) <= distance) & (agreeing == F.col("x.choice")) & (agreeing == F.col("y.choice"))

    def thin(left_keys: DataFrame, right_keys: DataFrame) -> DataFrame:
        met = left_keys.alias("x").join(right_keys.alias("y").hint("merge"), "key")
        return met.where(valid & (x < y if own else F.lit(True))).select(x.alias("a"), y.alias("b"))

    if full.isEmpty():
        return thin(a, b)

    def around(of: DataFrame, radius: int) -> DataFrame:
        flips = F.broadcast(_flips(spark, masks, radius))
        return of.join(flips, "choice").select("choice", "key", "hash", F.col("hash").bitwiseXOR(F.col("flip")).alias("meet"))

    def keys(of: DataFrame, how: str) -> DataFrame:
        return of.join(full, "key", how)

    near, far = around(keys(a, "left_semi"), distance // 2), around(keys(b, "left_semi"), distance - distance // 2)
    met = near.alias("x").join(far.alias("y").hint("merge"), ["key", "meet"]).where(valid & (x != y if own else F.lit(True)))
    shared = met.select((F.least(x, y) if own else x).alias("a"), (F.greatest(x, y) if own else y).alias("b")).distinct()
    return thin(keys(a, "left_anti"), keys(b, "left_anti")).unionByName(shared)


#: Columns of a stored ledger beside its key: a signature under one choice of blocks, or an id where the choice is -1.
LEDGER = "choice INT, hash BIGINT, queue_id STRING"


def _id_key(queue_id: Column) -> Column:
    return F.xxhash64(F.lit(-1), queue_id)


def ledger_rows(items: DataFrame, distance: int = NEAR_BITS) -> DataFrame:
    """What a stored ledger keeps of (queue_id, simhash, seen): the id, and the signature under every choice.

    The zero signature is kept by its id only, as it is near nothing.
    """
    none = F.lit(None)
    ids = items.select(_id_key(F.col("queue_id")).alias("key"), F.lit(-1).alias("choice"), none.cast("long").alias("hash"), "queue_id", "seen")
    signed = items.where("simhash <> 0").groupBy(F.col("simhash").alias("hash")).agg(F.max("seen").alias("seen"))
    return ids.unionByName(keyed(signed, distance, "seen").select("key", "choice", "hash", none.cast("string").alias("queue_id"), "seen"))


def unlisted(items: DataFrame, ledger, distance: int = NEAR_BITS, but: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """Items (queue_id, simhash) whose id is not in the stored ledger and whose signature is near none of it.

    Only the items are keyed and shuffled: the ledger, a ``KeyedStore`` of ``LEDGER`` rows, is read in the buckets they touch.
    """
    known = ledger.matching(items.select(_id_key(F.col("queue_id")).alias("key")), but).where("choice = -1").select("queue_id").distinct()
    fresh = cut_lineage(items.join(known, "queue_id", "left_anti"))
    if distance < 0:
        return fresh
    mine = keyed(fresh.where("simhash <> 0").select(F.col("simhash").alias("hash")).distinct(), distance)
    theirs = ledger.matching(mine, but).where("choice >= 0").select("hash", "choice", "key")
    matched = near_keyed(mine, theirs, distance, crowded).select(F.col("a").alias("simhash")).distinct()
    return fresh.join(matched, "simhash", "left_anti").select(*items.columns)


def ledger_exact(items: DataFrame, ledger: DataFrame, key: str = "queue_id") -> DataFrame:
    """Items whose id is not in the ledger. The distinct ids are the only thing compared."""
    return items.join(ledger.select(key).distinct(), key, "left_anti")


def ledger_near(items: DataFrame, ledger: DataFrame, distance: int = NEAR_BITS, crowded: int = CROWDED) -> DataFrame:
    """Items whose signature is not near any ledger signature; zero never matches, distance < 0 disables."""
    if distance < 0:
        return items
    fresh = items.where(F.col("simhash") != 0).select(F.col("simhash").alias("hash"))
    known = ledger.where(F.col("simhash") != 0).select(F.col("simhash").alias("hash"))
    matched = near_pairs(fresh, known, distance, crowded).select(F.col("a").alias("simhash")).distinct()
    return items.join(matched, "simhash", "left_anti")


def near_dedup(items: DataFrame, distance: int = NEAR_BITS, crowded: int = CROWDED, max_rounds: int = 10_000) -> DataFrame:
    """First-wins dedup in arrival order ``ord``: an item goes if an earlier *kept* item has its
    ``queue_id`` or a near ``simhash``. A dropped item suppresses nothing.

    Copies collapse first, by aggregation. What is left is decided in rounds: an undecided item with
    a kept earlier neighbour goes; one with no undecided earlier neighbour stays. Each round is a
    few keyed aggregations, checkpointed, so rounds neither repeat work nor depend on lost executors.
    Pass slim rows: the signature is computed once, in the checkpoint this starts from.
    """
    items = cut_lineage(items)  # read for the nodes and again for the result
    nodes = items.groupBy("queue_id", "simhash").agg(F.min("ord").alias("ord"))
    per_id = nodes.groupBy("queue_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "simhash")).alias("one"))
    alone = per_id.where("n = 1").select("queue_id", "one.simhash", "one.ord")
    shared = nodes.join(per_id.where("n > 1").select("queue_id"), "queue_id", "left_semi")
    # Among items with an id of their own, only the first of each signature can stay.
    blank = alone.where("simhash = 0")
    leaders = alone.where("simhash <> 0").groupBy("simhash").agg(F.min(F.struct("ord", "queue_id")).alias("one"))
    leaders = leaders.select("one.queue_id", "simhash", "one.ord")
    late = leaders.select("simhash", F.col("ord").alias("_lead"))
    shared = shared.join(late, "simhash", "left").where(F.col("_lead").isNull() | (F.col("ord") < F.col("_lead"))).drop("_lead")
    state = blank.unionByName(leaders).unionByName(shared).withColumn("kept", F.lit(None).cast("boolean"))
    state = cut_lineage(state)

    hashes = state.where("simhash <> 0").select(F.col("simhash").alias("hash")) if distance >= 0 else state.limit(0).select(F.col("simhash").alias("hash"))
    pairs = near_pairs(hashes, distance=max(distance, 0), crowded=crowded)
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut_lineage(pairs.select(F.inline(both)))

    def earliest(key: str) -> list[Column]:
        kept = F.min(F.when(F.col("kept"), F.col("ord")))
        undecided = F.min(F.when(F.col("kept").isNull(), F.col("ord")))
        return [kept.alias(f"kept_{key}"), undecided.alias(f"open_{key}")]

    for _ in range(max_rounds):
        by_id = state.groupBy("queue_id").agg(*earliest("id"))
        by_hash = state.where("simhash <> 0").groupBy("simhash").agg(*earliest("hash"))
        by_link = (
            links.join(by_hash, links.b == by_hash.simhash)
            .groupBy(F.col("a").alias("simhash"))
            .agg(F.min("kept_hash").alias("kept_link"), F.min("open_hash").alias("open_link"))
        )
        seen = state.join(by_id, "queue_id").join(by_hash, "simhash", "left").join(by_link, "simhash", "left")
        blocked = F.least("kept_id", "kept_hash", "kept_link") < F.col("ord")
        waiting = F.least("open_id", "open_hash", "open_link") < F.col("ord")
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(blocked, False).when(~waiting, True)
        state = cut_lineage(seen.select("queue_id", "simhash", "ord", decided.alias("kept")))
        if state.where("kept IS NULL").isEmpty():
            break
    else:
        raise RuntimeError(f"near_dedup did not settle in {max_rounds} rounds")
    return items.join(state.where("kept").select("ord"), "ord", "left_semi")


def ledger_prune(ledger: DataFrame, today: Column, days: int, max_entries: int) -> DataFrame:
    """Entries seen in the last ``days``, then the newest ``max_entries`` by file order ``ord``."""
    recent = ledger.where(F.col("seen") >= F.date_sub(today, days))
    return recent.orderBy(F.col("ord").desc()).limit(max_entries)


def first_wins(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First occurrence per key in arrival order with the number of copies seen."""
    return first_by(items, keys, order)

