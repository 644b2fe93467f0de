"""URL filters (operator 7): a Bloom filter cascade with exact membership over a closed set of keys.

Level 1 is a Bloom filter of the listed keys, level 2 one of the other keys that pass level 1, level 3 one of the listed
keys that pass level 2, and so on until nothing passes wrongly. A key of the corpus is listed exactly if the first level
it fails has an even number, or if it passes all and their number is odd. Building looks at every distinct key of the
corpus; asking needs no join, only the filters. Their bits grow with the list, so a list of over ``SLICE_KEYS`` keys
is cut into slices by hash, each with a cascade of its own; slices are built and asked one after the other.

Rules (host, path prefix) become keys too: a url asks for the last labels of its host with the first characters of its
path, for the label counts and lengths that occur among the rules, and the longest listed key is its rule. A url without
rule is blocked if its host is listed.

Defined cases: a null url, and one without ``://``, has an empty host and path, no rule, and is allowed; repeated rows
and null ids are judged one by one; an empty list or table gives verdicts without rules or no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.session import cut_lineage

BITS_PER_KEY, HASHES = 8, 4
#: Listed keys of one cascade at most, so that no broadcast filter passes about 4 MB.
SLICE_KEYS = 4_000_000
#: Bits of the fixed-size filters that spare most rows a shuffle (``possible_members``).
FIXED_BITS = 1 << 24
_LOW = (1 << 40) - 1


def hash_pair(key: Column, salt: int) -> tuple[Column, Column]:
    """Two numbers of 40 bits from a key."""
    return tuple(F.xxhash64(F.lit(2 * salt + i), key).bitwiseAND(F.lit(_LOW)) for i in (0, 1))


@dataclass(frozen=True)
class Filter:
    words: np.ndarray
    salt: int

    @classmethod
    def of(cls, keys: DataFrame, pair: tuple[Column, Column], bits: int, salt: int = 0) -> Filter:
        """Bits are set by an aggregation; the driver gets the words, whose number is bounded by ``bits``."""
        bits = max(64, -(-bits // 64) * 64)
        a, b = pair
        places = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: (a + i * b) % bits)
        found = keys.select(F.explode(places).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("v"))
        table = found.toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[table.column("w").to_numpy()] = table.column("v").to_numpy().view(np.uint64)
        return cls(words, salt)

    def hits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found, bits = np.ones(len(a), bool), 64 * len(self.words)
        for i in range(HASHES):
            p = (a + i * b) % bits
            found &= (self.words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found


def possible_members(ids: DataFrame, pair: tuple[Column, Column]) -> Filter:
    """A filter of fixed size: what it refuses is surely not in ``ids``; it only spares work, so it may fill up."""
    return Filter.of(ids, pair, FIXED_BITS)


def passing(rows: DataFrame, members: Filter, pair: tuple[Column, Column], wanted: bool) -> DataFrame:
    """The rows whose pair the filter passes, or those it refuses; other columns stay on the JVM."""
    shared = rows.sparkSession.sparkContext.broadcast(members)

    @F.pandas_udf("boolean")
    def passes(a, b):
        import pandas as pd

        return pd.Series(shared.value.hits(a.to_numpy(), b.to_numpy()))

    verdict = passes(*pair)
    return rows.where(verdict if wanted else ~verdict)


def asked(rows: DataFrame, filters: list[Filter], key: str, into: str) -> DataFrame:
    """``rows`` with the boolean column ``into``: is ``key`` listed, by the cascade ``filters``."""
    shared = rows.sparkSession.sparkContext.broadcast(filters)
    names = [f"__{side}{i}" for i in range(len(filters)) for side in "ab"]
    hashed = rows.select("*", *(h.alias(n) for n, h in zip(names, (x for f in filters for x in hash_pair(F.col(key), f.salt)), strict=True)))

    @F.pandas_udf("boolean")
    def listed(*columns):
        import pandas as pd

        values = [c.to_numpy() for c in columns]
        out, open_ = np.zeros(len(values[0]), bool), np.ones(len(values[0]), bool)
        for i, level in enumerate(shared.value):
            hit = level.hits(values[2 * i], values[2 * i + 1])
            out[open_ & ~hit] = i % 2 == 1  # failing an even-numbered level, counted from 1, means listed
            open_ &= hit
        out[open_] = len(shared.value) % 2 == 1
        return pd.Series(out)

    return hashed.withColumn(into, listed(*names)).drop(*names)


def cascade(listed: DataFrame, others: DataFrame) -> list[Filter]:
    """The levels for two disjoint tables of distinct ``key``s."""
    levels: list[Filter] = []
    inside, outside = listed, others
    while True:
        n = inside.count()
        levels.append(Filter.of(inside, hash_pair(F.col("key"), len(levels)), BITS_PER_KEY * n, len(levels)))
        passing = cut_lineage(asked(outside, levels[-1:], "key", "hit").where("hit").select("key"))
        if passing.isEmpty():
            return levels
        inside, outside = passing, inside


def marked(rows: DataFrame, columns: list[str], listed: DataFrame, universe: DataFrame, slice_keys: int = SLICE_KEYS) -> DataFrame:
    """``rows`` with ``in_<c>`` for each of ``columns``: is its key among ``listed``; every key asked for must be in ``universe``."""
    inside = cut_lineage(listed.select("key").where("key IS NOT NULL").distinct())
    outside = cut_lineage(universe.select("key").where("key IS NOT NULL").distinct().join(inside, "key", "left_anti"))
    slices = max(1, -(-inside.count() // slice_keys))

    def own(column: str, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(77), F.col(column)), F.lit(slices)) == i

    result = rows.withColumns({f"in_{c}": F.lit(False) for c in columns})
    for i in range(slices):
        levels = cascade(inside.where(own("key", i)), outside.where(own("key", i)))
        for c in columns:
            result = asked(result, levels, c, "__hit").withColumn(f"in_{c}", F.col(f"in_{c}") | (F.col("__hit") & own(c, i) & F.col(c).isNotNull())).drop("__hit")
        if slices > 1:
            result = cut_lineage(result)
    return result


#: Fixed values of the query: (action, host, path prefix).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labels that put a host on the list of the query.
AD_LABEL = r"(^|[.-])(ads?|adserver|track|tracker|tracking|banner|banners|click|clicks|pixel)([.-]|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every url, by the first ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    parts = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER)
    return parts.select("page_id", host.alias("host"), F.regexp_extract("rest", r"^([^/?#]*)([^?#]*)", 2).alias("path"))


def rule_keys(rules) -> list[Column]:
    """The keys by which a url may meet a rule: the last labels of its host with the first characters of its path."""
    labels, keys = F.split("host", r"\."), []
    for depth in sorted({host.count(".") + 1 for _, host, _ in rules}):
        for size in sorted({len(path) for _, _, path in rules}):
            fits = (F.size(labels) >= depth) & (F.length("path") >= size) & (F.col("host") != "")
            keys.append(F.when(fits, F.concat(F.array_join(F.slice(labels, -depth, depth), "."), F.substring("path", 1, size))))
    return keys


def judged(pages: DataFrame, rules=RULES, listed_hosts: DataFrame | None = None, slice_keys: int = SLICE_KEYS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page; ``listed_hosts`` (host) defaults to the corpus's advertising hosts."""
    urls = host_and_path(pages)
    if listed_hosts is None:
        listed_hosts = urls.select("host").distinct().where(F.col("host").rlike(AD_LABEL))
    actions = {host + path: action for action, host, path in rules}
    listed = pages.sparkSession.createDataFrame([(k,) for k in actions], "key string").unionByName(listed_hosts.select(F.col("host").alias("key")))
    rule_columns = {f"k{i}": key for i, key in enumerate(rule_keys(rules))}
    wide = urls.withColumns(rule_columns)
    names = [*rule_columns, "host"]
    universe = wide.select(F.explode(F.array(*names)).alias("key"))
    found = marked(wide, names, listed, universe, slice_keys)
    longest = F.array_max(F.array(*(F.when(F.col(f"in_{k}"), F.struct(F.length(k).alias("n"), F.col(k).alias("rule"))) for k in rule_columns)))
    action = F.create_map(*(F.lit(x) for pair in actions.items() for x in pair))
    own = F.when(F.col("in_host"), "block").otherwise("allow")
    verdicts = found.select("page_id", "host", "path", longest["rule"].alias("rule"), own.alias("own"))
    return verdicts.select("page_id", "host", "path", "rule", F.coalesce(F.try_element_at(action, F.col("rule")), F.col("own")).alias("verdict"))
