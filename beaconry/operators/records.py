"""Record exports: facets, boards, publishers, entity lists, names and orderings.

A record is (id, kind, type, status, start, title, regions array, sources array, lon, lat).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beaconry.operators.scan import number_rows
from beaconry.session import cut_lineage, small_side

# The base32 alphabet of record ids; its first ten characters carry the creation time.
ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"
TIME_CHARS = 10


def id_time(record_id: Column) -> Column:
    """Creation time in the top bits of the 26 characters after the prefix."""
    code = F.substring_index(record_id, "_", -1)
    letters = F.split(F.substring(code, 1, TIME_CHARS), "")

    def digit(letter: Column) -> Column:
        return (F.position(letter, F.lit(ALPHABET)) - 1).cast("bigint")

    millis = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0).cast("bigint"), lambda acc, c: acc * 32 + digit(c))
    return F.timestamp_millis(millis)


def records_by_month(records: DataFrame) -> DataFrame:
    """Counts per kind and creation month, with the folder the month's records live in."""
    made = records.select(F.substring("id", 1, 3).alias("kind"), id_time(F.col("id")).alias("at"))
    folder = F.concat_ws("/", F.lit("data"), "kind", F.date_format("at", "yyyy"), F.date_format("at", "MM"))
    return made.select("kind", folder.alias("folder")).groupBy("kind", "folder").agg(F.count(F.lit(1)).alias("n"))


def _domain() -> Column:
    return F.substring_index("type", ".", 1)


def facet_search(records: DataFrame, labels: dict[str, str], region=None, domain=None, status=None, since=None, query=None) -> DataFrame:
    """Conjunction of the facets that are set; the search text looks at id, type, title and regions."""
    found = records
    if region:
        found = found.where(F.array_contains("regions", region))
    if domain:
        found = found.where(_domain() == domain)
    if status:
        found = found.where(F.col("status") == status)
    if since:
        found = found.where(F.date_format("start", "yyyy-MM-dd") >= since)
    if query and query.strip():
        names = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
        labelled = F.transform("regions", lambda r: F.coalesce(names[r], r))
        hay = F.lower(F.concat_ws(" ", "id", "type", "title", F.concat_ws(" ", "regions"), F.concat_ws(" ", labelled)))
        found = found.where(hay.contains(query.strip().lower()))
    return found


def facet_counts(records: DataFrame) -> DataFrame:
    """Region, domain and status counts with the newest start and the share of all records; one shuffle."""

    def facet(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), value.alias("value"))

    facets = F.concat(
        F.transform("regions", lambda r: facet("region", r)),
        F.array(facet("domain", _domain()), facet("status", F.col("status")), facet("all", F.lit("all"))),
    )
    counts = records.select("start", F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("newest"))
    top = counts.where("facet = 'region'").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("_top"))
    whole = counts.where("facet = 'all'").select(F.col("n").alias("_all"))
    joined = counts.join(F.broadcast(whole)).join(F.broadcast(top))  # one-row sides
    busiest = (F.col("facet") == "region") & (F.col("value") == F.col("_top"))
    return joined.select("facet", "value", "n", "newest", F.round(F.col("n") / F.col("_all"), 4).alias("share"), busiest.alias("busiest"))


def facet_options(vocabulary: DataFrame, records: DataFrame) -> DataFrame:
    """Vocabulary entries and whether any record uses them."""
    used = records.select(_domain().alias("domain")).distinct().withColumn("used", F.lit(True))
    return vocabulary.join(used, "domain", "left").withColumn("used", F.coalesce("used", F.lit(False)))


def colocated(records: DataFrame, digits: int = 2) -> DataFrame:
    """Records at the same rounded point: how many, and the newest of them."""
    placed = records.where("lon IS NOT NULL AND lat IS NOT NULL")
    return placed.groupBy(F.round("lon", digits).alias("lon"), F.round("lat", digits).alias("lat")).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("id", F.struct("start", "id")).alias("representative")
    )


def unplaced(records: DataFrame) -> DataFrame:
    """Records without a point per first region; ``unverified`` if any is, else the newest one's status."""
    away = records.where("(lon IS NULL OR lat IS NULL) AND size(regions) > 0")
    return away.groupBy(F.get("regions", F.lit(0)).alias("region")).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.bool_or(F.col("status") == "unverified"), "unverified").otherwise(F.max_by("status", F.struct("start", "id"))).alias("mark"),
    )


def publishers(records: DataFrame) -> DataFrame:
    """Distinct publishers per record: the registry reference, else the host of the link."""

    def name(s: Column) -> Column:
        host = F.get(F.split(s["url"], "/"), F.lit(2))
        return F.coalesce(s["ref"], host)

    named = F.array_distinct(F.filter(F.transform("sources", name), lambda p: p.isNotNull() & (p != "")))
    return records.select("id", F.size(named).alias("publishers")).withColumn("single_source", F.col("publishers") == 1)


def region_of(rows: DataFrame, regions: DataFrame, country: str) -> DataFrame:
    """Country to region by the list each region carries; unlisted countries get none."""
    listed = regions.select("region", F.explode("countries").alias(country))
    return rows.join(small_side(listed), country, "left")


def board_rank(regions: DataFrame, by: str) -> DataFrame:
    """Board order by activity or by record count, the other one second, label last."""
    keys = ["activity", "n"] if by == "activity" else ["n", "activity"]
    order = [F.coalesce(F.col(k), F.lit(0)).desc() for k in keys] + [F.col("label")]
    return number_rows(regions, order, column="rank")


def canonical_order(features: DataFrame, listed: DataFrame, arrival: str) -> DataFrame:
    """Listed ids first in list order, the others after them in arrival order."""
    placed = features.join(small_side(listed), "id", "left").withColumn("_pos", F.coalesce(F.col("pos"), F.lit(2**31 - 1)))
    return number_rows(placed, [F.col("_pos"), F.col(arrival)], column="rank").drop("_pos", "pos")


def union_precedence(first: DataFrame, second: DataFrame, key: str, watch: list[str]) -> DataFrame:
    """All of the first list, and of the second what the first does not carry; rows without a key stay.

    ``watch`` marks rows whose flag, owner or former flags mention one of the words.
    """
    known = first.where(F.col(key).isNotNull()).select(key).distinct()
    both = first.unionByName(second.join(known, key, "left_anti"), allowMissingColumns=True)
    hay = F.lower(F.concat_ws(" ", "flag", "owner", F.concat_ws(" ", "former_flags")))
    marked = F.lit(False)
    for word in watch:
        marked = marked | hay.contains(word)
    return both.withColumn("watch", marked)


def flag_routes(entities: DataFrame) -> DataFrame:
    """First former flag to current flag, with how many entities took that way."""
    moved = entities.where((F.size("former_flags") > 0) & F.col("flag").isNotNull())
    return moved.groupBy(F.get("former_flags", F.lit(0)).alias("from_flag"), F.col("flag").alias("to_flag")).agg(F.count(F.lit(1)).alias("n"))


def entity_order(entities: DataFrame) -> DataFrame:
    """Deterministic order: with former flags first, then flag (none last), name, id."""
    order = [F.size("former_flags") == 0, F.coalesce("flag", F.lit("zz")), F.coalesce("name", F.lit("")), F.col("id")]
    return number_rows(entities, order, column="ord")


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.agg(
        F.count(F.lit(1)).alias("entities"), F.count("imo").alias("with_imo"), F.count_if(F.size("former_flags") > 0).alias("with_former_flag"), F.count_if("watch").alias("watch")
    )


def entity_assemble(primary: DataFrame, translated: DataFrame, keys: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Primary rows with their translated name, place key and coordinates; the second table lists what
    is missing and must be empty before the first is published. Overrides in the key table win."""
    joined = primary.join(translated, "id", "left").join(keys, "key", "left").join(places, "place", "left")
    missing = joined.where(F.col("place").isNull() | F.col("lon").isNull()).select("id", F.when(F.col("place").isNull(), "key").otherwise("place").alias("missing"))
    done = joined.where(F.col("place").isNotNull() & F.col("lon").isNotNull())
    return done.select("id", "kind", "name", "name_local", F.coalesce("city_override", "city").alias("city"), "lon", "lat"), missing


def lookup_fallback(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Second-language name by (name, country), else by name alone."""
    exact = names.where("country IS NOT NULL").select("name", "country", F.col("local").alias("_exact"))
    plain = names.where("country IS NULL").select("name", F.col("local").alias("_plain"))
    joined = rows.join(small_side(exact), ["name", "country"], "left").join(small_side(plain), "name", "left")
    return joined.withColumn("local", F.coalesce("_exact", "_plain")).drop("_exact", "_plain")


def unused_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Dictionary entries that no row needed."""
    exact = rows.select("name", "country").distinct()
    used = names.where("country IS NOT NULL").join(exact, ["name", "country"], "left_semi")
    open_ = exact.join(used.select("name", "country"), ["name", "country"], "left_anti").select("name").distinct()
    plain = names.where("country IS NULL").join(open_, "name", "left_semi")
    keyed = names.withColumn("_c", F.coalesce("country", F.lit(-1)))
    taken = used.unionByName(plain).select("name", F.coalesce("country", F.lit(-1)).alias("_c"))
    return keyed.join(taken, ["name", "_c"], "left_anti").drop("_c")


def tiered_keep(places: DataFrame, tiers: DataFrame, limits: dict[str, tuple[int, int]], far: int, forced: list[str], box: tuple) -> DataFrame:
    """Capitals and forced names stay; others by the population or rank threshold of their country's tier."""
    west, south, east, north = box
    tiered = places.where(F.col("lon").between(west, east) & F.col("lat").between(south, north)).join(small_side(tiers), "country", "left")
    population, rank = F.coalesce("population", F.lit(0)), F.coalesce("rank", F.lit(99))
    rule = population >= far
    for tier, (people, best) in limits.items():
        rule = F.when(F.col("tier") == tier, (population >= people) | (rank <= best)).otherwise(rule)
    return tiered.where(F.col("capital") | F.col("name").isin(*forced) | rule)


def pinned_cap(places: DataFrame, limit: int) -> DataFrame:
    """Pinned rows always; of the others the most populous fill up to ``limit``."""
    room = max(0, limit - places.where("pinned").count())
    rest = places.where("NOT pinned").orderBy(F.col("population").desc(), "name", "id").limit(room)
    return places.where("pinned").unionByName(rest)


def kind_counts(rows: DataFrame, in_scope: DataFrame) -> DataFrame:
    """Counts per kind; kinds out of scope are reported as skipped."""
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(small_side(in_scope.withColumn("_in", F.lit(True))), "kind", "left").select("kind", "n", F.col("_in").isNull().alias("skipped"))


def set_diff(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys in use that the dictionary does not know, and dictionary keys nobody uses."""
    a, b = used.select(key).distinct(), known.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("unknown")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("unused")))


def union_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def top_rows(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def top_per_group(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """First rows of each group; the limit is applied map-side before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


def to_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row as text; properties without a value are left out."""
    geometry = F.struct(F.array("lon", "lat").alias("coordinates"), F.lit("Point").alias("type"))
    return rows.select("id", F.to_json(F.struct(geometry.alias("geometry"), F.struct(*properties).alias("properties"), F.lit("Feature").alias("type"))).alias("feature"))


def prune_plan(files: DataFrame, keep: str, today: Column, days: int, max_files: int) -> DataFrame:
    """Batch files to delete: recognised names only, too old, or the oldest beyond max - 1; never ``keep``."""
    shape = r"^(\d{4}-\d{2}-\d{2})-[0-9a-z]{1,32}\.json$"
    own = files.where(F.col("name").rlike(shape) & (F.col("name") != keep)).select("name").distinct()
    dated = own.withColumn("day", F.regexp_extract("name", shape, 1).cast("date"))
    old = dated.where(F.col("day") < F.date_sub(today, days))
    recent = dated.where(F.col("day") >= F.date_sub(today, days))
    room = max(0, max(1, max_files) - 1)
    spared = recent.orderBy(F.col("name").desc()).limit(room).select("name")
    over = recent.join(small_side(spared), "name", "left_anti")
    return old.select("name", F.lit("age").alias("why")).unionByName(over.select("name", F.lit("count").alias("why")))


def key_audit(rows: DataFrame, properties: str, allowed: list[str], forbidden: str) -> DataFrame:
    """Property keys at every level of a JSON column: how often each occurs, forbidden or not listed.

    One pass per level over what the level before held inside, until nothing is nested any more. Items of a list count
    as members of the key that holds it.
    """
    level, counts, top = rows.select(F.lit("").alias("path"), F.col(properties).alias("json")), None, True
    while True:
        items = F.transform(F.from_json("json", "array<string>"), lambda x: F.struct(F.col("path").alias("path"), F.lit(None).cast("string").alias("name"), x.alias("json")))
        members = F.transform(
            F.map_entries(F.from_json("json", "map<string,string>")),
            lambda e: F.struct(F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), e["key"]).alias("path"), e["key"].alias("name"), e["value"].alias("json")),
        )
        inner = cut_lineage(level.select(F.explode(F.when(F.col("json").startswith("["), items).otherwise(members)).alias("x")).select("x.*"))
        unlisted = ~F.col("name").isin(*allowed) if top else F.lit(False)
        verdict = F.when(F.col("name").rlike(forbidden), "forbidden").when(unlisted, "not listed").otherwise("ok")
        found = inner.where("name IS NOT NULL").groupBy("path", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
        counts = found if counts is None else counts.unionByName(found)
        # a list at the top leaves its items at the top
        top = top and inner.where("name IS NOT NULL").isEmpty()
        level = inner.where(F.col("json").startswith("{") | F.col("json").startswith("["))
        if level.isEmpty():
            return counts.groupBy("path", "verdict").agg(F.sum("n").alias("n"))
