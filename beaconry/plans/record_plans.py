"""Record, entity, ordering and rule queries over ``events``, ``customer``, ``supplier``, ``part`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import dims
from beaconry.operators import records as rec
from beaconry.operators import rules
from beaconry.plans.common import read, sql_literal, sql_rows, stamp, stamp_sql
from beaconry.plans.geo_plans import EDGES, FENCE, POINTS, RADIUS, _lat, _lon, fence_edges

KINDS = {"click": "evt", "view": "act", "error": "sit", "purchase": "eqp", "signup": "src"}
LABEL_OF = {"north": "Northern Water", "south": "Southern Water", "west": "Western Plain", "east": "Eastern Hills"}


def _encode(ms: str, sql: bool) -> str:
    shift = (lambda v, n: f"({v} >> {n})") if sql else (lambda v, n: f"shiftright({v}, {n})")
    return " || ".join(f"substr('{rec.ALPHABET}', cast(({shift(ms, 5 * i)} & 31) + 1 as int), 1)" for i in range(9, -1, -1))


def records(spark, sf):
    kind = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items()) + " end"
    names = "array(" + ", ".join(f"'{r}'" for r in dims.REGIONS) + ")"
    statuses = "array(" + ", ".join(f"'{s}'" for s in dims.STATUSES) + ")"
    base = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.expr("unix_millis(ts)"))
    return base.select(
        "event_id",
        F.expr(f"concat({kind}, '_', {_encode('ms', False)}, '0123456789', lpad(cast(event_id as string), 6, '0'))").alias("id"),
        F.expr("concat(event_type, '.', event_id % 3)").alias("type"),
        F.expr(f"element_at({statuses}, cast(user_id % 4 as int) + 1)").alias("status"),
        F.col("ts").alias("start"),
        F.expr("concat('Title ', event_id % 50)").alias("title"),
        F.expr(f"case when event_id % 13 = 12 then cast(array() as array<string>) when event_id % 13 < 4 then array({names}[cast(event_id % 4 as int)], {names}[cast((event_id + 1) % 4 as int)]) else array({names}[cast(event_id % 4 as int)]) end").alias("regions"),
        F.expr("array(named_struct('ref', if(event_id % 3 = 0, concat('src', user_id % 5), null), 'url', concat('https://h', event_id % 6, '.example.org/x')), named_struct('ref', if(event_id % 6 = 0, concat('src', user_id % 5), null), 'url', concat('https://h', event_id % 4, '.example.org/y')))").alias("sources"),
        F.expr(f"if(event_id % 9 = 0, null, {_lon('event_id')})").alias("lon"),
        F.expr(f"if(event_id % 9 = 0, null, {_lat('event_id')})").alias("lat"),
    )


_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
RECORDS = f"""records AS (SELECT *, {sql_literal(dims.REGIONS)} AS rn FROM (SELECT event_id, {_KIND} || '_' || {_encode('(epoch_us(ts) // 1000)', True)} || '0123456789' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS id, {_KIND} AS kind,
  event_type || '.' || (event_id % 3) AS type, event_type AS domain, {sql_literal(dims.STATUSES)}[user_id % 4 + 1] AS status, ts AS start, 'Title ' || (event_id % 50) AS title, user_id,
  CASE WHEN event_id % 9 <> 0 THEN {_lon('event_id')} END AS lon, CASE WHEN event_id % 9 <> 0 THEN {_lat('event_id')} END AS lat FROM events)),
recs AS (SELECT *, CASE WHEN event_id % 13 = 12 THEN [] WHEN event_id % 13 < 4 THEN [rn[event_id % 4 + 1], rn[(event_id + 1) % 4 + 1]] ELSE [rn[event_id % 4 + 1]] END AS regions FROM records)"""


def records_by_month(spark, sf):
    return rec.records_by_month(records(spark, sf))


RECORDS_BY_MONTH_SQL = f"WITH {RECORDS} SELECT kind, 'data/' || kind || '/' || strftime(start, '%Y/%m') AS folder, count(*) AS n FROM recs GROUP BY 1, 2"


def facet_search(spark, sf):
    found = rec.facet_search(records(spark, sf), LABEL_OF, region="north", domain="click", since="2024-01-05", query=" Southern water ")
    return found.select("event_id", "status", stamp("start").alias("start"))


FACET_SEARCH_SQL = f"""WITH {RECORDS} SELECT event_id, status, {stamp_sql('start')} AS start FROM recs WHERE list_contains(regions, 'north') AND domain = 'click' AND start >= TIMESTAMP '2024-01-05' AND list_contains(regions, 'south')"""


def facet_counts(spark, sf):
    return rec.facet_counts(records(spark, sf)).withColumn("newest", stamp("newest"))


FACET_COUNTS_SQL = f"""WITH {RECORDS}, f AS (SELECT start, 'region' AS facet, unnest(regions) AS value FROM recs UNION ALL SELECT start, 'domain', domain FROM recs UNION ALL SELECT start, 'status', status FROM recs UNION ALL SELECT start, 'all', 'all' FROM recs),
c AS (SELECT facet, value, count(*) AS n, max(start) AS newest FROM f GROUP BY 1, 2)
SELECT facet, value, n, {stamp_sql('newest')} AS newest, round(n / (SELECT n FROM c WHERE facet = 'all'), 4) AS share,
  facet = 'region' AND value = (SELECT value FROM c WHERE facet = 'region' ORDER BY n DESC, value LIMIT 1) AS busiest FROM c"""


def facet_options(spark, sf):
    return rec.facet_options(dims.table(spark, [(d,) for d in dims.DOMAIN_VOCAB], "domain string"), records(spark, sf))


FACET_OPTIONS_SQL = f"WITH {sql_rows('vocab', 'domain', [(d,) for d in dims.DOMAIN_VOCAB])} SELECT domain, domain IN (SELECT event_type FROM events) AS used FROM vocab"


def colocated(spark, sf):
    return rec.colocated(records(spark, sf).withColumn("lon", F.floor("lon").cast("double")).withColumn("lat", F.floor("lat").cast("double")))


COLOCATED_SQL = f"WITH {RECORDS} SELECT floor(lon) AS lon, floor(lat) AS lat, count(*) AS n, arg_max(id, {{'s': start, 'i': id}}) AS representative FROM recs WHERE lon IS NOT NULL GROUP BY 1, 2"


def unplaced(spark, sf):
    return rec.unplaced(records(spark, sf))


UNPLACED_SQL = f"""WITH {RECORDS} SELECT regions[1] AS region, count(*) AS n, CASE WHEN bool_or(status = 'unverified') THEN 'unverified' ELSE arg_max(status, {{'s': start, 'i': id}}) END AS mark
FROM recs WHERE lon IS NULL AND len(regions) > 0 GROUP BY 1"""


def publishers(spark, sf):
    return rec.publishers(records(spark, sf))


PUBLISHERS_SQL = f"""WITH {RECORDS}, p AS (SELECT id, list_distinct([CASE WHEN event_id % 3 = 0 THEN 'src' || (user_id % 5) ELSE 'h' || (event_id % 6) || '.example.org' END, CASE WHEN event_id % 6 = 0 THEN 'src' || (user_id % 5) ELSE 'h' || (event_id % 4) || '.example.org' END]) AS names FROM recs)
SELECT id, CAST(len(names) AS INTEGER) AS publishers, len(names) = 1 AS single_source FROM p"""


def region_of(spark, sf):
    regions = dims.table(spark, dims.REGION_COUNTRIES, "region string, countries array<int>")
    rows = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("country"))
    return rec.region_of(rows, regions, "country")


_REGION_ROWS = [(c, r) for r, cs in dims.REGION_COUNTRIES for c in cs]
REGION_OF_SQL = f"WITH {sql_rows('listed', 'country, region', _REGION_ROWS)} SELECT c_custkey, c_nationkey AS country, region FROM customer LEFT JOIN listed ON country = c_nationkey"


def _board(spark, sf):
    used = read(spark, sf, "events").groupBy(F.col("user_id").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("event_type") == "click", 1)).alias("activity"))
    return used


def board_rank(spark, sf):
    by_n = rec.board_rank(_board(spark, sf), "n").select("label", F.col("rank").alias("by_count"))
    return by_n.join(rec.board_rank(_board(spark, sf), "activity").select("label", F.col("rank").alias("by_activity")), "label")


BOARD_RANK_SQL = """WITH b AS (SELECT user_id AS label, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS a FROM events GROUP BY 1)
SELECT label, row_number() OVER (ORDER BY n DESC, a DESC, label) AS by_count, row_number() OVER (ORDER BY a DESC, n DESC, label) AS by_activity FROM b"""


def topk(spark, sf):
    newest = rec.top_rows(read(spark, sf, "events"), [F.col("ts").desc(), F.col("event_id")], 14)
    largest = rec.top_per_group(read(spark, sf, "orders"), "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)
    return rec.union_sources(newest.select(F.lit("newest").alias("list"), F.col("event_id").alias("key")), largest.select(F.col("o_orderpriority").alias("list"), F.col("o_orderkey").alias("key")))


TOPK_SQL = """SELECT * FROM (SELECT 'newest' AS list, event_id AS key FROM events ORDER BY ts DESC, event_id LIMIT 14)
UNION ALL SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 10"""


def canonical_order(spark, sf):
    listed = dims.table(spark, [(5, 0), (3, 1), (1, 2), (40, 3)], "id bigint, pos int")
    features = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("s_suppkey * 7 % 11 * 1000000 + s_suppkey").alias("arrival"))
    return rec.canonical_order(features, listed, "arrival").select("id", "rank")


CANONICAL_ORDER_SQL = """WITH l(id, pos) AS (VALUES (5, 0), (3, 1), (1, 2), (40, 3))
SELECT s_suppkey AS id, row_number() OVER (ORDER BY coalesce(pos, 2147483647), s_suppkey * 7 % 11 * 1000000 + s_suppkey) AS rank FROM supplier LEFT JOIN l ON l.id = s_suppkey"""


# ---------------------------------------------------------------- entity lists
def entities(spark, sf):
    """Two lists of entities: customers carry the fuller record, suppliers repeat some of their ids."""
    first = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.expr("if(c_custkey % 11 = 0, null, lpad(cast(1000000 + c_custkey as string), 7, '0'))").alias("imo"),
        F.expr("if(c_custkey % 17 = 0, null, concat('F', c_nationkey))").alias("flag"), F.expr("concat('Owner ', c_custkey % 100)").alias("owner"),
        F.expr("if(c_custkey % 5 = 0, array(concat('F', (c_nationkey + c_custkey) % 25), concat('F', (c_nationkey + 3) % 25)), cast(array() as array<string>))").alias("former_flags"),
    )
    second = read(spark, sf, "supplier").select(
        F.expr("s_suppkey + 100000000").alias("id"), F.col("s_name").alias("name"), F.expr("case when s_suppkey % 7 = 0 then null when s_suppkey % 2 = 0 then cast(1000000 + s_suppkey as string) else cast(9000000 + s_suppkey as string) end").alias("imo"),
        F.expr("cast(null as string)").alias("flag"), F.expr("cast(null as string)").alias("owner"), F.expr("cast(array() as array<string>)").alias("former_flags"),
    )
    return first, second


ENTITIES = """e1 AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 11 <> 0 THEN CAST(1000000 + c_custkey AS VARCHAR) END AS imo, CASE WHEN c_custkey % 17 <> 0 THEN 'F' || c_nationkey END AS flag, 'Owner ' || (c_custkey % 100) AS owner,
  CASE WHEN c_custkey % 5 = 0 THEN ['F' || ((c_nationkey + c_custkey) % 25), 'F' || ((c_nationkey + 3) % 25)] ELSE CAST([] AS VARCHAR[]) END AS former_flags FROM customer),
e2 AS (SELECT s_suppkey + 100000000 AS id, s_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN CAST(1000000 + s_suppkey AS VARCHAR) ELSE CAST(9000000 + s_suppkey AS VARCHAR) END AS imo, NULL AS flag, NULL AS owner, CAST([] AS VARCHAR[]) AS former_flags FROM supplier),
ents AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 WHERE imo IS NULL OR imo NOT IN (SELECT imo FROM e1 WHERE imo IS NOT NULL))"""
WATCH = ["owner 7", "f13"]


def merged(spark, sf):
    return rec.union_precedence(*entities(spark, sf), "imo", WATCH)


def union_precedence(spark, sf):
    return merged(spark, sf).select("id", "imo", "watch")


UNION_PRECEDENCE_SQL = f"""WITH {ENTITIES}, h AS (SELECT id, imo, lower(concat_ws(' ', flag, owner, array_to_string(former_flags, ' '))) AS hay FROM ents)
SELECT id, imo, {' OR '.join(f"contains(hay, '{w}')" for w in WATCH)} AS watch FROM h"""


def flag_routes(spark, sf):
    return rec.flag_routes(merged(spark, sf))


FLAG_ROUTES_SQL = f"WITH {ENTITIES} SELECT former_flags[1] AS from_flag, flag AS to_flag, count(*) AS n FROM ents WHERE len(former_flags) > 0 AND flag IS NOT NULL GROUP BY 1, 2"


def entity_order(spark, sf):
    return rec.entity_order(merged(spark, sf)).select("id", "ord")


ENTITY_ORDER_SQL = f"WITH {ENTITIES} SELECT id, row_number() OVER (ORDER BY len(former_flags) = 0, coalesce(flag, 'zz'), coalesce(name, ''), id) AS ord FROM ents"


def entity_counts(spark, sf):
    return rec.entity_counts(merged(spark, sf))


ENTITY_COUNTS_SQL = f"""WITH {ENTITIES}, h AS (SELECT *, lower(concat_ws(' ', flag, owner, array_to_string(former_flags, ' '))) AS hay FROM ents)
SELECT count(*) AS entities, count(imo) AS with_imo, count(*) FILTER (WHERE len(former_flags) > 0) AS with_former_flag, count(*) FILTER (WHERE {' OR '.join(f"contains(hay, '{w}')" for w in WATCH)}) AS watch FROM h"""


def _assembled(spark, sf):
    primary = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"), F.expr("concat('k', c_custkey % 90)").alias("key"))
    translated = read(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.expr("concat('Kunde ', c_custkey)").alias("name_local"))
    keys = read(spark, sf, "supplier").select(F.expr("concat('k', s_suppkey)").alias("key"), F.expr("concat('p', s_suppkey % 40)").alias("place"), F.expr("if(s_suppkey % 10 = 0, concat('City ', s_suppkey), null)").alias("city_override"))
    places = read(spark, sf, "nation").select(F.expr("concat('p', n_nationkey)").alias("place"), F.col("n_name").alias("city"), F.expr(_lon("n_nationkey")).alias("lon"), F.expr(_lat("n_nationkey")).alias("lat"))
    return rec.entity_assemble(primary, translated, keys, places)


def entity_assemble(spark, sf):
    done, missing = _assembled(spark, sf)
    return rec.union_sources(done.select("id", "name_local", "city", F.lit(None).cast("string").alias("missing")), missing)


ENTITY_ASSEMBLE_SQL = """WITH j AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN 'Kunde ' || c_custkey END AS name_local, s_suppkey, n_name, CASE WHEN s_suppkey % 10 = 0 THEN 'City ' || s_suppkey END AS o
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 90 LEFT JOIN nation ON n_nationkey = s_suppkey % 40)
SELECT id, CASE WHEN n_name IS NOT NULL THEN name_local END AS name_local, CASE WHEN n_name IS NOT NULL THEN coalesce(o, n_name) END AS city, CASE WHEN s_suppkey IS NULL THEN 'key' WHEN n_name IS NULL THEN 'place' END AS missing FROM j"""


# ---------------------------------------------------------------- places from part
def _places(spark, sf):
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("cast(p_partkey % 25 as int)").alias("country"), F.expr("cast(p_retailprice * 10 as bigint)").alias("population"),
        F.col("p_size").alias("rank"), F.expr("p_partkey % 211 = 0").alias("capital"), F.expr(_lon("p_partkey")).alias("lon"), F.expr(_lat("p_partkey")).alias("lat"),
    )


PLACES = f"places AS (SELECT p_partkey AS id, p_name AS name, CAST(p_partkey % 25 AS INTEGER) AS country, CAST(trunc(p_retailprice * 10) AS BIGINT) AS population, p_size AS rank, p_partkey % 211 = 0 AS capital, {_lon('p_partkey')} AS lon, {_lat('p_partkey')} AS lat FROM part)"
TIER_LIMITS = {"core": (9500, 10), "near": (10000, 4)}
FAR, FRAME = 10400, (20.0, 31.0, 40.0, 45.0)


def tiered_keep(spark, sf):
    tiers = dims.table(spark, dims.TIERS, "country int, tier string")
    return rec.tiered_keep(_places(spark, sf), tiers, TIER_LIMITS, FAR, dims.FORCED_NAMES, FRAME).select("id", "tier")


TIERED_KEEP_SQL = f"""WITH {PLACES}, {sql_rows('tiers', 'country, tier', dims.TIERS)} SELECT id, tier FROM places LEFT JOIN tiers USING (country)
WHERE lon BETWEEN 20 AND 40 AND lat BETWEEN 31 AND 45 AND (capital OR name IN ('small ring', 'red widget') OR CASE tier WHEN 'core' THEN population >= 9500 OR rank <= 10 WHEN 'near' THEN population >= 10000 OR rank <= 4 ELSE population >= {FAR} END)"""


def pinned_cap(spark, sf):
    return rec.pinned_cap(_places(spark, sf).withColumn("pinned", F.col("capital") | F.col("name").isin(*dims.FORCED_NAMES)), 300).select("id", "pinned")


PINNED_CAP_SQL = f"""WITH {PLACES}, p AS (SELECT *, capital OR name IN ('small ring', 'red widget') AS pinned FROM places)
SELECT id, pinned FROM p WHERE pinned UNION ALL SELECT id, pinned FROM (SELECT * FROM p WHERE NOT pinned ORDER BY population DESC, name, id LIMIT greatest(0, 300 - (SELECT count(*) FROM p WHERE pinned)))"""
NAMES = [("small ring", 3, "kleiner Ring drei"), ("small ring", None, "kleiner Ring"), ("red widget", None, "rotes Teil"), ("blue bolt", 4, "blauer Bolzen vier"), ("no such name", None, "nichts"), ("red widget", 99, "rotes Teil 99")]
NAME_SCHEMA = "name string, country int, local string"


def lookup_fallback(spark, sf):
    names = dims.table(spark, NAMES, NAME_SCHEMA)
    places = _places(spark, sf)
    found = rec.lookup_fallback(places, names).select("id", "local", F.lit("row").alias("part"))
    unused = rec.unused_names(places, names).select(F.lit(None).cast("bigint").alias("id"), "local", F.lit("unused").alias("part"))
    return found.unionByName(unused)


LOOKUP_FALLBACK_SQL = f"""WITH {PLACES}, {sql_rows('names', 'name, country, local', NAMES)},
j AS (SELECT id, name, country, (SELECT local FROM names n WHERE n.name = p.name AND n.country = p.country) AS x, (SELECT local FROM names n WHERE n.name = p.name AND n.country IS NULL) AS y FROM places p)
SELECT id, coalesce(x, y) AS local, 'row' AS part FROM j UNION ALL SELECT NULL, local, 'unused' FROM names WHERE local NOT IN (SELECT coalesce(x, y) FROM j WHERE coalesce(x, y) IS NOT NULL)"""


def kind_counts(spark, sf):
    kinds = dims.table(spark, [("STANDARD",), ("PROMO",), ("SMALL",)], "kind string")
    return rec.kind_counts(read(spark, sf, "part").select(F.col("p_type").alias("kind")), kinds)


KIND_COUNTS_SQL = "SELECT p_type AS kind, count(*) AS n, p_type NOT IN ('STANDARD', 'PROMO', 'SMALL') AS skipped FROM part GROUP BY 1"


def set_diff(spark, sf):
    known = dims.table(spark, [(n[0],) for n in NAMES], "name string")
    return rec.set_diff(read(spark, sf, "part").select(F.col("p_name").alias("name")), known, "name")


SET_DIFF_SQL = f"""WITH {sql_rows('known', 'name', sorted({(n[0],) for n in NAMES}))} SELECT DISTINCT p_name AS name, 'unknown' AS problem FROM part WHERE p_name NOT IN (SELECT name FROM known)
UNION ALL SELECT name, 'unused' FROM known WHERE name NOT IN (SELECT p_name FROM part)"""


def union_sources(spark, sf):
    both = rec.union_sources(read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), read(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    return both.groupBy("segment").agg(F.count("name").alias("n"), F.count("balance").alias("with_balance"))


UNION_SOURCES_SQL = "SELECT segment, count(name) AS n, count(balance) AS with_balance FROM (SELECT c_name AS name, c_mktsegment AS segment, NULL AS balance FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier) GROUP BY 1"


def to_features(spark, sf):
    places = _places(spark, sf).withColumn("country", F.when(F.col("country") > 3, F.col("country"))).withColumn("lon", F.round("lon")).withColumn("lat", F.round("lat"))
    return rec.to_features(places, ["name", "population", "country"])


TO_FEATURES_SQL = f"""WITH {PLACES} SELECT id, '{{"geometry":{{"coordinates":[' || round(lon) || ',' || round(lat) || '],"type":"Point"}},"properties":{{"name":"' || name || '","population":' || population || CASE WHEN country > 3 THEN ',"country":' || country ELSE '' END || '}},"type":"Feature"}}' AS feature FROM places"""


def prune_plan(spark, sf):
    files = read(spark, sf, "orders").select(F.expr("case when o_orderkey % 10 = 0 then 'latest.json' when o_orderkey % 10 = 1 then concat('2024-13-', o_orderkey) else concat(date_format(timestampadd(DAY, cast(o_orderkey % 30 as int), timestamp'2024-01-01'), 'yyyy-MM-dd'), '-r', o_orderkey % 7, '.json') end").alias("name"))
    return rec.prune_plan(files, "2024-01-30-r1.json", F.lit("2024-01-30").cast("date"), 14, 14)


PRUNE_PLAN_SQL = """WITH f AS (SELECT DISTINCT strftime(TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 30 AS INTEGER)), '%Y-%m-%d') || '-r' || (o_orderkey % 7) || '.json' AS name FROM orders WHERE o_orderkey % 10 > 1),
k AS (SELECT name, name[1:10] < '2024-01-16' AS old FROM f WHERE name <> '2024-01-30-r1.json')
SELECT name, 'age' AS why FROM k WHERE old UNION ALL SELECT name, 'count' FROM k WHERE NOT old QUALIFY row_number() OVER (ORDER BY name DESC) > 13"""


def key_audit(spark, sf):
    nested = "concat('{\"id\":', event_id, ',\"note\":{\"text\":\"a\",\"', if(event_id % 10 = 0, 'position', 'detail'), '\":1},\"sources\":[{\"url\":\"u\",\"', if(event_id % 25 = 0, 'troop_count', 'date'), '\":2}],\"', if(event_id % 50 = 0, 'extra', 'status'), '\":', props, ',\"deep\":{\"a\":[{\"b\":{\"c\":{\"d\":{\"position\":1}}}}]}}')"
    rows = read(spark, sf, "events").select("event_id", F.expr(nested).alias("properties"))
    return rec.key_audit(rows, "properties", ["id", "note", "sources", "status", "deep"], "(?i)troop|position|coord")


KEY_AUDIT_SQL = """WITH p AS (SELECT event_id, unnest([['id', 'ok'], ['note', 'ok'], ['note.text', 'ok'], CASE WHEN event_id % 10 = 0 THEN ['note.position', 'forbidden'] ELSE ['note.detail', 'ok'] END, ['sources', 'ok'], ['sources.url', 'ok'],
  CASE WHEN event_id % 25 = 0 THEN ['sources.troop_count', 'forbidden'] ELSE ['sources.date', 'ok'] END, CASE WHEN event_id % 50 = 0 THEN ['extra', 'not listed'] ELSE ['status', 'ok'] END, CASE WHEN event_id % 50 = 0 THEN ['extra.k', 'ok'] ELSE ['status.k', 'ok'] END, ['deep', 'ok'], ['deep.a', 'ok'], ['deep.a.b', 'ok'], ['deep.a.b.c', 'ok'], ['deep.a.b.c.d', 'ok'], ['deep.a.b.c.d.position', 'forbidden']]) AS x FROM events)
SELECT x[1] AS path, x[2] AS verdict, count(*) AS n FROM p GROUP BY 1, 2"""


# ---------------------------------------------------------------- F1, F12
def _positions(spark, sf):
    return read(spark, sf, "events").select(
        "event_id",
        F.expr("case event_type when 'click' then ' ADSB ' when 'view' then 'ais' when 'error' then 'adsb' when 'purchase' then 'AIS' else 'signal' end").alias("kind"),
        F.expr("case when event_id % 17 = 0 then '~abc123' when event_id % 19 = 0 then null else concat(if(event_id % 2 = 0, '0x', ''), lpad(hex(4849664 + event_id * 37 % 60000), 6, '0')) end").alias("hex_id"),
        F.expr("case when event_id % 23 = 0 then '97012345' else concat(element_at(array('', '0', '00', '111', '8', '98', '99', '970'), cast(event_id % 8 as int) + 1), lpad(cast(200 + event_id % 700 as string), 3, '0'), lpad('', 6 - length(element_at(array('', '0', '00', '111', '8', '98', '99', '970'), cast(event_id % 8 as int) + 1)), '7')) end").alias("station_id"),
        F.expr(f"case when event_id % 29 = 0 then null when event_id % 31 = 0 then 95D else {_lat('event_id')} end").alias("lat"),
        F.expr(f"case when event_id % 29 = 0 or event_id % 37 = 0 then null else {_lon('event_id')} end").alias("lon"),
    )


def _reasoned(spark, sf):
    blocks = dims.table(spark, dims.PROTECTED_BLOCKS, "first int, last int")
    return rules.safety_reasons(_positions(spark, sf), blocks, dims.PROTECTED_CODES, fence_edges(spark, sf), RADIUS, dims.KINDS_WITH_POSITION)


def safety_filter(spark, sf):
    """Reason counts together with the ids that stay; no dropped row is ever named."""
    reasoned = _reasoned(spark, sf)
    stay = rules.kept(reasoned).select(F.lit("kept row").alias("reason"), F.col("event_id").alias("n"))
    return rules.reason_counts(reasoned).unionByName(stay)


_BLOCKS = " OR ".join(f"address BETWEEN {a} AND {b}" for a, b in dims.PROTECTED_BLOCKS)
SAFETY_FILTER_SQL = f"""WITH {POINTS}, {EDGES}, {FENCE}, r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'adsb' WHEN 'view' THEN 'ais' WHEN 'error' THEN 'adsb' WHEN 'purchase' THEN 'ais' ELSE 'signal' END AS kind,
  CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 THEN 4849664 + event_id * 37 % 60000 END AS address,
  CASE WHEN event_id % 23 <> 0 AND event_id % 8 < 7 THEN CASE WHEN event_id % 8 = 0 AND (200 + event_id % 700) >= 800 THEN (200 + event_id % 700) % 100 * 10 + 7 ELSE 200 + event_id % 700 END END AS code,
  event_id % 29 = 0 AS absent, event_id % 31 = 0 OR event_id % 37 = 0 AS bad FROM points),
q AS (SELECT event_id, CASE WHEN kind = 'adsb' AND address IS NULL THEN 'invalid_address' WHEN kind = 'adsb' AND ({_BLOCKS}) THEN 'protected_block'
  WHEN kind = 'ais' AND (code IS NULL OR code NOT BETWEEN 201 AND 775) THEN 'invalid_station' WHEN kind = 'ais' AND code IN ({', '.join(map(str, dims.PROTECTED_CODES))}) THEN 'protected_code'
  WHEN absent AND kind <> 'signal' THEN 'missing_position' WHEN absent THEN NULL WHEN bad THEN 'invalid_position' WHEN event_id IN (SELECT event_id FROM fenced) THEN 'in_fence' END AS reason FROM r)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM q GROUP BY 1 UNION ALL SELECT 'kept row', event_id FROM q WHERE reason IS NULL"""
# The shape rules of the store.
STORE_RULES = {
    "url_shape": "url rlike '^https?://.'",
    "title_length": "length(title) <= 300",
    "status_enum": "status in ('pending', 'scored', 'duplicate', 'dropped', 'queued')",
    "score_range": "score between 0 and 1",
    "stamp_shape": r"fetched_at rlike '^[0-9]{4}-[01][0-9]-[0-3][0-9]T[0-2][0-9]:[0-5][0-9]:[0-6][0-9]Z$'",
    "json_valid": "labels is null or try_parse_json(labels) is not null",
    "decision_complete": "status = 'queued' or (decided_by is not null and decided_at is not null)",
    "collector_required": "collector is not null",
}


def validate_rows(spark, sf):
    rows = read(spark, sf, "documents").select(
        "doc_id",
        F.expr("if(doc_id % 19 = 0, 'ftp://x.example.org/', concat('https://x.example.org/', doc_id - if(doc_id % 10 = 9, 1, 0)))").alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.expr("element_at(array('pending', 'scored', 'queued', 'published'), cast(doc_id % 4 as int) + 1)").alias("status"),
        F.expr("cast(doc_id % 30 as double) / 25").alias("score"),
        F.expr("if(doc_id % 21 = 0, '2024-01-02 10:00:00', '2024-01-02T10:00:00Z')").alias("fetched_at"),
        F.expr("if(doc_id % 23 = 0, '[1,', '{\"a\":1}')").alias("labels"),
        F.expr("if(doc_id % 3 = 0, doc_id % 5, null)").alias("decided_by"),
        F.expr("if(doc_id % 2 = 0, '2024-01-02T11:00:00Z', null)").alias("decided_at"),
        F.expr("if(doc_id % 27 = 0, null, source)").alias("collector"),
    )
    reviewers = dims.table(spark, [(i,) for i in range(4)], "id bigint")
    return rules.validate(rows, "doc_id", STORE_RULES, [["url"]], [("decided_by", reviewers, "id")])


VALIDATE_ROWS_SQL = """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'ftp://x.example.org/' ELSE 'https://x.example.org/' || (doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END) END AS url, split_part(text, chr(10), 1) AS title, doc_id % 4 AS st, (doc_id % 30) / 25 AS score FROM documents)
SELECT doc_id, 'url_shape' AS rule FROM r WHERE doc_id % 19 = 0 UNION ALL SELECT doc_id, 'title_length' FROM r WHERE length(title) > 300 UNION ALL SELECT doc_id, 'status_enum' FROM r WHERE st = 3
UNION ALL SELECT doc_id, 'score_range' FROM r WHERE score > 1 UNION ALL SELECT doc_id, 'stamp_shape' FROM r WHERE doc_id % 21 = 0 UNION ALL SELECT doc_id, 'json_valid' FROM r WHERE doc_id % 23 = 0
UNION ALL SELECT doc_id, 'decision_complete' FROM r WHERE st <> 2 AND (doc_id % 3 <> 0 OR doc_id % 2 <> 0) UNION ALL SELECT doc_id, 'collector_required' FROM r WHERE doc_id % 27 = 0
UNION ALL (SELECT doc_id, 'unique_url' FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) > 1) UNION ALL SELECT doc_id, 'reference_decided_by' FROM r WHERE doc_id % 3 = 0 AND doc_id % 5 = 4"""

QUERIES = {
    "records_by_month": records_by_month, "facet_search": facet_search, "facet_counts": facet_counts, "facet_options": facet_options, "colocated": colocated,
    "unplaced": unplaced, "publishers": publishers, "region_of": region_of, "board_rank": board_rank, "topk": topk, "canonical_order": canonical_order,
    "union_precedence": union_precedence, "flag_routes": flag_routes, "entity_order": entity_order, "entity_counts": entity_counts, "entity_assemble": entity_assemble,
    "tiered_keep": tiered_keep, "pinned_cap": pinned_cap, "lookup_fallback": lookup_fallback, "kind_counts": kind_counts, "set_diff": set_diff,
    "union_sources": union_sources, "to_features": to_features, "prune_plan": prune_plan, "key_audit": key_audit, "safety_filter": safety_filter, "validate_rows": validate_rows,
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES}
