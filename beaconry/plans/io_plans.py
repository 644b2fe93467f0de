"""Source and sink queries: the sample tables are written in the source's own format, then read back."""

from __future__ import annotations


from pyspark.sql import functions as F

from beaconry.operators import review_queue as rq
from beaconry.plans.common import RUN_TS, SIGNALS, fold_sql, read, signals, squash_sql, stamp, stamp_sql
from beaconry.plans.queue_plans import IDS, SCORED, SELECTED, STORE, USAGE, _usage, candidates, stored_rows
from beaconry.plans.record_plans import RECORDS, records
from beaconry.plans.trade_plans import STATS, stats
from beaconry.plans.warning_plans import ARCHIVE, archive
from beaconry.session import scratch_path
from beaconry.sinks import tables
from beaconry.sources import feeds, files

CHUNK = 500


def _escape(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# ---------------------------------------------------------------- S1
def payloads(spark, sf):
    """Documents as feed payloads of a bounded chunk each: RSS 2.0, RSS 1.0 and Atom by source."""
    day = "date_format(timestampadd(DAY, cast(doc_id % 60 as int), timestamp'2024-01-01'), "
    title = _escape("regexp_replace(substring_index(text, '\\n', 1), '[<>&]', ' ')")
    docs = read(spark, sf, "documents").withColumn("form", F.expr("cast(substr(source, 4) as int) % 3")).withColumn("chunk", F.expr(f"doc_id div {CHUNK}"))
    item = f"""case form
        when 0 then concat('<item><title>', {title}, '</title><link>https://', source, '.example.org/d/', doc_id, '</link><description>n ', n_chars, ' &amp;lt;b&amp;gt; &nbsp;x</description><pubDate>', {day}"dd MMM yyyy HH:mm:ss"), ' +0000</pubDate></item>')
        when 1 then concat('<item><title>', {title}, '</title><guid isPermaLink="true">https://', source, '.example.org/d/', doc_id, '</guid><description>n ', n_chars, '</description><dc:date>', {day}"yyyy-MM-dd'T'HH:mm:ss"), 'Z</dc:date></item>')
        else concat('<entry><title type="text">', {title}, '</title><link rel="self" href="https://self.example.org/"/><link href="https://', source, '.example.org/d/', doc_id, '"/><updated>', {day}"yyyy-MM-dd'T'HH:mm:ss"), 'Z</updated><summary>n ', n_chars, '</summary></entry>') end"""
    parts = docs.groupBy("source", "form", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.expr(item).alias("x")))), lambda i: i["x"]), "").alias("items"))
    body = """case when source = 'src7' then concat('<!DOCTYPE x [<!ENTITY a "b">]><rss><channel>', items, '</channel></rss>')
        when source = 'src8' then '<html><body>no feed</body></html>'
        when source = 'src9' then concat('<rss version="2.0"><channel>', items, '</channel>')
        when form = 0 then concat('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>', items, '</channel></rss>')
        when form = 1 then concat('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns="http://purl.org/rss/1.0/"><channel><title>t</title></channel>', items, '</rdf:RDF>')
        else concat('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>', items, '</feed>') end"""
    return parts.select(F.col("source").alias("feed_id"), F.expr(body).alias("body"), F.lit("https://base.example.org/").alias("base_url"), F.expr(f"timestamp'{RUN_TS}'").alias("fetched_at"))


def feed_items(spark, sf):
    items, rejects = feeds.feed_items(payloads(spark, sf))
    good = items.select("feed_id", "link", "title", "summary", stamp("published").alias("published"), F.lit(None).cast("string").alias("reason"))
    bad = rejects.distinct().select("feed_id", *[F.lit(None).cast("string").alias(c) for c in ("link", "title", "summary", "published")], "reason")
    return good.unionByName(bad)


FEED_ITEMS_SQL = f"""WITH {SIGNALS}, n AS (SELECT s.*, n_chars, CAST(feed[4:] AS INTEGER) % 3 AS form FROM signals s JOIN documents USING (doc_id))
SELECT feed AS feed_id, url AS link, {squash_sql("regexp_replace(title, '[<>&]', ' ', 'g')")} AS title, 'n ' || n_chars || CASE WHEN form = 0 THEN ' <b> x' ELSE '' END AS summary, {stamp_sql('published')} AS published, NULL AS reason
FROM n WHERE feed NOT IN ('src7', 'src8', 'src9')
UNION ALL SELECT DISTINCT feed, NULL, NULL, NULL, NULL, CASE feed WHEN 'src7' THEN 'entities' WHEN 'src8' THEN 'not a feed' ELSE 'malformed' END FROM n WHERE feed IN ('src7', 'src8', 'src9')"""


# ---------------------------------------------------------------- S2, S3
def read_candidates(spark, sf):
    path = scratch_path(spark, "candidates")
    line = F.to_json(
        F.struct(F.col("feed"), F.expr("concat('q', doc_id)").alias("queue_id"), F.expr("element_at(array('queued', 'deferred', 'off-topic', 'published'), cast(doc_id % 4 as int) + 1)").alias("status"), F.struct("url", "title").alias("signal"))
    )
    signals(spark, sf).select(F.when(F.col("doc_id") % 50 == 7, F.expr("concat('{\"feed\": ', doc_id, ' \"oops')")).otherwise(line)).write.text(path)
    good, bad = files.read_candidates(spark, path)
    counts = good.groupBy(F.lit("ok").alias("outcome"), "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(bad.groupBy(F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("status")).agg(F.count(F.lit(1)).alias("n")))


READ_CANDIDATES_SQL = """WITH c AS (SELECT CASE WHEN doc_id % 50 = 7 THEN 'not json' WHEN doc_id % 4 = 3 THEN 'unknown status' ELSE 'ok' END AS outcome, ['queued', 'deferred', 'off-topic', NULL][doc_id % 4 + 1] AS st FROM documents)
SELECT outcome, CASE WHEN outcome = 'ok' THEN st END AS status, count(*) AS n FROM c GROUP BY 1, 2"""


def bundle_of(batch_id):
    """The folder a batch lies in: the batches of one chunk of documents go together, so files are as many as chunks."""
    return F.regexp_extract(batch_id, r"x(\d+)$", 1)


def published(spark, sf, path):
    """Store rows as batches of bounded size, bundled by chunk, with their pointers; every fifth digest is wrong."""
    rows = stored_rows(spark, sf).withColumn("simhash", F.lit(None).cast("string")).withColumn("_file", F.expr(f"concat('2024-01-31-r', conv(substr(content_hash, 8, 2), 16, 10), 'x', cast(regexp_extract(url, '/([0-9]+)$', 1) as bigint) div {CHUNK})"))
    fields = sorted(c for c in rows.columns if c != "_file")
    listed = rows.groupBy("_file").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    docs = listed.select("_file", F.to_json(F.struct(F.col("_file").alias("batch_id"), F.lit(RUN_TS).alias("created_at"), "rows", F.lit("batch/1").alias("schema")), {"ignoreNullFields": "false"}).alias("value"), F.size("rows").cast("bigint").alias("rows"))
    number = F.regexp_extract("_file", r"r(\d+)x", 1).cast("int")
    file = F.concat(F.col("value"), F.lit("\n"))
    pointers = docs.select(F.col("_file").alias("batch_id"), F.concat("_file", F.lit(".json")).alias("file"), F.when(number % 5 == 0, F.lit("0" * 64)).otherwise(F.sha2(file, 256)).alias("sha256"), (F.col("rows") + F.when(number % 7 == 0, 1).otherwise(0)).alias("rows"))
    lines = docs.where(number % 11 != 0).select(F.concat("_file", F.lit("\t"), "value").alias("value"), bundle_of(F.col("_file")).alias("bundle"))
    lines.repartition("bundle").write.partitionBy("bundle").text(f"{path}/files")
    pointers.write.json(f"{path}/pointers")
    return files.batch_files(spark, f"{path}/files"), spark.read.schema(files.POINTER).json(f"{path}/pointers")


def read_batch(spark, sf):
    rows, refused = files.read_batch(*published(spark, sf, scratch_path(spark, "batches")))
    good = rows.select("batch_id", "content_hash", "triage_status", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(refused.select("batch_id", *[F.lit(None).cast("string").alias(c) for c in ("content_hash", "triage_status")], "reason"))


READ_BATCH_SQL = f"""{STORE}, b AS (SELECT content_hash, triage_status, doc_id // {CHUNK} AS c, CAST('0x' || content_hash[8:9] AS INTEGER) AS k FROM stored),
r AS (SELECT '2024-01-31-r' || k || 'x' || c AS batch_id, content_hash, triage_status, CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 5 = 0 THEN 'digest' WHEN k % 7 = 0 THEN 'row-count' END AS reason FROM b)
SELECT batch_id, content_hash, triage_status, reason FROM r WHERE reason IS NULL UNION ALL SELECT DISTINCT batch_id, NULL, NULL, reason FROM r WHERE reason IS NOT NULL"""


# ---------------------------------------------------------------- S4, S5
def warnings_scan(spark, sf):
    path = scratch_path(spark, "archive")
    rows = archive(spark, sf).withColumn("status", F.expr("if(event_id % 4 = 0, 'active', 'cancelled')"))
    named = F.struct(F.col("year").alias("msgYear"), F.col("number").alias("msgNumber"), F.col("area").alias("navArea"), "authority", "text", F.col("event_id").alias("eventId"))
    docs = rows.groupBy("status", F.expr(f"event_id div {CHUNK}").alias("chunk")).agg(F.to_json(F.struct(F.collect_list(named).alias("broadcast-warn"))).alias("value"))
    docs.select("status", "chunk", "value").repartition("status", "chunk").write.partitionBy("status", "chunk").text(path)
    scanned = files.read_warnings(spark, {s: f"{path}/status={s}/*" for s in ("cancelled", "active")})
    return scanned.select("eventId", "msgYear", "msgNumber", "navArea", "authority", "status", F.md5("text").alias("text_md5"))


WARNINGS_SCAN_SQL = f"""WITH {ARCHIVE} SELECT event_id AS "eventId", year AS "msgYear", number AS "msgNumber", area AS "navArea", authority, CASE WHEN event_id % 4 = 0 THEN 'active' ELSE 'cancelled' END AS status, md5(text) AS text_md5 FROM archive"""


def trade_scan(spark, sf):
    path = scratch_path(spark, "trade")
    row = F.struct("period", F.col("chapter").alias("cmdCode"), F.col("customs").alias("customsCode"), F.col("partner2").alias("partner2Code"), F.col("mot").alias("motCode"), F.col("value").alias("primaryValue"))
    replies = stats(spark, sf).groupBy("reporter", "partner", "flow", "period", F.expr(f"l_orderkey div {100 * CHUNK}")).agg(F.collect_list(row).alias("data"))
    name = F.concat_ws("-", F.col("reporter").cast("string"), F.lit("all"), "flow", F.lit("all"), F.lit("AG2"))
    replies.select(name.alias("reply"), F.to_json(F.struct("data")).alias("value")).write.partitionBy("reply").text(path)
    scanned = files.read_trade(spark, path)
    return scanned.groupBy("reporter", "flow", "period").agg(F.count(F.lit(1)).alias("n"), F.count("primaryValue").alias("with_value"), F.round(F.sum("primaryValue"), 4).alias("value"))


TRADE_SCAN_SQL = f"WITH {STATS} SELECT CAST(reporter AS VARCHAR) AS reporter, flow, period, count(*) AS n, count(value) AS with_value, round(sum(value), 4) AS value FROM stats GROUP BY 1, 2, 3"


# ---------------------------------------------------------------- S6, S7
def vessels_scan(spark, sf):
    path = scratch_path(spark, "vessels")
    one = "concat('<id><uid>1</uid><idType>', {0}, '</idType><idNumber>', {1}, '</idNumber></id>')"
    ids = ", ".join([
        "if(c_custkey % 9 = 0, '', " + one.format("'Vessel Registration Identification'", "concat('IMO ', 1000000 + c_custkey)") + ")",
        one.format("'Vessel Registration Identification'", "'IMO 9999999'"),
        "if(c_custkey % 5 = 0, concat(" + one.format("'Other Vessel Flag'", "concat('O', c_nationkey)") + ", " + one.format("'Former Vessel Flag'", "concat('F', c_nationkey)") + "), '')",
        one.format("'MMSI'", "lpad(cast(c_custkey as string), 9, '2')"),
    ])
    vessel = "if(c_custkey % 3 = 0, '', concat('<vesselInfo><vesselType>', c_mktsegment, '</vesselType><vesselFlag>N', c_nationkey, '</vesselFlag></vesselInfo>'))"
    entry = f"concat('<sdnEntry><uid>', c_custkey, '</uid><lastName>', c_name, '</lastName><programList><program>P', c_custkey % 4, '</program><program>Q</program></programList><idList>', {ids}, '</idList>', {vessel}, '</sdnEntry>')"
    chunks = read(spark, sf, "customer").groupBy(F.expr(f"c_custkey div {CHUNK}").alias("chunk")).agg(F.array_join(F.collect_list(F.expr(entry)), "").alias("entries"))
    docs = chunks.select("chunk", F.concat(F.lit('<sdnList xmlns="urn:list">'), "entries", F.lit("</sdnList>")).alias("value"))
    docs.repartition("chunk").write.partitionBy("chunk").text(path)
    vessels = files.read_vessels(spark, f"{path}/*")
    return vessels.select("name", "imo", "mmsi", "type", "flag", F.array_join("former_flags", ",").alias("former_flags"), F.array_join("programmes", ",").alias("programmes"))


VESSELS_SCAN_SQL = """SELECT c_name AS name, CASE WHEN c_custkey % 9 = 0 THEN '9999999' ELSE CAST(1000000 + c_custkey AS VARCHAR) END AS imo, lpad(CAST(c_custkey AS VARCHAR), 9, '2') AS mmsi, c_mktsegment AS type, 'N' || c_nationkey AS flag,
  CASE WHEN c_custkey % 5 = 0 THEN 'F' || c_nationkey || ',O' || c_nationkey ELSE '' END AS former_flags, 'P' || (c_custkey % 4) || ',Q' AS programmes FROM customer WHERE c_custkey % 3 <> 0"""


def vessels_prose(spark, sf):
    prose = "concat('Listed ', s_suppkey, if(s_suppkey % 3 = 0, '', concat(', imo number: ', if(s_suppkey % 5 = 0, '12345', ''), ' IMO-', 8000000 + s_suppkey, '.')), ' and 7654321 too, ', case when s_suppkey % 3 = 0 then 'nothing' else 'more' end)"
    entries = read(spark, sf, "supplier").select(F.expr("if(s_suppkey % 4 = 0, null, 'Motor')").alias("first_name"), F.expr("if(s_suppkey % 4 = 0, null, s_name)").alias("second_name"), F.lit(None).cast("string").alias("third_name"), F.expr(prose).alias("text"), F.lit("list").alias("list_type"))
    return files.vessels_from_prose(entries)


VESSELS_PROSE_SQL = "SELECT CASE WHEN s_suppkey % 4 <> 0 THEN 'Motor ' || s_name END AS name, CAST(8000000 + s_suppkey AS VARCHAR) AS imo, 'list' AS list_type FROM supplier WHERE s_suppkey % 3 <> 0"


# ---------------------------------------------------------------- S10, S11, S12
def vertex_table(spark, sf):
    path = scratch_path(spark, "vertices")
    dms = "concat({d}, '-', lpad(cast(p_partkey % 60 as string), 2, '0'), '-', if(p_partkey % 97 = 5, 'xx', concat(lpad(cast(p_partkey * 7 % 60 as string), 2, '0'), '.5')))"
    line = f"concat('B', p_partkey div 20, ',', if(p_partkey % 20 = 19, 18, p_partkey % 20), ',', {dms.format(d='30 + p_partkey % 15')}, ',', {dms.format(d='20 + p_partkey % 20')})"
    lines = F.expr(f"if(p_partkey % 50 = 0, array('# a comment line', {line}), array({line}))")
    rows = read(spark, sf, "part").select(F.explode(lines).alias("value"))
    rows.write.text(path)
    vertices, findings = files.read_vertices(spark, path, ["block", "vertex"])
    bad = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    good = vertices.where("lat IS NOT NULL").select("block", F.col("vertex").cast("bigint").alias("n"), F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))
    return good.unionByName(bad.select(F.col("rule").alias("block"), "n", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")))


VERTEX_TABLE_SQL = """WITH v AS (SELECT 'B' || (p_partkey // 20) AS block, CASE WHEN p_partkey % 20 = 19 THEN 18 ELSE p_partkey % 20 END AS n, p_partkey % 97 = 5 AS bad,
  (p_partkey % 60)::DOUBLE / 60 + ((p_partkey * 7 % 60) + 0.5::DOUBLE) / 3600 AS frac, 30 + p_partkey % 15 AS la, 20 + p_partkey % 20 AS lo FROM part)
SELECT block, n, round(la + frac, 8) AS lat, round(lo + frac, 8) AS lon FROM v WHERE NOT bad
UNION ALL SELECT r, count(*), NULL, NULL FROM v, (SELECT unnest(['lat', 'lon']) AS r) WHERE bad GROUP BY 1
UNION ALL SELECT 'unique_block_vertex', sum(c - 1)::BIGINT, NULL, NULL FROM (SELECT count(*) AS c FROM v GROUP BY block, n)"""


def records_scan(spark, sf):
    path = scratch_path(spark, "records")
    kinds = F.create_map(*[F.lit(v) for pair in {"evt": "event", "act": "actor", "sit": "site", "src": "source", "eqp": "unlisted"}.items() for v in pair])
    exported = records(spark, sf).select(kinds[F.substring("id", 1, 3)].alias("kind"), "id", "title", "status", "regions", stamp("start").alias("start"))
    exported.write.partitionBy("kind").json(path)
    found = files.read_records(spark, path, ("event", "actor", "equipment"), {"event", "actor", "site", "source"})
    return found.select("kind", "id", "status", F.size("regions").alias("n_regions"), "start")


RECORDS_SCAN_SQL = f"""WITH {RECORDS} SELECT CASE kind WHEN 'evt' THEN 'event' ELSE 'actor' END AS kind, id, status, CAST(len(regions) AS INTEGER) AS n_regions, {stamp_sql('start')} AS start FROM recs WHERE kind IN ('evt', 'act')"""


def vocab_dims(spark, sf):
    """Terms of a vocabulary made of the common words of ``documents``, one region per language.

    Common are words in at least a twentieth of a language's texts, so their number follows from the length of a text.
    """
    from beaconry.functions.text import fold, squash, words

    path = scratch_path(spark, "vocabulary")
    common = signals(spark, sf).select("lang", F.explode(F.array_distinct(words(fold(squash(F.col("text")))))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    texts = signals(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("of"))
    top = common.join(texts, "lang").where("20 * n >= of")
    by_lang = top.groupBy("lang").agg(F.sort_array(F.collect_list("w")).alias("terms"))
    regions = by_lang.agg(F.map_from_entries(F.collect_list(F.struct("lang", "terms"))).alias("regions"))
    weights = F.create_map(*[F.lit(v) for k in ("region", "topic", "title", "text", "feed_region") for v in (k, 0.5)])
    doc = regions.select("regions", F.create_map(F.lit("any"), F.array(F.lit("the*"))).alias("topics"), F.array(F.lit("of the")).alias("exclude"), weights.alias("weights"), F.lit(0.5).alias("threshold"), F.lit(0.6).alias("margin"))
    doc.write.json(path)
    rows, findings = files.read_vocabulary(spark, path)
    return rows.unionByName(findings.select(F.lit("finding").alias("kind"), F.col("where").alias("code"), F.col("rule").alias("term"), F.lit(False).alias("is_prefix"), F.lit(0).alias("n_tokens")))


VOCAB_DIMS_SQL = f"""WITH {SIGNALS}, w AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all({fold_sql('text')}, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM signals),
c AS (SELECT lang, count(*) AS o FROM signals GROUP BY 1), t AS (SELECT lang, w FROM w JOIN c USING (lang) GROUP BY lang, w, o HAVING 20 * count(*) >= o)
SELECT 'region' AS kind, lang AS code, w AS term, FALSE AS is_prefix, 1 AS n_tokens FROM t UNION ALL SELECT 'topic', 'any', 'the', TRUE, 1 UNION ALL SELECT 'exclude', '', 'of the', FALSE, 2
UNION ALL SELECT 'finding', c, 'margin', FALSE, 0 FROM (SELECT DISTINCT 'region/' || lang AS c FROM t UNION ALL SELECT 'topic/any' UNION ALL SELECT 'exclude/')"""


# ---------------------------------------------------------------- K1, K2, K3, K4, K6, K8
def run_artifact(spark, sf):
    path = scratch_path(spark, "run")
    tables.write_run(candidates(spark, sf).select("doc_id", "queue_id", "status", F.lit("2024-01-31").alias("run_day")), path)
    return spark.read.parquet(path).select("doc_id", "queue_id", "status", F.col("run_day").cast("string").alias("run_day"))


RUN_ARTIFACT_SQL = f"WITH {SCORED}, {IDS}, {SELECTED} SELECT doc_id, queue_id, status, '2024-01-31' AS run_day FROM selected"


def insert_absent(spark, sf):
    """Two overlapping batches and a replay of the first into one table."""
    path = scratch_path(spark, "signals")
    rows = signals(spark, sf).select(F.md5("text").alias("content_hash"), "doc_id", "lang")
    first, second = rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 2 = 0 OR doc_id % 3 = 0")
    for batch in (first, second, first):
        tables.insert_absent(spark, path, batch, ["content_hash"], ["doc_id"])
    return spark.read.parquet(path)


INSERT_ABSENT_SQL = """WITH r AS (SELECT md5(text) AS content_hash, doc_id, lang, CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 2 END AS b FROM documents)
SELECT content_hash, doc_id, lang FROM r QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY b, doc_id) = 1"""


def usage_upsert(spark, sf):
    """A stored ledger, then an additive delta that touches some of its days."""
    path = scratch_path(spark, "usage")
    usage = _usage(spark, sf)
    early, late = usage.where("day <= '2024-01-20'"), usage.where("day >= '2024-01-15'")
    tables.overwrite_days(rq.usage_vs_limit(early).select("day", "service", "units", "daily_limit"), path)
    stored = spark.read.parquet(path).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    touched = late.select("day").distinct()
    tables.overwrite_days(tables.add_usage(stored.join(touched, "day", "left_semi"), late), path)
    return spark.read.parquet(path).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "service", "units", "daily_limit")


USAGE_UPSERT_SQL = f"""WITH {USAGE} SELECT day, service, CAST(sum(units * CASE WHEN day BETWEEN '2024-01-15' AND '2024-01-20' THEN 2 ELSE 1 END) AS BIGINT) AS units, CAST(max(daily_limit) AS BIGINT) AS daily_limit FROM u GROUP BY 1, 2"""


def state_upsert(spark, sf):
    """State of one job per user before the last day of runs, then the last run of that day."""
    runs = read(spark, sf, "events").select(F.expr("concat('job', user_id)").alias("job"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ran_at"), (F.col("value") <= 60).alias("ok"), F.expr("if(event_id % 3 = 0, null, concat('c', event_id))").alias("cursor"))
    old, new = runs.where("ran_at < timestamp'2024-01-29'"), runs.where("ran_at >= timestamp'2024-01-29'")
    last = F.struct("ran_at", "run_id")
    state = old.groupBy("job").agg(F.max("ran_at").alias("last_run_at"), F.max_by("cursor", last).alias("cursor"), F.count_if(~F.col("ok")).alias("failures"), F.lit("old error").alias("last_error"))
    results = new.groupBy("job").agg(F.max("ran_at").alias("ran_at"), F.max_by("ok", last).alias("ok"), F.max_by("cursor", last).alias("cursor")).withColumn("error", F.lit("new error"))
    return tables.upsert_state(state, results).withColumn("last_run_at", stamp("last_run_at"))


STATE_UPSERT_SQL = f"""WITH r AS (SELECT 'job' || user_id AS job, event_id, ts, value <= 60 AS ok, CASE WHEN event_id % 3 <> 0 THEN 'c' || event_id END AS cursor FROM events),
s AS (SELECT job, max(ts) AS at, count(*) FILTER (WHERE NOT ok) AS f FROM r WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1),
sl AS (SELECT job, cursor FROM r WHERE ts < TIMESTAMP '2024-01-29' QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT job, ts AS at, ok, cursor FROM r WHERE ts >= TIMESTAMP '2024-01-29' QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) = 1)
SELECT job, {stamp_sql('coalesce(n.at, s.at)')} AS last_run_at, CASE WHEN n.ok THEN coalesce(n.cursor, sl.cursor) ELSE sl.cursor END AS cursor,
  CASE WHEN n.ok IS NULL THEN s.f WHEN n.ok THEN 0 ELSE coalesce(s.f, 0) + 1 END AS failures, CASE WHEN n.ok IS NULL THEN 'old error' WHEN NOT n.ok THEN 'new error' END AS last_error
FROM s FULL JOIN n USING (job) LEFT JOIN sl USING (job)"""


def multi_grain(spark, sf):
    path = scratch_path(spark, "grains")
    tables.write_grains(read(spark, sf, "events").select("event_id", "event_type", "value"), path, "event_type")
    per = spark.read.parquet(f"{path}/by_event_type").select("event_type", "n")
    summary = spark.read.schema("rows bigint, groups bigint").json(f"{path}/summary")
    return per.unionByName(summary.select(F.concat(F.lit("groups "), F.col("groups").cast("string")).alias("event_type"), F.col("rows").alias("n")))


MULTI_GRAIN_SQL = "SELECT event_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'groups ' || count(DISTINCT event_type), count(*) FROM events"


def fanout(spark, sf):
    messages = read(spark, sf, "conversations").select(
        F.expr("concat('key-', conv_id, '-', turn div 2)").alias("idempotency_key"), F.md5("text").alias("text"), F.expr("conv_id * 1000 + turn").alias("message_id"),
        F.expr("if(turn % 3 = 0, array('wide', 'short'), array('wide'))").alias("channels"),
    )
    posted = messages.where("message_id % 7 = 0").select("idempotency_key", F.lit("wide").alias("channel"))
    return tables.fan_out(messages, posted)


FANOUT_SQL = """WITH m AS (SELECT 'key-' || conv_id || '-' || (turn // 2) AS idempotency_key, md5(text) AS text, conv_id * 1000 + turn AS message_id, unnest(CASE WHEN turn % 3 = 0 THEN ['wide', 'short'] ELSE ['wide'] END) AS channel FROM conversations)
SELECT idempotency_key, text, message_id, channel FROM m WHERE NOT (channel = 'wide' AND idempotency_key IN (SELECT idempotency_key FROM m WHERE message_id % 7 = 0))
QUALIFY row_number() OVER (PARTITION BY idempotency_key, channel ORDER BY message_id) = 1"""

QUERIES = {
    "feed_items": feed_items, "read_candidates": read_candidates, "read_batch": read_batch, "warnings_scan": warnings_scan, "trade_scan": trade_scan, "vessels_scan": vessels_scan,
    "vessels_prose": vessels_prose, "vertex_table": vertex_table, "records_scan": records_scan, "vocab_dims": vocab_dims, "run_artifact": run_artifact, "insert_absent": insert_absent,
    "usage_upsert": usage_upsert, "state_upsert": state_upsert, "multi_grain": multi_grain, "fanout": fanout,
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES}
