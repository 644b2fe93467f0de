"""Relevance, queue, counter and freshness queries over ``documents``, ``labels``, ``conversations`` and ``events``."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from beaconry import dims
from beaconry.functions import hashing
from beaconry.operators import dedup, relevance, scan, term_join, text
from beaconry.operators import review_queue as rq
from beaconry.plans.common import NOT_W_SQL, RUN_TS, SIGNALS, W_SQL, fold_sql, read, signals, sql_rows, squash_sql, stamp, stamp_sql
from beaconry.functions.text import squash
from beaconry.session import scratch_path, small_side
from beaconry.sources import files
from beaconry.plans.text_plans import EXCERPT_CHARS, NEAR_DEDUP_SQL, signed_docs

LIMIT = 40
NOW = f"TIMESTAMP '{RUN_TS}'"
VOCABULARY = relevance.Vocabulary.from_rows(dims.VOCABULARY, dims.WEIGHTS, dims.EXCLUDE)
VOCABULARY_B = relevance.Vocabulary.from_rows(dims.VOCABULARY, dims.WEIGHTS_B, dims.EXCLUDE)


def feeds(spark):
    return dims.table(spark, dims.FEEDS, dims.FEED_SCHEMA)


FEEDS = sql_rows("feeds", "feed, enabled, queue, grade, region, cadence_minutes", dims.FEEDS)


def with_prior(spark, items):
    prior = feeds(spark).select("feed", F.col("region").alias("feed_region"))
    return items.join(small_side(prior), "feed", "left")


# ---------------------------------------------------------------- J5, A21, F4, A22 in SQL
def _found_sql(column: str, term: str) -> str:
    """List of distinct matches of one term in a folded column."""
    if term.endswith("*"):
        return f"list_distinct(regexp_extract_all({column}, '(?:^|{NOT_W_SQL})({term[:-1]}{W_SQL}*)', 1))"
    return f"CASE WHEN regexp_matches({column}, '(^|{NOT_W_SQL}){term}($|{NOT_W_SQL})') THEN ['{term}'] ELSE [] END"


def _code_sql(column: str, terms: list[str]) -> str:
    return "list_distinct(" + " || ".join(_found_sql(column, t) for t in terms) + ")"


_BLANK = "|".join(dims.EXCLUDE)
_CODES = [("region", c, i, t) for i, (c, t) in enumerate(VOCABULARY.regions.items())] + [("topic", c, i, t) for i, (c, t) in enumerate(VOCABULARY.topics.items())]
_HIT_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, '{c}' AS code, {i} AS ord, {_code_sql('rt' if k == 'region' else 't', terms)} AS in_title, {_code_sql('rx' if k == 'region' else 'x', terms)} AS in_text FROM blanked"
    for k, c, i, terms in _CODES
)
HITS = rf"""folded AS (SELECT doc_id, {fold_sql('title')} AS t, {fold_sql('text')} AS x FROM signals),
blanked AS (SELECT doc_id, t, x, regexp_replace(t, '(^|{NOT_W_SQL})(?:{_BLANK})($|{NOT_W_SQL})', '\1 \2', 'g') AS rt, regexp_replace(x, '(^|{NOT_W_SQL})(?:{_BLANK})($|{NOT_W_SQL})', '\1 \2', 'g') AS rx FROM folded),
codes AS (SELECT *, list_distinct(in_title || in_text) AS found FROM ({_HIT_ROWS})),
hits AS (SELECT doc_id, kind, code, unnest(found) AS term, in_title FROM codes)"""


def _score_ctes(name: str, w: dict) -> str:
    d = lambda v: f"{v!r}::DOUBLE"
    return f"""{name}_r AS (SELECT doc_id, code, ord, least(1, len(in_title) * {d(w['title'])} + (len(found) - len(in_title)) * {d(w['text'])}) AS s, found FROM codes WHERE kind = 'region' AND len(found) > 0),
{name}_best AS (SELECT * FROM {name}_r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ord) = 1),
{name}_t AS (SELECT doc_id, least(1, sum(CASE WHEN len(in_title) > 0 THEN {d(w['title'])} ELSE {d(w['text'])} END)) AS s, string_agg(code, '|' ORDER BY ord) AS topics FROM codes WHERE kind = 'topic' AND len(found) > 0 GROUP BY 1),
{name}_j AS (SELECT s.doc_id, coalesce(b.code, f.region) AS region, array_to_string(list_sort(coalesce(b.found, [])), '|') AS terms, coalesce(t.topics, '') AS topics,
  CASE WHEN coalesce(b.code, f.region) = f.region THEN greatest(coalesce(b.s, 0), {d(w['feed_region'])}) ELSE coalesce(b.s, 0) END AS rs, coalesce(t.s, 0) AS ts
  FROM signals s LEFT JOIN feeds f ON f.feed = s.feed LEFT JOIN {name}_best b ON b.doc_id = s.doc_id LEFT JOIN {name}_t t ON t.doc_id = s.doc_id),
{name} AS (SELECT doc_id, region, terms, topics, round(rs, 3) AS region_score, round(ts, 3) AS topic_score,
  CASE WHEN rs > 0 AND ts > 0 THEN round({d(w['region'])} * rs + {d(w['topic'])} * ts, 3) ELSE 0.0::DOUBLE END AS score FROM {name}_j)"""


def _outcome_sql(w: dict) -> tuple[str, str]:
    relevant = f"score + 1e-9 >= {w['threshold'] - w['margin']!r}"
    return relevant, f"({relevant} AND score + 1e-9 < {w['threshold']!r})"


SCORED = f"{SIGNALS}, {FEEDS}, {HITS}, {_score_ctes('scored', dims.WEIGHTS)}"
_REL, _BORDER = _outcome_sql(dims.WEIGHTS)
_REL_B, _BORDER_B = _outcome_sql(dims.WEIGHTS_B)


def term_hits(spark, sf):
    return relevance.term_hits(signals(spark, sf), "doc_id", VOCABULARY)


TERM_HITS_SQL = f"WITH {SIGNALS}, {HITS} SELECT doc_id, kind, code, term, list_contains(in_title, term) AS in_title FROM hits"
TERM_HITS_TABLE_SQL = TERM_HITS_SQL


def vocabulary_rows(spark):
    """The vocabulary as a table, read from its document."""
    path, groups = scratch_path(spark, "vocabulary"), {"region": {}, "topic": {}}
    for kind, code, _, term in dims.VOCABULARY:
        groups[kind].setdefault(code, []).append(term)
    weights = {k: v for k, v in dims.WEIGHTS.items() if k in relevance.WEIGHT_NAMES}
    document = {"regions": groups["region"], "topics": groups["topic"], "exclude": dims.EXCLUDE, "weights": weights, "threshold": dims.WEIGHTS["threshold"], "margin": dims.WEIGHTS["margin"]}
    spark.createDataFrame([(json.dumps(document),)], "value string").write.text(path)
    return files.read_vocabulary(spark, path)[0]


def term_hits_table(spark, sf):
    """The hits of the vocabulary as a table of terms: n-grams of words joined with it, the longest term first."""
    return term_join.term_hits(signals(spark, sf), "doc_id", vocabulary_rows(spark))


def scored(spark, sf):
    return relevance.score(with_prior(spark, signals(spark, sf)), VOCABULARY)


def relevance_score(spark, sf):
    joined = [F.array_join(c, "|").alias(c) for c in ("terms", "topics")]
    return scored(spark, sf).select("doc_id", "region", *joined, "region_score", "topic_score", "score")


RELEVANCE_SCORE_SQL = f"WITH {SCORED} SELECT * FROM scored"


def relevance_outcome(spark, sf):
    judged = relevance.outcome(scored(spark, sf), VOCABULARY.threshold, VOCABULARY.margin)
    return judged.select("doc_id", "score", "relevant", "borderline")


RELEVANCE_OUTCOME_SQL = f"WITH {SCORED} SELECT doc_id, score, {_REL} AS relevant, {_BORDER} AS borderline FROM scored"


def replay_diff(spark, sf):
    return relevance.replay_diff(with_prior(spark, signals(spark, sf)), "doc_id", VOCABULARY, VOCABULARY_B)


REPLAY_DIFF_SQL = f"""WITH {SCORED}, {_score_ctes('scored_b', dims.WEIGHTS_B)},
a AS (SELECT doc_id, score, {_REL} AS r, {_BORDER} AS b FROM scored), c AS (SELECT doc_id, score, {_REL_B} AS r, {_BORDER_B} AS b FROM scored_b)
SELECT doc_id, a.score AS score_before, c.score AS score_after, a.r AS relevant_before, c.r AS relevant_after, a.b AS borderline_before, c.b AS borderline_after
FROM a JOIN c USING (doc_id) WHERE a.r <> c.r OR a.b <> c.b"""


# ---------------------------------------------------------------- F3, F5, F6
def age_window(spark, sf):
    docs = signals(spark, sf).withColumn("published", F.when(F.col("doc_id") % 13 != 0, F.col("published")))
    return rq.age_window(docs, F.lit("2024-02-20 00:00:00").cast("timestamp"), 30).select("doc_id", stamp("published").alias("published"))


AGE_WINDOW_SQL = f"""WITH {SIGNALS}, s AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN published END AS published FROM signals)
SELECT doc_id, {stamp_sql('published')} AS published FROM s WHERE published IS NULL OR published >= TIMESTAMP '2024-01-21 00:00:00'"""


def grade_gate(spark, sf):
    return rq.grade_gate(signals(spark, sf), feeds(spark), dims.GRADE_FLOOR).select("doc_id", "grade", "low_grade")


GRADE_GATE_SQL = f"""WITH {SIGNALS}, {FEEDS} SELECT doc_id, grade, coalesce(grade = 'D', FALSE) AS low_grade FROM signals LEFT JOIN feeds USING (feed) WHERE grade IS NULL OR grade <= 'D'"""


def feed_gate(spark, sf):
    docs = signals(spark, sf).select("doc_id", "feed")
    runs = [("queue", None), ("ingest", None), ("queue", ["src2", "src4"]), ("ingest", ["src3", "src4"])]
    parts = [rq.feed_gate(docs, feeds(spark), m, s).select("doc_id", F.lit(i).alias("run")) for i, (m, s) in enumerate(runs)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


FEED_GATE_SQL = f"""WITH {SIGNALS}, {FEEDS}, j AS (SELECT * FROM signals JOIN feeds USING (feed))
SELECT doc_id, 0 AS run FROM j WHERE queue UNION ALL SELECT doc_id, 1 FROM j WHERE enabled
UNION ALL SELECT doc_id, 2 FROM j WHERE feed IN ('src2', 'src4') UNION ALL SELECT doc_id, 3 FROM j WHERE enabled AND feed IN ('src3', 'src4')"""


# ---------------------------------------------------------------- W1 and the flagship
def _judged(spark, items):
    judged = relevance.outcome(relevance.score(with_prior(spark, items), VOCABULARY), VOCABULARY.threshold, VOCABULARY.margin)
    return judged.withColumn("fetched_at", F.expr(NOW))


def select_newest(spark, sf):
    """Newest relevant documents are queued, the rest of the relevant ones deferred."""
    items = _judged(spark, text.content_keys(signals(spark, sf), "url", "text")).drop("title", "text")
    return rq.select_newest(items, LIMIT, "doc_id").select("doc_id", "queue_id", "score", "status")


IDS = f"ids AS (SELECT doc_id, feed, published, substr(sha256(url || chr(10) || {squash_sql('text')}), 1, 12) AS queue_id FROM signals)"
SELECTED = f"""judged AS (SELECT doc_id, score, {_REL} AS relevant, {_BORDER} AS borderline, region, topics FROM scored),
selected AS (SELECT doc_id, queue_id, score, region, topics, relevant, borderline, CASE WHEN NOT relevant THEN 'off-topic'
  WHEN row_number() OVER (PARTITION BY relevant ORDER BY published DESC, feed DESC, queue_id DESC) <= {LIMIT} THEN 'queued' ELSE 'deferred' END AS status FROM judged JOIN ids USING (doc_id))"""
SELECT_NEWEST_SQL = f"WITH {SCORED}, {IDS}, {SELECTED} SELECT doc_id, queue_id, score, status FROM selected"


def review_queue(spark, sf):
    """Keys, first occurrence, signature, near-duplicates, relevance, newest first: the whole run."""
    signed = signed_docs(spark, sf).select(F.col("doc_id").alias("ord"), "queue_id", "simhash")
    kept = dedup.near_dedup(signed).select(F.col("ord").alias("doc_id"), "queue_id")
    items = _judged(spark, signals(spark, sf).join(kept, "doc_id")).drop("title", "text")
    return rq.select_newest(items, LIMIT, "doc_id").select("doc_id", "queue_id", "region", "score", "borderline", "status")


_NEAR = NEAR_DEDUP_SQL.replace(f"WITH RECURSIVE {SIGNALS},", "", 1).rsplit("SELECT unnest(kept)", 1)[0].rstrip()
REVIEW_QUEUE_SQL = f"""WITH RECURSIVE {SCORED}, {IDS}, {_NEAR},
left_over AS (SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)),
pool AS (SELECT doc_id, score, {_REL} AS relevant, {_BORDER} AS borderline, region FROM scored WHERE doc_id IN (SELECT doc_id FROM left_over))
SELECT doc_id, queue_id, region, score, borderline, CASE WHEN NOT relevant THEN 'off-topic'
  WHEN row_number() OVER (PARTITION BY relevant ORDER BY published DESC, feed DESC, queue_id DESC) <= {LIMIT} THEN 'queued' ELSE 'deferred' END AS status FROM pool JOIN ids USING (doc_id)"""


# ---------------------------------------------------------------- A1
def run_stats(spark, sf):
    docs = text.content_keys(signals(spark, sf).withColumn("url", F.lit("https://one.example.org/")), "url", "text")
    first = scan.first_by(docs, ["feed", "content_key"], ["doc_id"])
    judged = relevance.outcome(relevance.score(with_prior(spark, first), VOCABULARY), VOCABULARY.threshold, VOCABULARY.margin)
    ledger = docs.where("doc_id % 5 = 0").select("queue_id").distinct().withColumn("known", F.lit(True))
    marked = judged.join(ledger, "queue_id", "left").withColumn("_stale", F.col("published") < F.lit("2024-01-06").cast("timestamp"))
    stage = F.when(F.col("_stale"), "stale").when(F.col("known"), "known").when(F.col("relevant"), "queued").otherwise("off-topic")
    return rq.run_stats(marked.withColumn("stage", stage), "feed")


RUN_STATS_SQL = f"""WITH {SCORED}, k AS (SELECT doc_id, feed, published, substr(sha256('https://one.example.org/' || chr(10) || {squash_sql('text')}), 1, 12) AS queue_id FROM signals),
l AS (SELECT DISTINCT queue_id FROM k WHERE doc_id % 5 = 0),
f AS (SELECT feed, queue_id, min(doc_id) AS doc_id, arg_min(published, doc_id) AS published, count(*) AS copies FROM k GROUP BY 1, 2),
s AS (SELECT feed, copies, CASE WHEN published < TIMESTAMP '2024-01-06' THEN 'stale' WHEN queue_id IN (SELECT queue_id FROM l) THEN 'known' WHEN {_REL} THEN 'queued' ELSE 'off-topic' END AS stage FROM f JOIN scored USING (doc_id))
SELECT feed, CAST(sum(copies) AS BIGINT) AS items, CAST(sum(copies - 1) AS BIGINT) AS duplicates, 0::BIGINT AS invalid, 0::BIGINT AS dropped, count(*) FILTER (WHERE stage = 'stale') AS stale,
  count(*) FILTER (WHERE stage = 'known') AS known, count(*) FILTER (WHERE stage = 'off-topic') AS off_topic, count(*) FILTER (WHERE stage = 'queued') AS queued, 0::BIGINT AS deferred FROM s GROUP BY 1"""


# ---------------------------------------------------------------- P21, J17, K5, A19
def candidates(spark, sf):
    """Selected candidates with everything a store row needs; every seventh carries a place."""
    items = text.content_keys(signals(spark, sf), "url", "text")
    flagged = text.policy_flag(_judged(spark, items), F.concat_ws(" ", "title", "text"), dims.PROTECTED_TERMS)
    placed = F.col("doc_id") % 7 == 0
    slim = flagged.select(
        *[c for c in flagged.columns if c not in ("title", "text")],
        text.excerpt(F.col("title"), 300).alias("title"),
        text.excerpt(squash(F.col("text")), EXCERPT_CHARS).alias("text"),
        F.when(placed, F.concat(F.lit("Place "), F.col("doc_id").cast("string"))).alias("place"),
        F.when(placed, F.col("doc_id") % 90 + 0.5).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        F.lit("region").alias("precision"),
        F.lit(VOCABULARY.threshold).alias("threshold"),
        F.concat(F.lit(hashing.KEY_PREFIX), F.sha2("text", 256)).alias("raw_hash"),
        F.lit(None).cast("string").alias("source_id"),
        F.lit(None).cast("bigint").alias("simhash"),
        F.col("published").alias("published_at"),
    )
    return rq.select_newest(slim, LIMIT, "doc_id")


def stored_rows(spark, sf):
    return rq.signal_rows(candidates(spark, sf))


def signal_rows(spark, sf):
    return stored_rows(spark, sf).drop("simhash", "source_id").withColumn("text", F.md5("text")).withColumn("title", F.md5("title"))


def _cut_sql(column: str, limit: int) -> str:
    cut = f"substr({column}, 1, {limit - 1})"
    sp = f"(CASE WHEN contains({cut}, ' ') THEN length({cut}) - strpos(reverse({cut}), ' ') ELSE -1 END)"
    return f"CASE WHEN length({column}) <= {limit} THEN {column} ELSE rtrim(CASE WHEN {sp} > {limit * 0.6} THEN substr({cut}, 1, {sp}) ELSE {cut} END, ' ') || '…' END"


_FLAG = " OR ".join(
    f"regexp_matches(f, '(^|{NOT_W_SQL}){t}" + ("" if " " in t else f"($|{NOT_W_SQL})") + "')" for t in dims.PROTECTED_TERMS
)
STORED = f"""full_key AS (SELECT doc_id, url, feed, lang, title, {squash_sql('text')} AS sq, text, published, {fold_sql("title || ' ' || text")} AS f FROM signals),
stored AS (SELECT doc_id, 'sha256:' || sha256(url || chr(10) || sq) AS content_hash, 'sha256:' || sha256(text) AS raw_hash, feed AS collector_id, url, lang,
  md5({_cut_sql('title', 300)}) AS title, md5({_cut_sql('sq', EXCERPT_CHARS)}) AS text, region,
  CASE WHEN doc_id % 7 = 0 THEN '{{"lat":' || (doc_id % 90) || '.5,"lon":null,"place":"Place ' || doc_id || '","precision":"region","region":' || coalesce('"' || region || '"', 'null') || '}}' END AS geo_json,
  strftime(published, '%Y-%m-%dT%H:%M:%SZ') AS published_at, '2024-01-31T00:00:00Z' AS fetched_at,
  CASE status WHEN 'queued' THEN 'queued' WHEN 'deferred' THEN 'pending' ELSE 'scored' END AS triage_status, score AS triage_score,
  '{{"borderline":' || borderline || ',"collector_status":"' || status || '","feed":"' || feed || '","queue_id":"' || queue_id || '","redline_check":' || ({_FLAG}) || ',"threshold":0.5,"topics":[' ||
   CASE WHEN topics = '' THEN '' ELSE '"' || replace(topics, '|', '","') || '"' END || ']}}' AS triage_labels FROM selected JOIN full_key USING (doc_id))"""
STORE = f"WITH {SCORED}, {IDS}, {SELECTED}, {STORED}"
SIGNAL_ROWS_SQL = f"{STORE} SELECT * EXCLUDE (doc_id) FROM stored"


def promote(spark, sf):
    return rq.promote(stored_rows(spark, sf))


PROMOTE_SQL = f"{STORE} SELECT content_hash FROM stored WHERE triage_status = 'queued'"
CAP = 60
BATCH_ID, CREATED_AT = "2024-01-31-000000", "2024-01-31T00:00:00Z"


def publish_batch(spark, sf):
    return rq.publish_batch(stored_rows(spark, sf), "content_hash", CAP, BATCH_ID, CREATED_AT)


_TITLE, _TEXT = _cut_sql("title", 300), _cut_sql("sq", EXCERPT_CHARS)
_SENT = ", ".join(f"'{c}', {'NULL' if c in ('simhash', 'source_id') else c}" for c in rq.STORE_COLUMNS)
PUBLISH_BATCH_SQL = f"""{STORE.replace(f"md5({_TITLE}) AS title, md5({_TEXT}) AS text", f"nullif({_TITLE}, '') AS title, nullif({_TEXT}, '') AS text")},
placed AS (SELECT *, row_number() OVER (ORDER BY CASE triage_status WHEN 'queued' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, content_hash) AS n FROM stored),
batch AS (SELECT * FROM placed WHERE n <= {CAP}),
per AS (SELECT coalesce(string_agg('"' || triage_status || '":' || c, ',' ORDER BY triage_status), '') AS by_status FROM (SELECT triage_status, count(*) AS c FROM batch GROUP BY 1)),
counts AS (SELECT count(*) AS rows, count(*) FILTER (WHERE triage_status = 'queued') AS reviews, (SELECT count(*) FROM stored) - count(*) AS truncated,
  coalesce(string_agg(CAST(json_object({_SENT}) AS VARCHAR), ',' ORDER BY n), '') AS lines FROM batch),
written AS (SELECT rows, reviews, truncated, '{{"batch_id":"{BATCH_ID}","counts":{{"by_triage_status":{{' || by_status || '}},"reviews":' || reviews || ',"rows":' || rows || ',"truncated":' || truncated ||
  '}},"created_at":"{CREATED_AT}","rows":[' || lines || '],"run_url":null,"schema":"batch/1"}}' || chr(10) AS body FROM counts, per)
SELECT '{BATCH_ID}' AS batch_id, '{BATCH_ID}.json' AS file, sha256(body) AS sha256, rows, reviews, truncated, body,
  '{{"batch_id":"{BATCH_ID}","created_at":"{CREATED_AT}","file":"{BATCH_ID}.json","rows":' || rows || ',"schema":"batch-pointer/1","sha256":"' || sha256(body) || '"}}' || chr(10) AS pointer FROM written"""


def batch_counts(spark, sf):
    return rq.batch_counts(stored_rows(spark, sf).select("triage_status"), CAP)


BATCH_COUNTS_SQL = f"""{STORE}, n AS (SELECT count(*) FILTER (WHERE triage_status = 'queued') AS q, count(*) FILTER (WHERE triage_status = 'pending') AS p, count(*) AS total FROM stored),
m AS (SELECT *, least(total, {CAP}) AS rows, least(q, {CAP}) AS queued FROM n)
SELECT rows, total - rows AS truncated, queued, least(p, {CAP} - queued) AS pending, rows - queued - least(p, {CAP} - queued) AS scored, queued AS reviews, (rows + queued) * 3 AS estimated_writes FROM m"""


# ---------------------------------------------------------------- reviews from labels, actions from conversations
def reviews(spark, sf):
    keyed = text.content_keys(signals(spark, sf), "url", "text").select("doc_id", F.col("content_key").alias("content_hash"))
    labels = read(spark, sf, "labels")
    return labels.join(keyed, "doc_id").select(
        F.col("doc_id").alias("id"), "content_hash",
        F.expr("case when quality = 1 and toxic = 0 then 'queued' when toxic = 1 then 'redline' when doc_id % 2 = 0 then 'dismissed' else 'drafted' end").alias("status"),
        F.expr("timestampadd(HOUR, cast(doc_id * 7 % 50 as int), timestamp'2024-01-10 00:00:00')").alias("created_at"),
    )


REVIEWS = f"""keyed AS (SELECT doc_id, url, title, 'sha256:' || sha256(url || chr(10) || {squash_sql('text')}) AS content_hash FROM signals),
reviews AS (SELECT doc_id AS id, content_hash, CASE WHEN quality = 1 AND toxic = 0 THEN 'queued' WHEN toxic = 1 THEN 'redline' WHEN doc_id % 2 = 0 THEN 'dismissed' ELSE 'drafted' END AS status,
  TIMESTAMP '2024-01-10 00:00:00' + to_hours(CAST(doc_id * 7 % 50 AS INTEGER)) AS created_at FROM labels JOIN keyed USING (doc_id))"""


def queue_join(spark, sf):
    known = text.content_keys(signals(spark, sf).where("doc_id % 3 <> 0"), "url", "text").select(F.col("content_key").alias("content_hash"), "url")
    return rq.queue_join(reviews(spark, sf).select("id", "content_hash"), known)


QUEUE_JOIN_SQL = f"""WITH {SIGNALS}, {REVIEWS} SELECT id, reviews.content_hash, url FROM reviews LEFT JOIN (SELECT content_hash, url FROM keyed WHERE doc_id % 3 <> 0) k USING (content_hash)"""


def queue_counts(spark, sf):
    return rq.queue_counts(reviews(spark, sf))


QUEUE_COUNTS_SQL = f"WITH {SIGNALS}, {REVIEWS} SELECT status, count(*) AS n, status = 'queued' AS waiting FROM reviews GROUP BY 1"


def queue_page(spark, sf):
    page = rq.queue_page(reviews(spark, sf), ("2024-01-10 20:00:00", 100), 25)
    return page.select("id", "content_hash", stamp("created_at").alias("created_at"))


QUEUE_PAGE_SQL = f"""WITH {SIGNALS}, {REVIEWS} SELECT id, content_hash, {stamp_sql('created_at')} AS created_at FROM reviews
WHERE status = 'queued' AND (created_at, id) > (TIMESTAMP '2024-01-10 20:00:00', 100) ORDER BY created_at, id LIMIT 25"""


def batch_no(spark, sf):
    rows = signals(spark, sf).select("doc_id", "feed", "lang")
    return rq.batch_no(rows, "lang", ["feed", "doc_id"], 25).select("doc_id", "lang", "batch")


BATCH_NO_SQL = "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) - 1) // 25 AS batch FROM documents"


def decisions(spark, sf):
    talk = read(spark, sf, "conversations")
    actions = talk.select(
        F.col("conv_id").alias("review_id"),
        F.expr("case when turn % 3 = 1 and role = 'user' then 'drafted' when turn % 3 = 2 and role = 'assistant' then 'dismissed' else 'skip' end").alias("action"),
        F.expr("timestampadd(MINUTE, cast(turn as int), timestamp'2024-01-12 00:00:00')").alias("ts"),
        (F.col("turn") % 4).alias("reviewer"),
        F.when(F.col("turn") % 5 == 1, F.concat(F.lit("note "), F.col("turn").cast("string"))).alias("note"),
    )
    final = rq.decisions(talk.select(F.col("conv_id").alias("review_id")).distinct(), actions)
    return final.withColumn("decided_at", stamp("decided_at"))


DECISIONS_SQL = f"""WITH a AS (SELECT conv_id AS review_id, CASE WHEN turn % 3 = 1 AND role = 'user' THEN 'drafted' WHEN turn % 3 = 2 AND role = 'assistant' THEN 'dismissed' ELSE 'skip' END AS action,
  TIMESTAMP '2024-01-12 00:00:00' + to_minutes(CAST(turn AS INTEGER)) AS ts, turn % 4 AS reviewer, CASE WHEN turn % 5 = 1 THEN 'note ' || turn END AS note FROM conversations),
d AS (SELECT * FROM a WHERE action <> 'skip' QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY ts) = 1),
s AS (SELECT review_id, arg_max('skipped by reviewer ' || reviewer, a.ts) AS skip_note FROM a LEFT JOIN (SELECT review_id, ts AS until FROM d) USING (review_id) WHERE action = 'skip' AND (until IS NULL OR ts < until) GROUP BY 1)
SELECT review_id, coalesce(d.action, 'queued') AS status, d.reviewer AS decided_by, {stamp_sql('d.ts')} AS decided_at, coalesce(d.note, s.skip_note) AS note
FROM (SELECT DISTINCT conv_id AS review_id FROM conversations) r LEFT JOIN d USING (review_id) LEFT JOIN s USING (review_id)"""


# ---------------------------------------------------------------- W5, W10, A23, A20
def rate_limit(spark, sf):
    posts = read(spark, sf, "events").select("event_id", F.concat(F.lit("ch"), (F.col("user_id") % 30).cast("string")).alias("channel"), F.col("ts").cast("timestamp").alias("ts"))
    return rq.rate_limit(posts, *dims.CHANNEL_LIMITS).drop("ts")


RATE_LIMIT_SQL = f"""WITH p AS (SELECT event_id, 'ch' || (user_id % 30) AS channel, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY channel ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) - 1 AS hour_n, count(*) OVER (PARTITION BY channel, s // 86400 ORDER BY s) - 1 AS day_n FROM p)
SELECT event_id, channel, hour_n, day_n, CASE WHEN hour_n >= {dims.CHANNEL_LIMITS[0]} THEN 'hour' WHEN day_n >= {dims.CHANNEL_LIMITS[1]} THEN 'day' END AS held_by FROM c"""


def _runs(spark, sf):
    return read(spark, sf, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") <= 50).alias("ok"))


def failure_streak(spark, sf):
    return rq.failure_streak(_runs(spark, sf)).select("job", "run_id", "streak")


FAILURE_STREAK_SQL = """WITH r AS (SELECT event_type AS job, event_id AS run_id, ts, value <= 50 AS ok FROM events),
g AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY job ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT job, run_id, CAST(sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY job, g ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g"""
_CADENCE = sql_rows("rules", "job, every_days, grace_days", dims.CADENCE)


def freshness(spark, sf):
    rules = dims.table(spark, dims.CADENCE, "job string, every_days int, grace_days int")
    return rq.freshness(rules, _runs(spark, sf), F.lit("2024-02-02 12:00:00").cast("timestamp"))


FRESHNESS_SQL = f"""WITH {_CADENCE}, r AS (SELECT event_type AS job, event_id AS run_id, ts, value <= 50 AS ok FROM events),
l AS (SELECT job, max(ts) FILTER (WHERE ok) AS last_ok, arg_max(ok, {{'t': ts, 'r': run_id}}) AS latest_ok FROM r GROUP BY 1),
a AS (SELECT rules.*, latest_ok, CAST(floor((epoch(TIMESTAMP '2024-02-02 12:00:00') - floor(epoch(last_ok))) / 86400) AS BIGINT) AS age_days FROM rules LEFT JOIN l USING (job))
SELECT job, age_days, CASE WHEN latest_ok IS NULL THEN 'never ran' WHEN age_days IS NULL THEN '?' WHEN NOT latest_ok THEN 'failed' WHEN age_days > every_days + grace_days THEN 'late' ELSE 'ok' END AS state FROM a"""


def _usage(spark, sf):
    return read(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("service"), F.expr("cast(1 + event_id % 5 as bigint)").alias("units"),
        F.expr("cast(case event_type when 'click' then 200 when 'view' then 210 when 'error' then 190 end as bigint)").alias("daily_limit"),
    )


def usage_vs_limit(spark, sf):
    return rq.usage_vs_limit(_usage(spark, sf))


USAGE = "u AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS service, 1 + event_id % 5 AS units, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 210 WHEN 'error' THEN 190 END AS daily_limit FROM events)"
USAGE_VS_LIMIT_SQL = f"""WITH {USAGE}, s AS (SELECT day, service, CAST(sum(units) AS BIGINT) AS units, CAST(max(daily_limit) AS BIGINT) AS daily_limit FROM u GROUP BY 1, 2)
SELECT *, daily_limit - units AS remaining, units > daily_limit AS over FROM s"""

QUERIES = {
    "term_hits": term_hits, "term_hits_table": term_hits_table, "relevance_score": relevance_score, "relevance_outcome": relevance_outcome, "replay_diff": replay_diff,
    "age_window": age_window, "grade_gate": grade_gate, "feed_gate": feed_gate, "select_newest": select_newest, "review_queue": review_queue,
    "run_stats": run_stats, "signal_rows": signal_rows, "promote": promote, "publish_batch": publish_batch, "batch_counts": batch_counts,
    "queue_join": queue_join, "queue_counts": queue_counts, "queue_page": queue_page, "batch_no": batch_no, "decisions": decisions,
    "rate_limit": rate_limit, "failure_streak": failure_streak, "freshness": freshness, "usage_vs_limit": usage_vs_limit,
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES}
