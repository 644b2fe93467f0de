"""Text, key and dedup queries over ``documents``, ``pages``, ``benchmark`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import dims
from beaconry.functions import hashing
from beaconry.operators import dedup, text

from beaconry.plans.common import (
    NOT_W_SQL,
    RUN_TS,
    SIGNALS,
    casefold_sql,
    fold_sql,
    read,
    signals,
    sql_literal,
    squash_sql,
    stamp,
    stamp_sql,
    words_sql,
)
from beaconry.session import cut_lineage, scratch_path
from beaconry.sinks.keyed_store import KeyedStore

EXCERPT_CHARS = 500

# ---------------------------------------------------------------- P1: URL keys
def _links(spark, sf):
    variants = """array(
        url,
        concat(regexp_replace(url, '#.*$', ''), if(url like '%?%', '&', '?'), 'UTM_medium=x&gclid=1', if(url like '%#%', '#top', '')),
        regexp_replace(url, '^http(s?)://([^/]*)', 'HTTP$1://user:pw@$2.:80'),
        case page_id % 5 when 0 then concat('ftp://files.example.org/', page_id) when 1 then 'http:///nohost'
             when 2 then concat('https://far.example.org:99999/', page_id) when 3 then concat(url, '#!/state/', page_id % 3)
             else concat('  https://[2001:DB8::1]:443/?b=2&a=', page_id % 3, '&&b=1 ') end)"""
    return read(spark, sf, "pages").select(F.explode(F.expr(variants)).alias("link"))


def url_canonical(spark, sf):
    return text.url_canonical(_links(spark, sf), "link")


_TRACK = ", ".join(f"'{p}'" for p in text.TRACKING_PARAMS)
URL_CANONICAL_SQL = rf"""
WITH links AS (SELECT unnest([
    url,
    regexp_replace(url, '#.*$', '') || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'UTM_medium=x&gclid=1' || CASE WHEN url LIKE '%#%' THEN '#top' ELSE '' END,
    regexp_replace(url, '^http(s?)://([^/]*)', 'HTTP\1://user:pw@\2.:80'),
    CASE page_id % 5 WHEN 0 THEN 'ftp://files.example.org/' || page_id WHEN 1 THEN 'http:///nohost'
      WHEN 2 THEN 'https://far.example.org:99999/' || page_id WHEN 3 THEN url || '#!/state/' || (page_id % 3)
      ELSE '  https://[2001:DB8::1]:443/?b=2&a=' || (page_id % 3) || '&&b=1 ' END]) AS raw FROM pages),
p AS (SELECT raw, trim(raw) AS u FROM links),
q AS (SELECT raw, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
    regexp_replace(regexp_extract(u, '^[a-zA-Z][^:]*://([^/?#]*)', 1), '^.*@', '') AS addr,
    regexp_extract(u, '^[a-zA-Z][^:]*://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(u, '#(.*)$', 1) AS frag FROM p),
r AS (SELECT *, CASE WHEN addr LIKE '[%' THEN lower(regexp_extract(addr, '^(\[[^\]]*\])', 1))
      ELSE rtrim(lower(split_part(addr, ':', 1)), '.') END AS host,
    TRY_CAST(nullif(regexp_extract(addr, '^(?:\[[^\]]*\]|[^:]*):(.*)$', 1), '') AS BIGINT) AS port,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> ''
      AND lower(split_part(x, '=', 1)) NOT IN ({_TRACK})
      AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_|pk_|mtm_|hsa_)'))), '&') AS kept FROM q),
s AS (SELECT raw, CASE WHEN port > 65535 THEN 'unparseable' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' END AS reason,
    scheme || '://' || host || CASE WHEN port IS NULL OR port = CASE scheme WHEN 'http' THEN 80 ELSE 443 END THEN '' ELSE ':' || port END
      || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END
      || CASE WHEN frag[1] IN ('!', '/') THEN '#' || frag ELSE '' END AS url FROM r)
SELECT CASE WHEN reason IS NULL THEN url END AS canonical, reason, count(*) AS n_links,
       count(DISTINCT CASE WHEN reason IS NULL THEN raw END) AS n_variants
FROM s GROUP BY 1, 2"""


# ---------------------------------------------------------------- P2: content keys
def content_keys(spark, sf):
    docs = signals(spark, sf).withColumn("url", F.concat(F.lit("https://"), "lang", F.lit(".example.org/d")))
    return text.copies_per_key(text.content_keys(docs, "url", "text"), "doc_id")


CONTENT_KEYS_SQL = f"""
WITH k AS (SELECT doc_id, 'sha256:' || sha256('https://' || lang || '.example.org/d' || chr(10) || {squash_sql('text')}) AS content_key FROM documents)
SELECT content_key, substr(content_key, 8, 12) AS queue_id, count(*) AS copies, min(doc_id) AS first_doc_id FROM k GROUP BY 1, 2"""


# ---------------------------------------------------------------- P4: excerpts
def page_excerpts(spark, sf):
    return text.page_excerpts(read(spark, sf, "pages").select("page_id", "html"), "html", EXCERPT_CHARS)


PAGE_EXCERPTS_SQL = rf"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
    '<![^>]*>', '', 'g'), '(?i)</?(?:p|br|div|li|ul|ol|tr|td|h1|h2|h3|h4|h5|h6)(?:\s[^>]*)?/?>', ' ', 'g'), '</?[A-Za-z][^>]*>', '', 'g') AS x FROM pages),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM t),
s AS (SELECT page_id, {squash_sql('x')} AS x FROM d),
c AS (SELECT page_id, x, substr(x, 1, {EXCERPT_CHARS - 1}) AS cut FROM s),
e AS (SELECT *, CASE WHEN contains(cut, ' ') THEN length(cut) - strpos(reverse(cut), ' ') ELSE -1 END AS sp FROM c)
SELECT page_id, length(x) AS n_chars, CASE WHEN length(x) <= {EXCERPT_CHARS} THEN x
  ELSE rtrim(CASE WHEN sp > {EXCERPT_CHARS * 0.6} THEN substr(cut, 1, CAST(sp AS INTEGER)) ELSE cut END, ' ') || '…' END AS excerpt FROM e"""


# ---------------------------------------------------------------- P6: items
def _items(spark, sf):
    date_text = """case page_id % 7
        when 0 then concat('Wed, 03 Jan 2024 10:', lpad(page_id % 60, 2, '0'), ':00 +0300')
        when 1 then concat('2024-01-04T11:', lpad(page_id % 60, 2, '0'), ':09Z')
        when 2 then concat('2024-01-05 12:', lpad(page_id % 60, 2, '0'), ':09')
        when 3 then concat('2024-01-06T13:', lpad(page_id % 60, 2, '0'), ':09.250+01:00')
        when 4 then 'yesterday'
        when 5 then concat('2024-03-0', 1 + page_id % 9)
        else null end"""
    link = """case page_id % 6
        when 0 then url
        when 1 then concat('/a/', page_id, '?utm_source=feed')
        when 2 then concat('b/', page_id, '#part')
        when 3 then concat('//cdn.example.net/', page_id)
        when 4 then 'javascript:void(0)'
        else concat('?page=', page_id) end"""
    return read(spark, sf, "pages").select(
        "page_id",
        F.lit("https://base.example.org/feeds/all.xml").alias("base_url"),
        F.expr(link).alias("link"),
        F.expr(date_text).alias("date_text"),
        F.expr("if(page_id % 3 = 0, array('north'), if(page_id % 3 = 1, array('north', 'south'), cast(array() as array<string>)))").alias("regions"),
    )


def items_clean(spark, sf):
    cleaned = text.clean_items(_items(spark, sf), text.run_instant(RUN_TS))
    return cleaned.select("page_id", "url", "invalid", stamp("published").alias("published"), "region")


ITEMS_CLEAN_SQL = f"""
WITH i AS (SELECT page_id, url AS own, page_id % 60 AS mi, lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') AS mm FROM pages),
c AS (SELECT page_id, CASE page_id % 6
    WHEN 0 THEN regexp_replace(regexp_replace(regexp_replace(own, '#.*$', ''), '([?&])utm_[^=&#]*=[^&#]*', '\\1', 'g'), '[?&]+$', '')
    WHEN 1 THEN 'https://base.example.org/a/' || page_id
    WHEN 2 THEN 'https://base.example.org/feeds/b/' || page_id
    WHEN 3 THEN 'https://cdn.example.net/' || page_id
    WHEN 4 THEN NULL
    ELSE 'https://base.example.org/feeds/all.xml?page=' || page_id END AS url,
  CASE page_id % 7
    WHEN 0 THEN TIMESTAMP '2024-01-03 07:00:00' + to_minutes(mi)
    WHEN 1 THEN TIMESTAMP '2024-01-04 11:00:09' + to_minutes(mi)
    WHEN 2 THEN TIMESTAMP '2024-01-05 12:00:09' + to_minutes(mi)
    WHEN 3 THEN TIMESTAMP '2024-01-06 12:00:09' + to_minutes(mi) END AS published FROM i)
SELECT page_id, url, url IS NULL AS invalid, {stamp_sql('published')} AS published,
       CASE WHEN page_id % 3 = 0 THEN 'north' END AS region FROM c"""


# ---------------------------------------------------------------- P8: token index
def token_index(spark, sf):
    index = text.token_index(signals(spark, sf), "doc_id", ["title", "text"])
    return index.groupBy("field", "token").agg(
        F.count_distinct("doc_id").alias("n_docs"),
        F.count(F.lit(1)).alias("n_hits"),
        F.sum(F.col("position").cast("bigint")).alias("position_sum"),
        F.min("doc_id").alias("first_doc"),
    )


TOKEN_INDEX_SQL = f"""
WITH {SIGNALS}, f AS (SELECT doc_id, 'title' AS field, {words_sql(fold_sql('title'))} AS t FROM signals
  UNION ALL SELECT doc_id, 'text', {words_sql(fold_sql('text'))} FROM signals),
x AS (SELECT doc_id, field, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS position FROM f)
SELECT field, token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits, CAST(sum(position) AS BIGINT) AS position_sum, min(doc_id) AS first_doc
FROM x GROUP BY 1, 2"""


# ---------------------------------------------------------------- P10: signatures
def signed_docs(spark, sf):
    """Signals with content key, short id and signature: the input of every dedup query."""
    docs = text.content_keys(signals(spark, sf), "url", "text")
    signature = text.signatures(docs, "doc_id", F.concat_ws("\n", "title", "text"))
    return docs.join(signature, "doc_id")


def signatures(spark, sf):
    signed = text.signatures(signals(spark, sf), "doc_id", F.concat_ws("\n", "title", "text"))
    return signed.select("doc_id", hashing.to_hex16(F.col("simhash")).alias("simhash"), "features")


SIGNATURES = rf"""toks AS (SELECT doc_id, {words_sql(casefold_sql("title || chr(10) || text"))} AS t FROM signals),
grams AS (SELECT doc_id, unnest(CASE WHEN len(t) < 3 THEN t ELSE
    list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS g FROM toks),
hashed AS (SELECT doc_id, CAST('0x' || substr(md5(g), 1, 16) AS UBIGINT) AS h FROM grams),
bits AS (SELECT doc_id, b.bit, sum((h >> b.bit) & 1) AS ones, count(*) AS n FROM hashed, (SELECT unnest(range(64)) AS bit) b GROUP BY 1, 2),
sig AS (SELECT s.doc_id, coalesce(CAST(sum(CASE WHEN ones * 2 > n THEN CAST(1 AS HUGEINT) << bit ELSE 0 END) AS UBIGINT), 0) AS simhash,
    coalesce(max(n), 0) AS features FROM signals s LEFT JOIN bits ON bits.doc_id = s.doc_id GROUP BY 1)"""
SIGNATURES_SQL = f"""WITH {SIGNALS}, {SIGNATURES}
SELECT doc_id, lpad(lower(to_hex(simhash)), 16, '0') AS simhash, CAST(features AS BIGINT) AS features FROM sig"""


# ---------------------------------------------------------------- P22 / P23: screens
def policy_flag(spark, sf):
    flagged = text.policy_flag(signals(spark, sf), F.concat_ws("\n", "title", "text"), dims.PROTECTED_TERMS)
    return flagged.select("doc_id", "flagged", F.array_join("terms_found", "|").alias("terms"))


def _term_sql(column: str, term: str, prefix: bool) -> str:
    end = "" if prefix and " " in term else f"($|{NOT_W_SQL})"
    return f"regexp_matches({column}, '(^|{NOT_W_SQL}){term}{end}')"


_TERMS = sorted(dims.PROTECTED_TERMS)
POLICY_FLAG_SQL = f"""
WITH {SIGNALS}, f AS (SELECT doc_id, {fold_sql("title || chr(10) || text")} AS x FROM signals),
h AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {_term_sql('x', t, True)} THEN {sql_literal(t)} END" for t in _TERMS)}], lambda v: v IS NOT NULL) AS hits FROM f)
SELECT doc_id, len(hits) > 0 AS flagged, array_to_string(hits, '|') AS terms FROM h"""


def _messages(spark, sf):
    extra = "case doc_id % 11 when 0 then ' near 36.8021 N' when 1 then ' at 36° 48'' N' when 2 then ' grid 37S DH 1234 5678' else '' end"
    return read(spark, sf, "documents").select("doc_id", F.concat("text", F.expr(extra)).alias("message"))


def screen_text(spark, sf):
    screened = text.screen_text(_messages(spark, sf), "message", dims.PROTECTED_TERMS, dims.POSITION_STEMS)
    return screened.select("doc_id", "safe", "reason", "positional", F.md5("message").alias("message_md5"))


_FINE = r"([\p{L}\p{N}]*[.,][0-9]+)\s*°?\s*([\p{L}\p{N}]*)"
_NEAR = "list_transform(range(1, len(ws) + 1), lambda i: [ws[i], ws[i] || ws[i + 1], ws[i] || ws[i + 1] || ws[i + 2]])"
_COORDINATES = rf"""(len(list_filter(list_zip(regexp_extract_all(message, '{_FINE}', 1), regexp_extract_all(message, '{_FINE}', 2)), lambda z:
      regexp_full_match(z[1], '[0-9]+[.,][0-9]+') AND strpos(replace(z[1], ',', '.'), '.') <= 4 AND length(z[1]) - strpos(replace(z[1], ',', '.'), '.') >= 3 AND length(z[2]) = 1 AND contains('{text.SIDES}', upper(z[2])))) > 0
    OR len(list_filter(range(1, len(ds)), lambda i: rtrim(ds[i])[-1] BETWEEN '0' AND '9' AND regexp_extract(ltrim(ds[i + 1]), '^[0-9]+') <> ''
      AND ltrim(ltrim(ds[i + 1])[length(regexp_extract(ltrim(ds[i + 1]), '^[0-9]+')) + 1 :])[1] IN (chr(39), '′'))) > 0
    OR len(list_filter(flatten({_NEAR}), lambda w: w IS NOT NULL AND len(list_filter([1, 2], lambda n: regexp_full_match(w[:n], '[0-9]+') AND contains('{text.BAND_LETTERS}', w[n + 1]) AND length(w) >= n + 5
      AND contains('{text.SQUARE_LETTERS}', w[n + 2]) AND contains('{text.SQUARE_LETTERS}', w[n + 3]) AND regexp_full_match(w[n + 4 :], '[0-9]+'))) > 0)) > 0)"""
SCREEN_TEXT_SQL = rf"""
WITH m AS (SELECT doc_id, text || CASE doc_id % 11 WHEN 0 THEN ' near 36.8021 N' WHEN 1 THEN ' at 36° 48'' N' WHEN 2 THEN ' grid 37S DH 1234 5678' ELSE '' END AS message FROM documents),
f AS (SELECT doc_id, message, {fold_sql('message')} AS x, string_split(message, '°') AS ds, string_split_regex(message, '[^\p{{L}}\p{{N}}]+') AS ws FROM m),
g AS (SELECT *, CASE WHEN {' OR '.join(_term_sql('x', t, True) for t in _TERMS)} THEN 'protected'
   WHEN {_COORDINATES} THEN 'coordinates' END AS reason,
   {' OR '.join(f"contains(x, '{s}')" for s in dims.POSITION_STEMS)} AS "positional" FROM f)
SELECT doc_id, reason IS NULL AS safe, reason, "positional", CASE WHEN reason IS NULL THEN md5(message) END AS message_md5 FROM g"""


# ---------------------------------------------------------------- P24: draft lint
DRAFT_LABELS = {"text_a": "[UNCONFIRMED]", "text_b": "[NOT CONFIRMED]"}
CHANNELS = [("wide", "text_a", 4096, True), ("short", "text_b", 300, False), ("open", "text_a", None, True)]


def _drafts(spark, sf):
    return read(spark, sf, "conversations").select(
        F.expr("conv_id * 100 + turn").alias("draft_id"),
        F.expr("if(conv_id % 4 = 3, 'record', 'bulletin')").alias("type"),
        F.expr("concat(if(conv_id % 3 = 0, '', '[UNCONFIRMED] '), text, if(turn % 2 = 0, ' Source: Agency 1 https://a.example.org/1', ' https://other.example.org/z'))").alias("text_a"),
        F.expr("concat(if(turn % 3 = 0, '', '[NOT CONFIRMED] '), text, ' Agency 1')").alias("text_b"),
        F.expr(
            "array(named_struct('name', concat('Agency ', 1 + turn % 2), 'url', 'https://a.example.org/1', 'archive_url', "
            "concat('https://archive.example.org/', conv_id), 'rating', substr('ABCDEF', cast(1 + conv_id % 5 as int), 1)), "
            "named_struct('name', 'Agency 9', 'url', 'https://b.example.org/9', 'archive_url', 'https://archive.example.org/9', 'rating', 'A'))"
        ).alias("sources"),
        F.expr("if(turn % 2 = 0, array('wide', 'short'), array('short', 'open'))").alias("channels"),
    )


def draft_findings(spark, sf):
    channels = dims.table(spark, CHANNELS, "channel string, language string, max_chars int, archives boolean")
    return text.draft_findings(_drafts(spark, sf), channels, DRAFT_LABELS, ["A", "B"])


DRAFT_FINDINGS_SQL = r"""
WITH d AS (SELECT conv_id * 100 + turn AS draft_id, turn, conv_id, CASE WHEN conv_id % 4 = 3 THEN 'record' ELSE 'bulletin' END AS type,
    CASE WHEN conv_id % 3 = 0 THEN '' ELSE '[UNCONFIRMED] ' END || text || CASE WHEN turn % 2 = 0 THEN ' Source: Agency 1 https://a.example.org/1' ELSE ' https://other.example.org/z' END AS text_a,
    CASE WHEN turn % 3 = 0 THEN '' ELSE '[NOT CONFIRMED] ' END || text || ' Agency 1' AS text_b,
    'Agency ' || (1 + turn % 2) AS n1, 'https://archive.example.org/' || conv_id AS a1, substr('ABCDEF', CAST(1 + conv_id % 5 AS INTEGER), 1) AS g1 FROM conversations),
l AS (SELECT draft_id, type, n1, a1, unnest([{'field': 'text_a', 'x': text_a, 'label': '[UNCONFIRMED]'}, {'field': 'text_b', 'x': text_b, 'label': '[NOT CONFIRMED]'}], recursive := true) FROM d),
u AS (SELECT draft_id, field, a1, unnest(regexp_extract_all(x, 'https?://[^\s<>"'']+')) AS link FROM l)
SELECT draft_id, 'sources' AS field, 'grade' AS rule, g1 AS detail FROM d WHERE type = 'bulletin' AND g1 NOT IN ('A', 'B')
UNION ALL SELECT draft_id, field, 'label', label FROM l WHERE type = 'bulletin' AND NOT contains(x, label)
UNION ALL SELECT draft_id, field, 'attribution', '' FROM l WHERE NOT contains(x, n1) AND NOT contains(x, 'Agency 9')
UNION ALL SELECT draft_id, field, 'link', link FROM u WHERE link NOT IN ('https://a.example.org/1', 'https://b.example.org/9', 'https://archive.example.org/9', a1)
UNION ALL SELECT draft_id, channel, 'length', CAST(n AS VARCHAR) FROM (
  SELECT draft_id, 'wide' AS channel, 4096 AS cap, length(trim(text_a)) + 2 + length(n1) + 2 + 23 + 3 + length(a1) + 1 + 8 + 2 + 23 + 3 + 29 AS n FROM d WHERE turn % 2 = 0
  UNION ALL SELECT draft_id, 'short', 300, length(trim(text_b)) + 2 + length(n1) + 2 + 23 + 1 + 8 + 2 + 23 FROM d) WHERE n > cap"""


# ---------------------------------------------------------------- W2, J1, J2, J3, W3
def first_wins(spark, sf):
    docs = text.content_keys(signals(spark, sf).withColumn("url", F.lit("https://one.example.org/")), "url", "text")
    kept = dedup.first_wins(docs.select("queue_id", "doc_id", "feed"), ["queue_id"], ["doc_id"])
    return kept.select("queue_id", "doc_id", "feed", (F.col("copies") - 1).alias("duplicates"))


FIRST_WINS_SQL = f"""
WITH k AS (SELECT doc_id, source AS feed, substr(sha256('https://one.example.org/' || chr(10) || {squash_sql('text')}), 1, 12) AS queue_id FROM documents)
SELECT queue_id, min(doc_id) AS doc_id, arg_min(feed, doc_id) AS feed, count(*) - 1 AS duplicates FROM k GROUP BY 1"""


def _ledger(signed):
    return signed.where("doc_id % 5 = 0").select("queue_id", "simhash", F.to_date("published").alias("seen"), F.col("doc_id").alias("ord"))


def ledger_exact(spark, sf):
    docs = text.content_keys(signals(spark, sf), "url", "text")
    known = docs.where("doc_id % 5 = 0").select("queue_id")
    return dedup.ledger_exact(docs.select("doc_id", "queue_id"), known)


LEDGER_EXACT_SQL = f"""WITH {SIGNALS}, k AS (SELECT doc_id, substr(sha256(url || chr(10) || {squash_sql('text')}), 1, 12) AS queue_id FROM signals)
SELECT doc_id, queue_id FROM k WHERE queue_id NOT IN (SELECT queue_id FROM k WHERE doc_id % 5 = 0)"""


def ledger_near(spark, sf):
    """Documents that are near nothing in a stored ledger: it holds every fifth document and, from a second run, the benchmark passages."""
    signed = cut_lineage(signed_docs(spark, sf).select("doc_id", "queue_id", "simhash"))
    ledger = KeyedStore(spark, scratch_path(spark, "ledger"), dedup.LEDGER)
    day = F.to_date(F.lit(RUN_TS))
    ledger.add(dedup.ledger_rows(signed.where("doc_id % 5 = 0").withColumn("seen", F.date_sub(day, 1))), 0)
    passages = text.signatures(read(spark, sf, "benchmark"), "item_id", F.col("text"))
    passages = passages.select(F.concat(F.lit("passage-"), F.col("item_id").cast("string")).alias("queue_id"), "simhash", day.alias("seen"))
    ledger.add(dedup.ledger_rows(passages), 1)
    return dedup.unlisted(signed.where("doc_id % 5 <> 0"), ledger).select("doc_id")


_BENCHMARK_TOO = SIGNALS.replace("signals AS", "own AS", 1) + """,
signals AS (SELECT doc_id, title, text FROM own UNION ALL SELECT -1 - row_number() OVER (), '', text FROM benchmark)"""
LEDGER_NEAR_SQL = f"""WITH {_BENCHMARK_TOO}, {SIGNATURES}
SELECT a.doc_id FROM sig a WHERE a.doc_id >= 0 AND a.doc_id % 5 <> 0 AND NOT EXISTS (
  SELECT 1 FROM sig b WHERE (b.doc_id < 0 OR b.doc_id % 5 = 0) AND a.simhash <> 0 AND b.simhash <> 0 AND bit_count(CAST(xor(a.simhash, b.simhash) AS UBIGINT)::BITSTRING) <= 3)"""


def near_dedup(spark, sf):
    signed = signed_docs(spark, sf).select(F.col("doc_id").alias("ord"), "queue_id", "simhash")
    return dedup.near_dedup(signed).select(F.col("ord").alias("doc_id"))


NEAR_DEDUP_SQL = f"""WITH RECURSIVE {SIGNALS}, {SIGNATURES},
near AS MATERIALIZED (SELECT b.doc_id AS late, a.doc_id AS early FROM sig a JOIN sig b ON a.doc_id < b.doc_id AND a.simhash <> 0 AND b.simhash <> 0
  AND bit_count(CAST(xor(a.simhash, b.simhash) AS UBIGINT)::BITSTRING) <= 3),
prior AS MATERIALIZED (SELECT s.doc_id, row_number() OVER (ORDER BY s.doc_id) AS i, coalesce(list(n.early) FILTER (WHERE n.early IS NOT NULL), []) AS earlier
  FROM sig s LEFT JOIN near n ON n.late = s.doc_id GROUP BY 1),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept
  UNION ALL SELECT p.i, CASE WHEN list_has_any(p.earlier, w.kept) THEN w.kept ELSE list_append(w.kept, p.doc_id) END FROM walk w JOIN prior p ON p.i = w.i + 1)
SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)"""


def ledger_prune(spark, sf):
    signed = text.content_keys(signals(spark, sf), "url", "text")
    ledger = signed.select("queue_id", F.to_date("published").alias("seen"), F.col("doc_id").alias("ord"))
    kept = dedup.ledger_prune(ledger, F.to_date(F.lit("2024-02-10")), 20, 300)
    return kept.select("queue_id", F.date_format("seen", "yyyy-MM-dd").alias("seen"), "ord")


LEDGER_PRUNE_SQL = f"""WITH {SIGNALS}
SELECT substr(sha256(url || chr(10) || {squash_sql('text')}), 1, 12) AS queue_id, strftime(published, '%Y-%m-%d') AS seen, doc_id AS ord
FROM signals WHERE published >= TIMESTAMP '2024-01-21 00:00:00' ORDER BY doc_id DESC LIMIT 300"""


QUERIES = {
    f.__name__: f
    for f in (
        url_canonical, content_keys, page_excerpts, items_clean, token_index, signatures, policy_flag, screen_text,
        draft_findings, first_wins, ledger_exact, ledger_near, near_dedup, ledger_prune,
    )
}
ORACLES = {
    "url_canonical": URL_CANONICAL_SQL,
    "content_keys": CONTENT_KEYS_SQL,
    "page_excerpts": PAGE_EXCERPTS_SQL,
    "items_clean": ITEMS_CLEAN_SQL,
    "token_index": TOKEN_INDEX_SQL,
    "signatures": SIGNATURES_SQL,
    "policy_flag": POLICY_FLAG_SQL,
    "screen_text": SCREEN_TEXT_SQL,
    "draft_findings": DRAFT_FINDINGS_SQL,
    "first_wins": FIRST_WINS_SQL,
    "ledger_exact": LEDGER_EXACT_SQL,
    "ledger_near": LEDGER_NEAR_SQL,
    "near_dedup": NEAR_DEDUP_SQL,
    "ledger_prune": LEDGER_PRUNE_SQL,
}
