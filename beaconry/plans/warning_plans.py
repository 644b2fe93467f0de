"""Warning-archive queries; the archive is assembled from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import dims
from beaconry.operators import warnings_archive as wa
from beaconry.plans.common import read, sql_literal, sql_rows, stamp
from beaconry.session import spread


_LAT, _LON = "(event_id * 37 % 1700)", "(event_id * 53 % 2300)"


def _figures(degrees: str, side: str) -> str:
    return f"concat('-', lpad(cast({degrees} % 100 * 3 div 5 as string), 2, '0'), '.', event_id % 10, '{side}')"


def _text(sql: bool) -> str:
    """The message text as one expression; the few spellings in which the engines differ are named.

    Spark's reads the figures behind whole degrees, which four places share, from the columns of ``_figures``: written out in
    each of them, they make a method that is too long for Java to compile, and every row is interpreted.
    """
    string = "varchar" if sql else "string"
    seas = "[" + ", ".join(f"'{s}'" for s in dims.SEAS) + "]"

    def pad(value: str, width: int) -> str:
        return f"lpad(cast(({value}) as {string}), {width}, '0')"

    def div(value: str, by: int) -> str:
        return f"(({value}) // {by})" if sql else f"(({value}) div {by})"

    def pick(letters: str, index: str, width: int = 1) -> str:
        return f"substr('{letters}', cast({index} as int), {width})"

    def when(test: str, then: str) -> str:
        return f"(case when {test} then {then} else '' end)"

    def position(shift: int) -> str:
        """Degrees and decimal minutes, a corner ``shift`` degrees away; four times as far on wide areas."""
        step = f"{shift} * (case when event_id % 40 = 0 then 4 else 1 end)"
        lat, lon = _LAT, _LON
        if not sql:
            return f"concat({pad(f'30 + {div(lat, 100)} + {step}', 2)}, lat_figures, {pad(f'19 + {div(lon, 100)} + {step}', 3)}, lon_figures)"
        return (
            f"concat({pad(f'30 + {div(lat, 100)} + {step}', 2)}, '-', {pad(div(lat + ' % 100 * 3', 5), 2)}, '.', event_id % 10, '0N ', "
            f"{pad(f'19 + {div(lon, 100)} + {step}', 3)}, '-', {pad(div(lon + ' % 100 * 3', 5), 2)}, '.', event_id % 10, '0E')"
        )

    year, month = pad("12 + event_id % 12", 2), pick("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC", "(event_id % 12) * 3 + 1", 3)
    stamp_ = f"{pad('event_id % 31 + 1', 2)}, {pad('event_id % 24', 2)}, {pad('event_id % 60', 2)}"
    header = f"concat('ZCZC ', {pick('DFPTQ', 'event_id % 5 + 1')}, {pick('ABDQ', 'event_id % 4 + 1')}, {pad('event_id % 100', 2)}, ' ', {stamp_}, ' UTC ', {month}, ' ', {year}, ' ')"
    sea = f"{seas}[event_id % 7 + 1]" if sql else f"element_at(array{seas.replace('[', '(').replace(']', ')')}, cast(event_id % 7 as int) + 1)"
    cancels = "event_id % 11 = 0 and event_id % 2 = 1"
    activity = """(case event_type when 'click' then 'TARGET PRACTICE AND DRILL. ' when 'view' then 'SOUNDING AND MAPPING. '
        when 'error' then 'SALVAGE OPERATIONS. ' when 'purchase' then 'DRIFTING TIMBER. ' else 'FIREWORKS ASHORE. ' end)"""
    parts = [
        when("event_id % 3 = 0", header),
        when("event_id % 2 = 0", f"concat('LIME  ROCK RADIO NAVWARN ', {pad('event_id % 900', 3)}, '/', {year}, ' ')"),
        f"concat({sea}, '. ')",
        when(cancels, f"concat('CANCEL NAVWARN ', {pad('event_id % 900', 3)}, '/24. ')"),
        when(f"not ({cancels})", activity),
        when("event_id % 11 <> 0", f"concat('IN POSITION ', {position(0)}, ' ')"),
        when("event_id % 11 <> 0 and event_id % 4 = 0", f"concat('AREA BOUND BY ', {position(1)}, ' ', {position(2)}, ' ', {position(0)}, '. ')"),
        when("event_id % 37 = 0", "'NORDWIND RANGE. '"),
        "'NNNN'",
    ]
    return "concat(" + ", ".join(parts) + ")"


#: Reading a message takes some hundred times what reading its row takes.
MESSAGES_OF_A_TASK = 100_000


def archive(spark, sf):
    authorities = "array(" + ", ".join(sql_literal(a) for a in dims.AUTHORITIES) + ")"
    events = spread(read(spark, sf, "events", False).select("event_id", "user_id", "event_type"), MESSAGES_OF_A_TASK)
    figured = events.select("*", F.expr(_figures(_LAT, "0N ")).alias("lat_figures"), F.expr(_figures(_LON, "0E")).alias("lon_figures"))
    return figured.select(
        "event_id",
        F.expr("cast(2012 + event_id % 12 as int)").alias("year"),
        F.expr("cast(event_id % 600 as int)").alias("number"),
        F.expr("concat('A', user_id % 4)").alias("area"),
        F.expr(f"element_at({authorities}, cast(user_id % 9 as int) + 1)").alias("authority"),
        F.inline(F.array(F.struct(F.expr(_text(False)).alias("text")))),  # a one-row generator: filters on the text do not repeat it
    )


ARCHIVE = f"""archive AS (SELECT event_id, CAST(2012 + event_id % 12 AS INTEGER) AS year, CAST(event_id % 600 AS INTEGER) AS number,
  'A' || (user_id % 4) AS area, {sql_literal(dims.AUTHORITIES)}[user_id % 9 + 1] AS authority, {_text(True)} AS text FROM events)"""

_P = wa.PLACE


def _degrees_sql(figures: str, side: str) -> str:
    parts = f"list_filter(string_split_regex(replace({figures}, ',', '.'), '[\\s-]+'), lambda p: p <> '')"
    number = lambda i: f"TRY_CAST({parts}[{i}] AS DOUBLE)"
    whole = f"length(split_part({parts}[1], '.', 1))"
    joined = f"CASE WHEN {whole} >= 4 THEN TRY_CAST(left({parts}[1], {whole} - 2) AS DOUBLE) + TRY_CAST(substr({parts}[1], {whole} - 1) AS DOUBLE) / 60 END"
    value = f"CASE len({parts}) WHEN 1 THEN {joined} WHEN 2 THEN {number(1)} + {number(2)} / 60 WHEN 3 THEN {number(1)} + {number(2)} / 60 + {number(3)} / 3600 END"
    return f"round(({value}) * CASE WHEN {side} IN ('S', 'W') THEN -1 ELSE 1 END, 6)"


POSITIONS = rf"""raw_pos AS (SELECT event_id, {', '.join(f"unnest(regexp_extract_all(text, '{_P}', {i})) AS g{i}" for i in range(1, 5))},
    generate_subscripts(regexp_extract_all(text, '{_P}', 1), 1) AS k FROM archive),
dec_pos AS (SELECT event_id, k, {_degrees_sql('g1', 'g2')} AS lat, {_degrees_sql('g3', 'g4')} AS lon FROM raw_pos),
ok_pos AS (SELECT event_id, lat, lon, min(k) AS k FROM dec_pos WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY 1, 2, 3),
pos AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY k) - 1 AS ordinal, lat, lon FROM ok_pos)"""


def _activity_sql(text: str) -> str:
    whens = " ".join(f"WHEN contains(upper({text}), '{n}') THEN '{k}'" for _, k, n in dims.ACTIVITIES)
    return f"CASE {whens} END"


_CANCEL = f"""(contains(upper({{t}}), 'CANCEL') AND NOT list_has_any(string_split_regex(upper({{t}}), '[^A-Z0-9]+'), {sql_literal(list(wa.OWN_CONTENT))})
  AND NOT regexp_matches(upper({{t}}), '(^|[^A-Z0-9])[0-9]{{{{6}}}}Z($|[^A-Z0-9])'))""".replace("{{6}}", "{6}")
_NAMED = " OR ".join(f"contains(upper(text), '{w}')" for w in dims.OWN_SEAS)
_WEST, _SOUTH, _EAST, _NORTH = dims.OWN_BOX
MARKED = rf"""{ARCHIVE}, {POSITIONS},
hit AS (SELECT DISTINCT event_id FROM pos WHERE lon BETWEEN {_WEST} AND {_EAST} AND lat BETWEEN {_SOUTH} AND {_NORTH}),
marked AS (SELECT *, ({_NAMED}) OR event_id IN (SELECT event_id FROM hit) AS in_region,
    regexp_matches(upper(coalesce(authority, '') || ' ' || substr(text, 1, 120)), '{dims.EXCLUDED_ISSUER}') OR regexp_matches(upper(text), '{dims.EXCLUDED_SUBJECT}') AS excluded,
    {_CANCEL.replace('{t}', 'text')} AS cancellation, {_activity_sql('text')} AS activity,
    CASE WHEN authority IS NULL THEN 'unknown' ELSE rtrim(split_part(authority, ' ', 1), '.,') END AS authority_key FROM archive),
messages AS (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY year, number, area ORDER BY event_id) = 1),
counted AS (SELECT * FROM messages WHERE in_region AND NOT excluded AND NOT cancellation)"""


def marked(spark, sf):
    return wa.flagged(archive(spark, sf), dims.OWN_SEAS, dims.OWN_BOX, dims.EXCLUDED_ISSUER, dims.EXCLUDED_SUBJECT, dims.ACTIVITIES)


def messages(spark, sf):
    return wa.once_per_message(marked(spark, sf), "event_id")


# ---------------------------------------------------------------- P15 / P16
def warn_facts(spark, sf):
    stations = dims.table(spark, dims.STATIONS, "station_letter string, station string")
    subjects = dims.table(spark, dims.SUBJECTS, "subject_letter string, subject string")
    facts = wa.warn_facts(archive(spark, sf), "event_id", stations, subjects, dims.ACTIVITIES)
    return facts.withColumn("issued_at", stamp("issued_at")).withColumn("body_md5", F.md5("body")).drop("body")


_S, _C = wa.SERIAL, wa.CANCELS
WARN_FACTS_SQL = rf"""WITH {ARCHIVE}, {sql_rows('stations', 'station_letter, station', dims.STATIONS)}, {sql_rows('subjects', 'subject_letter, subject', dims.SUBJECTS)},
f AS (SELECT event_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM archive),
w AS (SELECT event_id, flat, string_split(flat, ' ') AS words, list_position(list_transform(string_split(flat, ' '), lambda x: upper(x)), '{wa.START_WORD}') AS zc FROM f),
v AS (SELECT *, zc IS NOT NULL AND regexp_full_match(upper(words[zc + 1]), '[A-Z][A-Z][0-9][0-9]') AND regexp_full_match(words[zc + 2], '[0-9]+') AND length(words[zc + 2]) = 6
  AND upper(words[zc + 3]) = 'UTC' AND length(words[zc + 4]) = 3 AND regexp_matches(words[zc + 5], '^[0-9][0-9]') AS headed FROM w),
g AS (SELECT event_id, flat, CASE WHEN headed THEN array_to_string(words[zc : zc + 4], ' ') || ' ' || left(words[zc + 5], 2) ELSE '' END AS head,
  regexp_extract(flat, '{_S}', 0) AS serial, CASE WHEN headed THEN upper(words[zc + 1]) END AS mark, CASE WHEN headed THEN words[zc + 2] END AS clock,
  CASE WHEN headed THEN upper(words[zc + 4]) END AS mon, CASE WHEN headed THEN left(words[zc + 5], 2) END AS yy,
  {', '.join(f"nullif(regexp_extract(flat, '{_S}', {i}), '') AS s{i}" for i in range(1, 4))},
  nullif(regexp_extract(flat, '{_C}', 1), '') AS c1 FROM v),
e AS (SELECT *, CASE WHEN serial <> '' AND strpos(flat, serial) + length(serial) - 1 > CASE WHEN head <> '' THEN strpos(flat, head) + length(head) - 1 ELSE 0 END THEN strpos(flat, serial) + length(serial) - 1
   WHEN head <> '' THEN strpos(flat, head) + length(head) - 1 ELSE 0 END AS stop FROM g)
SELECT event_id, mark[1] AS station_letter, mark[2] AS subject_letter, mark[3:] AS serial_in_subject,
  strftime(try_strptime('20' || yy || mon || clock, '%Y%b%d%H%M'), '%Y-%m-%d %H:%M:%S') AS issued_at,
  array_to_string(list_transform(string_split(regexp_replace(s1, '\s+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS issuing_station,
  upper(s2) AS warning_kind, replace(s3, ' ', '') AS warning_serial, {_activity_sql('flat')} AS activity, {_CANCEL.replace('{t}', 'flat')} AS cancellation_only,
  replace(c1, ' ', '') AS cancelled_serial, station, subject, md5(regexp_replace(trim(substr(flat, stop + 1)), '\s*NNNN\s*$', '')) AS body_md5
FROM e LEFT JOIN stations ON stations.station_letter = mark[1] LEFT JOIN subjects ON subjects.subject_letter = mark[2]"""


def warn_positions(spark, sf):
    return wa.warn_positions(archive(spark, sf), "event_id")


WARN_POSITIONS_SQL = f"WITH {ARCHIVE}, {POSITIONS} SELECT event_id, ordinal, lat, lon FROM pos"


# ---------------------------------------------------------------- F7 / F8
def in_region(spark, sf):
    return marked(spark, sf).where("in_region").select("event_id")


def issuer_exclude(spark, sf):
    return marked(spark, sf).groupBy("year").agg(F.count_if("excluded").alias("excluded"), F.count_if(~F.col("excluded")).alias("kept"))


IN_REGION_SQL = f"WITH {MARKED} SELECT event_id FROM marked WHERE in_region"
ISSUER_EXCLUDE_SQL = f"WITH {MARKED} SELECT year, count(*) FILTER (WHERE excluded) AS excluded, count(*) FILTER (WHERE NOT excluded) AS kept FROM marked GROUP BY 1"


# ---------------------------------------------------------------- A2, A5, A16
def warn_series(spark, sf):
    found = messages(spark, sf)
    by_kind = wa.activity_counts(found).groupBy("year").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "activity", "n"))), ",").alias("by_activity")
    )
    return wa.warn_series(found).join(by_kind, "year", "left")


WARN_SERIES_SQL = f"""WITH {MARKED}, k AS (SELECT year, coalesce(activity, 'unclassified') AS a, count(*) AS n FROM counted GROUP BY 1, 2)
SELECT year, count(*) AS archive_all_areas, count(*) FILTER (WHERE in_region AND excluded) AS excluded,
  count(*) FILTER (WHERE in_region AND NOT excluded AND cancellation) AS cancellations,
  count(*) FILTER (WHERE in_region AND NOT excluded AND NOT cancellation) AS total,
  count(DISTINCT CASE WHEN in_region AND NOT excluded AND NOT cancellation THEN authority_key END) AS authorities,
  any_value((SELECT string_agg(a || '=' || n, ',' ORDER BY a || '=' || n) FROM k WHERE k.year = messages.year)) AS by_activity
FROM messages GROUP BY year"""


def top_authorities(spark, sf):
    return wa.top_authorities(messages(spark, sf), 12, 6)


TOP_AUTHORITIES_SQL = f"""WITH {MARKED}, y AS (SELECT year, authority_key, count(*) AS n FROM counted GROUP BY 1, 2),
t AS (SELECT NULL AS year, authority_key, CAST(sum(n) AS BIGINT) AS n FROM y GROUP BY 2)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY n DESC, authority_key) AS rank FROM t) WHERE rank <= 12
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, authority_key) AS rank FROM y) WHERE rank <= 6"""


def per_thousand(spark, sf):
    found = messages(spark, sf)
    military = [k for k, g in dims.GROUPS.items() if g == "military"]
    grouped = wa.activity_counts(found).where(F.col("activity").isin(*military)).groupBy("year").agg(F.sum("n").alias("in_group"))
    rated = wa.per_thousand(wa.warn_series(found), grouped, dims.SERIES_FROM, dims.BREAK_YEAR)
    return rated.withColumn("per_thousand", F.round("per_thousand", 4)).withColumn("group_share", F.round("group_share", 4))


_MIL = ", ".join(f"'{k}'" for k, g in dims.GROUPS.items() if g == "military")
PER_THOUSAND_SQL = f"""WITH {MARKED}, s AS (SELECT year, count(*) AS a, count(*) FILTER (WHERE in_region AND NOT excluded AND NOT cancellation) AS t,
  count(*) FILTER (WHERE in_region AND NOT excluded AND NOT cancellation AND activity IN ({_MIL})) AS g FROM messages WHERE year >= {dims.SERIES_FROM} GROUP BY 1),
r AS (SELECT year, 1000.0::DOUBLE * t / a AS p, CASE WHEN t > 0 THEN g::DOUBLE / t ELSE 0.0 END AS sh FROM s)
SELECT year, round(p, 4) AS per_thousand, round(sh, 4) AS group_share, year >= {dims.BREAK_YEAR} AS after_break,
  (SELECT year FROM r ORDER BY p DESC, year LIMIT 1) AS peak_year FROM r WHERE (SELECT count(*) FROM r) >= 5"""


# ---------------------------------------------------------------- A3, A4, J6
def density(spark, sf):
    return wa.warn_density(marked(spark, sf), dims.GROUPS, dims.DENSITY_YEARS, dims.CELL_DEG, dims.MAX_SPAN_DEG2)


_C0 = dims.CELL_DEG
DENSITY = f"""{MARKED}, span AS (SELECT event_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM pos GROUP BY 1),
boxed AS (SELECT CASE {' '.join(f"WHEN activity = '{k}' THEN '{g}'" for k, g in dims.GROUPS.items())} ELSE 'other' END AS kind, w, e, s, n
  FROM marked JOIN span USING (event_id) WHERE in_region AND NOT excluded AND NOT cancellation AND year BETWEEN {dims.DENSITY_YEARS[0]} AND {dims.DENSITY_YEARS[1]} AND (e - w) * (n - s) <= {dims.MAX_SPAN_DEG2}),
cx AS (SELECT kind, s, n, unnest(range(CAST(floor(w / {_C0}) AS BIGINT), CAST(floor((e + 1e-9) / {_C0}) AS BIGINT) + 1)) AS ix FROM boxed),
cxy AS (SELECT kind, ix, unnest(range(CAST(floor(s / {_C0}) AS BIGINT), CAST(floor((n + 1e-9) / {_C0}) AS BIGINT) + 1)) AS iy FROM cx),
grid AS (SELECT ix, iy, count(*) FILTER (WHERE kind = 'military') AS military, count(*) FILTER (WHERE kind = 'survey') AS survey, count(*) FILTER (WHERE kind = 'other') AS other FROM cxy GROUP BY 1, 2)"""
WARN_DENSITY_SQL = f"WITH {DENSITY} SELECT * FROM grid"
_IN_BOX = f"(ix + 0.5) * {_C0} BETWEEN west AND east AND (iy + 0.5) * {_C0} BETWEEN south AND north"


def cells_boxes(spark, sf):
    boxes = dims.table(spark, dims.BOXES, dims.BOX_SCHEMA)
    return wa.cells_in_boxes(density(spark, sf), boxes, dims.CELL_DEG).select("box", "ix", "iy", "military")


def region_rollup(spark, sf):
    boxes = dims.table(spark, dims.BOXES, dims.BOX_SCHEMA)
    return wa.region_rollup(density(spark, sf), boxes, dims.CELL_DEG)


_BOXES = sql_rows("boxes", "box, west, south, east, north", dims.BOXES)
CELLS_BOXES_SQL = f"WITH {DENSITY}, {_BOXES} SELECT box, ix, iy, military FROM grid JOIN boxes ON {_IN_BOX}"
REGION_ROLLUP_SQL = f"""WITH {DENSITY}, {_BOXES} SELECT box, CAST(coalesce(sum(military), 0) AS BIGINT) AS military, CAST(coalesce(sum(survey), 0) AS BIGINT) AS survey,
  CAST(coalesce(sum(other), 0) AS BIGINT) AS other, count(ix) AS cells FROM boxes LEFT JOIN grid ON {_IN_BOX} GROUP BY 1"""

QUERIES = {
    "warn_facts": warn_facts, "warn_positions": warn_positions, "in_region": in_region, "issuer_exclude": issuer_exclude,
    "warn_series": warn_series, "top_authorities": top_authorities, "per_thousand": per_thousand, "warn_density": density,
    "cells_boxes": cells_boxes, "region_rollup": region_rollup,
}
ORACLES = {
    "warn_facts": WARN_FACTS_SQL, "warn_positions": WARN_POSITIONS_SQL, "in_region": IN_REGION_SQL, "issuer_exclude": ISSUER_EXCLUDE_SQL,
    "warn_series": WARN_SERIES_SQL, "top_authorities": TOP_AUTHORITIES_SQL, "per_thousand": PER_THOUSAND_SQL, "warn_density": WARN_DENSITY_SQL,
    "cells_boxes": CELLS_BOXES_SQL, "region_rollup": REGION_ROLLUP_SQL,
}
