"""Trade queries; one statistic row per ``lineitem``, reporter from the supplier, partner from the customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import dims
from beaconry.functions.periods import shift
from beaconry.operators import trade
from beaconry.plans.common import read, sql_literal, sql_rows

TODAY = "200108"
MODES = dict(dims.MODES)


def stats(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("partner"))
    suppliers = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("reporter"))
    joined = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select(
        "l_orderkey", "l_linenumber",
        F.date_format("l_shipdate", "yyyyMM").alias("period"), "reporter", "partner",
        F.expr("if(l_linestatus = 'O', 'M', 'X')").alias("flow"),
        F.expr("lpad(cast(l_partkey % 97 as string), 2, '0')").alias("chapter"),
        F.expr("concat(lpad(cast(l_partkey % 97 as string), 2, '0'), lpad(cast(l_partkey % 7 as string), 2, '0'))").alias("heading"),
        F.expr("case l_returnflag when 'A' then '0' when 'N' then '2100' else '3200' end").alias("mot"),
        F.expr("case l_linenumber when 7 then 'C01' when 5 then null else 'C00' end").alias("customs"),
        F.expr("case l_linenumber when 6 then '36' when 4 then null else '0' end").alias("partner2"),
        F.expr("if(l_quantity = 13, null, l_extendedprice * (1 - l_discount))").alias("value"),
    )


STATS = """stats AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m') AS period, s_nationkey AS reporter, c_nationkey AS partner,
  CASE WHEN l_linestatus = 'O' THEN 'M' ELSE 'X' END AS flow, lpad(CAST(l_partkey % 97 AS VARCHAR), 2, '0') AS chapter,
  lpad(CAST(l_partkey % 97 AS VARCHAR), 2, '0') || lpad(CAST(l_partkey % 7 AS VARCHAR), 2, '0') AS heading,
  CASE l_returnflag WHEN 'A' THEN '0' WHEN 'N' THEN '2100' ELSE '3200' END AS mot, CASE l_linenumber WHEN 7 THEN 'C01' WHEN 5 THEN NULL ELSE 'C00' END AS customs,
  CASE l_linenumber WHEN 6 THEN '36' WHEN 4 THEN NULL ELSE '0' END AS partner2, CASE WHEN l_quantity = 13 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
single AS (SELECT * FROM stats WHERE coalesce(customs, 'C00') = 'C00' AND coalesce(partner2, '0') = '0' AND value IS NOT NULL),
und AS (SELECT * FROM single WHERE mot = '0')"""


def undivided(spark, sf):
    return trade.undivided(stats(spark, sf)).select("l_orderkey", "l_linenumber", "period", "reporter", "partner", "flow", F.round("value", 4).alias("value"))


UNDIVIDED_SQL = f"WITH {STATS} SELECT l_orderkey, l_linenumber, period, reporter, partner, flow, round(value, 4) AS value FROM und"


def period_dim(spark, sf):
    index = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    return trade.period_dim(F.min(index), F.max(index), read(spark, sf, "lineitem"))


PERIOD_DIM_SQL = """WITH b AS (SELECT min(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS f, max(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS l FROM lineitem),
m AS (SELECT CAST(unnest(range(f, l + 1)) AS INTEGER) AS "index" FROM b)
SELECT "index", printf('%04d%02d', "index" // 12, "index" % 12 + 1) AS period, printf('%04d%02d', ("index" - 1) // 12, ("index" - 1) % 12 + 1) AS previous, printf('%04d%02d', "index" // 12 - 1, "index" % 12 + 1) AS year_before FROM m"""


def latest_reported(spark, sf):
    return trade.latest_reported(stats(spark, sf), dims.PIVOT_PERIOD, TODAY)


LATEST = f"""latest AS (SELECT reporter, max(period) FILTER (WHERE mot = '0' AND value IS NOT NULL AND coalesce(customs, 'C00') = 'C00' AND coalesce(partner2, '0') = '0'
  AND period BETWEEN '{shift(TODAY, 24)}' AND '{shift(TODAY, 1)}' AND period > '{dims.PIVOT_PERIOD}') AS latest FROM stats GROUP BY 1)"""
LATEST_REPORTED_SQL = f"WITH {STATS}, {LATEST} SELECT * FROM latest"


def windows(spark, sf):
    return trade.window_periods(latest_reported(spark, sf), dims.PIVOT_PERIOD, dims.WINDOW_MONTHS)


_BEFORE = sql_literal([shift(dims.PIVOT_PERIOD, 1 + i) for i in range(dims.WINDOW_MONTHS)])
WINDOWS = f"""{LATEST}, win AS (SELECT reporter, 'before' AS label, unnest({_BEFORE}) AS period FROM latest
  UNION ALL SELECT reporter, 'after', printf('%04d%02d', k // 12, k % 12 + 1) FROM (SELECT reporter, CAST(latest[1:4] AS BIGINT) * 12 + CAST(latest[5:6] AS BIGINT) - 1 - unnest(range({dims.WINDOW_MONTHS})) AS k FROM latest WHERE latest IS NOT NULL))"""


def mirror_series(spark, sf):
    series = trade.mirror_series(stats(spark, sf), MODES)
    return series.select("period", "a", "b", *[F.round(c, 4).alias(c) for c in ("a_exports", "a_imports", "b_imports", "a_exports_sea", "a_exports_road")])


MIRROR = """sides AS (SELECT period, mot, value, reporter AS a, partner AS b, CASE WHEN flow = 'X' THEN 'a_exports' ELSE 'a_imports' END AS line FROM single
  UNION ALL SELECT period, mot, value, partner, reporter, 'b_imports' FROM single WHERE flow = 'M' AND mot = '0'),
mirror AS (SELECT period, a, b, sum(value) FILTER (WHERE line = 'a_exports' AND mot = '0') AS a_exports, sum(value) FILTER (WHERE line = 'a_imports' AND mot = '0') AS a_imports,
  sum(value) FILTER (WHERE line = 'b_imports' AND mot = '0') AS b_imports, sum(value) FILTER (WHERE line = 'a_exports' AND mot = '2100') AS a_exports_sea,
  sum(value) FILTER (WHERE line = 'a_exports' AND mot = '3200') AS a_exports_road FROM sides GROUP BY 1, 2, 3)"""
MIRROR_SERIES_SQL = f"""WITH {STATS}, {MIRROR} SELECT period, a, b, round(a_exports, 4) AS a_exports, round(a_imports, 4) AS a_imports, round(b_imports, 4) AS b_imports,
  round(a_exports_sea, 4) AS a_exports_sea, round(a_exports_road, 4) AS a_exports_road FROM mirror"""


def _framed(spark, sf):
    return trade.reported_absence(trade.mirror_series(stats(spark, sf), MODES), dims.CONTROL_PARTNER)


def reported_absence(spark, sf):
    return _framed(spark, sf).where("a_exports IS NULL").select("a", "b", "period", "reported")


FRAMED = f"""span AS (SELECT min(CAST(period[1:4] AS BIGINT) * 12 + CAST(period[5:6] AS BIGINT) - 1) AS f, max(CAST(period[1:4] AS BIGINT) * 12 + CAST(period[5:6] AS BIGINT) - 1) AS l FROM mirror),
frame AS (SELECT a, b, printf('%04d%02d', k // 12, k % 12 + 1) AS period FROM (SELECT DISTINCT a, b FROM mirror), (SELECT unnest(range(f, l + 1)) AS k FROM span)),
ctl AS (SELECT a, period, a_exports AS c FROM mirror WHERE b = {dims.CONTROL_PARTNER}),
framed AS (SELECT frame.*, a_exports, a_imports, b_imports, a_exports_sea, a_exports IS NOT NULL OR a_imports IS NOT NULL OR coalesce(c > 0, FALSE) AS reported
  FROM frame LEFT JOIN mirror USING (a, b, period) LEFT JOIN ctl USING (a, period))"""
REPORTED_ABSENCE_SQL = f"WITH {STATS}, {MIRROR}, {FRAMED} SELECT a, b, period, reported FROM framed WHERE a_exports IS NULL"


def halt_stats(spark, sf):
    found = trade.halt_stats(_framed(spark, sf), dims.PIVOT_PERIOD, "sea")
    rounded = {"mean_before": 8, "total": 4, "total_reported": 4, "mode_share": 4}
    return found.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else c for c in found.columns])


_PIV = dims.PIVOT_PERIOD
HALT_STATS_SQL = f"""WITH {STATS}, {MIRROR}, {FRAMED} SELECT a, b, round(avg(a_exports) FILTER (WHERE period < '{_PIV}' AND a_exports > 0), 8) AS mean_before,
  count(*) FILTER (WHERE period > '{_PIV}') AS of_months, count(*) FILTER (WHERE period > '{_PIV}' AND b_imports > 0) AS months,
  round(coalesce(sum(b_imports) FILTER (WHERE period > '{_PIV}' AND b_imports > 0), 0), 4) AS total, round(coalesce(sum(b_imports) FILTER (WHERE period > '{_PIV}' AND b_imports > 0 AND reported), 0), 4) AS total_reported,
  count(*) FILTER (WHERE period > '{_PIV}' AND a_exports IS NULL AND reported) AS absent_reported, count(*) FILTER (WHERE period > '{_PIV}' AND a_exports IS NULL AND NOT reported) AS absent_silent,
  round(avg(a_exports_sea / a_exports) FILTER (WHERE period < '{_PIV}' AND a_exports > 0 AND a_exports_sea > 0), 4) AS mode_share FROM framed GROUP BY 1, 2"""


def _compared_sql(code: str) -> str:
    return f"""lab AS (SELECT m.*, label FROM (SELECT reporter, partner, flow, period, {code} AS code, sum(value) AS value FROM und GROUP BY 1, 2, 3, 4, 5) m JOIN win USING (reporter, period)),
mon AS (SELECT reporter, partner, flow, count(DISTINCT period) FILTER (WHERE label = 'before') AS mb, count(DISTINCT period) FILTER (WHERE label = 'after') AS ma FROM lab GROUP BY 1, 2, 3),
sm AS (SELECT reporter, partner, flow, code, coalesce(sum(value) FILTER (WHERE label = 'before'), 0) AS sb, coalesce(sum(value) FILTER (WHERE label = 'after'), 0) AS sa,
  count(*) FILTER (WHERE label = 'after' AND value > 0) AS months_present, max(value) FILTER (WHERE label = 'after') AS top FROM lab GROUP BY 1, 2, 3, 4),
cmp AS (SELECT *, sb / nullif(mb, 0) AS b, sa / nullif(ma, 0) AS a FROM sm JOIN mon USING (reporter, partner, flow)),
res AS (SELECT reporter, partner, flow, code, coalesce(round(b), 0) AS before, coalesce(round(a), 0) AS after, CASE WHEN coalesce(b, 0) <> 0 THEN round(100 * (a - b) / b, 1) END AS change_pct, months_present,
  coalesce(round(top / nullif(sa, 0), 3), 0) AS top_month_share, ma FROM cmp)"""


def chapter_windows(spark, sf):
    return trade.chapter_windows(stats(spark, sf), windows(spark, sf))


def heading_windows(spark, sf):
    return trade.heading_windows(stats(spark, sf), windows(spark, sf), dims.HEADING_CHAPTERS)


CHAPTER_WINDOWS_SQL = f"WITH {STATS}, {WINDOWS}, {_compared_sql('chapter')} SELECT * EXCLUDE (ma), top_month_share > 0.6 AND months_present <= 3 AS lumpy FROM res"
HEADING_WINDOWS_SQL = f"""WITH {STATS}, {WINDOWS}, {_compared_sql('heading')} SELECT * EXCLUDE (ma, top_month_share), after > 0 AND months_present > 0 AND months_present <= greatest(2, ma // 4) AS lumpy
FROM res WHERE code[1:2] IN ({', '.join(repr(c) for c in dims.HEADING_CHAPTERS)})"""


def excess_growth(spark, sf):
    return trade.excess_growth(stats(spark, sf), windows(spark, sf))


EXCESS_GROWTH_SQL = f"""WITH {STATS}, {WINDOWS}, lab AS (SELECT m.*, label FROM (SELECT reporter, partner, period, sum(value) AS value FROM und WHERE flow = 'X' GROUP BY 1, 2, 3) m JOIN win USING (reporter, period)),
w AS (SELECT reporter, label, period, sum(value) AS value FROM lab GROUP BY 1, 2, 3),
t AS (SELECT reporter, round(avg(value) FILTER (WHERE label = 'before')) AS wb, round(avg(value) FILTER (WHERE label = 'after')) AS wa FROM w GROUP BY 1),
tr AS (SELECT reporter, round(100 * (wa - wb) / nullif(wb, 0), 1) AS trend_pct FROM t),
p AS (SELECT reporter, partner, round(avg(value) FILTER (WHERE label = 'before')) AS before, round(avg(value) FILTER (WHERE label = 'after')) AS after,
  count(*) FILTER (WHERE label = 'before') AS before_months, count(*) FILTER (WHERE label = 'after') AS after_months FROM lab GROUP BY 1, 2),
q AS (SELECT p.*, trend_pct, CASE WHEN after <> 0 THEN round(100 * (after - before) / nullif(before, 0), 1) END AS change_pct FROM p JOIN tr USING (reporter))
SELECT *, after - before AS change_value, round(change_pct - trend_pct, 1) AS excess_pct, round(after - before * (1 + trend_pct / 100)) AS excess_value FROM q"""


def label_lookup(spark, sf):
    by_chapter = stats(spark, sf).groupBy("chapter").agg(F.count(F.lit(1)).alias("n"))
    return trade.label_lookup(by_chapter, dims.table(spark, dims.LABELS, "code string, text string, local string"), "chapter")


LABEL_LOOKUP_SQL = f"""WITH {STATS}, {sql_rows('labels_', 'code, txt, loc', dims.LABELS)}
SELECT chapter, count(*) AS n, coalesce(any_value(trim(split_part(txt, ' - ', 2))), chapter) AS name, coalesce(any_value(loc), any_value(trim(split_part(txt, ' - ', 2))), chapter) AS name_local FROM stats LEFT JOIN labels_ ON code = chapter GROUP BY chapter"""

QUERIES = {
    "undivided": undivided, "period_dim": period_dim, "latest_reported": latest_reported, "mirror_series": mirror_series, "reported_absence": reported_absence,
    "halt_stats": halt_stats, "chapter_windows": chapter_windows, "heading_windows": heading_windows, "excess_growth": excess_growth, "label_lookup": label_lookup,
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES}
