"""Spatial queries: points from ``events`` and ``customer``, polygons from ``supplier``, boxes from ``nation``."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import dims
from beaconry.operators import geo
from beaconry.plans.common import read
from beaconry.plans.warning_plans import DENSITY, density
from beaconry.sources import polygons

# Six corners of every sample polygon, in quarter degrees around its centre.
CORNERS = [(4, 0), (2, 3), (-2, 4), (-4, 1), (-3, -3), (1, -4)]
STEP = 0.25
LIMIT_KM = 120.0


def _lon(key: str) -> str:
    return f"cast(19 as double) + cast({key} * 53 % 2300 as double) / cast(100 as double)"


def _lat(key: str) -> str:
    return f"cast(30 as double) + cast({key} * 37 % 1700 as double) / cast(100 as double)"


def points(spark, sf):
    return read(spark, sf, "events").select("event_id", F.expr(_lon("event_id")).alias("lon"), F.expr(_lat("event_id")).alias("lat"), "event_type", "user_id", "ts")


POINTS = f"points AS (SELECT event_id, {_lon('event_id')} AS lon, {_lat('event_id')} AS lat, event_type, user_id, ts FROM events)"


def geojson(spark, sf):
    """One polygon feature per supplier; every fourth has a second part five degrees to the east."""

    def ring(dx: float, scale: float) -> str:
        corner = [
            f"concat('[', lon + {dx}D + {x}D / 4 * sx * {scale}D, ',', lat + {y}D / 4 * sy * {scale}D, ']')" for x, y in [*CORNERS, CORNERS[0]]
        ]
        return "concat('[', " + ", ',', ".join(corner) + ", ']')"

    base = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("poly_id"),
        F.expr(_lon("s_suppkey")).alias("lon"),
        F.expr(_lat("s_suppkey")).alias("lat"),
        F.expr("cast(1 + s_suppkey % 3 as double)").alias("sx"),
        F.expr("cast(1 + s_suppkey % 2 as double)").alias("sy"),
    )
    both = f"if(poly_id % 4 = 0, concat('[[', {ring(0.0, 1.0)}, '],[', {ring(5.0, 0.5)}, ']]'), concat('[[', {ring(0.0, 1.0)}, ']]'))"
    return base.select("poly_id", F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.expr(both), F.lit("}")).alias("geometry"))


def edges(spark, sf):
    return geo.edges_of(polygons.rings_from_geojson(geojson(spark, sf), "poly_id", "geometry"))


_NEXT = [*CORNERS[1:], CORNERS[0]]
_CORNER_ROWS = ", ".join(f"({i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, (a, b) in enumerate(zip(CORNERS, _NEXT)))
EDGES = f"""shapes AS (SELECT s_suppkey AS poly_id, {_lon('s_suppkey')} AS lon, {_lat('s_suppkey')} AS lat, 1 + s_suppkey % 3 AS sx, 1 + s_suppkey % 2 AS sy FROM supplier),
ring_list AS (SELECT poly_id, 0 AS ring_id, lon, lat, sx, sy, CAST(1 AS DOUBLE) AS scale FROM shapes
  UNION ALL SELECT poly_id, 1, lon + CAST(5 AS DOUBLE), lat, sx, sy, CAST(0.5 AS DOUBLE) FROM shapes WHERE poly_id % 4 = 0),
corner(seq, fx, fy, tx, ty) AS (VALUES {_CORNER_ROWS}),
edges AS (SELECT poly_id, ring_id, seq, lon + CAST(fx AS DOUBLE) / 4 * sx * scale AS x1, lat + CAST(fy AS DOUBLE) / 4 * sy * scale AS y1,
  lon + CAST(tx AS DOUBLE) / 4 * sx * scale AS x2, lat + CAST(ty AS DOUBLE) / 4 * sy * scale AS y2 FROM ring_list, corner)"""


def _inside_sql(points_table: str, key: str) -> str:
    """(key, poly_id) pairs by even-odd parity."""
    return f"""SELECT {key}, poly_id FROM (SELECT p.{key}, e.poly_id, e.ring_id FROM {points_table} p JOIN edges e
      ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < e.x1 + (p.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
      GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) GROUP BY 1, 2"""


def _segment_sql(lon: str, lat: str) -> str:
    """Distance in km from a point to edge ``e``, as a scalar expression over e.x1 … e.y2."""
    kx, ky = f"(111.320::DOUBLE * cos(radians({lat})))", "110.574::DOUBLE"
    ax, ay, dx, dy = f"((e.x1 - {lon}) * {kx})", f"((e.y1 - {lat}) * {ky})", f"((e.x2 - e.x1) * {kx})", f"((e.y2 - e.y1) * {ky})"
    t = f"(CASE WHEN {dx} * {dx} + {dy} * {dy} = 0 THEN 0 ELSE greatest(0, least(1, -({ax} * {dx} + {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy}))) END)"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"


def _great_circle_sql(lon: str, lat: str, lon2: str, lat2: str) -> str:
    return (
        f"(2 * 6371.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians({lat2} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon}) / 2), 2)))))"
    )


# ---------------------------------------------------------------- S8, G6, G5
def edges_query(spark, sf):
    rounded = [F.round(c, 6).alias(c) for c in geo.EDGE]
    return edges(spark, sf).select("poly_id", "ring_id", "seq", *rounded)


EDGES_SQL = f"WITH {EDGES} SELECT poly_id, ring_id, seq, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM edges"


def densify(spark, sf):
    dense = geo.densify(edges(spark, sf), 0.3)
    return dense.select("poly_id", "ring_id", "seq", "k", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


DENSE = """dense AS (SELECT poly_id, ring_id, seq, k, x1 + (x2 - x1) * (k / n) AS lon, y1 + (y2 - y1) * (k / n) AS lat FROM (
  SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM (SELECT *, greatest(1, ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 0.3::DOUBLE)) AS n FROM edges)))"""
DENSIFY_SQL = f"WITH {EDGES}, {DENSE} SELECT poly_id, ring_id, seq, k, round(lon, 6) AS lon, round(lat, 6) AS lat FROM dense"


def poly_area(spark, sf):
    return geo.poly_area(edges(spark, sf), 8000.0).select("poly_id", F.round("km2", 2).alias("km2"), "parts", "dropped")


POLY_AREA_SQL = f"""WITH {EDGES}, a AS (SELECT poly_id, ring_id, abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * 6371.0::DOUBLE * 6371.0::DOUBLE / 2 AS km2 FROM edges GROUP BY 1, 2)
SELECT poly_id, round(sum(km2) FILTER (WHERE km2 >= 8000), 2) AS km2, count(*) FILTER (WHERE km2 >= 8000) AS parts, count(*) FILTER (WHERE km2 < 8000) AS dropped FROM a GROUP BY 1"""


# ---------------------------------------------------------------- G1, F2, G2
def points_in_poly(spark, sf):
    return geo.points_in_poly(points(spark, sf).select("event_id", "lon", "lat"), edges(spark, sf)).select("event_id", "poly_id")


POINTS_IN_POLY_SQL = f"WITH {POINTS}, {EDGES} {_inside_sql('points', 'event_id')}"
RADIUS = geo.fence_radius_km(dims.FENCE_BUFFER_NM, dims.FENCE_MARGINS_KM)


def fence_edges(spark, sf):
    """The fence: every tenth sample polygon."""
    return edges(spark, sf).where("poly_id % 10 = 7")


def fence_contains(spark, sf):
    return geo.in_fence(points(spark, sf).select("event_id", "lon", "lat"), fence_edges(spark, sf), RADIUS).select("event_id", "in_fence")


FENCE = f"""fence_in AS ({_inside_sql('points', 'event_id')}),
fenced AS (SELECT event_id FROM fence_in WHERE poly_id % 10 = 7
  UNION SELECT p.event_id FROM points p JOIN edges e ON e.poly_id % 10 = 7 WHERE {_segment_sql('p.lon', 'p.lat')} <= {RADIUS!r}::DOUBLE)"""
FENCE_CONTAINS_SQL = f"WITH {POINTS}, {EDGES}, {FENCE} SELECT event_id, event_id IN (SELECT event_id FROM fenced) AS in_fence FROM points"


def edge_distance(spark, sf):
    return geo.nearest(points(spark, sf).select("event_id", "lon", "lat"), edges(spark, sf), LIMIT_KM).select("event_id", F.round("km", 4).alias("km"))


EDGE_DISTANCE_SQL = f"""WITH {POINTS}, {EDGES}, d AS (SELECT event_id, min({_segment_sql('p.lon', 'p.lat')}) AS km FROM points p, edges e GROUP BY 1)
SELECT event_id, CASE WHEN km <= {LIMIT_KM} THEN round(km, 4) END AS km FROM d"""


# ---------------------------------------------------------------- J14, G10, J15, J20, G9
def _fields(spark, sf):
    dense = geo.densify(edges(spark, sf), 0.3)
    sets = {"even": dense.where("poly_id % 2 = 0"), "odd": dense.where("poly_id % 2 = 1")}
    return geo.nearest_set(points(spark, sf).select("event_id", "lon", "lat"), sets, LIMIT_KM)


def nearest_set(spark, sf):
    return _fields(spark, sf).select("event_id", F.round("km_even", 4).alias("km_even"), F.round("km_odd", 4).alias("km_odd"), "nearest")


_SETS = f"""{POINTS}, {EDGES}, {DENSE}, all_km AS (SELECT event_id, min({_great_circle_sql('p.lon', 'p.lat', 'q.lon', 'q.lat')}) FILTER (WHERE poly_id % 2 = 0) AS e,
  min({_great_circle_sql('p.lon', 'p.lat', 'q.lon', 'q.lat')}) FILTER (WHERE poly_id % 2 = 1) AS o FROM points p, dense q GROUP BY 1),
fields AS (SELECT event_id, CASE WHEN e <= {LIMIT_KM} THEN e END AS e, CASE WHEN o <= {LIMIT_KM} THEN o END AS o FROM all_km)"""
NEAREST_SET_SQL = f"""WITH {_SETS} SELECT event_id, round(e, 4) AS km_even, round(o, 4) AS km_odd,
  CASE WHEN e IS NULL AND o IS NULL THEN NULL WHEN o IS NULL OR round(e, 6) <= round(o, 6) THEN 'even' ELSE 'odd' END AS nearest FROM fields"""


def limit_zone(spark, sf):
    return geo.limit_zone(_fields(spark, sf), "even", "odd", 40.0).select("event_id")


LIMIT_ZONE_SQL = f"WITH {_SETS} SELECT event_id FROM fields WHERE e <= 40 AND (o IS NULL OR e <= o)"


def nearest_owner(spark, sf):
    """Second parts go to the nearer of two owners: main parts of odd and of even polygons."""
    e = edges(spark, sf)
    parts = e.where("ring_id = 1").select(F.col("poly_id").alias("part_id"), F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    main = e.where("ring_id = 0")
    owned = geo.nearest_owner(parts, {"a": main.where("poly_id % 2 = 1"), "b": main.where("poly_id % 2 = 0")}, 30.0)
    return owned.select("part_id", F.round("km_a", 4).alias("km_a"), F.round("km_b", 4).alias("km_b"), "owner")


NEAREST_OWNER_SQL = f"""WITH {EDGES}, d AS (SELECT p.poly_id AS part_id, min({_segment_sql('p.x1', 'p.y1')}) FILTER (WHERE e.poly_id % 2 = 1) AS a,
  min({_segment_sql('p.x1', 'p.y1')}) FILTER (WHERE e.poly_id % 2 = 0) AS b FROM edges p, edges e WHERE p.ring_id = 1 AND e.ring_id = 0 GROUP BY 1),
l AS (SELECT part_id, CASE WHEN a <= 30 THEN a END AS a, CASE WHEN b <= 30 THEN b END AS b FROM d)
SELECT part_id, round(a, 4) AS km_a, round(b, 4) AS km_b, CASE WHEN a IS NOT NULL AND (b IS NULL OR a < b) THEN 'a' WHEN b IS NOT NULL THEN 'b' END AS owner FROM l"""


def coincident(spark, sf):
    """Customers' points that repeat an event point, off by up to a dozen metres."""
    shifted = read(spark, sf, "customer").select("c_custkey", F.expr(f"{_lon('c_custkey')} + cast(c_custkey % 7 as double) * 0.00002D").alias("lon"), F.expr(_lat("c_custkey")).alias("lat"))
    reference = points(spark, sf).select(F.col("event_id").alias("ref_id"), "lon", "lat")
    met = geo.coincident(shifted, reference, 5.0)
    return met.select("c_custkey", "ref_id", F.round("metres", 3).alias("metres"))


COINCIDENT_SQL = f"""WITH {POINTS}, c AS (SELECT c_custkey, {_lon('c_custkey')} + CAST(c_custkey % 7 AS DOUBLE) * 0.00002::DOUBLE AS lon, {_lat('c_custkey')} AS lat FROM customer),
m AS (SELECT c_custkey, event_id AS ref_id, 1000 * sqrt(pow((p.lon - c.lon) * 111.320::DOUBLE * cos(radians(c.lat)), 2) + pow((p.lat - c.lat) * 110.574::DOUBLE, 2)) AS metres
  FROM c JOIN points p ON p.lat BETWEEN c.lat - 0.01 AND c.lat + 0.01 AND p.lon BETWEEN c.lon - 0.01 AND c.lon + 0.01)
SELECT c_custkey, ref_id, round(metres, 3) AS metres FROM m WHERE metres < 5"""


def boundary_check(spark, sf):
    checks = read(spark, sf, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_mktsegment").alias("label"), F.expr(_lon("c_custkey")).alias("lon"), F.expr(_lat("c_custkey")).alias("lat"))
    report = geo.boundary_check(checks, edges(spark, sf), LIMIT_KM)
    return report.select("label", "measured", "beyond", "worst_point", F.round("worst_km", 3).alias("worst_km"))


BOUNDARY_CHECK_SQL = f"""WITH {EDGES}, p AS (SELECT c_custkey, c_mktsegment AS label, {_lon('c_custkey')} AS lon, {_lat('c_custkey')} AS lat FROM customer),
d AS (SELECT c_custkey, label, min({_segment_sql('p.lon', 'p.lat')}) AS km FROM p, edges e GROUP BY 1, 2), l AS (SELECT c_custkey, label, CASE WHEN km <= {LIMIT_KM} THEN km END AS km FROM d)
SELECT label, count(km) AS measured, count(*) FILTER (WHERE km IS NULL) AS beyond, arg_max(c_custkey, {{'k': round(km, 3), 'c': -c_custkey}}) FILTER (WHERE km IS NOT NULL) AS worst_point, round(max(km), 3) AS worst_km FROM l GROUP BY 1"""


# ---------------------------------------------------------------- J13, A18, G7
def _boxes(spark, sf):
    return read(spark, sf, "nation").select(
        F.col("n_name").alias("box"),
        F.expr("cast(19 + n_nationkey % 5 * 4 as double)").alias("west"),
        F.expr("cast(30 + n_nationkey div 5 * 3 as double)").alias("south"),
        F.expr("cast(23 + n_nationkey % 5 * 4 as double)").alias("east"),
        F.expr("cast(33 + n_nationkey div 5 * 3 as double)").alias("north"),
    )


def area_share(spark, sf):
    return geo.area_share(_boxes(spark, sf), edges(spark, sf), STEP)


_SHARE = f"""{EDGES}, b AS (SELECT n_name AS box, CAST(19 + n_nationkey % 5 * 4 AS DOUBLE) AS west, CAST(30 + n_nationkey // 5 * 3 AS DOUBLE) AS south FROM nation),
cells AS (SELECT box || '/' || i || '/' || j AS cell, box, west + (i + 0.5::DOUBLE) * {STEP} AS lon, south + (j + 0.5::DOUBLE) * {STEP} AS lat, cos(radians(south + (j + 0.5::DOUBLE) * {STEP})) AS weight
  FROM b, (SELECT unnest(range(16)) AS i), (SELECT unnest(range(12)) AS j)),
cell_in AS ({_inside_sql('cells', 'cell')}), whole AS (SELECT box, sum(weight) AS whole FROM cells GROUP BY 1),
shares AS (SELECT box, poly_id, round(sum(weight) / any_value(whole), 4) AS share FROM cell_in JOIN cells USING (cell) JOIN whole USING (box) GROUP BY 1, 2 HAVING sum(weight) / any_value(whole) >= 0.005)"""
AREA_SHARE_SQL = f"WITH {_SHARE} SELECT * FROM shares"


def share_accounting(spark, sf):
    return geo.share_accounting(area_share(spark, sf))


SHARE_ACCOUNTING_SQL = f"""WITH {_SHARE}, t AS (SELECT box, round(sum(share), 4) AS accounted FROM shares GROUP BY 1)
SELECT box, poly_id, share, row_number() OVER (PARTITION BY box ORDER BY share DESC, poly_id) AS rank, accounted FROM shares JOIN t USING (box)"""


def coverage_audit(spark, sf):
    frame = _boxes(spark, sf).where("box <> 'NATION_0'").select(*[F.col(a).alias(b) for a, b in zip(("west", "south", "east", "north"), geo.EDGE)])
    audit = geo.coverage_audit(edges(spark, sf), frame, STEP, 500.0)
    return audit.select("poly_id", *[F.round(c, 1).alias(c) for c in ("km2", "overlap_km2", "outside_km2")], "over_tolerance")


COVERAGE_AUDIT_SQL = f"""WITH {EDGES}, span AS (SELECT CAST(floor(min(least(x1, x2)) / {STEP}) AS BIGINT) AS w, CAST(ceil(max(x2) / {STEP}) AS BIGINT) AS e, CAST(floor(min(y1) / {STEP}) AS BIGINT) AS s, CAST(ceil(max(y1) / {STEP}) AS BIGINT) AS n FROM edges),
cells AS (SELECT i || '/' || j AS cell, (i + 0.5::DOUBLE) * {STEP} AS lon, (j + 0.5::DOUBLE) * {STEP} AS lat FROM (SELECT unnest(range(w, e + 1)) AS i FROM span), (SELECT unnest(range(s, n + 1)) AS j FROM span)),
cell_in AS ({_inside_sql('cells', 'cell')}), load AS (SELECT cell, count(*) AS n FROM cell_in GROUP BY 1),
b AS (SELECT CAST(19 + n_nationkey % 5 * 4 AS DOUBLE) AS west, CAST(30 + n_nationkey // 5 * 3 AS DOUBLE) AS south FROM nation WHERE n_name <> 'NATION_0'),
f AS (SELECT DISTINCT cell FROM cells JOIN b ON lon BETWEEN west AND west + 4 AND lat BETWEEN south AND south + 3),
k AS (SELECT poly_id, cos(radians(lat)) * {STEP} * 110.574::DOUBLE * {STEP} * 111.320::DOUBLE AS km2, n, cell IN (SELECT cell FROM f) AS framed FROM cell_in JOIN cells USING (cell) JOIN load USING (cell))
SELECT poly_id, round(sum(km2), 1) AS km2, round(sum(CASE WHEN n > 1 THEN km2 ELSE 0 END), 1) AS overlap_km2, round(sum(CASE WHEN NOT framed THEN km2 ELSE 0 END), 1) AS outside_km2,
  sum(CASE WHEN n > 1 THEN km2 ELSE 0 END) > 500 AS over_tolerance FROM k GROUP BY 1"""


# ---------------------------------------------------------------- J7, P27, J12, S9
def land_mask(spark, sf):
    return geo.land_mask(density(spark, sf), fence_edges(spark, sf), dims.CELL_DEG)


_G = dims.CELL_DEG
LAND_MASK_SQL = f"""WITH {DENSITY}, {EDGES}, cells AS (SELECT ix || '/' || iy AS cell, (ix + 0.5) * {_G}::DOUBLE AS lon, (iy + 0.5) * {_G}::DOUBLE AS lat FROM grid),
land AS (SELECT DISTINCT cell FROM ({_inside_sql('cells', 'cell')}) WHERE poly_id % 10 = 7)
SELECT *, (SELECT count(*) FROM land) AS dropped_on_land FROM grid WHERE ix || '/' || iy NOT IN (SELECT cell FROM land)"""


def geo_generalize(spark, sf):
    return geo.geo_generalize(points(spark, sf), "user_id", 1)


GEO_GENERALIZE_SQL = f"""WITH {POINTS}, r AS (SELECT user_id, round(lon, 1) AS lon, round(lat, 1) AS lat FROM points)
SELECT user_id, (min({{'lon': lon, 'lat': lat}})).lon AS lon, (min({{'lon': lon, 'lat': lat}})).lat AS lat FROM r GROUP BY 1"""


def nearby(spark, sf):
    records = points(spark, sf).select(F.col("event_id").alias("id"), "lon", "lat", F.col("ts").alias("at"))
    return geo.nearby(records)


NEARBY_SQL = f"""WITH {POINTS}, d AS (SELECT p.event_id AS id, q.event_id AS other, q.ts, round({_great_circle_sql('p.lon', 'p.lat', 'q.lon', 'q.lat')}, 3) AS km
  FROM points p JOIN points q ON p.event_id <> q.event_id AND q.lat BETWEEN p.lat - 0.6 AND p.lat + 0.6 AND q.lon BETWEEN p.lon - 1.2 AND p.lon + 1.2)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY km, ts DESC, other) AS rank, other, km FROM d WHERE km <= 60 QUALIFY rank <= 8"""


def arcs_decode(spark, sf):
    """Arcs per user: deltas from ``value`` in event order, quantized like a topology file."""
    arcs = read(spark, sf, "events").select(
        F.col("user_id").alias("arc"), F.col("event_id").alias("seq"), F.expr("event_id % 7 - 3").alias("dx"), F.expr("event_id % 5 - 2").alias("dy")
    )
    decoded = polygons.decode_arcs(arcs, (0.01, 0.02), (19.0, 30.0))
    return decoded.select("arc", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "from_end")


ARCS_DECODE_SQL = """WITH w AS (SELECT user_id AS arc, event_id AS seq, sum(event_id % 7 - 3) OVER o AS x, sum(event_id % 5 - 2) OVER o AS y, count(*) OVER (PARTITION BY user_id) - row_number() OVER o AS from_end
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT arc, seq, round(x * 0.01::DOUBLE + 19, 6) AS lon, round(y * 0.02::DOUBLE + 30, 6) AS lat, from_end FROM w"""

QUERIES = {
    "edges": edges_query, "densify": densify, "poly_area": poly_area, "points_in_poly": points_in_poly, "fence_contains": fence_contains,
    "edge_distance": edge_distance, "nearest_set": nearest_set, "limit_zone": limit_zone, "nearest_owner": nearest_owner,
    "coincident": coincident, "boundary_check": boundary_check, "area_share": area_share, "share_accounting": share_accounting,
    "coverage_audit": coverage_audit, "land_mask": land_mask, "geo_generalize": geo_generalize, "nearby": nearby, "arcs_decode": arcs_decode,
}
ORACLES = {
    "edges": EDGES_SQL, "densify": DENSIFY_SQL, "poly_area": POLY_AREA_SQL, "points_in_poly": POINTS_IN_POLY_SQL, "fence_contains": FENCE_CONTAINS_SQL,
    "edge_distance": EDGE_DISTANCE_SQL, "nearest_set": NEAREST_SET_SQL, "limit_zone": LIMIT_ZONE_SQL, "nearest_owner": NEAREST_OWNER_SQL,
    "coincident": COINCIDENT_SQL, "boundary_check": BOUNDARY_CHECK_SQL, "area_share": AREA_SHARE_SQL, "share_accounting": SHARE_ACCOUNTING_SQL,
    "coverage_audit": COVERAGE_AUDIT_SQL, "land_mask": LAND_MASK_SQL, "geo_generalize": GEO_GENERALIZE_SQL, "nearby": NEARBY_SQL, "arcs_decode": ARCS_DECODE_SQL,
}
