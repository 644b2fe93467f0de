"""Point, edge and polygon jobs on plain coordinate columns.

Polygons are edge tables ``(poly_id, ring_id, seq, x1, y1, x2, y2)``. Edges are put into grid cells
ahead of the join, one array per cell, so a point meets only the edges of its cell through an equal
key: no nested loop, and no shuffle of the points while the edge cells are small enough to broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beaconry.functions import geometry as g
from beaconry.operators.scan import number_rows
from beaconry.session import cut_lineage, measured_side, small_side, spread

EDGE = ["x1", "y1", "x2", "y2"]
ID = ["poly_id", "ring_id"]
#: Cell numbers from here downwards belong to no cell.
NOWHERE = -(1 << 40)
#: Cells an edge may take on average at a finer level than the caller's.
MOST_CELLS = 200
#: Points of a cell that meet its polygons in one task.
MOST_POINTS = 1 << 20


def edges_of(rings: DataFrame, points: str = "points") -> DataFrame:
    """Rings (poly_id, ring_id, points array of (lon, lat)) to closed edges; a repeated last point is dropped."""
    p = F.col(points)
    closed = (F.size(p) > 1) & (F.element_at(p, 1) == F.element_at(p, -1))
    open_ring = F.when(closed, F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    rings = rings.withColumn("_open", open_ring)
    shifted = F.concat(F.slice("_open", F.lit(2), F.size("_open")), F.slice("_open", 1, 1))
    pairs = F.transform("_open", lambda a, i: F.struct(a.alias("a"), F.element_at(shifted, i + 1).alias("b")))
    flat = rings.where(F.size("_open") >= 3).select(*ID, F.posexplode(pairs).alias("seq", "e"))
    return flat.select(*ID, "seq", F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))


def _range(low: Column, high: Column, cell: float, margin=0) -> Column:
    return F.explode(F.sequence(F.floor(low / cell) - margin, F.floor(high / cell) + margin))


def _pack(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.groupBy("_ix", "_iy").agg(F.collect_list(F.struct(*fields)).alias("_edges"))


def ring_rows(edges: DataFrame, cell: float) -> DataFrame:
    """Edges with every cell (``_ix``, ``_iy``) that the box of their ring covers and from which an eastward ray may cross them."""
    box = edges.groupBy(*ID).agg(F.min(F.least("x1", "x2")).alias("_w"), F.max(F.greatest("x1", "x2")).alias("_e"))
    rows = edges.join(small_side(box), ID).withColumn("_iy", _range(F.least("y1", "y2"), F.greatest("y1", "y2"), cell))
    return rows.withColumn("_ix", _range(F.col("_w"), F.col("_e"), cell))


def ring_cells(edges: DataFrame, cell: float) -> DataFrame:
    """Cell -> rings whose box covers it, each with the edges an eastward ray from the cell may cross."""
    rings = ring_rows(edges, cell).groupBy("_ix", "_iy", *ID).agg(F.collect_list(F.struct(*EDGE)).alias("edges"))
    return _pack(rings, ["poly_id", "edges"])


def near_rows(edges: DataFrame, cell: float) -> DataFrame:
    """Edges with every cell (``_ix``, ``_iy``) that has a point within one cell height of them, in kilometres at any latitude."""
    rows = edges.withColumn("_iy", _range(F.least("y1", "y2"), F.greatest("y1", "y2"), cell, 1))
    columns = _columns_around(F.least("x1", "x2"), F.greatest("x1", "x2"), F.greatest(F.abs("y1"), F.abs("y2")), cell)
    return rows.withColumn("_ix", F.explode(columns))


def near_cells(edges: DataFrame, cell: float, fields: list[str] | None = None) -> DataFrame:
    """Cell -> edges within one cell height of any of its points."""
    return _pack(near_rows(edges, cell), fields or EDGE)


def _column(lon: Column, cell: float) -> Column:
    """Number of the cell column on a globe without an edge at 180 degrees."""
    return F.pmod(F.floor(lon / cell), F.lit(math.ceil(360 / cell)))


def _columns_around(west: Column, east: Column, lat: Column, cell: float) -> Column:
    """Columns within one cell height of a stretch, in kilometres; near a pole all of them.

    One column more on either side covers the last one, which is narrower when the cell does not divide the circle.
    """
    n = math.ceil(360 / cell)
    top = lat + 2 * cell
    wide = F.ceil(F.lit(1.0) / F.cos(F.radians(F.least(F.lit(89.0), top)))) + 1
    first, last = F.floor(west / cell) - wide, F.floor(east / cell) + wide
    some = F.array_distinct(F.transform(F.sequence(first, last), lambda i: F.pmod(i, F.lit(n))))
    return F.when((top >= 89) | (last - first >= n), F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).otherwise(some)


def _row_hash(points: DataFrame) -> Column:
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in points.schema if "map<" not in f.dataType.simpleString()))


def _nowhere(points: DataFrame) -> Column:
    """A number no cell has, one of many by row."""
    return F.lit(NOWHERE) - F.pmod(_row_hash(points), F.lit(1 << 16))


def at_places(points: DataFrame, look: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Points with the columns that ``look`` finds for their position, NULL where it finds none or they have none.

    ``look`` gets the distinct positions (lon, lat) and returns those it has something for, so its work grows with the places
    and not with the points.
    """
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    places = cut_lineage(points.where(placed).select("lon", "lat").distinct())
    found = look(places).withColumnsRenamed({"lon": "_px", "lat": "_py"})
    keyed = points.withColumn("_px", F.when(placed, F.col("lon")).otherwise(_nowhere(points).cast("double"))).withColumn("_py", F.coalesce("lat", F.lit(0.0)))
    return keyed.join(measured_side(found), ["_px", "_py"], "left").drop("_px", "_py")


def attach(points: DataFrame, cells: DataFrame, cell: float, wanted: Column | None = None, around: bool = False) -> DataFrame:
    """Points with the ``_edges`` of their cell; only rows where ``wanted`` holds look anything up.

    Rows that look nothing up, and rows without a position, get keys no cell has, many different ones: they meet nothing and
    crowd no task. ``around`` goes with ``near_cells``, whose columns go round the globe.
    """

    nowhere = _nowhere(points)

    def key(value: Column) -> Column:
        return F.coalesce(value if wanted is None else F.when(wanted, value), nowhere)

    column = _column(F.col("lon"), cell) if around else F.floor(F.col("lon") / cell)
    keyed = points.withColumn("_ix", key(column)).withColumn("_iy", key(F.floor(F.col("lat") / cell)))
    return keyed.join(small_side(cells), ["_ix", "_iy"], "left").drop("_ix", "_iy")


def _odd(edges: Column) -> Column:
    return F.size(F.filter(edges, lambda e: g.crosses(F.col("lon"), F.col("lat"), e))) % 2 == 1


def _inside(rings: Column) -> Column:
    """Polygons among the cell's rings that hold the point: an odd number of crossings of any ring."""
    return F.array_distinct(F.transform(F.filter(rings, lambda r: _odd(r["edges"])), lambda r: r["poly_id"]))


def polygons_at(points: DataFrame, edges: DataFrame, cell: float = 1.0) -> DataFrame:
    """Every point with ``polygons``: the ids of the polygons that contain it (empty array outside)."""
    found = attach(points, ring_cells(edges, cell), cell)
    return found.withColumn("polygons", F.coalesce(_inside(F.col("_edges")), F.array())).drop("_edges")


def points_in_poly(points: DataFrame, edges: DataFrame, cell: float = 1.0) -> DataFrame:
    """(point, poly_id) pairs; the polygons of a position are searched once.

    Pairs grow with both tables, so they leave the task that finds them and are kept nowhere: a position brings its points along and
    meets the polygons of its cell one by one. A crowded cell is dealt in parts of about ``MOST_POINTS`` points, each with its polygons.
    """
    cells, key = ["_ix", "_iy"], ["_ix", "_iy", "_part"]
    placed = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    placed = placed.withColumns({"_ix": F.floor(F.col("lon") / cell), "_iy": F.floor(F.col("lat") / cell)})
    parts = placed.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / MOST_POINTS).alias("_parts"))
    crowded = F.broadcast(cut_lineage(parts.where("_parts > 1")))  # at most a row for every MOST_POINTS points
    n = F.coalesce("_parts", F.lit(1).cast("bigint"))
    dealt = placed.join(crowded, cells, "left").withColumn("_part", F.pmod(_row_hash(points), n)).repartition(*key)
    places = dealt.groupBy(*key, "lon", "lat").agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in points.columns))).alias("_points"))
    rows = ring_rows(edges, cell).join(crowded, cells, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    rings = rows.repartition(*key).groupBy(*key, *ID).agg(F.collect_list(F.struct(*EDGE)).alias("_edges"))
    shapes = rings.groupBy(*key, "poly_id").agg(F.collect_list("_edges").alias("_rings"))
    met = places.join(shapes.hint("merge"), key).where(F.exists("_rings", _odd))
    return met.select("poly_id", F.explode("_points").alias("_point")).select("_point.*", "poly_id")


def fence_radius_km(buffer_nm: float, margins_km: float) -> float:
    return (buffer_nm * g.KM_PER_NM + margins_km) * (1.0 + g.APPROX_MARGIN)


def in_fence(points: DataFrame, edges: DataFrame, radius_km: float, cell: float = 1.0, column: str = "in_fence") -> DataFrame:
    """True inside any polygon or within ``radius_km`` of an edge. Points without a position get NULL."""

    def look(places: DataFrame) -> DataFrame:
        held = polygons_at(places, edges, cell)
        reach = max(radius_km / g.KM_PER_DEG_LAT, cell / 8)
        close = attach(held, near_cells(edges.select(*EDGE).distinct(), reach), reach, around=True)
        near = F.exists("_edges", lambda e: g.segment_km(F.col("lon"), F.col("lat"), e) <= radius_km)
        return close.select("lon", "lat", ((F.size("polygons") > 0) | F.coalesce(near, F.lit(False))).alias(column))

    return at_places(points, look)


Distance = Callable[[Column, Column, Column], Column]


def nearest(
    points: DataFrame, edges: DataFrame, limit_km: float, column: str = "km", distance: Distance = g.segment_km, cell: float = 0.25
) -> DataFrame:
    """Distance to the nearest edge up to ``limit_km``, NULL beyond; the distance of a position is searched once."""
    return at_places(points, lambda places: nearest_to_places(places, edges, limit_km, column, distance, cell))


def _first_level(edges: DataFrame, cell: float) -> float:
    """``cell`` or a 4th or a 16th of it: the finest at which edges do not take many cells."""
    wide, high = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    finer = [cell / 16, cell / 4]
    taken = edges.agg(*[F.avg((wide / c + 7) * (high / c + 3)) for c in finer]).first()
    return next((c for c, n in zip(finer, taken) if n is not None and n <= MOST_CELLS), cell)


def nearest_to_places(places: DataFrame, edges: DataFrame, limit_km: float, column: str, distance: Distance, cell: float = 0.25) -> DataFrame:
    """(lon, lat, ``column``) of the places that have an edge within ``limit_km``.

    Levels of growing cells: a place settles at the first level whose guaranteed reach covers the
    distance found there; later levels look only for the places still open.
    """
    edges = spread(cut_lineage(edges.select(*EDGE).distinct()))
    cell, open_, done = _first_level(edges, cell), places, None
    while True:
        reach = cell * g.KM_PER_DEG_LAT
        keyed = open_.withColumn("_ix", _column(F.col("lon"), cell)).withColumn("_iy", F.floor(F.col("lat") / cell))
        met = near_rows(edges, cell).join(measured_side(keyed), ["_ix", "_iy"])
        # the least one is compared, so that no filter computes every distance a second time
        best = met.groupBy("lon", "lat").agg(F.min(distance(F.col("lon"), F.col("lat"), F.struct(*EDGE))).alias(column))
        settled = cut_lineage(best.where(F.col(column) <= min(reach, limit_km)))
        done = settled if done is None else done.unionByName(settled)
        if reach >= limit_km:
            return done
        open_ = cut_lineage(open_.join(settled, ["lon", "lat"], "left_anti"))
        if open_.isEmpty():
            return done
        cell = min(4 * cell, 1.001 * limit_km / g.KM_PER_DEG_LAT)


def as_edges(points: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Points as edges of no length, so that point sets and boundaries share one search."""
    return points.select(*(keep or []), F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))


def to_point_km(lon: Column, lat: Column, edge: Column) -> Column:
    return g.great_circle_km(lon, lat, edge["x1"], edge["y1"])


def densify(edges: DataFrame, step: float) -> DataFrame:
    """Points along every edge at most ``step`` apart (start included, end left to the next edge)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / step))
    steps = edges.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    share = F.col("k") / F.col("_n")
    return steps.select(*ID, "seq", "k", (F.col("x1") + dx * share).alias("lon"), (F.col("y1") + dy * share).alias("lat"))


def nearest_set(nodes: DataFrame, sets: dict[str, DataFrame], limit_km: float) -> DataFrame:
    """Distance of every node to each labelled point set and the label of the nearer one, within the limit."""

    def look(places: DataFrame) -> DataFrame:
        found = places
        for label, members in sets.items():
            found = found.join(nearest_to_places(places, as_edges(members), limit_km, f"km_{label}", to_point_km), ["lon", "lat"], "left")
        return found

    out = at_places(nodes, look)
    ranked = F.array_compact(F.array(*[F.when(F.col(f"km_{s}").isNotNull(), F.struct(F.round(f"km_{s}", 6).alias("km"), F.lit(s).alias("label"))) for s in sets]))
    return out.withColumn("nearest", F.array_min(ranked)["label"])


def limit_zone(fields: DataFrame, own: str, other: str, limit_km: float) -> DataFrame:
    """Nodes within the limit of ``own`` and not farther from it than from ``other`` (median cut)."""
    d1, d2 = F.col(f"km_{own}"), F.col(f"km_{other}")
    return fields.where(d1.isNotNull() & (d1 <= limit_km) & (d2.isNull() | (d1 <= d2)))


def nearest_owner(parts: DataFrame, owners: dict[str, DataFrame], limit_km: float) -> DataFrame:
    """Part vertices to the nearer of two owners within the limit; one row per part, NULL when none is near."""
    out = parts
    for owner, edges in owners.items():
        out = nearest(out, edges, limit_km, f"km_{owner}")
    first, second = owners
    per_part = out.groupBy("part_id").agg(*[F.min(f"km_{o}").alias(f"km_{o}") for o in owners])
    a, b = F.col(f"km_{first}"), F.col(f"km_{second}")
    owner = F.when(a.isNotNull() & (b.isNull() | (a < b)), first).when(b.isNotNull(), second)
    return per_part.withColumn("owner", owner)


def coincident(points: DataFrame, reference: DataFrame, metres: float) -> DataFrame:
    """Points within a few metres of reference points: (point, ref_id, metres).

    Positions meet through fine cells, each once; what lies at them is joined to the positions that met.
    """
    cell = 0.01
    refs = near_rows(as_edges(reference.select("lon", "lat").distinct()), cell).select("_ix", "_iy", F.col("x1").alias("_rx"), F.col("y1").alias("_ry"))
    places = points.select("lon", "lat").distinct().withColumn("_ix", _column(F.col("lon"), cell)).withColumn("_iy", F.floor(F.col("lat") / cell))
    distance = g.point_km(F.col("lon"), F.col("lat"), F.col("_rx"), F.col("_ry")) * 1000
    close = cut_lineage(places.join(refs, ["_ix", "_iy"]).withColumn("metres", distance).where(F.col("metres") < metres).drop("_ix", "_iy"))
    named = reference.select("ref_id", F.col("lon").alias("_rx"), F.col("lat").alias("_ry"))
    return points.join(close, ["lon", "lat"]).join(named, ["_rx", "_ry"]).drop("_rx", "_ry")


def ring_areas(edges: DataFrame) -> DataFrame:
    """Area of every ring on the sphere in square kilometres."""
    strip = F.radians(F.col("x2") - F.col("x1")) * (2 + F.sin(F.radians("y1")) + F.sin(F.radians("y2")))
    return edges.groupBy(*ID).agg((F.abs(F.sum(strip)) * (g.EARTH_RADIUS_KM**2) / 2).alias("km2"))


def poly_area(edges: DataFrame, min_km2: float = 0.0) -> DataFrame:
    """Polygon totals over the parts that are large enough, and how many parts were left out."""
    large = F.col("km2") >= min_km2
    return ring_areas(edges).groupBy("poly_id").agg(
        F.sum(F.when(large, F.col("km2"))).alias("km2"), F.count_if(large).alias("parts"), F.count_if(~large).alias("dropped")
    )


def raster(boxes: DataFrame, step: float) -> DataFrame:
    """Boxes (west, south, east, north) as cell centres with their area weight cos(latitude)."""
    nx = F.greatest(F.lit(1), F.round((F.col("east") - F.col("west")) / step).cast("int"))
    ny = F.greatest(F.lit(1), F.round((F.col("north") - F.col("south")) / step).cast("int"))
    cols = boxes.withColumn("_i", F.explode(F.sequence(F.lit(0), nx - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), ny - 1)))
    placed = cols.withColumn("lon", F.col("west") + (F.col("_i") + 0.5) * step).withColumn("lat", F.col("south") + (F.col("_j") + 0.5) * step)
    return placed.withColumn("weight", F.cos(F.radians("lat"))).drop("_i", "_j")


def area_share(boxes: DataFrame, edges: DataFrame, step: float, least: float = 0.005) -> DataFrame:
    """Share of every box in every polygon on a raster; slivers below ``least`` are dropped."""
    cells = raster(boxes, step)
    whole = cells.groupBy("box").agg(F.sum("weight").alias("whole"))
    covered = points_in_poly(cells, edges).groupBy("box", "poly_id").agg(F.sum("weight").alias("part"))
    share = covered.join(small_side(whole), "box").withColumn("share", F.col("part") / F.col("whole"))
    return share.where(F.col("share") >= least).select("box", "poly_id", F.round("share", 4).alias("share"))


def share_accounting(shares: DataFrame) -> DataFrame:
    """Shares of every box ranked from the largest, with how much of the box is accounted for."""
    total = shares.groupBy("box").agg(F.round(F.sum("share"), 4).alias("accounted"))
    ranked = number_rows(shares, [F.col("share").desc(), F.col("poly_id")], ["box"], "rank")
    return ranked.join(small_side(total), "box")


def poly_boxes(edges: DataFrame, step: float) -> DataFrame:
    """Bounding boxes on the raster grid."""
    low, high = (lambda c: F.floor(F.min(c) / step) * step), (lambda c: F.ceil(F.max(c) / step) * step)
    return edges.groupBy("poly_id").agg(
        low(F.least("x1", "x2")).alias("west"), low(F.least("y1", "y2")).alias("south"),
        high(F.greatest("x1", "x2")).alias("east"), high(F.greatest("y1", "y2")).alias("north"),
    )


def coverage_audit(edges: DataFrame, frame: DataFrame, step: float, tolerance_km2: float) -> DataFrame:
    """Per polygon: raster area, area shared with any other polygon, area outside the frame boxes.

    Overlap is counted per cell (covered twice or not), so crowded cells cost no pairs.
    """
    km2 = F.lit((step * g.KM_PER_DEG_LAT) * (step * g.KM_PER_DEG_LON))
    centres = raster(poly_boxes(edges, step), step).select("lon", "lat", "weight", F.round(F.col("lon") / step - 0.5).alias("cx"), F.round(F.col("lat") / step - 0.5).alias("cy"))
    cells = centres.groupBy("cx", "cy").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.first("weight").alias("weight"))
    framed = attach(polygons_at(cells, edges), near_cells(frame, 8.0, ["x1", "y1", "x2", "y2"]), 8.0, around=True)
    inside = F.exists("_edges", lambda b: F.col("lon").between(b["x1"], b["x2"]) & F.col("lat").between(b["y1"], b["y2"]))
    flat = framed.select("weight", F.size("polygons").alias("n"), F.coalesce(inside, F.lit(False)).alias("framed"), F.explode("polygons").alias("poly_id"))
    summed = flat.groupBy("poly_id").agg(
        (F.sum("weight") * km2).alias("km2"),
        (F.sum(F.when(F.col("n") > 1, F.col("weight")).otherwise(0.0)) * km2).alias("overlap_km2"),
        (F.sum(F.when(~F.col("framed"), F.col("weight")).otherwise(0.0)) * km2).alias("outside_km2"),
    )
    return summed.withColumn("over_tolerance", F.col("overlap_km2") > tolerance_km2)


def boundary_check(points: DataFrame, edges: DataFrame, limit_km: float) -> DataFrame:
    """Per label: check points measured, points beyond the limit, and the worst measured point."""
    measured = nearest(points, edges, limit_km)
    return measured.groupBy("label").agg(
        F.count("km").alias("measured"),
        F.count_if(F.col("km").isNull()).alias("beyond"),
        F.max_by("point_id", F.struct(F.round("km", 3), -F.col("point_id"))).alias("worst_point"),
        F.max("km").alias("worst_km"),
    )


def land_mask(cells: DataFrame, land: DataFrame, cell: float) -> DataFrame:
    """Cells whose centre is at sea, with the number of cells dropped on land.

    The marked cells are read twice, for the number and for the rest, so they are kept: all behind them runs once.
    """
    centred = cells.withColumn("lon", (F.col("ix") + 0.5) * cell).withColumn("lat", (F.col("iy") + 0.5) * cell)
    marked = cut_lineage(polygons_at(centred, land).withColumn("on_land", F.size("polygons") > 0).drop("lon", "lat", "polygons"))
    dropped = marked.agg(F.count_if("on_land").alias("dropped_on_land"))
    return marked.where(~F.col("on_land")).drop("on_land").join(F.broadcast(dropped))  # one-row side


def geo_generalize(places: DataFrame, entity: str, digits: int) -> DataFrame:
    """One generalized point per entity: rounded, the lowest (lon, lat) when there are several."""
    point = F.min(F.struct(F.round("lon", digits).alias("lon"), F.round("lat", digits).alias("lat"))).alias("p")
    return places.groupBy(entity).agg(point).select(entity, "p.lon", "p.lat")


def nearby(records: DataFrame, limit_km: float = 60.0, top: int = 8, finest: float = 0.03) -> DataFrame:
    """For every record (id, lon, lat, at): other records within ``limit_km``, nearest first at metre
    resolution, newest first on ties, at most ``top``.

    Records collapse to locations that carry their ``top + 1`` newest records. Locations are served by
    cells from fine to coarse: one leaves as soon as it has enough neighbours within the reach of a
    level, so a crowded place is settled in tiny cells and never meets its whole neighbourhood.
    """
    need = top + 1
    newest = W.partitionBy("lon", "lat").orderBy(F.col("at").desc(), F.col("id"))
    short = records.select("id", "lon", "lat", "at").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= need)
    places = cut_lineage(
        short.groupBy("lon", "lat").agg(F.collect_list(F.struct("at", "id")).alias("members"))  # at most ``need`` members
    )
    levels = [limit_km / g.KM_PER_DEG_LAT * 1.01]
    while levels[-1] > finest:
        levels.append(levels[-1] / 4)
    open_, done = places.select("lon", "lat"), None
    for cell in reversed(levels):
        last = cell == levels[0]
        reach = limit_km if last else cell * g.KM_PER_DEG_LAT
        columns = _columns_around(F.col("lon"), F.col("lon"), F.abs("lat"), cell)
        asking = open_.withColumn("_ix", F.explode(columns)).withColumn("_iy", _range(F.col("lat"), F.col("lat"), cell, 1))
        offers = places.select(F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "members", _column(F.col("lon"), cell).alias("_ix"), F.floor(F.col("lat") / cell).alias("_iy"))
        km = F.round(g.great_circle_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 3)
        met = asking.join(offers, ["_ix", "_iy"]).withColumn("km", km).where(F.col("km") <= reach)
        flat = met.select("lon", "lat", "km", F.explode("members").alias("m")).select("lon", "lat", "km", "m.at", "m.id")
        rank = W.partitionBy("lon", "lat").orderBy("km", F.col("at").desc(), "id")
        best = flat.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= need)
        served = best.groupBy("lon", "lat").agg(F.array_sort(F.collect_list(F.struct("_r", "id", "km"))).alias("near"))
        settled = cut_lineage(served if last else served.where(F.size("near") >= need))
        done = settled if done is None else done.unionByName(settled)
        if not last:
            open_ = open_.join(settled, ["lon", "lat"], "left_anti")
    own = F.filter("near", lambda n: n["id"] != F.col("id"))
    listed = records.select("id", "lon", "lat").join(done, ["lon", "lat"]).select("id", F.posexplode(F.slice(own, 1, top)).alias("rank", "n"))
    return listed.select("id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("other"), F.col("n.km").alias("km"))
