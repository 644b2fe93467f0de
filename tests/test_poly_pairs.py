"""Pairs of points and polygons: all of them, and none kept on disk."""

from beaconry import session
from beaconry.operators import geo

EDGE_ROW = "poly_id long, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double"


def squares(spark, places):
    """One square ring for each (poly_id, ring_id, west, south, side)."""
    rows = []
    for poly, ring, w, s, a in places:
        corners = [(w, s), (w + a, s), (w + a, s + a), (w, s + a)]
        rows += [(poly, ring, i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(corners, corners[1:] + corners[:1]))]
    return spark.createDataFrame(rows, EDGE_ROW)


def pairs_of(table, edges):
    return sorted((r.id, r.poly_id) for r in geo.points_in_poly(table, edges).select("id", "poly_id").collect())


def test_pairs_are_kept_nowhere(spark, monkeypatch):
    kept, cut = [], session.cut_lineage

    def counting(df):
        rows = cut(df)
        kept.append(session.measured_bytes(rows))
        return rows

    monkeypatch.setattr(session, "cut_lineage", counting)
    monkeypatch.setattr(geo, "cut_lineage", counting)
    edges = squares(spark, [(p, 0, 20.0, 36.0, 0.9) for p in range(150)])
    points = [(i, 20.1 + i / 1000, 36.5) for i in range(200)]
    assert pairs_of(spark.createDataFrame(points, "id int, lon double, lat double"), edges) == [(i, p) for i in range(200) for p in range(150)]
    assert sum(kept) < 200 * 150


def test_a_crowded_cell_is_dealt_in_parts_with_every_pair(spark, monkeypatch):
    monkeypatch.setattr(geo, "MOST_POINTS", 7)
    # polygon 1 has a ring inside its other one and a part elsewhere: any ring with an odd number of crossings counts, a pair comes once
    shapes = [(1, 0, 20.0, 36.0, 4.0), (1, 1, 21.0, 37.0, 1.0), (2, 0, 20.4, 36.4, 0.2), (3, 0, 40.0, 10.0, 1.0)]
    points = [(i, 20.0 + i / 40, 36.0 + i / 40) for i in range(120)] + [(200 + i, 20.5, 36.5) for i in range(50)] + [(300, None, 36.5), (301, 20.5, None), (302, 60.0, 60.0)]
    table = spark.createDataFrame(points, "id int, lon double, lat double")

    def holds(x, y, w, s, a):
        return x is not None and y is not None and w <= x < w + a and s <= y < s + a

    want = sorted({(i, p) for i, x, y in points for p, _, w, s, a in shapes if holds(x, y, w, s, a)})
    assert pairs_of(table, squares(spark, shapes)) == want
    assert geo.points_in_poly(table, squares(spark, shapes)).columns == ["id", "lon", "lat", "poly_id"]
