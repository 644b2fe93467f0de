"""Polygon sources: fence and GeoJSON documents, and delta-encoded arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.operators.scan import running_sums

_RING = "array<array<double>>"
_ARC_BUCKET = 100_000


def _point(p):
    return F.struct(p[0].alias("lon"), p[1].alias("lat"))


def rings_from_geojson(features: DataFrame, key: str, geometry: str) -> DataFrame:
    """Polygon and MultiPolygon geometries (JSON text) to one row per outer ring."""
    g = F.col(geometry)
    multi = F.from_json(g, f"coordinates array<array<{_RING}>>")["coordinates"]
    single = F.from_json(g, f"coordinates array<{_RING}>")["coordinates"]
    is_multi = F.get_json_object(g, "$.type") == "MultiPolygon"
    outer = F.when(is_multi, F.transform(multi, lambda poly: poly[0])).otherwise(F.slice(single, 1, 1))
    rings = features.select(F.col(key).alias("poly_id"), F.posexplode(outer).alias("ring_id", "ring"))
    return rings.select("poly_id", "ring_id", F.transform("ring", _point).alias("points"))


def read_fence(spark: SparkSession, path: str) -> DataFrame:
    """Fence documents: ``polygons`` with a ``ring`` of [lon, lat] each."""
    doc = spark.read.schema(f"polygons array<struct<ring:{_RING}>>").option("multiLine", True).json(path)
    rings = doc.select(F.posexplode("polygons").alias("poly_id", "p"))
    return rings.select("poly_id", F.lit(0).alias("ring_id"), F.transform("p.ring", _point).alias("points"))


def decode_arcs(arcs: DataFrame, scale: tuple[float, float], translate: tuple[float, float]) -> DataFrame:
    """Quantized deltas (arc, seq, dx, dy) to coordinates, with the position counted from the arc's end.

    A ring that uses an arc backwards orders its points by ``from_end`` instead of ``seq``. Sums run
    in buckets of consecutive points, so one long arc is not one task.
    """
    sums = {"_x": F.col("dx"), "_y": F.col("dy"), "_n": F.lit(1)}
    summed = running_sums(arcs, ["arc"], ["seq"], F.floor(F.col("seq") / _ARC_BUCKET), sums)
    length = arcs.groupBy("arc").agg(F.count(F.lit(1)).alias("_len"))
    return summed.join(length, "arc").select(
        "arc", "seq",
        (F.col("_x") * scale[0] + translate[0]).alias("lon"), (F.col("_y") * scale[1] + translate[1]).alias("lat"),
        (F.col("_len") - F.col("_n")).alias("from_end"),
    )
