"""The warning archive is read in small, even tasks, by methods that Java compiles, once per query."""

import re

from pyspark.sql import functions as F

from beaconry import dims
from beaconry.operators import geo
from beaconry.operators import warnings_archive as wa
from beaconry.plans import warning_plans as wp

SF = "/root/testdata/sf0.001"
#: HotSpot leaves longer methods to its interpreter.
HOTSPOT_LIMIT = 8000


def test_message_text_is_built_by_a_method_that_is_compiled(spark, capsys, tmp_path):
    """F27"""
    spark.read.parquet(f"{SF}/events.parquet").repartition(64).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wp.archive(spark, str(tmp_path)).select(F.length("text")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < HOTSPOT_LIMIT


def test_parts_of_a_serial_are_read_as_in_the_whole_text(spark):
    """the narrowed patterns find what the plain ones find."""
    texts = [
        "LIME ROCK RADIO NAVWARN 002/14 X", "x1ABC navwarn 12/24", ".AB.C navArea 1 / 24", "A B C D E F G SARWARN 7/23. NAVWARN 8/23", "NAVWARN NAVWARN 1/22",
        "NAVWARN 12/24", "ABC NAVWARN 12", "ÇİÖ ſARWARN 1/22", "no kind 12/24", "\U00010400B METAREA 3/21", "9WARNING 1/20 A WARNING 22/21", "", None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    plain = rows.select("v", *[F.regexp_extract("v", wa.SERIAL, i).alias(f"p{i}") for i in range(4)])
    both = plain.withColumn("s", wa.serial_of(F.col("v"))).select("*", *[F.regexp_extract("s", wa._SERIAL, i).alias(f"q{i}") for i in range(1, 4)])
    for r in both.collect():
        assert (r.s, r.q1, r.q2, r.q3) == (r.p0, r.p1, r.p2, r.p3), r.v


def test_archive_is_dealt_by_rows(spark, monkeypatch):
    """one file of one row group, in tasks of bounded size."""
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    monkeypatch.setattr(wp, "MESSAGES_OF_A_TASK", 20)
    sizes = wp.archive(spark, SF).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in sizes) == rows and max(r["count"] for r in sizes) <= 24


def test_land_mask_reads_its_cells_once(spark):
    """F32"""
    seen = spark.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    cells = spark.range(40, numPartitions=2).select(F.udf(look, "long")("id").alias("ix"), F.lit(0).cast("long").alias("iy"))
    land = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 2.0, 0.0), (1, 0, 1, 2.0, 0.0, 2.0, 1.0), (1, 0, 2, 2.0, 1.0, 0.0, 1.0), (1, 0, 3, 0.0, 1.0, 0.0, 0.0)], "poly_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    left = geo.land_mask(cells, land, 0.25).collect()
    assert sorted(r.ix for r in left) == list(range(8, 40)) and {r.dropped_on_land for r in left} == {8}
    assert seen.value == 40


def test_density_counts_equal_areas_before_they_spread(spark):
    """F32: what spreads over cells is a row per area, not per warning."""
    area = [{"lat": 36.0, "lon": 28.0}, {"lat": 37.0, "lon": 29.0}]
    rows = [(2018, "drill" if i % 2 else None, area) for i in range(10)]
    marked = spark.createDataFrame([(*r, True, False, False) for r in rows], "year int, activity string, positions array<struct<lat: double, lon: double>>, in_region boolean, excluded boolean, cancellation boolean")
    grid = wa.warn_density(marked, dims.GROUPS, dims.DENSITY_YEARS, dims.CELL_DEG, dims.MAX_SPAN_DEG2)
    assert {(r.military, r.survey, r.other) for r in grid.collect()} == {(5, 0, 5)} and grid.count() == 25
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.rindex("Aggregate") > plan.rindex("Generate")
