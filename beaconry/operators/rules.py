"""Row rules: the position safety filter and the validation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.operators.geo import in_fence
from beaconry.session import small_side

# The seven formats that carry an allocation code, and the code range.
CODE_FORMATS = (("[2-7]", 1), ("00", 3), ("0", 2), ("111", 4), ("8", 2), ("98", 3), ("99", 3))
CODE_RANGE = (201, 775)


def hex_address(value: Column) -> Column:
    """A 24-bit address from six hex digits with an optional 0x; NULL otherwise."""
    bare = F.regexp_replace(F.trim(value), "^0[xX]", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{6}$"), F.conv(bare, 16, 10).cast("int"))


def allocation_code(value: Column) -> Column:
    """The three-digit code inside a nine-digit station id, for every format that has one."""
    digits = F.trim(value)
    code = F.lit(None).cast("int")
    for prefix, start in reversed(CODE_FORMATS):
        code = F.when(digits.rlike(f"^{prefix}"), F.substring(digits, start, 3).try_cast("int")).otherwise(code)
    return F.when(digits.rlike("^[0-9]{9}$") & code.between(*CODE_RANGE), code)


def safety_reasons(
    rows: DataFrame, blocks: DataFrame, codes: list[int], fence: DataFrame, radius_km: float, with_position: list[str], cell: float = 1.0
) -> DataFrame:
    """Adds ``reason``: why a row must go, NULL when it may stay.

    Rows carry kind, hex_id, station_id, lat, lon. Order of the rules: identifier, protected block or
    code, missing position, impossible position, fence. Unknown kinds meet the position rules only.
    """
    kind = F.lower(F.trim(F.coalesce("kind", F.lit(""))))
    named = rows.withColumn("_kind", kind).withColumn("_address", hex_address(F.col("hex_id"))).withColumn("_code", allocation_code(F.col("station_id")))
    # A block is turned into its 4096-address pages, so the lookup has an equal key.
    pages = blocks.select("first", "last", F.explode(F.sequence(F.shiftright("first", 12), F.shiftright("last", 12))).alias("_page"))
    packed = pages.groupBy("_page").agg(F.collect_list(F.struct("first", "last")).alias("_blocks"))
    paged = named.withColumn("_page", F.shiftright("_address", 12)).join(small_side(packed), "_page", "left")
    in_block = F.coalesce(F.exists("_blocks", lambda b: F.col("_address").between(b["first"], b["last"])), F.lit(False))
    bounded = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~F.isnan("lat") & ~F.isnan("lon")
    placed = F.coalesce(bounded, F.lit(False))
    usable = paged.withColumn("_in_block", in_block).withColumn("_placed", placed)
    safe = usable.withColumn("_lat", F.col("lat")).withColumn("_lon", F.col("lon"))
    safe = safe.withColumn("lat", F.when(F.col("_placed"), F.col("lat"))).withColumn("lon", F.when(F.col("_placed"), F.col("lon")))
    fenced = in_fence(safe, fence, radius_km, cell, "_fenced").withColumn("lat", F.col("_lat")).withColumn("lon", F.col("_lon"))
    absent = F.col("lat").isNull() & F.col("lon").isNull()
    reason = (
        F.when((F.col("_kind") == "adsb") & F.col("_address").isNull(), "invalid_address")
        .when((F.col("_kind") == "adsb") & F.col("_in_block"), "protected_block")
        .when((F.col("_kind") == "ais") & F.col("_code").isNull(), "invalid_station")
        .when((F.col("_kind") == "ais") & F.col("_code").isin(*codes), "protected_code")
        .when(absent & F.col("_kind").isin(*with_position), "missing_position")
        .when(absent, None)
        .when(~F.col("_placed"), "invalid_position")
        .when(F.col("_fenced"), "in_fence")
    )
    return fenced.withColumn("reason", reason).select(*rows.columns, "reason")


def kept(reasoned: DataFrame) -> DataFrame:
    return reasoned.where("reason IS NULL").drop("reason")


def reason_counts(reasoned: DataFrame) -> DataFrame:
    """The only thing that is ever said about dropped rows: how many, and why."""
    return reasoned.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def validate(rows: DataFrame, key: str, rules: dict[str, str], unique: list[list[str]] | None = None, references: list | None = None) -> DataFrame:
    """(key, rule) for every broken rule.

    ``rules`` name SQL predicates that hold for a good row (NULL counts as good, as in a CHECK).
    ``unique``: column lists; all rows but the first by key break the rule. ``references``: triples
    (column, parent table, parent column).
    """
    broken = F.array_compact(F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
    out = rows.select(key, F.explode(broken).alias("rule"))
    for columns in unique or []:
        name = "unique_" + "_".join(columns)
        present = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
        first = present.groupBy(*columns).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        repeated = present.join(first, columns).where(F.col(key) != F.col("_first"))
        out = out.unionByName(repeated.select(key, F.lit(name).alias("rule")))
    for column, parent, parent_column in references or []:
        known = parent.select(F.col(parent_column).alias(column)).distinct()
        orphan = rows.where(F.col(column).isNotNull()).join(known, column, "left_anti")
        out = out.unionByName(orphan.select(key, F.lit(f"reference_{column}").alias("rule")))
    return out


class RefusedBatch(ValueError):
    """A strict batch with at least one bad row; nothing of it may be written."""


def strict(rows: DataFrame, findings: DataFrame) -> DataFrame:
    if not findings.isEmpty():
        raise RefusedBatch(f"{findings.count()} findings, batch refused as a whole")
    return rows
