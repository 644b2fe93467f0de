"""Trade statistics: undivided rows, mirror series, window comparisons, absences.

A statistic row is (period, reporter, partner, flow, chapter, heading, mot, customs, partner2, value).
NULL is never read as zero: a missing month stays missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.periods import month_index, period_of, shift
from beaconry.session import small_side

MAX_LOOK_BACK = 24


def undivided(stats: DataFrame) -> DataFrame:
    """Only the single all-modes, default-procedure, no-second-partner row of each statistic."""
    return _single(stats).where("mot = '0'")


def _single(stats: DataFrame) -> DataFrame:
    return stats.where("coalesce(customs, 'C00') = 'C00' AND coalesce(partner2, '0') = '0' AND value IS NOT NULL")


def period_dim(first: Column, last: Column, source: DataFrame) -> DataFrame:
    """All months between two month indexes found in ``source`` with the month before and a year before."""
    bounds = source.agg(first.alias("_first"), last.alias("_last"))
    months = bounds.select(F.explode(F.sequence("_first", "_last")).alias("index"))
    return months.select("index", period_of(F.col("index")).alias("period"), period_of(F.col("index") - 1).alias("previous"), period_of(F.col("index") - 12).alias("year_before"))


def window_periods(latest: DataFrame, pivot: str, months: int) -> DataFrame:
    """(reporter, label, period): the months before the pivot, and those ending at the reporter's latest."""
    last_before = shift(pivot, 1)
    before = F.array(*[F.lit(shift(last_before, i)) for i in range(months)])
    end = month_index(F.col("latest"))
    after = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: period_of(end - i))
    windows = F.array(
        F.struct(F.lit("before").alias("label"), before.alias("periods")),
        F.struct(F.lit("after").alias("label"), F.when(F.col("latest").isNotNull(), after).alias("periods")),
    )
    return latest.select("reporter", F.inline(windows)).select("reporter", "label", F.explode("periods").alias("period"))


def latest_reported(stats: DataFrame, pivot: str, today: str) -> DataFrame:
    """Last month with a figure per reporter, at most 24 months back and after the pivot; else NULL."""
    oldest, newest = shift(today, MAX_LOOK_BACK), shift(today, 1)
    inside = F.col("period").between(oldest, newest) & (F.col("period") > pivot)
    found = F.max(F.when(inside & F.col("counts"), F.col("period")))
    single = stats.withColumn("counts", F.expr("coalesce(customs, 'C00') = 'C00' AND coalesce(partner2, '0') = '0' AND value IS NOT NULL AND mot = '0'"))
    return single.groupBy("reporter").agg(found.alias("latest"))


def mirror_series(stats: DataFrame, modes: dict[str, str]) -> DataFrame:
    """Both sides of every pair per month: a's exports to b, a's imports from b, b's imports from a,
    and a's exports by transport mode. One shuffle: each row is keyed for the sides it belongs to."""
    single = _single(stats).where(F.col("mot").isin("0", *modes))
    side = F.struct(F.col("reporter").alias("a"), F.col("partner").alias("b"), F.when(F.col("flow") == "X", "a_exports").otherwise("a_imports").alias("line"))
    mirrored = F.struct(F.col("partner").alias("a"), F.col("reporter").alias("b"), F.lit("b_imports").alias("line"))
    sides = F.when((F.col("flow") == "M") & (F.col("mot") == "0"), F.array(side, mirrored)).otherwise(F.array(side))
    keyed = single.select("period", "mot", "value", F.explode(sides).alias("s")).select("period", "mot", "value", "s.*")

    def total(line: str, mot: str) -> Column:
        return F.sum(F.when((F.col("line") == line) & (F.col("mot") == mot), F.col("value")))

    whole = [total(line, "0").alias(line) for line in ("a_exports", "a_imports", "b_imports")]
    split = [total("a_exports", code).alias(f"a_exports_{name}") for code, name in modes.items()]
    return keyed.groupBy("period", "a", "b").agg(*whole, *split)


def full_frame(series: DataFrame) -> DataFrame:
    """Every month of the archive for every pair, so that a missing month becomes a visible row."""
    index = month_index(F.col("period"))
    span = series.agg(F.min(index).alias("_first"), F.max(index).alias("_last"))
    pairs = series.select("a", "b").distinct().join(F.broadcast(span))  # one-row side
    frame = pairs.select("a", "b", F.explode(F.sequence("_first", "_last")).alias("_i")).select("a", "b", period_of(F.col("_i")).alias("period"))
    return frame.join(series, ["a", "b", "period"], "left")


def reported_absence(series: DataFrame, control: int) -> DataFrame:
    """``reported``: the pair has a line, or the same reporter and month has a positive control line."""
    lines = series.where(F.col("b") == control).select("a", "period", F.col("a_exports").alias("_control"))
    framed = full_frame(series).join(small_side(lines), ["a", "period"], "left")
    has_line = F.col("a_exports").isNotNull() | F.col("a_imports").isNotNull()
    return framed.withColumn("reported", has_line | F.coalesce(F.col("_control") > 0, F.lit(False))).drop("_control")


def halt_stats(framed: DataFrame, pivot: str, mode: str) -> DataFrame:
    """Per pair, before and after the pivot month: means, months and totals with a line, absences split
    into reported and silent, and the mean share of one transport mode."""
    after, before = F.col("period") > pivot, (F.col("period") < pivot) & (F.col("a_exports") > 0)
    line = after & (F.coalesce(F.col("b_imports"), F.lit(0.0)) > 0)
    absent = after & F.col("a_exports").isNull()
    share = F.col(f"a_exports_{mode}") / F.when(F.col("a_exports") != 0, F.col("a_exports"))
    return framed.groupBy("a", "b").agg(
        F.avg(F.when(before, F.col("a_exports"))).alias("mean_before"),
        F.count_if(after).alias("of_months"),
        F.count_if(line).alias("months"),
        F.coalesce(F.sum(F.when(line, F.col("b_imports"))), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(line & F.col("reported"), F.col("b_imports"))), F.lit(0.0)).alias("total_reported"),
        F.count_if(absent & F.col("reported")).alias("absent_reported"),
        F.count_if(absent & ~F.col("reported")).alias("absent_silent"),
        F.avg(F.when(before & (F.col(f"a_exports_{mode}") > 0), share)).alias("mode_share"),
    )


#: A series of trade values: never imports and exports, or several partners, in one number.
SERIES = ["reporter", "partner", "flow"]


def _window_values(stats: DataFrame, windows: DataFrame, code: str) -> DataFrame:
    monthly = undivided(stats).groupBy(*SERIES, "period", F.col(code).alias("code")).agg(F.sum("value").alias("value"))
    return monthly.join(small_side(windows), ["reporter", "period"])


def _months_with_data(labelled: DataFrame) -> DataFrame:
    def months(label: str) -> Column:
        return F.count_distinct(F.when(F.col("label") == label, F.col("period"))).alias(f"months_{label}")

    return labelled.groupBy(*SERIES).agg(months("before"), months("after"))


def _compared(labelled: DataFrame) -> DataFrame:
    """Per series and code: window means over the months that have any data, and how they moved."""
    after = F.col("label") == "after"
    sums = labelled.groupBy(*SERIES, "code").agg(
        F.coalesce(F.sum(F.when(~after, F.col("value"))), F.lit(0.0)).alias("sum_before"),
        F.coalesce(F.sum(F.when(after, F.col("value"))), F.lit(0.0)).alias("sum_after"),
        F.count_if(after & (F.col("value") > 0)).alias("months_present"),
        F.max(F.when(after, F.col("value"))).alias("top_month"),
    )
    joined = sums.join(_months_with_data(labelled), SERIES)
    before = F.col("sum_before") / F.when(F.col("months_before") > 0, F.col("months_before"))
    mean_after = F.col("sum_after") / F.when(F.col("months_after") > 0, F.col("months_after"))
    change = F.when(F.coalesce(before, F.lit(0.0)) != 0, F.round(100 * (mean_after - before) / before, 1))
    return joined.select(
        *SERIES, "code", F.coalesce(F.round(before), F.lit(0.0)).alias("before"), F.coalesce(F.round(mean_after), F.lit(0.0)).alias("after"),
        change.alias("change_pct"), "months_present", "months_after",
        F.coalesce(F.round(F.col("top_month") / F.when(F.col("sum_after") != 0, F.col("sum_after")), 3), F.lit(0.0)).alias("top_month_share"),
    )


def chapter_windows(stats: DataFrame, windows: DataFrame) -> DataFrame:
    """Two-window comparison per chapter; ``lumpy`` marks one delivery that reads like a flow."""
    compared = _compared(_window_values(stats.where("length(chapter) = 2"), windows, "chapter"))
    lumpy = (F.col("top_month_share") > 0.6) & (F.col("months_present") <= 3)
    return compared.withColumn("lumpy", lumpy).drop("months_after")


def heading_windows(stats: DataFrame, windows: DataFrame, chapters: list[str]) -> DataFrame:
    """One level deeper for chosen chapters; the months with data are those of all headings."""
    labelled = _window_values(stats, windows, "heading")
    compared = _compared(labelled).where(F.substring("code", 1, 2).isin(*chapters))
    few = F.greatest(F.lit(2), F.floor(F.col("months_after") / 4))
    lumpy = (F.col("after") > 0) & (F.col("months_present") > 0) & (F.col("months_present") <= few)
    return compared.withColumn("lumpy", lumpy).drop("months_after", "top_month_share")


def excess_growth(stats: DataFrame, windows: DataFrame) -> DataFrame:
    """Partner growth over the reporter's own trend; the trend enters as its rounded percentage."""
    exports = undivided(stats).where("flow = 'X'")
    monthly = exports.groupBy("reporter", "partner", "period").agg(F.sum("value").alias("value"))
    labelled = monthly.join(small_side(windows), ["reporter", "period"])

    def mean(label: str) -> Column:
        return F.round(F.avg(F.when(F.col("label") == label, F.col("value"))))

    def percent(after: Column, before: Column) -> Column:
        return F.round(100 * (after - before) / F.when(before != 0, before), 1)

    world = labelled.groupBy("reporter", "label", "period").agg(F.sum("value").alias("value"))
    trend = world.groupBy("reporter").agg(mean("before").alias("_wb"), mean("after").alias("_wa"))
    trend = trend.select("reporter", percent(F.col("_wa"), F.col("_wb")).alias("trend_pct"))
    partners = labelled.groupBy("reporter", "partner").agg(
        mean("before").alias("before"), mean("after").alias("after"),
        F.count_if(F.col("label") == "before").alias("before_months"), F.count_if(F.col("label") == "after").alias("after_months"),
    )
    change = F.when(F.col("after") != 0, percent(F.col("after"), F.col("before")))
    out = partners.join(small_side(trend), "reporter").withColumn("change_pct", change)
    return out.withColumn("change_value", F.col("after") - F.col("before")).withColumn(
        "excess_pct", F.round(F.col("change_pct") - F.col("trend_pct"), 1)
    ).withColumn("excess_value", F.round(F.col("after") - F.col("before") * (1 + F.col("trend_pct") / 100)))


def label_lookup(rows: DataFrame, labels: DataFrame, code: str) -> DataFrame:
    """Code to label in two languages: text after `` - ``, second language, first language, code."""
    cut = labels.select(F.col("code").alias(code), F.trim(F.substring_index("text", " - ", -1)).alias("_name"), F.col("local").alias("_local"))
    joined = rows.join(small_side(cut), code, "left")
    name = F.coalesce("_name", code)
    return joined.withColumn("name", name).withColumn("name_local", F.coalesce(F.col("_local"), name)).drop("_name", "_local")
