"""Months written as YYYYMM strings, counted as ``year * 12 + month - 1``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(period: Column) -> Column:
    return F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 5, 2).cast("int") - 1


def period_of(index: Column) -> Column:
    year = F.floor(index / 12).cast("int")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lpad((index - year * 12 + 1).cast("string"), 2, "0"))


def shift(period: str, months_back: int) -> str:
    index = int(period[:4]) * 12 + int(period[4:]) - 1 - months_back
    return f"{index // 12}{index % 12 + 1:02d}"
