"""Rounding and division rules shared by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_dp(value: Column, places: int) -> Column:
    """Round half away from zero in decimal, so 1.005 gives 1.01 on every engine."""
    return F.round(value.cast("decimal(28,8)"), places).cast("double")


def round_small(value: Column, places: int) -> Column:
    """As ``round_dp`` for per-row values below 10^10: Spark keeps 18 digits in a long."""
    return F.round(value.cast("decimal(18,8)"), places).cast("double")


def percent(part: Column, places: int) -> Column:
    return round_dp(part * F.lit(100.0), places)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL on a zero denominator (Spark raises by default)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def int_div(value: Column, by: Column | int) -> Column:
    """Whole-number quotient of non-negative longs, exact at any size."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by))


def count_rows() -> Column:
    return F.count(F.lit(1))


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def plain_number(value: Column, places: int) -> Column:
    """Text of a number without trailing zeros: 3.50 -> '3.5', 10.00 -> '10'."""
    text = F.round(value.cast("decimal(28,8)"), places).cast(f"decimal(28,{places})")
    return F.regexp_replace(text.cast("string"), r"\.?0+$", "") if places else text.cast("string")
