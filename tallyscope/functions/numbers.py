"""Exact decimal averages and date distances."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def average_of(total: Column, rows: Column) -> Column:
    """``total / rows`` to 2 places, half away from zero; NULL when there are no rows.

    Spark's own ``avg`` of a decimal keeps only 4 extra places, so rounding it once more can be
    off in large groups. These operand types leave 16 places: right up to 10^13 rows.
    """
    quotient = total.cast("decimal(24,2)") / F.nullif(rows, F.lit(0)).cast("decimal(13,0)")
    return F.round(quotient, 2)


def average(column: str) -> Column:
    return average_of(F.sum(column), F.count(column))


def days_from(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def day(value: date) -> Column:
    return F.lit(value)
