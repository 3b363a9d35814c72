"""Periods: month and year ranges, request validation (survey G1, G2, F4).

Ranges are generated inside the row (``sequence`` + ``explode``), never by
joining against a calendar table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Validation outcomes of a requested period.
REASON_FORMAT, REASON_ORDER, REASON_MONTH, REASON_YEAR = "format", "order", "month", "year"
FIRST_YEAR = 2000  # earliest year the yearly vendor accepts


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def months_between_dates(start, end) -> Column:
    """Array of first-of-month dates from ``start``'s month to ``end``'s
    month, both included (empty when start is after end)."""
    s, e = F.trunc(_c(start), "month"), F.trunc(_c(end), "month")
    return F.when(s <= e, F.sequence(s, e, F.expr("INTERVAL 1 MONTH"))).otherwise(F.array().cast("array<date>"))


def month_cells(start: tuple[int, int], end: tuple[int, int]) -> Column:
    """G1 for fixed bounds ``(ano, mes)``: array of first-of-month dates."""
    return months_between_dates(F.make_date(F.lit(start[0]), F.lit(start[1]), F.lit(1)),
                                F.make_date(F.lit(end[0]), F.lit(end[1]), F.lit(1)))


def month_range(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """G1: one row (ano, mes) per month of every [start, end] row."""
    m = bounds.select(F.explode(months_between_dates(start, end)).alias("__m"))
    return m.select(F.year("__m").alias("ano"), F.month("__m").alias("mes"))


def year_range(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """One row per year of every [start, end] row, both ends included."""
    s, e = _c(start).cast("int"), _c(end).cast("int")
    seq = F.when(s <= e, F.sequence(s, e)).otherwise(F.array().cast("array<int>"))
    return bounds.select(F.explode(seq).alias("ano"))


def span_bounds(df: DataFrame, date_col: str) -> DataFrame:
    """First and last value of a date column: one aggregate row."""
    return df.agg(F.min(date_col).alias("start"), F.max(date_col).alias("end"))


def months_spanned(df: DataFrame, date_col: str) -> DataFrame:
    """G1 over the data: every month from the first to the last date."""
    return month_range(span_bounds(df, date_col), "start", "end")


def years_spanned(df: DataFrame, date_col: str) -> DataFrame:
    """G2 over the data: every year from the first to the last date."""
    b = span_bounds(df, date_col)
    return year_range(b.select(F.year("start").alias("s"), F.year("end").alias("e")), "s", "e")


def parse_month_year(text) -> tuple[Column, Column]:
    """``MM/AAAA`` -> (month, year) as INT, NULL when not a number. Like
    the reference, only the first two ``/`` parts are read."""
    parts = F.split(py_strip_col(text), "/")
    m = F.get(parts, 0).try_cast("int")
    y = F.get(parts, 1).try_cast("int")
    return m, y


def py_strip_col(c) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def validate_periods(requests: DataFrame, start: str, end: str) -> DataFrame:
    """check requested ``MM/AAAA`` periods in the reference's order -
    unreadable text, start after end, month outside 1..12 - and add
    ``valid`` and ``reason`` (NULL when valid)."""
    m1, y1 = parse_month_year(F.col(start))
    m2, y2 = parse_month_year(F.col(end))
    unreadable = m1.isNull() | y1.isNull() | m2.isNull() | y2.isNull()
    reversed_ = (y1 > y2) | ((y1 == y2) & (m1 > m2))
    bad_month = (m1 < 1) | (m1 > 12) | (m2 < 1) | (m2 > 12)
    reason = (F.when(unreadable, F.lit(REASON_FORMAT)).when(reversed_, F.lit(REASON_ORDER))
              .when(bad_month, F.lit(REASON_MONTH)))
    return requests.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def validate_years(requests: DataFrame, start: str, end: str, current_year: int) -> DataFrame:
    """F4, yearly vendor: integers, start <= end, both in FIRST_YEAR..current."""
    y1, y2 = py_strip_col(start).try_cast("int"), py_strip_col(end).try_cast("int")
    out_of_range = (y1 < FIRST_YEAR) | (y1 > current_year) | (y2 < FIRST_YEAR) | (y2 > current_year)
    reason = (F.when(y1.isNull() | y2.isNull(), F.lit(REASON_FORMAT)).when(y1 > y2, F.lit(REASON_ORDER))
              .when(out_of_range, F.lit(REASON_YEAR)))
    return requests.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
