"""Scalar helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import bucket


def date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns({
        "month_start": bucket(d, "M"), "month_end": F.last_day(d), "quarter_start": bucket(d, "Q"), "year_start": bucket(d, "A"),
        "week_end": bucket(d, "W"), "in_three_months": F.add_months(d, 3),
    })


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def truncate(text: Column, chars: int, marker: str = "…") -> Column:
    return F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(marker))).otherwise(text)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def numeric(text: Column) -> Column:
    """The number a string holds; "." and anything else that is none are missing."""
    return F.nullif(text, F.lit(".")).try_cast("double")
