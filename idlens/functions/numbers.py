"""Scores, rounding and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(c: Column, digits: int = 2) -> Column:
    """Half-even rounding."""
    return F.bround(c, digits)


def class_confidence(score: Column) -> Column:
    """MTH-3: share of 150 points as %, at most 99; above 60 points at least 85."""
    pct = F.least(round_even(score / F.lit(150.0) * F.lit(100.0), 2), F.lit(99.0))
    return (
        F.when(score <= 0, F.lit(0.0))
        .when(score > 60, F.greatest(pct, F.lit(85.0)))
        .otherwise(pct)
    )


def clamp_percent(c: Column, digits: int = 1) -> Column:
    """MTH-4."""
    return round_even(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c)), digits)


def quality_score(confidence: Column) -> Column:
    """MTH-5: confidence 0..1 as whole %, where 0 means "not measured" (98)."""
    pct = F.floor(confidence * 100 + 0.5).cast("int")
    return F.when(F.coalesce(pct, F.lit(0)) == 0, F.lit(98)).otherwise(pct)


def mrz_date(c: Column, expiry: bool = False) -> Column:
    """DAT-1: YYMMDD to DD/MM/YYYY; anything but six digits passes through."""
    yy = F.try_to_number(F.substring(c, 1, 2), F.lit("99")).cast("int")
    if expiry:
        year = F.when(yy < 80, yy + 2000).otherwise(yy + 1900)
    else:
        year = F.when(yy > 25, yy + 1900).otherwise(yy + 2000)
    slashed = F.concat_ws("/", F.substring(c, 5, 2), F.substring(c, 3, 2), year.cast("string"))
    return F.when(c.rlike("^[0-9]{6}$"), slashed).otherwise(c)


def day_month_year(c: Column) -> Column:
    """DATE of a DD/MM/YYYY text, NULL when it is none (a bare year, say)."""
    return F.to_date(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")))


def not_expired(expiry: Column, as_of: Column) -> Column:
    """DAT-2: valid while the expiry day has not passed; unknown dates stay NULL."""
    return day_month_year(expiry) >= as_of


def age_years(birth: Column, as_of: Column) -> Column:
    """DAT-2: whole years at `as_of`."""
    return F.floor(F.months_between(as_of, day_month_year(birth)) / 12).cast("int")


def epoch_millis(ts: Column) -> Column:
    """DAT-3."""
    return F.unix_millis(ts.cast("timestamp"))
