"""Summaries that are stored and merged without the rows they came from (AGG-12, AGG-17, STR-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL_BITS = 12  # 1.6 % standard error
KLL_SIZE = 400  # ranks within 0.7 %


def sketches(history: DataFrame, unit: str = "1 hour", by: tuple[str, ...] = ("document_type",), time: str = "timestamp",
             holder: str = "holder", value: str = "risk_score") -> DataFrame:
    """start, by, n_scans, holders (HyperLogLog), risks (KLL): one row per unit of time and group,
    some kilobytes whatever the number of scans. Works on a batch and, behind a watermark,
    on a stream. Null times have no row; null holders and values count in n_scans only."""
    return history.groupBy(F.window(time, unit).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n_scans"), F.hll_sketch_agg(F.col(holder).cast("string"), F.lit(HLL_BITS)).alias("holders"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_SIZE)).alias("risks")).select(
        F.col("w.start").alias("start"), *by, "n_scans", "holders", "risks")


def rolled_up(stored: DataFrame, unit: str = "DAY", by: tuple[str, ...] = ("document_type",)) -> DataFrame:
    """Stored sketches merged to longer units or fewer groups, without the raw rows."""
    return stored.groupBy(F.date_trunc(unit, "start").alias("start"), *by).agg(
        F.sum("n_scans").alias("n_scans"), F.hll_union_agg("holders").alias("holders"), F.kll_merge_agg_double("risks").alias("risks"))


def estimates(stored: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """The sketches' answers: n_holders and, for each quantile, risk_q<percent>."""
    asked = {f"risk_q{round(q * 100)}": F.kll_sketch_get_quantile_double("risks", F.lit(q)) for q in quantiles}
    return stored.withColumns({"n_holders": F.hll_sketch_estimate("holders"), **asked}).drop("holders", "risks")
