"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id bigint, x array<bigint>: each component c as floor(scale * c).

    Rows whose vector is null, empty, or holds a null, NaN or infinite component are left
    out. Where vectors differ in length, the most frequent length counts (of equally
    frequent ones the greater) and the others are left out. Null ids stay; other columns
    are not read; empty tables give empty tables.
    """
    c = F.col("embedding")
    broken = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), c.alias("embedding")).where(
        c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(broken, F.lit(False)))
    usual = whole.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = usual["size"] if usual else 0
    x = F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("bigint"))
    return whole.where(F.size("embedding") == size).select("vec_id", x.alias("x"))
