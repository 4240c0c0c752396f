"""Joins whose big side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this part of the rows on; fewer keys than this can be.
HOT_PART = 1000


def join_to_one(big: DataFrame, one: DataFrame, key: str, rows: str, total: int | None = None) -> DataFrame:
    """Inner join of `big` with `one`, which has a row per key and in `rows` the number of
    that key's rows in `big`.

    Keys with more than one in HOT_PART of all rows are fewer than HOT_PART, so their rows
    of `one` go to every task and the rows of `big` stay where they are; all other keys are
    shuffled. Rows of `big` without a partner, and null keys, drop. `total` is the number of
    rows of `big`, or more, where the caller knows it.
    """
    total = one.agg(F.sum(rows)).first()[0] or 0 if total is None else total
    hot = F.col(rows) * HOT_PART > total
    few = F.broadcast(one.where(hot & (F.col(rows) > 1)))
    near = big.join(few, key)
    far = big.join(few.select(key), key, "left_anti").join(one.where(~(hot & (F.col(rows) > 1))), key)
    return near.unionByName(far)
