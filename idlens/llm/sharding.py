"""Sharding by sampled splitters.

Rows are laid out in the order of a key (by default a hash of the text, so that
equal texts lie together) and cut into `shards` stretches of nearly equal size:

1. a size-weighted sample of keys is drawn; its quantiles split the keys into
   `shards * ranges` ranges (splitters);
2. keys that the sample shows to be overfull on their own get a range of their
   own, subdivided by a hash of the row's tie-breaking columns; where rows that agree
   in those too (null or repeated ids) are overfull, by the row's stored number;
3. the exact bytes and rows of every range are added up and neighbouring ranges
   dealt to the shards, each range going where its middle lies.

Only the splitters, the overfull keys and one line per range are ever gathered;
their numbers depend on the parameters, not on the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idlens.llm.common import cut

RANGES = 128  # per shard; a shard's size is off by at most one range
SAMPLE = 8  # expected sampled keys per range
FAN = 16  # splitters are searched in two steps of so many


def unit(*columns) -> Column:
    """A reproducible number in [0, 1) from the values of some columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def splitters(rows: DataFrame, total: int, ranges: int, sample: int = SAMPLE) -> tuple[list[int], list[tuple], list[tuple]]:
    """Boundaries between `ranges` ranges of about equal size, and the overfull keys and
    overfull (key, tie) with the number of parts each needs. `rows` has key, tie, row and size.

    A row is drawn with a chance in proportion to its size, and for certain when
    it is larger than the step between two draws.
    """
    step, most = total / (ranges * sample), F.lit(total / ranges)
    parts = F.ceil(F.col("weight") / most).cast("int")
    full = (F.col("hits") > 1) & (F.col("weight") >= most)
    tied = cut(rows.where(unit("key", "tie", "row", F.lit(7)) < F.col("size") / step).groupBy("key", "tie").agg(
        F.sum(F.greatest(F.col("size").cast("double"), F.lit(step))).alias("weight"), F.count("*").alias("hits")))
    drawn = tied.groupBy("key").agg(F.sum("weight").alias("weight"), F.sum("hits").alias("hits"))
    running = Window.orderBy("key")
    placed = drawn.withColumn("upto", F.sum("weight").over(running)).withColumn("range", F.ceil(F.col("upto") / most))
    bounds = [r["key"] for r in placed.groupBy("range").agg(F.max("key").alias("key")).orderBy("key").collect()]
    keys = [tuple(r) for r in drawn.where(full).select("key", parts).collect()]
    ties = [tuple(r) for r in tied.where(full).select("key", "tie", parts).collect()]
    return bounds[:-1], keys, ties


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below the key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    coarse = F.array(*map(F.lit, bounds[FAN - 1::FAN])) if len(bounds) >= FAN else F.array().cast("array<bigint>")
    block = F.size(F.filter(coarse, lambda b: b < key))
    fine = F.slice(F.array(*map(F.lit, bounds)), block * FAN + 1, FAN)
    return block * FAN + F.size(F.filter(fine, lambda b: b < key))


def shard_by_size(rows: DataFrame, shards: int = 8, ranges: int = RANGES) -> DataFrame:
    """Adds shard (0 .. shards - 1), slot (gapless from 0 in each shard).

    `rows` has key (bigint: the order), tie (bigint: separates rows of one key), row
    (bigint: separates rows of one tie, and must come from a stored table) and size
    (bigint, at least 1); further columns go along. Rows that share key and tie stay
    together unless they fill a range on their own. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    wanted = shards * ranges
    bounds, keys, ties = splitters(rows, total, wanted)
    placed = rows.withColumn("_range", range_of(F.col("key"), bounds))
    # at most about `wanted` rows each
    hot = F.broadcast(spark.createDataFrame(keys, "key bigint, _parts int"))
    tied = F.broadcast(spark.createDataFrame(ties, "key bigint, tie bigint, _tied int"))
    part = F.when(F.col("_tied").isNull(), F.concat(F.lit("t"), F.floor(unit("tie", F.lit(3)) * F.col("_parts")))).otherwise(
        F.concat_ws("/", F.lit("u"), "tie", F.floor(unit("row", F.lit(5)) * F.col("_tied"))))
    placed = placed.join(hot, "key", "left").join(tied, ["key", "tie"], "left").withColumn(
        "_cell", F.when(F.col("_parts").isNull(), F.lit("")).otherwise(F.concat_ws("/", "key", part))).drop("_parts", "_tied")

    cells = placed.groupBy("_range", "_cell").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    order = Window.orderBy("_range", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("_range", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("_bytes").over(order), F.lit(0)) + F.col("_bytes") / 2
    cells = cells.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(total))).cast("int")).withColumn(
        "_first", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    # one line per range and per part of an overfull key: bounded by the parameters
    cells = F.broadcast(cells.select("_range", "_cell", "shard", "_first"))
    number = F.row_number().over(Window.partitionBy("_range", "_cell").orderBy("key", "tie", "row"))
    return placed.join(cells, ["_range", "_cell"]).withColumn("slot", F.col("_first") + number - 1).drop("_range", "_cell", "_first")


def shard_documents(docs: DataFrame, shards: int = 8, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot of every document.

    Size: UTF-8 bytes of the text plus 1 (null: 1, checksum 0). Equal texts share a
    key, so a group is only split where a cut between shards needs it because the
    group fills a range of its own. Null and repeated doc_ids are rows like any
    other, and a group of them is split as well; other columns of `docs` are not read.
    """
    narrow = cut(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("tie"),
        F.monotonically_increasing_id().alias("row")))
    return shard_by_size(narrow, shards, ranges).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")
