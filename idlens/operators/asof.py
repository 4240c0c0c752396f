"""As-of join: a row meets the version of its key that was valid at its time (JN-9, DAT-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idlens.operators.crosscheck import id_key
from idlens.session import shared_dir


def as_of(events: DataFrame, versions: DataFrame, on: list[str], at: str, since: str, into: str = "version",
          parts: int | None = None) -> DataFrame:
    """Adds `into`: the columns of the latest row of `versions` with the same key whose `since`
    is not after the event's `at`; null where there is none.

    No pairs are made. Versions and events are put together and range-partitioned by
    (key, time), so a hot key spans many partitions; inside a partition the last version is
    carried along, and a partition that starts in the middle of a key begins with the last
    version before it, taken from one summary row a key and partition. Of several versions
    of one key and time the greatest counts. Events with a null key or time stay without a
    version and are not shuffled; versions with one are not used.
    """
    shared_dir(events.sparkSession)
    parts = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usable = " AND ".join(f"`{c}` IS NOT NULL" for c in on)
    kept = [c for c in versions.columns if c not in on]
    known = versions.where(f"{usable} AND `{since}` IS NOT NULL").select(
        *on, F.col(since).alias("_time"), F.struct(*kept).alias("_version")).groupBy(*on, "_time").agg(F.max("_version").alias("_version"))
    row = F.struct(*events.columns)
    asked = events.where(f"{usable} AND `{at}` IS NOT NULL")
    nothing = F.lit(None).cast(known.schema["_version"].dataType)
    both = known.select(*on, "_time", F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"), "_version", F.lit(None).cast(
        asked.select(row.alias("r")).schema["r"].dataType).alias("_row")).unionByName(asked.select(
            *on, F.col(at).alias("_time"), F.lit(1).alias("_kind"), F.xxhash64(*events.columns).alias("_tie"), nothing.alias("_version"), row.alias("_row")))
    cut = both.repartitionByRange(parts, *on, "_time", "_kind", "_tie").withColumn("_part", F.spark_partition_id()).checkpoint()
    last = F.max(F.when(F.col("_kind") == 0, F.struct("_time", "_version")))
    ends = cut.groupBy(*on, "_part").agg(last["_version"].alias("_last"))
    earlier = W.partitionBy(*on).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*on, "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    inside = W.partitionBy(*on, "_part").orderBy("_time", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = cut.join(carried, [*on, "_part"]).withColumn(
        "_met", F.coalesce(F.last("_version", ignorenulls=True).over(inside), F.col("_before"))).where("_kind = 1")
    rest = events.where(f"NOT ({usable} AND `{at}` IS NOT NULL)")
    return met.select("_row.*", F.col("_met").alias(into)).unionByName(rest.withColumn(into, nothing))


def verify_registry_as_of(claims: DataFrame, registry: DataFrame, keys: list[str], at: str = "captured_at",
                          since: str = "valid_from", until: str = "valid_until", parts: int | None = None) -> DataFrame:
    """JN-9 against a registry that changes: a claim (keys, doc_type, id_number, name, dob,
    gender, `at`) is checked against the registry row valid at its capture, not against the
    newest one. A version that had ended (`until` before `at`) is found but expired."""
    def facts(df: DataFrame, *more: str) -> DataFrame:
        return df.select("doc_type", id_key(F.col("id_number")).alias("id"), F.lower(F.trim("name")).alias("n"), F.col("dob").alias("b"),
                         F.upper(F.substring("gender", 1, 1)).alias("g"), *more)

    met = as_of(facts(claims, *keys, at), facts(registry, since, until), ["doc_type", "id"], at, since, "v", parts)
    found = F.col("v").isNotNull()
    same = {f: F.coalesce(F.col(c) == F.col(f"v.{c}"), F.lit(False)) for f, c in (("name_verified", "n"), ("dob_verified", "b"), ("gender_verified", "g"))}
    expired = found & F.coalesce(F.col(f"v.{until}") < F.col(at), F.lit(False))
    return met.select(*keys, F.col(f"v.{since}").alias(since), found.alias("id_found"), expired.alias("expired"),
                      *[c.alias(f) for f, c in same.items()],
                      (found & ~expired & same["name_verified"] & same["dob_verified"] & same["gender_verified"]).alias("is_verified"))
