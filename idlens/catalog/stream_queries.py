"""Registered queries over streams that arrive in slices, with a restart after each."""

from __future__ import annotations

from pyspark.sql import functions as F

from idlens.catalog.extract_queries import cross_sql
from idlens.catalog.registry import field_frame, joined, register, rel
from idlens.streaming import jobs
from idlens.streaming.pairing import pair_sides, rocksdb_state

SLICES = 4
#: A last row per source, far ahead of all others, lets the watermark pass them.
FAR = "timestamp'2100-01-01 00:00:00'"


# --- texts and payloads apart ------------------------------------------------------------

_OFFSET = "CASE doc_id % 5 WHEN 0 THEN 300 WHEN 1 THEN -180 WHEN 2 THEN 599 WHEN 3 THEN 7200 ELSE 0 END"
_LATE_SQL = "doc_id % 11 = 3 AND 2 * doc_id < (SELECT max(doc_id) FROM field_wide)"


@register("str1_text_and_qr_streams", f"""WITH met AS (SELECT doc_id, CASE WHEN {_OFFSET} <= 600 AND NOT ({_LATE_SQL}) THEN payload END AS payload FROM kyc),
{cross_sql().replace("JOIN kyc k", "JOIN met k")}
SELECT doc_id, qr_detected, qr_data, cast(matches AS INT) AS matches, array_to_string(mismatches, '|') AS mismatches FROM cross_checked""", ("field_wide", "kyc"))
def _(spark, sf):
    fields, kyc = field_frame(spark, sf), rel(spark, sf, "kyc")
    last = fields.agg(F.max("doc_id")).first()[0]
    # a text every ten minutes of event time; payloads before, after, outside the interval, or late by slices
    texts = fields.select("doc_id", "fields", F.timestamp_seconds(1704067200 + F.col("doc_id") * 600).alias("read_at"))
    codes = kyc.where("payload IS NOT NULL").select(
        "doc_id", "payload", F.timestamp_seconds(F.expr(f"1704067200 + doc_id * 600 + {_OFFSET}")).alias("decoded_at"))
    slot = F.least(F.floor(F.col("doc_id") * SLICES / (last + 1)), F.lit(SLICES - 1))
    late = (F.col("doc_id") % 11 == 3) & (2 * F.col("doc_id") < last)
    clock = (texts.limit(1).select(F.lit(-1).cast("bigint").alias("doc_id"), "fields", F.expr(FAR).alias("read_at")),
             codes.limit(1).select(F.lit(-1).cast("bigint").alias("doc_id"), "payload", F.expr(FAR).alias("decoded_at")))
    slices = [{"texts": texts.where(slot == i), "codes": codes.where(F.when(late, SLICES - 1).otherwise(slot) == i)} for i in range(SLICES)]
    slices.append(dict(zip(("texts", "codes"), clock)))
    out = jobs.fed(spark, slices, lambda s: jobs.cross_check_streams(s["texts"], s["codes"], ["doc_id"]).select("doc_id", "qr_check"), "texts-and-codes")
    return out.where("doc_id >= 0").select("doc_id", "qr_check.qr_detected", "qr_check.qr_data", "qr_check.matches", joined(F.col("qr_check.mismatches")).alias("mismatches"))


# --- sides paired with timers ---------------------------------------------------------------


@register("str2_timed_pairs", """WITH c AS (SELECT session_id, capture_id, seq, side, epoch_us(captured_at) // 1000 AS ms FROM captures WHERE side IN ('front', 'back')),
f AS (SELECT *, CASE WHEN side = lag(side) OVER w OR ms - lag(ms) OVER w > 1800000 THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY session_id ORDER BY ms, seq)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS grp FROM f),
p AS (SELECT *, (row_number() OVER (PARTITION BY session_id, grp ORDER BY ms, seq) - 1) // 2 AS pair FROM g)
SELECT session_id, max(capture_id) FILTER (side = 'front') AS front_capture, max(capture_id) FILTER (side = 'back') AS back_capture, min(ms) AS first_ms,
  CASE WHEN count(*) = 2 THEN 'pair' ELSE 'alone' END AS state FROM p GROUP BY session_id, grp, pair""", ("captures",))
def _(spark, sf):
    captures = rel(spark, sf, "captures").select("session_id", "capture_id", "seq", "side", "captured_at")
    cuts = captures.select(F.unix_micros("captured_at").alias("t")).approxQuantile("t", [i / SLICES for i in range(1, SLICES)], 0.01)
    slot = sum((F.unix_micros("captured_at") >= int(c)).cast("int") for c in cuts)
    clock = captures.limit(1).select("session_id", "capture_id", "seq", F.lit("front").alias("side"), F.expr(FAR).alias("captured_at"))
    slices = [{"captures": captures.where(slot == i)} for i in range(SLICES)] + [{"captures": clock.withColumn("session_id", F.lit(-1).cast(captures.schema["session_id"].dataType))}]
    with rocksdb_state(spark):
        return jobs.fed(spark, slices, lambda s: pair_sides(s["captures"]), "timed-pairs")


# --- duplicates -----------------------------------------------------------------------------


@register("str3_duplicate_submissions", "SELECT DISTINCT session_id, doc_type, side, cast(seq % 3 AS INT) AS day FROM captures", ("captures",))
def _(spark, sf):
    keys = ["session_id", "doc_type", "side"]
    captures = rel(spark, sf, "captures")
    # three days of captures, each within an hour: repeats of a day go, those of the next day come out again
    days = captures.select(*keys, (F.col("seq") % 3).cast("int").alias("day"),
                           F.timestamp_seconds(1704067200 + F.col("seq") % 3 * 86400 + F.col("seq") % 3600).alias("captured_at"))
    # a row three hours on moves the watermark past the hour's delay, so the state of the day is evicted
    clock = days.limit(1).select(F.lit(-1).cast(days.schema["session_id"].dataType).alias("session_id"), "doc_type", "side")
    slices = [{"captures": days.where(F.col("day") == d).unionByName(clock.select("*", F.lit(d).alias("day"), F.timestamp_seconds(F.lit(1704067200 + d * 86400 + 3 * 3600)).alias("captured_at")))}
              for d in range(3)]
    out = jobs.fed(spark, slices, lambda s: jobs.drop_duplicates(s["captures"], keys).select(*keys, "day"), "duplicates")
    return out.where("session_id >= 0")
