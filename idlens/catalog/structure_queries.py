"""Registered queries: lines from boxes, grid join, sketches, VARIANT, table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from idlens.catalog.extract_queries import _NON_EMPTY
from idlens.catalog.page_queries import ASSEMBLED_SQL, KEYS, box_frame
from idlens.catalog.registry import field_frame, register, rel
from idlens.functions.sql import register_sql_functions
from idlens.operators import history as H
from idlens.operators.assemble import assemble_text
from idlens.operators.boxes import exclude_overlaps_by_grid, lines_from_boxes
from idlens.operators.sketches import estimates, rolled_up, sketches
from idlens.session import scratch_path
from idlens.streaming import jobs

# --- lines from boxes: two columns a page, boxes jittered and in no order --------------------


@register("agg1_text_from_boxes", f"WITH {ASSEMBLED_SQL.format(source='blocks')} SELECT doc_id, raw_text FROM pg", ("blocks",))
def _(spark, sf):
    blocks = rel(spark, sf, "blocks")
    pos = F.col("seq") % 100000
    right = F.col("line_num") >= 12  # the first lines of a page stand on the left
    x = F.when(right, 8_000_000).otherwise(0) + pos * 50
    y = F.when(right, F.col("line_num") - 12).otherwise(F.col("line_num")) * 20 + pos % 3
    boxed = blocks.withColumn("bbox", F.array(*[v.cast("int") for v in (x, y, x + 40, y + 14)])).drop("block_num", "line_num", "seq")
    return assemble_text(lines_from_boxes(boxed, KEYS, boxes=False), KEYS).select("doc_id", "raw_text")


@register("flt8_overlap_by_grid", """
SELECT b.doc_id, b.seq, b.x1, b.y1, b.x2, b.y2 FROM boxes b
WHERE NOT EXISTS (SELECT 1 FROM photos p WHERE b.doc_id = p.doc_id AND coalesce(least(b.x2, p.x2) > greatest(b.x1, p.x1) AND least(b.y2, p.y2) > greatest(b.y1, p.y1)
  AND (least(b.x2, p.x2) - greatest(b.x1, p.x1)) * (least(b.y2, p.y2) - greatest(b.y1, p.y1)) / ((b.x2 - b.x1) * (b.y2 - b.y1))::DOUBLE > 0.15::DOUBLE, false))""", ("boxes", "photos"))
def _(spark, sf):
    photos = rel(spark, sf, "photos").select("doc_id", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    kept = exclude_overlaps_by_grid(box_frame(spark, sf), photos, ["doc_id"])
    return kept.select("doc_id", "seq", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


# --- sketches: estimates held against exact values ---------------------------------------------

_EXACT_SQL = """SELECT epoch_ms(date_trunc('day', timestamp)) AS start_ms, document_type, count(*) AS n_scans, true AS holders_close, true AS risks_close FROM {source} GROUP BY ALL"""


def held_against(history, merged):
    """Whether the merged sketches' answers are close to the exact ones: 5 % of the holders,
    two hundredths of the rank."""
    told = estimates(merged)
    day = F.date_trunc("DAY", "timestamp").alias("start")
    rows = history.select(day, "document_type", "holder", "risk_score").join(told.select("start", "document_type", "risk_q50", "risk_q90"), ["start", "document_type"])
    exact = rows.groupBy("start", "document_type").agg(
        F.count_distinct("holder").alias("d"), F.avg((F.col("risk_score") < F.col("risk_q50")).cast("double")).alias("under50"),
        F.avg((F.col("risk_score") <= F.col("risk_q50")).cast("double")).alias("upto50"), F.avg((F.col("risk_score") < F.col("risk_q90")).cast("double")).alias("under90"),
        F.avg((F.col("risk_score") <= F.col("risk_q90")).cast("double")).alias("upto90"), F.count(F.lit(1)).alias("rows"))
    slack = 0.02 + 1 / F.col("rows")
    risks = (F.col("under50") <= 0.5 + slack) & (F.col("upto50") >= 0.5 - slack) & (F.col("under90") <= 0.9 + slack) & (F.col("upto90") >= 0.9 - slack)
    return told.join(exact, ["start", "document_type"]).select(
        F.unix_millis("start").alias("start_ms"), "document_type", "n_scans", (F.abs(F.col("n_holders") - F.col("d")) <= 0.05 * F.col("d") + 1).alias("holders_close"), risks.alias("risks_close"))


@register("agg17_sketch_rollup", _EXACT_SQL.format(source="history"), ("history",))
def _(spark, sf):
    history = rel(spark, sf, "history")
    path = scratch_path(spark, "sketches")
    sketches(history).write.parquet(path)  # stored by the hour, merged to days
    return held_against(history, rolled_up(spark.read.parquet(path)))


@register("str5_sketch_stream", _EXACT_SQL.format(source="history"), ("history",))
def _(spark, sf):
    history = rel(spark, sf, "history").select("timestamp", "document_type", "holder", "risk_score")
    middle = history.select(F.unix_micros("timestamp").alias("t")).approxQuantile("t", [0.5], 0.01)[0]
    early = F.unix_micros("timestamp") < int(middle)
    clock = history.limit(1).withColumns({"timestamp": F.expr("timestamp'2100-01-01 00:00:00'"), "document_type": F.lit("clock")})
    slices = [{"history": history.where(early)}, {"history": history.where(~early)}, {"history": clock}]
    stored = jobs.fed(spark, slices, lambda s: sketches(s["history"].withWatermark("timestamp", "1 hour")), "sketch-stream")
    return held_against(history, rolled_up(stored.where("document_type <> 'clock'")))


# --- VARIANT ---------------------------------------------------------------------------------------


@register("jsn1_variant_history", """WITH j AS (SELECT id, CASE WHEN json_valid(result) THEN result END AS r FROM loose_history)
SELECT id, r IS NOT NULL AS is_json, json_extract_string(r, '$.riskLevel') AS level, cast(json_extract(r, '$.riskScore') AS DOUBLE) AS score, cast(json_array_length(r, '$.checks') AS INT) AS n_checks,
  json_extract_string(r, '$.extra.deep[1].k') AS deep, cast(json_extract(r, '$.extra') AS VARCHAR) AS extra, NULL::VARCHAR AS absent FROM j""", ("loose_history",))
def _(spark, sf):
    v = H.as_variant(rel(spark, sf, "loose_history"), ("result",))
    return v.select("id", F.col("result").isNotNull().alias("is_json"), H.at_path("result", "$.riskLevel").alias("level"), H.at_path("result", "$.riskScore", "double").alias("score"),
                    F.size(H.at_path("result", "$.checks", "array<variant>")).alias("n_checks"), H.at_path("result", "$.extra.deep[1].k").alias("deep"),
                    F.to_json(H.at_path("result", "$.extra", "variant")).alias("extra"), H.at_path("result", "$.nowhere.at[3]").alias("absent"))


@register("jsn2_variant_checks", """SELECT document_type, json_extract_string(c, '$.status') AS status, count(*) AS n_checks FROM (
  SELECT document_type, unnest(cast(json_extract(result, '$.checks') AS JSON[])) AS c FROM loose_history WHERE json_valid(result)) AS x GROUP BY ALL""", ("loose_history",))
def _(spark, sf):
    return H.variant_checks_by_status(H.as_variant(rel(spark, sf, "loose_history"), ("result",)))


# --- table functions -----------------------------------------------------------------------------------


@register("udf1_table_fields", f"""WITH long AS ({_NON_EMPTY})
SELECT doc_id, count(*) AS n_fields, max(CASE WHEN key = 'name' THEN value END) AS name, max(CASE WHEN key = 'dob' THEN value END) AS dob FROM long GROUP BY doc_id""", ("field_wide",))
def _(spark, sf):
    register_sql_functions(spark)
    return spark.sql("""SELECT d.doc_id, count(*) AS n_fields, max(CASE WHEN f.key = 'name' THEN f.value END) AS name, max(CASE WHEN f.key = 'dob' THEN f.value END) AS dob
        FROM (SELECT doc_id, map_entries(fields_map) AS fields FROM {docs}) d, LATERAL kyc_fields(d.fields) f GROUP BY d.doc_id""", docs=field_frame(spark, sf))


@register("udf1_table_zones", """SELECT doc_id, unnest(['number', 'birth', 'expiry', 'optional']) AS field,
  replace(unnest([substr(line2, 1, 9), substr(line2, 14, 6), substr(line2, 22, 6), substr(line2, 29, 14)]), '<', '') AS value,
  unnest([substr(line2, 10, 1), substr(line2, 20, 1), substr(line2, 28, 1), substr(line2, 43, 1)]) AS digit FROM zone WHERE length(line2) = 44""", ("zone",))
def _(spark, sf):
    register_sql_functions(spark)
    return spark.sql("SELECT z.doc_id, f.field, f.value, f.digit FROM {zone} z, LATERAL kyc_zone_fields(z.line2) f", zone=rel(spark, sf, "zone"))
