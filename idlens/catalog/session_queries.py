"""Registered queries: sessions, history, identity, risk, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from idlens import rules
from idlens.catalog.registry import joined, register, rel
from idlens.functions.numbers import epoch_millis
from idlens.operators import history as H
from idlens.operators import sessions as S
from idlens.operators.risk import history_level, score_risk
from idlens.session import scratch_path
from idlens.sources import sinks
from idlens.streaming import jobs

# --- sides -----------------------------------------------------------------------------

_SIDE_FIELDS = ("name", "dob", "gender", "address")


def side_frame(spark, sf):
    r = rel(spark, sf, "side_results")
    return r.select("session_id", "seq", "document_type", "document_name", F.struct(*_SIDE_FIELDS).alias("fields"),
                    "qr_detected", "qr_data", "raw_ocr_text")


_FLAGS = """fl AS (SELECT *, coalesce(name, '') <> '' OR coalesce(dob, '') <> '' OR coalesce(gender, '') <> '' AS is_front, coalesce(address, '') <> '' OR qr_detected AS is_back FROM side_results)"""
PAIR_SQL = f"""{_FLAGS}, fr AS (SELECT session_id, min(seq) AS front_seq FROM fl WHERE is_front GROUP BY session_id),
bk AS (SELECT fl.session_id, min(seq) AS back_seq FROM fl LEFT JOIN fr ON fl.session_id = fr.session_id WHERE is_back AND seq IS DISTINCT FROM front_seq GROUP BY fl.session_id),
pr AS (SELECT coalesce(fr.session_id, bk.session_id) AS session_id, front_seq, back_seq FROM fr FULL JOIN bk ON fr.session_id = bk.session_id)"""
_FILLED = ", ".join(f"CASE WHEN coalesce(f.{c}, '') <> '' THEN f.{c} WHEN coalesce(b.{c}, '') <> '' THEN b.{c} ELSE f.{c} END AS {c}" for c in _SIDE_FIELDS)
MERGE_SQL = f"""{PAIR_SQL}, merged AS (SELECT f.session_id, f.seq, b.seq AS back_seq, f.document_type, f.document_name || ' (Front + Back Merged)' AS document_name, {_FILLED},
  f.raw_ocr_text || chr(10) || '--- BACK SIDE ---' || chr(10) || b.raw_ocr_text AS raw_ocr_text, b.qr_data AS back_qr_data
  FROM pr JOIN side_results f ON f.session_id = pr.session_id AND f.seq = front_seq JOIN side_results b ON b.session_id = pr.session_id AND b.seq = back_seq AND b.document_type = f.document_type)"""
_MERGED_COLUMNS = "session_id, seq, document_type, document_name, name, dob, gender, address, raw_ocr_text, back_qr_data"


@register("flt7_side_predicates", f"WITH {_FLAGS} SELECT seq, is_front, is_back FROM fl", ("side_results",))
def _(spark, sf):
    return side_frame(spark, sf).select("seq", S.front_like(F.col("fields")).alias("is_front"),
                                        S.back_like(F.col("fields"), F.col("qr_detected")).alias("is_back"))


@register("win4_first_sides", f"WITH {PAIR_SQL} SELECT * FROM pr", ("side_results",))
def _(spark, sf):
    return S.side_pairs(side_frame(spark, sf)).select("session_id", "front_seq", "back_seq")


def merged_rows(spark, sf):
    m = S.merge_sides(side_frame(spark, sf))
    return m.select("session_id", "seq", "document_type", "document_name", "fields.*", "raw_ocr_text", "back_qr_data")


@register("jn4_merged_sides", f"WITH {MERGE_SQL} SELECT {_MERGED_COLUMNS} FROM merged", ("side_results",))
def _(spark, sf):
    return merged_rows(spark, sf).where(F.col("document_name").endswith(S.MERGED_SUFFIX))


@register("set4_merged_and_others", f"""WITH {MERGE_SQL} SELECT {_MERGED_COLUMNS} FROM merged UNION ALL
SELECT session_id, seq, document_type, document_name, name, dob, gender, address, raw_ocr_text, NULL FROM side_results r
WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.session_id = r.session_id AND r.seq IN (m.seq, m.back_seq))""", ("side_results",))
def _(spark, sf):
    return merged_rows(spark, sf)


CONSOLIDATED_SQL = f"""f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM side_results WHERE seq % 2 = 0) AS x WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM side_results WHERE seq % 2 = 1) AS x WHERE rn = 1),
con AS (SELECT coalesce(f.session_id, b.session_id) AS session_id, coalesce(f.document_type, b.document_type) AS document_type,
  concat_ws('+', CASE WHEN f.seq IS NOT NULL THEN 'front' END, CASE WHEN b.seq IS NOT NULL THEN 'back' END) AS sides, {_FILLED} FROM f FULL JOIN b ON f.session_id = b.session_id)"""


def consolidated(spark, sf):
    rows = side_frame(spark, sf).select("session_id", "seq", "document_type", "fields")
    return S.consolidate(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))


@register("jn5_consolidated_sessions", f"WITH {CONSOLIDATED_SQL} SELECT * FROM con", ("side_results",))
def _(spark, sf):
    return consolidated(spark, sf).select("session_id", "document_type", "sides", "fields.*")


@register("snk2_consolidated_results", f"WITH {CONSOLIDATED_SQL} SELECT * FROM con", ("side_results",))
def _(spark, sf):
    path = scratch_path(spark, "consolidated")
    sinks.write_consolidated(consolidated(spark, sf), path)
    return spark.read.parquet(path).select("session_id", "document_type", "sides", "fields.*")


# --- captures -----------------------------------------------------------------------------


@register("win5_primary_capture", """SELECT session_id, capture_id, doc_type, suspicious FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY suspicious, seq) AS rn FROM captures) AS x WHERE rn = 1""", ("captures",))
def _(spark, sf):
    return S.primary_capture(rel(spark, sf, "captures")).select("session_id", "capture_id", "doc_type", "suspicious")


_ORDER = "list_position([" + ", ".join(f"'{t}'" for t in rules.CHECKLIST_TYPES) + "], doc_type)"


@register("win5_primary_checklist", f"""SELECT session_id, doc_type, file_name FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_ORDER}, file_name) AS rn FROM checklist WHERE status = 'scanned') AS x WHERE rn = 1""", ("checklist",))
def _(spark, sf):
    return S.primary_checklist(rel(spark, sf, "checklist")).select("session_id", "doc_type", "file_name")


@register("win9_latest_capture", """SELECT session_id, doc_type, side, capture_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, doc_type, side ORDER BY captured_at DESC, seq DESC) AS rn FROM captures) AS x WHERE rn = 1""", ("captures",))
def _(spark, sf):
    return S.latest_captures(rel(spark, sf, "captures"), ["session_id", "doc_type", "side"]).select("session_id", "doc_type", "side", "capture_id")


@register("flt4_removed_captures", """SELECT capture_id, session_id FROM captures WHERE capture_id NOT IN (SELECT 'c' || cast(event_id AS VARCHAR) FROM events WHERE value < 20)""", ("captures",))
def _(spark, sf):
    gone = rel(spark, sf, "events").where("value < 20").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("capture_id"))
    return S.remove_captures(rel(spark, sf, "captures"), gone).select("capture_id", "session_id")


@register("jn14_side_lookup", """SELECT session_id, doc_type, arg_min(CASE WHEN side IN ('front', 'single') THEN file_name END, CASE WHEN side IN ('front', 'single') THEN seq END) AS front_file,
  arg_min(CASE WHEN side = 'back' THEN file_name END, CASE WHEN side = 'back' THEN seq END) AS back_file FROM captures GROUP BY session_id, doc_type""", ("captures",))
def _(spark, sf):
    return S.side_lookup(rel(spark, sf, "captures"))


@register("jn16_already_captured", """SELECT session_id, doc_type, side FROM (SELECT DISTINCT session_id, doc_type, 'front' AS side FROM checklist) AS w
WHERE EXISTS (SELECT 1 FROM captures c WHERE c.session_id = w.session_id AND c.doc_type = w.doc_type AND c.side = w.side)""", ("checklist", "captures"))
def _(spark, sf):
    wanted = rel(spark, sf, "checklist").select("session_id", "doc_type").distinct().withColumn("side", F.lit("front"))
    return S.already_captured(wanted, rel(spark, sf, "captures"), ["session_id", "doc_type", "side"])


@register("agg18_suspicious_sessions", "SELECT session_id, bool_or(suspicious) AS any_suspicious, count(*) AS n_captures FROM captures GROUP BY session_id", ("captures",))
def _(spark, sf):
    return S.session_flags(rel(spark, sf, "captures"))


# --- checklists ------------------------------------------------------------------------------


@register("agg13_checklist_counts", "SELECT session_id, count(*) FILTER (status = 'scanned') AS n_scanned, count(*) FILTER (status = 'na') AS n_na, count(*) AS n_entries FROM checklist GROUP BY session_id", ("checklist",))
def _(spark, sf):
    return S.checklist_counts(rel(spark, sf, "checklist"))


@register("flt3_checklist_filters", "SELECT session_id, doc_type, status, file_name FROM checklist WHERE status IN ('scanned', 'na')", ("checklist",))
def _(spark, sf):
    c = rel(spark, sf, "checklist")
    return S.scanned_entries(c).unionByName(S.unavailable_entries(c)).select("session_id", "doc_type", "status", "file_name")


@register("jn12_missing_documents", f"""SELECT s.session_id, r.doc_type FROM (SELECT DISTINCT session_id FROM checklist) AS s CROSS JOIN (SELECT unnest([{', '.join(f"'{t}'" for t in rules.CHECKLIST_TYPES)}]) AS doc_type) AS r
WHERE NOT EXISTS (SELECT 1 FROM checklist c WHERE c.session_id = s.session_id AND c.doc_type = r.doc_type AND c.status = 'scanned')""", ("checklist",))
def _(spark, sf):
    return S.missing_documents(rel(spark, sf, "checklist"))


@register("jn13_field_layers", """WITH a AS (SELECT doc_id, 'name' AS key, nm AS value, 0 AS layer FROM base UNION ALL SELECT doc_id, 'dob', dob, 0 FROM base
  UNION ALL SELECT doc_id, 'name', name, 1 FROM claims WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'gender', gender, 1 FROM claims UNION ALL SELECT doc_id, 'dob', 'edited', 2 FROM base WHERE doc_id % 7 = 0)
SELECT doc_id, key, arg_max(value, layer) AS value, max(layer) AS layer FROM a GROUP BY doc_id, key""", ("base", "claims"))
def _(spark, sf):
    base, claims = rel(spark, sf, "base"), rel(spark, sf, "claims")

    def layer(df, **columns):
        return df.select("doc_id", F.explode(F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v)])).alias("key", "value"))

    server = layer(base, name=F.col("nm"), dob=F.col("dob"))
    client = layer(claims, gender=F.col("gender")).unionByName(layer(claims.where("doc_id % 2 = 0"), name=F.col("name")))
    edits = layer(base.where("doc_id % 7 = 0"), dob=F.lit("edited"))
    return S.layer_fields([server, client, edits], ["doc_id"])


@register("set1_union_of_results", "SELECT doc_id, nm AS name, NULL AS id_number, dob FROM base UNION ALL SELECT doc_id, name, id_number, NULL FROM claims", ("base", "claims"))
def _(spark, sf):
    a = rel(spark, sf, "base").select("doc_id", F.col("nm").alias("name"), "dob")
    b = rel(spark, sf, "claims").select("doc_id", "name", "id_number")
    return S.union_results([a, b])


# --- users and records ---------------------------------------------------------------------------


@register("jn11_user_documents", "SELECT u.id, u.name AS user_name, r.record_id, r.doc_type FROM users u JOIN records r ON u.id = r.user_id", ("users", "records"))
def _(spark, sf):
    users = rel(spark, sf, "users").withColumnRenamed("name", "user_name")
    return H.user_documents(users, rel(spark, sf, "records")).select("id", "user_name", "record_id", "doc_type")


@register("agg12_user_risk", """SELECT u.id, coalesce(round(avg(r.risk_score), 6), 15.0) AS average_risk_score, count(r.record_id) AS n_documents, coalesce(bool_and(r.is_verified), false) AS all_verified
FROM users u LEFT JOIN records r ON u.id = r.user_id GROUP BY u.id""", ("users", "records"))
def _(spark, sf):
    return H.user_risk(rel(spark, sf, "users"), rel(spark, sf, "records")).withColumn(
        "average_risk_score", F.round("average_risk_score", 6))


@register("agg15_identity_consistency", """SELECT *, n_names <= 1 AND n_dobs <= 1 AS consistent FROM (SELECT user_id, count(DISTINCT lower(trim(regexp_replace(name, '\\s+', ' ', 'g')))) AS n_names,
  count(DISTINCT dob) AS n_dobs, count(*) AS n_documents FROM records GROUP BY user_id) AS x""", ("records",))
def _(spark, sf):
    return H.identity_consistency(rel(spark, sf, "records"))


@register("agg16_reused_ids", """SELECT doc_type, upper(regexp_replace(id_number, '[-\\s]', '', 'g')) AS id_number, count(DISTINCT user_id) AS n_users FROM records GROUP BY ALL HAVING count(DISTINCT user_id) > 1""", ("records",))
def _(spark, sf):
    return H.reused_ids(rel(spark, sf, "records"))


# --- history -----------------------------------------------------------------------------------------


@register("agg17_history_rollup", """SELECT document_type, risk_level, cast(grouping_id(document_type, risk_level) AS INT) AS level, count(*) AS n_scans, round(avg(risk_score), 6) AS mean_risk
FROM history GROUP BY ROLLUP (document_type, risk_level)""", ("history",))
def _(spark, sf):
    return H.history_rollup(rel(spark, sf, "history")).withColumn("mean_risk", F.round("mean_risk", 6))


@register("win10_risk_trend", """SELECT id, holder, round(risk_score - lag(risk_score) OVER w, 6) AS risk_change, round(avg(risk_score) OVER (PARTITION BY holder ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING), 6) AS running_mean
FROM history WINDOW w AS (PARTITION BY holder ORDER BY timestamp, id)""", ("history",))
def _(spark, sf):
    h = rel(spark, sf, "history").select("id", "holder", "timestamp", "risk_score")
    return H.risk_trend(h).select("id", "holder", F.round("risk_change", 6).alias("risk_change"), F.round("running_mean", 6).alias("running_mean"))


@register("jsn1_history_json", """SELECT id, json_extract_string(result, '$.riskLevel') AS level, cast(json_extract(result, '$.riskScore') AS DOUBLE) AS score, cast(json_array_length(result, '$.checks') AS INT) AS n_checks,
  json_extract_string(extracted_fields, '$.name') AS name, json_extract_string(saved_paths, '$.front') AS front FROM history""", ("history",))
def _(spark, sf):
    p = H.parse_history(rel(spark, sf, "history"))
    return p.select("id", F.col("result_parsed.riskLevel").alias("level"), F.col("result_parsed.riskScore").alias("score"),
                    F.size("result_parsed.checks").alias("n_checks"), F.col("fields_parsed")["name"].alias("name"), F.col("paths_parsed")["front"].alias("front"))


@register("jsn2_checks_by_status", """SELECT document_type, json_extract_string(c, '$.status') AS status, count(*) AS n_checks FROM (
  SELECT document_type, unnest(cast(json_extract(result, '$.checks') AS JSON[])) AS c FROM history) AS x GROUP BY ALL""", ("history",))
def _(spark, sf):
    return H.checks_by_status(rel(spark, sf, "history"))


# --- risk ------------------------------------------------------------------------------------------------

FACTS_SQL = f"""facts AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'passport' WHEN 'signup' THEN 'aadhaar' WHEN 'click' THEN 'dl' WHEN 'error' THEN 'visa' ELSE 'aadhaar' END AS doc_type,
  event_id % 5 = 0 AS tampered, event_id % 7 <> 0 AS face_matched, event_id % 3 <> 0 AS is_valid, event_id % 4 <> 0 AS mrz_valid, event_id % 2 = 0 AS ekyc_skipped, event_id % 2 = 1 AND value > 30 AS ekyc_verified FROM events),
fb AS (SELECT *, tampered OR NOT face_matched OR NOT is_valid AS bad, doc_type = 'aadhaar' AND ekyc_skipped AS skipped FROM facts),
fs AS (SELECT *, cast(CASE WHEN bad THEN CASE WHEN skipped THEN least(96, 70 + (event_id * 7919) % 16 + 10) ELSE 70 + (event_id * 7919) % 16 END
  WHEN skipped THEN 42 + (event_id * 7919) % 9 ELSE 18 + (event_id * 7919) % 11 END AS INT) AS risk_score FROM fb)"""


def fact_frame(spark, sf):
    e = F.col("event_id")
    kind = (F.when(F.col("event_type") == "view", "passport").when(F.col("event_type") == "signup", "aadhaar")
            .when(F.col("event_type") == "click", "dl").when(F.col("event_type") == "error", "visa").otherwise("aadhaar"))
    none = F.array().cast("array<string>")
    return rel(spark, sf, "events").select(
        "event_id", kind.alias("doc_type"), (e % 5 == 0).alias("tampered"), (e % 7 != 0).alias("face_matched"), (e % 3 != 0).alias("is_valid"),
        (e % 4 != 0).alias("mrz_valid"), (e % 2 == 0).alias("ekyc_skipped"), ((e % 2 == 1) & (F.col("value") > 30)).alias("ekyc_verified"),
        F.when(e % 10 == 0, F.array(F.lit("Edited photo"), F.lit("x"))).otherwise(none).alias("anomalies"),
        F.when(e % 6 == 0, F.array(F.lit("bank_statement"), F.lit("proof_of_address"))).alias("na_types"))


@register("rsk1_risk_score", f"WITH {FACTS_SQL} SELECT event_id, risk_score, CASE WHEN bad OR skipped THEN 'REVIEW REQUIRED' ELSE 'ACCEPTED' END AS risk_level FROM fs")
def _(spark, sf):
    return score_risk(fact_frame(spark, sf), "event_id").select("event_id", "risk_score", "risk_level")


_BAD_CHECKS = """list_filter(['ocr:passed:All primary fields extracted successfully', 'tampering:warning:' || CASE WHEN event_id % 10 = 0 THEN 'Edited photo' ELSE 'Digital boundary artifact detected' END,
  CASE WHEN face_matched THEN 'face:passed:Confidence: 96%' ELSE 'face:warning:Confidence below threshold (42%)' END, CASE WHEN mrz_valid THEN 'doc:passed:Checksum valid' ELSE 'doc:failed:Checksum mismatch' END,
  CASE WHEN skipped THEN 'ekyc:warning:Demographic authentication bypassed — identity unconfirmed (+10% risk penalty)' END], lambda x: x IS NOT NULL)"""
_GOOD_CHECKS = """list_filter(['doc_info:passed:Format, fields and issuing entity verified', 'integrity:passed:' || CASE WHEN doc_type IN ('passport', 'visa') THEN 'Standard ICAO 9303 checksum passed' ELSE 'Cryptographic signature valid' END,
  'face:passed:Biometric similarity score 96%', 'tamper:passed:Clean font consistency, no pixel interpolation anomalies',
  CASE WHEN doc_type = 'aadhaar' AND ekyc_verified THEN 'ekyc:passed:Name, DOB and Gender matched UIDAI record' WHEN skipped THEN 'ekyc:warning:Demographic authentication bypassed — identity unconfirmed (+20% risk factor)' END], lambda x: x IS NOT NULL)"""
_CHECKS_SQL = f"CASE WHEN bad THEN {_BAD_CHECKS} ELSE {_GOOD_CHECKS} END"
_NA = "Document not available — logged as N/A by officer"
_ALL_CHECKS_SQL = f"list_concat({_CHECKS_SQL}, CASE WHEN event_id % 6 = 0 THEN ['na_bank_statement:warning:{_NA}', 'na_proof_of_address:warning:{_NA}'] ELSE [] END)"


def check_texts(spark, sf):
    scored = score_risk(fact_frame(spark, sf), "event_id")
    return scored.select("event_id", F.transform("checks", lambda c: F.concat_ws(":", c["id"], c["status"], c["detail"])).alias("c"),
                         F.transform("checks", lambda c: c["title"]).alias("t"))


@register("rsk2_audit_checks", f"WITH {FACTS_SQL} SELECT event_id, array_to_string({_ALL_CHECKS_SQL}, '|') AS checks FROM fs")
def _(spark, sf):
    return check_texts(spark, sf).select("event_id", joined(F.col("c")).alias("checks"))


@register("set2_na_notes", f"""WITH {FACTS_SQL} SELECT event_id, array_to_string({_ALL_CHECKS_SQL}, '|') AS checks,
  CASE WHEN event_id % 6 = 0 THEN 'proof of_address not produced' END AS last_note FROM fs""")
def _(spark, sf):
    return check_texts(spark, sf).select("event_id", joined(F.col("c")).alias("checks"),
                                         F.when(F.col("event_id") % 6 == 0, F.element_at("t", -1)).alias("last_note"))


@register("rsk3_history_level", f"WITH {FACTS_SQL} SELECT history_level, count(*) AS n FROM (SELECT CASE WHEN risk_score < 40 THEN 'LOW' WHEN risk_score < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS history_level FROM fs) AS x GROUP BY ALL")
def _(spark, sf):
    scored = score_risk(fact_frame(spark, sf), "event_id")
    return scored.groupBy(history_level(F.col("risk_score")).alias("history_level")).agg(F.count(F.lit(1)).alias("n"))


# --- streams: everything there is, read as a stream, results from its files ------------------------------


def stream_of(spark, sf, name):
    """The derived relation staged as files and read back as a stream."""
    batch = rel(spark, sf, name)
    path = scratch_path(spark, name)
    batch.write.parquet(path)
    return jobs.read_stream(spark, path, batch.schema)


# windows are reported once the watermark (newest event minus the delay) has passed them
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@register("str2_session_pairs", f"""WITH g AS (SELECT *, CASE WHEN captured_at - lag(captured_at) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM captures WINDOW w AS (PARTITION BY session_id ORDER BY captured_at, seq)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY captured_at, seq ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT session_id, epoch_us(min(captured_at)) // 1000 AS start_ms, arg_min(CASE WHEN side = 'front' THEN capture_id END, CASE WHEN side = 'front' THEN seq END) AS front_capture,
  arg_min(CASE WHEN side = 'back' THEN capture_id END, CASE WHEN side = 'back' THEN seq END) AS back_capture, count(*) AS n_captures
FROM s GROUP BY session_id, grp HAVING max(captured_at) + INTERVAL 30 MINUTE <= {_CLOSED}""", ("captures",))
def _(spark, sf):
    out = jobs.drained(spark, jobs.pair_sessions(stream_of(spark, sf, "captures")), "sessions")
    return out.select("session_id", epoch_millis(F.col("window_start")).alias("start_ms"), "front_capture", "back_capture", "n_captures")


@register("str4_history_sink", "SELECT id, holder, document_type, risk_score FROM history", ("history",))
def _(spark, sf):
    path = scratch_path(spark, "history-sink")
    writer = jobs.history_writer(f"{path}/out")
    stream = stream_of(spark, sf, "history").select("id", "holder", "document_type", "risk_score")

    def replayed(batch, batch_id):
        # a failed batch is handed over again under the same id
        writer(batch, batch_id)
        writer(batch, batch_id)

    jobs.run_to_batches(stream, replayed, f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("id", "holder", "document_type", "risk_score")


def _monitor_sql(slide_minutes: int) -> str:
    starts = " UNION ALL ".join(
        f"SELECT *, time_bucket(INTERVAL {slide_minutes} MINUTE, timestamp) - INTERVAL {i * slide_minutes} MINUTE AS s FROM history" for i in range(60 // slide_minutes))
    return f"""WITH w AS ({starts}) SELECT epoch_us(s) // 1000 AS start_ms, document_type, risk_level, count(*) AS n_scans, round(avg(risk_score), 6) AS mean_risk FROM w
WHERE s + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY ALL"""


@register("str5_risk_monitor", _monitor_sql(60), ("history",))
def _(spark, sf):
    out = jobs.drained(spark, jobs.risk_monitor(stream_of(spark, sf, "history")), "monitor")
    return out.select(epoch_millis(F.col("window_start")).alias("start_ms"), "document_type", "risk_level", "n_scans", F.round("mean_risk", 6).alias("mean_risk"))


@register("str5_sliding_monitor", _monitor_sql(15), ("history",))
def _(spark, sf):
    out = jobs.drained(spark, jobs.risk_monitor(stream_of(spark, sf, "history"), slide="15 minutes"), "sliding")
    return out.select(epoch_millis(F.col("window_start")).alias("start_ms"), "document_type", "risk_level", "n_scans", F.round("mean_risk", 6).alias("mean_risk"))
