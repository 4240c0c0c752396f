"""Registered queries: sources, sinks, page assembly, layout, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from idlens import rules
from idlens.catalog.inputs import FIELD_COLUMNS
from idlens.catalog.registry import field_frame, joined, kind_sql, register, rel, strip_sql
from idlens.functions.numbers import epoch_millis
from idlens.operators import assemble as A
from idlens.operators import fields as P
from idlens.operators import layout as L
from idlens.operators.extract import fields_long
from idlens.operators.history import newest_first
from idlens.operators.risk import history_items
from idlens.plans.batch import first_pages
from idlens.session import scratch_path
from idlens.sources import readers, sinks

KEYS = ["doc_id", "page_number"]

# --- sources -------------------------------------------------------------------------

_EXT = r"lower(regexp_extract(file_name, '[^/](\.[^./]*)$', 1))"
_OK = "(" + ", ".join(f"'{e}'" for e in (*rules.IMAGE_EXTENSIONS, *rules.DOCUMENT_EXTENSIONS)) + ")"


@register("src1_manifest", f"""
SELECT doc_id, file_name, extension, extension IN {_OK} AS accepted, CASE WHEN extension NOT IN {_OK} THEN 'Unsupported file format ''' || extension || '''.' END AS error
FROM (SELECT doc_id, file_name, {_EXT} AS extension FROM kyc) AS x""", ("kyc",))
def _(spark, sf):
    return A.screen_files(rel(spark, sf, "kyc").select("doc_id", "file_name"))


@register("src2_pages", """
SELECT doc_id, i AS page_number, pages[i] AS page FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS i FROM (
  SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents) AS a) AS b""")
def _(spark, sf):
    docs = rel(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("pages"))
    return A.expand_pages(docs).withColumn("page_number", F.col("page_number").cast("bigint"))


@register("src3_blocks", "SELECT doc_id, seq, text, confidence FROM line_blocks", ("line_blocks",))
def _(spark, sf):
    nested = rel(spark, sf, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        i.cast("bigint").alias("seq"), x.alias("text"),
        ((F.col("doc_id") * 7 + i * 13) % 101).cast("double").alias("confidence"))).alias("blocks"))
    path = scratch_path(spark, "ocr")
    nested.write.parquet(path)
    stored = spark.read.schema(nested.schema).parquet(path)
    return A.flatten_blocks(stored)


@register("src4_registry", "SELECT doc_type, id_number, name, dob, gender, status FROM registry", ("registry",))
def _(spark, sf):
    path = scratch_path(spark, "registry")
    rows = rel(spark, sf, "registry")
    paths = {"lost": f"{path}/none"}
    for kind, column in readers._ID_OF_TYPE.items():
        rows.where(F.col("doc_type") == kind).select(
            "name", "dob", "gender", "status", F.col("id_number").alias(column)).write.json(f"{path}/{kind}")
        paths[kind] = f"{path}/{kind}"
    return readers.read_registry(spark, paths, multi_line=False).drop("attrs")


@register("src5_history_scan", "SELECT id, holder, document_type, risk_level, risk_score, epoch_us(timestamp) // 1000 AS millis FROM history", ("history",))
def _(spark, sf):
    path = scratch_path(spark, "history")
    rel(spark, sf, "history").write.parquet(path)
    return readers.read_history(spark, path).select(
        "id", "holder", "document_type", "risk_level", "risk_score", epoch_millis(F.col("timestamp")).alias("millis"))


@register("src6_request_defaults", """
SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, 'aadhaar') AS document_type, coalesce(CASE WHEN event_id % 4 = 0 THEN 'tesseract' END, 'auto') AS engine_pref,
  coalesce(CASE WHEN event_id % 5 <> 0 THEN value END, 15.0) AS average_risk_score, 'Unknown' AS name FROM events""")
def _(spark, sf):
    requests = rel(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("document_type"),
        F.when(F.col("event_id") % 4 == 0, "tesseract").alias("engine_pref"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("average_risk_score"))
    return P.with_defaults(requests, rules.REQUEST_DEFAULTS)


# --- assembling text ---------------------------------------------------------------------

_KEPT = f"length({strip_sql('text')}) > 0 AND (engine <> 'tesseract' OR confidence > 0)"


@register("flt1_kept_words", f"""
SELECT doc_id, count(*) AS n_words, cast(sum(length({strip_sql('text')})) AS BIGINT) AS n_chars FROM blocks WHERE {_KEPT} GROUP BY doc_id""", ("blocks",))
def _(spark, sf):
    return A.kept_words(rel(spark, sf, "blocks")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum(F.length("text")).alias("n_chars"))


ASSEMBLED_SQL = f"""kept AS (SELECT *, {_KEPT} AS k, {strip_sql('text')} AS w FROM {{source}}),
ln AS (SELECT doc_id, coalesce(block_num, -1) AS b, coalesce(line_num, seq) AS l, min(seq) FILTER (k) AS f, string_agg(w, ' ' ORDER BY seq) FILTER (k) AS line,
  sum(confidence) FILTER (k) AS cs, count(*) FILTER (k) AS n FROM kept GROUP BY ALL),
pg AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY f) FILTER (n > 0), '') AS raw_text, coalesce(round_even(sum(cs) / nullif(sum(n), 0), 2), 0) AS confidence_score,
  cast(sum(n) AS BIGINT) AS text_blocks_count FROM ln GROUP BY doc_id)"""


@register("agg1_page_text", f"WITH {ASSEMBLED_SQL.format(source='blocks')} SELECT doc_id, raw_text FROM pg", ("blocks",))
def _(spark, sf):
    return A.assemble_text(rel(spark, sf, "blocks"), KEYS).select("doc_id", "raw_text")


@register("agg2_page_text_without_lines", f"WITH {ASSEMBLED_SQL.format(source='line_blocks')} SELECT doc_id, raw_text FROM pg", ("line_blocks",))
def _(spark, sf):
    return A.assemble_text(rel(spark, sf, "line_blocks"), KEYS).select("doc_id", "raw_text")


@register("agg3_mean_confidence", f"WITH {ASSEMBLED_SQL.format(source='blocks')} SELECT doc_id, confidence_score FROM pg", ("blocks",))
def _(spark, sf):
    return A.assemble_text(rel(spark, sf, "blocks"), KEYS).select("doc_id", "confidence_score")


@register("agg4_block_count", f"WITH {ASSEMBLED_SQL.format(source='blocks')} SELECT doc_id, text_blocks_count FROM pg", ("blocks",))
def _(spark, sf):
    return A.assemble_text(rel(spark, sf, "blocks"), KEYS).select("doc_id", "text_blocks_count")


@register("win2_engine_choice", f"""WITH r AS (SELECT *, CASE engine WHEN 'paddleocr' THEN 0 WHEN 'easyocr' THEN 1 ELSE 2 END AS rk FROM ocr),
p AS (SELECT DISTINCT doc_id FROM ocr), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS rn FROM r WHERE length({strip_sql('raw_text')}) > 10)
SELECT p.doc_id, coalesce(engine, 'fallback') AS engine, coalesce(raw_text, '') AS raw_text, coalesce(confidence_score, 85.0) AS confidence_score FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND rn = 1""", ("ocr",))
def _(spark, sf):
    return A.pick_engine(rel(spark, sf, "ocr"), KEYS).drop("page_number")


# --- layout ----------------------------------------------------------------------------------

_BACK = " OR ".join(f"contains(upper(raw_text), '{w}')" for w in rules.CARD_BACK_WORDS)
_LETTER = " OR ".join(f"contains(upper(raw_text), '{w}')" for w in rules.LETTER_ANCHORS)
SUBTYPE_SQL = f"""CASE WHEN width / height::DOUBLE <= 0.88::DOUBLE OR (height > width * 1.15::DOUBLE AND ({_LETTER})) THEN 'full_e_aadhaar'
  WHEN width / height::DOUBLE >= 1.7::DOUBLE THEN 'cut_out_dual_card' WHEN width / height::DOUBLE < 1.18::DOUBLE THEN 'stacked_dual_card'
  WHEN ({_BACK}) AND NOT has_face THEN 'single_card_back' ELSE 'single_card_front' END"""


@register("flt5_layout_subtype", f"SELECT doc_id, {SUBTYPE_SQL} AS subtype FROM page_sizes", ("page_sizes",))
def _(spark, sf):
    return rel(spark, sf, "page_sizes").select("doc_id", L.layout_subtype(
        F.col("width"), F.col("height"), F.col("has_face"), F.col("raw_text")).alias("subtype"))


@register("flt6_side", f"""SELECT doc_id, CASE WHEN lower(doc_type) IN ('passport', 'visa') THEN 'front' WHEN s = 'single_card_front' THEN 'front' WHEN s = 'single_card_back' THEN 'back' ELSE 'full_page' END AS side
FROM (SELECT doc_id, doc_type, {SUBTYPE_SQL} AS s FROM page_sizes) AS x""", ("page_sizes",))
def _(spark, sf):
    subtype = L.layout_subtype(F.col("width"), F.col("height"), F.col("has_face"), F.col("raw_text"))
    return rel(spark, sf, "page_sizes").select("doc_id", L.infer_side(F.col("doc_type"), subtype).alias("side"))


def box_frame(spark, sf):
    return rel(spark, sf, "boxes").select("doc_id", "page_number", "seq", "text", F.array("x1", "y1", "x2", "y2").alias("bbox"))


@register("flt8_overlap_exclusion", """
SELECT b.doc_id, b.seq, b.x1, b.y1, b.x2, b.y2 FROM boxes b
WHERE NOT EXISTS (SELECT 1 FROM photos p WHERE b.doc_id = p.doc_id AND coalesce(least(b.x2, p.x2) > greatest(b.x1, p.x1) AND least(b.y2, p.y2) > greatest(b.y1, p.y1)
  AND (least(b.x2, p.x2) - greatest(b.x1, p.x1)) * (least(b.y2, p.y2) - greatest(b.y1, p.y1)) / ((b.x2 - b.x1) * (b.y2 - b.y1))::DOUBLE > 0.15::DOUBLE, false))""", ("boxes", "photos"))
def _(spark, sf):
    photos = rel(spark, sf, "photos").select("doc_id", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    kept = L.exclude_overlaps(box_frame(spark, sf), photos, ["doc_id"])
    return kept.select("doc_id", "seq", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


_ADDR = "|".join(rules.ADDRESS_WORDS)


def region_sql(kind: str) -> str:
    if kind == "address":
        hit = f"regexp_matches(upper(text), '{_ADDR}|\\b[0-9]{{6}}\\b') AND b.x1 < p.width * 0.68::DOUBLE"
        margins, right, least_size = (15, 15, 20, 25), "cast(floor(width * 0.68::DOUBLE) AS INT)", (40, 30)
    else:
        hit = "(contains(text, 'P<') OR contains(text, 'V<') OR contains(upper(text), 'IND') OR regexp_matches(upper(text), '[A-Z0-9<]{10,44}')) AND b.y1 > p.height * 0.6::DOUBLE"
        margins, right, least_size = (10, 10, 10, 10), "width", (100, 20)
    return f"""hull AS (SELECT b.doc_id, min(b.x1) AS x1, min(b.y1) AS y1, max(b.x2) AS x2, max(b.y2) AS y2 FROM boxes b JOIN box_pages p ON b.doc_id = p.doc_id WHERE {hit} GROUP BY b.doc_id),
framed AS (SELECT p.doc_id, p.width, p.height, p.subtype, greatest(0, x1 - {margins[0]}) AS a, greatest(0, y1 - {margins[1]}) AS b, least({right}, x2 + {margins[2]}) AS c, least(height, y2 + {margins[3]}) AS d, x1
  FROM box_pages p LEFT JOIN hull h ON p.doc_id = h.doc_id),
region AS (SELECT *, coalesce(x1 IS NOT NULL AND c - a > {least_size[0]} AND d - b > {least_size[1]}, false) AS good FROM framed)"""


def _box_text(values: list[str]) -> str:
    return " || ',' || ".join(f"cast({v} AS VARCHAR)" for v in values)


def _fraction_sql(f) -> str:
    return _box_text([f"cast(floor({side} * {x}::DOUBLE) AS INT)" for side, x in (("width", f[0]), ("height", f[1]), ("width", f[2]), ("height", f[3]))])


_DEFAULT_ADDRESS = "CASE " + " ".join(
    f"WHEN subtype = '{k}' THEN {_fraction_sql(v)}" for k, v in rules.ADDRESS_REGION_DEFAULTS.items() if k) + f" ELSE {_fraction_sql(rules.ADDRESS_REGION_DEFAULTS[None])} END"
_GOOD_BOX = _box_text(["a", "b", "c", "d"])


def regions(spark, sf, kind):
    r = L.region_boxes(box_frame(spark, sf), rel(spark, sf, "box_pages"), KEYS, kind)
    return r.select("doc_id", "box_source", joined(F.transform("box", lambda v: v.cast("string")), ",").alias("box"))


@register("agg6_address_box", f"WITH {region_sql('address')} SELECT doc_id, {_GOOD_BOX} AS box FROM region WHERE good", ("boxes", "box_pages"))
def _(spark, sf):
    return regions(spark, sf, "address").where("box_source = 'blocks'").drop("box_source")


@register("agg7_mrz_box", f"WITH {region_sql('mrz')} SELECT doc_id, CASE WHEN good THEN 'blocks' ELSE 'default' END AS box_source, CASE WHEN good THEN {_GOOD_BOX} ELSE {_fraction_sql(rules.MRZ_REGION_DEFAULT)} END AS box FROM region", ("boxes", "box_pages"))
def _(spark, sf):
    return regions(spark, sf, "mrz")


@register("agg8_fallback_box", f"WITH {region_sql('address')} SELECT doc_id, {_DEFAULT_ADDRESS} AS box FROM region WHERE NOT good", ("boxes", "box_pages"))
def _(spark, sf):
    return regions(spark, sf, "address").where("box_source = 'default'").drop("box_source")


def _rules_sql() -> str:
    rows = ", ".join(f"('{t}', '{s}', {p}, {c}, {m}, '{','.join(f)}')" for t, s, p, c, m, f in rules.SIDE_RULES)
    return f"sr(rule_type, rule_side, photo, qr, mrz, fields) AS (VALUES {rows})"


@register("jn6_side_rules", f"""WITH {_rules_sql()}, k AS (SELECT seq, side, {kind_sql('doc_type')} AS kind FROM captures),
t AS (SELECT seq, side, CASE WHEN kind IN (SELECT rule_type FROM sr) THEN kind ELSE 'aadhaar' END AS kind FROM k),
u AS (SELECT seq, kind, CASE WHEN EXISTS (SELECT 1 FROM sr WHERE rule_type = kind AND rule_side = side) THEN side ELSE 'full_page' END AS side FROM t)
SELECT seq, rule_type, rule_side, photo AS extract_photo, qr AS extract_qr, mrz AS extract_mrz, fields AS target_fields FROM u JOIN sr ON kind = rule_type AND side = rule_side""", ("captures",))
def _(spark, sf):
    out = L.apply_side_rules(rel(spark, sf, "captures"), rules.side_rule_frame(spark))
    return out.select("seq", "rule_type", "rule_side", "extract_photo", "extract_qr", "extract_mrz", joined(F.col("target_fields"), ",").alias("target_fields"))


_LONG = " UNION ALL ".join(f"SELECT doc_id, doc_type, '{c}' AS key, {c} AS value FROM field_wide WHERE {c} <> ''" for c in FIELD_COLUMNS)


@register("jn8_target_fields", f"""WITH {_rules_sql()}, long AS ({_LONG}), s AS (SELECT *, CASE doc_id % 2 WHEN 0 THEN 'front' ELSE 'back' END AS side FROM long)
SELECT doc_id, key, value FROM s WHERE EXISTS (SELECT 1 FROM sr WHERE rule_type = {kind_sql('doc_type')} AND rule_side = side AND list_contains(string_split(fields, ','), key))""", ("field_wide",))
def _(spark, sf):
    long = fields_long(field_frame(spark, sf), ["doc_id", "doc_type"])
    sided = long.withColumn("side", F.when(F.col("doc_id") % 2 == 0, "front").otherwise("back"))
    return L.keep_target_fields(sided, rules.side_rule_frame(spark)).select("doc_id", "key", "value")


# --- projections of fields ------------------------------------------------------------------------


def _ui_sql() -> str:
    parts = []
    for kind, entries in rules.UI_FIELDS.items():
        for key, label, sources, confidence, always in entries:
            known = [s for s in sources if s in FIELD_COLUMNS]
            value = "coalesce(" + ", ".join([*(f"nullif({s}, '')" for s in known), "''"]) + ")"
            parts.append(f"SELECT doc_id, '{key}' AS key, '{label}' AS label, {value} AS value, CASE WHEN {value} <> '' THEN {confidence} ELSE 0 END AS confidence "
                         f"FROM field_wide WHERE {kind_sql('doc_type')} = '{kind}'" + ("" if always else f" AND {value} <> ''"))
    return " UNION ALL ".join(parts)


def ui_rows(spark, sf):
    f = field_frame(spark, sf)
    return f.select("doc_id", F.inline(P.ui_fields(F.col("doc_type"), F.col("fields")))).drop("editable")


@register("prj3_ui_fields", _ui_sql(), ("field_wide",))
def _(spark, sf):
    return ui_rows(spark, sf)


@register("flt2_low_confidence", f"WITH ui AS ({_ui_sql()}) SELECT doc_id, key, confidence, confidence < 90 AS low_confidence FROM ui", ("field_wide",))
def _(spark, sf):
    return P.with_low_confidence(ui_rows(spark, sf)).select("doc_id", "key", "confidence", "low_confidence")


_TITLE = "array_to_string(list_transform(string_split(key, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_EXCLUDED = "(" + ", ".join(f"'{k}'" for k in rules.UI_PASSTHROUGH_EXCLUDED) + ")"


@register("prj4_passthrough_fields", f"WITH long AS ({_LONG}) SELECT doc_id, key, {_TITLE} AS label, value, 95 AS confidence FROM long WHERE key NOT IN {_EXCLUDED}", ("field_wide",))
def _(spark, sf):
    return field_frame(spark, sf).select("doc_id", F.inline(P.passthrough_fields(F.col("fields_map")))).drop("editable")


@register("prj5_display_rows", f"WITH long AS ({_LONG}) SELECT doc_id, {_TITLE} AS label, value FROM long WHERE key NOT IN ('mrz_raw', 'immigration_stamps')", ("field_wide",))
def _(spark, sf):
    return P.display_rows(field_frame(spark, sf), ["doc_id"])


@register("prj6_revalidation_keys", f"""SELECT doc_id, CASE kind WHEN 'aadhaar' THEN nullif(aadhaar_number, '') WHEN 'passport' THEN nullif(passport_number, '') WHEN 'visa' THEN nullif(visa_number, '') ELSE nullif(dl_number, '') END AS number,
  CASE WHEN kind <> 'visa' THEN nullif(name, '') END AS name, CASE WHEN kind = 'aadhaar' THEN nullif(dob, '') END AS dob,
  CASE WHEN kind = 'passport' THEN nullif(mrz_raw, '') END AS mrz_raw FROM (SELECT *, {kind_sql('doc_type')} AS kind FROM field_wide) AS x""", ("field_wide",))
def _(spark, sf):
    f = field_frame(spark, sf)
    shown = F.map_from_entries(F.transform(P.ui_fields(F.col("doc_type"), F.col("fields")), lambda e: F.struct(e["key"], e["value"])))
    back = f.select("doc_id", P.revalidation_fields(F.col("doc_type"), shown).alias("m"))

    def get(key):
        return F.try_element_at("m", F.lit(key))

    return back.select(
        "doc_id", F.coalesce(*[get(k) for k in ("aadhaar_number", "passport_number", "visa_number", "dl_number")]).alias("number"),
        get("name").alias("name"), get("dob").alias("dob"), get("mrz_raw").alias("mrz_raw"))


@register("prj7_history_items", """SELECT doc_id, coalesce(nullif(name, ''), 'Unknown Name') AS holder_name,
  coalesce(nullif(passport_number, ''), nullif(aadhaar_number, ''), nullif(dl_number, ''), nullif(visa_number, ''), 'Unknown ID') AS identifier FROM field_wide""", ("field_wide",))
def _(spark, sf):
    return history_items(field_frame(spark, sf)).select("doc_id", "holder_name", "identifier")


# --- order and first pages ---------------------------------------------------------------------------


@register("srt1_newest_first", "SELECT id, holder, epoch_us(timestamp) // 1000 AS millis FROM history ORDER BY timestamp DESC, id DESC LIMIT 100", ("history",))
def _(spark, sf):
    return newest_first(rel(spark, sf, "history"), 100).select("id", "holder", epoch_millis(F.col("timestamp")).alias("millis"))


@register("srt2_first_page", "SELECT doc_id, page_number, text FROM (SELECT doc_id, cast(seq + 1 AS BIGINT) AS page_number, text, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM line_blocks) AS x WHERE rn = 1", ("line_blocks",))
def _(spark, sf):
    pages = rel(spark, sf, "line_blocks").select("doc_id", (F.col("seq") + 1).alias("page_number"), "text")
    return first_pages(pages, "doc_id")


# --- sinks -------------------------------------------------------------------------------------------------


@register("snk3_history_append", """SELECT 'scan-' || md5(cast(doc_id AS VARCHAR)) AS id, doc_type AS document_type, coalesce(nullif(name, ''), 'Unknown Name') AS holder_name,
  CASE WHEN n = 'Unknown ID' THEN n ELSE repeat('X', greatest(length(n) - 4, 0)) || right(n, 4) END AS identifier, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'HIGH' END, 'LOW') AS risk_level,
  'unknown' AS file_name, 0.0::DOUBLE AS risk_score, false AS ekyc_verified, '{}' AS result, '{}' AS extracted_fields, '{}' AS saved_paths
FROM (SELECT *, coalesce(nullif(passport_number, ''), nullif(aadhaar_number, ''), nullif(dl_number, ''), nullif(visa_number, ''), 'Unknown ID') AS n FROM field_wide) AS x""", ("field_wide",))
def _(spark, sf):
    items = history_items(field_frame(spark, sf)).select(
        "doc_id", F.col("doc_type").alias("document_type"), "holder_name", "identifier",
        F.when(F.col("doc_id") % 3 == 0, "HIGH").alias("risk_level"))
    path = scratch_path(spark, "history")
    for half in (0, 1, 0):  # batches add up; a repeated one leaves its rows once
        sinks.append_history(items.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half), path, "doc_id")
    return spark.read.parquet(path).drop("doc_id", "run")


@register("snk4_user_append", "SELECT id, coalesce(CASE WHEN id % 4 <> 0 THEN name END, 'Unknown') AS name, coalesce(CASE WHEN id % 3 = 0 THEN balance END, 15.0) AS average_risk_score FROM users", ("users",))
def _(spark, sf):
    users = rel(spark, sf, "users").select(
        "id", F.when(F.col("id") % 4 != 0, F.col("name")).alias("name"),
        F.when(F.col("id") % 3 == 0, F.col("balance")).alias("average_risk_score"))
    path = scratch_path(spark, "users")
    for half in (0, 1, 0):
        sinks.append_users(users.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half), path)
    return spark.read.parquet(path).select("id", "name", "average_risk_score")


@register("snk5_capture_store", """SELECT base_name, capture_id FROM (SELECT *, row_number() OVER (PARTITION BY base_name ORDER BY captured_at DESC, seq DESC) AS rn FROM (
  SELECT *, concat_ws('_', regexp_replace(file_name, '[^a-z0-9_]', '_', 'g'), side) AS base_name FROM captures) AS a) AS b WHERE rn = 1""", ("captures",))
def _(spark, sf):
    store = sinks.capture_store(rel(spark, sf, "captures").withColumn("custom_name", F.col("file_name")))
    return store.select("base_name", "capture_id")
