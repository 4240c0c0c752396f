"""Session facts to risk and history rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlens.operators.extract import fields_map
from idlens.operators.risk import history_items, score_risk
from idlens.sources.sinks import history_rows, masked_id

SECRET = ("aadhaar_number", "passport_number", "visa_number", "dl_number")
UNSTORED = ("mrz_raw",)  # a zone spells the numbers out


def session_facts(
    results: DataFrame, ekyc: DataFrame, faces: DataFrame, unavailable: DataFrame, key: str = "session_id",
    paths: DataFrame | None = None,
) -> DataFrame:
    """One row per session: its primary result, registry verdict, face verdict, the
    documents noted as not available and, with `paths` (session, front_file, back_file),
    where its images are kept.

    `results` and the look-ups have one row per session each, except `unavailable`
    (session_id, doc_type), which is collected to at most one entry per type first.
    """
    na = unavailable.groupBy(key).agg(F.array_sort(F.collect_set("doc_type")).alias("na_types"))
    facts = (
        results.join(ekyc.select(key, "ekyc_verified", "ekyc_skipped"), key, "left")
        .join(faces.select(key, "face_matched"), key, "left")
        .join(na, key, "left")
    )
    return facts if paths is None else facts.join(paths.select(key, "front_file", "back_file"), key, "left")


def verify_sessions(facts: DataFrame, key: str = "session_id") -> DataFrame:
    """RSK-1..3 and PRJ-7: scored history rows, identifiers masked.

    `facts` holds document_type, fields, validation_status, tampered, anomalies, file_name,
    timestamp and the columns of `session_facts`. The non-empty fields and the kept images
    are stored as JSON; the numbers in the stored fields are masked like the identifier.
    """
    shown = F.transform_values(fields_map(F.col("fields")), lambda k, v: F.when(k.isin(*SECRET), masked_id(v)).otherwise(v))
    stored = F.to_json(F.map_filter(shown, lambda k, v: ~k.isin(*UNSTORED)))
    kept = [c for c in ("front_file", "back_file") if c in facts.columns]
    saved = [F.to_json(F.struct(*[F.col(c).alias(c.removesuffix("_file")) for c in kept])).alias("saved_paths")] if kept else []
    prepared = facts.withColumns({
        "doc_type": F.col("document_type"),
        "is_valid": F.col("validation_status")["overall"] == "pass",
        "mrz_valid": F.coalesce(F.col("fields.mrz_checksum_valid"), F.lit(True)),
    })
    scored = history_items(score_risk(prepared, key))
    rows = scored.select(
        key, "document_type", "file_name", "holder_name", "identifier", F.col("history_level").alias("risk_level"),
        F.col("risk_score").cast("double").alias("risk_score"), "timestamp",
        F.coalesce("ekyc_verified", F.lit(False)).alias("ekyc_verified"),
        F.to_json(F.struct(
            F.col("risk_level").alias("riskLevel"), F.col("risk_score").cast("double").alias("riskScore"),
            "explanation", "checks")).alias("result"),
        stored.alias("extracted_fields"), *saved,
    )
    return history_rows(rows, key)
