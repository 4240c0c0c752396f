"""Risk score, audit checks and history items (RSK-1..3, SET-2, PRJ-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens.functions.text import none_if_blank, normal_doc_type, title_label

# fixed values: score ranges (lowest score, number of whole scores)
BAD_RANGE, SKIPPED_RANGE, GOOD_RANGE = (70, 16), (42, 9), (18, 11)
SKIP_PENALTY, SCORE_CAP = 10, 96
SPREAD = 7919  # spreads consecutive ids over a range


def _spread(id_: Column, span: tuple[int, int]) -> Column:
    """A score of the range, fixed by the id."""
    return (F.lit(span[0]) + F.pmod(id_ * SPREAD, F.lit(span[1]))).cast("int")


def risk_score(id_: Column, bad: Column, skipped: Column) -> Column:
    """RSK-1."""
    base = _spread(id_, BAD_RANGE)
    return F.when(bad, F.when(skipped, F.least(F.lit(SCORE_CAP), base + SKIP_PENALTY)).otherwise(base)).otherwise(
        F.when(skipped, _spread(id_, SKIPPED_RANGE)).otherwise(_spread(id_, GOOD_RANGE)))


def risk_level(bad: Column, skipped: Column) -> Column:
    return F.when(bad | skipped, "REVIEW REQUIRED").otherwise("ACCEPTED")


def history_level(score: Column) -> Column:
    """RSK-3: score bands below 40, below 70 and above."""
    return F.when(score < 40, "LOW").when(score < 70, "MEDIUM").otherwise("HIGH")


def _check(id_: str, title: Column | str, status: Column | str, detail: Column | str) -> Column:
    def lit(x: Column | str) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    return F.struct(F.lit(id_).alias("id"), lit(title).alias("title"), lit(status).alias("status"),
                    lit(detail).alias("detail"))


def _either(cond: Column, yes: str, no: str) -> Column:
    return F.when(cond, yes).otherwise(no)


def audit_checks(bad: Column, skipped: Column, aadhaar: Column, travel: Column, face: Column, mrz: Column,
                 ekyc: Column, first_anomaly: Column) -> Column:
    """RSK-2: the check list of each branch, eKYC note included. Ids, titles and details
    are fixed values: results carry them as they stand."""
    skipped_title = "Aadhaar eKYC skipped"
    bad_checks = F.array(
        _check("ocr", "OCR extracted", "passed", "All primary fields extracted successfully"),
        _check("tampering", "Possible tampering detected", "warning",
               F.coalesce(first_anomaly, F.lit("Digital boundary artifact detected"))),
        _check("face", _either(face, "Face matched", "Face mismatch"), _either(face, "passed", "warning"),
               _either(face, "Confidence: 96%", "Confidence below threshold (42%)")),
        _check("doc", _either(mrz, "Integrity verified", "Document format anomaly"), _either(mrz, "passed", "failed"),
               _either(mrz, "Checksum valid", "Checksum mismatch")),
        F.when(skipped, _check("ekyc", skipped_title, "warning",
               "Demographic authentication bypassed — identity unconfirmed (+10% risk penalty)")),
    )
    good_checks = F.array(
        _check("doc_info", "Document information valid", "passed", "Format, fields and issuing entity verified"),
        _check("integrity", _either(travel, "MRZ valid", "Digital QR & Checksum valid"), "passed",
               _either(travel, "Standard ICAO 9303 checksum passed", "Cryptographic signature valid")),
        _check("face", "Face matched", "passed", "Biometric similarity score 96%"),
        _check("tamper", "No major tampering detected", "passed",
               "Clean font consistency, no pixel interpolation anomalies"),
        F.when(aadhaar & ekyc, _check("ekyc", "Aadhaar eKYC verified", "passed",
               "Name, DOB and Gender matched UIDAI record"))
        .when(aadhaar & skipped, _check("ekyc", skipped_title, "warning",
               "Demographic authentication bypassed — identity unconfirmed (+20% risk factor)")),
    )
    return F.when(bad, F.array_compact(bad_checks)).otherwise(F.array_compact(good_checks))


def na_checks(types: Column) -> Column:
    """SET-2: one warning per document noted as not available."""
    return F.transform(types, lambda t: F.struct(
        F.concat(F.lit("na_"), t).alias("id"),
        F.concat(F.regexp_replace(t, "^([^_]*)_", "$1 "), F.lit(" not produced")).alias("title"),
        F.lit("warning").alias("status"),
        F.lit("Document not available — logged as N/A by officer").alias("detail")))


def score_risk(facts: DataFrame, id_col: str = "session_id") -> DataFrame:
    """RSK-1..3 over a session-grain fact table with doc_type, tampered, face_matched,
    is_valid, mrz_valid, ekyc_skipped, ekyc_verified, anomalies and na_types (the last
    two ARRAY<STRING>). Unknown facts count against the document."""
    def fact(name: str, default: bool) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    kind = normal_doc_type(F.coalesce(F.col("doc_type"), F.lit("")))
    staged = facts.withColumns({
        "_aadhaar": kind == "aadhaar",
        "_travel": kind.isin("passport", "visa"),
        "_bad": fact("tampered", True) | ~fact("face_matched", False) | ~fact("is_valid", False),
    }).withColumn("_skipped", F.col("_aadhaar") & fact("ekyc_skipped", False))
    bad, skipped = F.col("_bad"), F.col("_skipped")
    checks = audit_checks(bad, skipped, F.col("_aadhaar"), F.col("_travel"), fact("face_matched", False),
                          fact("mrz_valid", False), fact("ekyc_verified", False), F.get("anomalies", F.lit(0)))
    none = F.array().cast("array<string>")
    explanation = (
        F.when(bad & skipped,
               "Potential document alteration detected and eKYC was skipped. Manual verification required.")
        .when(bad, "Potential document alteration detected. Manual verification recommended.")
        .when(skipped, "Document scan passed, but Aadhaar eKYC was skipped. Overall risk factor increased to "
                       "REVIEW REQUIRED due to unverified demographic records.")
        .otherwise("Document appears valid based on the available verification checks.")
    )
    scored = staged.withColumns({
        "risk_score": risk_score(F.col(id_col), bad, skipped),
        "risk_level": risk_level(bad, skipped),
        "explanation": explanation,
        "checks": F.concat(checks, na_checks(F.coalesce("na_types", none))),
    })
    return scored.withColumn("history_level", history_level(F.col("risk_score"))).drop(
        "_aadhaar", "_travel", "_bad", "_skipped")


def holder_name(name: Column) -> Column:
    return F.coalesce(none_if_blank(name), F.lit("Unknown Name"))


def holder_id(passport: Column, aadhaar: Column, licence: Column, visa: Column) -> Column:
    return F.coalesce(*[none_if_blank(c) for c in (passport, aadhaar, licence, visa)], F.lit("Unknown ID"))


def history_items(results: DataFrame, fields: str = "fields") -> DataFrame:
    """PRJ-7: holder and identifier columns of a history row."""
    f = F.col(fields)
    return results.withColumns({
        "holder_name": holder_name(f["name"]),
        "identifier": holder_id(f["passport_number"], f["aadhaar_number"], f["dl_number"], f["visa_number"]),
    })


def type_label(doc_type: Column) -> Column:
    return title_label(doc_type)
