"""Field checks and verdicts (VAL-1..5, AGG-10, AGG-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens.functions.checksums import verhoeff_valid
from idlens.functions.numbers import not_expired
from idlens.functions.text import let, normal_doc_type, present, title_label


def _mark(ok: Column) -> Column:
    return F.when(ok, "pass").otherwise("fail")


def _uid_ok(number: Column) -> Column:
    """A masked number passes; a full one must check."""
    bare = F.replace(number, F.lit(" "), F.lit(""))
    return F.coalesce(
        F.when(F.upper(bare).contains("X"), True).otherwise(
            bare.rlike("^[0-9]{12}$") & verhoeff_valid(bare)
        ),
        F.lit(False),
    )


def check_columns(doc_type: Column, fields: Column, mrz_policy: str = "strict") -> dict[str, Column]:
    """VAL-1..3: check name -> 'pass' / 'fail', NULL when it does not apply.

    `mrz_policy`: 'strict' takes the verdict of the check digits, 'lenient' that
    a zone was read at all.
    """
    kind = normal_doc_type(doc_type)
    aadhaar, travel, licence = kind == "aadhaar", kind.isin("passport", "visa"), kind == "driving_licence"
    flag = fields["mrz_checksum_valid" if mrz_policy == "strict" else "mrz_checksum_lenient"]
    mrz = F.coalesce(flag, F.coalesce(F.size(fields["mrz_raw"]), F.lit(0)) > 0)
    named = (aadhaar | licence) & present(fields["name"])
    return {
        "aadhaar_number": F.when(aadhaar, _mark(_uid_ok(fields["aadhaar_number"]))),
        "dob": F.when(aadhaar & present(fields["dob"]), "pass"),
        "mrz_check_digits": F.when(travel, _mark(mrz)),
        "document_number": F.when(
            travel, _mark(present(fields["passport_number"]) | present(fields["visa_number"]))
        ),
        "dl_number": F.when(
            licence, _mark(F.coalesce(F.length(fields["dl_number"]), F.lit(0)) >= 10)
        ),
        "name": F.when(named, "pass"),
    }


def overall(status: Column) -> Column:
    """AGG-10: at least one check and none failed."""
    good = (F.size(status) > 0) & F.forall(F.map_values(status), lambda v: v != "fail")
    return F.when(good, "pass").otherwise("fail")


def validate(df: DataFrame, doc_type: str = "document_type", fields: str = "fields",
             mrz_policy: str = "strict") -> DataFrame:
    """Adds the `validation_status` map, `overall` included."""
    def checks(f: Column) -> Column:
        named = check_columns(F.col(doc_type), f, mrz_policy)
        pairs = [x for k, v in named.items() for x in (F.lit(k), v)]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

    status = let(let(F.col(fields), checks), lambda c: F.map_concat(c, F.create_map(F.lit("overall"), overall(c))))
    return df.withColumn("validation_status", status)


def overall_from_long(checks: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """AGG-10 on rows (keys, check, status); combines before the shuffle."""
    return checks.groupBy(*keys).agg(
        F.when(F.bool_and(F.col(status) != "fail"), "pass").otherwise("fail").alias("overall"),
        F.count(F.lit(1)).alias("n_checks"),
    )


def validation_errors(status: Column) -> Column:
    """AGG-11: messages of the failed checks."""
    failed = F.filter(
        F.map_entries(status), lambda e: (e["key"] != "overall") & (e["value"] == "fail")
    )
    return F.transform(failed, lambda e: F.concat(title_label(e["key"]), F.lit(" validation failed")))


def verdict(df: DataFrame, as_of: Column, doc_type: str = "document_type", fields: str = "fields") -> DataFrame:
    """VAL-4: is_valid, mrz_valid, checksum_valid, expiry_valid, errors.

    Expiry is compared with `as_of`; a document without a readable expiry date is
    not held against it.
    """
    kind, f = normal_doc_type(F.col(doc_type)), F.col(fields)
    expiry = F.coalesce(f["date_of_expiry"], f["validity_nt"])
    return df.withColumns({
        "is_valid": F.col("validation_status")["overall"] == "pass",
        "mrz_valid": F.when(kind.isin("passport", "visa"), F.coalesce(f["mrz_checksum_valid"], F.lit(False)))
        .otherwise(True),
        "checksum_valid": F.when(kind == "aadhaar", _uid_ok(f["aadhaar_number"])).otherwise(True),
        "expiry_valid": F.coalesce(not_expired(expiry, as_of), F.lit(True)),
        "errors": validation_errors(F.col("validation_status")),
    })


def tampering(df: DataFrame, fields: str = "fields", cross: str = "qr_check") -> DataFrame:
    """VAL-5: tampered when the QR contradicts the text, the id number does not
    check, or a zone that was read does not check."""
    none = F.array().cast("array<string>")

    def found(f: Column, q: Column) -> Column:
        contradicted = q["qr_detected"] & (F.size(q["mismatches"]) > 0)
        bad_number = ~f["aadhaar_number_valid"] & present(f["aadhaar_number"])
        bad_zone = ~f["mrz_checksum_valid"] & (F.size(f["mrz_raw"]) > 0)
        return F.concat(
            F.when(contradicted, q["mismatches"]).otherwise(none),
            F.when(bad_number, F.array(F.lit("Id number checksum failed"))).otherwise(none),
            F.when(bad_zone, F.array(F.lit("MRZ check digits failed"))).otherwise(none))

    anomalies = let(F.struct(F.col(fields).alias("f"), F.col(cross).alias("q")), lambda s: found(s["f"], s["q"]))
    return df.withColumn("anomalies", anomalies).withColumn("tampered", F.size("anomalies") > 0)
