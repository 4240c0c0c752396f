"""Capture sessions: sides, primaries, checklists, field layers
(WIN-4, WIN-5, WIN-9, JN-4, JN-5, JN-12..14, JN-16, AGG-13, AGG-18, SET-*, FLT-3, FLT-4, FLT-7).

Sessions may be hot (one may hold a third of all captures), so every "first of a
session" is a row_number() <= k, which Spark limits per input partition before
the shuffle, or an aggregate that combines before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idlens import rules
from idlens.functions.text import none_if_blank, present

MERGED_SUFFIX = " (Front + Back Merged)"
BACK_SEPARATOR = "\n--- BACK SIDE ---\n"


def first_rows(df: DataFrame, keys: list[str], *order: Column | str, k: int = 1) -> DataFrame:
    """The first k rows per key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


# --- front and back ------------------------------------------------------------------------


def front_like(fields: Column) -> Column:
    """FLT-7."""
    return present(fields["name"]) | present(fields["dob"]) | present(fields["gender"])


def back_like(fields: Column, qr_detected: Column) -> Column:
    """FLT-7."""
    return present(fields["address"]) | F.coalesce(qr_detected, F.lit(False))


def blank_filled(df: DataFrame, front: str, back: str) -> Column:
    """Field by field: the front value, the back's where the front is blank."""
    def pick(name: str, dtype: str) -> Column:
        f, b = F.col(front)[name], F.col(back)[name]
        if dtype == "string":
            return F.coalesce(none_if_blank(f), none_if_blank(b), f)
        if dtype == "boolean":
            return F.when(F.coalesce(f, F.lit(False)), f).otherwise(F.when(F.coalesce(b, F.lit(False)), b).otherwise(f))
        if dtype.startswith("array"):
            return F.when(F.size(f) > 0, f).otherwise(F.when(F.size(b) > 0, b).otherwise(f))
        return F.coalesce(f, b)

    struct = df.schema[front].dataType
    return F.struct(*[pick(x.name, x.dataType.simpleString()).alias(x.name) for x in struct.fields])


def side_pairs(results: DataFrame, key: str = "session_id") -> DataFrame:
    """WIN-4: per session the first front-like row and the first back-like row
    other than it, as structs `front` and `back` (either may be NULL).

    One pass: of each kind the first two rows leave an input partition, as of the two
    first back-like rows at most one is the front itself.
    """
    kinds = F.array_compact(F.array(
        F.when(front_like(F.col("fields")), "front"), F.when(back_like(F.col("fields"), F.col("qr_detected")), "back")))
    sided = results.select(key, "seq", F.struct(*results.columns).alias("row"), F.explode(kinds).alias("_kind"))
    w = W.partitionBy(key, "_kind").orderBy("seq")
    few = sided.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")

    def nth(kind: str, n: int) -> Column:
        return F.when((F.col("_kind") == kind) & (F.col("_rn") == n), F.col("seq"))

    places = {"front": nth("front", 1), "_back1": nth("back", 1), "_back2": nth("back", 2)}
    found = few.groupBy(key).agg(*[x for name, at in places.items() for x in (
        F.min(at).alias(f"{name}_seq"), F.min_by("row", at).alias(name))])
    taken = F.coalesce(F.col("_back1_seq") == F.col("front_seq"), F.lit(False))
    return found.select(
        key, "front_seq", "front", F.when(taken, F.col("_back2_seq")).otherwise(F.col("_back1_seq")).alias("back_seq"),
        F.when(taken, F.col("_back2")).otherwise(F.col("_back1")).alias("back"))


def merge_sides(results: DataFrame, key: str = "session_id") -> DataFrame:
    """JN-4 / SET-4: sessions whose front and back are of one type get one merged
    record plus their other rows; all other sessions keep their rows.

    `results`: key, seq (one row each), document_type, document_name, fields, qr_detected,
    qr_data, raw_ocr_text. The pair comes back to its rows by key and seq, so a hot session
    spreads over the join: the front's row becomes the merged one, the back's row goes.
    """
    pairs = side_pairs(results, key).where("front.document_type = back.document_type")
    none = F.lit(None).cast(results.select(F.struct("*").alias("r")).schema["r"].dataType)
    roles = pairs.select(key, F.inline(F.array(
        F.struct(F.col("front_seq").alias("seq"), F.lit("front").alias("_role"), F.col("back").alias("_back")),
        F.struct(F.col("back_seq").alias("seq"), F.lit("back").alias("_role"), none.alias("_back")))))
    rows = results.join(roles, [key, "seq"], "left").where("_role is null or _role = 'front'")
    rows = rows.withColumns({"_f": F.col("fields"), "_b": F.col("_back.fields")})
    merged = F.col("_role") == "front"
    replaced = {
        "document_name": F.concat(F.col("document_name"), F.lit(MERGED_SUFFIX)),
        "fields": blank_filled(rows, "_f", "_b"),
        "raw_ocr_text": F.concat(F.coalesce(F.col("raw_ocr_text"), F.lit("")), F.lit(BACK_SEPARATOR),
                                 F.coalesce(F.col("_back.raw_ocr_text"), F.lit(""))),
    }
    return rows.select(
        *[F.when(merged, replaced[c]).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c) for c in results.columns],
        F.col("_back.qr_data").alias("back_qr_data"))


def consolidate(front: DataFrame, back: DataFrame, key: str = "session_id") -> DataFrame:
    """JN-5: two-image sessions: front fields, blanks filled from the back; either
    side may be missing. Inputs: key, seq, document_type, fields."""
    f = first_rows(front, [key], "seq").select(
        key, F.col("document_type").alias("_ft"), F.col("fields").alias("_f"))
    b = first_rows(back, [key], "seq").select(
        key, F.col("document_type").alias("_bt"), F.col("fields").alias("_b"))
    joined = f.join(b, key, "full")
    sides = F.concat_ws("+", F.when(F.col("_f").isNotNull(), "front"), F.when(F.col("_b").isNotNull(), "back"))
    return joined.select(
        key, F.coalesce("_ft", "_bt").alias("document_type"), sides.alias("sides"),
        blank_filled(joined, "_f", "_b").alias("fields"))


# --- captures --------------------------------------------------------------------------------


def primary_capture(captures: DataFrame, key: str = "session_id") -> DataFrame:
    """WIN-5: first capture that is not suspicious, else the first."""
    return first_rows(captures, [key], F.coalesce("suspicious", F.lit(False)), "seq")


def primary_checklist(checklist: DataFrame, key: str = "session_id") -> DataFrame:
    """WIN-5: first scanned entry in the fixed order of types."""
    order = F.array_position(F.array(*[F.lit(t) for t in rules.CHECKLIST_TYPES]), F.col("doc_type"))
    return first_rows(checklist.where("status = 'scanned'"), [key],
                      F.when(order > 0, order).otherwise(len(rules.CHECKLIST_TYPES) + 1), "doc_type", "file_name")


def latest_captures(captures: DataFrame, keys: list[str], time: str = "captured_at") -> DataFrame:
    """WIN-9 / SNK-5: the latest row per key; later sequence numbers win ties."""
    return first_rows(captures, keys, F.col(time).desc(), F.col("seq").desc())


def remove_captures(captures: DataFrame, removed: DataFrame) -> DataFrame:
    """FLT-4: captures without the removed ids."""
    return captures.join(removed.select("capture_id"), "capture_id", "left_anti")


def side_lookup(captures: DataFrame, key: str = "session_id") -> DataFrame:
    """JN-14: first front (or single) and first back file per session and type."""
    def first_file(*sides: str) -> Column:
        return F.min(F.when(F.col("side").isin(*sides), F.struct("seq", "file_name")))["file_name"]

    return captures.groupBy(key, "doc_type").agg(
        first_file("front", "single").alias("front_file"), first_file("back").alias("back_file"))


def already_captured(wanted: DataFrame, captures: DataFrame, keys: list[str]) -> DataFrame:
    """JN-16: the wanted (session, type, side) slots that hold a capture."""
    return wanted.join(captures.select(*keys).distinct(), keys, "left_semi")


def session_flags(captures: DataFrame, key: str = "session_id") -> DataFrame:
    """AGG-18 and AGG-13 of captures."""
    return captures.groupBy(key).agg(
        F.bool_or(F.coalesce("suspicious", F.lit(False))).alias("any_suspicious"),
        F.count(F.lit(1)).alias("n_captures"))


# --- checklists ------------------------------------------------------------------------------------


def checklist_counts(checklist: DataFrame, key: str = "session_id") -> DataFrame:
    """AGG-13: scanned and N/A entries per session."""
    return checklist.groupBy(key).agg(
        F.count_if(F.col("status") == "scanned").alias("n_scanned"),
        F.count_if(F.col("status") == "na").alias("n_na"), F.count(F.lit(1)).alias("n_entries"))


def scanned_entries(checklist: DataFrame) -> DataFrame:
    """FLT-3."""
    return checklist.where("status = 'scanned'")


def unavailable_entries(checklist: DataFrame) -> DataFrame:
    """FLT-3."""
    return checklist.where("status = 'na'")


def missing_documents(checklist: DataFrame, required=rules.CHECKLIST_TYPES, key: str = "session_id") -> DataFrame:
    """JN-12: required types without a scanned entry. Each session carries the set
    of its scanned required types (at most len(required) values), so neither a
    cross product nor a join is needed."""
    needed = F.array(*[F.lit(t) for t in required])
    hit = F.when((F.col("status") == "scanned") & F.col("doc_type").isin(*required), F.col("doc_type"))
    return checklist.groupBy(key).agg(F.collect_set(hit).alias("_have")).select(
        key, F.explode(F.array_except(needed, F.col("_have"))).alias("doc_type"))


# --- field layers -------------------------------------------------------------------------------------


def layer_fields(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """JN-13: rows (keys, key, value) of several sources; the later source wins."""
    tagged = [df.select(*keys, "key", "value", F.lit(i).alias("_layer")) for i, df in enumerate(layers)]
    top = F.max(F.struct("_layer", "value"))
    return reduce(DataFrame.unionByName, tagged).groupBy(*keys, "key").agg(
        top["value"].alias("value"), top["_layer"].alias("layer"))


def union_results(parts: list[DataFrame]) -> DataFrame:
    """SET-1: results of many sources, missing columns as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
