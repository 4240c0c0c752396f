"""Page layout and region boxes (FLT-5, FLT-6, FLT-8, AGG-6..8, JN-6, JN-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens import rules
from idlens.functions.text import alternation, contains_any, normal_doc_type


def layout_subtype(width: Column, height: Column, has_face: Column, text: Column) -> Column:
    """FLT-5: physical layout from the aspect ratio and text anchors."""
    ratio = width / height
    upper = F.upper(F.coalesce(text, F.lit("")))
    letter = (ratio <= 0.88) | ((height > width * 1.15) & contains_any(upper, rules.LETTER_ANCHORS))
    back = contains_any(upper, rules.CARD_BACK_WORDS) & ~F.coalesce(has_face, F.lit(False))
    return (
        F.when(letter, "full_e_aadhaar")
        .when(ratio >= 1.70, "cut_out_dual_card")
        .when((ratio > 0.88) & (ratio < 1.18), "stacked_dual_card")
        .when(back, "single_card_back")
        .when(ratio.isNotNull(), "single_card_front")
        .otherwise("unknown")
    )


def infer_side(doc_type: Column, subtype: Column) -> Column:
    """FLT-6."""
    return (
        F.when(F.lower(doc_type).isin(*rules.MRZ_TYPES), "front")
        .when(subtype == "single_card_front", "front")
        .when(subtype == "single_card_back", "back")
        .otherwise("full_page")
    )


# --- side rules --------------------------------------------------------------------------


def apply_side_rules(df: DataFrame, side_rules: DataFrame, doc_type: str = "doc_type", side: str = "side") -> DataFrame:
    """JN-6: rule of (type, side); unknown types take the default type's rules and
    sides a type does not have take the full page. Spark sends small rule
    tables to the rows by itself."""
    known = side_rules.select(F.col("doc_type").alias("_rt")).distinct()
    exact = side_rules.select(
        F.col("doc_type").alias("_et"), F.col("side").alias("_es"), F.lit(True).alias("_exact"))
    dim = side_rules.select(F.col("doc_type").alias("rule_type"), F.col("side").alias("rule_side"),
                            "extract_photo", "extract_qr", "extract_mrz", "target_fields")
    kind = normal_doc_type(F.coalesce(F.col(doc_type), F.lit("")))
    staged = df.withColumn("_kind", kind).join(known, F.col("_kind") == F.col("_rt"), "left")
    staged = staged.withColumns({
        "_kind": F.coalesce("_rt", F.lit(rules.DEFAULT_RULE_TYPE)),
        "_side": F.lower(F.coalesce(F.col(side), F.lit(""))),
    })
    staged = staged.join(
        exact, (F.col("_kind") == F.col("_et")) & (F.col("_side") == F.col("_es")), "left")
    staged = staged.withColumn("_side", F.when(F.col("_exact"), F.col("_side")).otherwise(rules.DEFAULT_SIDE))
    joined = staged.join(
        dim, (F.col("_kind") == F.col("rule_type")) & (F.col("_side") == F.col("rule_side")), "left")
    return joined.drop("_kind", "_side", "_rt", "_et", "_es", "_exact")


def keep_target_fields(fields_long: DataFrame, side_rules: DataFrame, doc_type: str = "doc_type",
                       side: str = "side", key: str = "key") -> DataFrame:
    """JN-8: only the fields a (type, side) may carry: left semi join to the rules."""
    allowed = side_rules.select(
        F.col("doc_type").alias("_t"), F.col("side").alias("_s"), F.explode("target_fields").alias("_f"))
    return fields_long.join(
        allowed,
        (normal_doc_type(F.col(doc_type)) == F.col("_t")) & (F.col(side) == F.col("_s")) & (F.col(key) == F.col("_f")),
        "left_semi",
    )


# --- boxes ----------------------------------------------------------------------------------


def overlap_share(box: Column, other: Column) -> Column:
    """Share of `box` covered by `other`; boxes are [x1, y1, x2, y2]. Nothing is
    covered by a missing box (least and greatest skip NULLs, so that is asked)."""
    width = F.least(box[2], other[2]) - F.greatest(box[0], other[0])
    height = F.least(box[3], other[3]) - F.greatest(box[1], other[1])
    area = (box[2] - box[0]) * (box[3] - box[1])
    return F.when(other.isNotNull() & (width > 0) & (height > 0) & (area > 0), width * height / area).otherwise(F.lit(0.0))


def exclude_overlaps(candidates: DataFrame, photos: DataFrame, keys: list[str], limit: float = 0.15) -> DataFrame:
    """FLT-8: candidate boxes that lie on no photo of their page, of which there may be
    several; a page without photo keeps all. Equal photos of a page count once."""
    page = photos.groupBy(*keys).agg(F.collect_set("bbox").alias("_photos"))
    joined = candidates.join(page, keys, "left")
    covered = F.exists("_photos", lambda p: F.coalesce(overlap_share(F.col("bbox"), p) > limit, F.lit(False)))
    return joined.where(~F.coalesce(covered, F.lit(False))).drop("_photos")


def _hull(blocks: DataFrame, pages: DataFrame, keys: list[str], near: str, inside) -> DataFrame:
    """Min/max hull of the blocks that `inside(edge, page)` accepts.

    Blocks are first combined per page and start edge (at most one row per pixel
    column or row), so that a page holding a big share of all blocks meets its
    page row with few rows.
    """
    edges = blocks.select(
        *keys, F.col("bbox")[0].alias("x1"), F.col("bbox")[1].alias("y1"),
        F.col("bbox")[2].alias("x2"), F.col("bbox")[3].alias("y2"))
    other = "y1" if near == "x1" else "x1"
    small = edges.groupBy(*keys, near).agg(
        F.min(other).alias(other), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    joined = small.join(pages.select(*keys, "width", "height"), keys)
    return joined.where(inside(F.col(near))).groupBy(*keys).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def _fraction_box(fractions, width: Column, height: Column) -> Column:
    x1, y1, x2, y2 = fractions
    return F.array(*[
        F.floor(side * f).cast("int") for side, f in ((width, x1), (height, y1), (width, x2), (height, y2))])


def default_box(kind: str, subtype: Column, width: Column, height: Column) -> Column:
    """AGG-8: region by fractions of the page when no block tells."""
    if kind == "mrz":
        return _fraction_box(rules.MRZ_REGION_DEFAULT, width, height)
    out = None
    for name, fractions in rules.ADDRESS_REGION_DEFAULTS.items():
        if name is not None:
            out = (F if out is None else out).when(subtype == name, _fraction_box(fractions, width, height))
    return out.otherwise(_fraction_box(rules.ADDRESS_REGION_DEFAULTS[None], width, height))


def region_boxes(blocks: DataFrame, pages: DataFrame, keys: list[str], kind: str = "address") -> DataFrame:
    """AGG-6 / AGG-7 / AGG-8: region box per page. `blocks`: keys, text, bbox;
    `pages`: keys, width, height, subtype (one row per page)."""
    text = F.upper(F.coalesce(F.col("text"), F.lit("")))
    if kind == "address":
        relevant = text.rlike(alternation(rules.ADDRESS_WORDS) + r"|\b[0-9]{6}\b")
        hull = _hull(blocks.where(relevant), pages, keys, "x1", lambda x: x < F.col("width") * 0.68)
        before, after, smallest = (15, 15), (20, 25), (40, 30)
        right = F.floor(F.col("width") * 0.68).cast("int")
    else:
        relevant = text.contains("P<") | text.contains("V<") | text.contains("IND") | text.rlike("[A-Z0-9<]{10,44}")
        hull = _hull(blocks.where(relevant), pages, keys, "y1", lambda y: y > F.col("height") * 0.60)
        before, after, smallest = (10, 10), (10, 10), (100, 20)
        right = F.col("width")
    joined = pages.join(hull, keys, "left").withColumns({
        "_x1": F.greatest(F.lit(0), F.col("x1") - before[0]),
        "_y1": F.greatest(F.lit(0), F.col("y1") - before[1]),
        "_x2": F.least(right, F.col("x2") + after[0]),
        "_y2": F.least(F.col("height"), F.col("y2") + after[1]),
    })
    good = F.col("x1").isNotNull() & (F.col("_x2") - F.col("_x1") > smallest[0]) & (
        F.col("_y2") - F.col("_y1") > smallest[1])
    subtype = F.col("subtype") if "subtype" in pages.columns else F.lit(None).cast("string")
    fallback = default_box(kind, subtype, F.col("width"), F.col("height"))
    return joined.select(
        *keys, F.when(good, "blocks").otherwise("default").alias("box_source"),
        F.when(good, F.array("_x1", "_y1", "_x2", "_y2")).otherwise(fallback).alias("box"),
    )
