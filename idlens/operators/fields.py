"""Projections of extracted fields for consumers (PRJ-1, PRJ-3..6, FLT-2, SRC-6, AGG-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens import rules
from idlens.functions.text import let, none_if_blank, normal_doc_type, present, strip, title_label
from idlens.operators.extract import FIELD_TYPES, field_text


def api_projection(results: DataFrame, validation: str = "validation_status") -> DataFrame:
    """PRJ-1: the six answer columns; a missing validation reads as passed."""
    passed = F.create_map(F.lit("overall"), F.lit("pass"))
    return results.select(
        "document_type", "document_name", "confidence", "extracted_fields",
        F.coalesce(F.col(validation), passed).alias("validation_status"),
        F.coalesce("raw_ocr_text", F.lit("")).alias("raw_ocr_text"))


def _ui_struct(key: Column, label: Column, value: Column, confidence: Column) -> Column:
    return F.struct(key.alias("key"), label.alias("label"), value.alias("value"),
                    confidence.cast("int").alias("confidence"), F.lit(True).alias("editable"))


def ui_fields(doc_type: Column, fields: Column) -> Column:
    """PRJ-3: the shown fields of a document type: renamed, labelled, with the fixed
    confidence when a value is there and 0 when not."""
    kind, out = normal_doc_type(doc_type), None
    for name, entries in rules.UI_FIELDS.items():
        shown = []
        for key, label, sources, confidence, always in entries:
            known = [none_if_blank(field_text(fields, s)) for s in sources if s in FIELD_TYPES]
            value = F.coalesce(*known, F.lit("")) if known else F.lit("")
            entry = _ui_struct(F.lit(key), F.lit(label), value, F.when(value != "", confidence).otherwise(0))
            shown.append(entry if always else F.when(value != "", entry))
        branch = F.array_compact(F.array(*shown))
        out = (F if out is None else out).when(kind == name, branch)
    empty = F.array().cast("array<struct<key:string,label:string,value:string,confidence:int,editable:boolean>>")
    return out.otherwise(empty)


def passthrough_fields(fields_map: Column) -> Column:
    """PRJ-4: remaining non-blank fields under a Title Case label."""
    rest = F.map_filter(
        fields_map, lambda k, v: ~k.isin(*rules.UI_PASSTHROUGH_EXCLUDED) & (strip(F.coalesce(v, F.lit(""))) != ""))
    return F.transform(F.map_entries(rest), lambda e: _ui_struct(
        e["key"], title_label(e["key"]), e["value"], F.lit(rules.UI_PASSTHROUGH_CONFIDENCE)))


def display_rows(df: DataFrame, keys: list[str], fields_map: str = "fields_map") -> DataFrame:
    """PRJ-5: one labelled row per non-empty field, raw zones left out."""
    shown = F.map_filter(F.col(fields_map), lambda k, v: present(v) & ~k.isin(*rules.DISPLAY_EXCLUDED))
    return df.select(*keys, F.explode(shown).alias("_k", "value")).select(
        *keys, title_label(F.col("_k")).alias("label"), "value")


def with_low_confidence(ui: DataFrame, confidence: str = "confidence") -> DataFrame:
    """FLT-2: fields to look at again."""
    return ui.withColumn("low_confidence", F.col(confidence) < rules.LOW_CONFIDENCE_BELOW)


def revalidation_fields(doc_type: Column, ui_map: Column) -> Column:
    """PRJ-6: UI keys back to the names the checks read (MAP<STRING,STRING>)."""
    kind = normal_doc_type(doc_type)

    def renamed(shown: Column) -> Column:
        out = None
        for name, mapping in rules.REVALIDATION_KEYS.items():
            targets: dict[str, list[Column]] = {}
            for ui_key, field in mapping.items():
                targets.setdefault(field, []).append(none_if_blank(F.try_element_at(shown, F.lit(ui_key))))
            pairs = [x for field, values in targets.items() for x in (F.lit(field), F.coalesce(*values))]
            out = (F if out is None else out).when(kind == name, F.create_map(*pairs))
        return out

    # the map is looked into once for each key, so it is bound first
    return F.map_filter(let(ui_map, renamed), lambda k, v: v.isNotNull())


def map_as_fields(values: Column) -> Column:
    """A MAP of field texts as the wide struct the checks take."""
    def typed(name: str, dtype: str) -> Column:
        text = F.try_element_at(values, F.lit(name))
        if dtype.startswith("array"):
            return F.split(text, "\n" if name == "mrz_raw" else ", ")
        return text.cast(dtype) if dtype != "string" else text

    return F.struct(*[typed(n, t).alias(n) for n, t in FIELD_TYPES.items()])


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """SRC-6: keys that are NULL, or whose column is absent, take their default."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def fields_per_document(long: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-13: number of non-empty fields per document."""
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fields"))
