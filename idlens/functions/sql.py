"""UDF-1: SQL-visible scalar and table functions, as SQL functions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from idlens.functions.checksums import PERMUTATION, PRODUCT


def _array(values: list[int]) -> str:
    return "array(" + ", ".join(map(str, values)) + ")"


def verhoeff_sql(digits: str, length: int = 12) -> str:
    state = "0"
    for i in range(length):
        digit = f"ascii(substring({digits}, {length - i}, 1)) - 48"
        state = f"get({_array(PRODUCT)}, {state} * 10 + get({_array(PERMUTATION[i % 8])}, {digit}))"
    return f"coalesce(CASE WHEN length({digits}) = {length} THEN {state} = 0 END, false)"


def definitions() -> dict[str, str]:
    """name -> (parameters RETURNS type RETURN body)."""
    yy = "try_cast(substring(d, 1, 2) AS INT)"
    return {
        "kyc_clean_id": "(x STRING) RETURNS STRING RETURN upper(regexp_replace(x, '[-\\\\s]', ''))",
        "kyc_verhoeff": "(x STRING) RETURNS BOOLEAN RETURN " + verhoeff_sql("regexp_replace(x, '[^0-9]', '')"),
        "kyc_mrz_birth": "(d STRING) RETURNS STRING RETURN CASE WHEN d RLIKE '^[0-9]{6}$' THEN concat_ws('/',"
        f" substring(d, 5, 2), substring(d, 3, 2), CAST(CASE WHEN {yy} > 25 THEN {yy} + 1900 ELSE {yy} + 2000 END AS STRING)) ELSE d END",
        "kyc_mrz_expiry": "(d STRING) RETURNS STRING RETURN CASE WHEN d RLIKE '^[0-9]{6}$' THEN concat_ws('/',"
        f" substring(d, 5, 2), substring(d, 3, 2), CAST(CASE WHEN {yy} < 80 THEN {yy} + 2000 ELSE {yy} + 1900 END AS STRING)) ELSE d END",
        "kyc_masked_id": "(x STRING) RETURNS STRING RETURN concat(repeat('X', greatest(length(x) - 4, 0)), right(x, 4))",
    }


def table_definitions() -> dict[str, str]:
    """Table functions, for use after LATERAL: name -> (parameters) RETURNS TABLE (columns) RETURN query."""
    return {
        # the non-empty fields of a document, a row each; LATERAL takes no map, so its entries
        "kyc_fields": "(fields ARRAY<STRUCT<key: STRING, value: STRING>>) RETURNS TABLE (key STRING, value STRING) RETURN"
        " SELECT f.key, f.value FROM (SELECT explode(fields) AS f) WHERE f.value <> ''",
        # the lines of a text, trimmed, numbered from 1
        "kyc_lines": "(text STRING) RETURNS TABLE (line_no INT, line STRING) RETURN"
        " SELECT pos + 1, line FROM (SELECT posexplode(filter(transform(split(text, '\\n'), x -> btrim(x, ' \\t\\r\\f')), x -> x <> '')) AS (pos, line))",
        # the number line of a zone, a row for each field with its check digit
        "kyc_zone_fields": "(line STRING) RETURNS TABLE (field STRING, value STRING, digit STRING) RETURN"
        " SELECT z.field, replace(z.value, '<', ''), z.digit FROM (SELECT inline(array("
        "named_struct('field', 'number', 'value', substring(line, 1, 9), 'digit', substring(line, 10, 1)),"
        " named_struct('field', 'birth', 'value', substring(line, 14, 6), 'digit', substring(line, 20, 1)),"
        " named_struct('field', 'expiry', 'value', substring(line, 22, 6), 'digit', substring(line, 28, 1)),"
        " named_struct('field', 'optional', 'value', substring(line, 29, 14), 'digit', substring(line, 43, 1))))) AS z WHERE length(line) = 44",
    }


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary functions of this session."""
    for name, body in (definitions() | table_definitions()).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
