"""The list of registered queries and small helpers they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idlens.catalog.inputs import FIELD_COLUMNS, relation, with_relations
from idlens.functions.text import let
from idlens.operators.fields import map_as_fields

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def prepare(spark: SparkSession) -> None:
    """Instants are compared as UTC; all other settings are the session's own."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def register(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Adds a query; `uses` names the derived relations its SQL reads."""
    def add(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        text = sql
        if sql is not None and uses:
            head = with_relations(*uses)
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE"):
                head, body = head.replace("WITH", "WITH RECURSIVE", 1), "WITH" + body[14:]
            text = head + (",\n" + body[4:].lstrip() if body.upper().startswith("WITH") else "\n" + body)
        REGISTRY[name] = Query(run, text)
        return fn

    return add


def rel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return relation(spark, sf_dir, name)


def joined(c: Column, separator: str = "|") -> Column:
    """Lists leave a query as text, which every engine compares alike."""
    return F.array_join(c, separator)


def field_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc_type, fields (the wide struct) and fields_map (non-empty texts)."""
    wide = rel(spark, sf_dir, "field_wide")
    pairs = [x for c in FIELD_COLUMNS for x in (F.lit(c), F.col(c))]
    values = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    both = let(values, lambda m: F.struct(
        map_as_fields(m).alias("fields"), F.map_filter(m, lambda k, v: v != "").alias("fields_map")))
    return wide.select("doc_id", "doc_type", both.alias("_both")).select("doc_id", "doc_type", "_both.fields", "_both.fields_map")


# --- pieces of checking SQL --------------------------------------------------------

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def q(text: str) -> str:
    return text.replace("'", "''")


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS})"


def rx(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{q(pattern)}', {group}), '')"


def lines_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip_sql('l')}), lambda l: l <> '')"


def name_letters_sql(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace({x}, '[^A-Za-z\\s.''-]', ' ', 'g'), '\\s+', ' ', 'g'), {WS})"
    )


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), {WS})"


def kind_sql(x: str) -> str:
    return f"CASE WHEN lower({x}) IN ('driving_licence', 'driving_license', 'dl') THEN 'driving_licence' ELSE lower({x}) END"
