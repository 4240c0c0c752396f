"""SNK-1..5: results, consolidated sessions, history, users, captures."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens import rules
from idlens.functions.text import base_name
from idlens.operators.fields import with_defaults
from idlens.operators.sessions import latest_captures


def masked_id(number: Column) -> Column:
    """Only the last four characters of an identifier stay readable."""
    hidden = F.repeat(F.lit("X"), F.greatest(F.length(number) - 4, F.lit(0)))
    return F.concat(hidden, F.right(number, F.lit(4)))


def result_key(file_name: Column, page: Column) -> Column:
    """SNK-1: key {file without extension}_p{page}."""
    return F.concat(F.regexp_replace(file_name, r"\.[^./]*$", ""), F.lit("_p"), page.cast("string"))


def write_results(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """SNK-1: one row per page, partitioned by type so that readers prune."""
    keyed = results.withColumn("result_key", result_key(F.col("file_name"), F.col("page_number")))
    keyed.write.mode(mode).partitionBy("document_type").format(fmt).save(path)


def write_consolidated(sessions: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """SNK-2: one row per session."""
    sessions.write.mode(mode).partitionBy("document_type").format(fmt).save(path)


def history_id(session_key: Column) -> Column:
    """SNK-3: an id that a repeated job computes again."""
    return F.concat(F.lit("scan-"), F.md5(session_key.cast("string")))


def history_rows(items: DataFrame, session: str = "session_id") -> DataFrame:
    """All columns of a history row; a placeholder for a missing identifier is no secret."""
    rows = with_defaults(items, rules.HISTORY_DEFAULTS).withColumn("id", history_id(F.col(session)))
    number = F.col("identifier")
    return rows.withColumn("identifier", F.when(number == rules.UNKNOWN_IDENTIFIER, number).otherwise(masked_id(number)))


def batch_run(rows: DataFrame) -> str:
    """A run's name from its rows in any order: only the same rows again have the same name."""
    stamps = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false", "timestampFormat": stamps + "XXX", "timestampNTZFormat": stamps})
    sums = [F.sum(F.xxhash64(F.lit(i), text).cast("decimal(38,0)")) for i in range(2)]
    found = rows.agg(F.count(F.lit(1)), *sums).first()
    return "rows-" + hashlib.md5(f"{rows.schema.json()}{tuple(found)}".encode()).hexdigest()


def _append(rows: DataFrame, path: str, run: str | None) -> DataFrame:
    """Each run owns one folder of the table; a repeated run overwrites its own rows.

    Without a run the rows name it, so different batches add up. Rows that hold the time of
    the job or a random value are other rows each time: there a run has to be given.
    """
    part = f"{path}/run={batch_run(rows) if run is None else run}"
    rows.write.mode("overwrite").parquet(part)
    return rows.sparkSession.read.parquet(part)


def append_history(items: DataFrame, path: str, session: str = "session_id", run: str | None = None) -> DataFrame:
    """SNK-3: appends the rows of a run and hands back what was written, with ids."""
    return _append(history_rows(items, session), path, run)


def append_users(users: DataFrame, path: str, run: str | None = None) -> DataFrame:
    """SNK-4: as SNK-3, for user records."""
    return _append(with_defaults(users, rules.REQUEST_DEFAULTS), path, run)


def capture_store(captures: DataFrame) -> DataFrame:
    """SNK-5: what the store holds after all captures: the latest per stored name."""
    named = captures.withColumn("base_name", base_name(
        F.col("doc_type"), F.col("side"), F.col("custom_name") if "custom_name" in captures.columns
        else F.lit(None).cast("string")))
    return latest_captures(named, ["base_name"])
