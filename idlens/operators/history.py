"""Users, document records and the scan history
(JN-11, AGG-12, AGG-15..17, WIN-10, SRT-1, JSN-1, JSN-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idlens import rules
from idlens.functions.text import clean_identifier, squeeze
from idlens.session import shared_dir

CHECKS_SCHEMA = "struct<riskLevel:string,riskScore:double,checks:array<struct<id:string,title:string,status:string,detail:string>>>"


def user_documents(users: DataFrame, records: DataFrame) -> DataFrame:
    """JN-11: users with their documents (1:N)."""
    return users.join(records, users["id"] == records["user_id"])


def user_risk(users: DataFrame, records: DataFrame) -> DataFrame:
    """AGG-12: mean risk, number and state of each user's documents. Records are
    aggregated before the join, so a user with many records joins with one row."""
    per_user = records.groupBy("user_id").agg(
        F.avg("risk_score").alias("_mean"), F.count(F.lit(1)).alias("_n"),
        F.bool_and("is_verified").alias("_all"))
    joined = users.join(per_user, users["id"] == per_user["user_id"], "left")
    return joined.select(
        users["id"], F.coalesce("_mean", F.lit(rules.DEFAULT_USER_RISK)).alias("average_risk_score"),
        F.coalesce("_n", F.lit(0)).alias("n_documents"), F.coalesce("_all", F.lit(False)).alias("all_verified"))


def identity_consistency(documents: DataFrame, key: str = "user_id") -> DataFrame:
    """AGG-15: does every document of a person show one name and one birth date?
    Distinct values are de-duplicated per person before the final count."""
    return documents.select(key, F.lower(squeeze(F.col("name"))).alias("n"), "dob").groupBy(key).agg(
        F.count_distinct("n").alias("n_names"), F.count_distinct("dob").alias("n_dobs"),
        F.count(F.lit(1)).alias("n_documents"),
    ).withColumn("consistent", (F.col("n_names") <= 1) & (F.col("n_dobs") <= 1))


def reused_ids(records: DataFrame) -> DataFrame:
    """AGG-16: id numbers seen under more than one user. The pairs are
    de-duplicated first, so one very common number does not reach one task."""
    pairs = records.select("doc_type", clean_identifier(F.col("id_number")).alias("id_number"), "user_id").where(
        F.col("id_number").isNotNull()).distinct()
    return pairs.groupBy("doc_type", "id_number").agg(F.count(F.lit(1)).alias("n_users")).where("n_users > 1")


def history_rollup(history: DataFrame) -> DataFrame:
    """AGG-17: counts and mean risk by type and level, with subtotals."""
    return history.rollup("document_type", "risk_level").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_scans"),
        F.avg("risk_score").alias("mean_risk"))


def newest_first(history: DataFrame, limit: int | None = None) -> DataFrame:
    """SRT-1 / SRC-5: newest first; with a limit Spark keeps only a top-k per task."""
    ordered = history.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit)


def risk_trend(history: DataFrame, holder: str = "holder", time: str = "timestamp", ident: str = "id",
               value: str = "risk_score") -> DataFrame:
    """WIN-10: change against the holder's previous scan and running mean.

    A plain window would send a hot holder to one task. Rows are range-partitioned
    by (holder, time, id) instead, so a hot holder spans many partitions; each
    partition yields one summary row per holder, the summaries (holders +
    partitions rows) are accumulated, and every part continues from the carried
    count, sum and last value. The range split is fixed by checkpoint(), so a
    re-run task sees the same parts.
    """
    shared_dir(history.sparkSession)
    parts = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = history.repartitionByRange(parts, holder, time, ident).withColumn(
        "_part", F.spark_partition_id()).checkpoint()
    last = F.max(F.struct(F.col(time), F.col(ident), F.col(value).alias("v")))
    summary = cut.groupBy(holder, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"), last["v"].alias("_last"))
    before = W.partitionBy(holder).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        holder, "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"),
        F.lag("_last").over(W.partitionBy(holder).orderBy("_part")).alias("_v0"))
    inside = W.partitionBy(holder, "_part").orderBy(time, ident)
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = cut.join(carried, [holder, "_part"])
    previous = F.coalesce(F.lag(value).over(inside), F.col("_v0"))
    return joined.select(
        *history.columns,
        (F.col(value) - previous).alias("risk_change"),
        ((F.col("_s0") + F.sum(value).over(running)) / (F.col("_n0") + F.count(F.lit(1)).over(running)))
        .alias("running_mean"))


def parse_history(history: DataFrame) -> DataFrame:
    """JSN-1: the JSON columns as typed columns."""
    return history.withColumns({
        "result_parsed": F.from_json("result", CHECKS_SCHEMA),
        "fields_parsed": F.from_json("extracted_fields", "map<string,string>"),
        "paths_parsed": F.from_json("saved_paths", "map<string,string>")})


def checks_by_status(history: DataFrame) -> DataFrame:
    """JSN-2: audit checks inside the result JSON, counted by type and status."""
    parsed = history.select("document_type", F.from_json("result", CHECKS_SCHEMA)["checks"].alias("c"))
    return parsed.select("document_type", F.explode("c").alias("c")).groupBy(
        "document_type", F.col("c.status").alias("status")).agg(F.count(F.lit(1)).alias("n_checks"))


def as_variant(history: DataFrame, columns: tuple[str, ...] = ("result", "extracted_fields", "saved_paths")) -> DataFrame:
    """JSN-1: the JSON columns as VARIANT, with all keys they hold, known or not; text that is
    no JSON becomes NULL. `to_json` gives the text back."""
    return history.withColumns({c: F.try_parse_json(c) for c in columns if c in history.columns})


def at_path(column: str, path: str, kind: str = "string"):
    """JSN-1: a value inside a VARIANT by path, NULL where it is absent or of another kind."""
    return F.try_variant_get(F.col(column), path, kind)


def variant_schema(history: DataFrame, column: str = "result") -> DataFrame:
    """JSN-1: one row, `schema`: the type that all values of a VARIANT column fit into."""
    return history.agg(F.schema_of_variant_agg(column).alias("schema"))


def variant_checks_by_status(history: DataFrame, column: str = "result") -> DataFrame:
    """JSN-2 over a VARIANT: audit checks counted by type and status, whatever else they hold."""
    checks = history.select("document_type", F.explode(at_path(column, "$.checks", "array<variant>")).alias("check"))
    return checks.groupBy("document_type", at_path("check", "$.status").alias("status")).agg(F.count(F.lit(1)).alias("n_checks"))
