"""SRC-1..5: manifests, OCR blocks, registries, history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlens.functions.text import normal_doc_type
from idlens.operators.assemble import screen_files
from idlens.operators.history import newest_first
from idlens.operators.sessions import union_results

BLOCK_SCHEMA = (
    "doc_id BIGINT, page_number INT, engine STRING, seq INT, text STRING, bbox ARRAY<INT>,"
    " confidence DOUBLE, block_num INT, line_num INT"
)
REGISTRY_FILE_SCHEMA = (
    "name STRING, dob STRING, gender STRING, status STRING, aadhaar_number STRING, passport_number STRING,"
    " dl_number STRING, visa_number STRING, address STRING, father_name STRING, pincode STRING,"
    " blood_group STRING, validity STRING, vehicle_classes STRING, nationality STRING, issue_date STRING,"
    " expiry_date STRING, place_of_issue STRING, mrz_line1 STRING, mrz_line2 STRING, visa_type STRING, entries STRING"
)
_ID_OF_TYPE = {
    "aadhaar": "aadhaar_number", "passport": "passport_number",
    "driving_licence": "dl_number", "visa": "visa_number",
}
_ATTRIBUTES = (
    "address", "father_name", "pincode", "blood_group", "validity", "vehicle_classes", "nationality",
    "issue_date", "expiry_date", "place_of_issue", "mrz_line1", "mrz_line2", "visa_type", "entries",
)
REGISTRY_SCHEMA = (
    "doc_type STRING, id_number STRING, name STRING, dob STRING, gender STRING, status STRING,"
    " attrs MAP<STRING,STRING>"
)


def scan_manifest(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """SRC-1: files under a folder. The content column is never selected, so no
    file is opened."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
        .select("path", "length", "modificationTime")
    )
    return screen_files(files.withColumn("file_name", F.regexp_extract("path", r"([^/]+)$", 1)))


def read_blocks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-3: block rows with the fixed schema (no inference pass)."""
    return spark.read.schema(BLOCK_SCHEMA).format(fmt).load(path)


def registry_rows(raw: DataFrame, doc_type: str) -> DataFrame:
    """Registry objects of one type as common rows; unreadable objects drop out."""
    kind = doc_type
    ids = _ID_OF_TYPE[kind]
    attrs = F.map_filter(
        F.create_map(*[x for a in _ATTRIBUTES for x in (F.lit(a), F.col(a))]), lambda k, v: v.isNotNull())
    return raw.where(F.col(ids).isNotNull()).select(
        F.lit(kind).alias("doc_type"), F.col(ids).alias("id_number"), "name", "dob", "gender", "status",
        attrs.alias("attrs"))


def read_registry(spark: SparkSession, paths: dict[str, str], multi_line: bool = True) -> DataFrame:
    """SRC-4: one JSON path per document type; a missing or bad one is empty."""
    parts = [spark.createDataFrame([], REGISTRY_SCHEMA)]
    for doc_type, path in paths.items():
        try:
            raw = (
                spark.read.schema(REGISTRY_FILE_SCHEMA).option("multiLine", multi_line)
                .option("mode", "PERMISSIVE").json(path)
            )
        except AnalysisException:  # no such path
            continue
        parts.append(registry_rows(raw, doc_type))
    return union_results(parts)


def read_history(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """SRC-5: newest first."""
    return newest_first(spark.read.parquet(path), limit)


def normalise_types(df: DataFrame, doc_type: str = "document_type") -> DataFrame:
    return df.withColumn(doc_type, normal_doc_type(F.col(doc_type)))
