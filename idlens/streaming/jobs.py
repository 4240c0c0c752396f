"""STR-1..5: intake, session pairing, duplicates, history sink, risk monitor.

Streams read files and write files; state is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlens.operators.crosscheck import check_payload
from idlens.plans.batch import process_pages, result_columns
from idlens.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def intake(pages: DataFrame) -> DataFrame:
    """STR-1: pages (raw_text, payload, file_name, page_number, ...) to results;
    stateless, the batch functions unchanged."""
    return result_columns(process_pages(pages))


def pair_sessions(captures: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """STR-2: captures of a session at most `gap` apart belong together; each closed
    group reports its first front and back. Rows later than the watermark drop."""
    def first_capture(side: str):
        return F.min(F.when(F.col("side") == side, F.struct("captured_at", "seq", "capture_id")))["capture_id"]

    return (
        captures.withWatermark("captured_at", delay)
        .groupBy("session_id", F.session_window("captured_at", gap).alias("w"))
        .agg(
            first_capture("front").alias("front_capture"), first_capture("back").alias("back_capture"),
            F.count(F.lit(1)).alias("n_captures"),
        )
        .select("session_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "front_capture", "back_capture", "n_captures")
    )


def drop_duplicates(captures: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """STR-3: a resubmission within the delay is dropped."""
    return captures.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(keys)


def cross_check_streams(texts: DataFrame, qr: DataFrame, keys: list[str], within: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """STR-1 / JN-2 where texts (keys, fields, read_at) and payloads (keys, payload, decoded_at)
    arrive apart: a text meets the payload of its keys that was decoded at most `within`
    before or after it. Both sides have watermarks, so state is bounded: a text whose
    payload has not come by then comes out once, as one without a QR; a payload that is
    later than the watermark, or outside the interval, counts as missing. A page should
    have one payload; of several each gives a row.
    """
    left = texts.withWatermark("read_at", delay)
    right = qr.select(*[F.col(k).alias(f"_{k}") for k in keys], "payload", "decoded_at").withWatermark("decoded_at", delay)
    bound = F.expr(f"decoded_at BETWEEN read_at - INTERVAL {within} AND read_at + INTERVAL {within}")
    for k in keys:
        bound = bound & (F.col(k) == F.col(f"_{k}"))
    return check_payload(left.join(right, bound, "left_outer").drop(*[f"_{k}" for k in keys]))


def history_writer(path: str) -> Callable[[DataFrame, int], None]:
    """STR-4: each micro-batch owns one folder and overwrites it, so a replayed
    batch leaves its rows once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def risk_monitor(history: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """STR-5: scans and mean risk per window, type and level; tumbling, or sliding
    when `slide` is given."""
    return (
        history.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", window, slide).alias("w"), "document_type", "risk_level")
        .agg(F.count(F.lit(1)).alias("n_scans"), F.avg("risk_score").alias("mean_risk"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "document_type", "risk_level", "n_scans", "mean_risk")
    )


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything available now, appended to parquet files (exactly once)."""
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_to_batches(stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str,
                   mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(writer)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def fed(spark: SparkSession, slices: list[dict[str, DataFrame]], stream: Callable[[dict[str, DataFrame]], DataFrame], name: str) -> DataFrame:
    """Results of a stream whose sources grow: each slice (source name -> rows) is added to the
    sources' folders and the query is started again from its checkpoint, so state outlives
    a restart and watermarks move between slices."""
    path = scratch_path(spark, name)
    for some in slices:
        for source, rows in some.items():
            rows.write.mode("append").parquet(f"{path}/{source}")
        out = stream({source: read_stream(spark, f"{path}/{source}", rows.schema) for source, rows in some.items()})
        run_to_files(out, f"{path}/out", f"{path}/state")
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there and reads its result files back."""
    path = scratch_path(spark, name)
    run_to_files(stream, f"{path}/out", f"{path}/state")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
