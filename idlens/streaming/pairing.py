"""Front and back of a session paired as they arrive, with state and timers (STR-2)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAIR = "session_id bigint, front_capture string, back_capture string, first_ms bigint, state string"
WAITING = "capture_id string, side string, ms bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State with timers needs the RocksDB store; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def pair_sides(captures: DataFrame, gap_ms: int = 30 * 60 * 1000, delay: str = "1 hour") -> DataFrame:
    """PAIR rows from a stream of captures (session_id, capture_id, seq, side, captured_at).

    A session keeps at most one waiting capture. The next capture of the session pairs
    with it if it is of the other side and at most `gap_ms` away, and the pair leaves at
    once ("pair"); otherwise the waiting one leaves alone ("alone") and the new one
    waits. When the watermark passes a waiting capture's time plus the gap, its timer
    lets it leave alone. Captures of a batch are taken in the order of time and seq;
    those of other sides than front and back, or later than the watermark, are left out.
    """

    class Sides(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getValueState("waiting", WAITING)

        @staticmethod
        def out(session, first, second, state: str) -> Row:
            ids = {first[1]: first[0]} | ({second.side: second.capture_id} if second else {})
            return Row(session_id=session, front_capture=ids.get("front"), back_capture=ids.get("back"), first_ms=first[2], state=state)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            # every call on the state is a message to the JVM, so it is read and written once a batch
            before = first = self.waiting.get() if self.waiting.exists() else None
            for row in sorted(rows, key=lambda r: (r.ms, r.seq)):
                if first is not None and first[1] != row.side and abs(row.ms - first[2]) <= gap_ms:
                    yield self.out(key[0], first, row, "pair")
                    first = None
                    continue
                if first is not None:
                    yield self.out(key[0], first, None, "alone")
                first = (row.capture_id, row.side, row.ms)
            if before is not None and (first is None or first[2] != before[2]):
                self.handle.deleteTimer(before[2] + gap_ms)
            if first is None:
                if before is not None:
                    self.waiting.clear()
            elif first is not before:
                self.waiting.update(first)
                if before is None or first[2] != before[2]:
                    self.handle.registerTimer(first[2] + gap_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            first = self.waiting.get() if self.waiting.exists() else None
            if first is not None and first[2] + gap_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.waiting.clear()
                yield self.out(key[0], first, None, "alone")

        def close(self) -> None:
            pass

    sides = captures.withWatermark("captured_at", delay).where(F.col("side").isin("front", "back")).select(
        F.col("session_id").cast("bigint").alias("session_id"), "capture_id", "side", F.col("seq").cast("bigint").alias("seq"),
        F.unix_millis("captured_at").alias("ms"), "captured_at")
    return sides.groupBy("session_id").transformWithState(
        statefulProcessor=Sides(), outputStructType=PAIR, outputMode="Append", timeMode="EventTime")
