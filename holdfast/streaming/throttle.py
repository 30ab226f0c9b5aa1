"""The request quota as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from holdfast.operators.throttle import MINUTE_US, QUOTA, request_log, window_walk
from holdfast.sources.workspace import fresh_path

HOUR_US = 3_600_000_000
_RESULT = "event_id long, user_id long, accepted boolean, retry_after int, late boolean"
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def quota_processor(window_us: int, quota: int, timed: bool) -> StatefulProcessor:
    """The state machine, defined inside the call so that it travels to the workers whole."""

    walk = window_walk(window_us, quota)

    def closing_ms(opened: int) -> int:
        return (int(opened) + window_us) // 1000 + 1

    class QuotaProcessor(StatefulProcessor):
        """Keeps (opened, seen) per key, and one timer at the close of its open window.

        When the watermark passes that time, no request of the window can come any more and
        the key's state goes. A request older than the open window but within the slack
        counts in that window and is flagged late.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.window = handle.getValueState("window", "opened long, seen long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            before = self.window.get() if self.window.exists() else (None, 0)
            # One key's rows of one micro-batch, whose size the source's trigger limit sets.
            batch = pd.concat([r[["event_id", "at"]] for r in rows]).sort_values(["at", "event_id"])
            at = batch["at"].to_numpy()
            opened_at, accepted, opened, seen = walk(at, *before)
            self.window.update((opened, seen))
            if timed and opened != before[0]:
                if before[0] is not None:
                    self.handle.deleteTimer(closing_ms(before[0]))
                self.handle.registerTimer(closing_ms(opened))
            wait = -((at - opened_at - window_us) // 1_000_000)
            yield pd.DataFrame(
                {
                    "event_id": batch["event_id"].to_numpy(),
                    "user_id": key[0],
                    "accepted": accepted,
                    "retry_after": pd.Series(wait, dtype="Int32").mask(accepted),
                    "late": at < opened_at,
                }
            )

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.window.clear()
            return iter(())

        def close(self) -> None:
            pass

    return QuotaProcessor()


def throttle_stream(
    events: DataFrame, window_us: int = MINUTE_US, quota: int = QUOTA, slack_us: int | None = HOUR_US
) -> DataFrame:
    """Streaming counterpart of ``throttle_batch``.

    The watermark follows the requests' own time with ``slack_us`` between, so a replay of an
    old log expires as a live one does. Spark admits no request older than the watermark;
    without a slack there is no watermark, every request is admitted, and no state expires.
    """
    log = request_log(events)
    if slack_us is None:
        timed, mode = log, "None"
    else:
        timed = log.withColumn("_at", F.timestamp_micros("at")).withWatermark("_at", f"{slack_us} microseconds")
        mode = "EventTime"
    return timed.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=quota_processor(window_us, quota, slack_us is not None),
        outputStructType=_RESULT,
        outputMode="Append",
        timeMode=mode,
    )


def open_log(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", bytes_per_trigger: int = 1 << 30
) -> DataFrame:
    """Files of a folder as a streaming log; the byte limit bounds a micro-batch."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxBytesPerTrigger", bytes_per_trigger)
        .parquet(folder)
    )


@contextmanager
def _rocksdb_state(spark: SparkSession):
    """Keyed state needs the RocksDB store; the session's own choice is put back."""
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)


def replay(
    log: DataFrame, window_us: int = MINUTE_US, quota: int = QUOTA, slack_us: int | None = HOUR_US, progress_of: list | None = None
) -> DataFrame:
    """Run the stream over everything the log holds now and return the table it wrote.

    ``progress_of`` takes the progress records of the micro-batches.
    """
    spark = log.sparkSession
    out, progress = fresh_path(spark, "throttle-out"), fresh_path(spark, "throttle-progress")
    decided = throttle_stream(log, window_us, quota, slack_us)
    with _rocksdb_state(spark):
        query = (
            decided.writeStream.format("parquet")
            .option("checkpointLocation", progress)
            .outputMode("append")
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
        if progress_of is not None:
            progress_of += query.recentProgress
    return spark.read.schema(decided.schema).parquet(out)
