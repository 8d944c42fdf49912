"""Structured Streaming forms of the feeds: sources, keep-last, expiry, dedup, windows, exactly-once increments."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.feeds import paced_scene, parse_bubble, parse_control


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of files as they arrive in a folder."""
    return spark.readStream.text(path)


def bubble_stream(lines: DataFrame) -> DataFrame:
    """(text, secs) of feed lines, blank ones dropped."""
    said, secs = parse_bubble(F.col("value"))
    return lines.select(said.alias("text"), secs.alias("secs")).where("text IS NOT NULL")


def control_stream(lines: DataFrame) -> DataFrame:
    """Valid control messages of JSON lines."""
    return lines.select(parse_control(F.col("value")).alias("m")).where("m IS NOT NULL").select("m.*")


def windowed_counts(events: DataFrame, ts: str, key: str, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window and key; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), key).agg(F.count("*").alias("n"))


def fresh_only(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """First row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def latest_state(events: DataFrame, key: str, ts: str, value: str, ttl_ms: int = 0) -> DataFrame:
    """(key, value, expired): the last value of each key by time, and, with a time to live, a row without value when it has run out.

    State is one value a key. Rows of null key or time are ignored, a late row never replaces a newer value.
    """
    clean = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(value).cast("string").alias("v")).where("key IS NOT NULL AND t IS NOT NULL")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "value": [None], "expired": [True]})
            return
        t, v = state.get if state.exists else (-(1 << 62), None)
        changed = False
        for b in batches:
            last = b.loc[b["t"].idxmax()] if len(b) else None
            if last is not None and last["t"] >= t:
                t, v, changed = int(last["t"]), last["v"], True
        if changed:
            state.update((t, v))
            yield pd.DataFrame({"key": [k[0]], "value": [v], "expired": [False]})
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return clean.groupBy("key").applyInPandasWithState(step, "key string, value string, expired boolean", "t long, v string", "update", timeout)


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes what is available in batches, resuming where the checkpoint ends; ``each`` must be idempotent by batch number."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(output: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends rows whose key isn't in the output yet, each once."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(output)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(output).select(*key), key, "left_anti")
        new.write.mode("append").parquet(output)

    return each


def append_with_ledger(output: str, ledger: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for (key, text): rows with a text go to the output, every key to the ledger after them, also one that yields nothing.

    Both are kept by batch number, so a batch that is run again after a failure replaces what it wrote before.
    """

    def each(batch: DataFrame, number: int) -> None:
        for rows, path in ((batch.where("text IS NOT NULL"), output), (batch.select(key).distinct(), ledger)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def paced_feed(spark: SparkSession, scenes: list[str], interval_s: int = 1) -> DataFrame:
    """(tick, at, scene): a row every interval, without a scene and with a drawn one by turns."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % interval_s == 0)
    tick = F.expr(f"value div {interval_s}")
    return rate.select(tick.alias("tick"), F.col("timestamp").alias("at"), paced_scene(tick, F.abs(F.xxhash64(tick) % 1_000_000), scenes).alias("scene"))


def feed_lines(rows: DataFrame, text: str, seconds: float) -> DataFrame:
    """Lines ``text<TAB>seconds`` as a consumer reads them; null and blank texts give none."""
    return rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(F.concat(F.col(text), F.lit(f"\t{seconds:g}")).alias("value"))


class Tracker(Protocol):
    """A source of rows: poll(after) gives the rows after an offset and the new offset; it must give the same rows again for the same offsets."""

    def poll(self, after: int, until: int | None = None) -> tuple[list[tuple], int]: ...


def tracked(spark: SparkSession, tracker: Tracker, schema: str) -> DataFrame:
    """The rows of a tracker as a stream."""
    name = "tracker_" + uuid.uuid4().hex

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:  # noqa: N802
            return {"at": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, at = tracker.poll(start["at"])
            return iter(rows), {"at": at}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
            return iter(tracker.poll(start["at"], end["at"])[0])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:  # noqa: N802, ARG002
            return Reader()

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()
