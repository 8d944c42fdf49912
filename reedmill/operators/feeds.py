"""Batch forms of the event-feed operators; streaming.feeds has the running ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

DEFAULT_SECONDS = 4.0

#: Schema of a control message: one of four kinds, told by its tag.
CONTROL_SCHEMA = "type STRING, tuning MAP<STRING,DOUBLE>, style STRING, text STRING, secs FLOAT, force STRING"
#: Names of the built-in styles; case doesn't matter.
STYLES = ("sona", "walo", "laso", "jelo", "loje", "suwi", "musi", "lipu", "sitelen", "sewi")


def parse_bubble(line: Column) -> tuple[Column, Column]:
    """(text, seconds) of a line ``text<TAB>seconds``; a missing or bad number is 4.0; blank text is null."""
    parts = F.split(line, "\t", 2)
    said = F.nullif(strip(parts[0]), F.lit(""))
    secs = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("float"), F.lit(DEFAULT_SECONDS).cast("float"))
    return said, secs


def parse_control(line: Column) -> Column:
    """The control message of a JSON line, null if it is invalid or without effect (blank bubble, unknown style or kind)."""
    msg = F.from_json(line, CONTROL_SCHEMA)
    ok = (
        ((msg["type"] == "SetTuning") & msg["tuning"].isNotNull())
        | ((msg["type"] == "SetStyle") & F.lower(msg["style"]).isin(*STYLES))
        | ((msg["type"] == "Bubble") & (strip(F.coalesce(msg["text"], F.lit(""))) != ""))
        | ((msg["type"] == "Force") & msg["force"].isNotNull())
    )
    return F.when(ok, msg)


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; combines before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def neighbours(df: DataFrame, key: str, ts: str, order: list[str], values: list[str], *, following: bool = False, span_s: int = 86_400) -> DataFrame:
    """df with ``_has`` and ``_<value>`` of the row before (or after) of the same key.

    Windows cover a key's time spans, not the whole key, so a key with a third of all rows is spread over its spans; the first (last) row of a
    span takes its neighbour from the nearest span with rows, found among one row a span.
    """
    spans = df.withColumn("_span", F.floor(F.unix_micros(F.col(ts)) / (span_s * 1_000_000)))
    row, at = F.struct(*values), F.struct(*order)
    shift, pick = (F.lead, F.min_by) if following else (F.lag, F.max_by)
    edges = spans.groupBy(key, "_span").agg(pick(row, at).alias("_edge"))
    beyond = edges.withColumn("_beyond", shift("_edge").over(Window.partitionBy(key).orderBy("_span"))).select(F.col(key).alias("_key"), F.col("_span").alias("_at"), "_beyond")
    near = shift(row).over(Window.partitionBy(key, "_span").orderBy(*order))
    joined = spans.withColumn("_near", near).join(beyond, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_at")), "left")
    found = joined.withColumn("_found", F.coalesce("_near", "_beyond"))
    return found.select(*df.columns, F.col("_found").isNotNull().alias("_has"), *[F.col("_found")[v].alias(f"_{v}") for v in values])


def shown_intervals(df: DataFrame, key: str, ts: str, seconds: Column, order: list[str]) -> DataFrame:
    """df with ``shown_until``: the expiry of a message or the next message of its key, whichever is first."""
    near = neighbours(df, key, ts, order, [ts], following=True)
    expiry = F.timestamp_micros((F.unix_micros(F.col(ts)) + seconds * 1_000_000).cast("long"))
    return near.withColumn("shown_until", F.least(expiry, F.col(f"_{ts}"))).drop("_has", f"_{ts}")


def changes(df: DataFrame, key: str, ts: str, values: list[str], order: list[str]) -> DataFrame:
    """Rows at which one of the values differs from the row before of the same key, the first row among them."""
    near = neighbours(df, key, ts, order, values)
    moved = ~F.col("_has")
    for v in values:
        moved = moved | ~F.col(v).eqNullSafe(F.col(f"_{v}"))
    return near.where(moved).select(*df.columns)


def assembled(df: DataFrame, key: str, values: list[str], order: Column) -> DataFrame:
    """One row a key with the last known value of each partial column."""
    return df.groupBy(key).agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v) for v in values])


def frame_index(seconds: Column, fps: float, frames: int) -> Column:
    """The frame of an animation after some seconds in its clip."""
    return F.pmod(F.floor(seconds * fps), F.lit(frames))


def union_rect(a: list[Column], b: list[Column], width: Column, height: Column) -> list[Column]:
    """x0, y0, x1, y1 of the smallest rectangle round two (x0, y0, x1, y1), clamped to a surface."""
    zero = F.lit(0)
    lo = [F.greatest(F.least(p, q), zero) for p, q in zip(a[:2], b[:2], strict=True)]
    return [*lo, F.least(F.greatest(a[2], b[2]), width), F.least(F.greatest(a[3], b[3]), height)]


def paced_scene(tick: Column, draw: Column, scenes: list[str]) -> Column:
    """The scene of a tick of a paced feed: none at even ticks, else one drawn by a non-negative whole number."""
    return F.when((tick % 2 == 0) | F.lit(not scenes), F.lit("")).otherwise(F.get(F.array(*[F.lit(s) for s in scenes or [""]]), F.pmod(draw, F.lit(max(1, len(scenes)))).cast("int")))
