"""Training logs: scalars of event files (records of length, checksum, protocol buffer)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _records(data: bytes) -> Iterator[bytes]:
    """Payloads of the records; a cut-off last record, as of a run still writing, ends the file."""
    at = 0
    while at + 12 <= len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 12 + n > len(data):
            return
        yield data[at + 12 : at + 12 + n]
        at += 16 + n


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers of the varint kind, raw bytes of all others."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def scalars(data: bytes) -> list[tuple[str, int, float]]:
    """(tag, step, value) of an event file: plain values and one-element float tensors."""
    out = []
    for record in _records(data):
        event = list(_fields(record))
        step = next((v for k, v in event if k == 2 and isinstance(v, int)), 0)
        for summary in (v for k, v in event if k == 5):
            for value in (v for k, v in _fields(summary) if k == 1):
                tag, x = "", None
                for k, v in _fields(value):
                    if k == 1:
                        tag = v.decode("utf-8", "replace")
                    elif k == 2 and len(v) == 4:
                        x = struct.unpack("<f", v)[0]
                    elif k == 8:
                        raw = [w for j, w in _fields(v) if j in (4, 5) and isinstance(w, bytes) and len(w) == 4]
                        x = struct.unpack("<f", raw[0])[0] if len(raw) == 1 else x
                if x is not None:
                    out.append((tag, step, x))
    return out


def training_logs(spark: SparkSession, path: str, pattern: str = "events.out.tfevents.*") -> DataFrame:
    """(run, file, place, tag, step, value) of all event files below a folder; run is the file's folder, place the value's place in its file. A file is one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                folder, _, file = p.rpartition("/")
                rows = [(folder.rpartition("/")[2], file, i, *r) for i, r in enumerate(scalars(data))]
                yield pd.DataFrame(rows, columns=["run", "file", "place", "tag", "step", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(read, "run string, file string, place long, tag string, step long, value double")
