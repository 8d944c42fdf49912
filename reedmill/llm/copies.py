"""Problem 4: records that differ only in formatting, collapsed to one each, over billions of rows.

Every row gets a canonical form (letters, digits and glyphs in lower case; exchangeable fields in sorted order) and a 64-bit hash of
it. Each partition builds two Bloom filters of its hashes, bits hit at least once and bits hit repeatedly. They are merged
slice by slice: a bit is repeated if any partition says so or if two partitions hit it, which is a saturating counter, so the merge is
exact. A row whose bits aren't all repeated is proven single and never shuffled; only possible repeats are grouped exactly,
by a 192-bit key, with partial aggregation before the shuffle, so one group may hold a third of all rows.

The filters grow with the table, 8 bits a row and hash function. Beyond ``max_bits`` they are split by the first bits of the hash: rows are then kept in a table by
that prefix, each prefix is probed with its own filter, and no worker or driver ever holds more than one filter of ``3 * max_bits / 8`` bytes (100 MB as set).
Every row is made canonical once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.bind import settled
from ..session import cut_lineage, written

#: Odd multipliers of the three hash functions (any odd 64-bit numbers do).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SLICE = 16  # log2 of the bits in a slice
FLUSH_ROWS = 1_000_000


def canonical(*fields: Column) -> Column:
    """The compared form: only letters, digits and private-use glyphs count, in lower case; fields may be exchanged; null is empty. Null if nothing is left."""
    bare = [F.lower(F.regexp_replace(F.coalesce(f, F.lit("")), r"[^\p{L}\p{N}\p{Co}]+", "")) for f in fields]
    return F.when(F.concat(*bare) != "", F.array_join(F.array_sort(F.array(*bare)), "\u0001"))


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bit of each hash in each of the three filters laid end to end; 2**bits bits a filter."""
    h = hashes.astype(np.int64).view(np.uint64)
    h = h ^ (h >> np.uint64(31))
    return [((h * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) + (j << bits) for j, m in enumerate(MULTIPLIERS)]


def _pack(low: np.ndarray) -> bytes:
    """Bits of a slice: 16-bit positions if few, else a bitmap (told apart by length 8192 plus a mark)."""
    if len(low) < 4000:
        return b"p" + low.astype(np.uint16).tobytes()
    full = np.zeros(1 << SLICE, np.bool_)
    full[low] = True
    return b"b" + np.packbits(full).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"p":
        full = np.zeros(1 << SLICE, np.bool_)
        full[np.frombuffer(data, np.uint16, offset=1)] = True
        return full
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).astype(np.bool_)


def _prefix(hashes: np.ndarray, prefix_bits: int) -> np.ndarray:
    """The first bits of each hash."""
    return (hashes.view(np.uint64) >> np.uint64(64 - prefix_bits)).astype(np.int64) if prefix_bits else np.zeros(len(hashes), np.int64)


def _partition_filters(bits: int, prefix_bits: int):
    """Filters of the rows of a partition as slices. Slices are numbered through all prefixes, 4 << (bits - SLICE) a prefix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(parts: list[np.ndarray]) -> pd.DataFrame:
            h = np.concatenate(parts).astype(np.int64)
            shift = _prefix(h, prefix_bits) << (bits + 2)
            places = np.concatenate([p + shift for p in _places(h, bits)])
            once, counts = np.unique(places, return_counts=True)
            low, high, again = once & ((1 << SLICE) - 1), once >> SLICE, counts > 1
            cuts = np.flatnonzero(np.diff(high)) + 1
            rows = [
                (int(hi[0]), _pack(lo), _pack(lo[re]))
                for lo, hi, re in zip(np.split(low, cuts), np.split(high, cuts), np.split(again, cuts), strict=True)
            ]
            return pd.DataFrame(rows, columns=["slice", "once", "again"])

        held: list[np.ndarray] = []
        for b in batches:
            if len(b):
                held.append(b["h"].to_numpy())
            if sum(map(len, held)) >= FLUSH_ROWS:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    return run


def _merge_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by slice; one slice is held at a time."""
    now, once, again = None, None, None
    for b in batches:
        for s, o, a in zip(b["slice"], b["once"], b["again"], strict=True):
            if s != now:
                if now is not None and again.any():
                    yield pd.DataFrame({"slice": [now], "again": [np.packbits(again).tobytes()]})
                now, once, again = s, np.zeros(1 << SLICE, np.bool_), np.zeros(1 << SLICE, np.bool_)
            o = _unpack(o)
            again |= _unpack(a) | (once & o)
            once |= o
    if now is not None and again.any():
        yield pd.DataFrame({"slice": [now], "again": [np.packbits(again).tobytes()]})


def _probe(shared, bits: int):
    @F.pandas_udf(BooleanType())
    def repeated(h: pd.Series) -> pd.Series:
        data = shared.value
        out = np.ones(len(h), np.bool_)
        for p in _places(h.to_numpy(), bits):
            out &= (data[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(out)

    return repeated


def repeat_flags(rows: DataFrame, hash_col: str, max_bits: int = 1 << 28) -> DataFrame:
    """rows with ``maybe``: whether the hash may occur again; true for all true repeats. rows is read several times, so it should be a checkpoint or a table."""
    n = rows.count()
    want = max(SLICE, int(np.ceil(np.log2(max(1, n * 8)))))
    prefix_bits = max(0, want - int(np.log2(max_bits)))
    bits = want - prefix_bits
    merged = (
        rows.select(F.col(hash_col).alias("h"))
        .mapInPandas(_partition_filters(bits, prefix_bits), "slice long, once binary, again binary")
        .repartition("slice")
        .sortWithinPartitions("slice")
        .mapInPandas(_merge_slices, "slice long, again binary")
    )
    if prefix_bits:
        merged = cut_lineage(merged)
        rows = written(rows.withColumn("prefix", F.shiftrightunsigned(F.col(hash_col), 64 - prefix_bits)), "prefix")
    step, a_prefix = (1 << SLICE) >> 3, 4 << (bits - SLICE)
    out = None
    for k in range(1 << prefix_bits):
        packed = np.zeros((3 << bits) >> 3, np.uint8)
        for r in merged.where(F.col("slice").between(k * a_prefix, (k + 1) * a_prefix - 1)).toLocalIterator():  # at most 3 * max_bits / 8 bytes
            at = (r["slice"] - k * a_prefix) * step
            packed[at : at + step] = np.frombuffer(r["again"], np.uint8)
        shared = rows.sparkSession.sparkContext.broadcast(packed)
        part = rows.where(F.col("prefix") == k).drop("prefix") if prefix_bits else rows
        part = part.withColumn("maybe", _probe(shared, bits)(F.col(hash_col)))
        if prefix_bits:  # one filter at a time in the workers' memory
            part = cut_lineage(part)
            shared.unpersist()
        out = part if out is None else out.unionAll(part)
    return out


def possible_repeats(rows: DataFrame, hash_col: str, max_bits: int = 1 << 28) -> DataFrame:
    """The rows whose hash may occur again, all true repeats among them."""
    return repeat_flags(rows, hash_col, max_bits).where("maybe").drop("maybe")


def keyed(tables: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """(tab, id, h, digest) of every row with content. tables: name, rows, id column, compared columns. Rows of two tables are never copies of each other."""
    parts = [settled(df.select(F.lit(tab).alias("tab"), F.col(row_id).cast("long").alias("id"), canonical(*[F.col(c) for c in cols]).alias("c"))) for tab, df, row_id, cols in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    named = F.concat_ws("\u0002", "tab", "c")
    return out.where("c IS NOT NULL").select("tab", "id", F.xxhash64(named).alias("h"), F.unhex(F.md5(named)).alias("digest"))


def copies(rows: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """(tab, first_id, copy_id): for every group of copies each member but its smallest id. Null ids are ignored; an id delivered twice is one row."""
    maybe = cut_lineage(possible_repeats(cut_lineage(rows.where(F.col("id").isNotNull())), "h", max_bits))
    key = ["tab", "h", "digest"]
    groups = maybe.groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return maybe.join(groups, key).where("id > first_id").select("tab", "first_id", F.col("id").alias("copy_id")).distinct()


def collapse(rows: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """(tab, first_id, n_copies): one row for each distinct record. Singles proven by the filter are passed on without a shuffle or join."""
    flagged = repeat_flags(cut_lineage(rows.where(F.col("id").isNotNull())), "h", max_bits)
    groups = flagged.where("maybe").groupBy("tab", "h", "digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies")).select("tab", "first_id", "n_copies")
    return groups.unionByName(flagged.where("NOT maybe").select("tab", F.col("id").alias("first_id"), F.lit(1).cast("long").alias("n_copies")))
