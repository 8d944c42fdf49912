"""Problem 7: documents into containers of one capacity, with as little unused room as possible.

Hierarchical multi-length packing. Documents are routed by length to tiers of context size: more than half the capacity, more than a quarter, and so
on, the last tier taking the rest. Tier by tier, longest first, what is left of the tier is packed best-fit decreasing into containers of its own; then the
gaps of these long windows are filled from all shorter tiers, the longest fitting documents first, before those are packed themselves. Containers of alike tier
and fill are dealt round to the step groups, so that groups hold alike numbers of tokens and of containers of each tier.

Only lengths matter, and there are at most ``capacity`` different ones: the histogram of lengths is the whole problem, whatever the number of
documents. The plan is a list of at most a few runs a length: so many containers, so many items each. Documents are ranked within their length by a
distributed prefix sum and pick their run by rank; the table of runs is broadcast (its size is bound by the number of lengths).

A document longer than the capacity, and only such, is divided into full containers and a rest, which is packed like a document.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TIERS = 4
ROWS_A_BUCKET = 200_000


class _Containers:
    """Groups of alike containers, found by gap."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.groups: dict[int, list] = {}  # number -> [containers, items, tier]
        self.gaps: dict[int, list[int]] = {}  # gap -> group numbers
        self.order: list[int] = []  # sorted gaps that occur

    def put(self, count: int, items: list[tuple[int, int]], gap: int, tier: int) -> None:
        self.groups[self.made] = [count, items, tier]
        if gap not in self.gaps:
            bisect.insort(self.order, gap)
            self.gaps[gap] = []
        self.gaps[gap].append(self.made)
        self.made += 1

    def fill(self, length: int, n: int) -> int:
        """Places items into the smallest gaps with room; the number of those left."""
        while n > 0 and (at := bisect.bisect_left(self.order, length)) < len(self.order):
            gap = self.order[at]
            g = self.gaps[gap][-1]
            count, items, tier = self.groups[g]
            k = gap // length
            take, used = (min(count, n // k), k) if n >= k else (1, n)
            self.groups[g][0] -= take
            n -= take * used
            if not self.groups[g][0]:
                del self.groups[g]
                self.gaps[gap].pop()
                if not self.gaps[gap]:
                    del self.gaps[gap]
                    self.order.pop(at)
            self.put(take, [*items, (length, used)], gap - used * length, tier)
        return n

    def open(self, length: int, n: int, tier: int) -> None:
        k = self.capacity // length
        if n >= k:
            self.put(n // k, [(length, k)], self.capacity - k * length, tier)
        if n % k:
            self.put(1, [(length, n % k)], self.capacity - n % k * length, tier)


def tier_of(length: int, capacity: int, tiers: int) -> int:
    """0 for more than half the capacity, 1 for more than a quarter, ..., tiers - 1 for the rest."""
    return min(tiers - 1, (capacity // length).bit_length() - 1)


def plan_runs(histogram: dict[int, int], capacity: int, tiers: int = 1) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, items a container, first container) and the number of containers. One tier is plain best-fit decreasing."""
    runs, n = plan_tiers(histogram, capacity, tiers)
    return [r[:5] for r in runs], n


def plan_tiers(histogram: dict[int, int], capacity: int, tiers: int = TIERS) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs as of ``plan_runs`` with the tier of their containers."""
    left = dict(histogram)
    lengths = sorted(left, reverse=True)
    all_groups: list[list] = []
    for tier in range(tiers):
        bins = _Containers(capacity)
        for length in lengths:  # the tier by itself
            if left[length] and tier_of(length, capacity, tiers) == tier:
                if n := bins.fill(length, left[length]):
                    bins.open(length, n, tier)
                left[length] = 0
        for length in lengths:  # gaps from shorter tiers
            if left[length] and bins.order and length <= bins.order[-1]:
                left[length] = bins.fill(length, left[length])
        all_groups += bins.groups.values()
    runs, rank, container = [], dict.fromkeys(histogram, 0), 0
    for count, items, tier in sorted(all_groups, key=lambda g: (g[2], sum(x * k for x, k in g[1]), g[1])):
        for length, k in items:
            runs.append((length, rank[length], rank[length] + count * k, k, container, tier))
            rank[length] += count * k
        container += count
    return runs, container


def pack(sizes: DataFrame, *, item_id: str, size: str, capacity: int, group_size: int = 64, tiers: int = TIERS) -> DataFrame:
    """(item_id, piece, n_tokens, container_id, step_group, tier): every item in one container, or, if it exceeds the capacity, in several.

    Items of null or zero size take no room: piece 0, container null. Repeated ids are packed as separate items.
    """
    if capacity < 1 or tiers < 1:
        raise ValueError("capacity and tiers must be at least 1")
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    whole = sizes.select(F.col(item_id).alias("item"), n.alias("n"))
    pieces = cut_lineage(
        whole.where("n > 0")
        .select("item", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity})")).alias("piece"))
        .select("item", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("len"), F.xxhash64("item", "piece").alias("o"))
    )
    pieces = pieces.withColumn("bucket", F.pmod("o", F.lit(max(16, pieces.count() // ROWS_A_BUCKET))))
    counts = pieces.groupBy("len", "bucket").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("c").fillna(0, ["before"])
    histogram = {r["len"]: r["c"] for r in counts.groupBy("len").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    runs, containers = plan_tiers(histogram, capacity, tiers)
    table = spark.createDataFrame(runs, "len long, lo long, hi long, k long, c0 long, tier int")
    groups = max(1, -(-containers // group_size))
    ranked = pieces.join(before, ["len", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("len", "bucket").orderBy("o", "item")) - 1)
    placed = ranked.join(F.broadcast(table), "len").where("rank >= lo AND rank < hi").withColumn("container", F.expr("c0 + (rank - lo) div k"))
    packed = placed.select(F.col("item").alias(item_id), "piece", F.col("len").alias("n_tokens"), F.col("container").alias("container_id"), (F.col("container") % groups).alias("step_group"), "tier")
    none = F.lit(None).cast("long")
    return packed.unionByName(whole.where("n <= 0").select(F.col("item").alias(item_id), F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("n_tokens"), none.alias("container_id"), none.alias("step_group"), none.cast("int").alias("tier")))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, unused room, share filled, fullest and emptiest step group."""
    per = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.first("step_group").alias("g"))
    steps = per.groupBy("g").agg(F.count("*").alias("n"), F.sum("used").alias("used"))
    return steps.agg(
        F.sum("n").alias("n_containers"), F.sum("used").alias("n_tokens"), (F.sum("n") * capacity - F.sum("used")).alias("unused"),
        (F.sum("used") / (F.sum("n") * capacity)).alias("filled"), F.count("*").alias("n_groups"), F.max("used").alias("fullest_group"), F.min("used").alias("emptiest_group"),
    )


def tier_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(tier, n_containers, n_own, n_filled_in, n_tokens, filled): containers of each tier, pieces of the tier's own lengths and of shorter tiers in them, and the share of room used."""
    used = packed.where("container_id IS NOT NULL")
    longest = used.groupBy("tier", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.count_if(F.col("n_tokens") * F.pow(F.lit(2.0), F.col("tier") + 1) > capacity).alias("own"))
    return longest.groupBy("tier").agg(
        F.count("*").alias("n_containers"), F.sum("own").alias("n_own"), F.sum(F.col("n") - F.col("own")).alias("n_filled_in"), F.sum("t").alias("n_tokens"),
        (F.sum("t") / (F.count("*") * capacity)).alias("filled"),
    )
