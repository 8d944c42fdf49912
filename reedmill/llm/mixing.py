"""Problem 3: records of several sources mixed to target shares of the total size, with capped repetition.

Each source's rows, in a pseudorandom order, are one stream of tokens, cut into blocks of exactly ``block_tokens`` tokens (the source's last block is the rest) by a distributed prefix
sum; a row that lies across a cut stands in each of its blocks with its part. The total is the largest for which every source can give its share without
using a block more often than allowed. The slots of each output shard are drawn from the multinomial distribution of the shares, and the draws are
corrected to the exact totals: on the driver for a bounded number of groups of shards, in the workers for the shards of each group. Slot g of a source is pass g div n, index g mod n of its
n blocks; a pseudorandom permutation
of the indexes for each source and pass (swap-or-not rounds) gives the block, so within a pass no block comes twice. Slots and rows are joined by
block, a key that no source can make hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_TOKENS = 128
ROWS_A_BUCKET = 200_000
GROUPS, GROUP_CELLS = 4096, 1_000_000
SLOTS_A_SHARD = 256
ROUNDS = 24


def blocks(rows: DataFrame, seed: int, block_tokens: int) -> DataFrame:
    """(source, ..., block, begin, n_tokens): the part of each row, from token ``begin`` on, in each of its blocks; blocks are numbered from 0 within the source."""
    n_buckets = max(16, rows.count() // ROWS_A_BUCKET)
    keyed = rows.withColumn("o", F.xxhash64("tab", "id", F.lit(seed))).withColumn("bucket", F.pmod("o", F.lit(n_buckets)))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("s").fillna(0, ["before"])
    run = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("o", "tab", "id").rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("before") + F.coalesce(run, F.lit(0))
    placed = keyed.join(before, ["source", "bucket"]).withColumn("start", start).drop("o", "bucket", "before")
    parts = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block_tokens}, (start + n_tokens - 1) div {block_tokens})")))  # as many as the row is long
    begin = F.greatest(F.lit(0), F.col("block") * block_tokens - F.col("start"))
    end = F.least("n_tokens", (F.col("block") + 1) * block_tokens - F.col("start"))
    return parts.withColumn("begin", begin).withColumn("n_tokens", end - F.col("begin")).drop("start")


def shard_draws(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources counts: multinomial draws, then corrected so that source s has slots[s] in all."""
    total = int(slots.sum())
    rng = np.random.default_rng(seed)
    sizes = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    draws = rng.multinomial(sizes, slots / max(1, total))
    for s, want in enumerate(slots):
        while (over := int(draws[:, s].sum() - want)) != 0:
            step = np.sign(over)
            can = np.flatnonzero(draws[:, s] > 0) if over > 0 else np.arange(shards)
            each = max(1, abs(over) // len(can))
            pick = rng.permutation(can)[: min(len(can), abs(over))]
            draws[pick, s] -= step * np.minimum(each, draws[pick, s]) if over > 0 else step * each
    return draws


def _shards(names: list[str], blocks_of: list[int], seed: int):
    """The shards of each group of shards: how many slots of each source, and which slots of the source they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, shard0, n, counts, firsts in zip(b["grp"], b["shard0"], b["shards"], b["counts"], b["firsts"], strict=True):
                draws = shard_draws(np.array(counts, np.int64), int(n), seed + 1 + int(g))
                first = np.cumsum(draws, axis=0) - draws + np.array(firsts, np.int64)
                shard, s = np.nonzero(draws)
                for at in range(0, len(shard), 50_000):
                    i, j = shard[at : at + 50_000], s[at : at + 50_000]
                    yield pd.DataFrame({"shard": int(shard0) + i, "source": [names[x] for x in j], "n": draws[i, j], "g0": first[i, j], "nb": [blocks_of[x] for x in j]})

    return run


def permuted(x: str, n: str, key: str) -> str:
    """SQL of a pseudorandom permutation of 0..n-1: ROUNDS swap-or-not steps, each its own inverse, so the whole is one to one for any n."""
    y = f"pmod(pmod(xxhash64({key}, r), {n}) - a, {n})"
    return f"aggregate(sequence(1, {ROUNDS}), {x}, (a, r) -> if(xxhash64({key}, r, greatest(a, {y})) % 2 = 0, a, {y}))"


def mix(rows: DataFrame, targets: list[tuple[str, float, int]], *, seed: int = 42, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(shard, slot, source, tab, id, begin, use_no, n_tokens): the mixture, one row for each use of a record, or of its part from token ``begin`` on.

    rows: tab, id, source (tidy), n_tokens. targets: source, share, most repeats. Rows of other sources and rows without a token are no part of
    it; a target source without rows has no share, and the others keep theirs in proportion. Empty input gives no rows.
    """
    spark = rows.sparkSession
    names = [s for s, _, _ in targets]
    used = rows.where(F.col("source").isin(names) & (F.col("n_tokens") > 0)).select("tab", "id", "source", "n_tokens")
    packed = cut_lineage(blocks(used, seed, block_tokens))
    have = {r["source"]: (r["nb"] + 1, r["tok"]) for r in packed.groupBy("source").agg(F.max("block").alias("nb"), F.sum("n_tokens").alias("tok")).collect()}  # a row a target
    live = [(s, share, reps, *have[s]) for s, share, reps in targets if s in have and share > 0 and reps > 0]
    plan = []
    if live:
        total = min(tok * reps / share for _, share, reps, _, tok in live)
        slots = np.array([max(1, min(nb * reps, round(total * share * nb / tok))) for _, share, reps, nb, tok in live], np.int64)
        shards = int(max(1, slots.sum() // SLOTS_A_SHARD))
        groups = min(shards, GROUPS, max(1, GROUP_CELLS // len(live)))
        draws = shard_draws(slots, groups, seed)
        first = np.cumsum(draws, axis=0) - draws
        edge = [shards * g // groups for g in range(groups + 1)]
        plan = [(g, edge[g], edge[g + 1] - edge[g], draws[g].tolist(), first[g].tolist()) for g in range(groups)]
    grouped = spark.createDataFrame(plan, "grp int, shard0 long, shards long, counts array<long>, firsts array<long>").repartition("grp")
    table = grouped.mapInPandas(_shards([x[0] for x in live], [int(x[3]) for x in live], seed), "shard long, source string, n long, g0 long, nb long")
    slot = table.select("shard", "source", "nb", F.explode(F.expr("sequence(g0, g0 + n - 1)")).alias("g")).selectExpr("shard", "source", "g", "nb", "g div nb AS use_no", "g % nb AS x")
    chosen = slot.selectExpr("shard", "source", "g AS slot", "use_no", f"{permuted('x', 'nb', f'source, use_no, {seed}')} AS block")
    return chosen.join(packed, ["source", "block"]).select("shard", "slot", "source", "tab", "id", "begin", "use_no", "n_tokens")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_tokens, actual_share, n_uses, n_rows, most_uses) for every target, the absent ones with zeros. A row is used once in each pass that has a part of it."""
    per_use = mixed.groupBy("source", "tab", "id", "use_no").agg(F.sum("n_tokens").alias("t"))
    per_row = per_use.groupBy("source", "tab", "id").agg(F.count("*").alias("uses"), F.sum("t").alias("t"))
    per = per_row.groupBy("source").agg(F.sum("t").alias("n_tokens"), F.sum("uses").alias("n_uses"), F.count("*").alias("n_rows"), F.max("uses").alias("most_uses"))
    total = per.agg(F.sum("n_tokens").alias("total"))
    goal = targets.select("source", "target_share", F.col("max_repeats").cast("long").alias("max_repeats"))
    joined = goal.join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    return joined.select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens",)], F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_uses", "n_rows", "most_uses")])
