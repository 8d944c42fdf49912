"""Dedup, joins, splits and mixes over relations with an explicit order."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_order
from ..session import cut_lineage, small_side


def first_seen(df: DataFrame, key: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. The aggregate combines before its shuffle, so a hot key costs one row a task; null keys are one key."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), *[k.alias(n) for k, n in zip(key, names, strict=True)], F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"))
    return keyed.groupBy(*names).agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")


def repeats(df: DataFrame, key: Sequence[Column], order: Column) -> DataFrame:
    """df with ``is_repeat``: whether an earlier row has the same key. order must be unique."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(key, names, strict=True)], order.alias("_o"))
    firsts = keyed.groupBy(*names).agg(F.min("_o").alias("_first")).withColumnsRenamed({n: n + "f" for n in names})
    on = [F.col(n).eqNullSafe(F.col(n + "f")) for n in names]
    return keyed.join(firsts, on, "left").withColumn("is_repeat", F.col("_o") > F.col("_first")).drop(*names, *[n + "f" for n in names], "_o", "_first")


def distributed_rank(df: DataFrame, hex_key: str, name: str = "rank", ties: Sequence[str] = ()) -> DataFrame:
    """df with its 1-based rank by a hexadecimal key, without sorting in one task: counts of 4096 key ranges, then ranks within each."""
    bucketed = df.withColumn("_b", F.substring(hex_key, 1, 3))
    counts = bucketed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # 4096 rows
    within = F.row_number().over(Window.partitionBy("_b").orderBy(hex_key, *ties))
    return bucketed.join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + within).drop("_b", "_before")


def running_total(df: DataFrame, order: str, amount: Column, name: str, width: int = 500_000) -> DataFrame:
    """df with the total of ``amount`` up to each row by ``order``: totals of sampled ranges of about ``width`` rows, whatever the values, first, then within each range."""
    n = df.count() // width + 1
    ranged = cut_lineage(df.withColumn("_a", amount).repartitionByRange(n, order).withColumn("_r", F.spark_partition_id()))
    totals = ranged.groupBy("_r").agg(F.sum("_a").alias("_t"))  # a row a range
    before = totals.select("_r", F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_a").over(Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(before), "_r").withColumn(name, F.col("_before") + within).drop("_a", "_r", "_before")


def without_known(df: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key isn't in a ledger."""
    return df.join(known.select(*on).distinct(), list(on), "left_anti")


def first_n(df: DataFrame, order: Sequence[str], n: int, key: str, name: str = "held_out") -> DataFrame:
    """df with a flag on its first n rows: top-n selection, n is the feature's bound."""
    top = df.orderBy(*order).limit(n).select(F.col(key).alias("_k"), F.lit(True).alias(name))
    return df.join(small_side(top), F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(False)))


def group_split(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """df with ``split``: the share of groups that come first in a hash order are eval, rows follow their group. Null groups are train."""
    groups = df.where(F.col(group).isNotNull()).select(F.col(group).alias("_g")).distinct().withColumn("_h", hash_order(seed, F.col("_g")))
    n = groups.count()
    held = distributed_rank(groups, "_h", "_rank", ["_g"]).where(F.col("_rank") <= int(n * share)).select("_g", F.lit("eval").alias("split"))
    return df.join(held, F.col(group) == F.col("_g"), "left").drop("_g").withColumn("split", F.coalesce("split", F.lit("train")))


def source_cap(df: DataFrame, source: str, capped: str, n: int, seed: int, key: str) -> DataFrame:
    """All rows of other sources and the n rows of the capped source that come first in a hash order."""
    some = df.where(F.col(source) == capped).withColumn("_h", hash_order(seed, F.col(key)))
    kept = distributed_rank(some, "_h", "_rank", [key]).where(F.col("_rank") <= n).drop("_h", "_rank")
    return df.where(~F.col(source).eqNullSafe(F.lit(capped))).unionByName(kept)


def weighted_union(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Union in which each part stands as often as its weight says, with ``copy`` numbers from 1."""
    out = None
    for df, times in parts:
        if times > 0:
            many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
            out = many if out is None else out.unionByName(many)
    return out


def hub_members(df: DataFrame, hub: str, member: Column) -> DataFrame:
    """(hub, member, n_partners) of each distinct member of a hub with at least two: the hub's pairs in linear form, whatever its size."""
    members = df.select(F.col(hub).alias("hub"), member.alias("member")).where(F.col("hub").isNotNull() & F.col("member").isNotNull()).distinct()
    sizes = members.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(sizes, "hub").select("hub", "member", (F.col("n") - 1).alias("n_partners"))


def hub_pairs(df: DataFrame, hub: str, member: str, most: int = 100) -> DataFrame:
    """Ordered pairs (a, b) of different members of a hub. For members from a small domain: a hub of more than ``most`` members is an error; hub_members has the linear form for any."""
    m = df.select(F.col(hub).alias("hub"), F.trim(F.col(member)).alias("a")).where(F.col("hub").isNotNull() & F.col("a").isNotNull()).distinct()
    if not m.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > most).isEmpty():
        raise ValueError(f"a hub has more than {most} members; use hub_members")
    return m.join(m.withColumnRenamed("a", "b"), "hub").where("a <> b")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that are in b too; nulls are equal."""
    return a.intersect(b)


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that aren't in b; nulls are equal."""
    return a.subtract(b)


def chosen_union(parts: Mapping[str, DataFrame], skip: Collection[str] = (), name: str = "part") -> DataFrame:
    """Union of the parts that aren't skipped, in order, each row with its part's name; a skipped part is never read. All skipped gives an empty relation of the first part's columns."""
    unknown = set(skip) - set(parts)
    if unknown or not parts:
        raise ValueError(f"no such part: {sorted(unknown)}")
    out = None
    for key, df in parts.items():
        if key not in skip:
            named = df.withColumn(name, F.lit(key))
            out = named if out is None else out.unionByName(named)
    return out if out is not None else next(iter(parts.values())).limit(0).withColumn(name, F.lit(""))


def status_join(links: DataFrame, left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, reason, key: Sequence[str], order: str) -> DataFrame:  # noqa: ANN001
    """Links with both sides' columns and ``status``: tok_missing, eng_missing, the gate's reason, duplicate or keep, the first that holds.

    left and right have one row a key; reason() gives the gate's reason column, '' for a pass. Duplicates are later passing links of the same ``key`` columns.
    """
    joined = links.join(left.withColumn("_l", F.lit(True)), left_key, "left").join(right.withColumn("_r", F.lit(True)), right_key, "left")
    gated = joined.withColumn("_why", F.when(F.col("_l").isNull(), "tok_missing").when(F.col("_r").isNull(), "eng_missing").otherwise(F.concat(F.lit("tp_"), reason())))
    passed = F.col("_why") == "tp_"
    firsts = gated.where(passed).groupBy(*key).agg(F.min(order).alias("_first")).withColumnsRenamed({k: k + "_f" for k in key})
    on = [F.col(k).eqNullSafe(F.col(k + "_f")) for k in key]
    status = F.when(~passed, F.col("_why")).when(F.col(order) > F.col("_first"), "duplicate").otherwise("keep")
    return gated.join(firsts, on, "left").withColumn("status", status).drop("_l", "_r", "_why", "_first", *[k + "_f" for k in key])


def full_outer_curve(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    """(step, a, b, delta) over the steps of either side."""
    x, y = a.select(on, F.col(value).alias("a")), b.select(on, F.col(value).alias("b"))
    return x.join(y, on, "full").withColumn("delta", F.col("b") - F.col("a"))


def valid_merges(merges: DataFrame, kept: DataFrame, word: str, parts: tuple[str, ...] = ("a", "b", "merged")) -> DataFrame:
    """The merges of which both parts and the result are kept: a semi-join for each of them."""
    for c in parts:
        merges = merges.join(kept.select(F.col(word).alias(c)), c, "left_semi")
    return merges.select(*parts)
