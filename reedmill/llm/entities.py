"""Problem 5: splits in which all rows of one entity stay together.

Rows are contracted by key first: each row joins the smallest row of its keys, and only rows of several keys leave edges, between those smallest rows. On
that graph Borůvka-style rounds let each component take its smallest edge, contract along the chosen edges by pointer jumping, and keep those edges; with the edges of the first step they are
the spanning forest, which is written to the checkpoint folder. Where no row has several keys there is nothing left to contract and no round is run.

Roots are stratified by size band and dealt to the splits systematically within their band, by a low-discrepancy sequence over distributed ranks. Only components of more than a
thousandth of all rows, of which there are fewer than a thousand, are dealt one by one to the split with the largest shortfall, as no sequence can balance so few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, small_side, written

ROWS_A_BUCKET = 200_000


def entity_key(raw: Column, is_document: Column) -> Column:
    """One spelling of an entity: E and a sentence number, L and a lipu line number, or D and a document path without its chunk mark. Null for null and blank."""
    s = F.lower(F.regexp_replace(raw, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\.0+$", ""), r"[^0-9]", ""), r"^0+(?=[0-9])", "")
    path = F.regexp_replace(F.translate(s, "\\", "/"), r"(?U)\s*#.*$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"^(\./)+", ""), r"(?U)\s+", "_")
    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit(None).cast("string"))
        .when(~is_document & s.rlike(r"(?U)^lipu[\s:_/#-]*[0-9]+$"), F.concat(F.lit("L"), digits))
        .when(~is_document & s.rlike(r"(?U)^(eng)?[\s:_/#-]*[0-9][0-9,]*(\.0+)?$"), F.concat(F.lit("E"), digits))
        .otherwise(F.concat(F.lit("D"), path))
    )


def star_edges(rows: DataFrame) -> DataFrame:
    """Edges (u, v): each row to the smallest row of each of its keys. rows: id, keys (array)."""
    named = rows.select("id", F.explode("keys").alias("key")).where(F.col("key").isNotNull())
    first = named.groupBy("key").agg(F.min("id").alias("v"), F.max("id").alias("last")).where("v < last").select("key", "v")
    return named.join(first, "key").where("id <> v").select(F.col("id").alias("u"), "v").distinct()


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels (v, root), forest (u, v)) of an undirected graph. Loops and repeated edges do no harm; vertices without an edge don't appear."""
    live = cut_lineage(edges.where("u <> v").select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv"), F.xxhash64("u", "v").alias("w")))
    labels, forest = None, None
    while not live.isEmpty():
        both = live.select(F.col("cu").alias("c"), F.struct("w", "u", "v", F.col("cv").alias("other")).alias("e")).unionAll(
            live.select(F.col("cv").alias("c"), F.struct("w", "u", "v", F.col("cu").alias("other")).alias("e"))
        )
        picks = cut_lineage(both.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.other", "e.u", "e.v"))
        chosen = picks.select("u", "v").distinct()
        forest = chosen if forest is None else forest.unionAll(chosen)
        back = picks.select(F.col("c").alias("other"), F.col("other").alias("back"))
        parent = picks.join(back, "other").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("p"))
        parent = cut_lineage(parent)
        while True:  # pointer jumping: the depth halves each time
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = cut_lineage(parent.join(up, "p").select("c", F.col("pp").alias("new"), (F.col("pp") != F.col("p")).alias("moved")))
            parent = jumped.select("c", F.col("new").alias("p"))
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select(F.col("c").alias("v"), F.col("p").alias("root"))
        else:
            labels = labels.join(parent.select(F.col("c").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
        labels = cut_lineage(labels)
        live = live.join(parent.select(F.col("c").alias("cu"), F.col("p").alias("pu")), "cu").join(parent.select(F.col("c").alias("cv"), F.col("p").alias("pv")), "cv")
        live = cut_lineage(live.where("pu <> pv").select("u", "v", F.col("pu").alias("cu"), F.col("pv").alias("cv"), "w"))
    if labels is None:
        labels = live.select("v", F.col("cv").alias("root"))
        forest = live.select("u", "v")
    return labels, forest


def contracted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``near``, the smallest row of any of its keys or null, and ``first``, whether a key begins with it; edges (u, v) between smallest rows of keys of one row). rows: id (unique), keys."""
    keyed = cut_lineage(rows.select("id", F.array_distinct(F.filter(F.coalesce("keys", F.array().cast(dict(rows.dtypes)["keys"])), lambda k: k.isNotNull())).alias("keys")))
    named = keyed.select("id", F.explode_outer("keys").alias("key"))
    firsts = named.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("v"))
    at = named.join(firsts, "key", "left")
    if keyed.where(F.size("keys") > 1).isEmpty():
        return at.select("id", F.col("v").alias("near"), F.coalesce(F.col("v") == F.col("id"), F.lit(False)).alias("first")), at.select(F.col("v").alias("u"), "v").limit(0)
    per = cut_lineage(at.groupBy("id").agg(F.array_sort(F.collect_set("v")).alias("vs")))  # as many as a row has keys
    near = per.select("id", F.try_element_at("vs", F.lit(1)).alias("near"), F.array_contains("vs", F.col("id")).alias("first"))
    edges = per.where(F.size("vs") > 1).select(F.col("vs")[0].alias("u"), F.explode(F.expr("slice(vs, 2, size(vs) - 1)")).alias("v")).distinct()
    return near, edges


def components_and_forest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, root) of all rows, edges (u, v) of a spanning forest of the linked rows). rows: id (unique), keys."""
    near, edges = contracted(rows.select("id", "keys"))
    near = cut_lineage(near)
    labels, forest = spanning_forest(edges)
    own = near.where(F.col("near").isNotNull() & ~F.col("first") & (F.col("near") != F.col("id"))).select(F.col("id").alias("u"), F.col("near").alias("v"))
    roots = near.join(labels.select(F.col("v").alias("near"), "root"), "near", "left").select("id", F.coalesce("root", "near", "id").alias("root"))
    return roots, own.unionByName(forest)


def components(rows: DataFrame) -> DataFrame:
    """rows with ``root``, the same for all rows linked by keys, directly or through others; rows without a key or a partner are their own root, rows without an id are left out. rows: id (unique), keys, and any others."""
    roots, _ = components_and_forest(rows)
    return rows.join(roots, "id")


def forest_table(rows: DataFrame) -> DataFrame:
    """The spanning forest (u, v) as a table in the checkpoint folder."""
    return written(components_and_forest(rows)[1])


def _torn(rows: DataFrame) -> DataFrame:
    """(id, root, split) of the rows of components that are in several splits."""
    joined = cut_lineage(components(rows).where(F.col("split").isNotNull()).select("id", "root", "split"))
    torn = joined.groupBy("root").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo < hi").select("root")
    return joined.join(torn, "root", "left_semi")


def split_breaks(rows: DataFrame) -> DataFrame:
    """(row_a, row_b): rows of one component that are in different splits. rows: id, keys, split.

    Components within one split, however large, drop out before the join, so that only pairs of the result are ever made. ``break_members`` gives the same in a row for each row.
    """
    part = _torn(rows)
    later = part.select("root", "split").distinct().groupBy("root").agg(F.collect_set("split").alias("splits"))  # as many as there are splits
    a = part.join(later, "root").select("root", F.col("id").alias("a"), F.explode(F.filter("splits", lambda s: s > F.col("split"))).alias("sb"))
    b = part.select("root", F.col("id").alias("b"), F.col("split").alias("sb"))
    return a.join(b, ["root", "sb"]).select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))


def break_members(rows: DataFrame) -> DataFrame:
    """(id, root, split, n_elsewhere): each row whose component has rows in other splits, and how many; linear in the rows however large the component."""
    part = _torn(rows)
    counts = part.groupBy("root", "split").agg(F.count("*").alias("n"))
    totals = counts.groupBy("root").agg(F.sum("n").alias("total"))
    return part.join(counts.join(totals, "root"), ["root", "split"]).select("id", "root", "split", (F.col("total") - F.col("n")).alias("n_elsewhere"))


def _deal(fraction: Column, shares: list[tuple[str, float]]) -> Column:
    total, edge, out = sum(max(0.0, s) for _, s in shares) or 1.0, 0.0, F.lit(shares[-1][0])
    for name, share in reversed(shares[:-1]):
        edge = sum(max(0.0, s) for n, s in shares[: [n for n, _ in shares].index(name) + 1]) / total
        out = F.when(fraction < edge, F.lit(name)).otherwise(out)
    return out


def assign_splits(rows: DataFrame, targets: list[tuple[str, float]], seed: int = 42, most_large: int = 1_000) -> DataFrame:
    """rows (id, root, new_split): every component in one split, sizes near the target shares. rows: id, keys. An empty table gives no rows."""
    linked = cut_lineage(components(rows.select("id", "keys")).select("id", "root"))
    n = linked.count()
    sizes = cut_lineage(linked.groupBy("root").agg(F.count("*").alias("size")))
    limit = max(2.0, n / most_large)
    large = sizes.where(F.col("size") > limit).orderBy(F.desc("size"), "root").collect()  # fewer than most_large, as sizes sum up to n
    short = {s: share * n for s, share in targets}
    dealt = []
    for r in large:
        best = max(short, key=lambda s: short[s])
        dealt.append((r["root"], best))
        short[best] -= r["size"]
    shares = [(s, short[s]) for s, _ in targets]
    spark = rows.sparkSession
    order = F.xxhash64("root", F.lit(seed))
    rest = sizes.where(F.col("size") <= limit).select("root", F.floor(F.log2("size")).cast("int").alias("band"), order.alias("o"))
    rest = rest.withColumn("bucket", F.pmod("o", F.lit(max(16, n // ROWS_A_BUCKET))))
    counts = rest.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("band", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = rest.join(small_side(before), ["band", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("band", "bucket").orderBy("o", "root")))
    even = F.expr("(rank * 0.6180339887498949D + band * 0.37D) % 1")  # golden-ratio sequence: shares hold within any run of ranks
    small = ranked.select("root", _deal(even, shares).alias("new_split"))
    big = spark.createDataFrame(dealt, "root long, new_split string")
    return linked.join(small.unionByName(big), "root").select("id", "root", "new_split")
