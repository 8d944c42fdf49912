"""Relations made of constants and grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sets import distributed_rank


def reactive_lines(spark: SparkSession, groups: Mapping[str, Sequence[str]], per_scene: int | None = None) -> DataFrame:
    """(scene, place, reply) of nested constants, at most ``per_scene`` replies each (a feature of the caller)."""
    nested = spark.createDataFrame([(s, list(r)) for s, r in groups.items()], "scene string, replies array<string>")
    rows = nested.select("scene", F.posexplode("replies").alias("place", "reply"))
    return rows if per_scene is None else rows.where(F.col("place") < per_scene)


def grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row with every combination of the axes' values, exploded in the row, so nothing is shuffled."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def permutation_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """df with ``split``: a share of the rows, one at least, to val in a hash order. key must be unique; an empty table stays empty."""
    from ..functions.text import hash_order

    n = df.count()
    ranked = distributed_rank(df.withColumn("_h", hash_order(seed, F.col(key))), "_h", "_rank", [key])
    return ranked.withColumn("split", F.when(F.col("_rank") <= max(1, int(n * share)), "val").otherwise("train")).drop("_h", "_rank")
