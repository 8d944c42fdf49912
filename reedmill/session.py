"""Session helpers: tables, checkpoint folder, joins whose broadcast is checked first."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its source has tasks for at most half of them, as of one small file. A source of many files or row groups is left as it is, so nothing is shuffled at scale, and so is
    the result of a shuffle, whose tasks would have to be run to be counted."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, local mode gets a folder of its own, removed at the end; a cluster has none that all workers see, so that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all workers share")
            shared = tempfile.mkdtemp(prefix="reedmill-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder and reads it from there; survives the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the checkpoint folder, one folder for each value of the ``by`` columns, so that a filter on them reads nothing else."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), uuid.uuid4().hex)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> int:
    """An upper estimate of a row's bytes without its strings and arrays."""
    return 16 + 16 * len(df.columns)


def small_side(df: DataFrame, max_rows: int = 500_000, max_bytes: int = 256 << 20) -> DataFrame:
    """Broadcast hint if a count proves df to have at most max_rows rows of at most max_bytes in all, else df as it is (AQE then picks and splits a shuffle join)."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c, t in df.dtypes if t in ("string", "binary")]
    texts += [F.greatest(F.size(F.col(f"`{c}`")), F.lit(0)).cast("long") * 16 for c, t in df.dtypes if t.startswith("array<") and t[6:] in ("bigint>", "int>", "double>", "float>")]
    size = sum(texts, F.lit(row_bytes(df)).cast("long"))
    seen = df.select(size.alias("size")).limit(max_rows + 1).agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(df) if seen[0] <= max_rows and (seen[1] or 0) <= max_bytes else df
