"""Sequential folds over ordered groups: a group streams through its task in batches, only the fold's state is held."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def early_stops(df: DataFrame, run: str, step: str, value: str, delta: float, patience: int) -> DataFrame:
    """(run, best, best_step, stopped_at) of each run: only a gain of more than delta counts and resets the count of stale steps; patience 0 never stops.

    Null values are ignored; a null run is a run.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = (False, None), None  # (any, name), [best, best_step, stale, stopped_at]

        def row() -> pd.DataFrame:
            return pd.DataFrame({run: [now[1]], "best": [state[0]], "best_step": [state[1]], "stopped_at": pd.array([state[3]], "Int64")})

        for b in batches:
            for name, s, v in zip(b["g"], b["s"], b["v"], strict=True):
                if now != (True, name):
                    if state:
                        yield row()
                    now, state = (True, name), [v, s, 0, None]
                elif state[3] is None:
                    if v < state[0] - delta:
                        state[:3] = [v, s, 0]
                    else:
                        state[2] += 1
                        if patience and state[2] >= patience:
                            state[3] = s
        if state:
            yield row()

    kind = dict(df.dtypes)[run]
    clean = df.where(F.col(value).isNotNull()).select(F.col(run).cast("string").alias("g"), F.col(step).cast("long").alias("s"), F.col(value).cast("double").alias("v"))
    ordered = clean.repartition("g").sortWithinPartitions("g", "s")
    out = ordered.mapInPandas(fold, f"`{run}` string, best double, best_step long, stopped_at long")
    return out.withColumn(run, F.col(run).cast(kind))
