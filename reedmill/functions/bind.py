"""Binding of a value within a Column expression.

Catalyst evaluates a higher-order function's free expressions anew for every element and doesn't share common parts inside lambdas. ``let`` computes
a value once a row and hands it on as a variable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, through which Catalyst pushes no filter: a filter on a costly computed column would otherwise be
    evaluated on a second copy of its expression."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))
