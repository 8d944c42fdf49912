"""Arrays as multisets: short ones by direct comparison, all others by run lengths of the sorted items instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let


SHORT = 48


def run_starts(s: Column) -> Column:
    """Places (from 0) at which a new value begins in a sorted array."""
    places = F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))
    return F.when(F.size(s) > 0, F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))).otherwise(F.array().cast("array<int>"))


def run_lengths(s: Column, starts: Column) -> Column:
    return F.transform(starts, lambda x, i: F.coalesce(F.get(starts, i + 1), F.size(s)) - x)


def most_common(items: Column) -> Column:
    """How often the most frequent item of an array occurs; 0 for none."""
    direct = lambda a: F.array_max(F.transform(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x))))
    by_runs = lambda a: let(F.array_sort(a), lambda s: F.array_max(run_lengths_of(s)))
    return let(items, lambda a: F.coalesce(F.when(F.size(a) <= SHORT, direct(a)).otherwise(by_runs(a)), F.lit(0)))


def run_lengths_of(s: Column) -> Column:
    """Lengths of the runs of equal values in a sorted array."""
    return let(run_starts(s), lambda t: run_lengths(s, t))


def numbered(items: Column) -> Column:
    """Equal items made distinct by their number, so that set operations act on multisets."""

    def each(s: Column, t: Column) -> Column:
        number = lambda x, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat_ws("\u0001", F.get(s, x), k.cast("string")))
        return F.flatten(F.transform(t, lambda x, i: number(x, F.coalesce(F.get(t, i + 1), F.size(s)) - x)))

    direct = lambda s: F.transform(s, lambda x, i: F.concat_ws("\u0001", x, (i + 1 - F.array_position(s, x)).cast("string")))
    return let(F.array_sort(items), lambda s: F.when(F.size(s) <= SHORT, direct(s)).otherwise(let(run_starts(s), lambda t: each(s, t))))
