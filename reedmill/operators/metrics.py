"""Corpus and generation metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import numbered
from ..functions.bind import let


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """The value at place int(p * n), the last one at most; 0 for none. Neither of the built-in percentiles."""
    n = F.size(sorted_values)
    return F.coalesce(F.try_element_at(sorted_values, F.greatest(F.least(F.floor(n * p), n - 1) + 1, F.lit(1)).cast("int")), F.lit(0))


def rank_from_counts(counts: Column, p: float) -> Column:
    """nearest_rank over a sorted array of (value, n): bounded by the number of distinct values, not by the rows."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c["n"])
    place = F.least(F.floor(total * p), total - 1)
    zero = F.expr("named_struct('seen', cast(0 as bigint), 'value', cast(null as bigint))")
    found = F.aggregate(
        counts, zero, lambda s, c: F.struct((s["seen"] + c["n"]).alias("seen"), F.when(s["value"].isNull() & (s["seen"] + c["n"] > place), c["value"].cast("long")).otherwise(s["value"]).alias("value")),
    )
    return F.coalesce(found["value"], F.lit(0).cast("long"))


def char_ngrams(text: Column, n: Column) -> Column:
    """All character n-grams, white space kept."""
    size = F.length(text)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(text, i, n))).otherwise(F.array().cast("array<string>"))


def chrf(hyp: Column, ref: Column, orders: int = 6, beta: float = 2.0) -> Column:
    """Character n-gram F-score times 100: precision and recall averaged over the orders that both sides have; 0 if a side is empty."""

    def counts(n: Column, h: Column, r: Column) -> Column:
        both = F.struct(numbered(char_ngrams(h, n)).alias("h"), numbered(char_ngrams(r, n)).alias("r"))
        return let(both, lambda b: F.struct(F.size(b["h"]).alias("h"), F.size(b["r"]).alias("r"), F.size(F.array_intersect(b["h"], b["r"])).alias("c")))

    def score(found: Column) -> Column:
        mean = lambda side: F.aggregate(found, F.lit(0.0), lambda s, x: s + x["c"] / x[side], lambda s: s / F.size(found))
        f = lambda m: F.when(m["p"] + m["r"] > 0, 100.0 * (1 + beta * beta) * m["p"] * m["r"] / (beta * beta * m["p"] + m["r"])).otherwise(0.0)
        return F.when(F.size(found) > 0, let(F.struct(mean("h").alias("p"), mean("r").alias("r")), f)).otherwise(0.0)

    def scored(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.lit(orders)), lambda n: counts(n, t["h"], t["r"]))
        return let(F.filter(every, lambda x: (x["h"] > 0) & (x["r"] > 0)), score)

    blank = (F.coalesce(hyp, F.lit("")) == "") | (F.coalesce(ref, F.lit("")) == "")
    return F.when(blank, F.lit(0.0)).otherwise(let(F.struct(hyp.alias("h"), ref.alias("r")), scored))


def share(part: Column, whole: Column) -> Column:
    """part / max(whole, 1)."""
    return part / F.greatest(whole, F.lit(1))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value x weight over the sum of weights; null without weight. Null values and weights count nothing."""
    both = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)).cast("double"))


def perplexity(mean_loss: Column) -> Column:
    return F.exp(mean_loss)
