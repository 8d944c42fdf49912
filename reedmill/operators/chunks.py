"""Chunking, framing, windows and n-grams within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import ascii_words, ensure_end, sentences, strip

MAX_CHUNK = 600
PREFIX_SENTENCES, SUFFIX_SENTENCES, PREFIX_WORDS = 3, 2, 5


def packed_chunks(text: Column, limit: int = MAX_CHUNK) -> Column:
    """Sentences packed greedily into chunks of at most ``limit`` characters; a short text stays as it is, a long sentence is a chunk of its own.

    A fold with the chunks so far, the open chunk and its counted length: a chunk begun after another counts its first sentence without the blank.
    """
    whole = strip(F.coalesce(text, F.lit("")))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        size = F.length(x)
        full = s["open"].isNotNull() & (s["n"] + size + 1 > limit)
        return F.struct(
            F.when(full, F.array_append(s["done"], s["open"])).otherwise(s["done"]).alias("done"),
            F.when(full | s["open"].isNull(), x).otherwise(F.concat(s["open"], F.lit(" "), x)).alias("open"),
            F.when(full, size).otherwise(s["n"] + size + 1).alias("n"),
        )

    last = lambda s: F.when(s["open"].isNotNull(), F.array_append(s["done"], s["open"])).otherwise(s["done"])
    folded = F.aggregate(F.transform(sentences(whole), ensure_end), zero, step, last)
    return F.when(whole == "", F.array().cast("array<string>")).when(F.length(whole) <= limit, F.array(whole)).otherwise(folded)


def continuation(chunk: Column, draw: Column) -> Column:
    """struct(prefix, suffix) of a chunk, null if it has one sentence or too short a prefix. draw: a non-negative whole number that picks the cut."""
    join = lambda part: F.array_join(F.transform(part, ensure_end), " ")

    def cut(b: Column) -> Column:
        s, n = b["s"], F.size(b["s"])
        k = (1 + F.pmod(b["draw"], F.greatest(F.least(F.lit(PREFIX_SENTENCES), n - 1), F.lit(1)))).cast("int")
        both = F.struct(join(F.slice(s, 1, k)).alias("prefix"), join(F.slice(s, k + 1, SUFFIX_SENTENCES)).alias("suffix"))
        return F.when(n >= 2, let(both, lambda p: F.when(F.size(ascii_words(p["prefix"])) >= PREFIX_WORDS, p)))

    return let(F.struct(sentences(chunk).alias("s"), draw.alias("draw")), cut)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks."""

    def runs(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) >= n, F.transform(places, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def distinct_share(words: Column, n: int) -> Column:
    """Distinct n-grams over all, 1 if there are none."""
    return let(ngrams(words, n), lambda g: F.when(F.size(g) > 0, F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.lit(1.0)))


def framed_tokens(tokens: Column, cap: int, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), F.slice(tokens, 1, cap), F.array(F.lit(eos)))


def masked_labels(prompt: Column, whole: Column, ignore: int = -100) -> Column:
    """Labels of a token sequence whose prompt isn't learnt."""
    k = F.least(F.size(prompt), F.size(whole))
    return F.concat(F.array_repeat(F.lit(ignore), k), F.slice(whole, k + 1, F.greatest(F.size(whole) - k, F.lit(0))))


def stride_windows(n: Column, block: int) -> Column:
    """struct(begin, end, scored) of the windows that score each of n-1 targets once; stride is half a block."""
    stride = block // 2
    last = F.greatest(F.ceil((n - 1 - block) / stride), F.lit(0)).cast("int")
    end = lambda i: F.least(i * stride + block, n - 1)
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * stride).alias("begin"), end(i).alias("end"), (end(i) - F.when(i > 0, end(i - 1)).otherwise(0)).alias("scored")))
    return F.when(n >= 2, windows).otherwise(F.array().cast("array<struct<begin:int,end:int,scored:int>>"))


def warmup_cosine(step: Column, peak: float, warmup: int, steps: int) -> Column:
    """Learning rate: linear warm-up, then a cosine to a tenth."""
    progress = (step - warmup) / max(1, steps - warmup)
    return F.when(step < warmup, peak * (step + 1) / warmup).when(step >= steps, F.lit(0.1 * peak)).otherwise(0.1 * peak + 0.9 * peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def mask_audit(labels: Column, reply_tokens: Column, slack: int = 2, ignore: int = -100) -> Column:
    """Whether the places to be learnt are as many as the reply's tokens, give or take ``slack``, some but not all."""
    learnt = F.size(F.filter(labels, lambda x: x != ignore))
    return (F.abs(learnt - reply_tokens) <= slack) & (learnt > 0) & (learnt < F.size(labels))


def random_window(n: Column, block: int, draw: Column) -> Column:
    """Start of a window of ``block`` targets in n tokens, drawn by a non-negative whole number; null if there is no room."""
    return F.when(n > block, F.pmod(draw, F.greatest(n - block, F.lit(1))))
