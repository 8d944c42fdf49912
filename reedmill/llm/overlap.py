"""Problem 1: the same or nearly the same records in evaluation and training splits.

Edit-distance segment join over word bags. A string becomes the sequence of its words from the rarest to the most frequent (of the evaluation strings; any order would be right), one code
character a word, so that word order, case, punctuation, spacing and script no longer matter and the insert/delete distance of two sequences is
``n + m - 2 * common words``. With at least a share s of the longer side in common this distance is at most (2 - 2s) * n = k for an
evaluation string of n words. The string is cut into k+1 segments; by the pigeonhole principle one of them stands unchanged in the
training string, at a position whose left side needs at most i edits and whose right side at most k-i. As frequent words make poor segments, the k rarest words are
a segment each and all the others together are the last one, which can only stand at the end. Training strings emit their
words and ends once, look them up in the segment table, and surviving pairs are verified: banded dynamic programming first
(``levenshtein`` with a threshold), the exact multiset overlap of the words last.

Nothing is shuffled but the verified pairs: the training side is only scanned and the evaluation side is broadcast after a check of its rows and bytes has
shown that it is small (else AQE's skew-aware shuffle join does the lookup).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import numbered
from ..functions.bind import settled
from ..functions.script import alnum_words, tidy_label
from ..session import cut_lineage, small_side


#: Code characters: first one and number of them for words of each class of frequency, the rarest first; and how many words are in the classes.
CODES = ((0x4E00, 16_000), (0x4E00 + 16_000, 2_000), (0x4E00 + 18_000, 1_500), (0x4E00 + 19_500, 500))
CLASSES = (256, 64, 8)


def _coded(words: Column, frequent: list[str]) -> Column:
    """Words from rare to frequent as one string of one character a word (a hash within its class; collisions are sorted out by the exact check)."""

    def code(w: Column) -> Column:
        place = lambda c: F.pmod(F.xxhash64(w), F.lit(c[1])) + c[0]
        out = place(CODES[0])
        for size, c in zip(CLASSES, CODES[1:], strict=True):
            if frequent[:size]:
                out = F.when(w.isin(frequent[:size]), place(c)).otherwise(out)
        return F.decode(F.unhex(F.lpad(F.hex(out), 4, "0")), "UTF-16BE")

    return F.array_join(F.array_sort(F.transform(words, code)), "")


def _mask(words: Column) -> Column:
    """A bit for each word's hash. Inserting or deleting a word changes at most one bit, so the differing bits of two masks are a lower bound of their distance."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(63)).cast("int"))))


def overlaps(
    evals: DataFrame, train: DataFrame, *, eval_id: str, eval_texts: list[list[str]], train_id: str, train_text: str, min_share: float = 0.7,
) -> DataFrame:
    """Pairs (eval_id, train_id, share) whose word bags have at least ``min_share`` of the longer side in common.

    ``eval_texts`` lists the strings made of one evaluation row, each a list of columns put one after the other; the best one counts.
    Null and wordless texts match nothing, repeated rows give a pair each, empty tables give no rows, other columns are ignored. min_share: above 0.5, at most 1.
    """
    pairs = candidates(evals, train, eval_id=eval_id, eval_texts=eval_texts, train_id=train_id, train_text=train_text, min_share=min_share)
    longer = F.greatest("n", "m")
    band = F.floor(F.col("n") + F.col("m") - 2 * min_share * longer + 1e-6).cast("int")
    close = pairs.where(F.bit_count(F.col("e_mask").bitwiseXOR(F.col("t_mask"))) <= band).withColumn("band", band).where(F.expr("levenshtein(e_code, t_code, band) >= 0"))
    bag = lambda c: numbered(F.split(c, " "))
    common = F.size(F.array_intersect(bag(F.col("e_bag")), bag(F.col("t_bag"))))
    return (
        close.select("e_id", "t_id", (common / longer).alias("share"))
        .where(F.col("share") >= min_share - 1e-9)
        .groupBy("e_id", "t_id")
        .agg(F.max("share").alias("share"))
        .select(F.col("e_id").alias(eval_id), F.col("t_id").alias(train_id), "share")
    )


def candidates(evals: DataFrame, train: DataFrame, *, eval_id: str, eval_texts: list[list[str]], train_id: str, train_text: str, min_share: float = 0.7) -> DataFrame:
    """The segment matches that keep the position limits, with both sides' codes; a pair comes once for each of its matches."""
    if not 0.5 < min_share <= 1:
        raise ValueError("min_share must be above 0.5 and at most 1")
    k_of = f"cast(floor(n * {2 - 2 * min_share!r} + 1e-6) as int)"
    first = evals.select(
        F.col(eval_id).alias("e_id"),
        F.explode(F.array(*[F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]) for cols in eval_texts])).alias("e_text"),
    ).distinct()
    worded = cut_lineage(settled(first.select("e_id", alnum_words(F.col("e_text")).alias("w"))).where(F.size("w") > 0))
    counts = worded.select("e_id", F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    frequent = [r["word"] for r in counts.orderBy(F.desc("c"), "word").limit(CLASSES[0]).collect()]
    lengths = [r["n"] for r in worded.select(F.size("w").alias("n")).distinct().collect()]  # at most as many as the longest string has words
    strings = (
        worded.select("e_id", F.size("w").alias("n"), F.array_join(F.array_sort("w"), " ").alias("e_bag"), _coded(F.col("w"), frequent).alias("e_code"), _mask(F.col("w")).alias("e_mask"))
        .distinct()
        .withColumn("k", F.expr(k_of))
    )
    words = F.expr("transform(sequence(0, k), i -> struct(i as i, if(i < k, substring(e_code, i + 1, 1), concat('|', substring(e_code, k + 1, n - k))) as piece))")
    segments = strings.select("*", F.inline(words))
    fitting = f"filter(array({', '.join(map(str, lengths)) or '0'}), n -> least(n, m) >= {min_share!r} * greatest(n, m) - 1e-9)"
    ends = f"transform(array_distinct(transform({fitting}, n -> n - {k_of})), l -> struct(m - l as q, concat('|', substring(t_code, m - l + 1, l)) as piece))"
    singles = "transform(sequence(0, m - 1), q -> struct(q as q, substring(t_code, q + 1, 1) as piece))"
    longest = max(lengths, default=0) / min_share + 1e-6
    pieces = (
        settled(train.select(F.col(train_id).alias("t_id"), alnum_words(F.col(train_text)).alias("w")))
        .where((F.size("w") > 0) & (F.size("w") <= longest))  # longer ones can't have the share
        .select("t_id", F.size("w").alias("m"), F.array_join(F.array_sort("w"), " ").alias("t_bag"), _coded(F.col("w"), frequent).alias("t_code"), _mask(F.col("w")).alias("t_mask"))
        .select("*", F.inline(F.expr(f"concat({singles}, {ends})")))
    )
    shift = F.col("q") - F.col("i")
    return (
        settled(pieces).join(small_side(segments), "piece")
        .where(F.least("n", "m") >= min_share * F.greatest("n", "m") - 1e-9)
        .where((F.abs(shift) <= F.col("i")) & (F.abs(shift - (F.col("m") - F.col("n"))) <= F.col("k") - F.col("i")))
    )


def overlap_report(pairs: DataFrame, evals: DataFrame, train: DataFrame, *, eval_id: str, eval_split: str, train_id: str, train_source: str) -> DataFrame:
    """Counts of pairs, evaluation rows and training rows by evaluation split and tidied training source."""
    by_split = evals.select(F.col(eval_id).alias("e_id"), F.col(eval_split).alias("split"))
    by_source = train.select(F.col(train_id).alias("t_id"), tidy_label(F.col(train_source)).alias("source"))
    return (
        pairs.select(F.col(eval_id).alias("e_id"), F.col(train_id).alias("t_id"))
        .join(by_split, "e_id")
        .join(by_source, "t_id")
        .groupBy("split", "source")
        .agg(F.count("*").alias("n_pairs"), F.countDistinct("e_id").alias("n_eval_rows"), F.countDistinct("t_id").alias("n_train_rows"))
    )
