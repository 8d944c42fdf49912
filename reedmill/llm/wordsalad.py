"""Problem 9: pages of keywords, tags, product rows and links instead of sentences.

Corpus counts: for every pair of neighbouring words the number of pages that hold it (each page once, so that a page can't
vouch for its own repetitions), and for every word the number of such pairs it begins and ends. The pointwise mutual information of a
pair is smoothed towards independence by a fixed share of all N counted pairs, so that it means the same at every size of the corpus:

    pmi(a, b) = ln( (n(a,b) - 1 + s N) / (n(a,.) n(.,b) / N + s N) )

Sentences, punctuated or not, are made of pairs that recur all over the corpus (a word and what holds it in its sentence); neighbours in a
keyword list meet by chance. Each page is read in blocks of neighbouring words, and a block whose mean PMI is below a share of the corpus's mean is
incoherent. A page is spam if enough of its words are in incoherent blocks or links, or if it excessively repeats a few
collocations. An exact check of those pages follows: one comes out if more than half of its words are link parts or stand in runs
without any of the words that hold a sentence together.

Texts are parsed once. Counting is partially aggregated before each shuffle. Scoring joins the pair table: broadcast if a count shows that it is small, and then only
sums of blocks are shuffled; else equal (page, block, pair) rows are added up first and joined by a shuffle that AQE splits at hot pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let, settled
from ..functions.script import WORDS, glyphs_to_latin
from ..session import cut_lineage, spread

BLOCK = 12
SMOOTH = 3e-4
LOW = 0.4
SALAD_SHARE, REPEATED_PAIRS = 0.4, 0.5
KEYWORD_RUN = 8
BROADCAST_PAIRS = 1_000_000  # 24 bytes and overhead each
#: A link with or without scheme.
LINK = r"(?i)(?:https?://|www\.)[^\s<>\"\]\)|]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/[^\s<>\"\]\)|]*"
#: Words that hold sentences together, by language.
SCAFFOLD = "li e mi sina ona la o pi the a an every each our her my one another and of to is was in with".split()


def page_words(text: Column) -> tuple[Column, Column]:
    """(words outside links in lower case, number of words inside links)."""
    latin = glyphs_to_latin(text)
    links = F.regexp_extract_all(latin, F.lit(LINK), F.lit(0))
    in_links = F.size(F.regexp_extract_all(F.array_join(links, " "), F.lit(r"\p{L}+"), F.lit(0)))
    bare = F.regexp_replace(F.regexp_replace(latin, LINK, " "), r"<[^<>]*>", " ")
    return F.coalesce(F.regexp_extract_all(F.lower(bare), F.lit(r"\p{L}+"), F.lit(0)), F.array().cast("array<string>")), F.greatest(F.coalesce(in_links, F.lit(0)), F.lit(0))


def keyword_words(words: Column) -> Column:
    """Number of words in runs of at least KEYWORD_RUN without a scaffold word."""
    marks = F.array_join(F.transform(words, lambda w: F.when(w.isin(*SCAFFOLD), "|").otherwise("x")), "")
    runs = F.filter(F.transform(F.split(marks, r"\|"), lambda r: F.length(r)), lambda n: n >= KEYWORD_RUN)
    return F.aggregate(runs, F.lit(0), lambda s, n: s + n)


def read_pages(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(page, doc, n_link_words, n_keyword_words, h) of every row with a word or link: ``page`` tells rows apart whatever their id, h holds the words' hashes."""
    words, links = page_words(F.col(text))
    parsed = settled(spread(docs).select(F.col(doc_id).alias("doc"), words.alias("w"), links.alias("n_link_words"))).where((F.size("w") > 0) | (F.col("n_link_words") > 0))
    counted = parsed.select("doc", "n_link_words", keyword_words(F.col("w")).alias("n_keyword_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    return cut_lineage(counted.withColumn("page", F.monotonically_increasing_id()))


def word_pairs(h: Column) -> Column:
    """Neighbours as an array of (a, b); null for less than two words."""
    n = F.size(h)
    return F.when(n > 1, F.arrays_zip(F.slice(h, 1, n - 1).alias("a"), F.slice(h, 2, n - 1).alias("b")))


def distinct_pairs(pairs: Column) -> Column:
    """Distinct structs of an array by sorting; ``array_distinct`` compares all with all for structs."""
    return let(F.sort_array(pairs), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))


def pair_pmi(pages: DataFrame, smooth: float = SMOOTH) -> tuple[DataFrame, float]:
    """((a, b, pmi) of every pair of the corpus, mean PMI over all counted pairs)."""
    pairs = cut_lineage(pages.select(F.explode(distinct_pairs(word_pairs(F.col("h")))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    first, second = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    k = smooth * total
    pmi = F.ln((F.col("n") - 1 + k) / (F.col("na") * F.col("nb") / float(max(1, total)) + k))
    scored = cut_lineage(pairs.join(first, "a").join(second, "b").select("a", "b", "n", pmi.alias("pmi")))
    mean = scored.agg(F.sum(F.col("n") * F.col("pmi"))).first()[0] or 0.0
    return scored.select("a", "b", "pmi"), mean / max(1, total)


def salad_scores(docs: DataFrame, doc_id: str, text: str, low: float = LOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_link_words, n_keyword_words, coherence, salad_share, repeated_share) of each page with a word.

    coherence: mean PMI of the page over that of the corpus, null for a page without neighbours. Null and blank texts and empty tables give no rows; a
    document id given twice is two pages. Other columns are ignored.
    """
    pages = read_pages(docs, doc_id, text)
    table, mean = pair_pmi(pages)
    rows = pages.select("page", F.posexplode(word_pairs(F.col("h"))).alias("pos", "p")).select("page", F.floor(F.col("pos") / block).alias("block"), "p.a", "p.b")
    if table.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        scored = rows.withColumn("n", F.lit(1)).join(F.broadcast(table), ["a", "b"])
    else:
        scored = rows.groupBy("page", "block", "a", "b").agg(F.count("*").alias("n")).join(table, ["a", "b"])
    blocks = scored.groupBy("page", "block").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("pmi")).alias("s"))
    per = blocks.groupBy("page").agg(F.sum(F.when(F.col("s") <= low * mean * F.col("n"), F.col("n")).otherwise(0)).alias("salad"), F.sum("n").alias("n_pairs"), F.sum("s").alias("s"))
    hashes = F.transform(word_pairs(F.col("h")), lambda p: F.xxhash64(p["a"], p["b"]))
    repeated = F.when(F.size("h") > 8, 1 - F.size(F.array_distinct(hashes)) / (F.size("h") - 1)).otherwise(F.lit(0.0))
    base = pages.select("page", "doc", F.size("h").alias("n_words"), "n_link_words", "n_keyword_words", repeated.alias("repeated_share"))
    all_words = F.col("n_words") + F.col("n_link_words")
    return base.join(per, "page", "left").select(
        F.col("doc").alias(doc_id), "n_words", "n_link_words", "n_keyword_words", F.try_divide(F.col("s") / F.col("n_pairs"), F.lit(mean)).alias("coherence"),
        ((F.coalesce(F.col("salad") / F.col("n_pairs"), F.lit(0.0)) * F.col("n_words") + F.col("n_link_words")) / all_words).alias("salad_share"), "repeated_share",
    )


def incoherent(scores: DataFrame, share: float = SALAD_SHARE, repeated: float = REPEATED_PAIRS) -> DataFrame:
    """Pages that are mostly word salad or links, or that excessively repeat their collocations."""
    return scores.where((F.col("salad_share") > share) | (F.col("repeated_share") > repeated))


def spam_pages(scores: DataFrame) -> DataFrame:
    """Incoherent pages that pass the exact check: more than half of the words outside sentences."""
    return incoherent(scores).where(2 * (F.col("n_keyword_words") + F.col("n_link_words")) > F.col("n_words") + F.col("n_link_words"))
