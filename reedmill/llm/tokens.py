"""Problem 2: tokens of every document under an existing byte-level BPE tokenizer, and totals by slice.

Documents are counted in place. An oversized document is cut only where the tokenizer is proven to work independently on both sides:
at every step from a character that isn't white space to one that is, and between ASCII characters of two of the classes letter, digit, mark (but not from an apostrophe to a letter).
No alternative of the splitting pattern matches across such a place, none looks back, and the only look-ahead is of white space that ends the left part, which these
places rule out. So both sides are split into the same pieces as the whole, and BPE never merges across pieces: the chunks' counts add up to the document's count exactly. White space
is the Unicode property, which doesn't change; letters and digits beyond ASCII decide nothing, as versions of Unicode differ in them. Only a run without any such place, as of 10,000 letters, stays whole. Chunks are
spread over all workers by a salted shuffle; ordinary documents are never shuffled, only their counts are added up (partially first).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the tokenizer's vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OVERSIZED, CHUNK = 8_000, 4_000
_MARKS = r"!-/:-@\[-`{-~"
BOUNDARY = regex.compile(rf"(?<=\P{{White_Space}})(?=\p{{White_Space}})|(?<=[A-Za-z])(?=[0-9{_MARKS}])|(?<=[0-9])(?=[A-Za-z{_MARKS}])|(?<=[{_MARKS}])(?=[0-9])|(?<=[{_MARKS}--'])(?=[A-Za-z])", regex.V1)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file; once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def independent_chunks(text: str, size: int = CHUNK) -> list[str]:
    """text cut at the first proven boundary after each ``size`` characters; whole if there is none."""
    cuts, at = [0], 0
    while m := BOUNDARY.search(text, at + size):
        at = m.start()
        cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def _count_or_cut(path: str, oversized: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            cut = [[None] if t is None or len(t) <= oversized else independent_chunks(t, size) for t in b["text"]]
            n = [0 if t is None else len(enc.encode_ordinary(t)) if c[0] is None else None for t, c in zip(b["text"], cut, strict=True)]
            out = b.drop(columns="text")
            out["n_tokens"], out["chunk"] = pd.array(n, "Int64"), cut
            yield out.explode("chunk", ignore_index=True)

    return run


def _count_chunks(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            b["n_tokens"] = [len(enc.encode_ordinary(t)) for t in b["chunk"]]
            yield b.drop(columns="chunk")

    return run


def document_tokens(docs: DataFrame, text: Column, keep: dict[str, Column], *, tokenizer: str = TOKENIZER, oversized: int = OVERSIZED, chunk: int = CHUNK) -> DataFrame:
    """The ``keep`` columns and n_tokens, one row for each row of docs; null and empty texts have 0 tokens.

    ``keep`` must tell rows apart where documents can be oversized. Counts are exact and don't depend on ``oversized`` and ``chunk``.
    """
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], text.alias("text"))
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    first = cut_lineage(rows.mapInPandas(_count_or_cut(tokenizer, oversized, chunk), f"{kept}, n_tokens long, chunk string"))
    whole = first.where("chunk IS NULL").drop("chunk")
    chunks = first.where("chunk IS NOT NULL").withColumn("salt", F.xxhash64("chunk", F.monotonically_increasing_id())).repartition("salt").drop("salt", "n_tokens")
    parts = chunks.mapInPandas(_count_chunks(tokenizer), f"{kept}, n_tokens long").groupBy(*keep).agg(F.sum("n_tokens").alias("n_tokens"))
    return whole.unionByName(parts)


def slice_totals(counts: DataFrame, by: list[str]) -> DataFrame:
    """Documents, documents without a token and tokens of each slice."""
    return counts.groupBy(*by).agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_tokens") == 0).alias("n_empty"), F.sum("n_tokens").alias("n_tokens"))
