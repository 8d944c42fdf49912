"""Encoding and decoding with an existing tokenizer, in Arrow batches with one tokenizer a worker. The path is a parameter; nothing is trained."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Fixed value: the splitting pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def codec(path: str):
    """(encode, decode) of a sentencepiece model (.model), a rank file (.tiktoken) or a tokenizer file (.json)."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return sp.encode, sp.decode
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return enc.encode_ordinary, enc.decode
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda t: tok.encode(t, add_special_tokens=False).ids, lambda ids: tok.decode(ids, skip_special_tokens=False)


def encoded(text: Column, path: str) -> Column:
    """Token ids of a text; null for null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, _ = codec(path)
        for b in batches:
            yield pd.Series([None if t is None else list(encode(t)) for t in b], dtype=object)

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of token ids; null for null."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, decode = codec(path)
        for b in batches:
            yield pd.Series([None if x is None else decode([int(i) for i in x]) for x in b], dtype=object)

    return run(ids)
