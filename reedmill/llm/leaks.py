"""Problem 8: evaluation passages inside a training corpus.

Latent semantic retrieval. Words are hashed TF-IDF features with document frequencies of the whole corpus. A distributed randomised SVD (seeded range
finder with power iterations; workers send partial products of bounded size) over the passages of at most SAMPLE_DOCS documents and of the items gives the latent space. Every
window of WINDOW words of the items, at every word, is in an index of inverted lists round centroids of the space; every document is read in windows of
WINDOW words at every STRIDE-th word, which are looked up in the list of their nearest centroid and proposed as candidates by cosine. Candidates are
verified word by word: at least RUN words round the two windows must be the same.

No run is lost, whatever surrounds it: any RUN = WINDOW + STRIDE - 1 words of a document hold one of its windows whole, the item has the same window, and windows of the same words have the same
vector, hence cosine 1 and the same nearest centroid (item windows stand in every list that comes within TIE of their nearest).

Paraphrases: every document is read in spans of 48 words at every 12th word (and its last 48; a shorter document is one span), every span is held against every
item, and the longest common subsequence decides. It is taken only where it can reach the stated share: it is at most the number of words of the span that the item has
at all, which is counted first for every pair. That bound is exact, so no pair of that share is lost. Subsequences are bit-parallel over many spans at once.

Documents are hashed once, into the checkpoint folder, in pieces of bounded length that overlap by a span; a long document is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import settled
from ..functions.script import letter_words
from ..session import cut_lineage, spread

RUN, WINDOW, STRIDE = 12, 8, 5
SPAN = 48  # at most 64, the bits of a word
PIECE = 342 * RUN  # words of a document in a piece; pieces begin where spans do
ITEM_PIECE = 512
FEATURES = 1 << 14
RANK, PASSAGE, ROUNDS = 64, 24, 2
SAMPLE_DOCS = 5_000
MIN_COSINE, TIE = 0.95, 1e-3
WINDOWS_A_BLOCK = 200_000
ITEMS_A_BLOCK = 5_000
CHUNK_TOKENS = 24_000
TABLE_CELLS = 4_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words without case, markup, punctuation, spacing and script."""
    return F.transform(letter_words(F.regexp_replace(text, r"<[^<>]*>", " ")), lambda w: F.xxhash64(w))


def in_pieces(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc, h) with at most ``size`` words each, neighbours overlapping by ``overlap``; only the last is shorter, but longer than the overlap."""
    step = size - overlap
    cut = f"transform(sequence(0, cast(greatest(0, ceil((size(h) - {size}) / {step})) as int)), k -> slice(h, k * {step} + 1, {size}))"
    return rows.select("doc", F.explode(F.expr(cut)).alias("h"))


def _flat(arrays: list) -> tuple[np.ndarray, np.ndarray]:
    """(all hashes, lengths)."""
    lengths = np.array([len(a) for a in arrays], np.int64)
    return (np.concatenate(arrays).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)), lengths


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes, lengths) with about CHUNK_TOKENS hashes."""
    for b in batches:
        ids, arrays, size = [], [], 0
        for i, a in zip(b["doc"], b["h"], strict=True):
            if size and size + len(a) > CHUNK_TOKENS:
                yield (np.array(ids), *_flat(arrays))
                ids, arrays, size = [], [], 0
            ids.append(i)
            arrays.append(a)
            size += len(a)
        if size:
            yield (np.array(ids), *_flat(arrays))


def _starts(lengths: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of the whole windows of each text, as places in the texts laid end to end."""
    n = np.where(lengths >= size, (lengths - size) // stride + 1, 0)
    text = np.repeat(np.arange(len(lengths)), n)
    return text, (np.cumsum(lengths) - lengths)[text] + stride * (np.arange(len(text)) - (np.cumsum(n) - n)[text])


# --- latent space ------------------------------------------------------------------------------------------------------------------


def _partial_products(shared):
    """Sum over passages of x (x Q): the rows of the product that aren't zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, basis = shared.value
        weighted, total, seen = basis * idf[:, None], np.zeros((FEATURES, basis.shape[1]), np.float32), np.zeros(FEATURES, np.bool_)
        for _, hashes, lengths in _chunks(batches):
            feature = hashes & (FEATURES - 1)
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            first = place % PASSAGE == 0
            y = np.add.reduceat(weighted[feature], np.flatnonzero(first), axis=0)
            order = np.argsort(feature, kind="stable")
            own, at = np.unique(feature[order], return_index=True)
            total[own] += idf[own, None] * np.add.reduceat(y[np.cumsum(first)[order] - 1], at, axis=0)
            seen[own] = True
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "y": [total[at].tobytes()]})

    return run


def latent_space(docs: DataFrame, items: DataFrame, rank: int = RANK, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Vectors of the features, FEATURES x (rank + 1): IDF times an orthonormal basis of the strongest latent directions, and a small constant so that no word has length 0. docs, items: doc, h."""
    spark = docs.sparkSession
    counts = docs.select("doc", F.explode(F.array_distinct(F.transform("h", lambda x: x.bitwiseAND(FEATURES - 1)))).alias("f")).groupBy("f").count()
    n = docs.count()
    df = np.zeros(FEATURES)
    for r in counts.collect():  # at most FEATURES rows
        df[r["f"]] = r["count"]
    idf = np.log((n + 1) / (np.minimum(df, n) + 1)).astype(np.float32) + np.float32(0.1)
    drawn = F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) < SAMPLE_DOCS / max(1, n)
    sample = cut_lineage(docs.where(drawn).unionAll(items).repartition(8))
    width = min(rank + 10, FEATURES)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, width)))[0].astype(np.float32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((idf, basis))
        total = np.zeros((FEATURES, width))
        for r in sample.mapInPandas(_partial_products(shared), "at binary, y binary").toLocalIterator():  # 8 parts of at most FEATURES x width numbers
            at = np.frombuffer(r["at"], np.int32)
            total[at] += np.frombuffer(r["y"], np.float32).reshape(len(at), width)
        q, r = np.linalg.qr(total)  # the singular vectors by way of a small square matrix
        u, s, _ = np.linalg.svd(r)
        basis = np.where(s > 1e-6 * max(s[0], 1e-30), q @ u, 0).astype(np.float32)
        shared.unpersist()
    return np.hstack([basis[:, :rank] * idf[:, None], np.full((FEATURES, 1), 1e-3, np.float32)]).astype(np.float32)


def _vectors(weights: np.ndarray, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Vectors of length 1 of the windows at those places; words are added in their order, so equal windows have equal vectors."""
    v = weights[feature[at]]
    for j in range(1, WINDOW):
        v += weights[feature[at + j]]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Index:
    """Inverted lists of item windows round centroids, and the items' words for verification."""

    def __init__(self, weights: np.ndarray, ids: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, seed: int = 3):
        self.weights, self.ids = weights, ids
        self.item, at = _starts(lengths, WINDOW, 1)
        self.words, self.at = _apart(hashes, lengths, at, self.item, -1)
        v = _vectors(weights, hashes & (FEATURES - 1), at) if len(at) else np.zeros((0, weights.shape[1]), np.float32)
        rng = np.random.default_rng(seed)
        self.centroids = v[rng.permutation(len(v))[: max(1, int(len(v) ** 0.5))]].copy()
        for _ in range(4):
            near = np.concatenate([np.argmax(sim, axis=1) for _, sim in self._by_block(v)] or [np.zeros(0, np.int64)])
            for c in range(len(self.centroids)):
                if (own := v[near == c]).size:
                    self.centroids[c] = own.sum(0) / max(1e-9, float(np.linalg.norm(own.sum(0))))
        window, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, sim in self._by_block(v):
            i, j = np.nonzero(sim >= sim.max(axis=1, keepdims=True) - TIE)
            window.append(at + i)
            c.append(j)
        window, c = np.concatenate(window), np.concatenate(c)
        order = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[order], np.arange(1, len(self.centroids)))
        self.lists = [(own, v[own]) for own in np.split(window[order], cuts)]

    def _by_block(self, v: np.ndarray, rows: int = 8192) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, similarities to the centroids) of blocks of bounded size."""
        for at in range(0, len(v), rows):
            yield at, v[at : at + rows] @ self.centroids.T

    def candidates(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of v, item window) of at least MIN_COSINE in the nearest list."""
        near = np.argmax(v @ self.centroids.T, axis=1)
        order = np.argsort(near, kind="stable")
        kinds, first = np.unique(near[order], return_index=True)
        rows, windows = [], []
        for c, own in zip(kinds, np.split(order, first[1:]), strict=True):
            w, q = np.nonzero(v[own] @ self.lists[c][1].T >= MIN_COSINE)
            rows.append(own[w])
            windows.append(self.lists[c][0][q])
        return np.concatenate(rows), np.concatenate(windows)


def _apart(hashes: np.ndarray, lengths: np.ndarray, at: np.ndarray, text: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with RUN marks before, between and behind them, and the places in them."""
    own = np.repeat(np.arange(len(lengths)), lengths)
    out = np.full(len(hashes) + RUN * (len(lengths) + 1), mark, np.int64)
    out[np.arange(len(hashes)) + RUN * (own + 1)] = hashes
    return out, at + RUN * (text + 1)


def same_run(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Whether RUN words that hold the windows at those places are the same in both."""
    reach = np.arange(WINDOW - RUN, RUN)
    same = np.cumsum(np.pad(a[at[:, None] + reach] == b[bt[:, None] + reach], ((0, 0), (1, 0))), axis=1)
    return (same[:, RUN:] - same[:, :-RUN] == RUN).any(axis=1)


def _runs(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for ids, hashes, lengths in _chunks(batches):
            text, at = _starts(lengths, WINDOW, STRIDE)
            if not len(at) or not len(index.item):
                continue
            row, window = index.candidates(_vectors(index.weights, hashes & (FEATURES - 1), at))
            words, place = _apart(hashes, lengths, at, text, 0)
            good = same_run(words, place[row], index.words, index.at[window])
            pairs = np.unique(text[row[good]] * len(index.ids) + index.item[window[good]])
            if len(pairs):
                yield pd.DataFrame({"item": index.ids[pairs % len(index.ids)], "doc": ids[pairs // len(index.ids)], "kind": "run", "share": 1.0, "answered": pd.array([None] * len(pairs), "boolean")})

    return run


# --- paraphrases -------------------------------------------------------------------------------------------------------------------


def _spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the spans of each document."""
    n = 1 + -(-np.maximum(lengths - SPAN, 0) // RUN)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(RUN * k, np.maximum(lengths[doc] - SPAN, 0))
    return doc, at + (np.cumsum(lengths) - lengths)[doc], np.minimum(lengths[doc], SPAN)


def _near(codes: np.ndarray, lengths: np.ndarray, item_codes: list[np.ndarray], n_codes: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, share) of the spans of at least that share. codes: from 1, 0 for a word of no item."""
    docs, items, shares = [], [], []
    doc, at, size = _spans(lengths)
    n = max(64, min(2048, TABLE_CELLS // (n_codes + 1)))
    padded = np.concatenate([codes, np.zeros(SPAN, codes.dtype)])
    for b in range(0, len(doc), n):
        d, z = doc[b : b + n], size[b : b + n]
        words = np.where(np.arange(SPAN) < z[:, None], padded[at[b : b + n, None] + np.arange(SPAN)], 0)
        own, place = np.unique(words, return_inverse=True)
        place, lookup = place.reshape(words.shape), np.full(n_codes + 1, -1)
        lookup[own] = np.arange(len(own))
        lookup[0] = -1
        masks = np.zeros((len(own), len(d)), np.uint64)  # where each word stands in each span
        for k in range(SPAN):
            masks[place[:, k], np.arange(len(d))] |= np.uint64(1 << k)
        full = np.uint64((1 << SPAN) - 1)
        inside = full >> (SPAN - z).astype(np.uint64)
        for i, w in enumerate(item_codes):
            rows = lookup[w]
            rows = rows[rows >= 0]
            if not len(rows):
                continue
            shorter = np.minimum(len(w), z)
            may = np.flatnonzero(np.bitwise_count(np.bitwise_or.reduce(masks[np.unique(rows)], axis=0)) >= least * shorter - 1e-9)
            if not len(may):
                continue
            part = masks[:, may]
            row = np.full(len(may), full)
            for r in rows:
                u = row & part[r]
                row = (row + u) | (row - u)
            share = (z[may] - np.bitwise_count(row & inside[may]).astype(np.int64)) / shorter[may]
            hit = np.flatnonzero(share >= least)
            docs.append(d[may[hit]])
            items.append(np.full(len(hit), i))
            shares.append(share[hit])
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((docs, np.int64), (items, np.int64), (shares, float)))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for y in b:
        u = row & masks.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - bin(row).count("1")


def holds(text: np.ndarray, run: np.ndarray) -> bool:
    """Whether the words of run stand in text one after the other; an empty run doesn't."""
    n = len(text) - len(run) + 1
    if not len(run) or n < 1:
        return False
    at = np.flatnonzero(text[:n] == run[0])
    return bool((text[at[:, None] + np.arange(len(run))] == run).all(axis=1).any()) if len(at) else False


def _paraphrases(shared, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_ids, words, item_codes, answers = shared.value
        for ids, hashes, lengths in _chunks(batches):
            if len(words):
                at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                d, i, share = _near(np.where(words[at] == hashes, at + 1, 0), lengths, item_codes, len(words), least)
                if len(d):
                    ends = np.cumsum(lengths)
                    answered = [None if answers[y] is None else holds(hashes[ends[x] - lengths[x] : ends[x]], answers[y]) for x, y in zip(d, i, strict=True)]
                    yield pd.DataFrame({"item": item_ids[i], "doc": ids[d], "kind": "paraphrase", "share": share, "answered": pd.array(answered, "boolean")})

    return run


# --- Spark -------------------------------------------------------------------------------------------------------------------------


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item_text: str, paraphrase: float = 1.0, answer: str | None = None) -> DataFrame:
    """(item_id, doc_id, kind, share). kind ``run``: at least 12 consecutive words in common. With paraphrase < 1, also the other pairs of which a span of the document and the item
    have at least that share of the shorter side as their longest common subsequence. With the items' column ``answer``, a column ``answered`` says of a paraphrase whether the words of
    the item's answer stand together in the same piece of the document (PIECE words); null for runs and for items without an answer.

    Null and blank texts give nothing, texts of less than 12 words no run; a document id given repeatedly gives one row an item; an empty corpus or test set gives no rows.
    """
    spark = docs.sparkSession
    corpus = settled(spread(docs).select(F.col(doc_id).alias("doc"), word_hashes(F.col(text)).alias("h"))).where(F.size("h") > 0)
    corpus = cut_lineage(in_pieces(corpus, PIECE, SPAN))
    said = word_hashes(F.col(answer)) if answer else F.array().cast("array<bigint>")
    tests = cut_lineage(settled(items.select(F.col(item_id).alias("doc"), word_hashes(F.col(item_text)).alias("h"), said.alias("answer"))).where(F.size("h") > 0).distinct())
    schema = f"item {dict(items.dtypes)[item_id]}, doc {dict(docs.dtypes)[doc_id]}, kind string, share double, answered boolean"
    weights = latent_space(corpus, tests.select("doc", "h"))
    cut = in_pieces(tests, ITEM_PIECE, RUN - 1).withColumn("part", F.xxhash64("doc", "h"))
    blocks = max(1, -(-int(cut.agg(F.sum(F.size("h"))).first()[0] or 0) // WINDOWS_A_BLOCK))
    found = []
    for block in range(blocks):
        part = cut.where(F.pmod("part", F.lit(blocks)) == block).orderBy("doc", "part").collect()  # about WINDOWS_A_BLOCK words
        shared = spark.sparkContext.broadcast(Index(weights, np.array([r["doc"] for r in part]), *_flat([np.array(r["h"], np.int64) for r in part])))
        found.append(corpus.mapInPandas(_runs(shared), schema))
    blocks = max(1, -(-tests.count() // ITEMS_A_BLOCK)) if paraphrase < 1 else 0
    for block in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("doc"), F.lit(blocks)) == block).orderBy("doc").collect()  # about ITEMS_A_BLOCK rows
        texts = [np.array(r["h"], np.int64) for r in part]
        words = np.unique(np.concatenate([np.zeros(0, np.int64), *texts]))
        shared = spark.sparkContext.broadcast((np.array([r["doc"] for r in part]), words, [np.searchsorted(words, h) + 1 for h in texts], [np.array(r["answer"], np.int64) if len(r["answer"]) else None for r in part]))
        found.append(corpus.mapInPandas(_paraphrases(shared, paraphrase), schema))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    best = F.max(F.struct((F.col("kind") == "run").alias("run"), F.coalesce("answered", F.lit(False)).alias("sure"), "share", "kind", "answered"))  # a run goes before a paraphrase
    found_pairs = out.groupBy("item", "doc").agg(best.alias("b"))
    return found_pairs.select(F.col("item").alias(item_id), F.col("doc").alias(doc_id), "b.kind", "b.share", *(["b.answered"] if answer else []))
