"""Problems 2, 3 and 7: exact round trips and invariants."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reedmill.llm import mixing, packing, tokens


def test_chunks_keep_counts():
    enc = tokens.encoder(tokens.TOKENIZER)
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["mi", "tomo", " ", "  ", "\n", "!", "é", "’s", "'s", "12", "󱤴", "日本", " "]) for _ in range(rng.randrange(400)))
        parts = tokens.independent_chunks(text, rng.choice([1, 7, 40]))
        assert "".join(parts) == text and sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 .'\n\té世")), max_size=80), st.integers(1, 20))
def test_chunks_keep_counts_of_any_text(text, size):
    enc = tokens.encoder(tokens.TOKENIZER)
    assert sum(len(enc.encode_ordinary(p)) for p in tokens.independent_chunks(text, size)) == len(enc.encode_ordinary(text))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("asrtl19 .,'-\n\té世\x1c\x85\xa0\u2028\U000f1934")), max_size=60), st.integers(1, 6))
def test_chunks_at_class_steps(text, size):
    enc = tokens.encoder(tokens.TOKENIZER)
    assert sum(len(enc.encode_ordinary(p)) for p in tokens.independent_chunks(text, size)) == len(enc.encode_ordinary(text))


def test_long_pages_of_any_kind_are_cut():
    enc = tokens.encoder(tokens.TOKENIZER)
    rng = random.Random(7)
    glyphs = lambda n: "".join(chr(0xF1900 + rng.randrange(120)) for _ in range(n))
    pages = [
        " ".join(glyphs(rng.randrange(1, 9)) for _ in range(8_000)), "\n".join(rng.choice(["mi", "tomo", "waso"]) for _ in range(20_000)), ",".join(str(rng.randrange(10**6)) for _ in range(10_000)),
        "\n".join(f"http://kala-{rng.randrange(99)}.example/barn?id={rng.randrange(9999)}" for _ in range(3_000)), "* [mi](http://a.example/b) | " * 3_000, "日本 " * 20_000,
    ]
    for page in pages:
        parts = tokens.independent_chunks(page)
        assert max(map(len, parts)) < tokens.CHUNK + 100 and "".join(parts) == page
        assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(page))


def test_document_tokens(spark):
    enc = tokens.encoder(tokens.TOKENIZER)
    data = [(1, "mi tawa"), (2, None), (3, ""), (4, "tomo pona " * 5_000), (5, "x" * 20_000), (6, "<|endoftext|>"), (7, "mi tawa")]
    df = spark.createDataFrame(data, "id long, text string").withColumn("chunk", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    want = {i: len(enc.encode_ordinary(t or "")) for i, t in data}
    for limits in ({}, {"oversized": 10, "chunk": 5}):
        assert {r.id: r.n_tokens for r in tokens.document_tokens(df, F.col("text"), {"id": F.col("id")}, **limits).collect()} == want
    totals = tokens.slice_totals(tokens.document_tokens(df, F.col("text"), {"id": F.col("id"), "s": F.lit("a")}), ["s"]).first()
    assert (totals.n_docs, totals.n_empty, totals.n_tokens) == (7, 2, sum(want.values()))
    assert tokens.document_tokens(df.limit(0), F.col("text"), {"id": F.col("id")}).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_places_every_item_once(histogram):
    runs, n = packing.plan_runs(histogram, 50)
    used = Counter()
    for length in histogram:
        spans = sorted((lo, hi) for x, lo, hi, _, _ in runs if x == length)
        assert [lo for lo, _ in spans] == [0, *[hi for _, hi in spans[:-1]]] and spans[-1][1] == histogram[length]
    for length, lo, hi, k, c0 in runs:
        for r in range(lo, hi):
            used[c0 + (r - lo) // k] += length
    assert len(used) == n and max(used.values(), default=0) <= 50
    assert n == plain_best_fit([x for x, c in histogram.items() for _ in range(c)], 50)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.integers(1, 5))
def test_tiers_place_every_item_once(histogram, tiers):
    runs, n = packing.plan_tiers(histogram, 64, tiers)
    used, longest, tier = Counter(), Counter(), {}
    for length in histogram:
        spans = sorted((lo, hi) for x, lo, hi, *_ in runs if x == length)
        assert [lo for lo, _ in spans] == [0, *[hi for _, hi in spans[:-1]]] and spans[-1][1] == histogram[length]
    for length, lo, hi, k, c0, t in runs:
        for r in range(lo, hi):
            c = c0 + (r - lo) // k
            used[c] += length
            longest[c] = max(longest[c], length)
            assert tier.setdefault(c, t) == t
    assert len(used) == n and max(used.values(), default=0) <= 64
    assert all(packing.tier_of(longest[c], 64, tiers) == t for c, t in tier.items())
    items = [x for x, c in histogram.items() for _ in range(c)]
    assert n <= plain_best_fit(items, 64) * 1.25 + 1


def test_tiers_fill_long_windows_from_short_documents():
    runs, n = packing.plan_tiers({700: 100, 300: 100, 20: 100}, 1024, 4)
    assert n == 100 and {r[5] for r in runs} == {0}
    runs, n = packing.plan_tiers({200_000: 3, 100_000: 3}, 300_000)  # any capacity
    assert n == 3


def plain_best_fit(items, capacity):
    """Containers of best-fit decreasing, item by item."""
    gaps = []
    for x in sorted(items, reverse=True):
        fitting = [g for g in gaps if g >= x]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_pack(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([0, 3, 17, 17, 17, 64, 100, 250, rng.randrange(1, 90)])) for i in range(3_000)] + [(9_000, None), (9_001, 1), (9_001, 1)]
    df = spark.createDataFrame(data, "doc long, n long").withColumn("len", F.lit("clash")).withColumn("piece", F.lit(0))
    out = packing.pack(df, item_id="doc", size="n", capacity=100)
    got = Counter()
    for r in out.collect():
        got[r.doc] += r.n_tokens
    want = Counter()
    for i, n in data:
        want[i] += n or 0
    assert got == want
    per = out.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    assert per.agg(F.max("t")).first()[0] <= 100
    divided = out.groupBy("doc").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).where("n > 1 and doc <> 9001")
    assert divided.agg(F.min("t")).first()[0] > 100
    report = packing.fill_report(out, 100).first()
    assert report.filled > 0.98 and report.fullest_group - report.emptiest_group <= 0.1 * report.fullest_group + 200
    empty = packing.pack(df.limit(0), item_id="doc", size="n", capacity=100)
    assert empty.count() == 0 and packing.fill_report(empty, 100).first().n_groups == 0
    with pytest.raises(ValueError):
        packing.pack(df, item_id="doc", size="n", capacity=0)


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 100, 257):
        got = [r.y for r in spark.range(n).selectExpr(f"{mixing.permuted('id', f'{n}L', 'cast(3 as bigint)')} as y").collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != list(range(n)))


def test_draws_meet_their_totals():
    import numpy as np

    slots = np.array([1, 500, 3, 9_000])
    draws = mixing.shard_draws(slots, 17, 5)
    assert (draws.sum(axis=0) == slots).all() and (draws >= 0).all()


def test_blocks_are_of_one_length(spark):
    rng = random.Random(14)
    data = [("t", i, rng.choice(["a", "b"]), rng.choice([1, 7, 40, 300, 1000])) for i in range(900)]
    parts = mixing.blocks(spark.createDataFrame(data, "tab string, id long, source string, n_tokens long"), 3, 64).collect()
    size, covered = Counter(), {}
    for r in parts:
        size[r.source, r.block] += r.n_tokens
        covered.setdefault(r.id, []).append((r.begin, r.n_tokens))
    last = {s: max(b for x, b in size if x == s) for s in "ab"}
    assert all(n == 64 or b == last[s] and 0 < n <= 64 for (s, b), n in size.items())
    for _, i, _, n in data:  # parts make up the row, end to end
        at = 0
        for begin, k in sorted(covered[i]):
            assert begin == at
            at += k
        assert at == n


def test_shards_have_no_ceiling(spark, monkeypatch):
    data = [("t", i, "ab"[i % 2], 64) for i in range(20_000)]
    df = spark.createDataFrame(data, "tab string, id long, source string, n_tokens long")
    monkeypatch.setattr(mixing, "GROUPS", 7)
    monkeypatch.setattr(mixing, "SLOTS_A_SHARD", 16)
    mixed = mixing.mix(df, [("a", 0.5, 1), ("b", 0.5, 1)], block_tokens=64)
    got = mixed.groupBy("shard").agg(F.count("*").alias("n")).collect()
    assert len(got) == 20_000 // 16 and sum(r.n for r in got) == 20_000 and max(r.n for r in got) < 64
    assert mixed.select("id").distinct().count() == 20_000 and mixed.select("source", "slot").distinct().count() == 20_000


def test_mix(spark):
    rng = random.Random(4)
    data = [("t", i, "big", rng.randrange(5, 60)) for i in range(6_000)] + [("t", 10_000 + i, "small", rng.randrange(5, 60)) for i in range(400)]
    data += [("t", 20_000, "big", 0), ("t", 20_001, "stray", 9), ("t", 20_002, None, 9)]
    df = spark.createDataFrame(data, "tab string, id long, source string, n_tokens long").withColumn("block", F.lit("clash"))
    targets = [("big", 0.7, 1), ("small", 0.3, 4), ("absent", 0.1, 2)]
    mixed = mixing.mix(df, targets)
    report = {r.source: r for r in mixing.share_report(mixed, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")).collect()}
    assert report["big"].most_uses <= 1 and report["small"].most_uses <= 4 and report["absent"].n_tokens == 0
    assert abs(report["big"].actual_share - 0.7) < 0.01 and abs(report["small"].actual_share - 0.3) < 0.01
    assert set(r.source for r in mixed.select("source").distinct().collect()) == {"big", "small"}
    assert mixing.mix(df.limit(0), targets).count() == 0
