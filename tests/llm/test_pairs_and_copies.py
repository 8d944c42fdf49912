"""Problems 1, 4 and 5 against brute force, and their edge cases."""

import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reedmill.llm import copies, entities, overlap


def rows(df):
    return sorted(tuple(r) for r in df.collect())


VOCABULARY = "mi sina ona li e la pona ike suli lili tomo telo waso kala soweli jan moku toki tawa lon".split()


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    gold = [(i, sentence(rng, rng.randint(1, 12)), sentence(rng, rng.randint(0, 6))) for i in range(25)]
    train = [(100 + i, sentence(rng, rng.randint(0, 14))) for i in range(150)]
    for i, (g, t, c) in enumerate(gold):  # edited copies
        w = (t + " " + c).split() if i % 3 else t.split()
        rng.shuffle(w)
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), rng.choice(VOCABULARY)) if rng.random() < 0.5 or len(w) < 2 else w.pop(rng.randrange(len(w)))
        train.append((500 + g, " ".join(w).upper() + " !"))
    got = rows(
        overlap.overlaps(
            spark.createDataFrame(gold, "gid long, text string, ctx string"), spark.createDataFrame(train, "tid long, text string"),
            eval_id="gid", eval_texts=[["text"], ["ctx"], ["ctx", "text"]], train_id="tid", train_text="text",
        ).select("gid", "tid")
    )
    want = set()
    for g, t, c in gold:
        for s in (t, c, f"{c} {t}"):
            a = Counter(s.lower().split())
            for i, x in train:
                b = Counter(w for w in x.lower().split() if w != "!")
                longer = max(sum(a.values()), sum(b.values()))
                if a and b and sum((a & b).values()) >= 0.7 * longer - 1e-9:
                    want.add((g, i))
    assert got == sorted(want) and len(want) > 20


def test_overlaps_of_other_shares(spark):
    rng = random.Random(33)
    gold = [(i, sentence(rng, rng.randint(1, 9))) for i in range(30)]
    train = [(100 + i, " ".join(rng.sample((w := rng.choice(gold)[1].split()), len(w))) if i % 2 else sentence(rng, rng.randint(1, 9))) for i in range(120)]
    g, t = spark.createDataFrame(gold, "gid long, text string"), spark.createDataFrame(train, "tid long, text string")
    for share in (1.0, 0.85, 0.55):
        want = set()
        for i, x in gold:
            for j, y in train:
                a, b = Counter(x.split()), Counter(y.split())
                if sum((a & b).values()) >= share * max(sum(a.values()), sum(b.values())) - 1e-9:
                    want.add((i, j))
        assert rows(overlap.overlaps(g, t, eval_id="gid", eval_texts=[["text"]], train_id="tid", train_text="text", min_share=share).select("gid", "tid")) == sorted(want)
    with pytest.raises(ValueError):
        overlap.overlaps(g, t, eval_id="gid", eval_texts=[["text"]], train_id="tid", train_text="text", min_share=0.5)


def test_overlap_edge_cases(spark):
    gold = spark.createDataFrame([(1, "mi pona", None, "x"), (2, None, None, "x"), (3, "", "", "x"), (4, "󱤴󱥔", None, "x")], "gid long, text string, ctx string, t_id string")
    train = spark.createDataFrame([(7, "PONA, mi."), (8, None), (9, ""), (10, "pona mi"), (10, "pona mi"), (11, "x " * 5000)], "tid long, text string")
    args = {"eval_id": "gid", "eval_texts": [["text"], ["ctx"], ["ctx", "text"]], "train_id": "tid", "train_text": "text"}
    got = overlap.overlaps(gold, train, **args)
    assert rows(got) == [(1, 7, 1.0), (1, 10, 1.0), (4, 7, 1.0), (4, 10, 1.0)]
    assert overlap.overlaps(gold.limit(0), train, **args).count() == 0 and overlap.overlaps(gold, train.limit(0), **args).count() == 0
    report = overlap.overlap_report(got, gold.withColumn("split", F.lit("val")), train.withColumn("source", F.lit(" A_b")), eval_id="gid", eval_split="split", train_id="tid", train_source="source")
    assert report.first()["source"] == "a-b"


def canon(s):
    return "".join(c for c in (s or "") if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co").lower()


def test_copies_equal_brute_force(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        a, b = rng.choice(["mi pona", "MI  pona!", "tomo", "", None, "…", "󱤴", f"waso {i}"]), rng.choice(["", None, "tomo.", "x", "mi​pona"])
        data.append((i, a, b))
    data += [(1000 + i, "hot", "") for i in range(300)]  # a third of all rows
    df = spark.createDataFrame(data, "rid long, ctx string, text string").withColumn("id", F.lit("clash")).withColumn("h", F.lit(1))
    keyed = copies.keyed([("bird", df, "rid", ["ctx", "text"]), ("other", df, "rid", ["text"])])
    want, sizes = set(), {}
    for tab, cols in (("bird", (1, 2)), ("other", (2,))):
        groups = defaultdict(list)
        for r in data:
            key = tuple(sorted(canon(r[c]) for c in cols))
            if any(key):
                groups[key].append(r[0])
        want |= {(tab, min(g), i) for g in groups.values() for i in g if i != min(g)}
        sizes |= {(tab, min(g)): len(g) for g in groups.values()}
    assert rows(copies.copies(keyed)) == sorted(want)
    assert {(t, f): n for t, f, n in rows(copies.collapse(keyed))} == sizes


def test_filter_keeps_every_repeat_when_overfull(spark):
    df = spark.range(20_000).select((F.col("id") % 15_000).alias("x")).select(F.xxhash64("x").alias("h"))
    maybe = copies.possible_repeats(df, "h", max_bits=1 << 16)
    assert maybe.groupBy("h").count().where("count > 1").count() == 5_000
    sparse = copies.possible_repeats(df, "h")
    assert 10_000 <= sparse.count() < 12_000


def test_filters_by_prefix_lose_nothing_and_stay_sharp(spark):
    df = spark.range(160_000).select((F.col("id") % 120_000).alias("x")).select(F.xxhash64("x").alias("h"))
    maybe = copies.possible_repeats(df, "h", max_bits=1 << 17)  # 16 prefixes
    assert maybe.groupBy("h").count().where("count > 1").count() == 40_000
    assert 80_000 <= maybe.count() < 90_000
    rng = random.Random(15)
    data = [(i, f"waso {rng.randrange(20_000)}") for i in range(30_000)]
    keyed = copies.keyed([("t", spark.createDataFrame(data, "rid long, text string"), "rid", ["text"])])
    groups = defaultdict(list)
    for i, t in data:
        groups[t].append(i)
    assert {f: n for _, f, n in rows(copies.collapse(keyed, 1 << 16))} == {min(g): len(g) for g in groups.values()}
    assert rows(copies.copies(keyed, 1 << 16)) == sorted(("t", min(g), i) for g in groups.values() for i in g if i != min(g))


def test_copies_of_empty_and_long(spark):
    none = spark.createDataFrame([], "rid long, text string")
    assert copies.copies(copies.keyed([("t", none, "rid", ["text"])])).count() == 0
    long = spark.createDataFrame([(1, "a b" * 200_000), (2, "AB" * 1), (3, "A, B" * 200_000), (4, None)], "rid long, text string")
    assert rows(copies.copies(copies.keyed([("t", long, "rid", ["text"])]))) == [("t", 1, 3)]


def test_entity_keys(column):
    same = [
        ["10000213", " 10000213", "eng:010000213", "ENG-10000213", "eng_10000213", "Eng 10000213", "eng/10000213", "#10000213", "10,000,213", "10000213.0", "0010000213"],
        ["lipu:7", "LIPU:7", "lipu: 7", "lipu-7", "Lipu:07 "],
    ]
    for group in same:
        assert len(set(column(lambda c: entities.entity_key(c, F.lit(False)), group))) == 1
    docs = ["poki/sona/ilo-228.md#18", "poki\\sona\\ilo-228.md", "./poki/sona/ilo-228.md#c3", "POKI/Sona/ILO-228.MD ", "poki//sona/ilo-228.md"]
    assert set(column(lambda c: entities.entity_key(c, F.lit(True)), docs)) == {"Dpoki/sona/ilo-228.md"}
    assert column(lambda c: entities.entity_key(c, F.lit(True)), ["tokwiki/lawa nasin 287#25", "TOKWIKI/LAWA_NASIN_287"]) == ["Dtokwiki/lawa_nasin_287"] * 2
    assert column(lambda c: entities.entity_key(c, F.lit(False)), ["7", "lipu:7", None, "  "]) == ["E7", "L7", None, None]


def plain_components(data):
    root = {i: i for i, _ in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_key = defaultdict(list)
    for i, keys in data:
        for k in keys or []:
            if k is not None:
                by_key[k].append(i)
    for ids in by_key.values():
        for i in ids[1:]:
            root[find(i)] = find(ids[0])
    groups = defaultdict(set)
    for i in root:
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    data = [(i, [f"a{rng.randrange(90)}", f"b{rng.randrange(120)}"] if rng.random() < 0.7 else [f"c{i // 7}"] if rng.random() < 0.5 else rng.choice([None, [], [None]])) for i in range(250)]
    data += [(1000 + i, [f"p{i}", f"p{i + 1}"]) for i in range(60)]  # a long path
    df = spark.createDataFrame(data, "id long, keys array<string>")
    groups = defaultdict(set)
    for r in entities.components(df).collect():
        groups[r.root].add(r.id)
    assert {frozenset(g) for g in groups.values()} == plain_components(data)
    labels, forest = entities.spanning_forest(entities.star_edges(df))
    assert forest.distinct().count() == labels.count() - labels.select("root").distinct().count()  # a forest


def test_splits(spark):
    data = [(i, [f"k{i % 400}"]) for i in range(4_000)] + [(10_000 + i, ["hot"]) for i in range(2_000)]
    df = spark.createDataFrame(data, "id long, keys array<string>")
    out = entities.assign_splits(df, [("train", 0.8), ("val", 0.1), ("test", 0.1)])
    assert out.count() == 6_000 and out.groupBy("root").agg(F.countDistinct("new_split").alias("n")).where("n > 1").count() == 0
    share = {r.new_split: r["count"] / 6_000 for r in out.groupBy("new_split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.02
    assert entities.assign_splits(df.limit(0), [("train", 1.0)]).count() == 0


def test_split_breaks(spark):
    data = [(1, ["a"], "train"), (2, ["a"], "val"), (3, ["a"], "train"), (4, ["b"], "train"), (5, ["b"], "train"), (6, None, "val"), (7, ["c"], None), (8, ["c"], "val")]
    df = spark.createDataFrame(data, "id long, keys array<string>, split string")
    assert rows(entities.split_breaks(df)) == [(1, 2), (2, 3)]
    assert entities.split_breaks(df.limit(0)).count() == 0


def test_forest_of_contracted_rows(spark):
    rng = random.Random(19)
    data = [(i, rng.choice([None, [], [f"a{rng.randrange(40)}"], [f"a{rng.randrange(40)}", f"b{rng.randrange(30)}"], [f"c{i}", "c0", None, "c0"]])) for i in range(300)]
    df = spark.createDataFrame(data, "id long, keys array<string>")
    roots, forest = entities.components_and_forest(df)
    want = plain_components(data)
    groups = defaultdict(set)
    for r in roots.collect():
        groups[r.root].add(r.id)
    assert {frozenset(g) for g in groups.values()} == want
    edges = [tuple(r) for r in forest.collect()]
    assert len(edges) == len(data) - len(want)
    assert plain_components([(i, [f"e{k}" for k, e in enumerate(edges) if i in e]) for i, _ in data]) == want


def test_break_members(spark):
    data = [(1, ["a"], "train"), (2, ["a"], "val"), (3, ["a"], "train"), (4, ["b"], "train"), (5, ["b"], "train"), (6, None, "val"), (7, ["c"], None), (8, ["c"], "val")]
    df = spark.createDataFrame(data, "id long, keys array<string>, split string")
    assert rows(entities.break_members(df).select("id", "split", "n_elsewhere")) == [(1, "train", 1), (2, "val", 2), (3, "train", 1)]
    assert entities.break_members(df.limit(0)).count() == 0 and entities.forest_table(df.limit(0)).count() == 0
