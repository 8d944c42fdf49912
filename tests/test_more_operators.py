"""Run lengths, formats, logs, tokenizers, feeds, set operations and the loop of rounds."""

import random
import struct
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reedmill.functions import arrays, formats, phonology, sqlnames
from reedmill.operators import chunks, feeds, increment, metrics, sets
from reedmill.operators import tokenizer as tk
from reedmill.sources import logs, readers, sinks
from reedmill.streaming import feeds as streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_run_lengths(spark):
    rng = random.Random(1)
    data = [(i, [rng.choice("abc") for _ in range(rng.randrange(9))]) for i in range(40)] + [(100, []), (101, None), (102, ["x"] * 5000 + ["y"])]
    df = spark.createDataFrame(data, "i int, a array<string>")
    for r in df.select("i", "a", arrays.most_common(F.col("a")).alias("m"), arrays.numbered(F.col("a")).alias("n")).collect():
        counts = Counter(r.a or [])
        assert r.m == (max(counts.values(), default=0) if r.a is not None else r.m)
        if r.a is not None:
            assert Counter(x.split("\u0001")[0] for x in r.n) == counts and len(set(r.n)) == len(r.a)


def test_running_total_of_sparse_and_dense_orders(spark):
    ids = [10**12 + i for i in range(300)] + [i * 10**6 for i in range(200)] + [-5]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.t for r in sets.running_total(df, "id", F.lit(1), "t", width=50).collect()}
    assert got == {x: k + 1 for k, x in enumerate(sorted(ids))}


def test_formats(column):
    assert column(formats.signed, [0.5, -1.25, None], "double") == ["+0.500", "-1.250", None]
    assert column(formats.percent, [0.123, None], "double") == ["12.3%", None] and column(formats.safe_name, ["a:b/c", None]) == ["a_b_c", None]
    lines = ["SCENE: sun | BIRD: hi", "x SCENE: (none) | BIRD: yo | more", "SCENE: a | BIRD: ", "BIRD: only", "SCENE: NONE| BIRD:b", None, ""]
    assert [tuple(r) if r else None for r in column(formats.scene_line, lines)] == [("sun", "hi"), ("", "yo | more"), None, None, ("", "b"), None, None]


def test_sql_names(spark):
    assert set(sqlnames.register_sql(spark)) == {"is_legal_word", "syllabify", "latin_to_ucsur", "ucsur_to_latin"}
    texts = ["mi moku e kili.", "jan Sonja li toki: pona!", "", "Mali", "krai zz", None, "ona li wile ala wile, a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("sql_names")
    got = spark.sql("select is_legal_word(t) a, syllabify(t) b, latin_to_ucsur(t) c, ucsur_to_latin(latin_to_ucsur(t)) d from sql_names").collect()
    t = F.col("t")
    want = df.select(phonology.is_legal_word(t), phonology.syllables(t), phonology.latin_to_ucsur(t), phonology.ucsur_to_latin(phonology.latin_to_ucsur(t))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _record(step, tag, value, tensor=False):
    x = _field(8, _varint(1 << 3) + b"\x01" + _field(4, struct.pack("<f", value))) if tensor else b"\x15" + struct.pack("<f", value)
    event = b"\x09" + struct.pack("<d", 1.5) + b"\x10" + _varint(step) + _field(5, _field(1, _field(1, tag.encode()) + x))
    return struct.pack("<Q", len(event)) + b"\0" * 4 + event + b"\0" * 4


def test_training_logs(spark, tmp_path):
    folder = tmp_path / "runs" / "r1"
    folder.mkdir(parents=True)
    data = _record(0, "loss", 2.5) + _record(300, "loss", 1.5) + _record(300, "val/ĉ", 0.25, True)
    (folder / "events.out.tfevents.1").write_bytes(data + _record(900, "loss", 9.0)[:-9])
    (folder / "events.out.tfevents.2").write_bytes(b"")
    (folder / "other").write_bytes(b"x")
    assert rows(logs.training_logs(spark, str(tmp_path)).select("run", "step", "tag", "value")) == [("r1", 0, "loss", 2.5), ("r1", 300, "loss", 1.5), ("r1", 300, "val/ĉ", 0.25)]


def test_tokenizers_round_trip(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "mi tawa  ma."), (2, ""), (3, None), (4, "o kute! 󱤀 é\n x")], "i int, t string")
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = f"/opt/tokenizers/{name}"
        if not Path(path).exists():
            continue
        ids = df.select("i", "t", tk.encoded(F.col("t"), path).alias("ids"))
        for r in ids.select("i", "t", "ids", tk.decoded(F.col("ids"), path).alias("back")).collect():
            assert (r.ids is None) == (r.t is None)
            assert r.back == r.t or name.endswith(".model") and r.back.split() == r.t.split()


def test_line_numbers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("x\n\ny\n")
    (tmp_path / "d" / "b.txt").write_text("z\nw\n")
    got = rows(readers.ordered_lines(spark, str(tmp_path / "d")).select("ord", "line", "value"))
    assert got == [(0, 0, "x"), (1, 1, ""), (2, 2, "y"), (3, 0, "z"), (4, 1, "w")]
    big = tmp_path / "big.txt"
    big.write_text("".join(f"{i}\n" for i in range(50_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = readers.ordered_lines(spark, str(big))
        assert lines.count() == 50_000 and lines.where("cast(value as long) <> ord OR line <> ord").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_nulls_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "t string, tok_id string")
    sinks.write_jsonl(df, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0] == '{"t":"a","tok_id":null}' == sinks.summary(df).first()[0]


def test_sources_fail_by_themselves_and_fetch(spark, tmp_path):
    (tmp_path / "bad.gz").write_bytes(b"not compressed")
    raw, fetched = tmp_path / "raw.txt", []

    def fetch():
        fetched.append(1)
        raw.write_text("mi\n")

    good = readers.Source("good", lambda s: readers.numbered_lines(s, str(raw), "good"), fetch, str(raw))
    bad = readers.Source("bad", lambda s: s.read.text(str(tmp_path / "bad.gz")).select(F.lit("1").alias("id"), F.col("value").alias("text")))
    for options, times in (({}, 1), ({}, 1), ({"force": True}, 2), ({"skip_fetch": True}, 2)):
        df, failed = readers.load_corpus(spark, [bad, good], **options)
        assert rows(df) == [("good", "good:0", "mi")] and [n for n, _ in failed] == ["bad"] and len(fetched) == times
    (tmp_path / "t.jsonl").write_text('{"source": "a", "messages": [{"role": "user", "content": "x"}]}\n')
    both = readers.split_jsonl(spark, {"train": str(tmp_path / "t.jsonl"), "validation": str(tmp_path / "t.jsonl")})
    assert rows(both.select("split", "source")) == [("train", "a"), ("validation", "a")]


def test_styles(spark):
    lines = [f'{{"type": "SetStyle", "style": "{s}"}}' for s in ("sona", "WALO", "sewi", "ink", "")]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(feeds.parse_control(F.col("l"))["style"].alias("s")).collect()
    assert [r.s for r in got] == ["sona", "WALO", "sewi", None, None]


def test_set_operations(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (None,)], "x int")
    assert {r.x for r in sets.in_both(a, b).collect()} == {1, None} and {r.x for r in sets.only_first(a, b).collect()} == {2}
    assert rows(sets.chosen_union({"a": a.where("x = 2"), "b": b.where("x = 1")}, skip={"b"})) == [(2, "a")]
    assert sets.chosen_union({"a": a}, skip={"a"}).count() == 0
    with pytest.raises(ValueError):
        sets.chosen_union({"a": a}, skip={"z"})
    with pytest.raises(ValueError):
        sets.hub_pairs(spark.range(300).select(F.lit(1).alias("h"), F.col("id").cast("string").alias("m")), "h", "m")


def test_weighted_mean_and_audit(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("a", 4.0, 3), ("a", None, 9), ("b", 1.0, 0)], "g string, v double, w int")
    assert rows(df.groupBy("g").agg(metrics.weighted_mean(F.col("v"), F.col("w")))) == [("a", 3.5), ("b", None)]
    df = spark.createDataFrame([([-100, 5, 6], 2), ([-100, 5, 6], 7), ([5, 6], 2), ([-100], 0)], "l array<int>, n int")
    assert [r[0] for r in df.select(chunks.mask_audit(F.col("l"), F.col("n"))).collect()] == [True, False, False, False]
    assert [r[0] for r in spark.range(3).select(chunks.random_window(F.col("id") + 63, 64, F.lit(9))).collect()] == [None, None, 0]


def test_rounds_and_persona_lines(spark):
    given = [3, 0, 0, 1, 0, 0, 0, 5]
    assert increment.until_stale(lambda i: given[i]) == 7 and increment.until_stale(lambda i: 1, most=4) == 4

    def ask(prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        return "1. mi lukin e sina\r\n- tomo li suli\n\n* waso"

    requests = spark.createDataFrame([("", "ambient", "lines"), ("tomo li suli", "home", "replies"), ("x", "m", "bad")], "ctx string, mood string, prompt string")
    got = rows(increment.persona_lines(requests, ask).where("ctx <> 'x'").select("ctx", "text", "reason"))
    assert got == [("", "mi lukin e sina", ""), ("", "tomo li suli", ""), ("", "waso", "too_short")] + [("tomo li suli", "mi lukin e sina", ""), ("tomo li suli", "tomo li suli", "reply_copies_scene"), ("tomo li suli", "waso", "too_short")]
    assert [r.reason for r in increment.persona_lines(requests.where("ctx = 'x'"), ask).collect()] == ["call_error"]


def test_ledger_and_output_of_a_batch(spark, tmp_path):
    write = streams.append_with_ledger(str(tmp_path / "out"), str(tmp_path / "ledger"), "seed")
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "seed string, text string")
    for _ in range(2):  # a batch run again replaces itself
        write(df, 0)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("seed", "text")) == [("a", "x"), ("a", "y")]
    assert rows(spark.read.parquet(str(tmp_path / "ledger")).select("seed")) == [("a",), ("b",)]


def test_tracked_and_paced_streams(spark, tmp_path):
    class Counting:
        """A tracker that has five rows."""

        def poll(self, after, until=None):
            end = 5 if until is None else until
            return [(i, f"w{i}") for i in range(after, end)], end

    q = streams.tracked(spark, Counting(), "n int, title string").writeStream.format("memory").queryName("tracked_rows").start()
    try:
        q.processAllAvailable()
        assert rows(spark.table("tracked_rows")) == [(i, f"w{i}") for i in range(5)]
    finally:
        q.stop()
    feed = streams.paced_feed(spark, ["tomo", "telo"])
    lines = streams.feed_lines(feed.withColumn("said", F.concat(F.lit("mi "), "scene")), "said", 4.0)
    q = lines.writeStream.format("memory").queryName("paced_rows").start()
    try:
        q.awaitTermination(6)
        said = [r.value for r in spark.table("paced_rows").collect()]
        assert said and all(x.endswith("\t4") for x in said)
    finally:
        q.stop()


def test_wiki_sentences_and_newest_real_run(spark, tmp_path):
    page = "<mediawiki><page><title>A</title><ns>0</ns><revision><text>mi pona. sina {{x}} ike!\nona</text></revision></page></mediawiki>"
    (tmp_path / "w.xml").write_text(page)
    assert rows(readers.wiki_sentences(spark, str(tmp_path / "w.xml"))) == [("A", 0, "mi pona."), ("A", 1, "sina  ike!"), ("A", 2, "ona")]
    df = spark.createDataFrame([("q", "q-1", "final"), ("q", "q-2-smoke", "final"), ("q", "q-0", "final")], "grp string, name string, file string")
    assert rows(readers.newest(df, "grp", ["final"], unwanted="smoke")) == [("q", "q-1", "final")]


def test_spread_and_checked_broadcasts(spark, tmp_path):
    from reedmill.session import small_side, spread, written

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 100
    many = spark.range(0, 100, 1, 4)
    assert spread(many) is many and spread(grouped := many.groupBy("id").count()) is grouped
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    wide = spark.range(50).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert hinted(small_side(wide)) and not hinted(small_side(wide, max_rows=49)) and not hinted(small_side(wide, max_bytes=40_000))
    kept = written(spark.range(10).select("id", (F.col("id") % 2).alias("k")), "k")
    assert rows(kept.where("k = 1").select("id")) == [(1,), (3,), (5,), (7,), (9,)]
