import bz2
import json

from pyspark.sql import functions as F

from reedmill.sources import readers, sinks
from reedmill.streaming import feeds


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('1\ttok\tmi "pona"\n2\ttok\n3\teng\thi\n4\ttok\tx\ty\n')
    (tmp_path / "b.tsv.bz2").write_bytes(bz2.compress(b"7\teng\thello\n"))
    assert rows(readers.language_tsv(spark, str(tmp_path / "a.tsv"))) == [("1", 'mi "pona"'), ("4", "x")]
    assert rows(readers.language_tsv(spark, str(tmp_path / "b.tsv.bz2"), "eng")) == [("7", "hello")]
    (tmp_path / "links").write_text("1\t2\n3\n4\t5\t6\n")
    assert rows(readers.link_tsv(spark, str(tmp_path / "links"))) == [(0, "1", "2"), (2, "4", "5")]
    (tmp_path / "l.txt").write_text("a\tb\n\n c\n")
    assert rows(readers.numbered_lines(spark, str(tmp_path / "l.txt"), "l", True)) == [("l:0", "a"), ("l:2", "c")]
    assert rows(readers.line_list(spark, str(tmp_path / "l.txt"), 1)) == [(0, "a\tb")]
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/x.md").write_text("# T\n*a*\n")
    (tmp_path / "tree/sub/y.md").write_text("  \n")
    (tmp_path / "tree/sub/z.txt").write_text(" z \n")
    assert rows(readers.markdown_tree(spark, str(tmp_path / "tree"))) == [("x.md", "T\na")]
    assert rows(readers.text_tree(spark, str(tmp_path / "tree"))) == [("sub/z.txt", "z")]


def test_wiki_reader(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><revision><text bytes='1'>{}</text></revision></page>"
    pages = [page.format("A", 0, "'''mi''' {{x}} pona"), page.format("B", 1, "no"), page.format("C", 0, " #redirect [[A]]")]
    (tmp_path / "w.xml.bz2").write_bytes(bz2.compress(("<mediawiki xmlns='http://x'>" + "".join(pages) + "</mediawiki>").encode()))
    assert rows(readers.wiki_pages(spark, str(tmp_path / "w.xml.bz2"))) == [("A", "mi  pona")]


def test_json_readers_and_sinks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": " a "}\nbad\n{"text": ""}\n{"other": 1}\n')
    assert rows(readers.jsonl_texts(spark, str(tmp_path / "x.jsonl"))) == [("a",)]
    assert readers.jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), readers.LINES_SCHEMA).count() == 0
    df = spark.createDataFrame([("ĉu 󱤀", 1)], "t string, n int")
    sinks.write_jsonl(df, str(tmp_path / "out"))
    assert rows(readers.jsonl(spark, str(tmp_path / "out"), "t string, n int")) == [("ĉu 󱤀", 1)]
    assert json.loads(sinks.summary(df).first()[0]) == {"t": "ĉu 󱤀", "n": 1} and sinks.markdown_rows(df).first()[0] == "| ĉu 󱤀 | 1 |"
    sinks.write_lines(df, "t", str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == "ĉu 󱤀"


def test_registry_goes_on_after_a_failure(spark):
    good = readers.Source("good", lambda s: s.createDataFrame([("1", "a")], "id string, text string"))
    bad = readers.Source("bad", lambda s: 1 / 0)
    df, failed = readers.load_corpus(spark, [good, bad])
    assert rows(df) == [("good", "1", "a")] and [n for n, _ in failed] == ["bad"]


def test_newest(spark):
    df = spark.createDataFrame([("q", "q-1", "final"), ("q", "q-2", "last"), ("q", "q-2", "best"), ("s", "s-9", "junk")], "grp string, name string, file string")
    assert rows(readers.newest(df, "grp", ["best", "final", "last"])) == [("q", "q-2", "best")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1").write_text("hi\t2\n\nyo\n")
    seen = []
    q = feeds.run_batches(feeds.bubble_stream(feeds.line_stream(spark, str(src))), str(tmp_path / "c1"), lambda b, n: seen.extend(rows(b)))
    q.awaitTermination()
    assert sorted(seen) == [("hi", 2.0), ("yo", 4.0)]


def test_append_once_resumes(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    stream = lambda: feeds.line_stream(spark, str(src))
    for n, lines in enumerate(["a\nb\na\n", "b\nc\n"]):
        (src / f"f{n}").write_text(lines)
        feeds.run_batches(stream(), str(tmp_path / "c"), feeds.append_once(out, ["value"])).awaitTermination()
    assert rows(spark.read.parquet(out)) == [("a",), ("b",), ("c",)]


def test_latest_state(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:05', 'new'), ('a', timestamp'2024-01-01 00:00:01', 'old'), ('b', timestamp'2024-01-01', 'x'), (null, timestamp'2024-01-01', 'y') as t(k, ts, v)").write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp, v string").parquet(src)
    q = feeds.latest_state(stream, "k", "ts", "v").writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {("a", "new"), ("b", "x")} <= {(r.key, r.value) for r in spark.table("latest").collect()}


def test_windowed_counts_and_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).select((F.col("id") % 10).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts")).write.parquet(src)
    stream = lambda: spark.readStream.schema("k long, ts timestamp").parquet(src)
    for name, df, mode in (("w", feeds.windowed_counts(stream(), "ts", "k", "1 hour", "10 minutes"), "complete"), ("f", feeds.fresh_only(stream(), "k", "ts", "1 day"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 100 and spark.table("f").count() == 10
