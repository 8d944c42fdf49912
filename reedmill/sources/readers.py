"""Readers of raw corpora and files; every relation gets an explicit order where lines have one."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage

CORPUS_SCHEMA = "source STRING, id STRING, text STRING"
PAIRS_SCHEMA = "en STRING, tp STRING, eng_id STRING, tok_id STRING, source STRING"
CHAT_SCHEMA = "source STRING, id STRING, mode STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>"
LINES_SCHEMA = "ctx STRING, text STRING, mood STRING, source STRING"
WIKI_SCHEMA = "title STRING, ns BIGINT, redirect STRING, revision STRUCT<text: STRUCT<_VALUE: STRING>>"


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line, file, value) of text files: the place among all lines, files by name, and the line number in the file, both from 0.

    Lines are numbered within their block of the file as they are read; blocks are counted, one row each, and added up.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    blocks = lines.groupBy("file", "_b").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = blocks.select("file", "_b", "_first", before(Window.orderBy("file", "_b")).alias("_all"), before(Window.partitionBy("file").orderBy("_b")).alias("_own"))
    joined = lines.join(F.broadcast(place), ["file", "_b"])  # a row a file block
    inside = F.col("_i") - F.col("_first")
    return joined.select((F.col("_all") + inside).alias("ord"), (F.col("_own") + inside).alias("line"), "file", "value")


def language_tsv(spark: SparkSession, path: str, lang: str | None = "tok") -> DataFrame:
    """(id, text) of lines ``id<TAB>lang<TAB>text``, compressed or not. Quotes are literal, further fields are dropped, shorter lines skipped."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 3)
    if lang is not None:
        rows = rows.where(F.col("p")[1] == lang)
    return rows.select(F.col("p")[0].alias("id"), F.col("p")[2].alias("text"))


def link_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(ord, tok_id, eng_id) of lines ``tok_id<TAB>eng_id``; further fields are dropped."""
    rows = ordered_lines(spark, path).select("ord", F.split("value", "\t").alias("p")).where(F.size("p") >= 2)
    return rows.select("ord", F.col("p")[0].alias("tok_id"), F.col("p")[1].alias("eng_id"))


def _relative(root: str) -> Column:
    """Path of a file below its root."""
    base = "file:" + os.path.abspath(root) if os.path.isabs(root) or ":" not in root else root
    plain = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    return F.regexp_replace(plain, "^" + base.rstrip("/") + "/", "")


def text_tree(spark: SparkSession, root: str, pattern: str = "*.txt", skip_unreadable: bool = False) -> DataFrame:
    """(id, text) of whole files below a folder, trimmed, without blank ones; id is the relative path. Undecodable bytes become U+FFFD."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if skip_unreadable:
        reader = reader.option("ignoreCorruptFiles", True)
    return reader.text(root, wholetext=True).select(_relative(root).alias("id"), text.strip(F.col("value")).alias("text")).where("text <> ''")


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """text_tree of Markdown files, markup removed."""
    plain = text_tree(spark, root, "*.md").withColumn("text", text.strip_markdown(F.col("text")))
    return plain.where("text <> ''")


def numbered_lines(spark: SparkSession, path: str, name: str, first_column: bool = False) -> DataFrame:
    """(id, text) of non-blank lines, or of their first column; id is ``name:line``, the line number in its file from 0, skipped lines counted."""
    line = F.split("value", "\t")[0] if first_column else F.col("value")
    rows = ordered_lines(spark, path).select("line", text.strip(line).alias("text")).where("text <> ''")
    return rows.select(F.concat(F.lit(name + ":"), F.col("line").cast("string")).alias("id"), "text")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of the articles of a wiki dump: namespace 0, titled, no redirects, plain text; id is the title."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(WIKI_SCHEMA).load(path)
    body = F.col("revision.text._VALUE")
    kept = pages.where((F.col("ns") == 0) & (F.coalesce("title", F.lit("")) != "") & ~F.upper(F.ltrim(body)).startswith("#REDIRECT"))
    return kept.select(F.col("title").alias("id"), text.strip_wikitext(body).alias("text")).where("text <> ''")


def wiki_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(id, place, text) of the sentences of a wiki dump's articles, compressed or not."""
    return wiki_pages(spark, path).select("id", F.posexplode(text.sentences(F.col("text"))).alias("place", "text"))


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines. strict: a bad line fails the query; else it is skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def jsonl_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text) of JSON lines, trimmed, without bad lines and blanks."""
    return jsonl(spark, path, "text STRING", strict=False).select(text.strip(F.col("text")).alias("text")).where("text <> ''")


def jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or an empty relation if the file isn't there."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return jsonl(spark, path, schema) if fs.exists(found) else spark.createDataFrame([], schema)


def line_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(ord, text) of non-blank lines in order, the first ``limit`` if given."""
    rows = ordered_lines(spark, path).select("ord", text.strip(F.col("value")).alias("text")).where("text <> ''")
    return rows.orderBy("ord").limit(limit) if limit is not None else rows


def split_jsonl(spark: SparkSession, paths: dict[str, str], schema: str = CHAT_SCHEMA) -> DataFrame:
    """JSON lines of several splits with their ``split``."""
    parts = [jsonl(spark, path, schema).withColumn("split", F.lit(name)) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Source:
    """A named corpus and its loader: load(spark) -> (id, text). fetch brings the raw files to ``raw`` (a local or mounted path), where they aren't there yet."""

    name: str
    load: Callable[[SparkSession], DataFrame]
    fetch: Callable[[], None] | None = None
    raw: str = ""


def load_corpus(spark: SparkSession, sources: list[Source], chosen: list[str] | None = None, *, force: bool = False, skip_fetch: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(source, id, text) of the chosen sources and the list of (source, error) of those that failed; unknown names fail too.

    Each source is read into the checkpoint folder by itself, so that one that fails, even by a corrupt file, doesn't stop the others. force fetches again what is there, skip_fetch nothing.
    """
    known, parts, failed = {s.name: s for s in sources}, [], []
    for name in chosen if chosen is not None else list(known):
        try:
            source = known[name]
            if source.fetch and not skip_fetch and (force or not os.path.exists(source.raw)):
                source.fetch()
            parts.append(cut_lineage(source.load(spark).select(F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), "text")))
        except Exception as e:  # noqa: BLE001  (any loader error is reported, not raised)
            failed.append((name, f"{type(e).__name__}: {str(e)[:200]}"))
    out = spark.createDataFrame([], CORPUS_SCHEMA)
    for p in parts:
        out = out.unionByName(p)
    return out, failed


def newest(listing: DataFrame, group: str, wanted: list[str], unwanted: str | None = None) -> DataFrame:
    """(group, name, file) of the newest run of each group that has a wanted file. listing: group, name, file. Names sort by time; of several wanted files the first named is taken. Names that match the pattern ``unwanted``, as of trial runs, are passed over."""
    if unwanted is not None:
        listing = listing.where(~F.col("name").rlike(unwanted))
    rank = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col("file"))
    return listing.where(rank > 0).withColumn("r", -rank).groupBy(group).agg(F.max_by(F.struct("name", "file"), F.struct("name", "r")).alias("m")).select(group, "m.name", "m.file")
