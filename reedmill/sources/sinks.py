"""Writers: JSON lines, text lines, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, characters unescaped, null fields as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One line a row; the column's text as it is."""
    df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").write.mode(mode).text(path)


def summary(df: DataFrame, name: str = "summary") -> DataFrame:
    """One JSON string a row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def markdown_rows(df: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
