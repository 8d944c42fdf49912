"""Texts of stamps, differences and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_stamp(ts: Column) -> Column:
    """A time stamp as it stands in run names."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def signed(value: Column, digits: int = 3) -> Column:
    """A difference with its sign; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%+.{digits}f", value))


def percent(share: Column, digits: int = 1) -> Column:
    """A share as per cent; null stays null."""
    return F.when(share.isNotNull(), F.format_string(f"%.{digits}f%%", share * 100))


def safe_name(name: Column) -> Column:
    """A model's name fit for a file name."""
    return F.translate(name, ":/", "__")


def scene_line(line: Column) -> Column:
    """struct(scene, reply) of ``SCENE: ... | BIRD: ...``; no scene is the empty string. Null for lines without both marks or without a reply."""
    scene = F.btrim(F.regexp_extract(line, r"(?s)SCENE:([^|]*)", 1))
    reply = F.btrim(F.regexp_extract(line, r"(?s)BIRD:(.*)\z", 1))
    none = F.lower(scene).isin("(none)", "none", "")
    return F.when(line.contains("SCENE:") & line.contains("BIRD:") & (reply != ""), F.struct(F.when(none, "").otherwise(scene).alias("scene"), reply.alias("reply")))


def few_shot_prompt(role: str, request: str, item: Column, closing: str, heading: str = "", examples: list[str] | None = None) -> Column:
    """Blocks parted by blank lines: the role, examples under their heading if there are any, the request with the item below it, what to put out."""
    parts = [F.lit(role)]
    if examples:
        parts.append(F.lit("\n".join([heading, *[f"- {e}" for e in examples]])))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit(request + "\n"), item), F.lit(closing))
