"""The incremental step with a model in the loop: what isn't done yet, calls, gates, dedup, append."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_line, copy_key, strip
from .gates import bubble_reason, response_reason
from .sets import first_seen, without_known


def pending(seeds: DataFrame, ledger: DataFrame | None, output: DataFrame | None, key: str) -> DataFrame:
    """Seeds not in the ledger; without a ledger, those not in the output."""
    done = ledger if ledger is not None else output
    return seeds if done is None else without_known(seeds, done, [key])


def generated(seeds: DataFrame, key: str, generate: Callable[[str], str], partitions: int | None = None) -> DataFrame:
    """(key, reply, error) of an injected call for each seed; a failing call gives its error and no reply. Partitions bound the concurrency."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s in b[key]:
                try:
                    rows.append((s, generate(s), None))
                except Exception as e:  # noqa: BLE001  (errors are rows)
                    rows.append((s, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "reply", "error"])

    df = seeds.select(key)
    return (df.repartition(partitions) if partitions else df).mapInPandas(run, f"`{key}` string, reply string, error string")


def judged(replies: DataFrame, key: str) -> DataFrame:
    """(key, text, reason) of each reply line: call errors, copies of the seed, gate reasons, '' for a pass."""
    lines = replies.select(key, "error", F.explode_outer(F.split("reply", "\n")).alias("line"))
    cleaned = lines.select(key, "error", strip(clean_line(F.col("line"))).alias("text")).where("error IS NOT NULL OR text <> ''")
    reason = F.when(F.col("error").isNotNull(), "call_error").when(copy_key(F.col("text")) == copy_key(F.col(key)), "copied_source").otherwise(response_reason(F.col("text")))
    return cleaned.select(key, "text", reason.alias("reason"))


def increment(seeds: DataFrame, key: str, generate: Callable[[str], str], ledger: DataFrame | None = None, output: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new output rows, ledger rows, reason counts). Every seed tried without error enters the ledger, also one that yields nothing; new texts are unknown to the output, first of their kind."""
    todo = pending(seeds, ledger, output, key)
    replies = generated(todo, key, generate)
    verdicts = judged(replies, key)
    good = verdicts.where("reason = ''").select(key, "text", strip(F.lower("text")).alias("k"))
    if output is not None:
        good = without_known(good, output.select(strip(F.lower("text")).alias("k")), ["k"])
    fresh = first_seen(good, [F.col("k")], [F.col(key), F.col("text")]).drop("k")
    done = replies.where("error IS NULL").select(key).distinct()
    return fresh, done, verdicts.groupBy("reason").agg(F.count("*").alias("n"))


def persona_lines(requests: DataFrame, ask: Callable[[str], str], partitions: int | None = None) -> DataFrame:
    """(ctx, mood, text, reason) of each line that an injected model gives for requests (ctx, mood, prompt); ctx is empty for ambient batches.

    Lines lose bullets and numbers, blank ones are dropped; a failing call gives one row with reason ``call_error``.
    """
    keyed = requests.select(F.to_json(F.struct("ctx", "mood", "prompt"), {"ignoreNullFields": "false"}).alias("request"))
    replies = generated(keyed, "request", lambda r: ask(json.loads(r)["prompt"]), partitions)
    lines = replies.select(F.from_json("request", "ctx STRING, mood STRING").alias("r"), "error", F.explode_outer(F.split("reply", "\\R")).alias("line"))
    said = lines.select("r.ctx", "r.mood", "error", strip(clean_line(F.col("line"))).alias("text")).where("error IS NOT NULL OR text <> ''")
    copied = (F.coalesce("ctx", F.lit("")) != "") & (strip(F.lower("text")) == strip(F.lower("ctx")))
    reason = F.when(F.col("error").isNotNull(), "call_error").when(copied, "reply_copies_scene").otherwise(bubble_reason(F.col("text")))
    return said.select("ctx", "mood", "text", reason.alias("reason"))


def until_stale(step: Callable[[int], int], patience: int = 3, most: int | None = None) -> int:
    """Runs step(round) -> number of new rows until ``patience`` rounds in a row give none (or after ``most`` rounds); the number of rounds run."""
    done = stale = 0
    while stale < patience and (most is None or done < most):
        stale = 0 if step(done) > 0 else stale + 1
        done += 1
    return done
