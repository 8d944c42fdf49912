"""Queries of set operations, rates, losses, formats, prompts and feed schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, text
from ..operators import chunks, feeds, sets
from ..operators import metrics as m
from ..session import table
from .registry import query


def _seeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "synthetic")
    return rows.where("mode = 'paraphrase'").select("seed"), rows.where("mode <> 'paraphrase'").select("seed")


@query("select seed from synthetic where mode = 'paraphrase' intersect select seed from synthetic where mode <> 'paraphrase'")
def seed_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Seeds used by the paraphrase step and by another, null among them."""
    return sets.in_both(*_seeds(spark, d))


@query("select seed from synthetic where mode <> 'paraphrase' except select seed from synthetic where mode = 'paraphrase'")
def seed_except(spark: SparkSession, d: str) -> DataFrame:
    """Seeds used by other steps only."""
    paraphrased, others = _seeds(spark, d)
    return sets.only_first(others, paraphrased)


@query("select 'replies' as part, reply_en as text from bird_english where reply_en is not null union all select 'sentences', en from translation_pairs where en is not null")
def conditional_union(spark: SparkSession, d: str) -> DataFrame:
    """English texts of two passes; the third is skipped and never read."""
    pass_of = lambda name, c: table(spark, d, name).where(F.col(c).isNotNull()).select(F.col(c).alias("text"))
    parts = {"replies": pass_of("bird_english", "reply_en"), "sentences": pass_of("translation_pairs", "en"), "documents": pass_of("documents", "text")}
    return sets.chosen_union(parts, skip={"documents"})


@query("""
select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as mean_loss, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 6) as ppl from lineitem group by l_returnflag
""")
def token_weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a loss weighted by tokens, and its perplexity: discounts stand for losses, quantities for tokens."""
    mean = m.weighted_mean(F.col("l_discount"), F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(mean, 6).alias("mean_loss"), F.round(m.perplexity(mean), 6).alias("ppl"))


@query("""
with n as (select ord, length(text) as n from corpus_filtered where text is not null),
w as (select ord, n, i, least(i * 32 + 64, n - 1) as e from n, unnest(range(0, case when n < 2 then 0 else greatest(cast(ceil((n - 1 - 64) / 32.0) as int), 0) + 1 end)) t(i)),
s as (select ord, ((ord + i) % 17 + 1) / 4.0 as loss, e - case when i > 0 then least((i - 1) * 32 + 64, n - 1) else 0 end as scored from w)
select ord, cast(sum(scored) as bigint) as targets, round(sum(loss * scored) / sum(scored), 6) as nll, round(exp(sum(loss * scored) / sum(scored)), 4) as ppl from s group by ord
""")
def stride_nll(spark: SparkSession, d: str) -> DataFrame:
    """Loss a target and perplexity of each text from its strided windows, every target counted once; the windows' losses are made of their numbers."""
    rows = table(spark, d, "corpus_filtered").where("text IS NOT NULL").select("ord", F.posexplode(chunks.stride_windows(F.length("text"), 64)).alias("i", "w"))
    scored = rows.select("ord", (((F.col("ord") + F.col("i")) % 17 + 1) / 4.0).alias("loss"), F.col("w.scored").cast("long").alias("scored"))
    nll = m.weighted_mean(F.col("loss"), F.col("scored"))
    return scored.groupBy("ord").agg(F.sum("scored").alias("targets"), F.round(nll, 6).alias("nll"), F.round(m.perplexity(nll), 4).alias("ppl"))


@query("""
with r as (select event_type as model, user_id % 4 as concurrency, sum(value) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) as rate from events group by all having max(ts) > min(ts))
select model, arg_max(concurrency, rate) as concurrency, round(max(rate), 6) as tok_per_s, round(1e8 / max(rate) / 86400, 2) as days_100m, round(1e9 / max(rate) / 86400, 2) as days_1b from r where rate > 0 group by model
""")
def throughput_rates(spark: SparkSession, d: str) -> DataFrame:
    """Best rate of each model over its concurrencies, and the days to a hundred million and a billion tokens. Event values stand for tokens."""
    wall = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000.0
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    runs = e.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 4).alias("concurrency")).agg(F.sum("value").alias("tokens"), wall.alias("wall")).where("wall > 0")
    rates = runs.withColumn("rate", F.col("tokens") / F.col("wall")).where("rate > 0")
    best = rates.groupBy("model").agg(F.max_by("concurrency", "rate").alias("concurrency"), F.max("rate").alias("rate"))
    days = lambda n: F.round(n / F.col("rate") / 86400, 2)
    return best.select("model", "concurrency", F.round("rate", 6).alias("tok_per_s"), days(1e8).alias("days_100m"), days(1e9).alias("days_1b"))


@query("""
with s as (select mode, count(*) as n, round(avg(case when text is not null and trim(text) <> '' then 1.0 else 0.0 end), 6) as keep_rate from synthetic group by mode)
select mode, n, keep_rate, row_number() over (order by keep_rate desc, mode) as place from s
""")
def capability_rank(spark: SparkSession, d: str) -> DataFrame:
    """Modes in order of their keep rate, best first; a mode a row, so the ranking is of a handful."""
    from pyspark.sql import Window

    kept = (F.col("text").isNotNull() & (F.trim("text") != "")).cast("double")
    per = table(spark, d, "synthetic").groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg(kept), 6).alias("keep_rate"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("keep_rate"), "mode")).cast("long")).orderBy("place")


@query("""
select event_id, strftime(ts, '%Y%m%d-%H%M%S') as stamp, printf('%+.3f', round(value, 2) - 50) as delta, printf('%.1f%%', (event_id % 1001) / 10.0) as share,
  replace(replace(event_type || ':' || user_id || '/x', ':', '_'), '/', '_') as safe from events
""")
def format_functions(spark: SparkSession, d: str) -> DataFrame:
    """Run stamps, signed differences, per cents and safe names."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    name = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"), F.lit("/x"))
    return e.select(
        "event_id", formats.run_stamp(F.col("ts")).alias("stamp"), formats.signed(F.round("value", 2) - 50).alias("delta"),
        formats.percent((F.col("event_id") % 1001) / 1000.0).alias("share"), formats.safe_name(name).alias("safe"),
    )


_SCENE_LINE = "case when be_id % 11 = 0 then 'BIRD ' || coalesce(reply_en, '') else '- SCENE: ' || coalesce(nullif(scene_en, ''), '(None)') || ' | BIRD: ' || coalesce(reply_en, '') end"


@query(f"""
with l as (select be_id, {_SCENE_LINE} as line from bird_english),
p as (select be_id, trim(split_part(split_part(line, 'SCENE:', 2), '|', 1)) as scene, trim(substr(line, instr(line, 'BIRD:') + 5)) as reply from l where contains(line, 'SCENE:') and contains(line, 'BIRD:'))
select be_id, case when lower(scene) in ('(none)', 'none', '') then '' else scene end as scene, reply from p where reply <> ''
""")
def scene_line_parse(spark: SparkSession, d: str) -> DataFrame:
    """Scenes and replies of model lines made of the table; lines without a mark or a reply are skipped."""
    rows = table(spark, d, "bird_english").select("be_id", formats.scene_line(F.expr(_SCENE_LINE)).alias("p")).where("p IS NOT NULL")
    return rows.select("be_id", "p.scene", "p.reply")


_ROLE, _ASK = "You write short sentences. Put out nothing but the sentences.", "Say the following in other words:"


@query(f"""
select pair_id, sha256('{_ROLE}' || chr(10) || chr(10) || 'Examples:' || chr(10) || '- mi pona' || chr(10) || '- sina pona' || chr(10) || chr(10) || '{_ASK}' || chr(10) || en || chr(10) || chr(10) || 'One sentence.') as few_shot,
  sha256('{_ROLE}' || chr(10) || chr(10) || '{_ASK}' || chr(10) || en || chr(10) || chr(10) || 'One sentence.') as bare from translation_pairs where en is not null
""")
def few_shot_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with and without examples."""
    prompt = lambda examples: F.sha2(formats.few_shot_prompt(_ROLE, _ASK, F.col("en"), "One sentence.", "Examples:", examples), 256)
    return table(spark, d, "translation_pairs").where("en IS NOT NULL").select("pair_id", prompt(["mi pona", "sina pona"]).alias("few_shot"), prompt(None).alias("bare"))


@query("""
with t as (select bird_id, len(string_split(coalesce(ctx, ''), ' ')) as p, len(string_split(coalesce(text, ''), ' ')) as n, len(string_split(trim(coalesce(text, '')), ' ')) as r from bird),
l as (select bird_id, n, n - least(p, n) as learnt, r from t)
select bird_id, abs(learnt - r) <= 2 and learnt > 0 and learnt < n as ok from l
""")
def mask_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether as many places are learnt as the trimmed line has tokens, give or take two; tokens are blank-separated words."""
    ids = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w))
    ctx, line = F.coalesce("ctx", F.lit("")), F.coalesce("text", F.lit(""))
    return table(spark, d, "bird").select("bird_id", chunks.mask_audit(chunks.masked_labels(ids(ctx), ids(line)), F.size(ids(F.trim(line)))).alias("ok"))


_MOD = "list_reduce(list_prepend(0, list_transform(string_split(sha256({}), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, x: (a * 16 + x) % {})"


@query(f"""
with n as (select ord, length(text) as n from corpus_filtered where length(text) > 64), b as (select ord, n, batch from n, range(0, 3) t(batch))
select ord, batch, {_MOD.format("cast(ord as varchar) || '/' || batch", 1000003)} % (n - 64) as begin, case when {_MOD.format("'coin/' || ord || '/' || batch", 1000)} < 300 then 'rows' else 'stream' end as kind from b
""")
def window_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three drawn windows of 64 targets of each text, and a coin of 0.3 for the stream that each batch is taken from."""
    n = table(spark, d, "corpus_filtered").select("ord", F.length("text").alias("n")).where("n > 64")
    rows = n.select("ord", "n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("batch"))
    key = F.concat(F.col("ord").cast("string"), F.lit("/"), F.col("batch").cast("string"))
    coin = text.text_hash(F.concat(F.lit("coin/"), key), 1000)
    begin = chunks.random_window(F.col("n"), 64, text.text_hash(key, 1_000_003))
    return rows.select("ord", F.col("batch").cast("long").alias("batch"), begin.cast("long").alias("begin"), F.when(coin < 300, "rows").otherwise("stream").alias("kind"))


@query(f"""
select event_id as tick, case when event_id % 2 = 0 then '' else ['waso', 'tomo', 'telo'][{_MOD.format("cast(event_id as varchar)", 1009)} % 3 + 1] end as scene from events
""")
def paced_scenes(spark: SparkSession, d: str) -> DataFrame:
    """What a paced feed asks for at each tick: nothing and a drawn scene by turns."""
    tick = F.col("event_id")
    return table(spark, d, "events").select(tick.alias("tick"), feeds.paced_scene(tick, text.text_hash(tick.cast("string"), 1009), ["waso", "tomo", "telo"]).alias("scene"))
