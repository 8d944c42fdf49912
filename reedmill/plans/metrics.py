"""Queries of corpus and generation metrics, prompts and training plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.bind import settled
from ..functions.phonology import is_legal_word
from ..functions.script import WORDS, tidy_label
from ..operators import chunks, gates, inline
from ..operators import metrics as m
from ..session import spread, table
from . import sqltext as q
from .corpus import RATIO, SENTENCES, TIDY
from .registry import query

CUE = "waso li toki e ni:"


@query("""
with c as (select source, list_sort(list(coalesce(length(text), 0))) as v from documents group by source)
select source, len(v) as n, v[cast(least(floor(len(v) * 0.5), len(v) - 1) as int) + 1] as p50, v[cast(least(floor(len(v) * 0.9), len(v) - 1) as int) + 1] as p90,
  v[cast(least(floor(len(v) * 0.99), len(v) - 1) as int) + 1] as p99, v[len(v)] as longest, v[len(v) // 2 + 1] as upper_median from c
""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of the document lengths by source, from the counts of distinct lengths."""
    n = table(spark, d, "documents").groupBy("source", F.coalesce(F.length("text"), F.lit(0)).alias("value")).agg(F.count("*").alias("n"))
    v = n.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("c"), F.sum("n").alias("n"), F.max("value").cast("long").alias("longest"))
    return v.select("source", "n", *[m.rank_from_counts(F.col("c"), p).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.99)], "longest", m.rank_from_counts(F.col("c"), 0.5).alias("upper_median"))


@query("select source, lang, count(*) as docs, cast(sum(coalesce(n_chars, 0)) as bigint) as chars, grouping(source) as all_sources, grouping(lang) as all_langs from documents group by cube (source, lang)")
def mode_source_cube(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "documents").cube("source", "lang")
    return out.agg(
        F.count("*").alias("docs"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"), F.grouping("source").cast("long").alias("all_sources"), F.grouping("lang").cast("long").alias("all_langs")
    )


def _distinct_sql(n: int) -> str:
    g = f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    return f"(case when len(w) < {n} then 1.0 else len(list_distinct({g})) * 1.0 / (len(w) - {n - 1}) end)"


_LINE = f"not regexp_matches(s, '[^A-Za-z.,;:!?''\"\\-\\s\\x{{a0}}]')"
_LOW = f"list_filter({q.words('s')}, lambda w: regexp_matches(w, '^[a-z]'))"
_OK_LINE = f"({_LINE} and len({_LOW}) > 0 and len(list_filter({_LOW}, lambda w: list_contains({q.names(WORDS)}, lower(w)))) * 1.0 / len({_LOW}) >= 0.6)"


@query(f"""
with {SENTENCES}, t as (select source, {q.letter_ratio("text")} <= {RATIO} as kept, regexp_extract_all(lower(text), '[a-z]+') as w from documents where {q.strip("coalesce(text, '')")} <> ''),
d as (select source, count(*) as nonempty, avg(case when kept then 1.0 else 0 end) as doc_keep, avg({_distinct_sql(1)}) as d1, avg({_distinct_sql(2)}) as d2, avg({_distinct_sql(3)}) as d3, avg(len(w)) as words from t group by source),
s as (select source, count(*) as n_sents, avg(case when {_OK_LINE} then 1.0 else 0 end) as sent_keep, avg(case when {q.reason("s")} = '' then 1.0 else 0 end) as strict from sents group by source)
select source, nonempty, round(doc_keep, 6) as doc_keep_rate, round(coalesce(sent_keep, 0), 6) as sent_keep_rate, round(coalesce(strict, 0), 6) as strict_pass_rate,
  round(d1, 6) as distinct_1, round(d2, 6) as distinct_2, round(d3, 6) as distinct_3, round(words, 6) as avg_words, coalesce(n_sents, 0) as n_sents from d left join s using (source)
""")
def generation_health(spark: SparkSession, d: str) -> DataFrame:
    """Keep rates over documents and sentences, and n-gram variety averaged over non-blank texts, by source."""
    docs = spread(table(spark, d, "documents")).where(text.strip(F.coalesce("text", F.lit(""))) != "")
    w = settled(docs.select("source", (gates.letter_ratio(F.col("text")) <= RATIO).cast("double").alias("kept"), text.lower_words(F.col("text")).alias("w")))
    per = w.groupBy("source").agg(
        F.count("*").alias("nonempty"), F.round(F.avg("kept"), 6).alias("doc_keep_rate"),
        *[F.round(F.avg(chunks.distinct_share(F.col("w"), n)), 6).alias(f"distinct_{n}") for n in (1, 2, 3)], F.round(F.avg(F.size("w")), 6).alias("avg_words"),
    )
    s = docs.select("source", F.explode(text.sentences(F.col("text"))).alias("s"))
    sents = s.groupBy("source").agg(
        F.count("*").alias("n_sents"), F.round(F.avg(gates.looks_like_language(F.col("s"), WORDS).cast("double")), 6).alias("sent_keep_rate"),
        F.round(F.avg((gates.sentence_reason(F.col("s")) == "").cast("double")), 6).alias("strict_pass_rate"),
    )
    out = per.join(sents, "source", "left").fillna(0, ["n_sents"]).fillna(0.0, ["sent_keep_rate", "strict_pass_rate"])
    return out.select("source", "nonempty", "doc_keep_rate", "sent_keep_rate", "strict_pass_rate", "distinct_1", "distinct_2", "distinct_3", "avg_words", "n_sents")


_CORE = WORDS


@query(f"""
with t as (select doc_id, source, regexp_extract_all(text, '[A-Za-z]+') as w from documents where {q.strip("coalesce(text, '')")} <> ''),
l as (select doc_id, source, w, list_filter(w, lambda x: regexp_matches(x, '^[a-z]')) as low from t),
g as (select source, avg(len(list_distinct(list_filter(low, lambda x: list_contains({q.names(_CORE)}, lower(x))))) * 1.0 / {len(_CORE)}) as per_text,
        sum(len(list_filter(low, lambda x: not list_contains({q.names(_CORE)}, lower(x))))) * 1.0 / greatest(sum(len(low)), 1) as oov from l group by source),
f as (select distinct source, lower(x) as f, regexp_matches(x, '^[a-z]') as is_low from (select source, unnest(w) as x from l)),
p as (select source, count(distinct f) as forms, count(distinct f) filter (is_low and list_contains({q.names(_CORE)}, f)) * 1.0 / {len(_CORE)} as pooled from f group by source)
select g.source, round(coalesce(pooled, 0), 6) as pooled_coverage, round(per_text, 6) as text_coverage, round(oov, 6) as oov_rate, coalesce(forms, 0) as distinct_forms from g left join p using (source)
""")
def vocab_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of the core vocabulary used, pooled and by text; unknown words; word forms. Names count as forms only."""
    w = spread(table(spark, d, "documents")).where(text.strip(F.coalesce("text", F.lit(""))) != "").select("source", text.ascii_words(F.col("text")).alias("w"))
    low = w.select("source", "w", F.filter("w", lambda x: x.rlike("^[a-z]")).alias("low"))
    core = lambda x: F.lower(x).isin(_CORE)
    per = low.groupBy("source").agg(
        F.round(F.avg(F.size(F.array_distinct(F.filter("low", core))) / len(_CORE)), 6).alias("text_coverage"),
        F.round(F.sum(F.size(F.filter("low", lambda x: ~core(x)))) / F.greatest(F.sum(F.size("low")), F.lit(1)), 6).alias("oov_rate"),
    )
    forms = w.select("source", F.explode("w").alias("x")).groupBy("source", F.lower("x").alias("f")).agg(F.max(F.col("x").rlike("^[a-z]")).alias("is_low"))
    pooled = forms.groupBy("source").agg(F.count("*").alias("distinct_forms"), F.round(F.count_if(F.col("is_low") & F.col("f").isin(_CORE)) / len(_CORE), 6).alias("pooled_coverage"))
    return per.join(pooled, "source", "left").fillna(0, ["distinct_forms"]).fillna(0.0, ["pooled_coverage"]).select("source", "pooled_coverage", "text_coverage", "oov_rate", "distinct_forms")


@query(f"""
with w as (select source, regexp_extract_all(lower(text), '[a-z]+') as w from synthetic where text is not null), f as (select {TIDY.format("source")} as source, {q.most("w")} * 1.0 / len(w) as f from w where len(w) >= 3)
select source, count(*) as n_scored, round(avg(case when f > 0.4 then 1.0 else 0 end), 6) as loop_rate, round(avg(f), 6) as mean_top_share from f group by source
""")
def loop_rate(spark: SparkSession, d: str) -> DataFrame:
    """Texts of three words or more in which one word makes up over two fifths."""
    w = spread(table(spark, d, "synthetic")).where("text IS NOT NULL").select(tidy_label(F.col("source")).alias("source"), text.lower_words(F.col("text")).alias("w")).where(F.size("w") >= 3)
    f = w.select("source", (gates.most_common(F.col("w")) / F.size("w")).alias("f"))
    return f.groupBy("source").agg(F.count("*").alias("n_scored"), F.round(F.avg((F.col("f") > 0.4).cast("double")), 6).alias("loop_rate"), F.round(F.avg("f"), 6).alias("mean_top_share"))


@query(f"""
with t as (select syn_id, regexp_extract_all(lower(text), '[a-z]+') as w from synthetic where text is not null)
select syn_id, round({_distinct_sql(1)}, 6) as distinct_1, round({_distinct_sql(2)}, 6) as distinct_2, round({_distinct_sql(3)}, 6) as distinct_3 from t
""")
def distinct_n(spark: SparkSession, d: str) -> DataFrame:
    w = spread(table(spark, d, "synthetic")).where("text IS NOT NULL").select("syn_id", text.lower_words(F.col("text")).alias("w"))
    return w.select("syn_id", *[F.round(chunks.distinct_share(F.col("w"), n), 6).alias(f"distinct_{n}") for n in (1, 2, 3)])


@query(f"""
with t as (select syn_id, regexp_extract_all(lower(text), '[a-z]+') as w from synthetic where text is not null)
select syn_id, len(w) as n_words, {q.most("w")} as top_word, {q.most(q.pairs("w"))} as top_pair from t
""")
def repetition_stats(spark: SparkSession, d: str) -> DataFrame:
    w = spread(table(spark, d, "synthetic")).where("text IS NOT NULL").select("syn_id", text.lower_words(F.col("text")).alias("w"))
    return w.select("syn_id", F.size("w").cast("long").alias("n_words"), gates.most_common(F.col("w")).cast("long").alias("top_word"), gates.most_common(gates.bigrams(F.col("w"))).cast("long").alias("top_pair"))


_CHRF = """
with p as (select pair_id, en, coalesce(tp, '') as h, r from (
  select a.pair_id, a.en, a.tp, b.r from translation_pairs a join (select eng_id, arg_min(tp, pair_id) as r from translation_pairs where tp is not null group by eng_id) b using (eng_id)
  where a.split = 'val' and a.tp is not null)),
g as (select pair_id, n, 'h' as side, h[i:i + n - 1] as x from p, range(1, 7) t(n), unnest(range(1, length(h) + 1)) u(i) where i <= length(h) - n + 1
      union all select pair_id, n, 'r', r[i:i + n - 1] from p, range(1, 7) t(n), unnest(range(1, length(r) + 1)) u(i) where i <= length(r) - n + 1),
c as (select pair_id, n, x, count(*) filter (side = 'h') as ch, count(*) filter (side = 'r') as cr from g group by all),
o as (select pair_id, n, sum(least(ch, cr)) * 1.0 / nullif(sum(ch), 0) as pr, sum(least(ch, cr)) * 1.0 / nullif(sum(cr), 0) as rc from c group by all having sum(ch) > 0 and sum(cr) > 0),
a as (select pair_id, avg(pr) as pr, avg(rc) as rc from o group by pair_id),
s as (select p.*, case when h = '' or r = '' or a.pair_id is null or pr + rc = 0 then 0.0 else 100.0 * 5 * pr * rc / (4 * pr + rc) end as score from p left join a using (pair_id))
"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rows against the first rendering of the same sentence."""
    rows = table(spark, d, "translation_pairs").where("tp IS NOT NULL")
    ref = rows.groupBy("eng_id").agg(F.min_by("tp", "pair_id").alias("r"))
    held = rows.where("split = 'val'").select("pair_id", "eng_id", "en", F.col("tp").alias("h")).join(ref, "eng_id")
    return held.withColumn("score", m.chrf(F.col("h"), F.col("r")))


@query(_CHRF + "select pair_id, round(score, 4) as chrf from s")
def chrf_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("pair_id", F.round("score", 4).alias("chrf"))


@query(
    _CHRF
    + f"""select count(*) as n, round(avg(score), 4) as chrf, round(avg(case when h <> '' and {q.reason("h")} = '' then 1.0 else 0 end), 6) as valid,
  round(avg(case when h <> '' and len(list_filter({q.words("h")}, lambda w: not {q.legal("w")})) = 0 then 1.0 else 0 end), 6) as legal,
  round(avg(case when h <> '' and trim(lower(h), '.!? ') = trim(lower(en), '.!? ') then 1.0 else 0 end), 6) as copied, round(avg(case when h = '' then 1.0 else 0 end), 6) as empty from s"""
)
def translator_gate(spark: SparkSession, d: str) -> DataFrame:
    """Mean score and rates of valid, legal, copied and empty renderings over all held-out rows."""
    s = _scored(spark, d)
    has, rate = F.col("h") != "", lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6).alias(name)
    return s.agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("chrf"), rate(has & (gates.sentence_reason(F.col("h")) == ""), "valid"),
        rate(has & ~F.exists(text.ascii_words(F.col("h")), lambda w: ~is_legal_word(w)), "legal"), rate(has & (text.copy_key(F.col("h")) == text.copy_key(F.col("en"))), "copied"), rate(~has, "empty"),
    )


@query(f"""
with t as (select source, coalesce(ctx, '') = '' as ambient from (select split_part({TIDY.format("source")}, '/', 1) as source, ctx from bird))
select source, count(*) as n, count(*) filter (ambient) as n_ambient, round(count(*) filter (ambient) * 1.0 / count(*), 6) as ambient_share from t group by source
""")
def bird_mix_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines and ambient share by the first part of the source label."""
    rows = table(spark, d, "bird").select(F.substring_index(tidy_label(F.col("source")), "/", 1).alias("source"), (F.coalesce("ctx", F.lit("")) == "").alias("ambient"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("ambient").alias("n_ambient"), F.round(F.count_if("ambient") / F.count("*"), 6).alias("ambient_share"))


@query("""
with t as (select ex_id, source, list_sum(list_transform(messages, lambda m: len(list_filter(string_split_regex(m.content, '\\s+'), lambda w: w <> '')))) as n from sft_train)
select ex_id, cast(n as bigint) as n_tokens from t where n <= 40
""")
def token_budget_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chat examples of at most 40 blank-separated tokens."""
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    n = F.aggregate("messages", F.lit(0).cast("long"), lambda s, x: s + count(x["content"]))
    return table(spark, d, "sft_train").select("ex_id", n.alias("n_tokens")).where("n_tokens <= 40")


@query("""
select ex_id, sha256('<bos>' || array_to_string(list_transform(messages, lambda m: '<|turn>' || case when m.role in ('assistant', 'model') then 'model' else m.role end || chr(10) || m.content || '<turn|>' || chr(10)), '')) as h
from sft_train
""")
def chat_render(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft_train").select("ex_id", F.sha2(text.chat_turns(F.col("messages")), 256).alias("h"))


@query("""
select pair_id, sha256('o ante e toki ni tawa toki pona: ' || en || chr(10) || 'ni: ') as h from translation_pairs where en is not null
""")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.format_string("o ante e toki ni tawa toki pona: %s\nni: ", F.col("en"))
    return table(spark, d, "translation_pairs").where("en IS NOT NULL").select("pair_id", F.sha2(prompt, 256).alias("h"))


@query(f"""
with b as (select bird_id, rtrim({q.strip("coalesce(ctx, '')")}, '.') as c, {q.strip("text")} as t from bird where text is not null)
select bird_id, sha256(case when c = '' then '{CUE}' else c || '. {CUE}' end || ' ' || t) as h from b
""")
def frame_example(spark: SparkSession, d: str) -> DataFrame:
    """Training strings: scene, cue and reply."""
    return table(spark, d, "bird").where("text IS NOT NULL").select("bird_id", F.sha2(text.framed_example(F.col("ctx"), F.col("text"), CUE), 256).alias("h"))


_TOKENS = "list_transform(string_split(coalesce({}, ''), ' '), lambda w: length(w))"


@query(f"""
with t as (select bird_id, {_TOKENS.format("ctx")} as p, {_TOKENS.format("text")} as w from bird)
select bird_id, array_to_string(list_transform(range(1, least(len(p), len(w)) + 1), lambda i: -100) || w[least(len(p), len(w)) + 1:], ' ') as labels from t
""")
def mask_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the prompt's places masked; tokens are word lengths."""
    ids = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), " "), lambda w: F.length(w))
    return table(spark, d, "bird").select("bird_id", F.array_join(F.transform(chunks.masked_labels(ids(F.col("ctx")), ids(F.col("text"))), lambda x: x.cast("string")), " ").alias("labels"))


@query(f"""
with t as (select ord, {_TOKENS.format("text")} as w from corpus_filtered) select ord, len(w[1:64]) + 2 as n, sha256(array_to_string([2] || w[1:64] || [3], ' ')) as h from t
""")
def frame_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token sequences capped at 64 (the feature's cap) between begin and end marks."""
    ids = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w))
    framed = chunks.framed_tokens(ids, 64, 2, 3)
    return table(spark, d, "corpus_filtered").select("ord", F.size(framed).cast("long").alias("n"), F.sha2(F.array_join(F.transform(framed, lambda x: x.cast("string")), " "), 256).alias("h"))


@query("""
with n as (select ord, length(text) as n from corpus_filtered where text is not null),
w as (select ord, n, i, least(i * 32 + 64, n - 1) as e from n, unnest(range(0, case when n < 2 then 0 else greatest(cast(ceil((n - 1 - 64) / 32.0) as int), 0) + 1 end)) t(i))
select ord, i * 32 as begin, e as "end", e - case when i > 0 then least((i - 1) * 32 + 64, n - 1) else 0 end as scored from w
""")
def stride_window_plan(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 64 at stride 32 over each text, and how many targets each scores first."""
    rows = table(spark, d, "corpus_filtered").where("text IS NOT NULL").select("ord", F.explode(chunks.stride_windows(F.length("text"), 64)).alias("w"))
    return rows.select("ord", F.col("w.begin").cast("long").alias("begin"), F.col("w.end").cast("long").alias("end"), F.col("w.scored").cast("long").alias("scored"))


@query("""
select step, round(case when step < 100 then 0.001 * (step + 1) / 100 when step >= 1000 then 0.0001 else 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * (step - 100) / 900.0)) end, 10) as lr from range(0, 1201) t(step)
""")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1201).select(F.col("id").alias("step"), F.round(chunks.warmup_cosine(F.col("id"), 0.001, 100, 1000), 10).alias("lr"))


@query("""
select cast(temp as double) as temp, seed, sample from (values (0.0), (0.7), (0.9)) t(temp), (select distinct seed from synthetic where seed is not null) s, range(0, 2) u(sample)
""")
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every seed at three temperatures, two samples each; the grid is exploded in the row."""
    seeds = table(spark, d, "synthetic").where("seed IS NOT NULL").select("seed").distinct()
    return inline.grid(seeds, temp=[0.0, 0.7, 0.9], sample=[0, 1]).select("temp", "seed", F.col("sample").cast("long").alias("sample"))
