"""Queries of joins, dedup, splits, mixes and the incremental step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.script import tidy_label
from ..operators import gates, sets
from ..session import table
from . import sqltext as q
from .corpus import TIDY
from .registry import query

SEED = 42

_LINKS = """
links as (select pair_id as ord, tok_id, eng_id from translation_pairs where tok_id is not null),
tok as (select id as tok_id, arg_max(text, ord) as tp from corpus_filtered where regexp_replace(lower(trim(source, ' \t\r\n')), '[\\s_]+', '-', 'g') = 'tatoeba' group by id),
eng as (select eng_id, arg_min(en, pair_id) as en from translation_pairs where split = 'train' group by eng_id)
"""


def _status_sql(select: str) -> str:
    return f"""
with {_LINKS},
g as (
  select l.ord, l.tok_id, l.eng_id, tok.tp, eng.en,
    case when tok.tok_id is null then 'tok_missing' when eng.eng_id is null then 'eng_missing' else 'tp_' || {q.reason("coalesce(tp, '')")} end as why
  from links l left join tok using (tok_id) left join eng on eng.eng_id = l.eng_id
), s as (
  select *, case when why <> 'tp_' then why when ord > min(case when why = 'tp_' then ord end) over (partition by en, tp) then 'duplicate' else 'keep' end as status from g
) {select}"""


def _linked(spark: SparkSession, d: str) -> DataFrame:
    pairs, corpus = table(spark, d, "translation_pairs"), table(spark, d, "corpus_filtered")
    links = pairs.where("tok_id IS NOT NULL").select(F.col("pair_id").alias("ord"), "tok_id", "eng_id")
    tok = corpus.where(tidy_label(F.col("source")) == "tatoeba").groupBy(F.col("id").alias("tok_id")).agg(F.max_by("text", "ord").alias("tp"))
    eng = pairs.where("split = 'train'").groupBy("eng_id").agg(F.min_by("en", "pair_id").alias("en"))
    gate = lambda: gates.sentence_reason(F.coalesce("tp", F.lit("")))
    return sets.status_join(links, tok, eng, left_key="tok_id", right_key="eng_id", reason=gate, key=["en", "tp"], order="ord")


@query(_status_sql("select ord, eng_id, tok_id, en, tp from s where status = 'keep'"))
def link_join_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links with both texts found, a sound sentence and no earlier link of the same texts."""
    return _linked(spark, d).where("status = 'keep'").select("ord", "eng_id", "tok_id", "en", "tp")


@query(_status_sql("select status, count(*) as n from s group by status"))
def link_join_status(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def link_semi(spark: SparkSession, d: str) -> DataFrame:
    needed = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(needed, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def unlinked_anti(spark: SparkSession, d: str) -> DataFrame:
    linked = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(linked, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""
with m as (select distinct o_custkey as hub, trim(o_orderpriority) as a from orders)
select x.hub, x.a, y.a as b from m x join m y on x.hub = y.hub and x.a <> y.a
""")
def hub_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of different priorities of a customer's orders."""
    return sets.hub_pairs(table(spark, d, "orders"), "o_custkey", "o_orderpriority").select("hub", "a", "b")


_MEMBERS = f"m as (select distinct eng_id as hub, {q.strip('tp')} as member from translation_pairs where tp is not null and eng_id is not null)"


@query(f"with {_MEMBERS} select hub, member, count(*) over (partition by hub) - 1 as n_partners from m qualify count(*) over (partition by hub) > 1")
def hub_members(spark: SparkSession, d: str) -> DataFrame:
    """Distinct renderings of one English sentence, each with its number of paraphrases: the paraphrase pairs in linear form."""
    return sets.hub_members(table(spark, d, "translation_pairs"), "eng_id", text.strip(F.col("tp")))


@query(f"with {_MEMBERS}, s as (select hub, count(*) as size from m group by hub) select size, count(*) as n_hubs from s group by size")
def cluster_size_hist(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "translation_pairs").where("tp IS NOT NULL AND eng_id IS NOT NULL").select(F.col("eng_id").alias("hub"), text.strip(F.col("tp")).alias("m")).distinct()
    return m.groupBy("hub").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_hubs"))


@query("""
select distinct seed from synthetic where seed is not null and seed not in (select seed from synthetic where mode = 'paraphrase' and seed is not null)
""")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Seeds not yet in the ledger of the paraphrase step."""
    rows = table(spark, d, "synthetic").where("seed IS NOT NULL")
    return sets.without_known(rows.select("seed").distinct(), rows.where("mode = 'paraphrase'"), ["seed"])


_NEW_KEY = f"lower({q.strip('text')})"


@query(f"""
with r as (select syn_id, mode, {_NEW_KEY} as k from synthetic where text is not null)
select min(syn_id) as syn_id, k as key from r where mode <> 'paraphrase' and k <> '' and k not in (select k from r where mode = 'paraphrase') group by k
""")
def global_dedup(spark: SparkSession, d: str) -> DataFrame:
    """New texts of the other modes: not in the paraphrase output, first of their kind."""
    rows = table(spark, d, "synthetic").where("text IS NOT NULL").select("syn_id", "mode", text.strip(F.lower("text")).alias("key")).where("key <> ''")
    fresh = sets.without_known(rows.where("mode <> 'paraphrase'"), rows.where("mode = 'paraphrase'"), ["key"])
    return sets.first_seen(fresh, [F.col("key")], [F.col("syn_id")]).select("syn_id", "key")


@query(f"""
with g as (select {q.strip("lower(coalesce(ctx, ''))")} as kc, {q.strip("lower(text)")} as kt from bird_gold)
select bird_id from bird b where not exists (select 1 from g where kc = {q.strip("lower(coalesce(b.ctx, ''))")} and kt = {q.strip("lower(coalesce(b.text, ''))")})
""")
def gold_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Training lines that aren't held out."""
    keyed = lambda df: df.withColumn("kc", text.strip(F.lower(F.coalesce("ctx", F.lit(""))))).withColumn("kt", text.strip(F.lower(F.coalesce("text", F.lit("")))))
    return sets.without_known(keyed(table(spark, d, "bird")), keyed(table(spark, d, "bird_gold")), ["kc", "kt"]).select("bird_id")


@query(f"""
with g as (
  select 0 as prio, gold_id as id, coalesce(ctx, '') as ctx, text, source from bird_gold
  union all select 1, bird_id, coalesce(ctx, ''), text, source from bird where text is not null
)
select prio, id from g qualify row_number() over (partition by {q.strip("lower(ctx)")}, {q.strip("lower(text)")} order by prio, id) = 1
""")
def priority_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Gold lines, then the others, each line once."""
    gold = table(spark, d, "bird_gold").select(F.lit(0).alias("prio"), F.col("gold_id").alias("id"), F.coalesce("ctx", F.lit("")).alias("ctx"), "text")
    rest = table(spark, d, "bird").where("text IS NOT NULL").select(F.lit(1).alias("prio"), F.col("bird_id").alias("id"), F.coalesce("ctx", F.lit("")).alias("ctx"), "text")
    both = gold.unionByName(rest)
    return sets.first_seen(both, [text.strip(F.lower("ctx")), text.strip(F.lower("text"))], [F.col("prio"), F.col("id")]).select("prio", "id")


@query(f"""
with b as (select min(bird_id) as bird_id, {q.strip("lower(text)")} as k from bird where coalesce(ctx, '') = '' and text is not null group by 2),
i as (select unnest({q.names(gates.INTERJECTIONS)}) as k), r as (select unnest(range(1, 4)) as copy)
select 'line' as kind, k, 1 as copy from b union all
select 'interjection', k, copy from i, r where k not in (select {q.strip("lower(text)")} from bird_gold)
""")
def inject_after_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ambient lines and, after the dedup, each interjection three times unless it is held out."""
    lines = table(spark, d, "bird").where("coalesce(ctx, '') = '' AND text IS NOT NULL").select(text.strip(F.lower("text")).alias("k")).distinct()
    bare = spark.createDataFrame([(k,) for k in gates.INTERJECTIONS], "k string")
    gold = table(spark, d, "bird_gold").select(text.strip(F.lower("text")).alias("k"))
    many = sets.weighted_union([(sets.without_known(bare, gold, ["k"]), 3)])
    return lines.select(F.lit("line").alias("kind"), "k", F.lit(1).cast("long").alias("copy")).unionByName(many.select(F.lit("interjection").alias("kind"), "k", F.col("copy").cast("long").alias("copy")))


@query("""
select 'bird' as part, bird_id as id, copy from bird, range(1, 4) t(copy) union all select 'synthetic', syn_id, 1 from synthetic
union all select 'translation_pairs', pair_id, copy from translation_pairs, range(1, 3) t(copy)
""")
def weighted_mix(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a union in which the parts stand three times, once and twice, with copy numbers."""
    part = lambda name, key: table(spark, d, name).select(F.lit(name).alias("part"), F.col(key).alias("id"))
    mixed = sets.weighted_union([(part("bird", "bird_id"), 3), (part("synthetic", "syn_id"), 1), (part("translation_pairs", "pair_id"), 2)])
    return mixed.select("part", "id", F.col("copy").cast("long").alias("copy"))


@query(f"select min(syn_id) as syn_id, sha256({q.squeeze('lower(text)')}) as key from synthetic where text is not null group by 2")
def dedup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """First row of each text in lower case with single blanks."""
    rows = table(spark, d, "synthetic").where("text IS NOT NULL").select("syn_id", text.dedup_key(F.col("text")).alias("key"))
    return sets.first_seen(rows, [F.col("key")], [F.col("syn_id")])


@query(f"""
with e as (select ex_id, mode, messages[1].content as p, messages[2].content as r from sft_train),
k as (select ex_id, mode, case when mode in ('paraphrase', 'translation') then {q.squeeze("lower(p)")} || chr(9) || {q.squeeze("lower(r)")} else {q.squeeze("lower(r)")} end as k from e)
select min(ex_id) as ex_id, sha256(k) as key from k group by 2
""")
def sft_dedup_mode_aware(spark: SparkSession, d: str) -> DataFrame:
    """Chat examples, pairs told apart by both turns, others by the response alone; one common set of keys."""
    e = table(spark, d, "sft_train").select("ex_id", "mode", F.col("messages")[0]["content"].alias("p"), F.col("messages")[1]["content"].alias("r"))
    p, r = text.squeeze(F.lower("p")), text.squeeze(F.lower("r"))
    key = F.when(F.col("mode").isin("paraphrase", "translation"), F.concat(p, F.lit("\t"), r)).otherwise(r)
    return sets.first_seen(e.select("ex_id", F.sha2(key, 256).alias("key")), [F.col("key")], [F.col("ex_id")])


@query(f"""
with c as (select ord, {TIDY.format("source")} as source, sha256('42|' || cast(ord as varchar)) as h from corpus_filtered)
select ord, source from c where source is distinct from 'tatoeba'
union all (select ord, source from c where source = 'tatoeba' order by h, ord limit 200)
""")
def source_cap(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with at most 200 documents of its largest source."""
    rows = table(spark, d, "corpus_filtered").select("ord", tidy_label(F.col("source")).alias("source"))
    return sets.source_cap(rows, "source", "tatoeba", 200, SEED, "ord")


@query("select doc_id, doc_id in (select doc_id from documents order by doc_id limit 200) as held_out from documents")
def first_n_holdout(spark: SparkSession, d: str) -> DataFrame:
    return sets.first_n(table(spark, d, "documents").select("doc_id"), ["doc_id"], 200, "doc_id")


@query("""
with c as (select ord, coalesce(length(text), 0) as n, sum(coalesce(length(text), 0)) over (order by ord) as total from corpus_filtered)
select ord, cast(total as bigint) as total from c where total - n < 50000
""")
def char_cap_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Documents in order until 50,000 characters are reached."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = table(spark, d, "corpus_filtered").select("ord", n.alias("n"))
    return sets.running_total(rows, "ord", F.col("n"), "total").where("total - n < 50000").select("ord", "total")


_MOD = "list_reduce(list_prepend(0, list_transform(string_split(sha256({}), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, x: (a * 16 + x) % 1000)"


@query(f"select ex_id, case when {_MOD.format('id')} < 50 then 'val' else 'train' end as split from sft_train where id is not null")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """A twentieth of the ids to val, by their hash."""
    return table(spark, d, "sft_train").where("id IS NOT NULL").select("ex_id", F.when(text.text_hash(F.col("id"), 1000) < 50, "val").otherwise("train").alias("split"))


@query("""
with g as (select distinct eng_id from translation_pairs where eng_id is not null),
r as (select eng_id, row_number() over (order by sha256('42|' || eng_id), eng_id) as k, count(*) over () as n from g)
select pair_id, case when k <= floor(n * 0.05) then 'eval' else 'train' end as split from translation_pairs left join r using (eng_id)
""")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """A twentieth of the English sentences held out with all their rows."""
    return sets.group_split(table(spark, d, "translation_pairs").select("pair_id", "eng_id"), "eng_id", 0.05, SEED).select("pair_id", "split")


@query("select doc_id from (select doc_id, sha256('42|' || cast(doc_id as varchar)) as h from documents) order by h, doc_id limit 250")
def hash_shuffle_cap(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 250 documents by a hash order (a sampling operator)."""
    return table(spark, d, "documents").select("doc_id", text.hash_order(SEED, F.col("doc_id")).alias("h")).orderBy("h", "doc_id").limit(250).select("doc_id")


_KEEPSET = """
with u as (select unnest([l_orderkey, l_partkey, l_suppkey]) as v from lineitem union all select p_partkey from part)
select v as old_id, row_number() over (order by v) - 1 as new_id from (select distinct v from u)
"""


@query(_KEEPSET)
def vocab_keepset(spark: SparkSession, d: str) -> DataFrame:
    """Ids in use anywhere, renumbered densely from 0."""
    used = table(spark, d, "lineitem").select(F.explode(F.array("l_orderkey", "l_partkey", "l_suppkey")).alias("v"))
    ids = used.unionAll(table(spark, d, "part").select(F.col("p_partkey").alias("v"))).distinct()
    ranked = sets.running_total(ids, "v", F.lit(1).cast("long"), "k")
    return ranked.select(F.col("v").alias("old_id"), (F.col("k") - 1).alias("new_id"))


@query(_KEEPSET)
def vocab_keepset_all(spark: SparkSession, d: str) -> DataFrame:
    """The same under its older name, from when vocab_keepset left out small lines."""
    return vocab_keepset(spark, d)


@query("""
with k as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents),
c as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from corpus_filtered),
m as (select substr(w, 1, i) as a, substr(w, i + 1) as b, w as merged from (select w, unnest(range(1, length(w))) as i from c))
select a, b, merged from m where a in (select w from k) and b in (select w from k) and merged in (select w from k)
""")
def merge_keepset(spark: SparkSession, d: str) -> DataFrame:
    """Merges a + b that stay valid as both parts and the whole are kept. Kept are the words of the documents; merges are all cuts of the corpus words in two."""
    words = lambda name: table(spark, d, name).select(F.explode(text.lower_words(F.col("text"))).alias("w")).distinct()
    cut = words("corpus_filtered").where("length(w) > 1").select("w", F.explode(F.expr("sequence(1, length(w) - 1)")).alias("i"))
    merges = cut.select(F.expr("substr(w, 1, i)").alias("a"), F.expr("substr(w, i + 1)").alias("b"), F.col("w").alias("merged"))
    return sets.valid_merges(merges, words("documents").select("w"), "w")


@query("""
with s as (select source, mode, list(distinct lower(trim(seed))) as seeds from synthetic where seed is not null group by source, mode)
select source, mode, seed from (select source, mode, seed, row_number() over (partition by source, mode order by seed) as k from (select source, mode, unnest(seeds) as seed from s)) where k <= 5
""")
def unnest_cap(spark: SparkSession, d: str) -> DataFrame:
    """Five distinct seeds at most of each group (the cap is the feature), kept per task before the shuffle."""
    rows = table(spark, d, "synthetic").where("seed IS NOT NULL").select("source", "mode", F.trim(F.lower("seed")).alias("seed")).distinct()
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source", "mode").orderBy("seed"))
    return rows.withColumn("k", rank).where("k <= 5").select("source", "mode", "seed")
