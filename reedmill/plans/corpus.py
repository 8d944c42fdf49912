"""Corpus queries: filters, gates, sentences, words, dedup keys, markup and scripts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonology, text
from ..functions.script import GLYPH_OF, LETTER_WORDS, MIDDLE_COLON, NAME_END, NAME_START, WORD_OF, WORDS, tidy_label
from ..operators import chunks, gates
from ..operators.metrics import share
from ..session import spread, table
from . import sqltext as q
from .registry import query

RATIO = 0.05
TIDY = "nullif(regexp_replace(lower(trim({}, ' \t\r\n')), '[\\s_]+', '-', 'g'), '')"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", "source", "lang", F.explode(text.sentences(F.col("text"))).alias("s"))


SENTENCES = f"sents as (select doc_id, source, lang, unnest({q.sentences('text')}) as s from documents)"


@query(f"""
with k as (select source, coalesce(length(text), 0) as n, {q.letter_ratio("text")} <= {RATIO} as keep from documents)
select coalesce(source, 'TOTAL') as source, count(*) as docs, count(*) filter (keep) as docs_kept, count(*) filter (not keep) as docs_dropped,
  cast(sum(n) filter (keep) as bigint) as chars_kept, cast(sum(n) filter (not keep) as bigint) as chars_dropped, round(100.0 * count(*) filter (not keep) / count(*), 4) as drop_percent
from k group by rollup (source)
""")
def filter_report_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters kept and dropped by the letter filter, by source and in total."""
    rows = spread(table(spark, d, "documents")).select("source", F.coalesce(F.length("text"), F.lit(0)).alias("n"), (gates.letter_ratio(F.col("text")) <= RATIO).alias("keep"))
    out = rows.rollup("source").agg(
        F.count("*").alias("docs"), F.count_if("keep").alias("docs_kept"), F.count_if(~F.col("keep")).alias("docs_dropped"),
        F.sum(F.when(F.col("keep"), F.col("n"))).alias("chars_kept"), F.sum(F.when(~F.col("keep"), F.col("n"))).alias("chars_dropped"),
        F.round(100.0 * F.count_if(~F.col("keep")) / F.count("*"), 4).alias("drop_percent"),
    )
    return out.withColumn("source", F.coalesce("source", F.lit("TOTAL")))


@query(f"select doc_id, round(r, 6) as ratio from (select doc_id, {q.letter_ratio('text')} as r from documents) where r <= {RATIO}")
def letter_ratio_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).select("doc_id", gates.letter_ratio(F.col("text")).alias("r"))
    return rows.where(F.col("r") <= RATIO).select("doc_id", F.round("r", 6).alias("ratio"))


@query(f"""
with {SENTENCES}, l as (select doc_id, s, list_filter({q.words("s")}, lambda w: regexp_matches(w, '^[a-z]')) as low from sents where not regexp_matches(s, '[^A-Za-z.,;:!?''"\\-\\s\\x{{a0}}]'))
select doc_id, count(*) as n_lines from l where len(low) > 0 and len(list_filter(low, lambda w: list_contains({q.names(WORDS)}, lower(w)))) * 1.0 / len(low) >= 0.6 group by doc_id
""")
def lang_line_filter(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that look like Toki Pona, counted by document."""
    return _sentences(spark, d).where(gates.looks_like_language(F.col("s"), WORDS)).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(f"select doc_id, len({q.sentences('text')}) as n_sentences from documents where text is not null")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).where("text IS NOT NULL").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(f"select doc_id, len({q.bare_sentences('text')}) as n_sentences from documents where text is not null")
def sentence_split_bare(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).where("text IS NOT NULL").select("doc_id", F.size(text.bare_sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(f"""
with {SENTENCES}, s as (select source, count(*) as sentences, count(distinct lower(s)) as distinct_sentences from sents group by source),
c as (select source, count(*) as docs, cast(sum(len({q.words("text")})) as bigint) as words, cast(sum(length(text)) as bigint) as chars from documents group by source)
select c.source, docs, words, chars, coalesce(sentences, 0) as sentences, coalesce(distinct_sentences, 0) as distinct_sentences from c left join s using (source)
""")
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words, characters and sentences by source."""
    s = _sentences(spark, d).groupBy("source").agg(F.count("*").alias("sentences"), F.countDistinct(F.lower("s")).alias("distinct_sentences"))
    words = F.when(F.col("text").isNotNull(), F.size(text.ascii_words(F.col("text"))))
    c = spread(table(spark, d, "documents")).groupBy("source").agg(F.count("*").alias("docs"), F.sum(words).alias("words"), F.sum(F.length("text")).alias("chars"))
    return c.join(s, "source", "left").fillna(0, ["sentences", "distinct_sentences"])


@query("""
select w as word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) group by w order by n desc, w limit 100
""")
def word_freq_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent words, ties by word."""
    words = spread(table(spark, d, "documents")).select(F.explode(text.lower_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


@query(f"with {SENTENCES} select {q.reason('s')} as reason, count(*) as n from sents group by 1")
def strict_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).groupBy(gates.sentence_reason(F.col("s")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"with {SENTENCES} select {q.reason('s', q.RELAXED)} as reason, count(*) as n from sents group by 1")
def relaxed_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).groupBy(gates.sentence_reason(F.col("s"), gates.RELAXED).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
with r as (select doc_id, list_transform({q.sentences("text")}, lambda s: {q.reason("s", q.RELAXED)}) as rs from documents where text is not null),
c as (select doc_id, len(list_filter(rs, lambda r: r <> 'skip')) as considered, len(list_filter(rs, lambda r: r = '')) as passed from r)
select doc_id, considered, passed, round(case when considered = 0 then 1.0 else passed * 1.0 / considered end, 6) as rate, (considered = 0 or passed * 1.0 / considered >= 0.5) as keep from c
""")
def sentence_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document's sentences that pass the relaxed gate; sentences without words don't count."""
    reasons = F.transform(text.sentences(F.col("text")), lambda s: gates.sentence_reason(s, gates.RELAXED))
    rows = spread(table(spark, d, "documents")).where("text IS NOT NULL").select("doc_id", reasons.alias("rs"))
    counted = rows.select("doc_id", F.size(F.filter("rs", lambda r: r != "skip")).cast("long").alias("considered"), F.size(F.filter("rs", lambda r: r == "")).cast("long").alias("passed"))
    rate = F.when(F.col("considered") == 0, 1.0).otherwise(share(F.col("passed"), F.col("considered")))
    return counted.select("*", F.round(rate, 6).alias("rate"), (rate >= 0.5).alias("keep"))


@query(f"""
with a as (select mode, m.content as t from (select mode, unnest(messages) as m from sft_train) where m.role = 'assistant'),
r as (select mode, coalesce(list_filter(list_transform({q.sentences("t")}, lambda s: {q.reason("s")}), lambda r: r <> '')[1], '') as reason from a)
select mode, reason, count(*) as n from r group by all
""")
def response_gate(spark: SparkSession, d: str) -> DataFrame:
    """First failing reason of each assistant turn, by mode."""
    turns = table(spark, d, "sft_train").select("mode", F.explode("messages").alias("m")).where("m.role = 'assistant'")
    return turns.groupBy("mode", gates.response_reason(F.col("m.content")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"select {q.bubble('text')} as reason, count(*) as n from bird where text is not null group by 1")
def bubble_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bird").where("text IS NOT NULL").groupBy(gates.bubble_reason(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


_CLAUSE = f"list_has_any(regexp_extract_all(lower(c), '[a-z]+'), {q.names(['li', 'mi', 'sina', 'o'])})"


@query(f"""
with b as (select bird_id, text as t, coalesce(ctx, '') as c from bird where text is not null),
r as (select bird_id, t, c, {q.bubble("t")} as rr, {q.bubble("c")} as rs from b)
select case when rr <> '' then 'reply_' || rr when c <> '' and rs <> '' then 'scene_' || rs when c <> '' and not {_CLAUSE} then 'scene_fragment'
  when c <> '' and {q.strip("lower(t)")} = {q.strip("lower(c)")} then 'reply_copies_scene' else '' end as reason, count(*) as n from r group by 1
""")
def bubble_pair_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bird").where("text IS NOT NULL").groupBy(gates.pair_reason(F.coalesce("ctx", F.lit("")), F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
select split, count(*) as n, count(*) filter (trim(lower(en), '.!? ') = trim(lower(tp), '.!? ')) as copied from translation_pairs group by split
""")
def copy_reject(spark: SparkSession, d: str) -> DataFrame:
    """Answers that only repeat their source, by split."""
    return table(spark, d, "translation_pairs").groupBy("split").agg(F.count("*").alias("n"), F.count_if(text.copy_key(F.col("en")) == text.copy_key(F.col("tp"))).alias("copied"))


_COMMON = 150
_SIMPLE_SQL = r"""
with common as (select w from (select unnest(regexp_extract_all(lower(scene_en), '[a-z'']+')) as w from bird_english) group by w order by count(*) desc, w limit 150),
l as (select list(w) as known from common),
s as (select be_id, {strip} as s from bird_english where reply_en is not null),
t as (select be_id, s, regexp_extract_all(s, '[A-Za-z'']+') as w from s)
select be_id from t, l
where regexp_matches(s, '[.!?]$') and not regexp_matches(s, '[^\x00-\x7F]') and not regexp_matches(s, '  | \.| ,') and len(w) between 3 and 12
  and len(list_filter(w, lambda x: length(x) > 13)) = 0 and len(list_filter(w, lambda x: length(x) = 1 and lower(x) not in ('a', 'i'))) = 0
  and len(list_filter(w[2:], lambda x: regexp_matches(x, '^[A-Z]'))) <= 2 and length(regexp_replace(s, '[^0-9]', '', 'g')) <= 4
  and len(list_filter(w, lambda x: list_contains(known, lower(x)))) * 1.0 / len(w) >= 0.4
"""


@query(_SIMPLE_SQL.replace("{strip}", q.strip("reply_en")))
def simple_sentence_filter(spark: SparkSession, d: str) -> DataFrame:
    """Replies that are short, plain and of mostly common words; common are the 150 most frequent words of the scenes."""
    rows = table(spark, d, "bird_english")
    words = rows.select(F.explode(F.regexp_extract_all(F.lower("scene_en"), F.lit("[a-z']+"), F.lit(0))).alias("w")).groupBy("w").count()
    common = [r["w"] for r in words.orderBy(F.desc("count"), "w").limit(_COMMON).collect()]
    return rows.where("reply_en IS NOT NULL").where(gates.is_simple_sentence(F.col("reply_en"), common, 12, 0.4)).select("be_id")


@query(f"""
with w as (select distinct lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents)
select lang, count(*) as n_words, count(*) filter ({q.legal("w")}) as n_legal, round(count(*) filter ({q.legal("w")}) * 1.0 / count(*), 6) as legal_share from w group by lang
""")
def legal_word_share(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of legal shape by language label."""
    w = spread(table(spark, d, "documents")).select("lang", F.explode(text.lower_words(F.col("text"))).alias("w")).distinct()
    ok = F.count_if(phonology.is_legal_word(F.col("w")))
    return w.groupBy("lang").agg(F.count("*").alias("n_words"), ok.alias("n_legal"), F.round(ok / F.count("*"), 6).alias("legal_share"))


_CODA = r"regexp_replace(w, '([aeiou])n([^aeioun]|$)', '\1N\2', 'g')"


@query(f"""
with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents)
select len(regexp_extract_all({_CODA}, '[{phonology.CONSONANTS}]?[{phonology.VOWELS}]N?|.')) as n_syllables, count(*) as n_words from w group by 1
""")
def syllabify_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words by number of syllables."""
    w = spread(table(spark, d, "documents")).select(F.explode(text.lower_words(F.col("text"))).alias("w")).distinct()
    return w.groupBy(F.size(phonology.syllables(F.col("w"))).alias("n_syllables")).agg(F.count("*").alias("n_words"))


@query("select doc_id, length(regexp_replace(text, '</?[a-zA-Z][^>]*>', '', 'g')) as n, sha256(regexp_replace(text, '</?[a-zA-Z][^>]*>', '', 'g')) as h from documents where text is not null")
def html_tag_strip(spark: SparkSession, d: str) -> DataFrame:
    plain = text.strip_html(F.col("text"))
    return spread(table(spark, d, "documents")).where("text IS NOT NULL").select("doc_id", F.length(plain).cast("long").alias("n"), F.sha2(plain, 256).alias("h"))


def _nested(t: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        t = f"regexp_replace({t}, '{pattern.replace('(?Um)', '(?m)').replace('(?U)', '')}', '{to.replace('$1', chr(92) + '1')}', 'g')".replace(r"\A", "^")
    return t


def _quoted(steps: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(p.replace("'", "''"), t.replace("\n", "' || chr(10) || chr(10) || '") if "\n" in t else t) for p, t in steps]


@query(f"select doc_id, length(t) as n, sha256(t) as h from (select doc_id, {q.strip(_nested('text', _quoted(text.MARKDOWN_STEPS)))} as t from documents where text is not null)")
def markdown_strip(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).where("text IS NOT NULL").select("doc_id", text.strip_markdown(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("h"))


def _wiki_sql(t: str) -> str:
    """The steps in SQL; without back-references, so each paired element is a pattern of its own."""
    paired = "|".join(f"<{x}[^>]*?>.*?</{x}>" for x in re.findall(r"[a-z]+", text.WIKI_BLOCKS[3][0].split(")", 2)[1].split("(")[1]))
    plain = _nested(t, _quoted([*text.WIKI_BLOCKS[:3], (f"(?is){paired}", "")]))
    for _ in range(4):  # as deep as templates are in the test tables
        plain = f"regexp_replace({plain}, '{text.WIKI_TEMPLATE}', '', 'g')"
    return q.strip(_nested(plain, _quoted(text.WIKI_STEPS)))


@query(f"select doc_id, length(t) as n, sha256(t) as h from (select doc_id, {_wiki_sql('text')} as t from documents where text is not null)")
def wikitext_strip(spark: SparkSession, d: str) -> DataFrame:
    """Plain text of wiki markup."""
    rows = spread(table(spark, d, "documents")).where("text IS NOT NULL").select("doc_id", text.strip_wikitext(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("h"))


_GLYPH = "map {" + ", ".join(f"'{w}': '{g}'" for w, g in GLYPH_OF.items()) + "}"
_LETTER = "map {" + ", ".join(f"'{k}': '{GLYPH_OF[w]}'" for k, w in LETTER_WORDS.items()) + "}"


def _glyphs_sql(t: str) -> str:
    return f"""trim(regexp_replace(array_to_string(list_transform(regexp_extract_all({t}, '[A-Za-z]+|[.!?:,]'), lambda t: case when regexp_matches(t, '^[.!?]$') then ' ' when t = ':' then '{chr(MIDDLE_COLON)}' when t = ',' then ''
  when ({_GLYPH})[lower(t)] is not null then ({_GLYPH})[lower(t)]
  when regexp_matches(t, '^[A-Z]') then '{chr(NAME_START)}' || array_to_string(list_filter(list_transform(string_split(lower(t), ''), lambda c: ({_LETTER})[c]), lambda g: g is not null), '') || '{chr(NAME_END)}'
  else '' end), ''), ' +', ' ', 'g'))"""


@query(f"select bird_id, {_glyphs_sql('text')} as glyphs from bird where text is not null")
def latin_to_ucsur(spark: SparkSession, d: str) -> DataFrame:
    """Glyph text of the training lines."""
    return table(spark, d, "bird").where("text IS NOT NULL").select("bird_id", phonology.latin_to_ucsur(F.col("text")).alias("glyphs"))


_WORD = "map {" + ", ".join(f"'{g}': '{w}'" for g, w in WORD_OF.items()) + "}"
_CARTOUCHE = f"upper(({_WORD})[t[2]][1]) || array_to_string(list_transform(string_split(t[3:-2], ''), lambda c: coalesce(({_WORD})[c][1], '')), '')"


@query(f"""
with g as (select gold_id, text, {_glyphs_sql("text")} as g from bird_gold where text is not null)
select gold_id, text, ltrim(array_to_string(list_transform(regexp_extract_all(g, '{chr(NAME_START)}[^{chr(NAME_END)}]*{chr(NAME_END)}|.'),
  lambda t: case when t = '{chr(MIDDLE_COLON)}' then ':' when length(t) > 2 then ' ' || {_CARTOUCHE} when ({_WORD})[t] is not null then ' ' || ({_WORD})[t] else '' end), '')) as back from g
union all select gold_id, text, null from bird_gold where text is null
""")
def ucsur_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Held-out lines written in glyphs and read back."""
    return table(spark, d, "bird_gold").select("gold_id", "text", phonology.ucsur_to_latin(phonology.latin_to_ucsur(F.col("text"))).alias("back"))


@query(f"""
with t as (select ord, {q.strip("coalesce(text, '')")} as t from corpus_filtered),
s as (select ord, t, list_transform({q.sentences("t")}, lambda s: {{'done': 0, 'longest': 0, 'part': length(s) + case when regexp_matches(s, '[.!?]$') then 0 else 1 end,
  'n': length(s) + case when regexp_matches(s, '[.!?]$') then 1 else 2 end}}) as l from t),
f as (select ord, t, case when len(l) > 0 then list_reduce(l, lambda a, x: case when a.n + x.n > {chunks.MAX_CHUNK}
  then {{'done': a.done + 1, 'longest': greatest(a.longest, a.part), 'part': x.part, 'n': x.part}}
  else {{'done': a.done, 'longest': a.longest, 'part': a.part + 1 + x.part, 'n': a.n + x.n}} end) end as r from s)
select ord, case when t = '' then 0 when length(t) <= {chunks.MAX_CHUNK} then 1 else r.done + 1 end as n_chunks,
  case when t = '' then 0 when length(t) <= {chunks.MAX_CHUNK} then length(t) else greatest(r.longest, r.part) end as longest from f
""")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each corpus document: number and greatest length."""
    rows = table(spark, d, "corpus_filtered").select("ord", chunks.packed_chunks(F.col("text")).alias("c"))
    return rows.select("ord", F.size("c").alias("n_chunks"), F.coalesce(F.array_max(F.transform("c", F.length)), F.lit(0)).alias("longest"))


DRAWS = 1_000_003


def _draw(*cols: Column) -> Column:
    """A whole number below DRAWS, drawn by the columns."""
    return text.text_hash(F.concat_ws("/", F.lit("42"), *[c.cast("string") for c in cols]), DRAWS)


def _draw_sql(key: str) -> str:
    return f"list_reduce(list_prepend(0, list_transform(string_split(sha256('42/' || {key}), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, x: (a * 16 + x) % {DRAWS})"


_ENDED = "lambda s: case when regexp_matches(s, '[.!?]$') then s else s || '.' end"
_CHUNKS = f"""
t as (select ord, {q.strip("coalesce(text, '')")} as t from corpus_filtered),
s as (select ord, t, list_transform(list_transform({q.sentences("t")}, {_ENDED}), lambda s: {{'done': []::varchar[], 'part': s, 'n': length(s) + 1}}) as l from t),
f as (select ord, t, case when len(l) > 0 then list_reduce(l, lambda a, x: case when a.n + x.n > {chunks.MAX_CHUNK} then {{'done': list_append(a.done, a.part), 'part': x.part, 'n': x.n - 1}}
  else {{'done': a.done, 'part': a.part || ' ' || x.part, 'n': a.n + x.n}} end) end as r from s),
c as (select ord, case when t = '' then [] when length(t) <= {chunks.MAX_CHUNK} then [t] else list_append(r.done, r.part) end as c from f),
p as (select ord, i - 1 as part, c[i] as chunk from c, unnest(range(1, len(c) + 1)) u(i))"""


_PAIRS = f"""
ss as (select ord, part, {q.sentences("chunk")} as s, {_draw_sql("ord || '/' || part")} as draw from p),
k as (select ord, part, s, 1 + draw % greatest(least({chunks.PREFIX_SENTENCES}, len(s) - 1), 1) as k from ss where len(s) >= 2),
y as (select ord, part, array_to_string(list_transform(s[1:k], {_ENDED}), ' ') as prefix, array_to_string(list_transform(s[k + 1:k + {chunks.SUFFIX_SENTENCES}], {_ENDED}), ' ') as suffix from k),
x as (select * from y where len({q.words("prefix")}) >= {chunks.PREFIX_WORDS})"""


@query(f"""
with {_CHUNKS}, {_PAIRS} select ord, part, prefix, suffix from x
""")
def continuation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A prefix and what follows, of each chunk with two sentences or more."""
    rows = table(spark, d, "corpus_filtered").select("ord", F.posexplode(chunks.packed_chunks(F.col("text"))).alias("part", "chunk"))
    pair = chunks.continuation(F.col("chunk"), _draw(F.col("ord"), F.col("part")))
    return rows.select("ord", "part", pair.alias("p")).where("p IS NOT NULL").select("ord", "part", "p.prefix", "p.suffix")


@query()
def sft_examples(spark: SparkSession, d: str) -> DataFrame:
    """Chat examples of the corpus: a fifth of the chunks asks for a topic, the rest for a continuation."""
    rows = table(spark, d, "corpus_filtered").select("ord", tidy_label(F.col("source")).alias("source"), F.posexplode(chunks.packed_chunks(F.col("text"))).alias("part", "chunk"))
    topic = _draw(F.col("ord"), F.col("part"), F.lit("mode")) % 1000 < 200
    p = chunks.continuation(F.col("chunk"), _draw(F.col("ord"), F.col("part")))
    chat = lambda user, assistant: F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))
    messages = F.when(topic, chat(F.concat(F.lit("o toki e ijo "), F.coalesce(F.try_element_at(text.ascii_words(F.col("chunk")), F.lit(1)), F.lit("ale"))), F.col("chunk"))).when(p.isNotNull(), chat(p["prefix"], p["suffix"]))
    return rows.select("ord", "part", "source", F.when(topic, "topic").otherwise("continuation").alias("mode"), messages.alias("messages")).where("messages IS NOT NULL")


@query(f"""
with {_CHUNKS}, {_PAIRS},
m as (select ord, part, chunk, {_draw_sql("ord || '/' || part || '/mode'")} % 1000 < 200 as topic from p),
e as (select ord, part, topic, case when topic then 'o toki e ijo ' || coalesce(({q.words("chunk")})[1], 'ale') else prefix end as ask, case when topic then chunk else suffix end as say
  from m left join x using (ord, part) where topic or prefix is not null)
select ord, part, case when topic then 'topic' else 'continuation' end as mode, 0 as turn, 'user' as role, ask as content from e
union all select ord, part, case when topic then 'topic' else 'continuation' end, 1, 'assistant', say from e
""")
def sft_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of sft_examples, a row each."""
    turns = sft_examples(spark, d).select("ord", "part", "mode", F.posexplode("messages").alias("turn", "m"))
    return turns.select("ord", "part", "mode", "turn", "m.role", "m.content")
