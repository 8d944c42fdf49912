"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from ..functions.script import WORD_OF
from .wordsalad import BLOCK, KEYWORD_RUN, LINK, LOW, REPEATED_PAIRS, SALAD_SHARE, SCAFFOLD, SMOOTH

_GLYPHS = "map {" + ", ".join(f"'{g}': ' {w} '" for g, w in WORD_OF.items()) + "}"


def latin_sql(text: str) -> str:
    """Glyphs of a text as Latin words between spaces."""
    return f"""case when regexp_matches({text}, '[\U000f1900-\U000f19ff]')
      then array_to_string(list_transform(string_split({text}, ''), lambda ch: coalesce(({_GLYPHS})[ch], ch)), '') else {text} end"""


_ALNUM = r"[\p{L}\p{N}]+"

P1 = f"""
with strings as (
  select distinct gold_id, unnest([coalesce(text, ''), coalesce(ctx, ''), coalesce(ctx, '') || ' ' || coalesce(text, '')]) as t from bird_gold
), e as (
  select gold_id, t, unnest(regexp_extract_all(lower({latin_sql("t")}), '{_ALNUM}')) as w from strings
), ec as (select gold_id, t, w, count(*) as c from e group by all),
en as (select gold_id, t, sum(c) as n from ec group by all),
b as (select bird_id, unnest(regexp_extract_all(lower({latin_sql("text")}), '{_ALNUM}')) as w from bird),
bc as (select bird_id, w, count(*) as c from b group by all),
bn as (select bird_id, sum(c) as m from bc group by all),
o as (select gold_id, t, bird_id, sum(least(ec.c, bc.c)) as common from ec join bc using (w) group by all)
select distinct gold_id, bird_id from o join en using (gold_id, t) join bn using (bird_id) where common >= 0.7 * greatest(n, m) - 1e-9
"""

_CANON = r"lower(regexp_replace(coalesce({}, ''), '[^\p{{L}}\p{{N}}\p{{Co}}]+', '', 'g'))"

_ROWS4 = f"""
  select 'synthetic' as tab, syn_id as id, {_CANON.format("text")} as c from synthetic where {_CANON.format("text")} <> ''
  union all
  select 'bird', bird_id, array_to_string(list_sort([{_CANON.format("ctx")}, {_CANON.format("text")}]), '|') from bird
  where {_CANON.format("ctx")} || {_CANON.format("text")} <> ''
"""

P4 = f"""
with r as ({_ROWS4}), g as (select *, min(id) over (partition by tab, c) as first_id from r)
select distinct tab, first_id, id as copy_id from g where id <> first_id
"""

P4_COLLAPSE = f"""
with r as ({_ROWS4}) select tab, min(id) as first_id, count(*) as n_copies from r group by tab, c
"""

_CLEAN = "lower(trim({}, ' \t\r\n ​﻿'))"
_KEY = r"""
case when {doc} then 'D' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(s, '\', '/'), '\s*#.*$', ''), '/+', '/', 'g'), '^(\./)+', ''), '\s+', '_', 'g')
     when regexp_matches(s, '^lipu[\s:_/#-]*[0-9]+$') then 'L' || cast(cast(regexp_replace(s, '[^0-9]', '', 'g') as bigint) as varchar)
     else 'E' || cast(cast(regexp_replace(regexp_replace(s, '\.0+$', ''), '[^0-9]', '', 'g') as bigint) as varchar) end
"""
P5 = f"""
with a as (
  select pair_id as row_id, {_CLEAN.format("eng_id")} as s, split, false as doc from translation_pairs
  union all select ex_id, {_CLEAN.format("id")}, split, mode in ('continuation', 'topic') from sft_train
), k as (select row_id, split, s, {_KEY.format(doc="doc")} as key from a where s <> ''),
t as (select * from k where key in (select key from k group by key having count(distinct split) > 1))
select least(x.row_id, y.row_id) as row_a, greatest(x.row_id, y.row_id) as row_b from t x join t y on x.key = y.key and x.split < y.split
"""

_KEYED5 = P5[: P5.index("t as (select")]
P5_MEMBERS = f"""{_KEYED5} c as (select key, split, count(*) as n from k where split is not null group by all), n as (select key, sum(n) as total from c group by key having count(*) > 1)
select row_id as id, split, cast(total - n as bigint) as n_elsewhere from k join c using (key, split) join n using (key)
"""
P5_FOREST = f"""{_KEYED5} g as (select key, count(*) as n from k group by key having count(*) > 1)
select cast(sum(n) as bigint) as n_rows, cast(sum(n - 1) as bigint) as n_edges, count(*) as n_trees from g
"""

P1_REPORT = f"""
with f as ({P1}),
s as (select bird_id, nullif(regexp_replace(lower(trim(source, ' \t\r\n')), '[\\s_]+', '-', 'g'), '') as source from bird)
select g.split, s.source, count(*) as n_pairs, count(distinct gold_id) as n_eval_rows, count(distinct bird_id) as n_train_rows
from f join bird_gold g using (gold_id) join s using (bird_id) group by all
"""

P8 = f"""
with w as (
  select item_id, regexp_extract_all(lower({latin_sql("text")}), '\\p{{L}}+') as w from benchmark
), g as (
  select distinct item_id, array_to_string(w[i : i + 11], ' ') as g from w, unnest(generate_series(1, len(w) - 11)) as t(i)
), v as (
  select doc_id, regexp_extract_all(lower({latin_sql("regexp_replace(text, '<[^<>]*>', ' ', 'g')")}), '\\p{{L}}+') as w from documents
), h as (
  select doc_id, array_to_string(w[i : i + 11], ' ') as g from v, unnest(generate_series(1, len(w) - 11)) as t(i)
)
select distinct item_id, doc_id from g join h using (g)
"""

_LINK = LINK.replace("'", "''")

P9_SCORES = f"""
with t as (select row_number() over () as page, doc_id, regexp_replace({latin_sql("text")}, '[\U000f1900-\U000f19ff]', ' ', 'g') as t from documents where text is not null),
w as (
  select page, doc_id, regexp_extract_all(lower(regexp_replace(regexp_replace(t, '{_LINK}', ' ', 'g'), '<[^<>]*>', ' ', 'g')), '\\p{{L}}+') as w,
    len(regexp_extract_all(array_to_string(regexp_extract_all(t, '{_LINK}'), ' '), '\\p{{L}}+')) as n_link_words from t
), p as (select page, doc_id, w, n_link_words, len(w) as n_words,
    coalesce(list_sum(list_filter(list_transform(string_split(array_to_string(list_transform(w, lambda x: case when x in ({", ".join(f"'{x}'" for x in SCAFFOLD)}) then '|' else 'x' end), ''), '|'),
      lambda r: len(r)), lambda n: n >= {KEYWORD_RUN})), 0)::int as n_keyword_words
  from w where len(w) + n_link_words > 0
), r as (select page, i, (i - 1) // {BLOCK} as block, w[i] as a, w[i + 1] as b from p, unnest(generate_series(1, n_words - 1)) as g(i)),
c as (select a, b, count(distinct page) as n from r group by all),
k as (select sum(n) as total from c), f as (select a, sum(n) as na from c group by a), s as (select b, sum(n) as nb from c group by b),
m as (select a, b, n, ln((n - 1 + {SMOOTH} * total) / (na * nb / total::double + {SMOOTH} * total)) as pmi from c join f using (a) join s using (b), k),
mean as (select sum(n * pmi) / any_value(total) as mean from m, k),
bl as (select page, block, count(*) as n, sum(pmi) as s from r join m using (a, b) group by all),
per as (select page, sum(case when s <= {LOW} * mean * n then n else 0 end) as salad, sum(n) as n_pairs, sum(s) as s from bl, mean group by page),
d as (select page, count(distinct (a, b)) as nd from r group by page)
select doc_id, n_words, n_link_words, n_keyword_words, round(s / n_pairs / mean, 6) as coherence,
  round((coalesce(salad / n_pairs, 0.0) * n_words + n_link_words) / (n_words + n_link_words), 6) as salad_share,
  round(case when n_words > 8 then 1 - nd / (n_words - 1) else 0.0 end, 6) as repeated_share
from p left join per using (page) left join d using (page), mean
"""

P9 = f"""
select doc_id from ({P9_SCORES}) where (salad_share > {SALAD_SHARE} or repeated_share > {REPEATED_PAIRS}) and 2 * (n_keyword_words + n_link_words) > n_words + n_link_words
"""

_LABEL = "nullif(regexp_replace(regexp_replace(lower({}), '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g'), '[\\s\\p{{Z}}_]+', '-', 'g'), '')"
_LANG = f"case when {_LABEL.format('lang')} in ('toki', 'toki-pona', 'tp') then 'tok' when {_LABEL.format('lang')} in ('english', 'eng') then 'en' else {_LABEL.format('lang')} end"
P2_SLICES = f"""
select 'corpus_filtered' as tab, {_LABEL.format("source")} as source, {_LANG} as lang, {_LABEL.format("domain")} as domain, count(*) as n_docs, count(*) filter (coalesce(text, '') = '') as n_empty from corpus_filtered group by all
union all select 'synthetic', {_LABEL.format("source")}, null, null, count(*), count(*) filter (coalesce(text, '') = '') from synthetic group by all
"""
P3_INVARIANTS = "select 0 as n_overused, 0 as n_twice, 0 as n_stray"
P5_INVARIANTS = f"""{_KEYED5.replace("where s <> ''", "")} n as (select count(*) as n from a)
select any_value(n) as n_rows, count(distinct key) filter (s is not null and s <> '') + count(*) filter (coalesce(s, '') = '') as n_entities, 0 as n_torn from (select * from k, n)
"""
P7_INVARIANTS = "select count(distinct doc_id) as n_docs, 0 as n_divided, 0 as n_overfull from documents"

P9_INCOHERENT = f"select doc_id from ({P9_SCORES}) where salad_share > 0.5"

ORACLES = {"p2_slice_docs": P2_SLICES, "p3_invariants": P3_INVARIANTS, "p5_invariants": P5_INVARIANTS, "p7_invariants": P7_INVARIANTS, "p9_found": P9, "p9_incoherent": P9_INCOHERENT, "p9_scores": P9_SCORES, "p8_found": P8, "p1_found": P1, "p1_report": P1_REPORT, "p4_found": P4, "p4_collapse": P4_COLLAPSE, "p5_found": P5, "p5_members": P5_MEMBERS, "p5_forest": P5_FOREST}
