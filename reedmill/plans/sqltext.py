"""DuckDB SQL fragments with the meaning of the text functions."""

from __future__ import annotations

from ..functions.phonology import CONSONANTS, FORBIDDEN, VOWELS
from ..functions.script import WORDS
from ..operators.gates import HISTORIC_WORDS, INTERJECTIONS, LETTERS, RELAXED, STRICT, Profile

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(t: str) -> str:
    return f"regexp_replace({strip(t)}, '{WS}+', ' ', 'g')"


def sentences(t: str) -> str:
    marked = rf"regexp_replace({t}, '([.!?]){WS}+', '\1' || chr(10), 'g')"
    return f"list_filter(list_transform(string_split_regex({marked}, '\\n+'), lambda s: {strip('s')}), lambda s: s <> '')"


def bare_sentences(t: str) -> str:
    return f"list_filter(list_transform(string_split_regex({t}, '[.!?]+'), lambda s: {strip('s')}), lambda s: s <> '')"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, '[A-Za-z]+')"


def names(items: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def letter_ratio(t: str) -> str:
    low = f"lower(coalesce({t}, ''))"
    every, own = rf"length(regexp_replace({low}, '[^\p{{L}}]', '', 'g'))", f"length(regexp_replace({low}, '[^{LETTERS}]', '', 'g'))"
    return f"(case when {every} = 0 then 0.0 else ({every} - {own}) * 1.0 / {every} end)"


def legal(w: str) -> str:
    return f"(regexp_matches(lower({w}), '^(?:[{CONSONANTS}]?[{VOWELS}]n?(?:[{CONSONANTS}][{VOWELS}]n?)*|n)$') and not regexp_matches(lower({w}), '{FORBIDDEN}|n[nm]'))"


def most(items: str) -> str:
    return f"coalesce(list_max(list_transform(list_distinct({items}), lambda u: len(list_filter({items}, lambda v: v = u)))), 0)"


def pairs(w: str) -> str:
    return f"(case when len({w}) > 1 then list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) else [] end)"


def reason(sentence: str, p: Profile = STRICT) -> str:
    """The sentence gate as one expression; the words are computed where they are used."""
    w, low, t = words(sentence), words(f"lower({sentence})"), f"lower({sentence})"
    known = names([*p.vocabulary, *p.extra])
    capital = f"case when not {legal('w')} then 'illegal_name' end" if p.name_shapes else "null"
    bad = f"list_filter(list_transform({w}, lambda w: case when regexp_matches(w, '^[A-Z]') then {capital} when not list_contains({known}, lower(w)) then 'unknown_word' end), lambda r: r is not null)[1]"
    out = [f"when len({w}) = 0 then '{p.blank}'"]
    if p.shortest is not None:
        out.append(f"when len({w}) < {p.shortest} then 'too_short'")
    if p.longest is not None:
        out.append(f"when len({w}) > {p.longest} then 'too_long'")
    m, e = p.predicate, p.object_mark
    out += [
        f"when {bad} is not null then {bad}",
        rf"when regexp_matches({t}, '\b{m}{WS}+{m}\b') then 'double_li'",
        rf"when regexp_matches({t}, '\b{m}{WS}+{e}\b') then 'li_e_error'",
        rf"when regexp_matches({t}, '^{WS}*{m}\b') then 'leading_li'",
        f"when len({w}) >= {p.unigram_from} and {most(low)} * 1.0 / len({w}) > {p.unigram_share} then 'unigram_repetition'",
        f"when len({w}) >= {p.bigram_from} and {most(pairs(low))} > {p.bigram_times} then 'bigram_repetition'",
    ]
    if p.needs_predicate:
        out.append(f"when not list_has_any({low}, {names([m, *p.bare_subjects])}) then 'missing_predicate'")
    return f"(case {' '.join(out)} else '' end)"


def bubble(t: str) -> str:
    part = f"case when {reason('s')} in ('too_short', 'missing_predicate') and list_contains({names(INTERJECTIONS)}, lower(array_to_string({words('s')}, ' '))) then '' else {reason('s')} end"
    first = f"coalesce(list_filter(list_transform({bare_sentences(t)}, lambda s: {part}), lambda r: r <> '')[1], '')"
    return f"""(case when len({bare_sentences(t)}) = 0 then 'empty' when len({words(t)}) > 12 then 'too_long_bubble'
      when regexp_matches(lower({t}), '\\b(mi|sina){WS}+e\\b') then 'subject_e_no_verb'
      when regexp_matches({t}, '(?:^|[^A-Za-z])[A-Z]') then 'proper_name' else {first} end)"""


__all__ = ["HISTORIC_WORDS", "RELAXED", "STRICT", "WORDS", "WS", "bare_sentences", "bubble", "legal", "letter_ratio", "most", "names", "pairs", "reason", "sentences", "squeeze", "strip", "words"]
