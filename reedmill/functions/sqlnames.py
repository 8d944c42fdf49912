"""The public functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .phonology import LEGAL, SYLLABLE
from .script import GLYPH_OF, IGNORED_MARKS, LETTER_WORDS, LONG_NAME_END, LONG_NAME_START, MIDDLE_COLON, MIDDLE_DOT, NAME_END, NAME_START, WORD_OF


def _map(pairs: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs.items()) + ")"


def register_sql(spark: SparkSession) -> list[str]:
    """Makes is_legal_word, syllabify, latin_to_ucsur and ucsur_to_latin known to SQL; they are SQL functions, which Catalyst inlines."""
    letters = _map({k: GLYPH_OF[w] for k, w in LETTER_WORDS.items()})
    name = f"array_join(filter(transform(split(lower(t), ''), c -> {letters}[c]), g -> g is not null), '')"
    glyphs = (
        f"case when t rlike '^[.!?]$' then ' ' when t = ':' then '{chr(MIDDLE_COLON)}' when t = ',' then '' when {_map(GLYPH_OF)}[lower(t)] is not null then {_map(GLYPH_OF)}[lower(t)] "
        f"when t rlike '^[A-Z]' then concat('{chr(NAME_START)}', {name}, '{chr(NAME_END)}') else '' end"
    )
    to_glyphs = f"trim(regexp_replace(array_join(transform(regexp_extract_all(x, '[A-Za-z]+|[.!?:,]', 0), t -> {glyphs}), ''), ' +', ' '))"
    opening, closing, ignored = f"'{chr(NAME_START)}', '{chr(LONG_NAME_START)}'", f"'{chr(NAME_END)}', '{chr(LONG_NAME_END)}'", ", ".join(f"'{chr(c)}'" for c in IGNORED_MARKS)
    dot, colon, word = chr(MIDDLE_DOT), chr(MIDDLE_COLON), f"{_map(WORD_OF)}[c]"
    ended = "if(coalesce(s.name, '') <> '', array_append(s.out, concat(upper(substr(s.name, 1, 1)), substr(s.name, 2))), s.out)"
    state = lambda out, nm: f"struct({out} as out, {nm} as name)"
    attach = lambda m: f"if(size(s.out) > 0, concat(slice(s.out, 1, greatest(size(s.out) - 1, 0)), array(concat(try_element_at(s.out, -1), '{m}'))), array('{m}'))"
    step = (
        f"case when c in ({opening}) then {state(ended, repr(''))} when c in ({closing}) then {state(ended, 'cast(null as string)')} when c in ({ignored}) then s "
        f"when c in ('{dot}', '{colon}') and s.name is not null then s when c = '{dot}' then {state(attach('.'), 's.name')} when c = '{colon}' then {state(attach(':'), 's.name')} "
        f"when {word} is null then s when s.name is not null then {state('s.out', f'concat(s.name, substr({word}, 1, 1))')} else {state(f'array_append(s.out, {word})', 's.name')} end"
    )
    to_latin = f"aggregate(split(x, ''), struct(cast(array() as array<string>) as out, cast(null as string) as name), (s, c) -> {step}, s -> array_join({ended}, ' '))"
    legal, syllable = LEGAL.replace("\\", "\\\\"), SYLLABLE.replace("\\", "\\\\")
    bodies = {
        "is_legal_word": ("boolean", f"lower(x) rlike '{legal}'"), "syllabify": ("array<string>", f"regexp_extract_all(lower(x), '{syllable}', 0)"),
        "latin_to_ucsur": ("string", to_glyphs), "ucsur_to_latin": ("string", to_latin),
    }
    for fn, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {fn}(x STRING) RETURNS {kind.upper()} RETURN {body}")
    return list(bodies)
