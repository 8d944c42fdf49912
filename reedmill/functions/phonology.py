"""Syllables, legal word shapes and transliteration as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import GLYPH_OF, IGNORED_MARKS, LETTER_WORDS, LONG_NAME_END, LONG_NAME_START, MIDDLE_COLON, MIDDLE_DOT, NAME_END, NAME_START, WORD_OF, literal_map

# Consonants, vowels and the syllables that no word may have.
CONSONANTS, VOWELS = "ptksmnljw", "aeiou"
FORBIDDEN = "ti|ji|wo|wu"

LEGAL = f"^(?!.*(?:{FORBIDDEN}))(?!.*n[nm])(?:[{CONSONANTS}]?[{VOWELS}]n?(?:[{CONSONANTS}][{VOWELS}]n?)*|n)\\z"
SYLLABLE = f"(?s)[{CONSONANTS}]?[{VOWELS}](?:n(?![{VOWELS}n]))?|."


def is_legal_word(word: Column) -> Column:
    """Whether a word could be Toki Pona by its sounds."""
    return F.lower(word).rlike(LEGAL)


def syllables(word: Column) -> Column:
    """Greedy syllables; a letter that fits none stands alone."""
    return F.regexp_extract_all(F.lower(word), F.lit(SYLLABLE), F.lit(0))


def latin_to_ucsur(text: Column) -> Column:
    """Glyphs of a Latin text: known words, names in cartouches, end marks as one blank, colons kept, the rest dropped."""
    letters = literal_map({k: GLYPH_OF[w] for k, w in LETTER_WORDS.items()})
    words = literal_map(GLYPH_OF)
    name = lambda t: F.array_join(F.filter(F.transform(F.split(F.lower(t), ""), lambda c: letters[c]), lambda g: g.isNotNull()), "")
    glyphs = lambda t: (
        F.when(t.rlike("^[.!?]$"), F.lit(" "))
        .when(t == ":", F.lit(chr(MIDDLE_COLON)))
        .when(t == ",", F.lit(""))
        .when(words[F.lower(t)].isNotNull(), words[F.lower(t)])
        .when(t.rlike("^[A-Z]"), F.concat(F.lit(chr(NAME_START)), name(t), F.lit(chr(NAME_END))))
        .otherwise(F.lit(""))
    )
    tokens = F.regexp_extract_all(text, F.lit("[A-Za-z]+|[.!?:,]"), F.lit(0))
    return F.trim(F.regexp_replace(F.array_join(F.transform(tokens, glyphs), ""), " +", " "))


def ucsur_to_latin(text: Column) -> Column:
    """Latin words of a glyph text. Cartouches give capitalised acrostics, dots and colons join the word before, joiners only part words.

    The states are told apart by a fold over the code points: letters of the open name (null outside) and the words so far.
    """
    words = literal_map(WORD_OF)
    capital = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("name"))
    opening, closing = [chr(NAME_START), chr(LONG_NAME_START)], [chr(NAME_END), chr(LONG_NAME_END)]
    ended = lambda s: F.when(F.coalesce(s["name"], F.lit("")) != "", F.array_append(s["out"], capital(s["name"]))).otherwise(s["out"])

    def attach(s: Column, mark: str) -> Column:
        n = F.size(s["out"])
        return F.when(n > 0, F.concat(F.slice(s["out"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(s["out"], F.lit(-1)), F.lit(mark))))).otherwise(F.array(F.lit(mark)))

    def step(s: Column, ch: Column) -> Column:
        word, none = words[ch], F.lit(None).cast("string")
        state = lambda out, name: F.struct(out.alias("out"), name.alias("name"))
        return (
            F.when(ch.isin(*opening), state(ended(s), F.lit("")))
            .when(ch.isin(*closing), state(ended(s), none))
            .when(ch.isin(*map(chr, IGNORED_MARKS)), s)
            .when(ch.isin(chr(MIDDLE_DOT), chr(MIDDLE_COLON)) & s["name"].isNotNull(), s)
            .when(ch == chr(MIDDLE_DOT), state(attach(s, "."), s["name"]))
            .when(ch == chr(MIDDLE_COLON), state(attach(s, ":"), s["name"]))
            .when(word.isNull(), s)
            .when(s["name"].isNotNull(), state(s["out"], F.concat(s["name"], F.substring(word, 1, 1))))
            .otherwise(state(F.array_append(s["out"], word), s["name"]))
        )

    return F.aggregate(F.split(text, ""), zero, step, lambda s: F.array_join(ended(s), " "))
