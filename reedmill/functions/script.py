"""Toki Pona words, their glyphs, and Column builders that bring both scripts to one form."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in the order of their code points, and the script's structural code points.
BASE_WORDS = """
a akesi ala alasa ale anpa ante anu awen e en esun ijo ike ilo insa jaki jan jelo jo kala kalama kama kasi ken
kepeken kili kiwen ko kon kule kulupu kute la lape laso lawa len lete li lili linja lipu loje lon luka lukin lupa
ma mama mani meli mi mije moku moli monsi mu mun musi mute nanpa nasa nasin nena ni nimi noka o olin ona open
pakala pali palisa pan pana pi pilin pimeja pini pipi poka poki pona pu sama seli selo seme sewi sijelo sike sin
sina sinpin sitelen sona soweli suli suno supa suwi tan taso tawa telo tenpo toki tomo tu unpa uta utala walo wan
waso wawa weka wile
""".split()
LATER_WORDS = """
namako kin oko kipisi leko monsuta tonsi jasima kijetesantakalu soko meso epiku kokosila lanpan n misikeke ku
""".split()
FIRST_GLYPH = 0xF1900
NAME_START, NAME_END, LONG_NAME_START, LONG_NAME_END = 0xF1990, 0xF1991, 0xF1992, 0xF1993
IGNORED_MARKS = (0xF1994, 0xF1995, 0xF1996, 0xF1997, 0xF1998)
MIDDLE_DOT, MIDDLE_COLON = 0xF199C, 0xF199D
LETTER_WORDS = {
    "a": "ala", "e": "esun", "i": "ilo", "o": "open", "u": "uta", "p": "pona", "t": "toki", "k": "kala", "s": "suno",
    "m": "mama", "n": "nasin", "l": "luka", "j": "jan", "w": "waso",
}

WORDS = BASE_WORDS + LATER_WORDS
GLYPH_OF = {w: chr(FIRST_GLYPH + i) for i, w in enumerate(WORDS)}
WORD_OF = {g: w for w, g in GLYPH_OF.items()}

#: Any code point of the glyph block.
GLYPHS = r"[\x{F1900}-\x{F19FF}]"


def literal_map(pairs: dict[str, str]) -> Column:
    """A map literal."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def glyphs_to_latin(text: Column) -> Column:
    """Each glyph becomes its Latin word between spaces; other glyph-block code points become a space. Text without glyphs is passed as it is."""
    spaced = F.array_join(
        F.transform(F.split(text, ""), lambda ch: F.coalesce(literal_map({g: f" {w} " for g, w in WORD_OF.items()})[ch], ch)), ""
    )
    return F.when(text.rlike(GLYPHS), F.regexp_replace(spaced, GLYPHS, " ")).otherwise(text)


def letter_words(text: Column) -> Column:
    """Lower-case runs of letters, glyphs as their words; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(glyphs_to_latin(text)), F.lit(r"\p{L}+"), F.lit(0)), F.array().cast("array<string>"))


def alnum_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, glyphs as their words; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(glyphs_to_latin(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def tidy_label(label: Column) -> Column:
    """One spelling of a label: no outer or invisible space, lower case, hyphen for underscore and inner space. Null and blank become null."""
    bare = F.regexp_replace(F.lower(label), r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")
    return F.nullif(F.regexp_replace(bare, r"(?U)[\s_]+", "-"), F.lit(""))
