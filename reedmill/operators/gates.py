"""Quality gates: Columns that give the reason of the first failing rule, '' for a pass.

A gate is one CASE expression over a words array that Catalyst evaluates once; all language constants are a ``Profile``, so the gates
work for other languages as well.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import most_common
from ..functions.bind import let
from ..functions.phonology import is_legal_word
from ..functions.script import WORDS
from ..functions.text import ascii_words, bare_sentences, copy_key, dedup_key, sentences, squeeze, strip

# Letters, historic words and bare interjections of the language, and the limits of the gates.
LETTERS = "aeijklmnopstuw"
HISTORIC_WORDS = ["ali", "powe", "majuna", "po"]
INTERJECTIONS = [
    "mu", "mu a", "mu mu", "a", "a a", "pona", "pona a", "pona mute", "pona mute a", "toki a", "toki", "o", "ike a", "jaki a",
    "wawa a", "musi a", "suwi a", "epiku a", "pakala", "lili a",
]
BUBBLE_WORDS = 12
LINE_CHARACTERS = r"""[A-Za-z\s.,;:!?'"-]"""


@dataclass(frozen=True)
class Profile:
    """What a gate knows of a language."""

    vocabulary: tuple[str, ...] = tuple(WORDS)
    predicate: str = "li"
    object_mark: str = "e"
    bare_subjects: tuple[str, ...] = ("mi", "sina", "o")
    shortest: int | None = 3
    longest: int | None = 40
    name_shapes: bool = True
    unigram_share: float = 0.4
    unigram_from: int = 0
    bigram_times: int = 2
    bigram_from: int = 0
    needs_predicate: bool = True
    blank: str = "empty"
    extra: tuple[str, ...] = field(default=())


STRICT = Profile()
RELAXED = Profile(shortest=None, longest=None, name_shapes=False, unigram_from=5, bigram_from=4, needs_predicate=False, blank="skip", extra=tuple(HISTORIC_WORDS))


def letter_ratio(text: Column, letters: str = LETTERS) -> Column:
    """Share of letters that are foreign to the language; 0 without letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = F.length(F.regexp_replace(low, r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(low, f"[^{letters}]", ""))
    return F.when(every == 0, F.lit(0.0)).otherwise((every - own) / every)


def bigrams(words: Column) -> Column:
    """Neighbouring words as 'a b'."""

    def pairs(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))

    return let(words, pairs)


def sentence_reason(sentence: Column, p: Profile = STRICT) -> Column:
    """The reason of the first failing rule of a sentence gate. For the relaxed profile, a sentence without words gives 'skip'."""
    bound = F.struct(sentence.alias("s"), ascii_words(sentence).alias("w"), ascii_words(F.lower(sentence)).alias("low"))
    return let(bound, lambda b: let(_first_bad(b["w"], p), lambda bad: _reason(b["s"], b["w"], b["low"], bad, p)))


def _first_bad(words: Column, p: Profile) -> Column:
    """The reason of the first word that can't stand, null if all can."""
    known = [*p.vocabulary, *p.extra]
    bad_word = lambda w: F.when(w.rlike("^[A-Z]"), F.when(~is_legal_word(w), "illegal_name") if p.name_shapes else F.lit(None).cast("string")).when(~F.lower(w).isin(known), "unknown_word")
    return F.try_element_at(F.filter(F.transform(words, bad_word), lambda r: r.isNotNull()), F.lit(1))


def _reason(sentence: Column, words: Column, low: Column, bad: Column, p: Profile) -> Column:
    n, text = F.size(words), F.lower(sentence)
    m, e = p.predicate, p.object_mark
    reason = F.when(n == 0, F.lit(p.blank))
    if p.shortest is not None:
        reason = reason.when(n < p.shortest, "too_short")
    if p.longest is not None:
        reason = reason.when(n > p.longest, "too_long")
    reason = (
        reason.when(bad.isNotNull(), bad)
        .when(text.rlike(rf"(?U)\b{m}\s+{m}\b"), "double_li")
        .when(text.rlike(rf"(?U)\b{m}\s+{e}\b"), "li_e_error")
        .when(text.rlike(rf"(?U)\A\s*{m}\b"), "leading_li")
        .when((n >= p.unigram_from) & (most_common(low) / n > p.unigram_share), "unigram_repetition")
        .when((n >= p.bigram_from) & (most_common(bigrams(low)) > p.bigram_times), "bigram_repetition")
    )
    if p.needs_predicate:
        reason = reason.when(~F.arrays_overlap(low, F.array(*[F.lit(w) for w in (m, *p.bare_subjects)])), "missing_predicate")
    return reason.otherwise("")


def response_reason(text: Column, p: Profile = STRICT) -> Column:
    """The first failing sentence's reason, '' if all pass."""
    reasons = F.transform(sentences(text), lambda s: sentence_reason(s, p))
    return F.coalesce(F.try_element_at(F.filter(reasons, lambda r: r != ""), F.lit(1)), F.lit(""))


def bubble_reason(text: Column, p: Profile = STRICT) -> Column:
    """The gate of short spoken lines: no names, no objects without a verb, whitelisted interjections may be short."""
    words, parts = ascii_words(text), bare_sentences(text)

    def part_reason(s: Column) -> Column:
        r = sentence_reason(s, p)
        waived = r.isin("too_short", "missing_predicate") & F.lower(F.array_join(ascii_words(s), " ")).isin(INTERJECTIONS)
        return F.when(waived, "").otherwise(r)

    first = F.try_element_at(F.filter(F.transform(parts, part_reason), lambda r: r != ""), F.lit(1))
    return (
        F.when(F.size(parts) <= 0, "empty")
        .when(F.size(words) > BUBBLE_WORDS, "too_long_bubble")
        .when(F.lower(text).rlike(r"(?U)\b(mi|sina)\s+e\b"), "subject_e_no_verb")
        .when(F.exists(words, lambda w: w.rlike("^[A-Z]")), "proper_name")
        .otherwise(F.coalesce(first, F.lit("")))
    )


def is_clause(text: Column, p: Profile = STRICT) -> Column:
    """Whether a predicate mark or a subject that does without stands in the text."""
    return F.arrays_overlap(F.transform(ascii_words(text), lambda w: F.lower(w)), F.array(*[F.lit(w) for w in (p.predicate, *p.bare_subjects)]))


def pair_reason(scene: Column, reply: Column, p: Profile = STRICT) -> Column:
    """Gate of a scene and its reply: reply first, then the scene if there is one, its form, and copying."""
    r, s = bubble_reason(reply, p), bubble_reason(scene, p)
    has = F.coalesce(scene, F.lit("")) != ""
    return (
        F.when(r != "", F.concat(F.lit("reply_"), r))
        .when(has & (s != ""), F.concat(F.lit("scene_"), s))
        .when(has & ~is_clause(scene, p), "scene_fragment")
        .when(has & (strip(F.lower(reply)) == strip(F.lower(scene))), "reply_copies_scene")
        .otherwise("")
    )


def looks_like_language(line: Column, vocabulary: list[str]) -> Column:
    """Plain characters only, a lower-case word, and at least 60 % of the lower-case words known."""
    low = F.filter(ascii_words(line), lambda w: w.rlike("^[a-z]"))
    known = F.size(F.filter(low, lambda w: F.lower(w).isin(vocabulary)))
    return line.rlike(rf"(?U)\A{LINE_CHARACTERS}*\z") & (F.size(low) > 0) & (known / F.greatest(F.size(low), F.lit(1)) >= 0.6)


def is_simple_sentence(text: Column, common: list[str], max_words: int = 12, min_common: float = 0.75) -> Column:
    """Short, plain, finished English sentences of mostly common words."""
    s = strip(text)
    words = F.regexp_extract_all(s, F.lit("[A-Za-z']+"), F.lit(0))
    n = F.size(words)
    ok = s.rlike(r"[.!?]\z") & ~s.rlike(r"[^\x00-\x7F]") & ~s.rlike(r"  | \.| ,") & (n >= 3) & (n <= max_words)
    ok &= ~F.exists(words, lambda w: F.length(w) > 13) & ~F.exists(words, lambda w: (F.length(w) == 1) & ~F.lower(w).isin("a", "i"))
    ok &= F.size(F.filter(F.slice(words, 2, 1_000_000), lambda w: w.rlike("^[A-Z]"))) <= 2
    ok &= F.length(F.regexp_replace(s, "[^0-9]", "")) <= 4
    if common:
        ok &= F.size(F.filter(words, lambda w: F.lower(w).isin(common))) / F.greatest(n, F.lit(1)) >= min_common
    return F.coalesce(ok, F.lit(False))


__all__ = [
    "HISTORIC_WORDS", "INTERJECTIONS", "LETTERS", "RELAXED", "STRICT", "Profile", "bigrams", "bubble_reason", "copy_key", "dedup_key", "is_clause",
    "is_simple_sentence", "letter_ratio", "looks_like_language", "most_common", "pair_reason", "response_reason", "sentence_reason", "squeeze",
]
