"""Column builders for text: trimming, markup removal, splitting, tokenising, prompts and chat turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .bind import let

# Fixed values: (pattern, replacement) steps of each markup in the order in which they apply; Java syntax.
MARKDOWN_STEPS = [
    (r"(?s)\A---\n.*?\n---\n", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?Um)^#+\s*", ""),
    (r"[*_]{1,3}([^*_\n]+)[*_]{1,3}", "$1"),
    (r"(?Um)\\\s*$", ""),
]
WIKI_BLOCKS = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<ref[^>]*?>.*?</ref>", ""),
    (r"(?i)<ref[^>]*?/>", ""),
    (r"(?is)<(nowiki|gallery|math|syntaxhighlight|source|pre|code|score|timeline)[^>]*?>.*?</\1>", ""),
]
WIKI_TEMPLATE = r"(?s)\{\{[^{}]*?\}\}"
WIKI_STEPS = [
    (r"(?i)\[\[(?:File|Image|sitelen):[^\[\]]*?(?:\[\[[^\[\]]*?\]\][^\[\]]*?)*\]\]", ""),
    (r"\[\[[a-z\-]{2,12}:[^\]]*?\]\]", ""),
    (r"\[\[[^\[\]|]+\|([^\[\]]+)\]\]", "$1"),
    (r"\[\[([^\[\]|]+)\]\]", "$1"),
    (r"(?U)\[https?://\S+\s+([^\]]+)\]", "$1"),
    (r"(?U)\[https?://\S+\]", ""),
    (r"(?m)^[!|].*$", ""),
    (r"(?m)^\{\||^\|\}|^\|-.*$", ""),
    (r"(?Um)^=+\s*(.*?)\s*=+\s*$", "$1"),
    (r"'{2,5}", ""),
    (r"</?[a-zA-Z][^>]*>", ""),
    (r"\n{3,}", "\n\n"),
]
# A tag and the end of a sentence.
HTML_TAG = r"</?[a-zA-Z][^>]*>"
SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n+"
TEMPLATE_DEPTH = 8


def strip(text: Column) -> Column:
    """Without outer white space of any kind (``trim`` takes off blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Words joined by single blanks."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def dedup_key(text: Column) -> Column:
    """Hash of the text in lower case with single blanks."""
    return F.sha2(F.regexp_replace(strip(F.lower(text)), r"(?U)\s+", " "), 256)


def _apply(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def strip_markdown(text: Column) -> Column:
    return strip(_apply(text, MARKDOWN_STEPS))


def strip_templates(text: Column, depth: int = TEMPLATE_DEPTH) -> Column:
    """Innermost {{...}} removed until nothing changes: ``depth`` times unrolled, then in a loop for the rows that still hold one (told by ``has_template``)."""
    once = lambda t: F.regexp_replace(t, WIKI_TEMPLATE, "")
    passes = lambda t: F.sequence(F.lit(1), F.size(F.split(t, r"\{\{")))  # noqa: E731  (each pass takes a {{ away or is the last)
    step = lambda a, _: F.when(a["on"], let(once(a["t"]), lambda n: F.struct(n.alias("t"), (n != a["t"]).alias("on")))).otherwise(a)
    rest = lambda t: F.aggregate(passes(t), F.struct(t.alias("t"), F.lit(True).alias("on")), step)["t"]
    return let(reduce(lambda t, _: once(t), range(depth), text), lambda t: F.when(has_template(t), rest(t)).otherwise(t))


def has_template(text: Column) -> Column:
    return text.rlike(WIKI_TEMPLATE)


@F.pandas_udf(StringType())
def strip_templates_exactly(texts):  # noqa: ANN001, ANN201
    """Fixpoint of the template removal in Python."""
    import regex

    inner = regex.compile(r"\{\{[^{}]*?\}\}", regex.S)

    def flat(t: str | None) -> str | None:
        while t is not None and (n := inner.sub("", t)) != t:
            t = n
        return t

    return texts.map(flat, na_action="ignore")


def strip_wikitext(text: Column, exact: bool = False) -> Column:
    """Plain text of wiki markup; no bound on template nesting. exact: templates are removed in a Python stage, with the same result."""
    plain = _apply(text, WIKI_BLOCKS)
    plain = strip_templates_exactly(plain) if exact else strip_templates(plain)
    return strip(_apply(plain, WIKI_STEPS))


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def sentences(text: Column) -> Column:
    """Sentences with their end marks; split behind an end mark or at line ends."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def bare_sentences(text: Column) -> Column:
    """Sentences without end marks."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: s != "")


def first_sentence(text: Column) -> Column:
    """First bare sentence, else the first line with content, else the trimmed text."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    return F.coalesce(F.try_element_at(bare_sentences(text), F.lit(1)), F.try_element_at(lines, F.lit(1)), strip(text))


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))


def lower_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def apostrophe_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0))


def ensure_end(text: Column) -> Column:
    """With a full stop unless an end mark stands there."""
    return F.when(text.rlike(r"[.!?]\z"), text).otherwise(F.concat(text, F.lit(".")))


def clean_line(text: Column) -> Column:
    """A model's output line without bullet or number in front."""
    return F.regexp_replace(strip(text), r"^[-*0-9.) ]+", "")


def copy_key(text: Column) -> Column:
    """For comparing an answer with its source: lower case without outer end marks and blanks."""
    return F.btrim(F.lower(text), F.lit(".!? "))


def text_hash(text: Column, modulus: int) -> Column:
    """The SHA-256 of the text as a whole number, modulo a small number, folded digit by digit."""
    digits = F.transform(F.split(F.sha2(text, 256), ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + d) % modulus)


def hash_order(seed: int, *cols: Column) -> Column:
    """A reproducible shuffle key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


def chat_turns(messages: Column, *, bos: str = "<bos>", ask: bool = False) -> Column:
    """Role-tagged turns of a chat; assistant turns are named model, unknown roles are left out."""
    role = lambda m: F.when(m["role"].isin("assistant", "model"), "model").otherwise(m["role"])
    kept = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant", "model"))
    turns = F.array_join(F.transform(kept, lambda m: F.concat(F.lit("<|turn>"), role(m), F.lit("\n"), m["content"], F.lit("<turn|>\n"))), "")
    return F.concat(F.lit(bos), turns, F.lit("<|turn>model\n" if ask else ""))


def scene_prompt(scene: Column, cue: str) -> Column:
    """The cue, after the scene if there is one."""
    bare = F.rtrim(strip(F.coalesce(scene, F.lit(""))), F.lit("."))
    return F.when(bare == "", F.lit(cue)).otherwise(F.concat(bare, F.lit(". " + cue)))


def framed_example(scene: Column, reply: Column, cue: str) -> Column:
    return F.concat(scene_prompt(scene, cue), F.lit(" "), strip(reply))
