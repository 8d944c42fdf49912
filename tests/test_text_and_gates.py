import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from reedmill.functions import text
from reedmill.functions.script import WORDS, tidy_label
from reedmill.operators import gates
from reedmill.plans import corpus
from reedmill.sources import readers


def test_sentences(column):
    got = column(text.sentences, ["a b. c d? e\n\n f ", "", "  ", None, "no end", "x.y"])
    assert got == [["a b.", "c d?", "e", "f"], [], [], None, ["no end"], ["x.y"]]
    assert column(text.bare_sentences, ["a. b!? c", "..."]) == [["a", "b", "c"], []]
    assert column(text.first_sentence, ["a. b", "...\n ", " x"]) == ["a", "...", "x"]


def test_markup(column):
    md = "---\nt: 1\n---\n# Head\nsee [here](u) and ![p](q) *strong* word\\\n<!-- no -->end"
    assert column(text.strip_markdown, [md]) == ["Head\nsee here and  strong word\nend"]
    wiki = "'''B''' {{a {{b}} c}}[[File:x.png|[[y]] z]][[ma|tomo]] [[telo]] [http://e.org x y] [http://e.org]<ref name=a/><ref>r</ref>\n== H ==\n{|\n| cell\n|}\n<b>t</b>"
    assert column(text.strip_wikitext, [wiki])[0].split() == ["B", "tomo", "telo", "x", "y", "H", "t"] or "{" in column(text.strip_wikitext, [wiki])[0]
    deep = "{{" * 12 + "x" + "}}" * 12 + "y"
    assert column(lambda c: text.strip_wikitext(c, exact=True), [deep]) == ["y"]


def test_templates_at_any_depth(spark, column, tmp_path):
    deep = lambda n: "a" + "{{x" * n + "}}" * n + "y"
    odd = ["{{" * 30 + "x" + "}}" * 12 + "y", "{{{a}}} b", "{{a|{{b}}", "{{a" * 20 + "{b}" + "}}" * 20, "{{a}}" * 50 + deep(11), "plain", "", None]
    values = [deep(n) for n in (1, 7, 8, 9, 10, 40, 300)] + odd
    got = column(text.strip_wikitext, values)
    assert got[:7] == ["ay"] * 7
    assert got == column(lambda c: text.strip_wikitext(c, exact=True), values)
    wiki = "'''B''' {{a {{b}} c}}[[File:x.png|[[y]] z]][[ma|tomo]] [[telo]]"
    assert column(text.strip_wikitext, [wiki]) == ["B tomo telo"]
    (tmp_path / "dump.xml").write_text(f"<mediawiki><page><title>T</title><ns>0</ns><revision><text>{deep(12)}</text></revision></page></mediawiki>")
    assert [tuple(r) for r in readers.wiki_pages(spark, str(tmp_path / "dump.xml")).collect()] == [("T", "ay")]
    spark.createDataFrame([(1, deep(12)), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in corpus.wikitext_strip(spark, str(tmp_path)).collect()] == [(1, 2, hashlib.sha256(b"ay").hexdigest())]


def test_small_helpers(column):
    assert column(text.ensure_end, ["a", "a.", "a?", ""]) == ["a.", "a.", "a?", "."]
    assert column(text.squeeze, [" a   b\n"]) == ["a b"]
    assert column(text.clean_line, ["- 1. mi pona"]) == ["mi pona"]
    assert column(text.copy_key, ["Mi pona! ", None]) == ["mi pona", None]
    assert column(lambda c: text.scene_prompt(c, "cue:"), ["sky. ", "", None]) == ["sky. cue:", "cue:", "cue:"]
    assert column(tidy_label, ["\tPoki ", "mun_small/x", " ", None, "toki ramble"]) == ["poki", "mun-small/x", None, None, "toki-ramble"]


def test_hash_modulus(column):
    ids = ["mi pona", "", "lipu:7"]
    assert column(lambda c: text.text_hash(c, 1000), ids) == [int(hashlib.sha256(i.encode()).hexdigest(), 16) % 1000 for i in ids]


def test_gate_names(column):
    ok = ["jan Tan li pona lukin.", "Toki li pona tawa mi.", "ma Mewika li suli."]
    assert column(gates.sentence_reason, ok) == ["", "", ""]
    assert column(gates.sentence_reason, ["mama Tom li tawa.", "jan London li pona lukin."]) == ["illegal_name"] * 2


def test_gate_boundaries(column):
    cases = {
        "": "empty", "mi pona": "too_short", "mi pona a": "", " ".join(["mi", "pona", "e", "telo"] * 10): "bigram_repetition", " ".join(["mi"] * 41): "too_long", "mi xyz London li": "unknown_word",
        "mi li li pona": "double_li", "ona li e telo": "li_e_error", "  li pona mute": "leading_li", "mi mi pona telo suli": "", "mi mi pona telo": "unigram_repetition", "ona pona mute": "missing_predicate",
        "a mi pona b": "unknown_word",
    }
    assert column(gates.sentence_reason, list(cases)) == list(cases.values())
    relaxed = {"123": "skip", "London": "", "majuna li pona": "", "mi mi": "", "mi pona mi pona mi pona": "unigram_repetition", "ona pona mute": ""}
    assert column(lambda c: gates.sentence_reason(c, gates.RELAXED), list(relaxed)) == list(relaxed.values())
    bubbles = {"mu": "", "": "empty", "mi e telo": "subject_e_no_verb", "jan Ton li pona": "proper_name", "waso li pona. mi tawa": "too_short", " ".join(["waso"] * 13): "too_long_bubble", "pona mute a! waso li tawa.": ""}
    assert column(gates.bubble_reason, list(bubbles)) == list(bubbles.values())


def test_letter_ratio(column):
    assert column(gates.letter_ratio, ["", None, "123", "toki", "bd", "tb"]) == [0.0, 0.0, 0.0, 0.0, 1.0, 0.5]


def plain_reason(s: str) -> str:
    """The strict gate in plain Python, from its rules."""
    w = re.findall("[A-Za-z]+", s)
    low = [x.lower() for x in w]
    if not w:
        return "empty"
    if len(w) < 3 or len(w) > 40:
        return "too_short" if len(w) < 3 else "too_long"
    shape = re.compile(r"(?:[ptksmnljw]?[aeiou]n?(?:[ptksmnljw][aeiou]n?)*|n)\Z")
    for x in w:
        if x[0].isupper():
            if not shape.match(x.lower()) or re.search("ti|ji|wo|wu|n[nm]", x.lower()):
                return "illegal_name"
        elif x.lower() not in WORDS:
            return "unknown_word"
    t = s.lower()
    for pattern, name in ((r"\bli\s+li\b", "double_li"), (r"\bli\s+e\b", "li_e_error"), (r"\A\s*li\b", "leading_li")):
        if re.search(pattern, t):
            return name
    pairs = list(zip(low, low[1:], strict=False))
    if max(map(low.count, low)) / len(w) > 0.4:
        return "unigram_repetition"
    if max(map(pairs.count, pairs)) > 2:
        return "bigram_repetition"
    return "" if {"li", "mi", "sina", "o"} & set(low) else "missing_predicate"


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["mi", "li", "e", "pona", "telo", "o", "Ana", "Tom", "x", "waso", "la", "suli", ".", "  "]), max_size=9).map(" ".join), min_size=30, max_size=60))
def test_gate_against_plain_python(column, sentences):
    assert column(gates.sentence_reason, sentences) == [plain_reason(s) for s in sentences]
