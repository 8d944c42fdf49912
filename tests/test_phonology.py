from reedmill.functions.phonology import is_legal_word, latin_to_ucsur, syllables, ucsur_to_latin
from reedmill.functions.script import GLYPH_OF, LONG_NAME_END, LONG_NAME_START, MIDDLE_COLON, MIDDLE_DOT, NAME_END, NAME_START, WORDS


# The golden cases of this file must hold as they are.


def g(*words):
    return "".join(GLYPH_OF[w] for w in words)


def test_syllables(column):
    cases = {
        "mali": ["ma", "li"], "toki": ["to", "ki"], "sonja": ["son", "ja"], "anpa": ["an", "pa"], "a": ["a"], "nnn": ["n", "n", "n"], "krai": ["k", "r", "a", "i"], "": [],
        "kijetesantakalu": ["ki", "je", "te", "san", "ta", "ka", "lu"], "wuwojiti": ["wu", "wo", "ji", "ti"],
    }
    assert column(syllables, list(cases)) == list(cases.values())


def test_legal_words(column):
    good = [*WORDS, "n", "N", "Sonja", "juwi"]
    bad = ["", "tin", "woli", "wuwojiti", "aula", "aa", "panma", "anna", "krai", "toki!", "toki pona!", "pona\n"]
    assert column(is_legal_word, good) == [True] * len(good)
    assert column(is_legal_word, bad) == [False] * len(bad)
    assert len(WORDS) == 137


def test_latin_to_ucsur(column):
    mali = chr(NAME_START) + g("mama", "ala", "luka", "ilo") + chr(NAME_END)
    cases = {
        "mi olin e sina": g("mi", "olin", "e", "sina"), "mi pona. mi wile.": g("mi", "pona") + " " + g("mi", "wile"), "toki? pona!": g("toki") + " " + g("pona"),
        "toki:": g("toki") + chr(MIDDLE_COLON), "mi, sina": g("mi", "sina"), "Mi pona": g("mi", "pona"), "jan Mali li pona": g("jan") + mali + g("li", "pona"),
        "Sonja": chr(NAME_START) + g("suno", "open", "nasin", "jan", "ala") + chr(NAME_END), "hello": "", "": "", "...": "", "Brrr": chr(NAME_START) + chr(NAME_END),
    }
    assert column(latin_to_ucsur, list(cases)) == list(cases.values())


def test_ucsur_to_latin(column):
    name = g("mama", "ala", "luka", "ilo")
    cases = {
        g("mi", "olin", "e", "sina"): "mi olin e sina", g("mi", "pona") + chr(MIDDLE_DOT): "mi pona.", g("toki") + chr(MIDDLE_COLON): "toki:",
        chr(NAME_START) + name + chr(NAME_END): "Mali", chr(LONG_NAME_START) + name + chr(LONG_NAME_END): "Mali", chr(NAME_START) + g("toki", "ala") + chr(NAME_END): "Ta",
        g("tomo") + chr(0xF1995) + g("telo"): "tomo telo", g("kasi") + chr(0xF1996) + g("suwi"): "kasi suwi", g("lawa") + chr(0xF1994) + g("ma"): "lawa ma",
        chr(0xF1997) + g("lawa") + chr(0xF1998) + g("ma"): "lawa ma", chr(NAME_START) + name: "Mali", chr(NAME_START) + name + chr(NAME_START) + g("a") + chr(NAME_END): "Mali A", chr(MIDDLE_DOT) + g("mi"): ". mi",
    }
    assert column(ucsur_to_latin, list(cases)) == list(cases.values())


def test_round_trip(column):
    cases = {"mi pona.": "mi pona", "toki:": "toki:", "mi olin e sina.": "mi olin e sina", "jan Mali li pona.": "jan Mali li pona", "soweli suli li lon ma.": "soweli suli li lon ma", "Sonja li toki.": "Sonja li toki"}
    assert column(lambda c: ucsur_to_latin(latin_to_ucsur(c)), list(cases)) == list(cases.values())
