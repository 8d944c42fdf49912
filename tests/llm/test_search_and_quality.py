"""Problems 6, 8 and 9: brute force, held-out accuracy and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from reedmill.llm import defects, leaks, wordsalad

VOCABULARY = "pona ike suli lili tomo telo waso kala soweli jan moku toki tawa lon nasin mun suno seli lete kili".split()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def clause(rng):
    n = lambda: rng.choice(VOCABULARY)
    return rng.choice([f"{n()} li {n()} e {n()}", f"mi {n()} e {n()} {n()}", f"{n()} {n()} li {n()}", f"tenpo {n()} la ona li {n()} e {n()}"])


def prose(rng, sentences):
    return " ".join(clause(rng) + rng.choice([".", "!", "?"]) for _ in range(sentences))


@pytest.fixture(scope="module")
def leak_data():
    rng = random.Random(8)
    items = [(i, prose(rng, 8)) for i in range(12)]
    docs = [(100 + i, prose(rng, rng.randint(1, 25))) for i in range(150)]
    for i in range(30):
        w = items[i % 12][1].split()
        n = (8, 11, 12, 13, 20)[i % 5]
        a = rng.randrange(len(w) - n)
        part = " ".join(w[a : a + n])
        docs.append((500 + i, f"{prose(rng, 4)} <b>{part.upper().replace(' ', '  ')}</b> {prose(rng, 4)}"))
    return items, docs


def brute(items, docs):
    import re

    words = lambda t: re.findall(r"[^\W\d_]+", re.sub(r"<[^<>]*>", " ", t or "").lower())
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    return sorted({(i, d) for i, t in items for d, x in docs if grams(words(t)) & grams(words(x))})


def test_leaks_equal_brute_force(spark, leak_data):
    items, docs = leak_data
    found = leaks.leaks(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string"),
        doc_id="doc_id", text="text", item_id="item_id", item_text="text",
    )
    want = brute(items, docs)
    assert rows(found.select("item_id", "doc_id")) == want and len(want) >= 15


def test_leak_edge_cases(spark, leak_data):
    items, docs = leak_data
    long = items[0][1] + " " + " ".join(VOCABULARY * 3000)
    odd = [(1, None), (2, ""), (3, "mi"), (4, long), (5, items[1][1]), (5, items[1][1])]
    d, i = spark.createDataFrame(odd, "doc_id long, text string"), spark.createDataFrame([*items, (90, None), (91, "mi pona"), (0, items[0][1])], "item_id long, text string")
    args = {"doc_id": "doc_id", "text": "text", "item_id": "item_id", "item_text": "text"}
    assert rows(leaks.leaks(d, i, **args).select("item_id", "doc_id")) == [(0, 4), (1, 5)]
    assert leaks.leaks(d.limit(0), i, **args).count() == 0 and leaks.leaks(d, i.limit(0), **args).count() == 0
    w = items[2][1].split()
    swapped = " ".join("pi" if k % 9 == 8 else x for k, x in enumerate(w))
    near = leaks.leaks(spark.createDataFrame([(1, swapped)], "doc_id long, text string"), i, paraphrase=0.8, **args)
    best = near.where("item_id = 2").orderBy(F.desc("share")).first()
    assert best.kind == "paraphrase" and best.share > 0.8


def test_bare_runs_in_unlike_surroundings(spark, leak_data):
    rng = random.Random(18)
    items, other = leak_data[0], [f"{a}{b}{c}" for a in ("gro", "fle", "dru", "vez") for b in ("ban", "tiv", "xol", "mer") for c in ("th", "ck", "sh", "nd")]
    docs = [(i, prose(rng, 12)) for i in range(600)]  # the words of the items are common, those of the surroundings rare
    for i in range(60):
        w, page = items[i % 12][1].split(), [rng.choice(other) for _ in range(70)]
        a, at = rng.randrange(len(w) - 12), rng.randrange(58)
        docs.append((1000 + i, " ".join([*page[:at], *w[a : a + 12], *page[at:]])))
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), doc_id="doc_id", text="text", item_id="item_id", item_text="text")
    want = brute(items, docs)
    assert rows(found.select("item_id", "doc_id")) == want and len(want) >= 60


def test_paraphrases_equal_brute_force(spark, leak_data):
    rng = random.Random(28)
    items, other = [*leak_data[0], (50, " ".join(f"{a}{b}" for a in ("ba", "de", "gi") for b in "bcdfghjklmnpqrstvwxyzaeiou"))], [f"{a}{b}{c}" for a in ("gro", "fle") for b in ("ban", "tiv", "xol", "mer") for c in ("th", "ck", "nd")]
    docs = [(i, prose(rng, 12)) for i in range(100)] + [(200, "mi pona"), (201, items[0][1].split()[0])]
    for i in range(52):
        w = items[i % 13][1].split()[:40]
        changed = [rng.choice(other) if k % (6, 10)[i % 2] == 3 else x for k, x in enumerate(w)]
        page, at = [rng.choice(other) for _ in range(60)], rng.randrange(60)
        docs.append((1000 + i, " ".join([*page[:at], *changed, *page[at:]])))
    words = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()

    def best(a, b):
        starts = {*range(0, max(1, len(b) - 47), 12), max(0, len(b) - 48)}
        return max(leaks.common_subsequence(a, b[k : k + 48]) / min(len(a), len(b), 48) for k in starts)

    runs = set(brute(items, docs))
    want = sorted((i, d, s) for i, t in items for d, x in docs if (i, d) not in runs and (s := round(best(words(t), words(x)), 6)) >= 0.6)
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), doc_id="doc_id", text="text", item_id="item_id", item_text="text", paraphrase=0.6)
    assert rows(found.where("kind = 'paraphrase'").select("item_id", "doc_id", F.round("share", 6))) == want
    assert sum(d >= 1000 for _, d, _ in want) >= 52


def test_answers_of_paraphrases(spark, leak_data):
    items = [(i, t, a) for (i, t), a in zip(leak_data[0], ["kili loje", None, "", "waso"], strict=False)]
    docs = []
    for i, t, _ in items:
        w = t.split()[:40]
        changed = " ".join("gro" if k % 9 == 4 else x for k, x in enumerate(w))
        docs += [(10 + i, changed), (20 + i, changed + " zzz Kili, loje! waso")]
    args = {"doc_id": "doc_id", "text": "text", "item_id": "item_id", "item_text": "text", "paraphrase": 0.7, "answer": "answer"}
    out = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, answer string"), **args)
    got = {(r.item_id, r.doc_id): r.answered for r in out.where("kind = 'paraphrase'").collect()}
    assert got[0, 10] is False and got[0, 20] is True and got[1, 11] is None and got[2, 22] is None and got[3, 23] is True


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(12))], [rng.randrange(5) for _ in range(rng.randrange(12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leaks.common_subsequence(a, b) == t[-1][-1]


def test_spam_pages(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(VOCABULARY)
    good = [(i, prose(rng, rng.randint(4, 20))) for i in range(400)]
    lists = [(1000 + i, " | ".join(f"{word()} {word()}" for _ in range(40))) for i in range(8)]
    tags = [(1100 + i, "Tags: " + ", ".join(word() for _ in range(60))) for i in range(4)]
    links = [(1200 + i, " ".join(f"[{word()}](http://www.{word()}-{word()}.example/{word()})" for _ in range(20))) for i in range(4)]
    repeats = [(1300, "telo kala suli " * 50)]
    ends_in_tags = [(1400, prose(rng, 12) + " #pona #tomo http://a.example/b")]
    odd = [(1500, None), (1501, ""), (1502, " \n"), (1503, "123 !"), (1504, "mi")]
    docs = spark.createDataFrame(good + lists + tags + links + repeats + ends_in_tags + odd, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("n", F.lit(2))
    scores = wordsalad.salad_scores(docs, "doc_id", "text")
    assert [r[0] for r in rows(wordsalad.spam_pages(scores).select("doc_id"))] == [i for i, _ in lists + tags + links + repeats]
    assert wordsalad.salad_scores(docs.limit(0), "doc_id", "text").count() == 0


def test_distinct_pairs(spark):
    df = spark.createDataFrame([([(1, 2), (2, 3), (1, 2)],), ([],), (None,)], "p array<struct<a: long, b: long>>")
    assert [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.select(wordsalad.distinct_pairs(F.col("p"))).collect()] == [[(1, 2), (2, 3)], [], None]


def pair_table(rng, n):
    """Sound pairs and known defects: (id, question, answer, defect)."""
    said = {w: f"{w}ish" for w in VOCABULARY}
    out = []
    for i in range(n):
        a, b, c = (rng.choice(VOCABULARY) for _ in range(3))
        q = f"The {said[a]} {said[b]}s a {said[c]} at the house."
        t = f"{a} li {b} e {c} lon tomo."
        kind = rng.choice([None] * 24 + ["empty", "refusal", "copied", "truncated", "other_language"])
        bad = {
            "empty": rng.choice([None, "", "n/a", "-", "(none)"]), "refusal": rng.choice(["Sorry, I can't translate this line.", "Unfortunately, I am unable to help with that"]),
            "copied": rng.choice([q, q.upper(), f'"{q}"', f"{q} {q}", "Sentence: " + q]), "truncated": rng.choice([f"{a} li", f"{a} li {b} e ...", f"{a} li {b} e {c[:2]}-" if len(c) > 3 else f"{a} li {b} e"]),
            "other_language": rng.choice(["La plato encuentra mi jardín siempre.", "Das schlüssel malt die wagen heute."]),
        }
        out.append((i, q, bad.get(kind, t), kind))
    return out


def test_lexicon_has_all_words(spark):
    n = 201_000
    words = spark.range(2 * n).selectExpr(f"concat('wórd', id % {n}) as w").unionAll(spark.createDataFrame([("once",), ("pona",), ("pona",)], "w string"))
    known = defects._frequent(words, 2)
    assert all(f"wórd{i}" in known for i in range(n)) and "pona" in known and "once" not in known and f"wórd{n}" not in known


def test_defects_held_out(spark):
    data = pair_table(random.Random(12), 2500)
    df = spark.createDataFrame([(i, q, a) for i, q, a, _ in data], "rid long, q string, a string").withColumn("defect", F.lit("clash")).withColumn("row_id", F.lit(0))
    others = spark.createDataFrame([(f"I count every {w} and every {v}.",) for w in VOCABULARY for v in VOCABULARY], "text string")
    got = {r.row_id: r.defect for r in defects.defective_pairs(df, tab="t", row_id="rid", question="q", answer="a", toki=True, other_texts=others).collect()}
    want = {i: k for i, _, _, k in data if k}
    hits = sum(got.get(i) == k for i, k in want.items())
    assert hits / len(want) > 0.95 and hits / len(got) > 0.95


def test_defect_edge_cases(spark):
    none = spark.createDataFrame([], "rid long, q string, a string")
    other = spark.createDataFrame([("x",), (None,)], "text string")
    args = {"tab": "t", "row_id": "rid", "question": "q", "answer": "a", "toki": False, "other_texts": other}
    assert defects.defective_pairs(none, **args).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "", ""), (3, None, "I like the sea. " * 20_000), (3, None, None)], "rid long, q string, a string")
    got = rows(defects.defective_pairs(odd, **args).select("row_id", "defect"))
    assert [r for r in got if r[1] == "empty"] == [(1, "empty"), (2, "empty"), (3, "empty")]
    assert defects.is_copy("No.", '"No."') and not defects.is_copy("", "") and not defects.is_copy("a b", "b a")
