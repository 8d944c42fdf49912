"""Problem 6: unusable answers in prompt and response pairs.

A multi-label linear classifier (one logistic model a defect) on hashed word n-grams of the answer and features of the pair: how much
of each side stands in the other, the share of words of the wanted language, how the answer ends. It is trained on a bounded sample of
rows (SAMPLE_ROWS a table, the rows of smallest hash) whose answers are taken as sound, and on synthetic defects made from them: emptied, refused,
copied, cut off and swapped into another language. Sample rows that look defective to a model trained on the other half are dropped
first; their share is the estimate of how frequent the defect is. The threshold of each defect is the one of best F1 on held-out rows, weighted so that defects are as
frequent as that, without sound rows that look defective even so. Where a defect is exactly defined (empty, copied) the threshold is a tenth of the lowest score of a held-out defect, as an exact check of the finds follows.

All tables' classifiers are trained at once, each in a task of its own, and kept in the checkpoint folder. Every row of the tables is then scored; word counts behind
the features cover all rows.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.script import WORD_OF, WORDS
from ..session import cut_lineage

DEFECTS = ("empty", "refusal", "copied", "truncated", "other_language")
#: Groups of features, and the groups by which each defect may be told, so that words of rows wrongly taken as sound can't excuse them.
PAIR, WORDING, LANGUAGE, ENDING = range(4)
TOLD_BY = ((PAIR,), (PAIR, WORDING, LANGUAGE, ENDING), (PAIR,), (PAIR, WORDING, LANGUAGE, ENDING), (PAIR, LANGUAGE))
SAMPLE_ROWS = 12_000
MEMO_WORDS = 200_000
CHECKED = ("empty", "copied")
DIRTY = 0.3  # a row taken as sound that scores above is taken for neither
BITS = 18
CLEANING_ROUNDS = 2
SOUND_SHARE = 0.2
RAREST = 4
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*")
EDGE = regex.compile(r"^[\s\p{Cf}]+|[\s\p{Cf}]+$")
DOTS = regex.compile(r"\s*(?:\.\s?){2,}")
CLOSING = regex.compile(r"[\"'”»)\]*_’]+$")
TOKI = frozenset(WORDS)
GLYPH_TABLE = {ord(g): f" {w} " for g, w in WORD_OF.items()}
#: What stands for nothing (compared without case and punctuation).
NOTHING = frozenset(["", "n a", "na", "none", "null", "nil", "nan", "empty", "blank", "nothing", "tbd", "todo", "undefined", "no answer", "no response", "no reply"])
PARTICLES = frozenset("li e la pi".split())
#: English words that hold sentences together.
ENGLISH = frozenset("""
a an the this that these those my your his her its our their i you he she it we they me him us them am is are was were be been do does did have has had
will would can could may might must shall should not no and or but if so as at by for from in into near of off on over than then to under up with without
what who where when why how there here every each some any all such very too let
""".split())


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(GLYPH_TABLE).lower().replace("’", "'"))


def bucket(x: float) -> int:
    return int(x * 5 + 1e-9)


class HashedWords:
    """A set of words as sorted 64-bit hashes: 8 bytes a word, so that all words of a large table fit."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.memo = np.unique(hashes.astype(np.int64)), {}

    def __contains__(self, word: str) -> bool:
        known = self.memo.get(word)
        if known is None:
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big", signed=True)
            at = int(np.searchsorted(self.hashes, h))
            known = at < len(self.hashes) and int(self.hashes[at]) == h
            if len(self.memo) >= MEMO_WORDS:  # only of answers given before
                self.memo.clear()
            self.memo[word] = known
        return known

    def __or__(self, other: HashedWords) -> HashedWords:
        return HashedWords(np.concatenate([self.hashes, other.hashes]))

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "memo": {}}


class _Words(dict):
    """What is known of a word: (in the wanted language, asked, Toki Pona, English); kept for the words met before."""

    def __init__(self, lex: Lexicons):
        super().__init__()
        self.lex = lex

    def __missing__(self, w: str) -> tuple[bool, bool, bool, bool]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        toki, asked = w in TOKI, w in self.lex.asked
        self[w] = found = (toki if self.lex.toki else asked, asked, toki, w in ENGLISH or "'" in w)
        return found


class _Ids(dict):
    """Numbers of features, (group, name, ...) each; kept for those met before."""

    def __missing__(self, key: tuple) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[key] = found = zlib.crc32(" ".join(map(str, key[1:])).encode()) & ((1 << BITS) - 4) | key[0]
        return found


class Lexicons:
    """seen: words that occur inside answers or in questions; asked: words of questions."""

    def __init__(self, seen: frozenset[str], asked: frozenset[str], toki: bool):
        self.seen, self.asked, self.toki = seen, asked, toki
        self.words, self.ids = _Words(self), _Ids()

    def __getstate__(self) -> dict:
        return {"seen": self.seen, "asked": self.asked, "toki": self.toki}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)


def is_nothing(answer: str | None) -> bool:
    return " ".join(words_of(answer or "")) in NOTHING


def repeats_question(q: list[str], a: list[str], label: bool) -> bool:
    """The answer's words are the question's once or more, perhaps behind a label of up to two words."""
    if not q or not a:
        return False
    for skip in range(3 if label else 1):
        k, over = divmod(len(a) - skip, len(q))
        if k > 0 and not over and a[skip:] == q * k:
            return True
    return "".join(q) == "".join(a)


def is_copy(question: str | None, answer: str | None) -> bool:
    """The answer is the question once or more, perhaps behind a label with a colon."""
    return repeats_question(words_of(question or ""), words_of(answer or ""), ":" in (answer or ""))


def features(question: str | None, answer: str | None, lex: Lexicons) -> list[int]:
    """Hashed features of one pair."""
    raw = DOTS.sub("…", EDGE.sub("", answer or ""))
    a, q = words_of(raw), words_of(question or "")
    n, ids, words = len(a), lex.ids, lex.words
    out = [ids[PAIR, "bias"], ids[PAIR, "n", min(n, 5)]]
    if n <= 3:
        whole = " ".join(a)
        out.append(ids[WORDING, "whole", whole])
        if whole in NOTHING:
            out.append(ids[PAIR, "nothing"])
    if not a:
        return out
    left: dict[str, int] = {}
    for w in q:
        left[w] = left.get(w, 0) + 1
    common = same = own = asked = toki = english = 0
    for w in a:
        if w in left:
            same += 1
            if left[w]:
                left[w] -= 1
                common += 1
        i = words[w]
        own, asked, toki, english = own + i[0], asked + i[1], toki + i[2], english + i[3]
    ra, rq, rs = bucket(common / n), bucket(common / max(1, len(q))), bucket(same / n)
    out += [ids[PAIR, "ra", ra], ids[PAIR, "rq", rq], ids[PAIR, "rr", ra, rq], ids[PAIR, "in", rs, min(3, n // max(1, len(q)))]]
    if q and set(a) == set(q):
        out.append(ids[PAIR, "same words"])
    if repeats_question(q, a, ":" in raw):
        out.append(ids[PAIR, "copy"])
    o, s, t, e = bucket(own / n), bucket(asked / n), bucket(toki / n), bucket(english / n)
    out += [ids[LANGUAGE, "english", e], ids[LANGUAGE, "which", o, t, e], ids[LANGUAGE, "own", o], ids[LANGUAGE, "asked", s], ids[LANGUAGE, "toki", t], ids[LANGUAGE, "langs", o, t]]
    out += [ids[WORDING, "u", w] for w in a]
    out += [ids[WORDING, "b", x, y] for x, y in zip(a, a[1:], strict=False)]
    end = raw[-1] if not raw[-1].isalnum() else "w"
    closed = CLOSING.sub("", raw)
    mark = closed[-1] if closed and not closed[-1].isalnum() else "w"
    last, known = a[-1], a[-1] in lex.seen
    out += [ids[WORDING, "first", *a[:1]], ids[WORDING, "first", *a[:2]], ids[WORDING, "last", last], ids[WORDING, "last", last, mark], ids[WORDING, "last2", *a[-2:]], ids[WORDING, "last3", *a[-3:]]]
    out += [ids[ENDING, "end", end], ids[ENDING, "mark", mark], ids[ENDING, "known", known], ids[ENDING, "known", known, mark], ids[ENDING, "len", len(last) < 3, known, mark]]
    out += [ids[WORDING, "lastq", last, w] for w in q[-3:]]
    return list(set(out))


# --- synthetic defects -------------------------------------------------------------------------------------------------------------

STANDINS = [None, "", " ", "\n", "​", " ", "-", "—", "...", "…", "n/a", "N/A", "none", "None", "null", "NULL", "(none)", "(empty)", "[ ]", "[]", '""', "?", "nil", "TBD", "{}", "blank"]
OPENERS = ["", "", "Sorry, ", "I'm sorry, but ", "I am sorry, ", "I apologize. ", "I apologize, but ", "Unfortunately, ", "Regrettably ", "Hmm. ", "As a language model, ", "As an AI, ", "Apologies, "]
MODALS = ["I can't", "I cannot", "I won't", "I am unable to", "I'm unable to", "I'm not able to", "I am not able to", "it is not possible for me to", "I must decline to", "I have to decline to"]
TASKS = ["answer", "translate", "respond to", "help with", "process", "continue", "render", "write a line for", "complete", "reply to", "assist with"]
THINGS = ["this", "that", "this line", "this sentence", "this request", "this input", "this text", "your request"]
TAILS = ["", "", "", " as asked", " without more context", " at this time"]
LABELS = ["Sentence: ", "Answer: ", "BIRD: ", "SCENE: ", "English: ", "Text: ", "Q: ", "A: "]
MARKS = ["", "", ".", "!"]


def refused(rng: random.Random) -> str:
    s = f"{rng.choice(OPENERS)}{rng.choice(MODALS)} {rng.choice(TASKS)} {rng.choice(THINGS)}{rng.choice(TAILS)}{rng.choice(MARKS)}"
    return dressed(s[0].upper() + s[1:], rng, 0.2)


def dressed(s: str, rng: random.Random, share: float) -> str:
    """Harmless changes of form."""
    if rng.random() > share:
        return s
    k = rng.randrange(8)
    return [s.upper, s.lower, s.title, lambda: f'"{s}"', lambda: f"“{s}”", lambda: f"({s})", lambda: f"> {s}", lambda: s.replace(" ", " ")][k]()


def copied(question: str, rng: random.Random) -> str:
    k = rng.randrange(5)
    bare = question.rstrip(".!? ")
    return [lambda: question, lambda: f"{question} {question}", lambda: rng.choice(LABELS) + question, lambda: bare + rng.choice(["", ".", "!", "…", ";"]), lambda: dressed(question, rng, 1.0)][k]()


def truncated(answer: str, rng: random.Random, toki: bool) -> str | None:
    """The answer cut off inside a word or behind a word that can't end a sentence."""
    spots = [(m.start(), m.end()) for m in WORD.finditer(answer)]
    if len(spots) < 3:
        return None
    if rng.random() < 0.5:
        start, end = rng.choice(spots[1:])
        if end - start < 3:
            return None
        cut = answer[: rng.randrange(start + 2 if end - start > 3 else start + 1, end)]
    else:
        open_words = [e for (s, e), (s2, _) in zip(spots, spots[1:], strict=False) if ((w := answer[s:e].lower()) in PARTICLES or not toki and w in {"a", "an", "the", "and", "to", "my", "your", "of", "with", "in", "so", "by", "i", "every", "near", "on", "behind", "as"}) and answer[e:s2].isspace()]
        if not open_words:
            return None
        cut = answer[: rng.choice(open_words)]
    return cut + rng.choice(["", "", "", "-", ",", "…", " ...", ";", "—"])


def ended(answer: str, rng: random.Random) -> str:
    """The whole answer with another end, which is no defect."""
    return answer.rstrip(" .!?…") + rng.choice(["", "", "…", "...", " …", "!", "."])


def foreign(text: str, own: list[str], rng: random.Random) -> str:
    """Words of no known language: the letters of a text exchanged by a random rule. Up to a third are words of the wanted language, as languages share some."""
    vowels, others = list("aeiouáéíóúäöü"), list("bcdfghjklmnpqrstvwxyzñçŝĉ")
    to = {v: rng.choice(vowels) for v in "aeiou"} | {c: rng.choice(others) for c in "bcdfghjklmnpqrstvwxyz"}
    parts = "".join(to.get(c, c) for c in text.lower()).split(" ")
    for _ in range(rng.randrange(len(parts) // 3 + 1) if own else 0):
        parts[rng.randrange(len(parts))] = rng.choice(own)
    s = " ".join(parts)
    return s[:1].upper() + s[1:]


def synthetic(rows: list[tuple[str | None, str | None]], others: list[str], toki: bool, rng: random.Random) -> list[tuple[str | None, str | None, tuple[int, ...]]]:
    """(question, answer, labels) made of sound rows, sound ones with another end among them. others: sentences in the languages that answers must not be in."""
    out = []
    away = (4,) if toki else ()
    for q, a in rows:
        if a and rng.random() < SOUND_SHARE:
            out.append((q, ended(a, rng), ()))
        k = rng.random()
        if k < 0.08:
            out.append((q, rng.choice(STANDINS), (0,)))
        elif k < 0.35:
            out.append((q, refused(rng), (1, *away)))
        elif k < 0.5:
            if q and words_of(q):
                out.append((q, copied(q, rng), (2, *away)))
        elif k < 0.8:
            t = truncated(a or "", rng, toki)
            if t:
                out.append((q, t, (3,)))
        elif others and k < 0.92:
            out.append((q, dressed(rng.choice(others), rng, 0.2), (4,)))
        else:
            out.append((q, foreign(rng.choice(others) if others else a or "", words_of(a or ""), rng), (4,)))
    return out


# --- the linear model --------------------------------------------------------------------------------------------------------------


def fit_linear(rows: list[list[int]], labels: np.ndarray, rounds: int = 40, penalty: float = 1e-5) -> np.ndarray:
    """Weights (features x labels) by full-batch Adam on the logistic loss, a label at a time over the features by which it may be told."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    cols = np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum()))
    row = np.repeat(np.arange(len(rows)), lengths)
    rare = (cols & 3 == WORDING) & (np.bincount(cols, minlength=1 << BITS)[cols] < RAREST)  # else single rows would be learnt by heart
    out = np.zeros((1 << BITS, labels.shape[1]), np.float32)
    for j in range(labels.shape[1]):
        own = np.isin(cols & 3, TOLD_BY[j]) & ~rare
        used, col = np.unique(cols[own], return_inverse=True)
        at, y = row[own], labels[:, j].astype(np.float64)
        w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
        for t in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[col], len(rows)), -30, 30)))
            g = np.bincount(col, (p - y)[at], len(used)) / len(rows) + penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        out[used, j] = w
    return out


def scores(weights: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    z = np.add.reduceat(weights[np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum()))], np.cumsum(lengths) - lengths, axis=0)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def threshold(p: np.ndarray, y: np.ndarray, frequency: float) -> float:
    """The threshold of best F1 where the defect has that frequency, in the middle between the scores on its two sides.

    Held-out rows taken as sound that score above DIRTY count as neither: the sample isn't labelled, and a few of them are defective.
    """
    sure = (y > 0) | (p <= DIRTY)
    p, y = p[sure], y[sure]
    order = np.argsort(-p)
    positives, negatives = max(1.0, float(y.sum())), max(1.0, float((1 - y).sum()))
    tp, fp = np.cumsum(y[order]) / positives * frequency, np.cumsum(1 - y[order]) / negatives * (1 - frequency)
    i = int(np.argmax(2 * tp / (tp + fp + frequency + 1e-12)))
    return float((p[order][i] + p[order][min(i + 1, len(p) - 1)]) / 2)


def lossless(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold that all held-out defects reach, with room for unlike ones: a tenth of the lowest score. 0, which leaves all to the exact check, where few are held out."""
    found = p[y > 0]
    return float(found.min() / 10) if len(found) >= 30 else 0.0


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, lex: Lexicons):
        self.weights, self.thresholds, self.lex = weights, thresholds, lex


def train(rows: list[tuple[str | None, str | None]], others: list[str], lex: Lexicons, seed: int = 11) -> Model:
    """rows: a bounded sample of (question, answer), mostly sound."""
    rng = random.Random(seed)
    own = [features(q, a, lex) for q, a in rows]

    def examples(kept: list[int], times: int) -> tuple[list[list[int]], np.ndarray]:
        sound = [rows[i] for i in kept if rows[i][1] and words_of(rows[i][1])]
        made = synthetic(sound * times, others, lex.toki, rng)
        y = np.zeros((len(kept) + len(made), len(DEFECTS)), np.float32)
        for i, (_, _, ls) in enumerate(made):
            y[len(kept) + i, list(ls)] = 1
        return [own[i] for i in kept] + [features(q, a, lex) for q, a, _ in made], y

    kept, frequency = list(range(len(rows))), np.full(len(DEFECTS), 0.5)
    for _ in range(CLEANING_ROUNDS):  # each half is judged by a model that hasn't seen it
        rng.shuffle(kept)
        halves = [kept[::2], kept[1::2]]
        models = [fit_linear(*examples(h, 1)) if h else None for h in halves]
        clean, suspect = [], np.zeros(len(DEFECTS))
        for h, m in zip(halves, reversed(models), strict=True):
            bad = scores(m, [own[i] for i in h]) > DIRTY if h and m is not None else np.zeros((len(h), len(DEFECTS)), np.bool_)
            suspect += np.bincount(bad.argmax(axis=1)[bad.any(axis=1)], minlength=len(DEFECTS))
            clean += [r for r, x in zip(h, bad.any(axis=1), strict=True) if not x]
        if len(kept) == len(rows):
            frequency = (suspect + 1) / (len(rows) + 2)
        kept = clean or kept
    x, y = examples(kept, 2)
    held = np.array([rng.random() < 0.25 for _ in x])
    if held.all() or not held.any():
        held = np.arange(len(x)) % 2 == 1
    trial = fit_linear([r for r, h in zip(x, held, strict=True) if not h], y[~held]) if not held.all() else fit_linear(x, y)
    at = held if held.any() else ~held
    p, t = scores(trial, [r for r, h in zip(x, at, strict=True) if h]), y[at]
    cuts = np.array([lossless(p[:, j], t[:, j]) if k in CHECKED else threshold(p[:, j], t[:, j], float(frequency[j])) for j, k in enumerate(DEFECTS)])
    weights = fit_linear(x, y)
    return Model(weights, cuts, lex)


def decide(model: Model, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
    """The first defect of each pair, or None."""
    if not pairs:
        return []
    p = scores(model.weights, [features(q, a, model.lex) for q, a in pairs])
    out: list[str | None] = []
    for (q, a), row in zip(pairs, p >= model.thresholds, strict=True):
        kind = None
        for name, yes in zip(DEFECTS, row, strict=True):
            if yes and (name != "empty" or is_nothing(a)) and (name != "copied" or is_copy(q, a)):
                kind = name
                break
        out.append(kind)
    return out


# --- Spark -------------------------------------------------------------------------------------------------------------------------


def _spark_words(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(F.translate(c, "’", "'")), F.lit(r"[\p{L}\p{M}\p{N}]+(?:'[\p{L}\p{M}]+)*"), F.lit(0)), F.array().cast("array<string>"))


def _frequent(words: DataFrame, least: int) -> HashedWords:
    """All words that occur at least ``least`` times in the whole table."""
    counts = words.groupBy("w").count().where(F.col("count") >= least)
    h = F.conv(F.substring(F.md5("w"), 1, 16), 16, -10).cast("long")
    return HashedWords(counts.select(h.alias("h")).toArrow()["h"].to_numpy())


class Pairs:
    """A table of pairs: rows, and how their answers have to be."""

    def __init__(self, df: DataFrame, *, tab: str, row_id: str, question: str, answer: str, toki: bool, other_texts: DataFrame):
        self.tab, self.toki = tab, toki
        self.rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(question).alias("q"), F.col(answer).alias("a"))
        self.others = other_texts.select(F.lit(None).cast("string").alias("q"), F.col("text").alias("a")).where("a IS NOT NULL").distinct()

    def lexicons(self) -> Lexicons:
        asked = _frequent(self.rows.select(F.explode(_spark_words(F.col("q"))).alias("w")), 2)
        answers = self.rows.select(_spark_words(F.col("a")).alias("w")).where(F.size("w") > 1)
        return Lexicons(_frequent(answers.select(F.explode(F.slice("w", 1, F.size("w") - 1)).alias("w")), 3) | asked, asked, self.toki)

    def sample(self) -> DataFrame:
        first = lambda df, other: df.select("q", "a").orderBy(F.xxhash64("q", "a"), "q", "a").limit(SAMPLE_ROWS).select(F.lit(self.tab).alias("tab"), F.lit(other).alias("other"), "q", "a")
        return first(self.rows.where("a IS NOT NULL"), False).unionAll(first(self.others, True))


def fitted(tables: list[Pairs]) -> dict[str, Model]:
    """The classifier of each table by its name."""
    spark = tables[0].rows.sparkSession
    lexicons = {t.tab: t.lexicons() for t in tables}
    shared = spark.sparkContext.broadcast(lexicons)
    sample = tables[0].sample()
    for t in tables[1:]:
        sample = sample.unionAll(t.sample())

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["q", "a"], kind="stable")
        none = lambda c: [x if isinstance(x, str) else None for x in c]
        own, others = rows[~rows["other"]], rows[rows["other"]]
        model = train(list(zip(none(own["q"]), none(own["a"]), strict=True)) or [(None, "")], none(others["a"]), shared.value[key[0]])
        return pd.DataFrame({"tab": [key[0]], "model": [pickle.dumps((model.weights, model.thresholds))]})

    # at most 2 x SAMPLE_ROWS rows a table
    models = cut_lineage(sample.repartition(max(2, len(tables)), "tab").groupBy("tab").applyInPandas(fit, "tab string, model binary"))
    found = {r["tab"]: Model(*pickle.loads(r["model"]), lexicons[r["tab"]]) for r in models.collect()}  # noqa: S301  (a row a table, written above)
    for t in tables:
        if t.tab not in found:  # no rows: nothing will be scored
            found[t.tab] = train([(None, "")], [], lexicons[t.tab])
    return found


def defects_of(tables: list[Pairs]) -> DataFrame:
    """(tab, row_id, defect) of every row with an unusable answer of all tables."""
    out, models = None, fitted(tables)
    for t in tables:
        model = models[t.tab]
        found = t.rows.mapInPandas(_scored(t.rows.sparkSession.sparkContext.broadcast(model)), "row_id long, defect string").select(F.lit(t.tab).alias("tab"), "row_id", "defect")
        out = found if out is None else out.unionByName(found)
    return out


def _scored(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds = decide(shared.value, list(zip(b["q"], b["a"], strict=True)))
            yield pd.DataFrame({"row_id": b["row_id"], "defect": kinds}).dropna(subset=["defect"])

    return run


def defective_pairs(df: DataFrame, *, tab: str, row_id: str, question: str, answer: str, toki: bool, other_texts: DataFrame) -> DataFrame:
    """(tab, row_id, defect) of every row with an unusable answer. toki: answers must be in Toki Pona, else in the questions' language.

    other_texts: column ``text`` with sentences in a language that answers must not be in. A null or blank question is no fault and can't be
    copied; a null answer is empty; repeated rows come out each; an empty table gives no rows.
    """
    return defects_of([Pairs(df, tab=tab, row_id=row_id, question=question, answer=answer, toki=toki, other_texts=other_texts)])
