"""Toxicity: a noisy channel restores obfuscated words, then restored text is scored.

Obfuscated stretches (leetspeak, letters set apart, repeated letters) become a character
lattice: every observed character may stand for itself, for the letters it imitates, or for
nothing (a separator, or a repeat of the letter before), and signs between letters may end a
word, each at a cost.  Stretches have any length: a lattice takes time in proportion to it.  Viterbi decodes
the lattice under a character trigram model, counted over the words of all documents.  A stretch whose lattice has only one path
is its own decoding, so plain words need no search.  The restored words join the text's own.

The score is a logistic regression on the text's words and word beginnings (4 to 7 letters).
Its weights are learned from at most ``MAX_POS`` + ``MAX_NEG`` labelled rows (those of the
smallest id hash); the intercept is then set back to the true share of positives.

Defined cases: null or empty text has no words and gets the intercept's score; null
labels are not learned from, and of several labels of a document the highest counts;
without positives or without negatives the score is their smoothed share; repeated rows are
scored each for itself; extra columns pass through ``score_documents`` untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, table, with_columns

MAX_POS, MAX_NEG, MAX_FEATURES = 1000, 2000, 1000
WORDS_HELD = 100_000  # distinct words that a task holds before it turns them into trigrams
RIDGE, STEPS = 3e-5, 1200
#: A feature is a sign of label 1 if its log-likelihood ratio is over STRENGTH and its rate at least RATIO times that of label 0; a
#: beginning gives way to a longer one that has LONGER of its texts; a sign in ALONE of the texts of label 1 is also learned by itself, COPIES times.
STRENGTH, RATIO, LONGER, ALONE, COPIES = 15, 6, 0.95, 0.04, 8
WORD = re.compile(r"[^\W\d_]+")
#: What each sign imitates.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SEPARATORS = " .-_*"
SPACE = re.compile(r"\s")
SIGNS = re.compile(r"[0-9@$!|+]")
LEET_CORE = re.compile(r"[a-zA-Z][0-9@$!|+][a-zA-Z0-9]|[0-9@$!|+][a-zA-Z][a-zA-Z0-9@$!|+]")
REPEATS = re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*]{1,2}[^\W_@$!]){3,}(?![^\W_])")
COST = {"same": 0.0, "leet": 1.0, "drop_sep": 0.5, "drop_repeat": 1.0, "keep_sign": 6.0, "end_word": 0.5}


def folded(w: str) -> str:
    """The word in an alphabet of bounded size: letters from U+0600 on share one sign with those of the same
    place in a row of 128, so that the letters of most scripts stay apart and ideographs are spread evenly."""
    return w if w.isascii() else "".join(c if c < "\u0600" else chr(0x600 + ord(c) % 128) for c in w)


def add_trigrams(to: Counter[str], words: Counter[str]) -> None:
    for w, n in words.items():
        s = "  " + folded(w) + " "
        for i in range(2, len(s)):
            to[s[i - 2 : i + 1]] += n


def letter_counts(docs: DataFrame) -> Counter[str]:
    """Trigrams of the words of all texts, edges as spaces; tasks count their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Counter(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                words.update(WORD.findall((t or "").lower()))
                if len(words) > WORDS_HELD:
                    add_trigrams(grams, words)
                    words.clear()
        add_trigrams(grams, words)
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return Counter({r["gram"]: r["n"] for r in rows})


class CharModel:
    """Trigram model with additive smoothing and backing off by interpolation."""

    def __init__(self, words: Counter[str], grams: Counter[str] | None = None):
        self.c3, self.c2, self.n2, self.n1 = Counter(grams or {}), Counter(), Counter(), Counter()
        add_trigrams(self.c3, words)
        for k, n in self.c3.items():
            self.n2[k[:2]] += n
            self.c2[k[1:]] += n
            self.n1[k[1]] += n
        self.memo: dict[str, float] = {}

    def cost(self, two: str, c: str) -> float:
        k = two + c
        if k not in self.memo:
            f = folded(k)
            p2 = (self.c2[f[1:]] + 0.05) / (self.n1[f[1]] + 0.05 * 60)
            self.memo[k] = -float(np.log((self.c3[f] + 3 * p2) / (self.n2[f[:2]] + 3)))
        return self.memo[k]


def arcs(s: str, i: int) -> list[tuple[str, float]]:
    """(letters out, channel cost) of the lattice at position i; a space out ends a word."""
    c = s[i]
    if c in SEPARATORS:
        return [("", COST["drop_sep"]), (" ", COST["end_word"])]
    out = [(x, COST["leet"]) for x in LEET.get(c, "")]
    if c.isalpha():
        out.append((c, COST["same"]))
        if i and s[i - 1] == c:
            out.append(("", COST["drop_repeat"] if i < 2 or s[i - 2] != c else 0.0))
    elif not out:
        out.append(("", COST["keep_sign"]))
        if not c.isalnum():
            out.append((" ", COST["end_word"]))
    return out


def restore(s: str, model: CharModel) -> str:
    """The likeliest words behind a stretch of text, with spaces between them."""
    # by the two letters before: the cost, and the way back as (way before, letter)
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    for i in range(len(s)):
        step: dict[str, tuple[float, tuple | None]] = {}
        found = arcs(s, i)
        for two, (cost, way) in states.items():
            for letter, k in found:
                if not letter or letter == " " and two == "  ":
                    to, total, new = two, cost + k, way
                else:
                    to, total, new = "  " if letter == " " else two[1] + letter, cost + k + model.cost(two, letter), (way, letter)
                if to not in step or total < step[to][0]:
                    step[to] = (total, new)
        states = step
    # at the end a word is closed, unless none is begun
    ends = [(cost if two == "  " else cost + model.cost(two, " "), two) for two, (cost, _) in states.items()]
    way, out = states[min(ends)[1]][1], []
    while way:
        way, letter = way
        out.append(letter)
    return "".join(reversed(out))


def stretches(text: str) -> set[str]:
    """The distinct obfuscated-looking stretches of a lower-cased text."""
    out = set()
    found = [REPEATS, LEET_CORE] if SIGNS.search(text) else [REPEATS]
    for sign in found:
        end = 0
        for m in sign.finditer(text):
            if m.start() >= end:  # else in the stretch before
                a = m.start()
                while a > 0 and not text[a - 1].isspace():
                    a -= 1
                gap = SPACE.search(text, m.end())
                end = gap.start() if gap else len(text)
                out.add(text[a:end].strip(".,;:?!\"'()[]{}<>*#%&-_/\\~`^="))
    out.update(m[0] for m in SPACED.finditer(text))
    return out


def words_of(text: str | None, model: CharModel | None) -> set[str]:
    low = (text or "").lower()
    words = set(WORD.findall(low))
    if model:
        for s in stretches(low):
            words.update(restore(s, model).split())
    return words


def features(words: set[str]) -> set[str]:
    out = {"=" + w for w in words}
    for k in (4, 5, 6, 7):
        out.update(w[:k] for w in words if len(w) >= k)
    return out


def document_counts(rows: list[tuple[str, int]], least: int) -> list[Counter[str]]:
    """By label: in how many texts the features stand that ``least`` texts of label 1 have.  One text's features
    are held at a time; a table of hashed counts first tells which features can be worth a name."""
    rough = np.zeros(1 << 21, np.int32)
    slots = lambda f: np.fromiter((hash(x) & (len(rough) - 1) for x in f), np.int64, len(f))
    for t, y in rows:
        if y:
            np.add.at(rough, slots(features(words_of(t, None))), 1)
    df: list[Counter[str]] = [Counter(), Counter()]
    for label in (1, 0):
        for t, y in rows:
            if y == label:
                f = list(features(words_of(t, None)))
                for i in np.flatnonzero(rough[slots(f)] >= least):
                    if label or f[i] in df[1]:
                        df[label][f[i]] += 1
        if label:
            df[1] = Counter({x: n for x, n in df[1].items() if n >= least})
    return df


@dataclass
class ToxicModel:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    chars: CharModel | None = None

    def score(self, text: str | None) -> float:
        z = self.bias
        if self.weights:
            words, w = words_of(text, self.chars), self.weights
            hits = {x for x in self._exact if x[1:] in words} if len(words) > len(self._exact) else {"=" + x for x in words if "=" + x in w}
            for k in (4, 5, 6, 7):
                hits |= self._starts[k] & {x[:k] for x in words}
            z += sum(w[x] for x in sorted(hits))
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))

    def __post_init__(self) -> None:
        self._exact = {x for x in self.weights if x[0] == "="}
        self._starts = {k: {x for x in self.weights if x[0] != "=" and len(x) == k} for k in (4, 5, 6, 7)}


def train(rows: list[tuple[str, int]], share: float | None = None, letters: Counter[str] | None = None) -> ToxicModel:
    """rows: (text, label); share: the true share of label 1, if rows were stratified; letters: the corpus'
    trigrams (those of the rows, if not given)."""
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    if not n1 or not n0:
        p = (n1 + 0.5) / (len(rows) + 1)
        return ToxicModel(float(np.log(p / (1 - p))))
    rows = sorted(set(rows))  # copies are one example
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    least = max(3, n1 // 200)
    df = document_counts(rows, least)

    def strength(x: str) -> float:
        """Log-likelihood ratio of the feature, if it speaks for label 1 clearly."""
        a, b = df[1][x], df[0][x]
        if a < least or a / n1 < RATIO * (b + 0.5) / n0:
            return 0.0
        p = (a + b) / (n1 + n0)
        return 2 * (a * np.log(a / n1 / p) + (b * np.log(b / n0 / p) if b else 0.0))

    picked = sorted(((s, x) for x in df[1] if (s := strength(x)) > STRENGTH), key=lambda v: (-v[0], v[1]))[:MAX_FEATURES]
    # a beginning gives way to a longer one that stands in nearly all of its toxic texts
    longer = Counter()
    for _, x in picked:
        for k in range(4, min(7, len(x))):
            if x[0] != "=":
                longer[x[:k]] = max(longer[x[:k]], df[1][x])
    names = [x for _, x in picked if x[0] == "=" or longer[x] < LONGER * df[1][x]]
    at = {x: i for i, x in enumerate(names)}
    # obfuscated words are mostly insults: their model is the corpus' words with the learned ones weighed up
    grams = Counter(letters or {})
    if letters is None:
        for t, _ in rows:
            add_trigrams(grams, Counter(WORD.findall(t.lower())))
    total = sum(n for k, n in grams.items() if k.startswith("  "))
    insults = [x[1:] for x in names if x[0] == "="]
    chars = CharModel(Counter({w: max(1, total // len(insults)) for w in insults}), grams)
    x = np.zeros((len(rows), len(names)))
    for i, (t, _) in enumerate(rows):
        for f in features(words_of(t, chars)):
            if f in at:
                x[i, at[f]] = 1
    # of features that stand in the same texts, the most specific is kept: whole word, then longest
    best: dict[bytes, int] = {}
    for i, n in enumerate(names):
        k = x[:, i].tobytes()
        if k not in best or (n[0] == "=", len(n)) > (names[best[k]][0] == "=", len(names[best[k]])):
            best[k] = i
    use = sorted(best.values())
    names = [names[i] for i in use]
    x = np.hstack([x[:, use], np.ones((len(rows), 1))])
    y = np.array([v for _, v in rows], float)
    # a sign that stands alone: texts of one common, nearly pure sign each, so that one hit can be enough
    alone = [i for i, f in enumerate(names) if df[1][f] >= max(10, ALONE * n1) and df[0][f] <= 0.02 * df[1][f] * n0 / n1]
    extra = np.zeros((len(alone), x.shape[1]))
    extra[range(len(alone)), alone] = 1
    extra[:, -1] = 1
    extra = np.repeat(extra, COPIES, axis=0)
    x, y = np.vstack([x, extra]), np.concatenate([y, np.ones(len(extra))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], RIDGE)
    reg[-1] = 0
    lip = 0.25 * np.linalg.norm(x, 2) ** 2 / len(y) + RIDGE
    v, prev = w.copy(), w.copy()
    for k in range(STEPS):  # accelerated gradient descent; weights of toxic signs stay positive
        p = 1 / (1 + np.exp(-np.clip(x @ v, -50, 50)))
        w = v - (x.T @ (p - y) / len(y) + reg * v) / lip
        w[:-1] = np.maximum(w[:-1], 0)
        v, prev = w + k / (k + 3) * (w - prev), w
    bias = float(w[-1])
    if share is not None and 0 < share < 1:
        bias += float(np.log(share / (1 - share)) - np.log(n1 / n0))
    return ToxicModel(bias, {n: float(c) for n, c in zip(names, w) if c > 1e-6}, chars)


def training_rows(docs: DataFrame, labels: DataFrame, fold: int = 5) -> tuple[list[tuple[str, int]], float | None]:
    """Labelled texts outside the held-out fold, at most MAX_POS and MAX_NEG; the share of label 1."""
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != 0))
    y = y.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    n = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    if not n:
        return [], None
    h = F.xxhash64("doc_id")
    ids = y.where(F.col("y") == 1).orderBy(h, "doc_id").limit(MAX_POS).unionByName(y.where(F.col("y") == 0).orderBy(h, "doc_id").limit(MAX_NEG))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()  # ids: MAX_POS + MAX_NEG rows at most
    rows = sorted({(r["doc_id"], r["text"] or "", r["y"]) for r in rows})
    return [(t, v) for _, t, v in rows], n.get(1, 0) / sum(n.values())


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """docs, whatever its columns, with toxicity_score and toxicity_predicted added."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> dict[str, list]:
        s = [known.value.score(t) for t in b.column("text").to_pylist()]
        return {"toxicity_score": s, "toxicity_predicted": [int(x >= 0.5) for x in s]}

    return with_columns(docs, run, "toxicity_score double, toxicity_predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(*training_rows(docs, table(spark, sf_dir, "labels")), letter_counts(docs))
    return score_documents(docs, model).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxicity_predicted").alias("predicted")
    )
