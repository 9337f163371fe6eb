"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes of the
lower-cased UTF-8 text, hashed to ``BUCKETS`` rows); a softmax layer turns it into language
probabilities.  Both are trained together by stochastic gradient descent in numpy on at
most ``PER_LANG`` labelled documents of each of the ``MAX_LANGS`` commonest languages, ``MAX_DOCS`` in all (those of the
smallest id hash), a fifth of which is kept out to calibrate: a temperature is fitted to it, and a score
below which a prediction counts as rejected.  That score parts right predictions from wrong ones and from those of foreign
text, as which the kept-out texts serve a second time, with their letters exchanged at random.  Since mean and layer are both linear,
prediction adds rows of (embeddings @ layer), which is the same number for less work.

Defined cases: a null text or one without any letter is ``und`` with score 0, as is every
text when there is nothing to learn from; repeated rows are predicted each for itself; a
null doc_id is never held out nor learned from; extra columns are ignored.  Whole texts are
read, in pieces of ``PIECE`` bytes, so one long text needs no more memory than a short one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, map_pandas, table

BUCKETS, DIM, NGRAMS, PIECE = 1 << 15, 16, (2, 3, 4), 1 << 19
PER_LANG, MAX_LANGS, MAX_DOCS = 600, 400, 4000
UND = "und"


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of bytes that start at each position."""
    x = data.astype(np.uint32)
    h = x * np.uint32(0x01000193)
    for n in range(2, max(NGRAMS) + 1):
        if len(x) < n:
            return
        h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * np.uint32(0x9E3779B1)
        if n in NGRAMS:
            yield ((h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(17)).astype(np.int32)


def encode(text: str) -> np.ndarray:
    return np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)


def mean_rows(text: str, rows: np.ndarray) -> np.ndarray:
    """The mean of the rows of all n-grams of a text, piece by piece."""
    data, total, n = encode(text), np.zeros(rows.shape[1]), 0
    for i in range(0, len(data), PIECE):
        for k, g in zip(NGRAMS, grams(data[i : i + PIECE + max(NGRAMS) - 1])):
            g = g[: min(PIECE, len(data) - i - k + 1)]
            total += rows[g].sum(0, dtype=np.float64)
            n += len(g)
    return total / max(1, n)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    counts = np.zeros(BUCKETS)
    data = encode(text)
    for i in range(0, len(data), PIECE):
        for k, g in zip(NGRAMS, grams(data[i : i + PIECE + max(NGRAMS) - 1])):
            counts += np.bincount(g[: min(PIECE, len(data) - i - k + 1)], minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1.0, counts.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


@dataclass
class LangModel:
    langs: list[str]
    rows: np.ndarray  # BUCKETS x languages: embeddings @ layer
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # scores below it are rejected

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax((mean_rows(text, self.rows) + self.bias) / self.temperature)
        i = int(p.argmax())
        return self.langs[i], float(p[i])


def train(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.5, seed: int = 11) -> LangModel | None:
    """rows: (text, lang)."""
    langs = sorted({y for _, y in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    cut = len(rows) // 5 if len(rows) >= 20 else 0
    bags = {i: bag(rows[i][0]) for i in order[cut:]}
    emb, layer, bias = rng.normal(0, 0.3, (BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, len(langs))), np.zeros(len(langs))
    at = {y: i for i, y in enumerate(langs)}
    for e in range(epochs):
        step = rate / (1 + e)
        for i in rng.permutation(order[cut:]):
            ix, w = bags[i]
            v = w @ emb[ix]
            g = -softmax(v @ layer + bias)
            g[at[rows[i][1]]] += 1
            emb[ix] += step * 20 * np.outer(w, layer @ g)  # each row holds a small share of the mean
            layer += step * np.outer(v, g)
            bias += step * 0.1 * g
    model = LangModel(langs, (emb @ layer).astype(np.float32), bias)
    if cut:
        held = [(mean_rows(rows[i][0], model.rows) + bias, at[rows[i][1]]) for i in order[:cut]]
        loss = lambda t: -sum(math.log(softmax(z / t)[y] + 1e-12) for z, y in held)
        model.temperature = min((2.0 ** (k / 4) for k in range(-12, 17)), key=loss)
        score = lambda z: softmax(z / model.temperature)
        good = [p.max() for z, y in held if (p := score(z)).argmax() == y]
        bad = [p.max() for z, y in held if (p := score(z)).argmax() != y]
        bad += [score(mean_rows(foreign(rows[i][0], rng), model.rows) + bias).max() for i in order[:cut]]
        model.least = best_cut(good, bad)
    return model


def foreign(text: str, rng: np.random.Generator) -> str:
    """The text in a language of its own: each letter stands for another."""
    letters = sorted({c for c in text.lower() if c.isalpha()})
    return text.lower().translate({ord(x): letters[i] for x, i in zip(letters, rng.permutation(len(letters)))})


def best_cut(good: list[float], bad: list[float]) -> float:
    """The score at which the shares of good ones from it on and of bad ones below it are largest together."""
    if not good:
        return 1.0
    good, bad = np.sort(good), np.sort(bad)
    at = np.unique(np.concatenate([good, bad, [0.0]]))
    gain = 1 - np.searchsorted(good, at) / len(good) + np.searchsorted(bad, at) / max(1, len(bad))
    i = int(gain.argmax())
    below = bad[bad < at[i]]
    return float((at[i] + (below[-1] if len(below) else 0.0)) / 2)  # halfway to the best of the bad ones


def training_rows(docs: DataFrame, fold: int = 4, held: int = 2, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """At most per_lang labelled documents of each language outside the held-out fold."""
    seen = docs.where((crc_mod(F.col("doc_id"), fold) != held) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in seen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return []
    per_lang = max(1, min(per_lang, MAX_DOCS // len(counts)))
    # a language's share by id hash, a little more than needed; then the exact bound
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, 1.3 * per_lang / n + 20 / n))])
    u = (F.xxhash64("doc_id") / F.lit(2.0**64)) + 0.5
    picked = seen.where(u < share[F.col("lang")]).select("lang", u.alias("u"), "doc_id", "text").collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(picked, key=lambda r: (r["lang"], r["u"], r["doc_id"], r["text"])):
        if taken[r["lang"]] < per_lang:
            taken[r["lang"]] += 1
            out.append((r["text"], r["lang"]))
    return out


def predict(docs: DataFrame, model: LangModel | None) -> DataFrame:
    """docs with lang_pred, score and rejected added."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        for b in batches:
            got = [m.predict(t) if m and ok else (UND, 0.0) for t, ok in zip(b["text"], b["_letters"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [m is None or g[1] < m.least for g in got]})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    return map_pandas(docs.select("doc_id", "text", letters), run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(training_rows(docs)))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
