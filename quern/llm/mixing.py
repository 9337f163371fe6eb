"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic.  Every cell has a weight, 1 at
first; raking multiplies the weights, one margin after another, until the tokens that are expected
to be kept, sum of tokens * min(1, weight), meet the targets of all three margins.  min(1, weight) is
then a document's probability, and a document stays if a uniform number made from its
doc_id and text is below it, so the same rows are kept whoever computes them, and again after a loss.

Targets: the ``budget`` share of all tokens; in each margin, shares in proportion to (tokens of the value)
to the power ``flatten`` (1 keeps the mix, 0 makes all values equal), or given shares.  No value is asked for more
than it has; what it lacks is shared out among the others.

Cells are grouped before anything is shuffled.  Up to ``MAX_CELLS`` of them are raked on the
driver in numpy; more are raked as tables, by the same steps and the same rule for stopping:
``SWEEPS`` at most, or when no probability changes by ``CLOSE`` in a sweep.  Both warn of margins that
stay off target by more than ``OFF`` of it.

Defined cases: null source, language or topic is a value of its own, written ``(none)``; a null or
empty text has no tokens, topic ``empty``, and is kept with its cell's probability (cells
without tokens keep weight 1); repeated rows share their fate; an empty table gives no
rows; extra columns pass through.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ASCII_SPACE, discard, materialize, table

MARGINS = ("__mix_source", "__mix_lang", "__mix_topic")
ADDED = ("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_selected")
MAX_CELLS, SWEEPS, CLOSE = 200_000, 200, 1e-9
BUDGET, FLATTEN, CAP, GRID = 0.5, 0.5, 1e3, 50
OFF = 1e-6
NONE = "(none)"


def count_tokens(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, ASCII_SPACE))).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """The form of a text, which serves as its topic where the caller gives none (``mix`` takes any column)."""
    signs = F.length(text) - F.length(F.translate(text, "#$%&*", ""))
    return F.when(tokens == 0, "empty").when(text.contains(" | "), "table").when(signs * 20 > F.length(text), "noise").when(tokens < 100, "short").otherwise("prose")


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    d = docs.withColumn("__mix_tokens", count_tokens(F.col("text")))
    d = d.withColumn("__mix_topic", F.coalesce(topic if topic is not None else topic_of(F.col("text"), F.col("__mix_tokens")), F.lit(NONE)))
    return d.withColumn("__mix_source", F.coalesce("source", F.lit(NONE))).withColumn("__mix_lang", F.coalesce("lang", F.lit(NONE)))


def scale_for(kept_at, total: float) -> float:
    """The factor on shares at which sum(min(available, factor * share)) is ``total``.  kept_at takes ``GRID`` factors at a
    time, so that a table is summed a few times only: each time the interval shrinks to a ``GRID``-th."""
    factors = [4.0 ** (k - 1) for k in range(GRID)]
    lo = 0.0
    for _ in range(10):
        kept = kept_at(factors)
        i = next((i for i, v in enumerate(kept) if v >= total * (1 - 1e-12)), len(kept) - 1)
        lo, hi = factors[i - 1] if i else lo, factors[i]
        if hi - lo <= 1e-12 * hi:
            break
        factors = [lo + (hi - lo) * k / GRID for k in range(1, GRID)] + [hi]
    return hi


def targets_of(totals: dict[str, float], budget: float, flatten: float, given: dict[str, float] | None = None) -> dict[str, float]:
    """Tokens to keep of each value of a margin; none is asked for more than it has."""
    share = {k: (given.get(k, 0.0) if given is not None else float(t) ** flatten if t else 0.0) for k, t in totals.items()}
    have, part = np.array([float(totals[k]) for k in share]), np.array(list(share.values()), float)
    x = scale_for(lambda fs: [float(np.minimum(have, f * part).sum()) for f in fs], budget * sum(totals[k] for k in totals if share[k] or given is None))
    return {k: min(float(totals[k]), x * v) for k, v in share.items()}


def report(margin: str, off: int, worst: float) -> None:
    if off:
        warnings.warn(f"mixing: {off} values of {margin[6:]} stay off target, by {worst:.3g} of it at most", stacklevel=3)


def rake(cells: list[tuple], budget: float = BUDGET, flatten: float = FLATTEN, given: dict[str, dict[str, float]] | None = None) -> np.ndarray:
    """Weights of cells (source, lang, topic, tokens)."""
    tokens = np.array([c[3] for c in cells], float)
    w = np.ones(len(cells))
    index, want = [], []
    for m in range(3):
        values = sorted({c[m] for c in cells})
        at = {v: i for i, v in enumerate(values)}
        ix = np.array([at[c[m]] for c in cells], int)
        total = np.bincount(ix, tokens, len(values))
        t = targets_of(dict(zip(values, total)), budget, flatten, (given or {}).get(MARGINS[m][6:]))
        index.append(ix)
        want.append(np.array([t[v] for v in values]))
    for _ in range(SWEEPS):
        before = w.copy()
        for ix, t in zip(index, want):
            have = np.bincount(ix, tokens * np.minimum(1, w), len(t))
            w = np.where(tokens > 0, np.minimum(w * np.where(have > 0, t / np.where(have > 0, have, 1), 1)[ix], CAP), w)
        if np.abs(np.minimum(1, w) - np.minimum(1, before)).max(initial=0) < CLOSE:
            break
    for m, ix, t in zip(MARGINS, index, want):
        gap = np.abs(np.bincount(ix, tokens * np.minimum(1, w), len(t)) - t) / np.where(t > 0, t, 1)
        report(m, int((gap > OFF).sum()), float(gap.max(initial=0)))
    return w


def rake_tables(cells: DataFrame, budget: float = BUDGET, flatten: float = FLATTEN, given: dict[str, dict[str, float]] | None = None, sweeps: int | None = None) -> DataFrame:
    """The same steps over a table of cells: adds weight."""
    cells = materialize(cells.withColumn("weight", F.lit(1.0)), "rake")
    want = {}
    for m in MARGINS:
        t = cells.groupBy(m).agg(F.sum("tokens").alias("t"))
        g = (given or {}).get(m[6:])
        share = F.pow(F.col("t").cast("double"), F.lit(flatten)) if g is None else F.coalesce(F.create_map(*[F.lit(x) for kv in g.items() for x in kv])[F.col(m)], F.lit(0.0))
        t = t.withColumn("share", F.when(F.col("t") > 0, share).otherwise(0.0))
        t = materialize(t, "margin")
        asked = t.where("share > 0" if g is not None else "true").select(F.sum("t")).first()[0] or 0
        kept = lambda fs: [v or 0.0 for v in t.select(*[F.sum(F.least(F.col("t").cast("double"), F.col("share") * f)) for f in fs]).first()]  # noqa: B023, E731
        x = scale_for(kept, budget * asked)
        want[m] = t.select(m, F.least(F.col("t").cast("double"), F.col("share") * x).alias("want"))
    p = F.least(F.lit(1.0), "weight")
    have_of = lambda m: cells.groupBy(m).agg(F.sum(F.col("tokens") * p).alias("have")).join(want[m], m)
    for _ in range(SWEEPS if sweeps is None else sweeps):
        cells = cells.withColumn("before", p)
        for m in MARGINS:
            have = have_of(m)
            f = have.select(m, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(1.0).alias("f"))
            new = materialize(cells.join(f, m).withColumn("weight", F.when(F.col("tokens") > 0, F.least(F.lit(CAP), F.col("weight") * F.col("f"))).otherwise(F.col("weight"))).drop("f"), "rake")
            discard(cells)
            cells = new
        change = cells.agg(F.max(F.abs(p - F.col("before")))).first()[0]
        cells = cells.drop("before")
        if change is None or change < CLOSE:
            break
    for m in MARGINS:
        gap = F.abs(F.col("have") - F.col("want")) / F.when(F.col("want") > 0, F.col("want")).otherwise(1.0)
        r = have_of(m).agg(F.count_if(gap > OFF).alias("n"), F.max(gap).alias("worst")).first()
        report(m, r["n"], r["worst"])
    return cells


def mix(docs: DataFrame, budget: float = BUDGET, flatten: float = FLATTEN, given: dict[str, dict[str, float]] | None = None, topic: Column | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs with mix_topic, mix_tokens, mix_weight, mix_probability and mix_selected added."""
    spark = docs.sparkSession
    d = with_cells(docs, topic)
    cells = materialize(d.groupBy(*MARGINS).agg(F.sum("__mix_tokens").alias("tokens")), "cells")
    if cells.count() <= max_cells:
        rows = sorted(tuple(r) for r in cells.collect())
        w = rake(rows, budget, flatten, given)
        weights = spark.createDataFrame([(*r[:3], float(x)) for r, x in zip(rows, w)], "__mix_source string, __mix_lang string, __mix_topic string, __mix_weight double")
        weights = F.broadcast(weights)  # max_cells rows at most
    else:
        weights = rake_tables(cells, budget, flatten, given).drop("tokens").withColumnRenamed("weight", "__mix_weight")
    u = (F.xxhash64("doc_id", "text") / F.lit(2.0**64)) + 0.5
    out = d.join(weights, list(MARGINS), "left").withColumn("__mix_p", F.least(F.lit(1.0), "__mix_weight"))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED], F.col("__mix_topic").alias("mix_topic"), F.col("__mix_tokens").alias("mix_tokens"), F.col("__mix_weight").alias("mix_weight"),
        F.col("__mix_p").alias("mix_probability"), (u < F.col("__mix_p")).alias("mix_selected"),
    )


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_selected")
