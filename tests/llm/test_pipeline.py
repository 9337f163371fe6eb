"""The pipeline's stages, each against a brute-force version on its own input."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F
from test_edges import brute_components, brute_leaks, brute_lines

from quern.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def brute_toxic(docs, labels):
    """Ids of rejected documents: one text after another, folds and letters by plain Python."""
    letters = Counter()
    for t in docs.values():
        toxicity.add_trigrams(letters, Counter(toxicity.WORD.findall((t or "").lower())))
    seen = {d: y for d, y in labels if y is not None and zlib.crc32(str(d).encode()) % 5 != 0}
    model = toxicity.train(sorted((docs[d] or "", int(y > 0)) for d, y in seen.items() if d in docs), sum(y > 0 for y in seen.values()) / len(seen), letters)
    return {d for d, t in docs.items() if model.score(t) >= 0.5}


def brute_rake(cells, sweeps=200):
    """Probabilities of cells {(source, lang, topic): tokens}, in plain loops; half the tokens, shares by the root."""
    wants = []
    for m in range(3):
        total = defaultdict(int)
        for c, n in cells.items():
            total[c[m]] += n
        free, left, want = set(k for k, n in total.items() if n), 0.5 * sum(total.values()), dict.fromkeys(total, 0.0)
        while free:  # those that are asked for more than they have give all
            x = left / sum(total[k] ** 0.5 for k in free)
            over = {k for k in free if x * total[k] ** 0.5 >= total[k]}
            if not over:
                want |= {k: x * total[k] ** 0.5 for k in free}
                break
            want |= {k: float(total[k]) for k in over}
            left -= sum(total[k] for k in over)
            free -= over
        wants.append(want)
    w = dict.fromkeys(cells, 1.0)
    for _ in range(sweeps):
        before = dict(w)
        for m in range(3):
            have = defaultdict(float)
            for c, n in cells.items():
                have[c[m]] += n * min(1.0, w[c])
            w = {c: min(1e3, w[c] * wants[m][c[m]] / have[c[m]]) if n and have[c[m]] else w[c] for c, n in cells.items()}
        if max(abs(min(1, w[c]) - min(1, before[c])) for c in w) < 1e-9:
            break
    return {c: min(1.0, x) for c, x in w.items()}


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        texts = {d: r["text"] for d, r in before.items()}
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        after = {r["doc_id"]: r for r in out.collect()}
        if name == "toxicity":
            gone = brute_toxic(texts, labels)
        elif name == "line_dedup":
            gone = set()
            want = {d: (n, sha) for d, n, _, sha in brute_lines(list(texts.items()), 10)}
            assert all(hashlib.sha256((r["text"] or "").encode()).hexdigest() == want[d][1] and r["n_chars"] == len(r["text"]) for d, r in after.items())
        elif name == "ngram_jaccard_join":
            gone = {d for d, c in brute_components(list(texts.items())).items() if c != d}
        else:
            gone = {d for d, _ in brute_leaks(list(texts.items()), items)}
        assert set(after) == set(before) - gone, name
        if name != "line_dedup":
            assert all(before[d] == r for d, r in after.items())
        docs = out
    rows = mixing.mix(docs).collect()
    cells = Counter()
    for r in rows:
        cells[r["source"] or mixing.NONE, r["lang"] or mixing.NONE, r["mix_topic"]] += r["mix_tokens"]
        assert r["mix_tokens"] == len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))
    want = brute_rake(cells)
    assert all(r["mix_probability"] == pytest.approx(want[r["source"] or mixing.NONE, r["lang"] or mixing.NONE, r["mix_topic"]], abs=1e-6) for r in rows)
    last = p.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in rows if r["mix_selected"]} and set(docs.columns) <= set(last.columns)


def test_odd_ids(spark):
    """Rows of a null id are judged by themselves; rows that repeat an id stay or go together, equal ones once."""
    import corpus_pipeline as p

    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(None, leak), (None, a), (None, a), (1, a), (1, a), (1, b), (2, b), (3, leak + " end"), (4, "c d")]
    docs = spark.createDataFrame([(d, t, "en", "s", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda rs: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["n_chars"]) for r in rs)
    want = lambda ix: key({"doc_id": rows[i][0], "text": rows[i][1], "n_chars": i} for i in ix)
    assert key(p.keep_one_of_near_copies(spark, docs, SF).collect()) == want([0, 1, 2, 3, 5, 7, 8])
    assert key(p.remove_benchmark_leaks(spark, docs, SF).collect()) == want([1, 2, 3, 4, 5, 6, 8])


def test_near_copies_are_sought_among_documents_that_can_link(spark, monkeypatch):
    """The third stage indexes no text that shares only a passage with others, and drops the same documents."""
    import corpus_pipeline as p
    from quern.llm import jaccard

    words = lambda s, n: " ".join(f"{s}x{i}" for i in range(n))
    rows = [(i, f"{words(f'a{i}', 30)} {words(f'p{i % 7}', 12)} {words(f'b{i}', 30)}") for i in range(150)] + [(500 + i, f"{words(f'c{i % 5}', 60)} end{i}") for i in range(20)]
    indexed, write = [], jaccard.materialize

    def spy(d, name):
        out = write(d, name)
        if name == "index":
            indexed.extend(i for r in out.select("ids").collect() for i in jaccard.unpack(r["ids"], "int64").tolist())
        return out

    monkeypatch.setattr(jaccard, "materialize", spy)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r["doc_id"] for r in p.keep_one_of_near_copies(spark, docs, SF).collect()}
    assert got == {d for d, c in brute_components(rows).items() if c == d} == {*range(150), *range(500, 505)}
    assert set(indexed) == set(range(500, 520))


def test_documents_that_cannot_link_cost_little_disk(spark, monkeypatch):
    """The third stage neither writes nor shuffles all tokens of texts that share nothing, and loses no near copy."""
    import corpus_pipeline as p
    from quern.llm import jaccard

    words = lambda s, n: " ".join(f"{s}x{i}" for i in range(n))
    rows = [(i, words(f"a{i}", 504)) for i in range(400)] + [(400 + i, words(f"c{i % 10}", 60) + " end" * (1 + i // 10)) for i in range(30)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).localCheckpoint()
    bus, store, write, tables = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore(), jaccard.materialize, []

    def shuffled():
        bus.waitUntilEmpty(30_000)
        return store.executorSummary("driver").totalShuffleWrite()

    def spy(d, name):
        out = write(d, name)
        tables.append(sum(os.path.getsize(urlparse(f).path) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard, "materialize", spy)
    before, known = shuffled(), docs.select("doc_id", "text")
    n_tokens = 400 * 500 + sum(len(jaccard.shingle_set(t)) for _, t in rows[400:])
    kept, _, n = jaccard.candidates(known, n_tokens)
    assert {r["doc_id"] for r in kept.collect()} == set(range(400, 430)) and n == n_tokens - 400 * 500
    assert shuffled() - before + sum(tables) < 2 * n_tokens
    for share in (0.05, 0.4, 0.7):  # what part of the tokens shows leaves out no document that links
        got = {r["doc_id"]: r["n"] for r in jaccard.may_link(known, n_tokens, share).collect()}
        assert set(range(400, 430)) <= set(got) and all(m == len(jaccard.shingle_set(rows[d][1])) for d, m in got.items())
        assert share < 0.4 or len(got) == 30
    gone = {d for d, c in brute_components(rows).items() if c != d}
    assert {r["doc_id"] for r in p.keep_one_of_near_copies(spark, docs, SF).collect()} == set(range(430)) - gone and len(gone) == 20


def test_run(spark):
    import corpus_pipeline as p

    assert p.run(spark, SF).select(F.countDistinct("doc_id"), F.count("*")).first()[0] > 0
