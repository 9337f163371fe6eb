"""Each operator on one table of odd rows, on an empty table, and against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, decontaminate, jaccard, langid, lines, mixing, secrets, suffixes, syncmers, toxicity
from quern.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key string, score double, row string, N_Lines string, weight double, mix_topic string, Toxicity_Score int, tokens int, u array<int>"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


BASE = prose(120, 1)
LONG = prose(30_000, 2)


def odd_rows():
    texts = [None, "", " \n\t ", "one", "two words", BASE, BASE, BASE + "\n" + prose(60, 3), LONG, LONG + " tail", "é" * 200, "a" * 500, "same line\nsame line\n\nÄ Same  ", "\n".join(["common"] * 3)]
    texts += [f"common\nline {i}\n  COMMON\t" for i in range(12)]
    texts += [edited(BASE, i % 7, i) for i in range(40)]
    rows = [(i, t, ["en", None, "de"][i % 3], ["a", "b", None][i % 3], None, 7, "k", 0.5, "r", "z", 2.5, "w", 9, 8, [1, None]) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, BASE) + (None,) * 13, (3, "other text of id three", "en", "a", 1, 1, "", 0.0, "", "", 0.0, "", 1, 1, [])] + [(2**62 + 1, "a text of a large id", *[None] * 13)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 ---


def brute_repeats(rows, length):
    first = {}
    for d, t in rows:
        if d is not None:
            for p in range(len(t) - length + 1):
                first[t[p : p + length]] = min(first.get(t[p : p + length], d), d)
    out = []
    for d, t in rows:
        m = np.zeros(len(t), bool)
        if d is not None:
            for p in range(len(t) - length + 1):
                if first[t[p : p + length]] < d:
                    m[p : p + length] = True
        out.append((-1 if d is None else d, len(t), np.frombuffer(t, np.uint8)[~m].tobytes()))
    return sorted(out)


def test_suffix_dedup(odd, empty):
    rows = [(r[0], (r[1] or "").encode()) for r in odd_rows()]
    got = suffixes.remove_repeats(odd, 50).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got) == brute_repeats(rows, 50)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"])
    assert suffixes.remove_repeats(empty).collect() == []


def test_a_key_in_all_documents_in_new_surroundings(spark):
    """Windows of hot keys go to buckets of their own hashes; the result is the same."""
    r = random.Random(12)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrases, passage = [noise(24), noise(40), noise(55)], noise(80)
    rows = [(i, noise(30) + phrases[i % 3] + noise(30) + phrases[(i + 1) % 3] + (passage if i % 7 == 0 else noise(9)) + noise(20)) for i in range(300)] + [(None, passage), (5, "again " + passage)]
    keys = [k for _, t in rows for k in set(suffixes.window_keys(np.frombuffer(t.encode(), np.uint8), 50).tolist())]
    from collections import Counter

    assert Counter(keys).most_common(1)[0][1] > 150  # one key in half of all documents
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_repeats([(d, t.encode()) for d, t in rows], 50)
    for hot in (20, 10**6):
        got = suffixes.remove_repeats(docs, 50, hot=hot).collect()
        assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_bytes"], bytes(x["kept"])) for x in got) == want
    block = suffixes.Block(np.array([1], np.int64).tobytes(), np.array([200], np.int64).tobytes(), suffixes.pack(np.frombuffer(noise(200).encode(), np.uint8)), 50)
    key, runs, several = suffixes.told_apart(block.distinct_keys())
    assert len(key) == len(set(block.key.tolist())) and (runs >= 1).all() and not several.any()
    parts = [block.fragments(np.unique(block.key) << np.uint64(1) | np.uint64(bit), 8) for bit in (0, 1)]
    assert sum(len(f) for p in parts[1].values() for f in p[0]) > sum(len(f) for p in parts[0].values() for f in p[0]) and all(len(f) == 50 for p in parts[1].values() for f in p[0])


def test_messages_of_many_blocks_to_many_buckets(monkeypatch):
    """A message's answer doesn't cost what its whole bucket holds, and says the same as counting; hashes and keys made piece
    by piece are the same."""
    import time

    g = np.random.default_rng(8)
    pool = np.unique(g.integers(0, 1 << 42, 300_000).astype(np.uint64))
    blocks = [np.unique(g.choice(pool, 20)) << np.uint64(6) for _ in range(20_000)]
    sent = [[x for i, x in suffixes.keys_by_bucket(b, 1) if i == 0][0] for b in blocks]
    began = time.thread_time()
    got = suffixes.repeated_keys(sent, 4096)
    assert time.thread_time() - began < 5  # 1.0 here; as intersections with all keys of the bucket, 20.5
    key, n = np.unique(np.concatenate(blocks), return_counts=True)
    twice = key[n > 1] >> np.uint64(6)
    for b, x in list(zip(blocks, got))[::97]:
        assert np.array_equal(suffixes.unpack(x, np.uint64) >> np.uint64(1), np.intersect1d(b >> np.uint64(6), twice))
    parts = dict(suffixes.keys_by_bucket(blocks[0], 64))
    assert sum(len(suffixes.unpack(x, np.uint8)) // 7 for x in parts.values()) == len(blocks[0]) and set(parts) == set((blocks[0] >> np.uint64(6) & np.uint64(63)).tolist())
    data, at = g.integers(97, 100, 5000).astype(np.uint8), np.sort(g.choice(4950, 900, replace=False))
    whole = suffixes.window_hashes(data, at, 50)
    frags = [data[p : p + 50 + p % 30].tobytes() for p in at.tolist() if p < 4900] + [data[7:70].tobytes(), data[9:80].tobytes()]
    low = np.arange(len(frags), dtype=np.int64)
    settled = suffixes._lowest(frags, low, 50)
    monkeypatch.setattr(suffixes, "HASH_BYTES", 300)
    assert np.array_equal(whole, suffixes.window_hashes(data, at, 50))
    assert all(np.array_equal(a, b) for a, b in zip(settled, suffixes._lowest(frags, low, 50)))


@pytest.mark.parametrize("length", [13, 50, 77])
def test_windows_sorted_in_several_buckets(length, monkeypatch):
    monkeypatch.setattr(suffixes, "SORT_AT_ONCE", 300)
    g = np.random.default_rng(length)
    t = g.integers(97, 99, 3000).astype(np.uint8)
    t[500:800], t[2000:2300] = t[1500:1800], 97
    at, want = np.arange(len(t) - length + 1), {}
    for p in at:
        want.setdefault(t[p : p + length].tobytes(), set()).add(int(p))
    got = [set(c.tolist()) for o, s in suffixes.equal_windows(t, at, length) for c in np.split(at[o], s[1:])]
    assert sorted(map(sorted, got)) == sorted(map(sorted, want.values()))


def test_cover_reaches_every_pair():
    assert suffixes.SHIFT.max() < suffixes.V and all((a + suffixes.SHIFT[a, b]) % 13 in suffixes.COVER and (b + suffixes.SHIFT[a, b]) % 13 in suffixes.COVER for a in range(13) for b in range(13))


# --- 2 ---


def brute_leaks(docs, items):
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    from collections import Counter

    out = {}
    for d, t in docs:
        w = words(t)
        for i, b in items:
            x = words(b)
            if not x:
                continue
            k = min(5, len(x))
            sh = lambda v: Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))  # noqa: B023, E731
            want = sh(x)
            if not sh(w).keys() & want.keys():
                continue  # no window shares anything
            for s in range(max(1, len(w) - len(x) + 1)):
                have = sh(w[s : s + len(x)])
                both = sum((have & want).values())
                union = sum((have | want).values())
                if union and both / union >= 0.8:
                    out.setdefault((d, i), set()).add((s, round(both / union, 6)))
    return {k: (len({s for s, _ in v}), min(s for s, _ in v), max(x for _, x in v)) for k, v in out.items()}


def test_decontamination(spark, odd, empty):
    items = [(1, prose(15, 50)), (2, prose(59, 51)), (3, "three word item"), (4, None), (5, ""), (6, prose(15, 50)), (7, "rep rep rep rep rep rep rep rep rep rep"), (8, prose(33, 52).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(100, prose(40, 60) + " " + items[0][1] + " " + prose(40, 61)), (101, items[1][1]), (102, prose(9, 62) + " " + edited(items[1][1], 1, 9) + " end"), (103, "Three  WORD\nitem"), (104, "x " + items[6][1] + " rep rep y"), (105, " ".join(items[1][1].split()[:54])), (106, prose(300, 63)), (107, None), (108, "a " + prose(33, 52)), (None, items[0][1])]
    extra = spark.createDataFrame([(d, t, *[None] * 13) for d, t in docs], SCHEMA)
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["first_word"], r["similarity"]) for r in decontaminate.contaminated(odd.unionByName(extra), bench).collect()}
    want = brute_leaks([(r[0], r[1]) for r in odd_rows() if r[1] is not LONG and r[1] != LONG + " tail"] + docs, items)
    assert got == want and (100, 1) in got and (102, 2) in got and (105, 2) in got and (103, 3) in got
    assert decontaminate.contaminated(empty, bench).collect() == [] and decontaminate.contaminated(odd, bench.limit(0)).collect() == []


def test_radius_and_blocks_lose_no_leak(spark):
    """Fingerprints of windows at a similarity of 0.8 and a little more, and of others, against all distances."""
    pairs = []
    for i in range(1500):
        n = (60, 100, 140)[i % 3]
        a = prose(n, 8000 + i)
        pairs.append((i, a, edited(a, 1 + i % 3, i) if i % 5 else prose(n, 90_000 + i)))
    d = spark.createDataFrame(pairs, "i int, a string, b string")
    sh = lambda c: decontaminate.shingles(decontaminate.words(F.col(c)), 5)
    d = d.select("i", sh("a").alias("x"), sh("b").alias("y")).select("i", decontaminate.similarity(F.col("x"), F.col("y")).alias("s"), decontaminate.simhash(F.col("x")).alias("fx"), decontaminate.simhash(F.col("y")).alias("fy")).cache()
    x = {r["i"]: r for r in d.collect()}
    apart = {i: ((r["fx"] ^ r["fy"]) % 2**64).bit_count() for i, r in x.items()}
    alike = [i for i, r in x.items() if 0.8 <= r["s"] < 1]
    assert len(alike) > 200 and all(apart[i] <= decontaminate.RADIUS for i in alike)
    items = d.select(F.col("i").cast("long").alias("item_id"), F.lit(1).alias("n"), F.col("fy").alias("fp"))
    left = d.select("i", "fx", F.explode(decontaminate.blocks(F.col("fx"))).alias("b")).select("i", "b.no", "b.value")
    met = left.join(decontaminate.hamming_index(items), ["no", "value"]).where("i = item_id").select("i").distinct()
    assert {i for i in apart if apart[i] <= decontaminate.RADIUS} <= {r["i"] for r in met.collect()}


def test_stride_meets_every_leak():
    for m in range(1, 120):
        e, step = m // 9, decontaminate.stride([m])
        assert step * (e + 1) <= m - e + e + step  # a run of at least `step` is left whatever e positions are missed
        worst = -(-(m - e) // (e + 1))
        assert step <= worst


# --- 3 ---


def brute_lines(rows, min_docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    from collections import Counter

    df, seen = Counter(), set()
    for i, (d, t) in enumerate(rows):
        mine = {(f"row {i}" if d is None else d, key(x)) for x in (t or "").split("\n")} - seen
        df.update(k for _, k in mine)
        seen |= mine
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not key(x) or df[key(x)] < min_docs]
        out.append((-1 if d is None else d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, -1])
def test_line_dedup(odd, empty, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", limit)
    got = lines.drop_repeated_lines(odd).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == brute_lines([r[:2] for r in odd_rows()], 10)
    assert all(r["key"] in ("k", "", None) for r in got)
    first = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(odd.where("doc_id >= 13 AND doc_id < 26"), keep="first").collect()}
    assert first[13] == "common" and first[14] == "line 0"
    assert lines.drop_repeated_lines(empty).collect() == []


@pytest.mark.parametrize("bits, limit", [(1 << 8, lines.BROADCAST_BYTES), (1 << 6, -1), (64 << 10, -1)])
def test_line_dedup_where_one_filter_would_be_full(spark, odd, monkeypatch, bits, limit):
    """Ranges of hashes with filters of their own: nothing but what is seen again is suspected, and nothing is missed."""
    monkeypatch.setattr(lines, "MAX_BITS", bits)
    monkeypatch.setattr(lines, "BROADCAST_BYTES", limit)
    r = random.Random(4)
    rows = [(i, "\n".join([f"line {r.randrange(700)}" for _ in range(8)] + [f"own {i}"])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if bits < 1 << 16:
        again = lines.seen_again(docs, 1, 64, 1 << 12)
        assert 600 < again.count() < 800  # 700 shared lines, 500 of single documents
    for d, x in ((docs, rows), (odd, [q[:2] for q in odd_rows()])):
        got = lines.drop_repeated_lines(d).collect()
        assert sorted((-1 if q["doc_id"] is None else q["doc_id"], q["n_lines"], q["n_dropped"], q["kept_sha256"]) for q in got) == brute_lines(x, 10)


def test_rows_of_one_doc_id_are_one_document_of_a_line(spark):
    for rows, gone in (([(1, "a line")] * 10 + [(2, "a line")], 0), ([(i % 9, "a line") for i in range(20)] + [(None, "A Line ")], 21)):
        got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0]
        assert got == gone and brute_lines(rows, 10) and sum(x[2] for x in brute_lines(rows, 10)) == gone


# --- 4 ---


def test_fingerprints(spark, odd, empty):
    rows = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = syncmers.with_next(odd).collect()
    want = sorted((str(d), t, rows[(i + 1) % len(rows)][1]) for i, (d, t) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in got) == want
    assert syncmers.with_next(empty).collect() == []
    one = syncmers.with_next(odd.where("doc_id = 5").limit(1)).first()
    assert one["next_text"] == one["text"]
    d = spark.createDataFrame([(1, prose(200, 1), prose(200, 1)), (2, "", ""), (3, "", "x y"), (4, prose(90, 2), edited(prose(90, 2), 5, 1)), (5, prose(90, 3), prose(90, 4))], "i int, a string, b string")
    s = lambda c: syncmers.sketch(syncmers.anchors(F.col(c)))
    d = d.select("i", syncmers.word_hashes(F.col("a")).alias("a"), syncmers.word_hashes(F.col("b")).alias("b")).select("i", s("a").alias("a"), s("b").alias("b"))
    like = {r[0]: r[1] for r in d.select("i", syncmers.likeness(F.col("a"), F.col("b"))).collect()}
    assert like[1] == like[2] == 1.0 and like[3] == 0.0 and 0.4 < like[4] < 1 and like[5] < 0.1


def test_syncmers_depend_on_their_window_only(spark):
    a, b = prose(80, 7), "other words before " + prose(80, 7)
    d = spark.createDataFrame([(a,), (b,)], "t string").select(syncmers.word_hashes(F.col("t")).alias("h")).select(syncmers.anchors(F.col("h")).alias("x"))
    x, y = ([(p["pos"], p["hash"]) for p in r["x"]] for r in d.collect())
    assert [(p + 3, h) for p, h in x] == [v for v in y if v[0] >= 3]
    at = [p for p, _ in x]
    assert max(q - p for p, q in zip(at, at[1:])) <= syncmers.K - syncmers.S + 1


def brute_anchors(units, k, s, run, whole):
    """Closed syncmers by their definition; run and whole hash tuples of units."""
    out = []
    for i in range(len(units) - k + 1):
        inner = [run(tuple(units[i + j : i + j + s])) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, whole(tuple(units[i : i + k]))))
    return out


def test_fingerprints_against_brute_force(spark, tmp_path):
    """The query's columns on odd texts: the definition, the edit, exact likeness, few words and no words."""
    texts = [None, "", " \n\t ", "one", "two words", "schön größer 漢字", "漢字仮名交じり文は単語の間に空白を置かない文章である" * 3, BASE, BASE, edited(BASE, 3, 1), prose(31, 5), prose(32, 6), prose(33, 7), "a" * 50, prose(3000, 8)]
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, text_words string, edited double")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in syncmers.op4_document_fingerprints(spark, str(tmp_path)).collect()}
    full = [t or "" for t in texts]
    edits = [t[: len(t) - len(t) // 2] + full[(i + 1) % len(full)][: len(t) // 2] for i, t in enumerate(full)]
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
    units = {u for t in full + edits for w in (words(t), list(t)) for u in w}
    unit = {r["u"]: r["h"] for r in spark.createDataFrame([(u,) for u in units], "u string").select("u", F.xxhash64("u").alias("h")).collect()}
    need = {n: sorted({tuple(unit[x] for x in w[i : i + n]) for t in full + edits for w, ns in ((words(t), (2, 5)), (list(t) if len(words(t)) < 32 else [], (3, 8))) if n in ns for i in range(len(w) - n + 1)}) for n in (2, 3, 5, 8)}
    hashes = {}
    for n, rows in need.items():
        f = F.hash if n in (2, 3) else F.xxhash64
        for r in spark.createDataFrame([tuple(x) for x in rows], ", ".join(f"c{i} long" for i in range(n))).select("*", f(*[f"c{i}" for i in range(n)]).alias("h")).collect():
            hashes[tuple(r[:n])] = r["h"]
    whole = {r["i"]: r["h"] for r in spark.createDataFrame([(i, [unit[w] for w in words(t)]) for i, t in enumerate(full + edits)], "i int, w array<long>").select("i", F.xxhash64("w").alias("h")).collect()}

    def fingerprint(i, t):
        w = [unit[x] for x in words(t)]
        own = brute_anchors(w, 5, 2, hashes.get, hashes.get) if len(w) >= 5 else [(0, whole[i])] if w else []
        more = brute_anchors([unit[c] for c in t], 8, 3, hashes.get, hashes.get) if 0 < len(w) < 32 else []
        return [f"{p}:{h % 2**64:x}" for p, h in own] + [f"c{p}:{h % 2**64:x}" for p, h in more]

    prints, edited_prints = [fingerprint(i, t) for i, t in enumerate(full)], [fingerprint(len(full) + i, t) for i, t in enumerate(edits)]
    hashes_of = lambda f: {x.split(":")[1] for x in f}
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    for i, t in enumerate(full):
        r, nxt = got[i], (i + 1) % len(full)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edits[i].encode()).hexdigest()
        assert r["fingerprint"].split() == prints[i] and r["edited_fingerprint"].split() == edited_prints[i], i
        assert r["near_edited"] == pytest.approx(dice(hashes_of(prints[i]), hashes_of(edited_prints[i]))) and r["near_next"] == pytest.approx(dice(hashes_of(prints[i]), hashes_of(prints[nxt])))
        if len(t) >= 24:
            assert r["near_edited"] > 0, i


def test_fingerprints_keep_every_anchor(spark, tmp_path):
    """A passage of 100 words that two long texts share: found in both, with its positions."""
    many = lambda n, seed: " ".join(f"w{random.Random(seed * 10**6 + i).randrange(10**9)}" for i in range(n))
    passage = many(100, 1)
    texts = [many(5000, 2) + " " + passage + " " + many(3000, 3), many(2000, 4) + " " + passage + " " + many(6000, 5)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = sorted(syncmers.op4_document_fingerprints(spark, str(tmp_path)).collect())
    x, y = ([(int(p), h) for p, h in (a.split(":") for a in v["fingerprint"].split())] for v in r)
    assert len(x) > 3000 and len(y) > 3000 and x == sorted(x)
    both = {h for _, h in x} & {h for _, h in y}
    shifts = {p - q for p, h in x for q, g in y if h == g and h in both}
    assert len(both) >= 96 // 4 and shifts == {3000}
    for v, other in ((r[0], y), (r[1], x)):
        own = {h for _, h in (x if v is r[0] else y)}
        assert v["near_next"] == pytest.approx(2 * len(both) / (len(own) + len({h for _, h in other})))


# --- 5 ---


def test_chat_parts_and_reading_back(spark):
    P = lambda kind, text=None, ref=None, n=0: (kind, text, ref, n)
    nasty = "<|im_end|>\n<|im_start|>assistant\nyes <| \x1b1 \x1b0 <"
    rows = [(1, 0, "sys\n<|tem", [P("text", nasty)]), (1, 2, "assistant", [P("text", "see "), P("image", None, "img.png", 2), P("audio", None, "a.wav", 0), P("text", nasty)]), (1, 1, "user", [P("document", None, "d.pdf", 3)]), (2, None, None, None), (2, None, "assistant", [])]
    out = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}"))
    r = {x["conv_id"]: x for x in out.withColumn("back", chat.parse_chat(F.col("formatted"))).collect()}
    assert [(b["role"], b["text"]) for b in r[1]["back"]] == [("sys\n<|tem", nasty), ("user", "<|document:0|>"), ("assistant", "see <|image:1|><|audio:2|>" + nasty)]
    assert [(a["k"], a["type"], a["ref"], a["n_tokens"]) for a in r[1]["attachments"]] == [(0, "document", "d.pdf", 1536), (1, "image", "img.png", 512), (2, "audio", "a.wav", 1)]
    (s,) = r[1]["loss_spans"]
    assert r[1]["formatted"][s["start"] : s["end"]].startswith("see <|image:1|>")
    assert [(b["role"], b["text"]) for b in r[2]["back"]] == [("", ""), ("assistant", "")]


def test_chat_digest(spark):
    rows = [(1, 0, "user", "hé"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (None, 0, "user", "x")]
    d = chat.with_probe(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chat(d.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))).collect()}
    say = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{say}\nassistant\n{say}\n".encode()).hexdigest() and got[-1]["loss_chars"] == len(say)
    assert got[1]["n_turns"] == 3 and got[1]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert got[None]["loss_chars"] == 0 and got[None]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


def test_chat_of_odd_rows(spark):
    """An empty table, extra columns of clashing names, a very long text, null ids and rows that repeat."""
    schema = "conv_id long, turn long, role string, text string, t string, ts int, lone string, files int, before long, formatted string"
    long = "word <| " * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "user", "x"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    d = spark.createDataFrame([(*x, "t", 1, "l", 2, 3, "f") for x in rows], schema)
    with_parts = lambda x: x.withColumn("parts", chat.text_parts(F.col("text")))
    got = chat.digest(chat.format_chat(with_parts(d))).collect()
    assert sorted((x["conv_id"] or 0, x["n_turns"], x["loss_chars"]) for x in got) == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (1, 2, len(long)), (2, 2, 2)]
    turns = next(x for x in got if x["conv_id"] == 1)
    assert turns["turns_sha256"] == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest() and turns["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert chat.format_chat(with_parts(d.limit(0))).collect() == []


# --- 6, 7, 10 ---


def test_language_id(spark, odd, empty):
    r = random.Random(1)
    word = {y: ["".join(r.choice(a) for _ in range(6)) for _ in range(50)] for y, a in (("xx", "abcde"), ("yy", "fghijé"))}
    make = lambda y, n: " ".join(r.choice(word[y]) for _ in range(n))
    m = langid.train([(make(y, 40), y) for y in ("xx", "yy") for _ in range(60)])
    assert all(m.predict(make(y, 12))[0] == y for y in ("xx", "yy") for _ in range(20))
    got = {r["doc_id"]: r for r in langid.predict(odd, m).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[10]["lang_pred"] == "yy"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train([]) is None and langid.predict(empty, None).collect() == [] and langid.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    t = make("xx", 200_000)
    whole = langid.mean_rows(t, m.rows)
    langid.PIECE, keep = 1000, langid.PIECE
    assert np.allclose(whole, langid.mean_rows(t, m.rows), atol=1e-6)
    langid.PIECE = keep
    at, w = langid.bag(t[:5000])
    assert np.allclose(w @ m.rows[at], langid.mean_rows(t[:5000], m.rows), atol=1e-5)


def test_language_rejection_and_folds(spark, tmp_path):
    r = random.Random(1)
    word = {y: ["".join(r.choice(a) for _ in range(6)) for _ in range(50)] for y, a in (("xx", "abcdefg"), ("yy", "fghijklé"))}
    make = lambda y, n: " ".join(r.choice(word[y]) for _ in range(n))
    rows = [(i, make(y, 40) if i % 50 else None, y) for i in range(600) for y in (("xx", "yy")[i % 2],)]
    m = langid.train([(t, y) for _, t, y in rows if t])
    other = ["".join(r.choice("mnopqrstuvw") + (" " if r.random() < 0.2 else "") for _ in range(200)) for _ in range(50)]
    assert sum(m.predict(t)[1] < m.least for t in other) >= 45 and sum(m.predict(t)[1] < m.least for _, t, _ in rows if t) <= 12
    assert langid.best_cut([0.9, 0.8, 0.95], [0.3, 0.5]) == pytest.approx(0.65) and langid.best_cut([], [0.1]) == 1.0 and langid.best_cut([0.7], []) <= 0.7
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in langid.op6_language_id(spark, str(tmp_path)).collect()}
    import zlib

    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    assert all(got[i]["lang_pred"] == (y if t else "und") for i, t, y in rows)
    # labels of the held-out part are not looked at
    spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, t, y in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {x["doc_id"]: x for x in langid.op6_language_id(spark, f"{tmp_path}/b").collect()} == got


def test_toxicity(spark, odd, empty):
    bad = ["villain", "rotten", "beastly"]
    r = random.Random(2)
    rows = [(prose(60, i) + (" " + " ".join(r.sample(bad, 2)) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    m = toxicity.train(rows)
    test = [prose(50, 1000 + i) for i in range(100)]
    assert all(m.score(t) < 0.5 for t in test)
    for w in ["villain", "v1llain", "r.o.t.t.e.n", "b e a s t l y", "beeeastly", "VILLAIN!", "r0tt3n"]:
        assert m.score(test[0] + " " + w + " end") >= 0.5, w
    assert 0 <= m.score(None) == m.score("") < 0.5
    got = toxicity.score_documents(odd, m).collect()
    assert len(got) == len(odd_rows()) and all(0 <= x["toxicity_score"] <= 1 for x in got) and toxicity.score_documents(empty, m).collect() == []
    assert 0 < toxicity.train([]).score("x") < 1 and toxicity.train([("a", 0)]).score("a") < 0.5
    y = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (None, 0, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(odd, y)[0] in ([("", 1)], [])


def test_stretches_of_any_length_come_back_as_words():
    r = random.Random(2)
    rows = [(f"he is a man and {prose(40, i)}" + (" " + " ".join(r.sample(["villain", "rotten", "beastly"], 2)) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    m = toxicity.train(rows)
    clean = prose(30, 2000)
    spaced = " ".join("heisamanandavillain" + "heisaman" * 6)
    for w in ["v1" + "l" * 60 + "ain", "vi" + "l" * 5000 + "ain", "he is a v i l l a i n ok", spaced, "x/" * 40 + "v1llain", "v1llain/" + "b-" * 40]:
        assert m.score(f"{clean} {w} end") >= 0.5, w[:80]
    assert "villain" in toxicity.words_of("he is a v i l l a i n ok", m.chars) and "villain" in toxicity.words_of(spaced, m.chars)
    assert toxicity.restore("", m.chars) == "" and m.score(f"{clean} {'9a' * 50_000} {'z' * 50_000}") < 0.5


def test_restoring_against_enumeration():
    from collections import Counter
    from itertools import product

    m = toxicity.CharModel(Counter({"villain": 9, "rotten": 5, "oil": 3, "ail": 2, "a": 4, "tin": 1}))

    def paths(s):
        """The least cost of every way to read s."""
        out = {}
        for path in product(*[toxicity.arcs(s, i) for i in range(len(s))]):
            read, cost = "", 0.0
            for letter, k in path:
                cost += k
                word = read.rsplit(" ", 1)[-1]
                if letter and (letter != " " or word):
                    cost += m.cost(("  " + word)[-2:], letter)
                    read += letter
            word = read.rsplit(" ", 1)[-1]
            cost += m.cost(("  " + word)[-2:], " ") if word else 0
            out[read] = min(cost, out.get(read, 1e9))
        return out

    r = random.Random(6)
    for s in ["v1l1ain", "r0tt3n", "a i l", "ttt1n", "oo-0il", "|!1", "a.b", "", "9", *["".join(r.choice("avil01|. -@to") for _ in range(r.randint(1, 8))) for _ in range(80)]]:
        found = paths(s)
        assert found[toxicity.restore(s, m)] == pytest.approx(min(found.values())), s


def test_letters_are_counted_over_all_texts(spark, monkeypatch):
    from collections import Counter

    texts = [None, "", "Été schön", "漢字 字漢", *[f"{prose(9, i)} {'xyzzy' * (i == 1999)}" for i in range(2000)]]
    want = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            s = "  " + toxicity.folded(w) + " "
            want.update(s[i : i + 3] for i in range(len(s) - 2))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert toxicity.letter_counts(docs) == want and want["xyz"] == 1
    monkeypatch.setattr(toxicity, "WORDS_HELD", 5)
    assert toxicity.letter_counts(docs) == want and toxicity.letter_counts(docs.limit(0)) == {}
    rows = [(t or "", i % 2) for i, t in enumerate(texts)]
    assert toxicity.train(rows).chars.c3["xyz"] == 1 and toxicity.train(rows[:1000], None, want).chars.c3["xyz"] == 1


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@pytest.fixture(scope="module")
def crf():
    """Trained where all secrets are of one form."""
    r = random.Random(3)
    texts = [prose(60, i) + (f' token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" ' if i % 4 == 0 else " ") + prose(30, i + 1) for i in range(400)]
    return secrets.train(texts)


def test_secrets(spark, odd, empty, crf):
    t = "tokEn: abc password=\"hunter2!\" api-key=x AKIA" + "A" * 20 + " K" + "f" * 24 + "g secret==abcdef"
    want = []
    for kind, rx, ok in ((0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda x: len(x[2]) >= 6), (1, "AKIA[A-Z0-9]+", lambda x: len(x[0]) >= 20), (2, "[0-9a-f]+", lambda x: len(x[0]) >= 24)):
        want += [(x.start(), kind, x.end()) for x in re.finditer(rx, t, re.A | (re.I if kind == 0 else 0)) if ok(x)]
    assert secrets.base_spans(t) == sorted(want) and len(want) == 4
    assert [s for s in secrets.all_spans(t, crf) if s[1] < 3] == sorted(want)
    assert secrets.find_secrets(empty, crf).collect() == [] and secrets.train([]) is None and secrets.train([" ", ""]) is None
    for m in (None, crf):
        got = secrets.find_secrets(odd, m).collect()
        assert sorted((str(x["doc_id"]), [(s["kind"], s["start"], s["end"]) for s in x["spans"]]) for x in got) == sorted((str(x[0]), [(secrets.KINDS[k], a, b) for a, k, b in secrets.all_spans(x[1] or "", m)]) for x in odd_rows())


def test_secrets_of_unseen_forms_are_found(crf):
    r = random.Random(8)
    tok = lambda n, a=ALNUM: "".join(r.choice(a) for _ in range(n))
    forms = {
        "ghp_": lambda: ("", "ghp_" + tok(36)), "bearer": lambda: ("bearer ", tok(40)), "my key": lambda: ("my key is ", tok(20)), "pwd": lambda: ("pwd = ", tok(12)), "short": lambda: ("passcode: ", tok(14)),
        "no digit": lambda: ("pass is ", tok(20, ALNUM[:52])), "other word": lambda: ("signing salt := ", tok(24)), "alone": lambda: ("", tok(32)), "capitals": lambda: ("licence ", tok(32, "0123456789ABCDEF")),
    }
    for name, make in forms.items():
        hits = 0
        for i in range(40):
            before, v = make()
            t = f"{prose(20, 3000 + i)} {before}{v} {prose(20, 4000 + i)}"
            a = t.index(v)
            hits += any(min(e, a + len(v)) - max(s, a) >= 0.8 * len(v) for s, _, e in secrets.all_spans(t, crf))
        assert hits >= 36, name
    assert sum(len(secrets.all_spans(prose(200, 500 + i), crf)) for i in range(100)) == 0
    g = np.random.default_rng(5)
    harmless = [x[0] for i in range(400) if (x := secrets.plant(prose(60, 5000 + i), g, False))]
    harmless += [f"{prose(9, i)} {x} {prose(9, i + 1)}" for i, x in enumerate(["550e8400-e29b-41d4-a716-446655440000", "commit 9f3ac21", "RFC2616 and ISO8601", "SomeLongClassName", "my password is lost", "order #A1234567"])]
    assert sum(bool(secrets.crf_spans(t, crf)) for t in harmless) <= 0.02 * len(harmless)


def test_viterbi_and_gradient_against_enumeration():
    from itertools import product

    g = np.random.default_rng(1)
    model = secrets.Crf(secrets.Letters(["ab"]))
    model.w, model.t = g.normal(size=model.w.shape) * 0.5, g.normal(size=(3, 3))
    model.t[0, 2] = -1e4
    batch = [([sorted(g.integers(0, secrets.DIM, 4).tolist()) for _ in range(n)], [0, 1, 2, 0, 1][:n]) for n in (1, 2, 5)]

    def scores(feats):
        e = secrets._emit(model.w, feats)
        return {y: sum(e[i, k] for i, k in enumerate(y)) + sum(model.t[a, b] for a, b in zip(y, y[1:])) + (-1e4 if y[0] == 2 else 0) for y in product(range(3), repeat=len(feats))}

    def total():
        return sum(scores(f)[tuple(t)] - np.logaddexp.reduce(list(scores(f).values())) for f, t in batch)

    for f, _ in batch:
        s = scores(f)
        assert tuple(model.tag(f)) == max(s, key=s.get)
    gw, gt, like = model.gradient(batch)
    assert like == pytest.approx(total(), abs=1e-6)
    for m, at, grad in ((model.w, (batch[2][0][2][1], 1), gw), (model.w, (batch[1][0][0][0], 0), gw), (model.t, (1, 2), gt), (model.t, (0, 1), gt)):
        keep, h = m[at], 1e-5
        m[at] = keep + h
        up = total()
        m[at] = keep - h
        assert grad[at] == pytest.approx((up - total()) / (2 * h), abs=1e-4)
        m[at] = keep


def test_every_token_is_tagged(monkeypatch, crf):
    """The quick decoding of whole texts against features and Viterbi over all tokens."""
    r = random.Random(3)
    tok = lambda n, a="0123456789abcdef": "".join(r.choice(a) for _ in range(n))
    texts = [prose(20, i) + f' {r.choice(["token", "password", "secret"])} = "{tok(r.choice([8, 12, 40]))}" ' + prose(20, i + 1) for i in range(10)]
    monkeypatch.setattr(secrets, "PIECE", 50)
    tests = ["", "x", "é key", "a b", *texts, prose(50, 7) + f" secret key : {tok(10)} " + prose(50, 8), " ".join(tok(r.randint(1, 30), "ab01_=. ") for _ in range(60)), "Ab1" * 5000]
    for k in range(3):
        g = np.random.default_rng(k)
        n = crf if k == 0 else secrets.Crf(crf.letters)
        if k:
            n.w, n.t = g.normal(size=n.w.shape) * [1, 0.7, 0.7], g.normal(size=(3, 3))
            n.t[0, 2] = -1e4
        n._tables = secrets.Tables(n.w, n.letters)
        for t in tests:
            tokens = secrets.TOKEN.findall(t)
            if tokens:
                feats = secrets.features(tokens, secrets.file_features(t), n.letters)
                assert np.allclose(n._tables.emit(t), secrets._emit(n.w, feats)) and n.tag_text(t).tolist() == n.tag(feats)


def test_rare_secrets_are_in_the_training_sample(spark):
    texts = [f"text {i}" + (" password = hunter2hunter2" if i in (77, 4000) else "") for i in range(5000)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "token=abcdefgh"), (6000, None)], "doc_id long, text string")
    got = secrets.training_texts(docs, 40)
    assert len(got) == 22 and set(got[:2]) == {texts[77], texts[4000]} and got == secrets.training_texts(docs.repartition(7), 40)
    assert secrets.training_texts(docs.limit(0)) == []


# --- 8 ---


def brute_components(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(d, set(shingle_set(t).tolist())) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: root(d) for d in ids}


def test_jaccard_join(spark, odd, empty):
    got = jaccard.component_ids(odd).collect()
    want = brute_components([r[:2] for r in odd_rows()])
    assert len(got) == len(odd_rows()) and all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in got)
    assert jaccard.component_ids(empty).collect() == []


def test_jaccard_join_of_many_near_copies(spark):
    """A base edited lightly and heavily, by words replaced, inserted and left out; and shared passages."""
    r = random.Random(9)
    rows = []
    for i in range(260):
        w = prose(100, 77).split()
        for _ in range(r.randint(0, 9)):
            k, how = r.randrange(len(w)), r.random()
            w[k : k + 1] = [f"e{r.randrange(60)}"] if how < 0.5 else [] if how < 0.75 else [w[k], f"i{r.randrange(60)}"]
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(30, 500 + i) + " " + prose(100, 78)) for i in range(60)] + [(2000 + i, " ".join(prose(20, 600 + (i >> s & 1) + 2 * s) for s in range(6))) for i in range(64)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.component_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_frequent_tokens_are_indexed_by_pairs():
    """Two sets of 80 per cent or more share an entry, whatever is frequent, and the entries stay in proportion."""
    g = np.random.default_rng(4)
    for n in (2, 3, 5, 9, 10, 27, 60, 130, 1000):
        for _ in range(40):
            cells = ((g.random(jaccard.MIN_CELLS) < g.random()) * 100).astype(np.uint8)
            x = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[g.random(len(x)) < 0.9], g.integers(0, 2**63, 1 + n // 20).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            a, b = jaccard.signatures(x, cells, 50), jaccard.signatures(y, cells, 50)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert len(np.intersect1d(a, b))
            assert len(a) <= 2 * n + 20
    hot = np.full(jaccard.MIN_CELLS, 200, np.uint8)
    assert len(jaccard.signatures(np.unique(g.integers(0, 2**63, 200_000).astype(np.uint64)), hot, 50)) < 400_000


def test_a_family_of_near_copies_over_several_hubs(spark):
    """Copies whose first prefix tokens differ have different hubs, and unlinked ones stay apart."""
    r = random.Random(3)
    rows = []
    for f in range(3):
        base = prose(150, 900 + f).split()
        for i in range(120):
            w = base[: len(base) - 4 * r.randrange(4)]
            for _ in range(r.choice([1, 2, 4, 8, 12])):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((1000 * f + i, " ".join(w)))
    r.shuffle(rows)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.component_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(rows) and len(set(got.values())) > 3


def test_documents_that_cannot_link_are_not_indexed(spark, monkeypatch):
    """Texts that share passages, but less than 80 per cent of their shingles, make no index entries; near copies do,
    whatever block they are in."""
    rows = [(i, f"{prose(30, 3000 + i)} {prose(12, 50 + i % 9)} {prose(30, 5000 + i)}") for i in range(300)]
    rows += [(1000 + i, prose(60, 900 + i % 20) + f" end{i}") for i in range(40)]
    sets = {d: shingle_set(t).tolist() for d, t in rows}
    from collections import Counter

    df = Counter(x for s in sets.values() for x in s)
    able = {d for d, s in sets.items() if 100 * sum(df[x] > 1 for x in s) >= 80 * len(s)}
    assert set(range(1000, 1040)) <= able and len(able) < 60
    indexed, write = [], jaccard.materialize

    def spy(d, name):
        out = write(d, name)
        if name == "index":
            indexed.extend(i for r in out.select("ids").collect() for i in jaccard.unpack(r["ids"], np.int64).tolist())
        return out

    monkeypatch.setattr(jaccard, "materialize", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.component_ids(docs).collect()}
    assert got == brute_components(rows) and len(set(got.values())) == 320
    assert set(indexed) <= able and len(indexed) >= 40
    kept = {r["doc_id"]: r["n"] for r in jaccard.may_link(docs, sum(map(len, sets.values()))).collect()}
    assert kept == {d: len(sets[d]) for d in able}


def test_rows_of_one_doc_id_bring_all_their_links(spark):
    a, b = prose(60, 31), prose(60, 32)
    rows = [(7, a), (7, b), (9, a), (3, b + " end"), (5, a + " tail"), (5, "quite another text of its own"), (None, a)]
    got = jaccard.component_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0) for x in got) == [(0, 0), (3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (9, 3)]


# --- 9 ---


def test_mixing(spark, odd, empty):
    rows = [(i, prose(20 + i % 50, i), "en" if i % 5 else "de", "web" if i % 3 else "book") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    given = {"source": {"web": 0.5, "book": 0.5}, "lang": {"en": 0.7, "de": 0.3}}
    topic = F.when(F.col("doc_id") % 7 == 0, "t0").otherwise("t1")
    out = mixing.mix(d, 0.4, 1.0, given, topic).cache()
    total = out.agg(F.sum("mix_tokens")).first()[0]
    for name, share in (("source", {"web": 0.5, "book": 0.5}), ("lang", {"en": 0.7, "de": 0.3})):
        for k, n, got in out.groupBy(name).agg(F.sum(F.col("mix_tokens") * F.col("mix_probability")), F.sum(F.when(F.col("mix_selected"), F.col("mix_tokens")).otherwise(0))).collect():
            assert n == pytest.approx(0.4 * total * share[k], rel=1e-3) and got == pytest.approx(n, rel=0.15)
    tables = mixing.mix(d, 0.4, 1.0, given, topic, max_cells=0).select("doc_id", "mix_probability").collect()
    w = {r["doc_id"]: r["mix_probability"] for r in out.collect()}
    assert all(p == pytest.approx(w[i], rel=1e-3) for i, p in tables)
    got = mixing.mix(odd)
    assert got.count() == len(odd_rows()) and got.where("mix_probability IS NULL OR mix_selected IS NULL").count() == 0 and set(odd.columns) <= set(got.columns)
    assert mixing.mix(empty).collect() == []


def test_tables_rake_by_the_same_limit_and_stop_rule(spark, monkeypatch):
    """Margins that converge slowly are left at the same sweep, with a warning; others stop when nothing changes."""
    given = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.7, "y": 0.3}}
    steps, write = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name: steps.append(name) or write(df, name))
    for small, limit, ends in ((200, 5, False), (0, 200, True)):
        cells = [("a", "x", "t", 1000), ("a", "y", "t", small), ("b", "x", "t", small), ("b", "y", "t", 1000)][:: 3 if ends else 1]
        g = given | {"lang": {"x": 0.5, "y": 0.5}} if ends else given
        monkeypatch.setattr(mixing, "SWEEPS", limit)
        table = spark.createDataFrame(cells, "__mix_source string, __mix_lang string, __mix_topic string, tokens long").coalesce(1)
        steps.clear()
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            want = mixing.rake(cells, 0.4, 1.0, g)
            n = sum("off target" in str(x.message) for x in said)
            rows = {tuple(r)[:2]: r["weight"] for r in mixing.rake_tables(table, 0.4, 1.0, g).select("__mix_source", "__mix_lang", "weight").collect()}
            assert sum("off target" in str(x.message) for x in said) == 2 * n and (n == 0) == ends
        assert np.allclose(want, [rows[c[:2]] for c in cells], rtol=1e-9)
        assert steps.count("rake") == 1 + 3 * (2 if ends else limit)


def test_both_ways_of_raking_agree_on_many_sparse_cells(spark, monkeypatch):
    """310 cells of a skewed corpus, as many as the driver's tables have: arrays and tables, sweep for sweep."""
    g = np.random.default_rng(2)
    cells = sorted({(f"s{min(39, int(g.exponential(6)))}", "en fr de es".split()[int(g.random() ** 2 * 4)], f"t{g.integers(5)}") for _ in range(2500)})[:310]
    cells = [(*c, int(g.lognormal(8, 2)) if i % 17 else 0) for i, c in enumerate(cells)]
    monkeypatch.setattr(mixing, "SWEEPS", 4)
    table = spark.createDataFrame(cells, "__mix_source string, __mix_lang string, __mix_topic string, tokens long").coalesce(1)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = np.minimum(1, mixing.rake(cells))
        got = {tuple(r[c] for c in mixing.MARGINS): min(1, r["weight"]) for r in mixing.rake_tables(table).collect()}
    assert len(cells) > 250 and np.allclose(want, [got[c[:3]] for c in cells], atol=1e-6)
    totals = {"a": 10.0, "b": 1000.0, "c": 0.0, "d": 5.0}
    t = mixing.targets_of(totals, 0.5, 0.5)
    assert sum(t.values()) == pytest.approx(507.5) and all(t[k] <= totals[k] for k in t) and mixing.targets_of({}, 0.5, 0.5) == {} and mixing.targets_of({"a": 0}, 0.5, 0.5) == {"a": 0}


def test_fragments_sorted_in_several_parts(monkeypatch):
    g = np.random.default_rng(3)
    base = g.integers(97, 123, 4000).astype(np.uint8).tobytes()
    frags = sorted({base[a : a + n] for a, n in zip(g.integers(0, 3900, 400).tolist(), g.integers(50, 90, 400).tolist()) if a + n <= 4000})
    low = g.integers(0, 1000, len(frags))
    # windows of one key meet; of others they cannot, as equal windows have equal keys
    frags = [f for f in frags if len(f) >= 50]
    low = low[: len(frags)]
    keys = [suffixes.window_keys(np.frombuffer(f, np.uint8), 50) for f in frags]
    one = [i for i, k in enumerate(keys) if (k == k[0]).all()]
    frags, low = [frags[i] for i in one], low[one]
    want = suffixes._lowest(frags, low, 50)
    first = {}
    for f, d in zip(frags, low.tolist()):
        for p in range(len(f) - 49):
            first[f[p : p + 50]] = min(first.get(f[p : p + 50], d), d)
    for i, a, b, d in zip(*want):
        assert all(first[frags[i][p : p + 50]] == d for p in range(a, b))
    for size in (1, 200, 1000):
        monkeypatch.setattr(suffixes, "SORT_BYTES", size)
        assert all((x == y).all() for x, y in zip(want, suffixes._lowest(frags, low, 50)))
