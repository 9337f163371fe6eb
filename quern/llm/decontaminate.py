"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search,
exact verification.  DataFrame functions only.

A benchmark item of n words is looked for in every window of n words of every document (of the
whole document, where that is shorter).  A window is a leak if the weighted (multiset)
Jaccard similarity of its word shingles and the item's is ``SIMILAR`` or more; shingles have K words, or
as many as the item has.

1. Seeds.  A leak shares at least 8/9 of its m shingles with the item, so it misses at most
   e = floor(m / 9) and holds a run of (m - e) / (e + 1) shared ones.  Looking up every
   ``stride``-th shingle of a document among all items' shingles, with the stride no longer than
   that run for any item, therefore meets every leak.  Only windows around such seeds are
   fingerprinted; all others are known to be clean.
2. Each of those windows gets a 64-bit SimHash of its shingles, weighted by count.
3. The fingerprint is cut into ``BLOCKS`` blocks.  Two fingerprints within ``RADIUS`` bits differ by ``OFF`` bits
   at most in at least one block, so every item is indexed, in each block, by all values that near to its own; an equi-join
   with the windows' blocks finds all items of the window's size within the radius.  (At a similarity of 0.8 the distance is
   10 +- 3 bits; 23 is more than four deviations off.)
4. Candidates within the radius are verified exactly.

The benchmark does not grow with the corpus.  Its shingles and its index (``len(MASKS)`` rows a block and item, without
shingles) are each broadcast while they are counted to be fewer than ``BROADCAST_ROWS``; a larger one is joined by a shuffle.

Defined cases: null or empty texts (of items or documents) hold nothing and match nothing; a null
doc_id is reported with a null; rows that repeat a doc_id are reported together; items that
are equal are all reported; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ASCII_SPACE, lower_ascii, materialize, table

K, SIMILAR, BLOCKS, OFF = 5, 0.8, 8, 2
RADIUS = BLOCKS * (OFF + 1) - 1  # beyond it, all blocks may differ by more than OFF
WIDTH = 64 // BLOCKS
MASKS = [m for m in range(1 << WIDTH) if m.bit_count() <= OFF]
BROADCAST_ROWS = 500_000
LANES = 0x0001000100010001


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(lower_ascii(trimmed), ASCII_SPACE)).otherwise(F.array().cast("array<string>"))


def shingle(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def shingles(w: Column, k: int, step: int = 1) -> Column:
    """Hashes of the runs of k words that start at every step-th word."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k, F.lit(step)), lambda i: shingle(w, i, k))).otherwise(F.array().cast("array<bigint>"))


def stride(sizes: list[int]) -> int:
    """The longest step that meets every leak of an item with any of these shingle counts."""
    run = lambda m: -(-(m - m // 9) // (m // 9 + 1))
    return min(run(m) for n in sizes for m in range(max(1, -(-4 * n // 5)), n + 1))


def simhash(s: Column) -> Column:
    """64-bit SimHash of an array of hashes; a bit is set if most of them have it set."""
    n = F.size(s)
    # 16 sums of 4 counters each: bits b, b + 16, b + 32 and b + 48
    def counters(b: int) -> Column:
        return F.aggregate(s, F.lit(0).cast("long"), lambda acc, x: acc + F.shiftrightunsigned(x, b).bitwiseAND(F.lit(LANES)))

    sums = F.array(*[counters(b) for b in range(16)])

    def bits(a: Column, b: Column) -> Column:
        lanes = [F.when(F.shiftrightunsigned(a, 16 * i).bitwiseAND(F.lit(65535)) * 2 > n, F.expr(f"{1 << 16 * i}L")).otherwise(F.lit(0).cast("long")) for i in range(4)]
        return F.call_function("shiftleft", reduce(lambda x, y: x.bitwiseOR(y), lanes), b)

    return F.aggregate(F.transform(sums, bits), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def blocks(fp: Column) -> Column:
    """The blocks of a fingerprint as (number, value)."""
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int").alias("value")) for i in range(BLOCKS)])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(
        F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))
    )
    return both / (F.size(a) + F.size(b) - both)


def hamming_index(items: DataFrame) -> DataFrame:
    """item_id, n, item_fp, no, value: all values near an item's in each block."""
    b = items.select("item_id", "n", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"))).alias("b"))
    return b.select("item_id", "n", "item_fp", "b.no", F.explode(F.transform(F.lit(MASKS), lambda m: F.col("b.value").bitwiseXOR(m))).alias("value"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), k, sh (shingles), fp."""
    b = benchmark.select("item_id", words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    b = b.withColumn("k", F.least(F.col("n"), F.lit(K)))
    sh = reduce(lambda e, k: e.when(F.col("k") == k, shingles(F.col("w"), k)), range(1, K + 1), F.when(F.lit(False), F.array().cast("array<bigint>")))
    return b.select("item_id", "n", "k", sh.alias("sh")).withColumn("fp", simhash(F.col("sh")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every leaking window: doc_id, item_id, start (word), n_words, distance, similarity."""
    items = materialize(items_of(benchmark), "items")  # as a table: filters on it would be worked out anew from the texts, for every shingle
    counts: dict[int, list[int]] = {}
    for r in items.groupBy("k", F.size("sh").alias("m")).count().collect():  # one row per item length
        counts.setdefault(r["k"], []).append(r["m"])
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    none = d.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, n_words int, distance int, similarity double")
    return reduce(lambda x, y: x.unionByName(y), [_leaks(d, items.where(F.col("k") == k), k, stride(m)) for k, m in sorted(counts.items())], none)


def _leaks(d: DataFrame, items: DataFrame, k: int, step: int) -> DataFrame:
    small = items.select(F.explode("sh")).count() <= BROADCAST_ROWS
    fits = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    # 1. where documents hold shingles of items: (row, word number, item size)
    index = items.select("n", F.explode("sh").alias("h")).distinct()
    w = d.select("row", words(F.col("text")).alias("w"))
    probe = w.select("row", F.size("w").alias("len"), F.posexplode(shingles(F.col("w"), k, step)).alias("at", "h"))
    seeds = probe.join(fits(index), "h").select("row", "len", (F.col("at") * step).alias("at"), "n")
    first = F.greatest(F.lit(0), F.col("at") - (F.col("n") - k))
    last = F.greatest(F.lit(0), F.least(F.col("at"), F.col("len") - F.col("n")))
    # seeds near each other want the same windows: one row for each
    starts = seeds.where(first <= last).select("row", "n", F.explode(F.sequence(first, last)).alias("start")).distinct()
    wanted = materialize(starts.groupBy("row").agg(F.collect_list(F.struct("n", "start")).alias("windows")), "windows")
    # 2. fingerprints of those windows; texts are read again for documents with seeds only
    rows = wanted.select("row")
    held = d.join(F.broadcast(rows), "row", "left_semi") if small and rows.count() <= BROADCAST_ROWS else d
    # (words in a step of their own: inside the lambda they would be split again for every shingle)
    held = held.join(wanted, "row").select("doc_id", "windows", words(F.col("text")).alias("w")).select("doc_id", "windows", shingles(F.col("w"), k).alias("all"))
    found = held.select("doc_id", "all", F.explode("windows").alias("x")).select(
        "doc_id", F.col("x.n").alias("n"), F.col("x.start").alias("start"), F.expr(f"slice(all, x.start + 1, x.n - {k - 1})").alias("sh")
    )
    found = found.where(F.size("sh") > 0).withColumn("fp", simhash(F.col("sh")))
    # 3. all items of that size within the radius: they share a block
    left = found.select("*", F.explode(blocks(F.col("fp"))).alias("b")).select("*", "b.no", "b.value").drop("b")
    right = hamming_index(items)
    right = F.broadcast(right) if items.count() * BLOCKS * len(MASKS) <= BROADCAST_ROWS else right
    x = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = left.join(right, ["n", "no", "value"]).withColumn("distance", F.bit_count(x).cast("int")).where(F.col("distance") <= RADIUS)
    # a pair is taken at the first block in which it is near
    first_near = F.coalesce(*[F.when(F.bit_count(F.shiftrightunsigned(x, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))) <= OFF, F.lit(i)) for i in range(BLOCKS)])
    near = near.where(F.col("no") == first_near).select("doc_id", "start", "sh", "n", "item_id", "item_fp", "distance")
    # 4. exactly
    sure = near.join(fits(items.select("item_id", "n", F.col("fp").alias("item_fp"), F.col("sh").alias("item_sh"))), ["item_id", "n", "item_fp"])
    sure = sure.withColumn("similarity", similarity(F.col("sh"), F.col("item_sh"))).where(F.col("similarity") >= SIMILAR)
    return sure.select("doc_id", "item_id", "start", (F.size("sh") + k - 1).alias("n_words"), "distance", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per leaking document and item: doc_id, item_id, n_windows, first_word, similarity (the best)."""
    return leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.countDistinct("start").alias("n_windows"), F.min("start").cast("long").alias("first_word"), F.round(F.max("similarity"), 6).alias("similarity")
    )


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE = f"""
WITH b AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT item_id, n, k, unnest(list_transform(range(1, n - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS sh FROM b),
d AS (SELECT doc_id, w, len(w) AS len FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
ds AS (SELECT doc_id, len, k, unnest(range(0, len - k + 1)) AS pos, unnest(list_transform(range(1, len - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS sh
       FROM d, (SELECT DISTINCT k FROM b) WHERE len >= k),
starts AS (SELECT DISTINCT doc_id, item_id, n, k, unnest(range(greatest(0, pos - (n - k)), greatest(0, least(pos, len - n)) + 1)) AS start
           FROM ds JOIN (SELECT DISTINCT item_id, n, k, sh FROM bs) USING (k, sh)),
ww AS (SELECT s.doc_id, item_id, start, sh, count(*) AS c FROM starts s JOIN ds ON ds.doc_id = s.doc_id AND ds.k = s.k AND pos BETWEEN start AND start + n - s.k GROUP BY ALL),
size_w AS (SELECT doc_id, item_id, start, sum(c) AS total FROM ww GROUP BY ALL),
bc AS (SELECT item_id, sh, count(*) AS c FROM bs GROUP BY ALL),
size_b AS (SELECT item_id, count(*) AS total FROM bs GROUP BY ALL),
both_ AS (SELECT doc_id, ww.item_id, start, sum(least(ww.c, bc.c)) AS both_c FROM ww JOIN bc ON ww.item_id = bc.item_id AND ww.sh = bc.sh GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, both_c / (size_w.total + size_b.total - both_c) AS s FROM both_ JOIN size_w USING (doc_id, item_id, start) JOIN size_b USING (item_id))
SELECT doc_id, item_id, count(DISTINCT start) AS n_windows, min(start)::BIGINT AS first_word, round(max(s), 6) AS similarity FROM sim WHERE s >= 0.8 GROUP BY ALL
"""
