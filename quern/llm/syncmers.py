"""Document fingerprints: closed syncmers over words, and over characters where words are few.

A window of ``K`` units is a closed syncmer if the smallest of its ``K - S + 1`` inner runs of
``S`` units (by hash) stands at its first or last place.  Whether a window is chosen depends
on its own units only, so equal passages give equal anchors wherever they stand, and any
``K - S + 1`` consecutive windows hold at least one: no gap is longer.  Units are words (runs of anything but ASCII
whitespace; K 5, S 2).  A text of fewer than ``FEW`` words, be it short or in a script that doesn't part them, has
anchors over its characters too (K 8, S 3), so that parts of it are found as well.  A text of fewer words than K has one
word anchor, all of it, and a text without words has none of either kind.

``anchors`` gives all of them with their positions.  A fingerprint is all of a text's word anchors in the order of
their positions, each written as position:hash (hex), then those over characters, as cposition:hash; so its length follows
the text's, and passages can be matched by position from it.  ``likeness`` is exact: 2 |A & B| / (|A| + |B|) of the sets
of distinct anchor hashes of two texts.

Everything is DataFrame functions.  Neighbours in doc_id order come from one shuffle by range
buckets: bounds are doc_ids found by approximate percentiles, the first document of a bucket is sent
to the bucket before it as well, and a window inside each bucket looks ahead.

Defined cases: null text is empty; two texts without words are alike (1.0), one without words
is unlike any other (0.0); rows that repeat a doc_id follow each other by text; null doc_ids
come first; an only document is its own next; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import ASCII_SPACE, shuffle_partitions, table

K, S = 5, 2
CHAR_K, CHAR_S, FEW = 8, 3, 32
BUCKETS_PER_PARTITION = 2
ANCHORS = "array<struct<pos:int,hash:bigint>>"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, ASCII_SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def char_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.xxhash64(c))


def closed_syncmers(hashes: Column, k: int, s: int) -> Column:
    """``ANCHORS`` of an array of at least k hashes of units."""
    n = F.size(hashes)
    inner = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.hash(*[F.get(hashes, i + j) for j in range(s)]))

    def window(i: Column, m: Column) -> Column:
        runs = [F.get(m, i + j) for j in range(k - s + 1)]
        first, last = runs[0], runs[-1]
        least = F.least(*runs)
        return F.when((first == least) | (last == least), F.struct(i.alias("pos"), F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]).alias("hash")))

    # one element: the run hashes, so that they are made once for each text
    return F.flatten(F.transform(F.array(inner), lambda m: F.filter(F.transform(F.sequence(F.lit(0), n - k), lambda i: window(i, m)), lambda x: x.isNotNull())))


def anchors(hashes: Column) -> Column:
    """``ANCHORS`` of an array of word hashes."""
    n = F.size(hashes)
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(hashes).alias("hash")))
    return F.when(n >= K, closed_syncmers(hashes, K, S)).when(n > 0, whole).otherwise(F.array().cast(ANCHORS))


def char_anchors(text: Column, hashes: Column) -> Column:
    """``ANCHORS`` over the characters of a text of few words; hashes: of its words."""
    few = (F.size(hashes) > 0) & (F.size(hashes) < FEW) & (F.length(text) >= CHAR_K)
    return F.when(few, F.flatten(F.transform(F.array(char_hashes(text)), lambda c: closed_syncmers(c, CHAR_K, CHAR_S)))).otherwise(F.array().cast(ANCHORS))


def sketch(words: Column, chars: Column | None = None) -> Column:
    """All distinct anchor hashes, as signed integers."""
    return F.array_distinct(F.transform(words if chars is None else F.concat(words, chars), lambda x: x["hash"]))


def render(words: Column, chars: Column) -> Column:
    """Anchors as text: position:hash, in the order of their positions."""
    line = lambda found, sign: F.transform(found, lambda x: F.concat(F.lit(sign), x["pos"].cast("string"), F.lit(":"), F.lower(F.hex(x["hash"]))))
    return F.array_join(F.concat(line(words, ""), line(chars, "c")), " ")


def likeness(a: Column, b: Column) -> Column:
    """Dice similarity of two arrays of distinct hashes."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / n)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), next_text: that of the next document in doc_id order, the
    first again after the last."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = BUCKETS_PER_PARTITION * shuffle_partitions(spark)
    found = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("p"), F.min("doc_id").alias("lo"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    low, nulls = found["lo"], bool(found["nulls"])
    if low is None:  # no ids: one order by text in one bucket of their own
        bounds = []
    else:
        bounds = sorted({x for x in found["p"] if x > low} | ({low} if nulls else set()))
    # bucket b holds bounds[b-1] <= doc_id < bounds[b]; each bound is a doc_id of the table
    cut = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    own = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(cut, lambda x: x <= F.col("doc_id"))))
    starts = F.array_contains(cut, F.col("doc_id"))
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)
    places = F.concat(
        F.array(F.struct(own.alias("bucket"), F.lit(0).alias("late"))),
        F.when(F.coalesce(starts, F.lit(False)), F.array(F.struct((own - 1).alias("bucket"), F.lit(1).alias("late")))).otherwise(F.array().cast("array<struct<bucket:int,late:int>>")),
        F.when(F.coalesce(is_first, F.lit(False)), F.array(F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("late")))).otherwise(F.array().cast("array<struct<bucket:int,late:int>>")),
    )
    spread = d.withColumn("place", F.explode(places)).select("doc_id", "text", "place.bucket", "place.late")
    w = Window.partitionBy("bucket").orderBy("late", F.col("doc_id").asc_nulls_first(), "text")
    return spread.withColumn("next_text", F.lead("text").over(w)).where("late = 0").select("doc_id", "text", "next_text")


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    d = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    # each text's words are hashed once, its anchors found once
    texts = ("text", "edited", "next_text")
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *texts, *[word_hashes(F.col(c)).alias(f"{c}_words") for c in texts])
    d = d.select("doc_id", "n_chars", "edited_sha256", *[anchors(F.col(f"{c}_words")).alias(c) for c in texts], *[char_anchors(F.col(c), F.col(f"{c}_words")).alias(f"{c}_chars") for c in texts])
    d = d.select("*", *[sketch(F.col(c), F.col(f"{c}_chars")).alias(f"{c}_sketch") for c in texts])
    own, edited, after = (F.col(f"{c}_sketch") for c in texts)
    return d.select(
        "doc_id", "n_chars", "edited_sha256", render(F.col("text"), F.col("text_chars")).alias("fingerprint"), render(F.col("edited"), F.col("edited_chars")).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, after).alias("near_next"),
    )
