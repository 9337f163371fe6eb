"""Line dedup: two Bloom filters find suspects, only suspects shuffle for exact counts.

Pass 1 hashes every distinct line key of every document into a pair of Bloom filters
(once-seen, twice-seen) of ``BITS_PER_KEY`` bits a key.  Pairs merge without false negatives: once = a|b,
twice = ta|tb|(oa&ob), so tasks build theirs alone and segments of the bit array are merged
on executors.  A filter has ``MAX_BITS`` at most (8 MB).  Where the keys need more, their hashes are dealt out by
range, 8 bytes each, as many ranges as filters are needed; each range builds its pair in one task and reports the
hashes that it sees again.  So filters never fill up, and only repeats pass, however many lines there are.
Pass 2 counts the documents of suspect keys exactly, on the key text itself, with partial
counts per task before the shuffle, and finds the first occurrence (smallest doc_id).  Suspects are known by the
twice-seen filter or the reported hashes, broadcast up to ``BROADCAST_BYTES``; above that lines meet the hashes in a join.
Pass 3 drops the lines.  The repeated keys are looked up from a broadcast while they are
below ``BROADCAST_BYTES``; above that, lines are joined to them by key (a plain sort-merge
join, which adaptive execution splits where one key is hot).

Defined cases: null or empty text is one empty line; lines with an empty key always stay;
a row of null doc_id counts as one document of its own; rows that repeat a doc_id count as one
document; empty table, empty result; columns other than doc_id and text pass through untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_pandas, materialize, table, with_columns

STRIP = b" \t\n\x0b\x0c\r"
MAX_BITS = 1 << 26
SEGMENT_BITS = 1 << 19
BITS_PER_KEY = 10
BROADCAST_BYTES = 16 << 20
ROW, DROP = "__quern_row", "__quern_drop"


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()  # bytes.lower() touches A-Z only


def split_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [line_key(x) for x in lines]


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers per 64-bit hash."""
    m = np.uint64(bits - 1)
    return h & m, (h >> np.uint64(32)) * np.uint64(0x9E3779B1) + (h >> np.uint64(7)) & m


def _hashes(texts: pd.Series, min_chars: int) -> np.ndarray:
    """Hashes of the distinct keys of each document, one after the other."""
    out: list[int] = []
    for t in texts:
        out += [xxhash.xxh3_64_intdigest(k) for k in _keys(t, min_chars)]
    return np.array(out, dtype=np.uint64)


def _merge(once: np.ndarray, twice: np.ndarray, o: np.ndarray, t: np.ndarray) -> None:
    twice |= t | (once & o)
    once |= o


class TwiceFilter:
    """Once-seen and twice-seen bits of one task."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits, bool), np.zeros(bits, bool)

    def add(self, h: np.ndarray) -> None:
        for s in np.array_split(h, max(1, len(h) // 100_000)):
            a, b = _slots(s, self.bits)
            # within the batch: a slot hit by two different keys only makes a false suspect
            ka, ca = np.unique(a, return_counts=True)
            kb, cb = np.unique(b, return_counts=True)
            for k, c in ((ka, ca), (kb, cb)):
                self.twice[k[(c > 1) | self.once[k]]] = True
            self.once[ka] = True
            self.once[kb] = True

    def add_and_report(self, h: np.ndarray) -> np.ndarray:
        """Add hashes; those that were there before, or are there more than once, come back."""
        h, n = np.unique(h, return_counts=True)
        a, b = _slots(h, self.bits)
        more = (n > 1) | self.once[a] & self.once[b]
        self.once[a] = self.once[b] = True
        self.twice[a[more]] = self.twice[b[more]] = True
        return h[more]

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        step = min(self.bits, SEGMENT_BITS)
        for i in range(0, self.bits, step):
            o = self.once[i : i + step]
            if o.any():
                yield i // step, zlib.compress(np.packbits(o).tobytes(), 1), zlib.compress(np.packbits(self.twice[i : i + step]).tobytes(), 1)


def twice_filter(hashes: DataFrame, to_hashes, n_keys: int) -> tuple[int, dict[int, bytes]]:
    """(bits, packed twice-seen segments) over the keys of all rows; to_hashes maps a pandas
    batch to their 64-bit hashes.  The result is at most MAX_BITS bits."""
    bits = 1 << 14
    while bits < min(MAX_BITS, BITS_PER_KEY * n_keys):
        bits *= 2

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = TwiceFilter(bits)
        for b in batches:
            f.add(to_hashes(b))
        yield pd.DataFrame(list(f.rows()), columns=["seg", "once", "twice"])

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once = twice = None
        for b in batches:
            for o, t in zip(b["once"], b["twice"]):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                if once is None:
                    once, twice = o.copy(), t.copy()
                else:
                    _merge(once, twice, o, t)
        yield pd.DataFrame({"seg": [int(key[0])], "twice": [zlib.compress(twice.tobytes(), 1)]})

    parts = hashes.mapInPandas(build, "seg long, once binary, twice binary")
    # A segment's partial filters are of fixed size; they are folded batch by batch, not held together.
    merged = parts.groupBy("seg").applyInPandas(fold, "seg long, twice binary")
    return bits, {r["seg"]: zlib.decompress(r["twice"]) for r in merged.collect()}


def unpack(bits: int, segs: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(bits, bool)
    step = min(bits, SEGMENT_BITS)
    for i, b in segs.items():
        out[i * step : (i + 1) * step] = np.unpackbits(np.frombuffer(b, np.uint8))[:step].astype(bool)
    return out


def suspected(h: np.ndarray, bits: int, twice: np.ndarray) -> np.ndarray:
    a, b = _slots(h, bits)
    return twice[a] & twice[b]


def seen_again(texts: DataFrame, min_chars: int, ranges: int, bits: int) -> DataFrame:
    """h: the hashes that several documents have, by ranges of hashes with a pair of filters each; a table."""
    shift = np.uint64(64 - (ranges - 1).bit_length()) if ranges > 1 else None

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = np.sort(_hashes(b["text"], min_chars))
            part = (h >> shift).astype(np.int64) if shift is not None else np.zeros(len(h), np.int64)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            yield pd.DataFrame({"part": part[at], "hashes": [x.tobytes() for x in np.split(h, at[1:])] if len(h) else []})

    def filtered(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, found, n = TwiceFilter(bits), [], 0
        for b in batches:
            for x in b["hashes"]:
                found.append(f.add_and_report(np.frombuffer(x, np.uint64)))
                n += len(found[-1])
                if n > 4_000_000:
                    found, n = [np.unique(np.concatenate(found))], 0
        yield pd.DataFrame({"h": np.unique(np.concatenate(found)).view(np.int64)})

    return materialize(texts.select("text").mapInPandas(deal, "part long, hashes binary").groupBy("part").applyInPandas(filtered, "h long"), "seen-again")


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    """The distinct keys of a document that count."""
    return [k for k in set(split_keys(text)[1]) if k and (min_chars <= 1 or len(k.decode("utf-8", "surrogatepass")) >= min_chars)]


def repeated_keys(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """key (binary), n_docs, first_doc of the keys found in at least min_docs documents."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    n_lines = int(texts.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0)
    ids = texts.where("doc_id IS NOT NULL").groupBy("doc_id").count()
    by_row = ids.where("count > 1").isEmpty()  # else a key's documents are told apart before they are counted
    again, filt = None, None
    if BITS_PER_KEY * n_lines <= MAX_BITS:
        filt = spark.sparkContext.broadcast(twice_filter(texts.select("text"), lambda b: _hashes(b["text"], min_chars), n_lines))
    else:
        ranges = 1
        while ranges * MAX_BITS < BITS_PER_KEY * n_lines:
            ranges *= 2
        again = seen_again(texts, min_chars, ranges, MAX_BITS)
        if again.count() * 8 <= BROADCAST_BYTES:
            filt, again = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in again.toLocalIterator()], np.int64).view(np.uint64))), None

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = filt.value if filt is not None else None
        twice = unpack(*known) if isinstance(known, tuple) else None
        for b in batches:
            count: Counter[tuple[bytes, Any]] = Counter()
            first: dict[tuple[bytes, Any], int] = {}
            hashes: dict[bytes, int] = {}
            for d, t in zip(b["doc_id"], b["text"]):
                keys = _keys(t, min_chars)
                if not keys:
                    continue
                h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
                if known is None:
                    hashes.update(zip(keys, h.view(np.int64).tolist()))
                elif twice is not None:
                    keys = [keys[i] for i in np.flatnonzero(suspected(h, known[0], twice))]
                else:
                    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                    keys = [keys[i] for i in np.flatnonzero(known[at] == h)] if len(known) else []
                d = None if pd.isna(d) else int(d)
                for k in keys:
                    x = k, None if by_row else d
                    count[x] += 1
                    if d is not None:
                        first[x] = min(first.get(x, d), d)
            yield pd.DataFrame({"key": [k for k, _ in count], "n": list(count.values()), "first": pd.array([first.get(x) for x in count], "Int64"), "h": pd.array([hashes.get(k) for k, _ in count], "Int64")})

    found = map_pandas(texts, suspects, "key binary, n long, first long, h long")
    if again is not None:
        found = found.join(again.hint("merge"), "h", "left_semi")
    if not by_row:
        found = found.groupBy("key", "first").agg(F.sum("n").alias("n")).withColumn("n", F.when(F.col("first").isNull(), F.col("n")).otherwise(1))
    return found.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first_doc")).where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """docs with repeated lines taken out of ``text``; adds n_lines, n_dropped, kept_sha256.

    keep="none": a key found in min_docs documents goes everywhere.  keep="first": its first
    line in the document of the smallest doc_id stays.
    """
    spark = docs.sparkSession
    heavy = materialize(repeated_keys(docs, min_docs, min_chars), "lines")
    size = heavy.select(F.sum(F.octet_length("key") + 16)).first()[0] or 0
    extra = "text string, n_lines long, n_dropped long, kept_sha256 string"

    if size <= BROADCAST_BYTES:
        found = spark.sparkContext.broadcast({bytes(r["key"]): r["first_doc"] for r in heavy.collect()})
        src, drops = docs, None
    else:
        # another way: (row, position) of repeated lines by a join on the key, then back to the row
        src = materialize(docs.withColumn(ROW, F.expr("uuid()")), "lines-rows")

        def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = [(r, d, i, k) for r, d, t in zip(b[ROW], b["doc_id"], b["text"]) for i, k in enumerate(split_keys(t)[1]) if k]
                yield pd.DataFrame(at, columns=[ROW, "doc_id", "at", "key"])

        at = map_pandas(src.select(ROW, "doc_id", "text"), positions, f"{ROW} string, doc_id long, at int, key binary").join(heavy, "key")
        at = at.groupBy(ROW, "key").agg(F.collect_list("at").alias("ats"), F.max(F.col("doc_id").eqNullSafe(F.col("first_doc"))).alias("is_first"))
        if keep == "first":
            at = at.withColumn("ats", F.when(F.col("is_first"), F.array_except("ats", F.array(F.array_min("ats")))).otherwise(F.col("ats")))
        drops = at.groupBy(ROW).agg(F.flatten(F.collect_list("ats")).alias(DROP))
        src, found = src.join(drops, ROW, "left"), None

    def apply(b: pa.RecordBatch) -> dict[str, list]:
        known = found.value if found is not None else {}
        out: dict[str, list] = {"text": [], "n_lines": [], "n_dropped": [], "kept_sha256": []}
        ids = b.column("doc_id").to_pylist()
        drop = b.column(DROP).to_pylist() if found is None else None
        for j, t in enumerate(b.column("text").to_pylist()):
            ls, keys = split_keys(t)
            if drop is None:
                seen: set[bytes] = set()
                rest = []
                for line, k in zip(ls, keys):
                    if k in known:
                        if keep != "first" or k in seen or ids[j] is None or known[k] != ids[j]:
                            continue
                        seen.add(k)
                    rest.append(line)
            else:
                gone = set(drop[j] or ())
                rest = [x for i, x in enumerate(ls) if i not in gone]
            s = b"\n".join(rest)
            out["text"].append(s.decode("utf-8", "surrogatepass") if len(rest) < len(ls) else t)
            out["n_lines"].append(len(ls))
            out["n_dropped"].append(len(ls) - len(rest))
            out["kept_sha256"].append(hashlib.sha256(s).hexdigest())
        return out

    return with_columns(src, apply, extra).drop(ROW, DROP)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, doc, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, doc, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS doc, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), heavy AS (
  SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN doc END) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN heavy h ON l.key = h.key GROUP BY doc_id, doc
"""
