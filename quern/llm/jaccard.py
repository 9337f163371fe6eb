"""N-gram Jaccard join: token-combination prefixes, then exact verification.

Two documents link when their shingle sets have a Jaccard similarity of 0.8 or more.

1. Equal sets form classes; only the smallest id of a class goes on.  A document that links shares 80 % of its tokens
   with another, so one with fewer tokens that any other document has is left out before anything is indexed (``may_link``).
2. Tokens (shingles) get one global order by frequency, counted over one document of each class in a table of
   cells whose size follows the number of tokens (``CELL_TOKENS`` a cell, up to ``MAX_CELLS``).  Tokens of cells over
   ``FREQUENT`` (and well over the mean cell) are the frequent class.
3. A document of n tokens takes a prefix in that order, of w = n - ceil(0.8 n) + 1 tokens.  If all are rare, each is indexed
   alone.  Else the prefix is extended by C tokens: linked documents share C + 1 tokens of their extended
   prefixes, so they share a rare one, or two frequent ones of the same of C classes by hash.  Rare tokens are indexed
   alone, frequent ones by the pairs within a class.  C follows n, so the pairs are in proportion to n; a
   document is indexed by the C of every size that it can link with (two at most).
4. Index entries are kept in blocks of documents.  Each block sends its distinct entries to the entry's bucket, which
   tells it those that other documents have, and the smallest doc_id of each: a hub.  Two documents that link share an
   entry, so they share its hub.  A document is compared with its hubs, never with all that share an entry.
5. Links with hubs join components.  Where all documents of a hub are one component, nothing is left to find.
6. Else pairs of the hub's documents are found by their differences from it: |x ^ y| = |dx ^ dy| for
   dx = x ^ hub, and two linked documents, not both linked to the hub, share more of their differences
   than a prefix of them leaves out (see ``differences``).  Edits of different places share nothing, so
   near copies of a hub that are no near copies of each other never meet, however many they are.  Documents that
   the hub doesn't hold for the most part share a token outside it (see ``outside``).
7. Those pairs are verified exactly, and components are joined.

A bucket gets an entry once from each block, so a token of a third of all documents costs a line in each block; no
pairs are listed within a component, nor, but for shared edits, between those of a hub.

Defined cases: null or empty text has no shingle and links with nothing (its component is
itself); a null doc_id links with nothing and has a null component; rows that repeat a doc_id
each keep a row and share a component, with the links of all their texts; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, free_shuffles, map_pandas, materialize, table
from quern.llm.components import connected_components
from quern.llm.shingles import mix, shingle_set
from quern.llm.suffixes import pack, unpack

K, SIMILAR = 5, 80  # words in a shingle; per cent
CELL_TOKENS, MIN_CELLS, MAX_CELLS, CELL_SEGMENTS = 8, 1 << 16, 1 << 24, 64
FREQUENT = 64
BLOCK_ENTRIES, BUCKET_ENTRIES, PACK, NAMED = 200_000, 2_000_000, 100, 64
BROADCAST_ROWS, BATCH_BYTES = 1_000_000, 8 << 20  # ids: 8 MB
BLOCK_TOKENS, BUCKET_TOKENS, SPARE_BITS, SHRINKS, FIRST = 2_000_000, 4_000_000, 5, 0.8, 0.4


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Join docs with a table of doc_id: broadcast while its counted rows are few, else by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", how)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, K) for t in b["text"]]
            digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": [len(s) for s in sets], "d1": [int(d[0]) for d in digests], "d2": [int(d[1]) for d in digests]})

    return map_pandas(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, d1 long, d2 long")


# --- sets of pairs --------------------------------------------------------------------------


def with_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, x, y: pairs with their token sets as bytes.  The set of a travels with its pairs, that of b is made once."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], 0
            for d, t, bs in zip(b["doc_id"], b["text"], b["bs"]):
                x = shingle_set(t, K).tobytes()
                for h in bs:
                    out.append((d, h, x))
                    size += len(x)
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(out, columns=["a", "b", "x"])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=["a", "b", "x"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"b": b["doc_id"], "y": [shingle_set(t, K).tobytes() for t in b["text"]]})

    few = pairs.count() <= BROADCAST_ROWS  # two ids each: 16 MB
    near = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    mine = pairs.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list("b").alias("bs"))  # one for each entry of a document at most
    x = docs.join(near(mine), "doc_id").select("doc_id", "text", "bs").mapInPandas(spread, "a long, b long, x binary")
    y = docs.join(near(pairs.select(F.col("b").alias("doc_id")).distinct()), "doc_id", "left_semi").select("doc_id", "text").mapInPandas(sets, "b long, y binary")
    return x.join(y.hint("merge"), "b").select("a", "b", "x", "y")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked ones of the pairs (a, b), which are a table; a table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            linked = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b["x"], b["y"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(x), len(y)) * 100 >= SIMILAR * max(len(x), len(y)):
                    both = overlap(x, y)
                    linked[i] = 100 * both >= SIMILAR * (len(x) + len(y) - both)
            yield b.loc[linked, ["a", "b"]]

    out = materialize(with_sets(docs, pairs).mapInPandas(run, "a long, b long"), "links")
    free_shuffles(docs.sparkSession)
    return out


# --- documents that can link ----------------------------------------------------------------


def planes_packed(a: np.ndarray) -> bytes:
    """Numbers byte by byte: their high bytes are mostly zero."""
    return pack(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T))


def planes_unpacked(b: bytes, kind: type) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def may_link(docs: DataFrame, n_tokens: int, share: float = 1.0) -> DataFrame:
    """doc_id, n of the documents that have ``SIMILAR`` per cent of their tokens (n in all) in other documents as well, as far as
    the lowest ``share`` of all hashes shows; a table.

    A document that links lacks n - ceil(0.8 n) of its tokens in the other one at most.  Both have the same of the tokens they
    share below any hash, so no more than that many tokens below it may be in no other document.

    Blocks of documents send their sorted tokens, cut to some bits more than it takes to number all tokens, as gaps with
    the number of each one's document to buckets by range; a bucket answers with how many tokens of each document it has
    from several.  Nothing else is written.  Tokens that agree in those bits only count as repeated, so too many documents may be
    kept, but none that links is left out."""
    bits = min(63, SPARE_BITS + max(16, int(n_tokens).bit_length()))
    top, buckets = int(share * (1 << bits)), 8
    while buckets * BUCKET_TOKENS < share * n_tokens:
        buckets *= 2
    lows = np.array([top * i // buckets for i in range(buckets + 1)], np.uint64)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId() << 32, 0
        ids, sizes, sets, total = [], [], [], 0

        def block() -> pd.DataFrame:
            """Its messages; its documents go along to a group of their own, with how many tokens they have and send."""
            tokens, of = np.concatenate(sets), np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in sets])
            order = np.argsort(tokens)
            tokens, of = tokens[order], of[order]
            cut = np.searchsorted(tokens, lows)
            out = [(-1 - ((part >> 32) + n) % buckets, part + n, pack(np.array(ids, np.int64)), planes_packed(np.array([sizes, [len(x) for x in sets]], np.int64).ravel()))]
            for i in np.flatnonzero(np.diff(cut)).tolist():
                at = slice(cut[i], cut[i + 1])
                out.append((i, part + n, planes_packed(np.diff(tokens[at], prepend=np.uint64(0))), planes_packed(of[at])))
            return pd.DataFrame(out, columns=["bucket", "block", "x", "y"])

        for b in batches:
            for doc, t in zip(b["doc_id"], b["text"]):
                x = shingle_set(t, K) >> np.uint64(64 - bits)
                if len(x):
                    ids.append(doc)
                    sizes.append(len(x))
                    sets.append(x[: np.searchsorted(x, np.uint64(top))])
                    total += 1 + len(sets[-1])
                if total >= BLOCK_TOKENS:
                    yield block()
                    ids, sizes, sets, total, n = [], [], [], 0, n + 1
        if ids:
            yield block()

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        """block, documents x, and how many tokens y of each are in several documents."""
        if b["bucket"].iloc[0] < 0:
            return b.assign(first=True)[["block", "first", "x", "y"]]
        lists = [np.cumsum(planes_unpacked(x, np.uint64), dtype=np.uint64) for x in b["x"]]
        every = np.sort(np.concatenate(lists))
        both = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for block, x, of in zip(b["block"], lists, b["y"]):
            hit = both[np.minimum(np.searchsorted(both, x), len(both) - 1)] == x if len(both) else np.zeros(len(x), bool)
            if hit.any():
                doc, number = np.unique(planes_unpacked(of, np.int32)[hit], return_counts=True)
                out.append((block, False, planes_packed(np.diff(doc, prepend=np.int32(0))), planes_packed(number.astype(np.int32))))
        return pd.DataFrame(out, columns=["block", "first", "x", "y"])

    def judge(b: pd.DataFrame) -> pd.DataFrame:
        first = b[b["first"]].iloc[0]
        ids, (n, alone) = unpack(first["x"], np.int64), planes_unpacked(first["y"], np.int64).reshape(2, -1)
        alone = alone.copy()
        for x, y in b.loc[~b["first"], ["x", "y"]].itertuples(index=False):
            alone[np.cumsum(planes_unpacked(x, np.int32))] -= planes_unpacked(y, np.int32)
        keep = alone <= n - -(-SIMILAR * n // 100)
        return pd.DataFrame({"doc_id": ids[keep], "n": n[keep]})

    told = docs.select("doc_id", "text").mapInPandas(send, "bucket int, block long, x binary, y binary").groupBy("bucket").applyInPandas(meet, "block long, first boolean, x binary, y binary")
    out = materialize(told.groupBy("block").applyInPandas(judge, "doc_id long, n long"), "may-link")
    free_shuffles(docs.sparkSession)
    return out


def candidates(docs: DataFrame, n_tokens: int) -> tuple[DataFrame, DataFrame, int]:
    """The documents that can link, the table to discard after use, and how many tokens they have.  ``FIRST`` of the tokens
    leave out most that can't, and all tokens the others.  Documents that are left out may have held the copies of
    others' tokens, so it is done again while it leaves out much."""
    kept, drop, first, share = docs, None, n_tokens, FIRST
    while True:
        ids = may_link(kept, n_tokens, share)
        n = ids.select(F.sum("n")).first()[0] or 0
        if 2 * n <= first:  # few enough to write them
            written = materialize(by_id(kept, ids.select("doc_id"), "left_semi"), "candidates")
            discard(ids)
            if drop is not None:
                discard(drop)
            kept = drop = written
        else:
            if drop is not None:
                discard(drop)
            kept, drop = by_id(docs, ids.select("doc_id"), "left_semi"), ids
        if share == 1.0 and n > SHRINKS * n_tokens or not n:
            return kept, drop, n
        n_tokens, share = n, 1.0


# --- frequencies ----------------------------------------------------------------------------


def n_cells(n_tokens: int) -> int:
    size = MIN_CELLS
    while size < MAX_CELLS and size * CELL_TOKENS < n_tokens:
        size *= 2
    return size


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of one byte (eighths of a power of two): 16 MB at most, and still one order."""
    return np.minimum(255, np.round(8 * np.log2(1.0 + counts))).astype(np.uint8)


def cell_levels(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Of each cell, how many tokens fall into it (``levels``); and the level over which cells are frequent: that of
    ``FREQUENT`` beside four times what a cell holds in the mean, however many tokens there are."""
    step = size // CELL_SEGMENTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(size, np.int32)
        for b in batches:
            for t in b["text"]:
                np.add.at(c, (shingle_set(t, K) & np.uint64(size - 1)).astype(np.int64), 1)
        rows = [(i, zlib.compress(c[i * step : (i + 1) * step].tobytes(), 1)) for i in range(CELL_SEGMENTS) if c[i * step : (i + 1) * step].any()]
        yield pd.DataFrame(rows, columns=["seg", "n"])

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(step, np.int64)
        for b in batches:
            for n in b["n"]:
                total += np.frombuffer(zlib.decompress(n), np.int32)
        yield pd.DataFrame({"seg": [int(key[0])], "n": [zlib.compress(levels(total).tobytes(), 1)], "total": [int(total.sum())]})

    out, n = np.zeros(size, np.uint8), 0
    for r in docs.select("text").mapInPandas(count, "seg long, n binary").groupBy("seg").applyInPandas(fold, "seg long, n binary, total long").collect():
        out[r["seg"] * step : (r["seg"] + 1) * step] = np.frombuffer(zlib.decompress(r["n"]), np.uint8)
        n += r["total"]
    return out, int(levels(np.array([FREQUENT + 4 * n / size]))[0])


def level_of(tokens: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return cells[(tokens & np.uint64(len(cells) - 1)).astype(np.int64)]


# --- index entries --------------------------------------------------------------------------


def classes_of(n: int) -> list[int]:
    """Numbers of classes C by which a set of n tokens and any that it can link with are indexed."""
    c = lambda m: 1 << max(0, int(m // 8).bit_length() - 1)
    return list(dict.fromkeys([c(-(-SIMILAR * n // 100)), c(100 * n // SIMILAR)]))


def signatures(tokens: np.ndarray, cells: np.ndarray, frequent: int) -> np.ndarray:
    """The index entries of a token set (see 3 above)."""
    n = len(tokens)
    if n < 2:
        return tokens[:0]  # alone, it is similar to equal sets only, and those are one class
    w = n - -(-SIMILAR * n // 100) + 1
    f = level_of(tokens, cells)
    order = np.lexsort((tokens, f))
    n_rare = int((f <= frequent).sum())
    if n_rare >= w:
        return tokens[order[:w]]
    out = [tokens[order[:n_rare]]]
    for c in classes_of(n):
        often = np.sort(tokens[order[n_rare : w + c]])
        kind = mix(often) & np.uint64(c - 1)
        by = np.lexsort((often, kind))
        often, kind = often[by], kind[by]
        for lag in range(1, len(often)):
            same = np.flatnonzero(kind[lag:] == kind[:-lag])
            if not len(same):
                break
            out.append(mix(often[same] * np.uint64(3) + mix(often[same + lag]) + np.uint64(c)))
    return np.concatenate(out)


def keys_packed(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys: gaps, byte by byte."""
    return pack(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T))


def keys_unpacked(b: bytes) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(6, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :6] = planes.T
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64)


def ids_packed(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Ids as numbers into a short list."""
    names, at = np.unique(ids, return_inverse=True)
    return pack(names), pack(at.astype(np.int32))


def ids_unpacked(names: bytes, at: bytes) -> np.ndarray:
    return unpack(names, np.int64)[unpack(at, np.int32)]


def hubs_of(docs: DataFrame, cells, frequent: int, expected: int) -> DataFrame:
    """Distinct pairs (a, b) of a document and a hub: the smallest doc_id of an entry that both have, and whether
    other documents have such an entry too; a table."""
    spark = docs.sparkSession
    # blocks and buckets grow with the root of the index, so that what goes from one to the other stays worth a row
    grow = 1
    while grow < 16 and BLOCK_ENTRIES * BUCKET_ENTRIES * grow * grow < PACK * expected:
        grow *= 2
    block_entries, buckets = BLOCK_ENTRIES * grow, 8
    while buckets * BUCKET_ENTRIES * grow < expected:
        buckets *= 2

    def make_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId() << 32, 0
        ids, sigs, total = [], [], 0

        def block() -> pd.DataFrame:
            keys = np.concatenate(sigs) >> np.uint64(16)
            return pd.DataFrame({"block": [part + n], "ids": [pack(np.array(ids, np.int64))], "sizes": [pack(np.array([len(s) for s in sigs], np.int64))], "keys": [pack(np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6].T))]})

        for b in batches:
            for doc, t in zip(b["doc_id"], b["text"]):
                s = signatures(shingle_set(t, K), cells.value, frequent)
                if len(s):
                    ids.append(doc)
                    sigs.append(s)
                    total += len(s)
                if total >= block_entries:
                    yield block()
                    ids, sigs, total, n = [], [], 0, n + 1
        if ids:
            yield block()

    blocks = materialize(docs.select("doc_id", "text").mapInPandas(make_blocks, "block long, ids binary, sizes binary, keys binary"), "index")

    def opened(r) -> tuple[np.ndarray, np.ndarray]:
        """The entries of a block, and the document of each."""
        planes = unpack(r.keys, np.uint8).reshape(6, -1)
        keys = np.zeros((planes.shape[1], 8), np.uint8)
        keys[:, :6] = planes.T
        return keys.view(np.uint64).ravel(), np.repeat(unpack(r.ids, np.int64), unpack(r.sizes, np.int64))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Distinct entries of a block, the smallest document of each, and how many there are (up to 3)."""
        for b in batches:
            out = []
            for r in b.itertuples():
                key, doc = opened(r)
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                number = np.minimum(3, np.diff(np.append(at, len(key)))).astype(np.uint8)
                key, doc = key[at], doc[at]
                where = (key % np.uint64(buckets)).astype(np.int64)
                for i in np.unique(where):
                    m = where == i
                    out.append((int(i), r.block, keys_packed(key[m]), *ids_packed(doc[m]), pack(number[m])))
            yield pd.DataFrame(out, columns=["bucket", "block", "keys", "names", "docs", "number"])

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        lists = [keys_unpacked(x) for x in b["keys"]]
        key, doc = np.concatenate(lists), np.concatenate([ids_unpacked(*x) for x in zip(b["names"], b["docs"])])
        number = np.concatenate([unpack(x, np.uint8) for x in b["number"]]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        least = np.minimum.reduceat(doc[order], at)
        number = np.add.reduceat(number[order], at)
        found = number > 1
        key, least, many = key[at][found], least[found], (number[found] > 2).astype(np.uint8)
        out = []
        for x in lists:
            i = np.searchsorted(key, x)
            i = i[key[np.minimum(i, len(key) - 1)] == x] if len(key) else i[:0]
            out.append((keys_packed(key[i]), *ids_packed(least[i]), pack(many[i])))
        return pd.DataFrame(out, columns=["keys", "names", "hubs", "many"]).assign(block=b["block"].to_numpy())

    told = blocks.mapInPandas(send, "bucket int, block long, keys binary, names binary, docs binary, number binary").groupBy("bucket").applyInPandas(meet, "keys binary, names binary, hubs binary, many binary, block long")
    told = materialize(told.groupBy("block").agg(F.collect_list(F.struct("keys", "names", "hubs", "many")).alias("told")), "told")
    free_shuffles(spark)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                known = np.concatenate([keys_unpacked(x["keys"]) for x in r.told])
                hub = np.concatenate([ids_unpacked(x["names"], x["hubs"]) for x in r.told])
                if not len(known):
                    continue
                many = np.concatenate([unpack(x["many"], np.uint8) for x in r.told])
                order = np.argsort(known)
                known, hub, many = known[order], hub[order], many[order]
                key, doc = opened(r)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = (known[at] == key) & (hub[at] != doc)
                yield pd.DataFrame({"a": doc[hit], "b": hub[at[hit]], "many": many[at[hit]] > 0}).groupby(["a", "b"], as_index=False).max()

    # (a document is in one block, so its pairs are distinct)
    out = materialize(blocks.join(told, "block").mapInPandas(pairs, "a long, b long, many boolean"), "hubs")
    for t in (blocks, told):
        discard(t)
    free_shuffles(spark)
    return out


# --- pairs of one hub -----------------------------------------------------------------------


def differences(x: np.ndarray, hub: np.ndarray, cells: np.ndarray) -> tuple[bool, list[np.ndarray]]:
    """Whether x links to the hub, and the index entries of its differences d, rarest first.

    x and y of one hub link if 9 |dx ^ dy| <= |x| + |y|, so they share o differences with
    18 o >= 9 (|dx| + |dy|) - |x| - |y|.  An x that doesn't link to the hub has 9 |dx| > |x| + |hub|.

    * Against any partner that doesn't: 18 o > 9 |d| + |hub| - |own|.  This holds for both sides, and
      for a linked y against an unlinked x: one prefix each.
    * For an unlinked x against a linked y: g = |dx| - (|x| + |hub|) / 9 and |y| <= |hub| + |dy| give
      o >= 0.9 g: a second, longer prefix.
    """
    only_x, only_h = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
    d = np.concatenate([only_x, only_h])
    d = d[np.lexsort((d, level_of(d, cells), np.arange(len(d)) >= len(only_x)))]
    linked = 9 * len(d) <= len(x) + len(hub)
    o = (9 * len(d) + len(hub) - len(x)) // 18 + 1
    short = d[: max(0, len(d) - o + 1)]
    if linked:
        return True, [d[:0], short]
    g = 9 * len(d) - len(x) - len(hub)  # 9 times g above
    return False, [short, d[: max(0, len(d) - max(1, -(-g // 10)) + 1)]]


def outside(x: np.ndarray, hub: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The index entries of what x has beside its hub.

    Let the hub hold tx tokens of x, fewer than 0.8 |x|.  A y that links to x shares 0.8 max(|x|, |y|) tokens with it, and at
    most min(tx, ty) of them are the hub's; so they share one outside the hub, and one in the first
    n - ceil(0.8 n) + 1 of each."""
    own = np.setdiff1d(x, hub, assume_unique=True)
    return own[np.lexsort((own, level_of(own, cells)))][: len(x) - -(-SIMILAR * len(x) // 100) + 1]


MAP = ("m0", "m1", "m2", "m3")


def bit_map(d: np.ndarray) -> np.ndarray:
    """256 bits, four numbers: those at which tokens of d fall."""
    bits = np.zeros(256, np.uint8)
    bits[(d & np.uint64(255)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def group_pairs(docs: DataFrame, members: DataFrame, cells, components: DataFrame) -> DataFrame:
    """Pairs (a, b) of one hub that may link, across components.  members: a, b (a hub of it), a table.

    Entries of kind 0 and 1 are differences of documents that the hub holds for the most part (0.8), kind 2 what all of
    them have outside the hub, for pairs with a document that it doesn't.  A row of kind -1 for each member has a bit map of
    all its differences: bits that only one of two maps has are differences that only one has, so the maps bound how many
    two documents share, and only those that may share enough become pairs."""
    columns = ["hub", "kind", "token", "earlier", "at", "a", "n", "nd", "nb", "linked", "held", *MAP]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for a, h, x, y in zip(b["a"], b["b"], b["x"], b["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both, linked, entries = overlap(x, y), False, [x[:0]] * 2
                held = 100 * both >= SIMILAR * len(x)
                n_d, nb = len(x) + len(y) - 2 * both, len(x) - both
                out.append(pd.DataFrame([(h, -1, 0, None, 0, a, 0, 0, 0, False, False, *bit_map(np.setxor1d(x, y, assume_unique=True)).tolist())], columns=columns))
                if held:
                    linked, entries = differences(x, y, cells.value)
                for kind, e in enumerate([*entries, outside(x, y, cells.value)]):
                    if len(e):
                        out.append(pd.DataFrame({"hub": h, "kind": kind, "token": e.view(np.int64), "earlier": [e[:i].view(np.int64) for i in range(len(e))] if len(e) <= NAMED else [None] * len(e), "at": np.arange(len(e)), "a": a, "n": len(x), "nd": n_d, "nb": nb, "linked": linked, "held": held, **dict.fromkeys(MAP, 0)}))
            yield pd.concat(out) if out else pd.DataFrame(columns=columns)

    e = with_sets(docs, members).mapInPandas(run, "hub long, kind int, token long, earlier array<long>, at int, a long, n long, nd long, nb long, linked boolean, held boolean, m0 long, m1 long, m2 long, m3 long")
    every = e = materialize(e.join(components.withColumnRenamed("doc_id", "a"), "a", "left").withColumn("c", F.coalesce("component_id", "a")).drop("component_id"), "differences")
    free_shuffles(docs.sparkSession)
    # entries that meet another component; counted before they are dealt out
    maps = e.where("kind < 0").select("hub", "a", *MAP)
    e = e.drop(*MAP).where("kind >= 0")
    meets = e.groupBy("hub", "kind", "token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("held").alias("held")).where("lo < hi AND NOT (kind = 2 AND held)").select("hub", "kind", "token")
    e = materialize(e.join(meets, ["hub", "kind", "token"]).join(maps, ["hub", "a"]), "meeting")
    discard(every)
    free_shuffles(docs.sparkSession)
    x, y = (e.select("hub", "kind", "token", *[F.col(c).alias(f"{p}_{c}") for c in ("earlier", "at", "a", "n", "nd", "nb", "linked", "held", "c", *MAP)]) for p in ("x", "y"))
    # enough shared differences can still follow the first shared one: own tokens (nb of them) come before the hub's
    rest = "CASE WHEN x_at < x_nb THEN least(x_nb - x_at, y_nb - y_at) + least(x_nd - x_nb, y_nd - y_nb) ELSE least(x_nd - x_at, y_nd - y_at) END"
    may = f"(kind = 0 AND NOT x_linked AND x_a < y_a OR kind = 1 AND NOT x_linked AND y_linked) AND 18 * ({rest}) >= 9 * (x_nd + y_nd) - x_n - y_n"
    # and enough shared tokens outside the hub, of which each has n - nb inside
    apart = f"kind = 2 AND NOT x_held AND (y_held OR x_a < y_a) AND 9 * (least(x_nb - x_at, y_nb - y_at) + least(x_n - x_nb, y_n - y_nb)) >= 4 * (x_n + y_n)"
    may = f"x_c <> y_c AND 100 * least(x_n, y_n) >= {SIMILAR} * greatest(x_n, y_n) AND ({may} OR {apart})"
    only = lambda p, q: " + ".join(f"bit_count({p}_{c} & ~{q}_{c})" for c in MAP)
    may += f" AND 18 * least(x_nd - ({only('x', 'y')}), y_nd - ({only('y', 'x')})) >= 9 * (x_nd + y_nd) - x_n - y_n"
    # a pair comes up once, at its first shared entry (entries of long prefixes don't name the earlier ones: distinct() is left to do it)
    may += " AND coalesce(NOT arrays_overlap(x_earlier, y_earlier), true)"
    out = x.join(y, ["hub", "kind", "token"]).where(may).select(F.least("x_a", "y_a").alias("a"), F.greatest("x_a", "y_a").alias("b")).distinct()
    out = materialize(out, "pairs")
    discard(e)
    free_shuffles(docs.sparkSession)
    return out


# --- components -----------------------------------------------------------------------------


def edges_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))


def unique_components(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_id, component_id of the documents that have links; ids are unique.  meta: ``describe`` of docs."""
    spark = docs.sparkSession
    real = meta.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    groups = real.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "classes")  # a join with a table, not with its aggregate, can be split where a key is hot
    copies = materialize(real.join(groups, ["d1", "d2", "n_shingles"]).where("doc_id <> rep").select("doc_id", "rep"), "copies")
    known = by_id(docs.where(F.col("doc_id").isNotNull()), copies.select("doc_id"), "left_anti")

    n_tokens = real.select(F.sum("n_shingles")).first()[0] or 0
    known, used, n_tokens = candidates(known, n_tokens)
    found, frequent = cell_levels(known, n_cells(n_tokens))
    cells = spark.sparkContext.broadcast(found)
    members = hubs_of(known, cells, frequent, n_tokens // 4)
    size = lambda c: real.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"))
    sized = members.join(size("a"), "a").join(size("b"), "b").where(f"100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)")
    pairs = materialize(sized.select("a", "b"), "pairs")
    near = links(known, pairs)
    stars = materialize(connected_components(edges_of(near)).where("doc_id <> component_id"), "stars")

    # hubs whose documents are not one component
    many = members.where("many").join(stars.withColumnRenamed("doc_id", "a"), "a", "left").select("a", "b", F.coalesce("component_id", "a").alias("c"))
    many = materialize(many, "members")
    mixed = many.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("b")
    open_ = materialize(many.join(mixed, "b").select("a", "b"), "open")
    inside = group_pairs(known, open_, cells, stars)
    more = links(known, inside)
    for t in (groups, used, members, pairs, near, many, open_, inside):
        discard(t)

    edges = stars.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")).unionByName(edges_of(more))
    return connected_components(edges.unionByName(copies.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))))


def component_ids(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    meta = materialize(describe(docs), "meta")
    if meta.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        final = unique_components(docs, meta)
    else:  # rows are linked instead, and then joined by their ids
        rows = materialize(docs.where("doc_id IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
        texts = rows.select(F.col("row").alias("doc_id"), "text")
        found = unique_components(texts, materialize(describe(texts), "meta"))
        of = rows.select("row", "doc_id").join(found.select(F.col("doc_id").alias("row"), "component_id"), "row", "left")
        of = materialize(of.select("doc_id", F.coalesce("component_id", "row").alias("c")), "row-components")
        # a component of rows is linked to the smallest of its ids
        least = materialize(of.groupBy("c").agg(F.min("doc_id").alias("least")), "least")
        final = connected_components(of.join(least, "c").select(F.col("doc_id").alias("u"), F.col("least").alias("v")))
    return meta.select("doc_id", "n_shingles").join(final, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return component_ids(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), t AS (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS h FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (an + bn - c)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(doc_id, m) AS (
    SELECT doc_id, doc_id FROM s
    UNION
    SELECT e.u, r.m FROM r JOIN edges e ON e.v = r.doc_id WHERE r.m < e.u
  ) SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id
)
SELECT s.doc_id, len(sh) AS n_shingles, component_id FROM s JOIN reach USING (doc_id)
"""
