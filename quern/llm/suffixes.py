"""Exact repeats by suffix sorting with a difference cover, one suffix bucket at a time.

``equal_windows`` finds which windows of ``length`` bytes of a buffer are equal.  It sorts the suffixes that
start there as blockwise suffix sorters do: positions whose remainder modulo 13 is in a
difference cover are ranked first (names of 13 bytes, doubled until they reach past the window);
then buckets of suffixes with a common beginning are sorted one at a time by their first 13 bytes, and ties,
however long, are resolved by the ranks of two cover positions the same distance ahead.  Memory
is the buffer's ranks and one bucket.  Neighbours that agree in a whole window are one class.

``remove_repeats`` takes from every document the bytes of each window that also starts in a
document of a smaller doc_id.  Corpora don't fit one buffer, so:

1. Documents are packed into blocks of about ``BLOCK`` bytes, a table in the shared folder.
2. A window's key is the smallest hash of the k-grams in it, so equal windows have equal keys, and about one
   position in 16 starts a new key.  Each block sends its distinct keys and how often it has them, 7 bytes each, to
   the key's bucket, which tells it those that other documents have as well.
3. Runs of windows with such a key are cut out as fragments.  Each block sends its distinct
   fragments with their smallest doc_id to the key's bucket.  A key of more than ``HOT`` runs (a common phrase in ever new
   surroundings) would fill one bucket: its windows are sent one by one, each to the bucket of its own hash.
   In the bucket, equal fragments are merged, the
   rest are suffix sorted, and every window gets the smallest doc_id that holds it.
4. Blocks mark the bytes of windows whose smallest doc_id is below their document's.

A bucket gets each key or fragment once from each block, so a passage in a third of all documents
costs no more than a line in every block, and its copies never meet in one task.  No more than ``SORT_BYTES`` and the
fragments of one key that is not hot are sorted at a time.

Defined cases: null text is empty; documents shorter than the window stay whole; a null doc_id
is neither smaller nor greater than any other, so such documents stay whole and remove
nothing; rows that repeat a doc_id don't remove each other's text; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import free_shuffles, map_pandas, materialize, table
from quern.llm.shingles import prefix_sums, range_hashes

BLOCK, BUCKET_BYTES, SORT_BYTES, HASH_BYTES = 8 << 20, 16 << 20, 2 << 20, 1 << 20
V, COVER = 13, (0, 1, 3, 9)
SORT_AT_ONCE = 1 << 18
HOT = 4096
NO_ID = -(2**63)  # stands for a null doc_id inside blocks

#: SHIFT[a, b]: how far to go from remainders a and b for both to be in the cover.
SHIFT = np.array([[next(d for d in range(V) if (a + d) % V in COVER and (b + d) % V in COVER) for b in range(V)] for a in range(V)])


# --- suffix sorting -------------------------------------------------------------------------


def _words(text: np.ndarray, pad: int) -> np.ndarray:
    """At each position, its next 8 bytes as a number that sorts like them."""
    t = np.concatenate([text, np.zeros(pad + 8, np.uint8)])
    w = np.zeros(len(t) - 7, np.uint64)
    for k in range(8):
        w |= t[k : k + len(w)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return w


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows by keys, the first key first; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return rank


def cover_ranks(words: np.ndarray, n: int, length: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions, by ``length`` bytes or more; 0 elsewhere."""
    rank = np.zeros(len(words) + length + 4 * V, np.int64)
    at = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
    rank[at] = _dense(words[at], words[at + V - 8])
    depth = V
    while depth < length:
        rank[at] = _dense(rank[at], rank[at + depth])  # at + depth has the same remainder
        depth *= 2
    return rank


def _tie_order(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For suffixes tied on their first V bytes, how many of their group come before each."""
    less = np.zeros(len(at), np.int64)
    rem = at % V
    top = np.int64(rank.max() + 1)
    members = [np.flatnonzero(rem == r) for r in range(V)]
    for a in range(V):
        for b in range(V):
            if len(members[a]) and len(members[b]):
                d = SHIFT[a, b]
                theirs = np.sort(group[members[b]] * top + rank[at[members[b]] + d])
                mine = group[members[a]] * top
                less[members[a]] += np.searchsorted(theirs, mine + rank[at[members[a]] + d]) - np.searchsorted(theirs, mine)
    return less


def equal_windows(text: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each suffix bucket: index numbers of ``at`` in suffix order, and where in that order the
    classes begin: positions with equal ``length`` bytes."""
    if not len(at):
        return
    words = _words(text, length + 4 * V)
    rank = cover_ranks(words, len(text), length)
    head = (words[at] >> np.uint64(48)).astype(np.uint16)
    by_head = np.argsort(head, kind="stable")
    edges = np.flatnonzero(np.diff(head[by_head].astype(np.int32))) + 1
    # suffix buckets: runs of beginnings, cut where one more would be over the limit
    cuts, last = [0], 0
    for i, e in enumerate(edges):
        after = edges[i + 1] if i + 1 < len(edges) else len(at)
        if after - last > SORT_AT_ONCE:
            cuts.append(int(e))
            last = int(e)
    cuts.append(len(at))
    offsets = [*range(0, max(1, length - 7), 8), max(0, length - 8)]
    for lo, hi in zip(cuts, cuts[1:]):
        ix = by_head[lo:hi]
        p = at[ix]
        order = np.lexsort((words[p + V - 8], words[p]))
        ix, p = ix[order], p[order]
        same = (words[p[1:]] == words[p[:-1]]) & (words[p[1:] + V - 8] == words[p[:-1] + V - 8])
        group = np.concatenate([[0], np.cumsum(~same)])
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if len(tied):
            less = _tie_order(p[tied], group[tied], rank)
            sub = tied[np.lexsort((less, group[tied]))]
            ix[tied], p[tied] = ix[sub], p[sub]
        new = np.ones(len(p), bool)
        eq = np.ones(len(p) - 1, bool)
        for o in offsets:
            eq &= words[p[1:] + o] == words[p[:-1] + o]
        new[1:] = ~eq
        yield ix, np.flatnonzero(new)


# --- keys and fragments of one block --------------------------------------------------------


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of a document, the smallest hash of its k-grams (48 bits)."""
    k = max(4, 2 * length // 5)
    n = len(data) - k + 1
    h = range_hashes(prefix_sums(data), np.arange(n), np.arange(k, k + n)) >> np.uint64(16)
    w, span = length - k + 1, 1
    while 2 * span <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (w - span)], h[w - span :]) if w > span else h


ZIP, UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # made once: messages are many and small


def pack(a: np.ndarray) -> bytes:
    return ZIP.compress(a.tobytes())


def unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(UNZIP.decompress(b), kind)


def window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at ascending positions, ``HASH_BYTES`` of data at a time."""
    cuts, parts = np.searchsorted(at, np.arange(0, len(data) + HASH_BYTES, HASH_BYTES)), [np.zeros(0, np.uint64)]
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        lo = i * HASH_BYTES
        p = at[cuts[i] : cuts[i + 1]] - lo
        parts.append(range_hashes(prefix_sums(data[lo : lo + HASH_BYTES + length]), p, p + length))
    return np.concatenate(parts)


class Block:
    """Documents one after the other; runs: stretches of windows of one document with one key."""

    def __init__(self, ids: bytes, lens: bytes, data: bytes, length: int):
        self.ids, self.lens, self.data, self.length = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64), unpack(data, np.uint8), length
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])
        parts = []
        for d in range(len(self.ids)):
            if self.lens[d] >= length and self.ids[d] != NO_ID:
                a = self.starts[d]
                key = window_keys(self.data[a : a + self.lens[d]], length)
                first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
                end = np.append(first[1:], len(key))
                parts.append((key[first], np.full(len(first), d), a + first, a + end))
        none = np.zeros(0, np.int64)
        self.key, self.doc, self.first, self.end = (np.concatenate(x) for x in zip(*parts)) if parts else (none.astype(np.uint64), none, none, none)

    def distinct_keys(self) -> np.ndarray:
        """Keys, each with whether several documents of the block have it and the logarithm of its runs (``told_apart``)."""
        order = np.lexsort((self.ids[self.doc], self.key))
        k, d = self.key[order], self.ids[self.doc[order]]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
        end = np.append(at[1:], len(k))[: len(at)]
        runs = np.frexp((end - at).astype(float))[1] - 1
        return k[at] << np.uint64(6) | (runs << 1 | (d[at] != d[end - 1])).astype(np.uint64)

    def fragments(self, repeated: np.ndarray, buckets: int) -> dict[int, tuple[list[bytes], np.ndarray, np.ndarray]]:
        """By bucket: distinct fragments with a repeated key, the smallest doc_id of each, and the
        (start, document, fragment) of all their occurrences.  repeated: keys, the lowest bit tells the hot ones.
        The same for the same block, whenever made."""
        if not len(repeated):
            return {}
        keys = repeated >> np.uint64(1)
        spot = np.minimum(np.searchsorted(keys, self.key), len(keys) - 1)
        is_hot = (repeated[spot] & np.uint64(1)) == 1
        runs, hot = (np.flatnonzero((keys[spot] == self.key) & x) for x in (~is_hot, is_hot))
        n = self.end[hot] - self.first[hot]
        single = np.repeat(self.first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())  # windows of hot keys
        first, end = np.concatenate([self.first[runs], single]), np.concatenate([self.end[runs], single + 1])
        doc = np.concatenate([self.doc[runs], np.repeat(self.doc[hot], n)])
        own = window_hashes(self.data, single, self.length)
        where = (np.concatenate([self.key[runs], own]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        raw, out = self.data.tobytes(), {}
        for mine in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            if len(mine):
                known: dict[bytes, int] = {}
                number = np.array([known.setdefault(raw[s : e + self.length - 1], len(known)) for s, e in zip(first[mine].tolist(), end[mine].tolist())], np.int64)
                low = np.full(len(known), 2**63 - 1, np.int64)
                np.minimum.at(low, number, self.ids[doc[mine]])
                out[int(where[mine[0]])] = (list(known), low, np.stack([first[mine], doc[mine], number]))
        return out


def told_apart(sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, how many runs each has at least, and whether they are of several documents."""
    return sent >> np.uint64(6), np.int64(1) << (sent >> np.uint64(1) & np.uint64(31)).astype(np.int64), (sent & np.uint64(1)) == 1


def keys_by_bucket(sent: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """The sorted keys of a block for each bucket, as gaps byte by byte: one pass, however many buckets there are."""
    if not len(sent):
        return []
    where = ((sent >> np.uint64(6)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(where, kind="stable")
    where, sent = where[order], sent[order]
    cut = np.append(0, np.flatnonzero(where[1:] != where[:-1]) + 1)
    out = []
    for i, lo, hi in zip(where[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(sent)]):
        gaps = np.diff(sent[lo:hi], prepend=np.uint64(0))
        out.append((i, pack(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :7].T))))
    return out


def repeated_keys(messages: list[bytes], hot: int) -> list[bytes]:
    """For each block's message to a bucket, those of its keys that several documents have; the lowest bit tells keys of
    more than ``hot`` runs.  Each message costs what it holds, not what the bucket holds."""
    lists = []
    for x in messages:
        planes = unpack(x, np.uint8).reshape(7, -1)
        gaps = np.zeros((planes.shape[1], 8), np.uint8)
        gaps[:, :7] = planes.T
        lists.append(np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64))
    every = np.sort(np.concatenate(lists))
    key, runs, several = told_apart(every)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    blocks_of = np.diff(np.append(at, len(key)))
    repeated = (blocks_of > 1) | np.logical_or.reduceat(several, at) if len(at) else np.zeros(0, bool)
    is_hot = np.add.reduceat(runs, at) > hot if len(at) else np.zeros(0, bool)
    key, is_hot = key[at][repeated], is_hot[repeated].astype(np.uint64)
    found = []
    for x in lists:
        x = x >> np.uint64(6)
        i = np.searchsorted(key, x)
        i = i[key[np.minimum(i, len(key) - 1)] == x] if len(key) else i[:0]
        found.append(pack(key[i] << np.uint64(1) | is_hot[i]))
    return found


def pack_documents(docs: DataFrame) -> DataFrame:
    """block, n_bytes, ids, lens, data of the documents in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def block() -> pd.DataFrame:
            raw = b"".join(texts)
            return pd.DataFrame({"block": [part + n], "n_bytes": [len(raw)], "ids": [np.array(ids, np.int64).tobytes()], "lens": [np.array([len(t) for t in texts], np.int64).tobytes()], "data": [pack(np.frombuffer(raw, np.uint8))]})

        for b in batches:
            for d, t in zip(b["doc_id"], b["text"]):
                t = (t or "").encode("utf-8", "surrogatepass")
                if ids and size + len(t) > BLOCK:
                    yield block()
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(NO_ID if pd.isna(d) else int(d))
                texts.append(t)
                size += len(t)
        if ids:
            yield block()

    return map_pandas(docs.select("doc_id", "text"), run, "block long, n_bytes long, ids binary, lens binary, data binary")


# --- over the cluster -----------------------------------------------------------------------


def first_keys(text: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """The keys of the windows that start at ``begin``."""
    k = max(4, 2 * length // 5)
    sums, key = prefix_sums(text), None
    for i in range(length - k + 1):
        h = range_hashes(sums, begin + i, begin + i + k) >> np.uint64(16)
        key = h if key is None else np.minimum(key, h)
    return key


def _lowest(frags: list[bytes], low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For distinct fragments, stretches of windows: fragment, from window, to window, smallest doc_id
    that holds them; in order of the fragments."""
    every = np.arange(len(frags))
    sizes = np.array([len(f) for f in frags], np.int64)
    whole = np.frombuffer(b"".join(frags), np.uint8)
    begins, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    parts = []
    cuts = np.unique(np.append(np.searchsorted(begins, np.arange(0, len(whole), HASH_BYTES)), len(frags)))
    for lo, hi in zip(cuts, cuts[1:]):
        parts.append(first_keys(whole[begins[lo] : ends[hi - 1]], begins[lo:hi] - begins[lo], length))
    _, back, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    alone = n[back] == 1  # no other fragment has its key, so none has its windows
    a = every[alone]
    sure = (a, np.zeros(len(a), np.int64), sizes[a] - length + 1, low[a])
    parts = [sure]
    rest = every[~alone]
    rest = rest[np.argsort(back[rest], kind="stable")]  # fragments of one key side by side: only they can share windows
    ends, new_key = np.cumsum(sizes[rest]), np.flatnonzero(np.diff(back[rest])) + 1
    lo = 0
    while lo < len(rest):
        # as many keys as make up SORT_BYTES, one at least
        limit = np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SORT_BYTES)
        i = np.searchsorted(new_key, max(limit, lo + 1), side="right") - 1
        hi = int(new_key[i]) if i >= 0 and new_key[i] > lo else int(new_key[i + 1]) if i + 1 < len(new_key) else len(rest)
        hi = len(rest) if limit >= len(rest) else hi
        parts.append(_settle(frags, rest[lo:hi], sizes, low, length))
        lo = hi
    both = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((both[1], both[0]))
    return tuple(x[order] for x in both)


def _settle(frags: list[bytes], some: np.ndarray, sizes: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The same for fragments ``some``, by suffix sorting."""
    text = np.frombuffer(b"".join(frags[i] for i in some), np.uint8)
    begin = np.cumsum(sizes[some]) - sizes[some]
    wins = sizes[some] - length + 1
    owner = np.repeat(np.arange(len(some), dtype=np.int32), wins)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(wins) - wins, wins)
    doc = low[some][owner]
    for order, starts in equal_windows(text, begin[owner] + nth, length):
        lowest = np.minimum.reduceat(doc[order], starts)
        doc[order] = np.repeat(lowest, np.diff(np.append(starts, len(order))))
    edge = np.ones(len(owner), bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(edge)
    return some[owner[at]], nth[at], nth[at] + np.diff(np.append(at, len(owner))), doc[at]


def remove_repeats(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, kept (binary: what is left of its text) and spans (removed
    stretches, in bytes of its text)."""
    spark = docs.sparkSession
    blocks = materialize(pack_documents(docs), "blocks")
    total = blocks.select(F.sum("n_bytes")).first()[0] or 0
    buckets = 8
    while buckets * BUCKET_BYTES < total:
        buckets *= 2

    def send_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                out = [(i, r.block, x) for i, x in keys_by_bucket(Block(r.ids, r.lens, r.data, length).distinct_keys(), buckets)]
                yield pd.DataFrame(out, columns=["bucket", "block", "keys"])

    def find_repeated(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": b["block"], "keys": repeated_keys(list(b["keys"]), hot)})

    def repeated_of(lists) -> np.ndarray:
        return np.sort(np.concatenate([unpack(x, np.uint64) for x in lists])) if lists is not None and len(lists) else np.zeros(0, np.uint64)

    keys = blocks.mapInPandas(send_keys, "bucket int, block long, keys binary")
    told = keys.groupBy("bucket").applyInPandas(find_repeated, "block long, keys binary")
    told = materialize(told.groupBy("block").agg(F.collect_list("keys").alias("keys")), "repeated")
    del keys  # the shuffle files go with the last plan that refers to them
    free_shuffles(spark)

    def send_fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                block = Block(r.ids, r.lens, r.data, length)
                out = []
                for i, (frags, low, _) in block.fragments(repeated_of(r.keys), buckets).items():
                    sizes = np.array([len(f) for f in frags], np.int64)
                    out.append((i, r.block, pack(sizes), pack(low), pack(np.frombuffer(b"".join(frags), np.uint8))))
                yield pd.DataFrame(out, columns=["bucket", "block", "sizes", "low", "bytes"])

    def settle(b: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        numbers, lows = [], []
        for s, d, x in zip(b["sizes"], b["low"], b["bytes"]):
            ends = np.cumsum(unpack(s, np.int64)).tolist()
            raw, at, mine = unpack(x, np.uint8).tobytes(), 0, []
            for e in ends:
                mine.append(known.setdefault(raw[at:e], len(known)))
                at = e
            numbers.append(np.array(mine, np.int64))
            lows.append(unpack(d, np.int64))
        low = np.full(len(known), 2**63 - 1, np.int64)
        for mine, d in zip(numbers, lows):
            np.minimum.at(low, mine, d)
        owner, start, end, doc = _lowest(list(known), low, length)
        first, n = np.searchsorted(owner, np.arange(len(known))), np.bincount(owner, minlength=len(known))
        out = []
        for mine in numbers:
            per = n[mine]
            row = np.repeat(first[mine] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            out.append(pack(np.stack([np.repeat(np.arange(len(mine)), per), start[row], end[row], doc[row]])))
        return pd.DataFrame({"block": b["block"], "bucket": b["bucket"], "rows": out})

    frags = blocks.join(told, "block").mapInPandas(send_fragments, "bucket int, block long, sizes binary, low binary, bytes binary")
    settled = frags.groupBy("bucket").applyInPandas(settle, "block long, bucket int, rows binary")
    settled = materialize(settled.groupBy("block").agg(F.collect_list(F.struct("bucket", "rows")).alias("settled")), "settled")
    del frags
    free_shuffles(spark)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                block = Block(r.ids, r.lens, r.data, length)
                mark = np.zeros(len(block.data) + 1, np.int32)
                if r.settled is not None:
                    occurs = block.fragments(repeated_of(r.keys), buckets)
                    for s in r.settled:
                        frag, a, e, d = unpack(s["rows"], np.int64).reshape(4, -1)
                        first_of, doc_of, number = occurs[s["bucket"]][2]
                        # all stretches of all occurrences
                        per = np.bincount(frag, minlength=number.max() + 1)
                        first = np.concatenate([[0], np.cumsum(per)[:-1]])
                        n = per[number]
                        row = np.repeat(first[number] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        begin = np.repeat(first_of, n)
                        cut = d[row] < block.ids[np.repeat(doc_of, n)]
                        np.add.at(mark, begin[cut] + a[row][cut], 1)
                        np.add.at(mark, begin[cut] + e[row][cut] - 1 + length, -1)
                gone = np.cumsum(mark[:-1], out=mark[:-1]) > 0
                out = []
                for i, d in enumerate(block.ids.tolist()):
                    x, y = block.starts[i], block.starts[i + 1]
                    g = gone[x:y]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                    out.append((None if d == NO_ID else d, int(y - x), block.data[x:y][~g].tobytes(), [{"start": int(p), "end": int(q)} for p, q in edge.reshape(-1, 2)]))
                yield pd.DataFrame({"doc_id": pd.array([o[0] for o in out], "Int64"), "n_bytes": [o[1] for o in out], "kept": [o[2] for o in out], "spans": [o[3] for o in out]})

    done = blocks.join(told, "block", "left").join(settled, "block", "left")
    return map_pandas(done, finish, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
