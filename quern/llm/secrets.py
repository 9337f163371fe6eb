"""Secret scan: fixed rules, and a linear-chain conditional random field that adds spans.

Rules give the base spans.  The CRF tags tokens O, B or I (outside, begin, inside a
secret) from the token's shape (among it how unlike the corpus' words its letters follow each other), its
neighbouring words and features of the file, and is decoded by Viterbi.  It is trained here, by
stochastic gradient ascent on the conditional likelihood, from at most ``TRAIN_DOCS`` documents, half of them
with a secret as far as there are any (those of the smallest id hash):

* secrets that the rules find, as they are and once more with random letters and digits in their place;
* random secrets of many alphabets and lengths, with and without a vendor's prefix, planted into plain stretches of
  the texts by ``SECRET_FORMS``: beside a telling word, beside another one than the rules know, or beside none;
* what looks much like a secret and is none (identifiers, versions, addresses, dates, file names, talk of
  passwords), planted by ``HARMLESS_FORMS``, and plain stretches, all learned as O;
* stretches where a first model finds secrets that neither rules nor planting put there, learned as O as well.

Tokens of the texts that look random but that no rule covers are left out of training: they may be unknown secrets.

The CRF tags all tokens of every text.  A token's score depends on the classes of its neighbours, so
scores are looked up for whole texts at once, and Viterbi runs where a bound on the gain of any
span leaves the tag open: all others are O in the best sequence.  Only spans disjoint from all base
spans are added, so base spans stay as they are.

Defined cases: null text is empty; an empty text has no spans; repeated rows are scanned
each for itself; a table without any text to learn from gives base spans
alone; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, map_pandas, materialize, table

TRAIN_DOCS = 3000
KINDS = ["assign", "access", "hex", "crf"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
#: As long as the maximal run itself, so shorter runs need not be visited.
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text with a secret, for Spark (Java's syntax): the rules as one.
ANY_RULE = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6})|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
SEED = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
ALNUM = re.compile(r"[A-Za-z0-9]*")
CONTEXT = 48  # characters on either side of a seed or of what is planted
PLAIN = 200  # characters of a plain stretch
PIECE, TOKENS_HELD = 1 << 20, 400_000  # characters turned into tokens at once; distinct tokens remembered
#: Words that tell something of what follows them.
WORDS = {
    "password", "passwd", "pwd", "pass", "passphrase", "passcode", "pw", "pin", "secret", "token", "key", "apikey", "api", "bearer", "basic", "auth", "authorization", "credential", "credentials",
    "login", "private", "access", "client", "session", "cookie", "license", "is", "sha", "md5", "commit", "id", "uuid", "version", "order", "ref", "file", "http", "https", "www",
}
#: How secrets are written; v is the secret, w a word of ``CUES``.  Those without w say nothing of it.
SECRET_FORMS = ["{w} = {v}", "{w}: {v}", '{w}="{v}"', "my {w} is {v}", "the {w} is {v} now", "{w} {v}", "Authorization: Bearer {v}", "--{w} {v}", "export {w}={v};", "https://user:{v}@host.example/", "{v}", "({v})", "'{v}'"]
CUES = ["password", "passwd", "pwd", "pass", "passphrase", "passcode", "pw", "secret", "token", "key", "api key", "API_KEY", "auth", "credential", "login", "private key", "access key", "client_secret", "session", "Pwd", "KEY"]
#: Harmless neighbours of secrets.  h, d, l, u: a hex digit, digit, small or capital letter; W a word of the text, C one with a capital.
HARMLESS_FORMS = [
    "hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh", "id hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh", "commit hhhhhhh", "commit hhhhhhhhhhhh", "md5 hhhhhhhh", "uu-dddd-dd", "order uudddddd", "ref: uuu/dddd/dd", "version d.dd.d-beta.d", "vd.d.dd",
    "IMG_dddddddd_dddddd.jpg", "https://www.example.com/W/ddd/W?W=dd", "W.dd@mail.example.com", "dddd-dd-ddTdd:dd:ddZ", "dddd-dd-dd", "ISBN ddd-d-dd-dddddd-d", "+dd ddd ddddddd", "dddd dddd dddd dddd", "dd.ddd.d.dd", "W_W_W", "WWW", "W-W-W",
    "the key is W", "the key to W is W", "a password is W W", "my password is W", "token W", "the secret of W", "the token is W", "login W", "key: W", "secret: W W", "W's password", "pass W", "WCC", "CCC", "CC", "CCCC.java", "W = W", "W: W", "file W.txt", "Wdd", "udd:udd", "$dddd.dd", "d,ddd,ddd", "dddddddd", "id dddddddddd", "Wld", "W!!!",
]
ALPHABETS = ["0123456789abcdef", "BASE62", "BASE62", "BASE62-_", "BASE62+/", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "BASE62!$%&*"]
CUED, ALONE_FROM = (8, 48), 16  # lengths of secrets; least length of one beside no telling word
PLANTED = 2000  # secrets, and as many harmless forms, planted into the texts
O, B, I = 0, 1, 2
DIM, BATCH, RIDGE = 1 << 13, 64, 1e-5
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _values(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand (an assignment's value without its name)."""
    out = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out + [m.span() for m in ACCESS.finditer(text)] + [m.span() for m in HEX.finditer(text)]


def _random_like(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def windows(text: str, values: list[tuple[int, int]] = []) -> list[tuple[int, int]]:
    """Merged stretches of text around the seeds and the values."""
    out: list[list[int]] = []
    for x, y in sorted([m.span() for m in SEED.finditer(text) if _random_like(m[0])] + values):
        if y > x:
            a, b = max(0, x - CONTEXT), min(len(text), y + CONTEXT)
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
    return [tuple(x) for x in out]


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


class Letters:
    """How letters follow each other in the words of texts: the mean cost of a token's letter pairs."""

    def __init__(self, texts: list[str]):
        pairs = Counter(p for t in texts for w in re.findall(r"(?<![a-z0-9])[a-z]+(?![a-z0-9])", t.lower()) for p in zip(" " + w, w + " "))
        first = Counter()
        for (x, _), n in pairs.items():
            first[x] += n
        every = "abcdefghijklmnopqrstuvwxyz"
        self.cost = {x + y: -math.log2((pairs[x, y] + 1) / (first[x] + 27)) for x in every for y in every}

    def strange(self, low: str) -> float:
        """Bits a pair, of the pairs of letters that stand together in a lower-cased token."""
        found = [self.cost[p] for p in map("".join, zip(low, low[1:])) if p in self.cost]
        return sum(found) / len(found) if found else 0.0


LENGTHS = (2, 3, 4, 6, 8, 12, 16, 24, 40)
Kind = str | tuple[int, ...]


def kind_of(t: str, letters: Letters) -> Kind:
    """What a token is like by itself; longer ones are ASCII letters and digits."""
    if len(t) == 1 and not t.isalnum():
        return t
    n, low = bisect.bisect(LENGTHS, len(t)), t.lower()
    digits = 0 if t.isalpha() else sum(c.isdigit() for c in t)
    up, lo = t != low, t != t.upper()
    turns = 0
    if digits or up and lo and t[1:] != low[1:]:
        turns = min(4, sum((x.isdigit() != y.isdigit()) or (x.islower() and y.isupper()) for x, y in zip(t, t[1:])))
    odd = min(9, int(letters.strange(low))) if len(t) >= 6 else -1
    ent, dig, hexed = -1, -1, -1
    if len(t) >= 8:
        hexed = int(bool(re.fullmatch("[0-9a-f]+", t)))
        if digits:
            ent, dig = int(2 * _entropy(t)), 8 * digits // len(t)
    return n, int(digits > 0), int(up), int(lo), turns, odd, ent, dig, hexed


def shape(kind: Kind) -> list[str]:
    """Features of such a token; the first two describe it to its neighbours."""
    if isinstance(kind, str):
        return [f"sym={kind}"]
    n, d, up, lo, turns, odd, ent, dig, hexed = kind
    mixed = f"{d}{up}{lo}"
    out = [f"len={n}", f"mix={mixed}", f"len+mix={n}{mixed}", f"turns={turns}{int(n > 4)}", f"turns+mix={turns}{mixed}"]
    if odd >= 0:
        out += [f"odd={odd}", f"odd+mix={odd}{mixed}", f"odd+len={odd}{n}"]
    if hexed >= 0:
        out += [f"hex={hexed}{mixed}", f"ent={ent}", f"dig={dig}"]
    return out


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    return [f"file:eq={min(3, text.count('='))}", f"file:long={int(n > 4000)}", f"file:brace={int('{' in text)}"]


_IDS: dict[str, int] = {}


def _id(f: str) -> int:
    if f not in _IDS:
        _IDS[f] = int.from_bytes(hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % DIM
    return _IDS[f]


BESIDE = (-2, -1, 1, 2)


@functools.cache
def _own(kind: Kind) -> list[int]:
    return [_id(x) for x in shape(kind)]


@functools.cache
def _beside(kind: Kind | None, k: int) -> list[int]:
    return [_id(f"{k}:{x}") for x in (shape(kind)[:2] if kind is not None else ["edge"])]


def features(tokens: list[str], file: list[str], letters: Letters) -> list[list[int]]:
    own = [kind_of(t, letters) for t in tokens]
    words = [t.lower() if t.lower() in WORDS else "" for t in tokens]
    always, out = [_id(x) for x in ["bias", *file]], []
    for i, kind in enumerate(own):
        f = [*always, *_own(kind)]
        for k in BESIDE:
            f += _beside(own[i + k] if 0 <= i + k < len(own) else None, k)
        f += [_id(f"near={w}") for w in sorted(set(words[max(0, i - 5) : i])) if w]
        out.append(f)
    return out


def _emit(w: np.ndarray, feats: list[list[int]]) -> np.ndarray:
    return np.array([w[f].sum(0) for f in feats])


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    n = len(emit)
    score, back = emit[0] + [0.0, 0.0, -1e9], np.zeros((n, 3), int)  # a sequence can't begin inside
    for i in range(1, n):
        s = score[:, None] + trans
        back[i] = s.argmax(0)
        score = s.max(0) + emit[i]
    tags = [int(score.argmax())]
    for i in range(n - 1, 0, -1):
        tags.append(int(back[i, tags[-1]]))
    return tags[::-1]


def decode(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The tags of ``viterbi``.  A span of B and I gains over O at most the sum of its tokens' best gains and what
    leaving it gives; a token all of whose spans would lose is O, and cuts the search."""
    into = np.maximum(emit[:, B] + trans[:, B].max(), emit[:, I] + trans[1:, I].max()) - emit[:, O] - trans[O, O]
    into[0] = max(into[0], emit[0, B] - emit[0, O])
    leave = max(0.0, trans[1:, O].max() - trans[O, O])
    total = np.concatenate([[0.0], np.cumsum(into)])
    best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
    is_open = np.concatenate([[False], best + leave >= -1e-6, [False]])
    tags = np.zeros(len(emit), np.int8)
    for a, b in np.flatnonzero(is_open[1:] != is_open[:-1]).reshape(-1, 2):
        lo, hi = max(0, a - 1), min(len(emit), b + 1)
        e = emit[lo:hi].copy()
        if lo < a:
            e[0, 1:] = -1e9
        if hi > b:
            e[-1, 1:] = -1e9
        tags[lo:hi] = viterbi(e, trans)
    return tags


class Tables:
    """Scores of whole texts: each class of tokens (shape and telling word) has what it adds to its own
    token and to those beside it."""

    def __init__(self, w: np.ndarray, letters: Letters):
        self.w, self.letters, self.known, self.classes, self.sums = w, letters, {}, {}, {}
        self.rows: dict[int, list[np.ndarray]] = {k: [] for k in (0, *BESIDE)}
        self.words: list[str] = []
        self.packed: dict[int, np.ndarray] = {}

    def _sum(self, names: list[str]) -> np.ndarray:
        key = tuple(names)
        if key not in self.sums:
            self.sums[key] = self.w[[_id(x) for x in names]].sum(0)
        return self.sums[key]

    def _class(self, token: str) -> int:
        kind, low = kind_of(token, self.letters), token.lower()
        word = low if low in WORDS else ""
        key = (kind, word)
        if key not in self.classes:
            self.classes[key] = len(self.classes)
            self.rows[0].append(self.w[_own(kind)].sum(0))
            for k in BESIDE:
                self.rows[k].append(self.w[_beside(kind, k)].sum(0))
            self.words.append(word)
            self.packed = {}
        return self.classes[key]

    def codes(self, text: str) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            end = ALNUM.match(text, min(len(text), at + PIECE)).end()  # tokens are not cut
            tokens = TOKEN.findall(text, at, end)
            if len(self.known) > TOKENS_HELD:
                self.known.clear()
            for t in set(tokens):
                if t not in self.known:
                    self.known[t] = self._class(t)
            out.append(np.fromiter(map(self.known.__getitem__, tokens), np.int32, len(tokens)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def emit(self, text: str) -> np.ndarray:
        """As _emit(w, features(tokens, file_features(text))) for all tokens of the text."""
        c = self.codes(text)
        if not len(c):
            return np.zeros((0, 3))
        if not self.packed:
            self.packed = {k: np.array(v) for k, v in self.rows.items()}
            self.telling = np.array([bool(x) for x in self.words])
        e = self.packed[0][c] + self._sum(["bias", *file_features(text)])
        for k in (1, 2):
            e[k:] += self.packed[-k][c[:-k]]
            e[:k] += self._sum([f"{-k}:edge"])
            e[:-k] += self.packed[k][c[k:]]
            e[-k:] += self._sum([f"{k}:edge"])
        near = {(i, self.words[c[p]]) for p in np.flatnonzero(self.telling[c]).tolist() for i in range(p + 1, min(len(c), p + 6))}
        for i, word in sorted(near):
            e[i] += self._sum([f"near={word}"])
        return e


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


class Crf:
    def __init__(self, letters: Letters) -> None:
        self.w, self.t, self.letters = np.zeros((DIM, 3)), np.zeros((3, 3)), letters
        self.t[O, I] = -1e4  # I follows B or I only
        self.gw, self.gt = np.full((DIM, 3), 1e-2), np.full((3, 3), 1.0)  # squares of past gradients
        self._tables: Tables | None = None

    def gradient(self, batch: list[tuple[list[list[int]], list[int]]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log-likelihood of some sequences, by weights and transitions; and the log-likelihood."""
        size, longest = len(batch), max(len(f) for f, _ in batch)
        n = np.array([len(f) for f, _ in batch])
        flat = [x for f, _ in batch for x in f]
        ids = np.concatenate([np.array(x) for x in flat])
        owner = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
        emit = np.stack([np.bincount(owner, self.w[ids, k], len(flat)) for k in range(3)], 1)
        seq, pos = np.repeat(np.arange(size), n), np.concatenate([np.arange(k) for k in n])
        tags = np.zeros((size, longest), int)
        tags[seq, pos] = np.concatenate([t for _, t in batch])
        e = np.zeros((size, longest, 3))
        e[seq, pos] = emit
        e[:, 0, I] -= 1e4
        on = np.arange(longest)[None, :] < n[:, None]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for i in range(1, longest):
            a[:, i] = np.where(on[:, i, None], _lse(a[:, i - 1, :, None] + self.t, 1) + e[:, i], a[:, i - 1])
        for i in range(longest - 2, -1, -1):
            b[:, i] = np.where(on[:, i + 1, None], _lse(self.t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0)
        z = _lse(a[:, -1], 1)
        node = np.exp(a + b - z[:, None, None])
        g = (np.eye(3)[tags] - node)[seq, pos]
        gw = np.stack([np.bincount(ids, g[owner, k], DIM) for k in range(3)], 1)
        step = on[:, 1:, None, None]
        edge = np.where(step, np.exp(np.minimum(0, a[:, :-1, :, None] + self.t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])), 0).sum((0, 1))
        got = np.zeros((3, 3))
        np.add.at(got, (tags[:, :-1][on[:, 1:]], tags[:, 1:][on[:, 1:]]), 1)
        path = e[seq, pos, tags[seq, pos]].sum() + (got * self.t).sum()
        return gw, got - edge, float(path - z.sum())

    def step(self, batch: list[tuple[list[list[int]], list[int]]], rate: float) -> None:
        """One ascent step, each weight at its own rate (the root of its past gradients' squares)."""
        gw, gt, _ = self.gradient(batch)
        gw = gw / len(batch) - RIDGE * self.w
        gt = gt / len(batch)
        self.gw += gw**2
        self.gt += gt**2
        self.w += rate * gw / np.sqrt(self.gw)
        self.t += rate * gt / np.sqrt(self.gt)
        self.t[O, I] = -1e4

    def fit(self, data: list[tuple[list[list[int]], list[int]]], epochs: int, rate: float, rng: np.random.Generator) -> None:
        for _ in range(epochs):
            order = rng.permutation(len(data))
            order = order[np.argsort([len(data[i][0]) // 8 for i in order], kind="stable")]  # sequences of like length together
            parts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for p in rng.permutation(len(parts)):
                self.step([data[i] for i in parts[p]], rate)

    def tag(self, feats: list[list[int]]) -> list[int]:
        return viterbi(_emit(self.w, feats), self.t)

    def tag_text(self, text: str) -> np.ndarray:
        """Tags of all tokens of a text."""
        if self._tables is None:
            self._tables = Tables(self.w, self.letters)
        e = self._tables.emit(text)
        return decode(e, self.t) if len(e) else np.zeros(0, np.int8)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tables": None, "gw": None, "gt": None}


def respelled(text: str, values: list[tuple[int, int]], rng: np.random.Generator) -> str:
    """The text with its secrets written in letters of either case and digits: secrets of other alphabets."""
    out = list(text)
    for a, b in values:
        for i in range(a, b):
            if out[i].isalnum():
                out[i] = BASE62[rng.integers(62)]
    return "".join(out)


def tagged(text: str, lo: int, hi: int, values: list[tuple[int, int]], letters: Letters) -> list[tuple[list[list[int]], list[int]]]:
    """The stretch as an example: tokens inside the values are secret."""
    tokens, tags = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, lo, hi)], []
    for _, a, b in tokens:
        if not any(x <= a and b <= y for x, y in values):
            tags.append(O)
        else:
            tags.append(I if tags and tags[-1] != O and not any(x == a for x, _ in values) else B)
    return [(features([t for t, *_ in tokens], file_features(text), letters), tags)] if tokens else []


def examples(text: str, values: list[tuple[int, int]], letters: Letters) -> list[tuple[list[list[int]], list[int]]]:
    """Windows that the values label in full."""
    out = []
    for lo, hi in windows(text, values):
        if any(_random_like(m[0]) and not any(x < lo + m.end() and lo + m.start() < y for x, y in values) for m in SEED.finditer(text[lo:hi])):
            continue
        out += tagged(text, lo, hi, values, letters)
    return out


def random_secret(rng: np.random.Generator, alone: bool) -> str:
    pick = lambda xs: xs[rng.integers(len(xs))]
    chars = pick(ALPHABETS).replace("BASE62", BASE62)
    if alone and not any(c.isdigit() for c in chars):
        chars = BASE62
    n = int(rng.integers(ALONE_FROM if alone else CUED[0], CUED[1] + 1))
    v = "".join(pick(chars) for _ in range(n))
    v = v if v[0].isalnum() and v[-1].isalnum() else f"a{v[1:-1]}7"
    if rng.random() < 0.25:  # a vendor's prefix
        v = "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.integers(2, 6))) + pick("_-") + v
    return v


def plant(text: str, rng: np.random.Generator, secret: bool) -> tuple[str, int, int, list[tuple[int, int]]] | None:
    """A plain stretch of the text with a secret or a harmless form in it: (text, from, to, values)."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    at = int(rng.integers(max(1, len(text))))
    lo, hi = max(0, at - CONTEXT), min(len(text), at + CONTEXT)
    near = text[lo:hi]
    if _values(near) or windows(near):
        return None
    words = re.findall(r"[^\W\d_]{2,}", near) or ["word"]
    gap = near.find(" ", at - lo)
    gap = gap if gap >= 0 else len(near)
    if secret:
        form = pick(SECRET_FORMS)
        v = random_secret(rng, "{w}" not in form and "Bearer" not in form and "@" not in form)
        before, after = form.replace("{w}", pick(CUES)).split("{v}")
        a = gap + 1 + len(before)
        out, values = f"{near[:gap]} {before}{v}{after} {near[gap:]}", [(a, a + len(v))]
    else:
        kinds = {"h": "0123456789abcdef", "d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        form = pick(HARMLESS_FORMS)
        # (runs of a kind's letter that stand for themselves are whole words: left as they are)
        made = re.sub(r"(?<![a-z])[hdlu]+(?![a-z])|(?<=v)d|W|(?<!IS)C", lambda m: pick(words) if m[0] == "W" else pick(words).title() if m[0] == "C" else "".join(pick(kinds[c]) for c in m[0]), form)
        out, values = f"{near[:gap]} {made} {near[gap:]}", []
    return out, 0, len(out), values


def train(texts: list[str], epochs: int = 4, rate: float = 0.3, seed: int = 7) -> Crf | None:
    rng = np.random.default_rng(seed)
    carriers = [t for t in texts if t.strip()]
    if not carriers:
        return None
    model = Crf(Letters(carriers))
    data = []
    for t in texts:
        values = _values(t)
        data += examples(t, values, model.letters)
        if values:
            data += examples(respelled(t, values, rng), values, model.letters)
    for i in range(PLANTED):
        for secret in (True, False):
            if made := plant(carriers[i % len(carriers)], rng, secret):
                data += tagged(*made, model.letters)
    # plain stretches, so that ordinary words are seen as O in every neighbourhood
    for t in carriers:
        at = int(rng.integers(max(1, len(t) - PLAIN)))
        data += plain(t, at, at + PLAIN, model.letters)
    model.fit(data, epochs, rate, rng)
    # what is found apart from the rules' secrets is learned as O, unless it looks random
    wrong = [x for t in texts for a, b in crf_spans(t, model) if not any(x < b and a < y for x, y in _values(t)) for x in plain(t, a - CONTEXT, b + CONTEXT, model.letters)]
    if wrong:
        model.fit(data + [wrong[i] for i in rng.permutation(len(wrong))[: len(data)]], 2, rate, rng)
    model._tables = None  # of the weights before
    return model


def plain(text: str, lo: int, hi: int, letters: Letters) -> list[tuple[list[list[int]], list[int]]]:
    """The stretch as an example of O throughout, if it holds no secret and nothing that may be one."""
    lo, hi = max(0, lo), min(len(text), hi)
    near = text[max(0, lo - CONTEXT) : hi + CONTEXT]
    tokens = [m[0] for m in TOKEN.finditer(text, lo, hi)]
    if not tokens or _values(near) or windows(near) or any(len(t) >= 8 and _random_like(t) for t in tokens):
        return []
    return [(features(tokens, file_features(text), letters), [O] * len(tokens))]


def crf_spans(text: str, model: Crf) -> list[tuple[int, int]]:
    tags, out = model.tag_text(text), []
    if tags.any():
        for m, tag in zip(TOKEN.finditer(text), tags.tolist()):
            if tag == B:
                out.append([m.start(), m.end()])
            elif tag == I:
                out[-1][1] = m.end()
    return [(a, b) for a, b in out]


def all_spans(text: str, model: Crf | None) -> list[tuple[int, int, int]]:
    """(start, kind, end): base spans, and the CRF's where no base span is touched."""
    base = base_spans(text)
    more = [(a, 3, b) for a, b in crf_spans(text, model)] if model else []
    return sorted(base + [x for x in more if not any(s < x[2] and x[0] < e for s, _, e in base)])


def training_texts(docs: DataFrame, bound: int = TRAIN_DOCS) -> list[str]:
    """Texts with a secret and texts without, half of ``bound`` each at most (those of the smallest id hash).  The rules
    look at every text once; the texts themselves are fetched by id."""
    d = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    has = materialize(d.select("doc_id", F.col("text").rlike(ANY_RULE).alias("has")), "has-secret")
    h, half = F.xxhash64("doc_id"), bound // 2
    first = lambda x: has.where(F.col("has") == x).select("doc_id").distinct().orderBy(h, "doc_id").limit(half)
    ids = first(True).unionByName(first(False)).distinct()  # `bound` rows
    rows = sorted({(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()})
    discard(has)
    with_secret = [bool(re.search(ANY_RULE, t, re.A)) for _, t in rows]
    return [t for x in (True, False) for t in [t for (_, t), y in zip(rows, with_secret) if x == y][:half]]


def find_secrets(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) in code points."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        for b in batches:
            found = [[(KINDS[k], s, e) for s, k, e in all_spans(t or "", m)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": found})

    return map_pandas(docs.select("doc_id", "text"), scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, train(training_texts(docs)))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    line = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )
