"""A hierarchical Pitman-Yor language model, trained by Gibbs sampling of table counts.

Restaurants: one for each pair of words before a word (level 2), one for each
word before (level 1), and the root (level 0), whose base is uniform over the
words and one unknown word.  A restaurant's parent lacks the farther word, so
pairs that end alike share a parent; the two words are END at a text's start.
Each restaurant has a key of its own: no contexts are merged.  Customers of a
level-2 restaurant are the training tokens, and each table of a restaurant is a
customer of its parent.

The state is, for each restaurant and word, how many tables its c customers sit
at.  With t[.] for these counts the posterior is a product over restaurants of

    rising(strength, discount; T) / rising(strength, 1; C) * product of S(c, t),

S being generalised Stirling numbers.  ``DISCOUNT`` is 1/2 at all levels, for
which S has a closed form, so each t's conditional given all others (the terms
of its own restaurant and of its parent) is exact at any number of customers.
Strengths are resampled, one for each level, on a grid, from their conditional.

How it is spread: everything of a word before (its level-1 restaurant and the
level-2 restaurants below it) lives in the bucket of that word's hash.  Words
before with more tokens than half a bucket are hot: their pairs are dealt out
by pair, hot pairs by pair and word, and their level-1 tables live with the
root.  Root tables live in buckets of the words.  So no bucket has all tokens
of a word.  In a sweep each bucket draws its own tables, against counts of the
root that are refreshed between sweeps; within a bucket rows are drawn in
``PARTS`` random parts, one after the other (rows of one part at once).  Only
sums of hot restaurants, at most two for each bucket, and of the root are known
to all.  Predictions are averaged over the samples, then their logarithms are
summed as doubles.

Texts are encoded once into written blocks that carry their ids, so all passes
see the same numbers whatever task is retried; words are numbered, frequent ones
first.  Counts are summed in a block before they are shuffled; rows are packed
arrays, a few bytes a token.

Defined cases: a null text is empty and has one token, its end; a null id isn't
held out; rows that repeat are scored each for itself; without training rows
every word is unknown and has the base's probability 1.  A very long text is one
block, whose task needs some 60 bytes a token.  Extra columns take no part,
whatever their names.  For a seed, a number of buckets and a set of hot words,
draws don't depend on how the texts are dealt out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import drop_stored, stored

DISCOUNT = 0.5
#: The strengths among which a level's is drawn; the prior is even on them.
GRID = np.geomspace(0.02, 2000.0, 26)
STRENGTHS = (10.0, 2.0, 1.0)
BURN_IN, SAMPLES = 2, 3
PARTS = 4
#: Bounds of a block: tokens, and texts (their numbers are kept in 16 bits).
BLOCK_TOKENS, BLOCK_ROWS = 1_000_000, 60_000
#: Tokens for each bucket, about.
BUCKET_TOKENS = 1_300_000
#: Buckets of words before for each bucket of words.
WORDS_SHARE = 6
#: Counts up to which a conditional is worked out in full; beyond it, where its mass is.
FULL = 1 << 18
_CELLS = 400_000
#: Bytes of text handled at once.
SLICE_BYTES = 1_000_000
FOLDS, HELD_OUT = 7, 2
U64 = np.uint64
_END = np.array([0x5DEECE66D1234567], U64)
#: Local numbers of words up to which three fit a 64-bit key with a bit to spare.
_NARROW = 1 << 21
#: Words up to which their numbers are looked up in a table.
_TABLE = 1 << 25

ROW = "kind string, at long, of long, blob binary, x double, y double"
Row = tuple[str, int, int, bytes | None, float, float]


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


# -- packed arrays


def freeze(**arrays: np.ndarray) -> bytes:
    """Named arrays as bytes, compressed: whole numbers by planes of bytes, ascending ones by their steps, hashes as they are."""
    head, parts = [], []
    for name, a in arrays.items():
        a = np.asarray(a)
        steps = False
        if a.dtype.kind in "iu" and a.dtype != U64 and a.size:
            steps = bool(a.size > 2 and a[0] >= 0 and (a[1:] >= a[:-1]).all())
            if steps:
                a = np.diff(a, prepend=0)
            kind = np.promote_types(np.min_scalar_type(a.min()), np.min_scalar_type(a.max()))
            a = a.astype(np.int64 if kind == U64 else kind, copy=False)
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.dtype.kind in "iu" and a.itemsize > 1 and a.dtype != U64 else a.tobytes()
        z = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        head.append([name, a.dtype.str, len(raw), len(z), steps])
        parts.append(z)
    h = json.dumps(head).encode()
    return b"".join([len(h).to_bytes(4, "little"), h, *parts])


def thaw(blob: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    out, at = {}, 4 + n
    for name, kind, raw, z, steps in json.loads(blob[4 : 4 + n]):
        data = pa.decompress(blob[at : at + z], decompressed_size=raw, codec="zstd", asbytes=True) if raw else b""
        t = np.dtype(kind)
        if t.kind in "iu" and t != U64:
            planes = np.frombuffer(data, np.uint8).reshape(t.itemsize, -1).T if t.itemsize > 1 else np.frombuffer(data, np.uint8)
            a = np.ascontiguousarray(planes).view(t).ravel().astype(np.int64)
            out[name] = np.cumsum(a) if steps else a
        else:
            out[name] = np.frombuffer(data, t)
        at += z
    return out


def in_runs(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x, ascending within runs of equal v, by its steps there."""
    out = np.diff(x, prepend=0)
    begin = np.concatenate([[True], v[1:] != v[:-1]])
    out[begin] = x[begin]
    return out


def from_runs(v: np.ndarray, steps: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    total = np.cumsum(steps)
    return total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(v))))


def local_numbers(*arrays: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the different numbers of the words in arrays, ascending; the arrays as places in these)."""
    most = max((int(a.max()) for a in arrays if len(a)), default=0)
    if most < _TABLE:
        mark = np.zeros(most + 1, bool)
        for a in arrays:
            mark[a] = True
        words = np.flatnonzero(mark)
        place = np.cumsum(mark, dtype=np.int32) - np.int32(1)
        return words, [place[a].astype(np.int64) for a in arrays]
    words = np.unique(np.concatenate([np.unique(a) for a in arrays]))
    return words, [np.searchsorted(words, a) for a in arrays]


# -- the model's numbers


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0."""
    x = np.asarray(x, float)
    y = x + 8
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_stirling(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log S(c, t) for discount 1/2, S(c + 1, t) = S(c, t - 1) + (c - t / 2) S(c, t)."""
    c, t = np.asarray(c, float), np.asarray(t, float)
    return lgamma(2 * c - t) - lgamma(t) - lgamma(c - t + 1) - 2 * (c - t) * np.log(2)


def strength_fit(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The log of restaurants' part in the posterior of their level's strength, for each of GRID."""
    c, t = np.asarray(c, np.int64), np.asarray(t, np.int64)
    c, t = c[c > 1], t[c > 1]
    if not len(c):
        return np.zeros(len(GRID))
    pairs, n = np.unique(c.astype(U64) << U64(32) | t.astype(U64), return_counts=True)
    c, t = (pairs >> U64(32)).astype(float)[:, None], (pairs & U64(0xFFFFFFFF)).astype(float)[:, None]
    d, s = DISCOUNT, GRID[None, :]
    return n @ (lgamma(s / d + t) - lgamma(s / d + 1) + (t - 1) * np.log(d) - lgamma(s + c) + lgamma(s + 1))


@dataclass
class Up:
    """What a restaurant's parent adds to the conditional of a word's tables: the parent's other customers
    of the word, its tables of the word, all its other customers, and its level's strength."""

    same: np.ndarray
    tables: np.ndarray
    all: np.ndarray
    strength: float


def draw(rng: np.random.Generator, c: np.ndarray, others: np.ndarray, strength: float, up: Up | None, base: float = 1.0) -> np.ndarray:
    """Tables of a word with c customers, given the restaurant's tables of other words and the parent.

    Without a parent (the root) each table costs the base's probability.
    """
    out = np.minimum(np.asarray(c, np.int64), 1)
    many = np.flatnonzero(c > 1)
    many = many[np.argsort(c[many], kind="stable")]
    size = c[many]
    i = 0
    while i < len(many):
        # rows of about the same number of customers together
        j = max(i + 1, min(int(np.searchsorted(size, 1.25 * size[i] + 1, "right")), i + max(1, _CELLS // int(size[i]))))
        at = many[i:j]
        out[at] = _draw_alike(
            rng, c[at].astype(float), others[at].astype(float), strength,
            up and Up(up.same[at].astype(float), up.tables[at].astype(float), up.all[at].astype(float), up.strength), base
        )
        i = j
    return out


def _steps(c, others, strength, up, base, k):
    """log of p(k + 1 tables) / p(k tables); arrays broadcast to rows by k."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = 4 * (c - k) / (k * (2 * c - k - 1)) * (strength + DISCOUNT * (others + k))
        if up is None:
            r = r * base
        else:
            n = up.same + k
            r = r * (2 * n + 1 - up.tables) * (2 * n - up.tables) / (4 * (n - up.tables + 1) * (up.strength + up.all + k))
        return np.where(k < c, np.log(np.maximum(r, 1e-300)), -np.inf)


def _draw_alike(rng, c, others, strength, up, base):
    low = np.ones(len(c)) if up is None else np.maximum(1, up.tables - up.same)
    most = int(c.max())
    first = np.ones(len(c))
    if most > FULL:
        # where the ratio of neighbours passes one, by halving; the mass is within a few roots of it
        a, b = low.copy(), c.copy()
        for _ in range(64):
            m = np.floor((a + b) / 2)
            rising = (_steps(c, others, strength, up, base, m) > 0) & (m < b)
            a, b = np.where(rising, m + 1, a), np.where(rising, b, m)
        reach = 12 * np.sqrt(a) + 64
        first, most = np.maximum(low, np.floor(a - reach)), int((2 * reach).max()) + 2
    k = first[:, None] + np.arange(most)[None, :]
    col = lambda x: x[:, None]
    steps = _steps(col(c), col(others), strength, up and Up(col(up.same), col(up.tables), col(up.all), up.strength), base, k[:, :-1])
    steps[k[:, :-1] < col(low)] = 0.0
    logp = np.zeros(k.shape)
    np.cumsum(steps, axis=1, out=logp[:, 1:])
    logp[(k < col(low)) | (k > col(c))] = -np.inf
    p = np.cumsum(np.exp(logp - logp.max(axis=1, keepdims=True)), axis=1)
    at = (rng.random(len(c))[:, None] * p[:, -1:] > p).sum(axis=1)
    return (first + np.minimum(at, most - 1)).astype(np.int64)


@dataclass
class Model:
    """The numbers that all buckets share: strengths by level, and sums of the root and of hot restaurants."""

    buckets: int
    hot: np.ndarray
    hot_pairs: np.ndarray
    words: int = 0
    tokens: int = 0
    strengths: tuple[float, ...] = STRENGTHS
    root: tuple[int, int] = (0, 0)
    #: customers and tables of hot words before (1, 2, ...) and of hot pairs (0, 1, ...)
    hot_c: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    hot_t: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    pair_c: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_t: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def word_buckets(self) -> int:
        """Buckets of words, fewer than those of words before: what they hear is far less, and rows of both meet."""
        return -(-self.buckets // WORDS_SHARE)

    def bucket(self, h: np.ndarray, buckets: int | None = None) -> np.ndarray:
        return ((W.mix(h.astype(U64) ^ U64(0x27D4EB2F165667C5)) >> U64(32)) * U64(buckets or self.buckets) >> U64(32)).astype(np.int64)

    def hot_number(self, words: np.ndarray) -> np.ndarray:
        """1, 2, ... for hot words, else 0."""
        i = np.searchsorted(self.hot, words)
        i[i == len(self.hot)] = 0
        return np.where(self.hot[i] == words, i + 1, 0) if len(self.hot) else np.zeros(len(words), np.int64)

    def pair_number(self, pairs: np.ndarray) -> np.ndarray:
        """0, 1, ... for hot pairs, else -1."""
        i = np.searchsorted(self.hot_pairs, pairs)
        i[i == len(self.hot_pairs)] = 0
        return np.where(self.hot_pairs[i] == pairs, i, -1) if len(self.hot_pairs) else np.full(len(pairs), -1, np.int64)

    def route(self, words: np.ndarray, v: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The bucket of each trigram x v w; v, x and w number words."""
        out = self.bucket(words)[v]
        hot = np.flatnonzero(self.hot_number(words)[v] > 0)
        if len(hot):
            pair = pair_key(words[v[hot]], words[x[hot]])
            key = np.where(self.pair_number(pair) >= 0, W.mix(pair * W._R3 + words[w[hot]].astype(U64)), pair)
            out[hot] = self.bucket(key)
        return out


def pair_key(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    return W.mix(v.astype(U64) * W._R2 + W.mix(x.astype(U64)))


# -- blocks of texts


def _encode(block_tokens: int):
    """Texts to blocks: ids, folds, sizes, the hashes of the block's words, and the tokens as places in these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, number = task.partitionId() if task else 0, 0
        ids, held, sizes, h, rows, size = [], [], [], [], 0, 0

        def out():
            tokens = np.concatenate(h)
            words, place = np.unique(tokens, return_inverse=True)
            fold = np.concatenate(held)
            n = np.concatenate(sizes)
            of = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number]), pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of), pa.array([len(tokens)]),
                    pa.array([int(n[~fold].sum())]), pa.array([freeze(held=fold.astype(np.uint8), sizes=n)], pa.binary()),
                    pa.array([freeze(h=words, n=np.bincount(place), tokens=place)], pa.binary())
                ],
                ["block", "ids", "n_all", "n_train", "texts", "tokens"],
            )

        for b in batches:
            fold = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for r0, r1, data, offsets in W.slices(b.column(2), SLICE_BYTES):
                if rows and (size > block_tokens or rows + r1 - r0 > BLOCK_ROWS):
                    yield out()
                    number += 1
                    ids, held, sizes, h, rows, size = [], [], [], [], 0, 0
                for a in range(r0, r1, BLOCK_ROWS):  # a slice of empty texts may have very many
                    z = min(r1, a + BLOCK_ROWS)
                    if rows + z - a > BLOCK_ROWS:
                        yield out()
                        number += 1
                        ids, held, sizes, h, rows, size = [], [], [], [], 0, 0
                    o = offsets[a - r0 : z - r0 + 1]
                    w = W.split_words(data[o[0] : o[-1]], o - o[0])
                    ids.append(b.column(0).slice(a, z - a))
                    held.append(fold[a:z])
                    sizes.append(np.diff(w.first) + 1)
                    h.append(np.insert(w.hashes(lower=True), w.first[1:], _END[0]))
                    rows += z - a
                    size += len(h[-1])
        if rows:
            yield out()

    return run


def before(tokens: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(word before, word before that) of each token."""
    starts = np.cumsum(sizes) - sizes
    v = np.concatenate([[end], tokens[:-1]])
    v[starts] = end
    x = np.concatenate([[end], v[:-1]])
    x[starts] = end
    return v, x


def ask_names(block: int, tokens: bytes, model: Model) -> Iterator[Row]:
    """A block's words to the buckets of their hashes, to be numbered."""
    k = thaw(tokens)
    for to, on in _by_word_bucket(k["h"], model):
        yield "ask", to, block, freeze(h=k["h"][on], n=k["n"][on]), 0.0, 0.0


def name_words(at: int, rows: list[Row], model: Model) -> Iterator[Row]:
    """Numbers for a bucket's words, the frequent ones first, so that most numbers are small."""
    asked = [(r[2], thaw(r[3])) for r in rows]
    words, place = np.unique(np.concatenate([a["h"] for _, a in asked]), return_inverse=True)
    n = np.bincount(place, np.concatenate([a["n"] for _, a in asked]))
    number = np.empty(len(words), np.int64)
    number[np.lexsort((words, -n))] = np.arange(len(words)) * model.word_buckets + at
    cuts = np.cumsum([0, *(len(a["h"]) for _, a in asked)])
    for (block, _), i, j in zip(asked, cuts[:-1], cuts[1:], strict=True):
        yield "named", block, at, freeze(number=number[place[i:j]]), 0.0, 0.0


def rename_block(tokens: bytes, named: dict[int, bytes], model: Model) -> bytes:
    """A block's tokens as places in the ascending numbers of its words."""
    k = thaw(tokens)
    number = np.empty(len(k["h"]), np.int64)
    for to, on in _by_word_bucket(k["h"], model):
        number[on] = thaw(named[to])["number"]
    order = np.argsort(number)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return freeze(words=number[order], tokens=place[k["tokens"]], end=place[np.searchsorted(k["h"], _END)])


def _read_block(texts: bytes, tokens: bytes) -> tuple[np.ndarray, ...]:
    """(words, v, x, w, number of the text, held out) of a block's tokens."""
    t, k = thaw(texts), thaw(tokens)
    v, x = before(k["tokens"], t["sizes"], int(k["end"][0]))
    row = np.repeat(np.arange(len(t["sizes"])), t["sizes"])
    return k["words"], v, x, k["tokens"], row, t["held"][row] > 0


def _heavy(share: float):
    """Counts of words before, and of pairs of which the nearer word is heavy, that may be hot in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts, tokens in zip(b.column(0), b.column(1), strict=True):
                words, v, x, _, _, _ = _read_block(texts.as_py(), tokens.as_py())
                least = max(1.0, share * len(v))
                n = np.bincount(v, minlength=len(words))
                big = np.flatnonzero(n >= least)
                on = n[v] >= least
                pair, k = np.unique(pair_key(words[v[on]], words[x[on]]), return_counts=True)
                keep = k >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([words[big], pair[keep].view(np.int64)])), pa.array(np.repeat([False, True], [len(big), int(keep.sum())])), pa.array(np.concatenate([n[big], k[keep]]))],
                    ["key", "pair", "n"],
                )

    return run


def trigram_order(v: np.ndarray, x: np.ndarray, w: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by v, x and w; which in that order are new)."""
    if words <= _NARROW:
        key = (v.astype(U64) << U64(42)) | (x.astype(U64) << U64(21)) | w.astype(U64)
        order = np.argsort(key)
        s = key[order]
        return order, np.concatenate([[True], s[1:] != s[:-1]])
    order = np.lexsort((w, x, v))
    a, b, c = v[order], x[order], w[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])


def pack_block(block: int, texts: bytes, tokens: bytes, model: Model, with_texts: bool) -> Iterator[Row]:
    """A block's different trigrams, a row for each bucket: the numbers of their words, and training counts.

    With texts, also how often each stands in the block, and the numbers of the texts.
    """
    words, v, x, w, row, held = _read_block(texts, tokens)
    if with_texts or len(words) > _NARROW:
        order, new = trigram_order(v, x, w, len(words))
        first = np.flatnonzero(new)
        c = np.add.reduceat((~held[order]).astype(np.int64), first)
        at = order[first]
        v, x, w = v[at], x[at], w[at]
    else:
        # without texts the keys themselves are sorted, which is cheaper than their order
        key = np.sort(((v.astype(U64) << U64(21) | x.astype(U64)) << U64(21) | w.astype(U64)) << U64(1) | held.astype(U64))
        tri = key >> U64(1)
        first = np.flatnonzero(np.concatenate([[True], tri[1:] != tri[:-1]]))
        c = np.add.reduceat((key & U64(1) == 0).astype(np.int64), first)
        tri, low = tri[first], U64(_NARROW - 1)
        v, x, w = ((tri >> U64(s) & low).astype(np.int64) for s in (42, 21, 0))
    n = np.diff(np.append(first, len(held)))
    to = model.route(words, v, x, w)
    narrow = np.uint16 if model.buckets <= 1 << 16 else np.int64
    by = np.argsort(to.astype(narrow), kind="stable")
    if with_texts:
        row = row[order][np.argsort(np.repeat(to, n).astype(narrow), kind="stable")]
    v, x, w, c, n, to = v[by], x[by], w[by], c[by], n[by], to[by]
    v, x, w = words[v], words[x], words[w]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    spans = np.concatenate([[0], np.cumsum(n)])
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        more = {"n": n[i:j], "row": row[spans[i] : spans[j]]} if with_texts else {}
        yield "tokens", int(to[i]), block, freeze(v=v[i:j], x=in_runs(v[i:j], x[i:j]), w=w[i:j], c=c[i:j], **more), 0.0, 0.0


def _pack(model: Model, with_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, texts, tokens in zip(*(b.column(i) for i in range(3)), strict=True):
                yield _batch(pack_block(block.as_py(), texts.as_py(), tokens.as_py(), model, with_texts))

    return run


_SCHEMA = pa.schema([("kind", pa.string()), ("at", pa.int64()), ("of", pa.int64()), ("blob", pa.binary()), ("x", pa.float64()), ("y", pa.float64())])


def _batch(rows: Iterable[Row]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


# -- a bucket of words before


@dataclass
class Bucket:
    """A bucket's different trigrams, by v, x, w, and the rows of both levels that they make.

    Entries are the (hot word before or 0, word) pairs whose counts the root's buckets keep.
    """

    words: np.ndarray
    v: np.ndarray
    x: np.ndarray
    w: np.ndarray
    c: np.ndarray
    #: of each trigram: its level-2 restaurant and its level-1 row
    r2: np.ndarray
    l1: np.ndarray
    pair: np.ndarray  # of each level-2 restaurant: hot pair or -1
    v1: np.ndarray  # of each level-1 row: the word before
    e1: np.ndarray  # of each level-1 row: its entry
    hot1: np.ndarray  # of each word: hot number or 0
    entry_w: np.ndarray
    entry_p: np.ndarray
    live2: np.ndarray
    kids: np.ndarray
    live1: np.ndarray

    @property
    def here(self) -> np.ndarray:
        """Which level-1 rows have their tables in this bucket."""
        return self.hot1[self.v1] == 0


def merge_rows(blobs: list[bytes], model: Model) -> tuple[Bucket, list[tuple[np.ndarray, dict]]]:
    """The bucket of packed rows, and for each row the trigrams that it lists (with its arrays)."""
    rows = [thaw(b) for b in blobs]
    x = np.concatenate([from_runs(r["v"], r["x"]) for r in rows])
    words, (v, x, w) = local_numbers(np.concatenate([r["v"] for r in rows]), x, np.concatenate([r["w"] for r in rows]))
    order, new = trigram_order(v, x, w, len(words))
    first = np.flatnonzero(new)
    c = np.add.reduceat(np.concatenate([r["c"] for r in rows])[order], first)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    at = order[first]
    v, x, w = v[at], x[at], w[at]
    sizes = np.cumsum([0, *(len(r["c"]) for r in rows)])
    return structure(words, v, x, w, c, model), [(group[a:b], r) for a, b, r in zip(sizes[:-1], sizes[1:], rows, strict=True)]


def structure(words: np.ndarray, v: np.ndarray, x: np.ndarray, w: np.ndarray, c: np.ndarray, model: Model) -> Bucket:
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (x[1:] != x[:-1])])
    r2, first = np.cumsum(new) - 1, np.flatnonzero(new)
    hot1 = model.hot_number(words)
    pair = np.full(len(first), -1, np.int64)
    on = np.flatnonzero(hot1[v[first]] > 0)
    pair[on] = model.pair_number(pair_key(words[v[first][on]], words[x[first][on]]))
    n = len(words)
    pairs, l1 = np.unique(v * n + w, return_inverse=True)
    v1, w1 = pairs // n, pairs % n
    size = len(model.hot) + 1
    entries, e1 = np.unique(w1 * size + hot1[v1], return_inverse=True)
    train, live2 = c > 0, c > 1
    kids = np.bincount(l1[train], minlength=len(pairs))
    busy = np.bincount(l1[live2], minlength=len(pairs)) > 0
    return Bucket(words, v, x, w, c, r2, l1, pair, v1, e1, hot1, words[entries // size], entries % size, live2, kids, busy | ((kids > 1) & (hot1[v1] == 0)))


def _by_word_bucket(w: np.ndarray, model: Model) -> Iterator[tuple[int, np.ndarray]]:
    to = model.bucket(w, model.word_buckets)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1], [True]])) if len(w) else []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(to[order[i]]), order[i:j]


def _fit_rows(level: int, fit: np.ndarray) -> Iterator[Row]:
    for g in np.flatnonzero(fit):
        yield "fit", level * len(GRID) + int(g), 0, None, float(fit[g]), 0.0


def count_bucket(at: int, rows: list[Row], model: Model) -> Iterator[Row]:
    """Packed rows to a bucket's first state, with each customer's tables one, and its message to the root's buckets."""
    b, _ = merge_rows([r[3] for r in rows], model)
    train = b.c > 0
    tokens = np.bincount(b.e1[b.l1], b.c, len(b.entry_w)).astype(np.int64)
    # level 2
    all_c = np.bincount(b.r2, b.c).astype(np.int64)
    all_t = np.bincount(b.r2[train], minlength=len(all_c))
    ur, r2 = np.unique(b.r2[b.live2], return_inverse=True)
    still = np.ones(len(all_c), bool)
    still[ur] = False
    still &= b.pair < 0
    fit2 = strength_fit(all_c[still], all_t[still])
    static2 = np.bincount(b.r2[train & ~b.live2], minlength=len(all_c))[ur]
    # level 1
    rows1 = np.flatnonzero(b.live1)
    number = np.full(len(b.v1), -1, np.int64)
    number[rows1] = np.arange(len(rows1))
    busy_kids = np.bincount(b.l1[b.live2], minlength=len(b.v1))
    has = (b.kids > 0) & b.here
    per_v = np.bincount(b.v1[has], minlength=len(b.words))
    live_v = np.zeros(len(b.words), bool)
    live_v[b.v1[rows1]] = True
    fit1 = strength_fit(per_v[~live_v], per_v[~live_v])
    uv, v1 = np.unique(b.v1[rows1], return_inverse=True)
    static1 = np.bincount(b.v1[has & ~b.live1], minlength=len(b.words))[uv]
    # what the root's buckets hear of: one table for each level-1 row here, the tables below hot ones
    sent = np.bincount(b.e1, np.where(b.here, has, b.kids), len(b.entry_w)).astype(np.int64)
    live_e, e1 = np.unique(b.e1[rows1], return_inverse=True)
    live = np.zeros(len(b.entry_w), bool)
    live[live_e] = True
    yield (
        "fixed", at, 0,
        freeze(
            c2=b.c[b.live2], r2=r2, l2=number[b.l1[b.live2]], static2=static2, all2=all_c[ur], pair=b.pair[ur],
            v1=v1, e1=e1, hot=b.hot1[uv], static1=static1, kids1=(b.kids - busy_kids)[rows1], entry_w=b.entry_w[live_e], entry_p=b.entry_p[live_e],
        ),
        0.0, 0.0,
    )
    yield "state", at, 0, freeze(t2=np.ones(int(b.live2.sum()), np.int64), t1=np.ones(len(rows1), np.int64)), 0.0, 0.0
    for to, on in _by_word_bucket(b.entry_w, model):
        yield "first", to, at, freeze(w=b.entry_w[on], p=b.entry_p[on], n=sent[on], tokens=tokens[on], live=live[on].astype(np.uint8)), 0.0, 0.0
    q = np.flatnonzero(b.pair >= 0)
    for i in q:
        yield "pair", int(b.pair[i]), 0, None, float(all_c[i]), float(all_t[i])
    yield from _fit_rows(2, fit2)
    yield from _fit_rows(1, fit1)


def sweep_bucket(at: int, rows: list[Row], model: Model, rng: np.random.Generator, keep: int | None) -> Iterator[Row]:
    """Draws a bucket's tables anew, given the root's counts of its entries; sends what changed."""
    fixed, state = (next(r for r in rows if r[0] == kind) for kind in ("fixed", "state"))
    old = thaw(state[3])
    s = thaw(fixed[3]) | old
    n_e = len(s["entry_w"])
    rc, rt, c_hot, t_hot = (np.zeros(n_e, np.int64) for _ in range(4))
    replies = {r[2]: thaw(r[3]) for r in rows if r[0] == "reply"}
    for to, on in _by_word_bucket(s["entry_w"], model):
        a = replies[to]
        rc[on], rt[on], c_hot[on], t_hot[on] = a["rc"], a["rt"], a["c1"], a["t1"]
    _, theta1, theta2 = model.strengths
    c2, r2, l2, t2 = s["c2"], s["r2"], s["l2"], s["t2"].copy()
    v1, e1, hot = s["v1"], s["e1"], s["hot"]
    here = hot[v1] == 0
    sum_of = lambda i, x, n: np.bincount(i, x, n).astype(np.int64)
    n1, nv = len(v1), len(hot)
    c1 = np.where(here, s["kids1"] + sum_of(l2, t2, n1), c_hot[e1])
    t1 = np.where(here, s["t1"], t_hot[e1])
    cv = np.where(hot == 0, s["static1"] + sum_of(v1, np.where(here, c1, 0), nv), model.hot_c[hot])
    tv = s["static1"] + sum_of(v1, np.where(here, t1, 0), nv)
    old2, old1 = t2.copy(), t1.copy()
    tu = s["static2"] + sum_of(r2, t2, len(s["static2"]))
    mine = tu.copy()
    paired = s["pair"] >= 0
    tu[paired] = model.pair_t[s["pair"][paired]]
    c0 = model.root[0]

    def settle(new: np.ndarray, on: np.ndarray) -> None:
        """Takes new tables of level-1 rows, and what follows above."""
        nonlocal c0
        d = new - t1[on]
        t1[on] = new
        np.add.at(tv, v1[on], d)
        np.add.at(rc, e1[on], d)
        c0 += int(d.sum())
        np.minimum(rt, rc, out=rt)

    part2, part1 = rng.integers(0, PARTS, len(t2)), rng.integers(0, PARTS, n1)
    for part in range(PARTS):
        on = np.flatnonzero(part2 == part)
        p = l2[on]
        up = Up(c1[p] - t2[on], t1[p], cv[v1[p]] - t2[on], theta1)
        d = draw(rng, c2[on], tu[r2[on]] - t2[on], theta2, up) - t2[on]
        t2[on] += d
        np.add.at(tu, r2[on], d)
        np.add.at(c1, p, d)
        np.add.at(cv, v1[p], d)
        # rows below one parent are drawn at once: it can't have more tables than customers
        over = np.flatnonzero(here & (t1 > c1))
        settle(c1[over], over)
        t1[~here] = np.minimum(t1[~here], c1[~here])
        on = np.flatnonzero(here & (part1 == part))
        up = Up(rc[e1[on]] - t1[on], rt[e1[on]], c0 - t1[on], model.strengths[0])
        settle(draw(rng, c1[on], tv[v1[on]] - t1[on], theta1, up), on)
    kept = {} if keep is None else {f"t2_{keep}": t2, f"t1_{keep}": t1}
    yield fixed
    yield "state", at, 0, freeze(**(old | {"t2": t2, "t1": t1} | kept)), 0.0, 0.0
    delta = sum_of(e1, np.where(here, t1 - old1, 0), n_e) + sum_of(e1[l2], np.where(here[l2], 0, t2 - old2), n_e)
    for to, on in _by_word_bucket(s["entry_w"], model):
        yield "change", to, at, freeze(w=s["entry_w"][on], p=s["entry_p"][on], n=delta[on]), 0.0, 0.0
    moved = s["static2"] + sum_of(r2, t2, len(s["static2"])) - mine
    for i in np.flatnonzero(paired & (moved != 0)):
        yield "pair", int(s["pair"][i]), 0, None, 0.0, float(moved[i])
    yield from _fit_rows(2, strength_fit(s["all2"][~paired], tu[~paired]))
    yield from _fit_rows(1, strength_fit(cv[hot == 0], tv[hot == 0]))


# -- a bucket of words, with the root's tables and those of hot words before


def _find(s: dict[str, np.ndarray], w: np.ndarray, p: np.ndarray, hot_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each entry's word, place of its hot row or -1)."""
    i = np.searchsorted(s["words"], w)
    k = np.full(len(w), -1, np.int64)
    on = p > 0
    k[on] = np.searchsorted(s["hot_w"] * hot_size + s["hot_p"], i[on] * hot_size + p[on])
    return i, k


def _answers(s: dict[str, np.ndarray], i: np.ndarray, k: np.ndarray, rc: np.ndarray, rt: np.ndarray, c1: np.ndarray, t1: np.ndarray) -> dict[str, np.ndarray]:
    pick = lambda a: np.where(k >= 0, a[np.maximum(k, 0)], 0) if len(a) else np.zeros(len(k), np.int64)
    return {"rc": rc[i], "rt": rt[i], "c1": pick(c1), "t1": pick(t1)}


def _root_sums(s: dict[str, np.ndarray], rc: np.ndarray) -> Iterator[Row]:
    yield "root", 0, 0, None, float(rc.sum()), float(s["rt"].sum())
    p, at = np.unique(s["hot_p"], return_inverse=True)
    for q, c, t in zip(p, np.bincount(at, s["c1"], len(p)), np.bincount(at, s["t1"], len(p)), strict=True):
        yield "hot", int(q), 0, None, float(c), float(t)


def root_customers(s: dict[str, np.ndarray], t1: np.ndarray) -> np.ndarray:
    return s["below"] + np.bincount(s["hot_w"], t1, len(s["words"])).astype(np.int64)


def first_root(at: int, rows: list[Row], model: Model) -> Iterator[Row]:
    """The root's first state from the buckets' messages, its replies, and where each bucket's entries stand."""
    heard = [(r[2], thaw(r[3])) for r in rows]
    size = len(model.hot) + 1
    words = np.unique(np.concatenate([m["w"] for _, m in heard]))
    w = np.concatenate([np.searchsorted(words, m["w"]) for _, m in heard])
    p, n, tokens = (np.concatenate([m[k] for _, m in heard]) for k in ("p", "n", "tokens"))
    below = np.bincount(w, np.where(p == 0, n, 0), len(words)).astype(np.int64)
    keys, row = np.unique((w * size + p)[p > 0], return_inverse=True)
    c1 = np.bincount(row, n[p > 0], len(keys)).astype(np.int64)
    s = {"words": words, "count": np.bincount(w, tokens, len(words)).astype(np.int64), "below": below, "hot_w": keys // size, "hot_p": keys % size, "c1": c1, "t1": np.minimum(c1, 1)}
    rc = root_customers(s, s["t1"])
    s["rt"] = np.minimum(rc, 1)
    yield "root state", at, 0, freeze(**s), 0.0, 0.0
    for of, m in heard:
        i, k = _find(s, m["w"], m["p"], size)
        yield "link", at, of, freeze(place=np.where(k >= 0, len(words) + k, i)), 0.0, 0.0
        on = m["live"] > 0
        if on.any():
            yield "reply", of, at, freeze(**_answers(s, i[on], k[on], rc, s["rt"], s["c1"], s["t1"])), 0.0, 0.0
    yield "known", 0, 0, None, float((s["count"] > 0).sum()), float(s["count"].sum())
    yield from _root_sums(s, rc)


def sweep_root(at: int, rows: list[Row], model: Model, rng: np.random.Generator, keep: int | None) -> Iterator[Row]:
    """Takes the buckets' changes, draws hot words' and the root's tables anew, and replies."""
    s = thaw(next(r for r in rows if r[0] == "root state")[3])
    size = len(model.hot) + 1
    heard = [(r[2], m, *_find(s, m["w"], m["p"], size)) for r in rows if r[0] == "change" for m in (thaw(r[3]),)]
    below, c1, t1, rt = (s[k].copy() for k in ("below", "c1", "t1", "rt"))
    c0, total = model.root
    c0 -= int(root_customers(s, t1).sum())
    for _, m, i, k in heard:
        np.add.at(below, i[k < 0], m["n"][k < 0])
        np.add.at(c1, k[k >= 0], m["n"][k >= 0])
    s |= {"below": below, "c1": c1}
    t1 = np.minimum(t1, c1)
    rc = root_customers(s, t1)
    c0 += int(rc.sum())
    tables = model.hot_t.copy()
    np.minimum(rt, rc, out=rt)
    part1 = rng.integers(0, PARTS, len(t1))
    for part in range(PARTS if len(t1) else 0):
        on = np.flatnonzero((part1 == part) & (c1 > 0))
        w, p = s["hot_w"][on], s["hot_p"][on]
        new = draw(rng, c1[on], tables[p] - t1[on], model.strengths[1], Up(rc[w] - t1[on], rt[w], np.maximum(c0 - t1[on], rc[w] - t1[on]), model.strengths[0]))
        d = new - t1[on]
        np.add.at(tables, p, d)
        np.add.at(rc, w, d)
        c0 += int(d.sum())
        t1[on] = new
        np.minimum(rt, rc, out=rt)
    part0 = rng.integers(0, PARTS, len(rc))
    for part in range(PARTS):
        on = np.flatnonzero((part0 == part) & (rc > 0))
        new = draw(rng, rc[on], np.maximum(total - rt[on], 0), model.strengths[0], None, 1.0 / (model.words + 1))
        total += int((new - rt[on]).sum())
        rt[on] = new
    s |= {"t1": t1, "rt": rt}
    if keep is not None:
        s |= {f"rc_{keep}": rc, f"rt_{keep}": rt, f"c1_{keep}": c1, f"t1_{keep}": t1}
    yield "root state", at, 0, freeze(**s), 0.0, 0.0
    for of, _, i, k in heard:
        yield "reply", of, at, freeze(**_answers(s, i, k, rc, rt, c1, t1)), 0.0, 0.0
    yield from _root_sums(s, rc)


def answer_all(at: int, rows: list[Row], samples: int) -> Iterator[Row]:
    """For all entries of each bucket: the word's training count, and the samples' counts at the root and of hot rows."""
    s = thaw(next(r for r in rows if r[0] == "root state")[3])
    n = len(s["words"])
    for r in rows:
        if r[0] == "link":
            place = thaw(r[3])["place"]
            k = np.where(place < n, -1, place - n)
            i = np.where(place < n, place, s["hot_w"][np.maximum(k, 0)] if len(s["hot_w"]) else place)
            out = {"count": s["count"][i]}
            for j in range(samples):
                a = _answers(s, i, k, *(s[f"{x}_{j}"] for x in ("rc", "rt", "c1", "t1")))
                out |= {f"{x}_{j}": y for x, y in a.items()}
            yield "answer", r[2], at, freeze(**out), 0.0, 0.0


# -- scores


def predict(c: np.ndarray, t: np.ndarray, all_c: np.ndarray, all_t: np.ndarray, strength: float, parent: np.ndarray) -> np.ndarray:
    """A restaurant's predictive probability of a word with c customers at t tables."""
    return (np.maximum(c - DISCOUNT * t, 0) + (strength + DISCOUNT * all_t) * parent) / (strength + all_c)


def score_bucket(at: int, rows: list[Row], models: list[Model]) -> Iterator[Row]:
    """For each block, the sums over the bucket's tokens of each of its texts."""
    packed = [r for r in rows if r[0] == "tokens"]
    model = models[0]
    b, listed = merge_rows([r[3] for r in packed], model)
    s = thaw(next(r for r in rows if r[0] == "state")[3])
    answers = {r[2]: thaw(r[3]) for r in rows if r[0] == "answer"}
    parts = list(_by_word_bucket(b.entry_w, model))

    def entry(name: str) -> np.ndarray:
        out = np.zeros(len(b.entry_w), np.int64)
        for to, on in parts:
            out[on] = answers[to][name]
        return out

    train, here, hot = b.c > 0, b.here, b.hot1[b.v1]
    all_c = np.bincount(b.r2, b.c).astype(np.int64)
    paired = b.pair >= 0
    total = np.zeros(len(b.c))
    for j, m in enumerate(models):
        rc, rt, c_hot, t_hot = (entry(f"{x}_{j}") for x in ("rc", "rt", "c1", "t1"))
        p = predict(rc, rt, m.root[0], m.root[1], m.strengths[0], 1.0 / (m.words + 1))
        t2 = train.astype(np.int64)
        t2[b.live2] = s[f"t2_{j}"]
        c1 = np.where(here, np.bincount(b.l1, t2, len(b.v1)).astype(np.int64), c_hot[b.e1])
        t1 = np.minimum(c1, 1)
        t1[b.live1] = s[f"t1_{j}"]
        t1 = np.where(here, t1, t_hot[b.e1])
        cv, tv = (np.bincount(b.v1, np.where(here, a, 0), len(b.words)) for a in (c1, t1))
        cv1, tv1 = np.where(here, cv[b.v1], m.hot_c[hot]), np.where(here, tv[b.v1], m.hot_t[hot])
        p = predict(c1, t1, cv1, tv1, m.strengths[1], p[b.e1])
        cu, tu = all_c.copy(), np.bincount(b.r2, t2, len(all_c)).astype(np.int64)
        cu[paired], tu[paired] = m.pair_c[b.pair[paired]], m.pair_t[b.pair[paired]]
        total += predict(b.c, t2, cu[b.r2], tu[b.r2], m.strengths[2], p[b.l1])
    logp = np.log10(total / len(models))
    count = entry("count")[b.e1][b.l1]
    base = np.log10((count + 1) / (model.tokens + model.words + 1))
    for (group, r), (_, _, block, _, _, _) in zip(listed, packed, strict=True):
        g = np.repeat(group, r["n"])
        of = r["row"]
        row = np.flatnonzero(np.bincount(of))
        known, its_base, score = (np.bincount(of, a[g])[row] for a in (count > 0, base, logp))
        yield "sums", block, at, freeze(row=row, known=known.astype(np.int64), base=its_base, score=score), 0.0, 0.0


def sum_block(ids: pa.Array, texts: bytes, blobs: Iterable[bytes], id_name: str, tokens: int) -> pa.Table:
    t = thaw(texts)
    n = len(t["sizes"])
    known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for blob in blobs:
        s = thaw(blob)
        known[s["row"]] += s["known"]
        base[s["row"]] += s["base"]
        score[s["row"]] += s["score"]
    return pa.table({id_name: ids, "held_out": pa.array(t["held"] > 0), "n_tokens": t["sizes"], "n_known": known, "train_tokens": np.full(n, tokens, np.int64), "base_score": base, "score": score})


# -- the run


def _grouped(df: DataFrame, parts: int, work) -> DataFrame:
    """work(at, rows) on all rows of each bucket; there are about ``parts`` of them."""

    def run(t: pa.Table) -> pa.Table:
        cols = [t.column(f.name).to_pylist() for f in _SCHEMA]
        del t
        rows = list(zip(*cols, strict=True))
        # buckets' messages come in any order; sums of doubles and draws must not depend on it
        rows.sort(key=lambda r: (r[0], r[2]))
        return pa.Table.from_batches([_batch(work(rows[0][1], rows))], _SCHEMA)

    return _dealt(df, parts).groupBy("at").applyInArrow(run, ROW)


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """df by ``at``, in more partitions than the session has where there are more buckets."""
    return df.repartition(parts, "at") if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


class Sums:
    """The few sums that the driver needs of a step's rows: root, hot restaurants and fits of strengths."""

    def __init__(self, df: DataFrame):
        few = df.where("blob IS NULL").groupBy("kind", "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        # one row for the root, each hot restaurant (at most two for each bucket) and each point of the grid
        self.rows = [(r.kind, r.at, r.x, r.y) for r in few.collect()]

    def pairs(self, kind: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        c, t = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k, at, x, y in self.rows:
            if k == kind:
                c[at], t[at] = round(x), round(y)
        return c, t

    def fit(self, level: int) -> np.ndarray:
        out = np.zeros(len(GRID))
        for k, at, x, _ in self.rows:
            if k == "fit" and at // len(GRID) == level:
                out[at % len(GRID)] = x
        return out


def draw_strength(rng: np.random.Generator, fit: np.ndarray) -> float:
    p = np.exp(fit - fit.max())
    return float(rng.choice(GRID, p=p / p.sum()))


def hot_keys(blocks: DataFrame, model: Model, n_all: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Words before, and pairs, with more than ``most`` tokens: at most n_all / most of each."""
    found = blocks.select("texts", "tokens").mapInArrow(_heavy(most / max(n_all, 1) / 4), "key long, pair boolean, n long")
    rows = found.groupBy("key", "pair").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
    return np.sort(np.array([r.key for r in rows if not r.pair], np.int64)), np.sort(np.array([r.key for r in rows if r.pair], np.int64).view(U64))


def train_and_score(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 1,
    buckets: int | None = None, hot_tokens: float | None = None, block_tokens: int = BLOCK_TOKENS, strengths: tuple[float, float, float] | None = None
) -> DataFrame:
    """For each row: fold, tokens, and the base's and the model's log10 probability of its text.

    buckets and hot_tokens (words before with more tokens are dealt out) default
    by the number of tokens.  Given strengths (root first) aren't resampled.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.col(text).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"block long, ids array<{id_type}>, n_all long, n_train long, texts binary, tokens binary"
    encoded = stored(docs.mapInArrow(_encode(block_tokens), schema), "encoded", "uncompressed")
    n = encoded.agg(F.coalesce(F.sum("n_all"), F.lit(0)).alias("all"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("train")).first()
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n["all"] // BUCKET_TOKENS))
    most = hot_tokens or max(n["all"] / buckets / 2, 1000.0)
    model = Model(buckets, np.zeros(0, np.int64), np.zeros(0, U64), tokens=n["train"], strengths=strengths or STRENGTHS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, tokens in zip(b.column(0), b.column(1), strict=True):
                yield _batch(ask_names(block.as_py(), tokens.as_py(), model))

    def rename(block: pa.Table, named: pa.Table) -> pa.Table:
        got = dict(zip(named.column("of").to_pylist(), named.column("blob").to_pylist(), strict=True))
        tokens = pa.array([rename_block(block.column("tokens")[0].as_py(), got, model)], pa.binary())
        return block.drop_columns(["at", "tokens"]).append_column("tokens", tokens)

    named = _grouped(encoded.select("block", "tokens").mapInArrow(ask, ROW), model.word_buckets, lambda at, rows, m=model: name_words(at, rows, m))
    blocks = stored(encoded.withColumn("at", F.col("block")).groupBy("at").cogroup(named.groupBy("at")).applyInArrow(rename, schema), "blocks", "uncompressed")
    drop_stored(spark, encoded)
    model = replace(model, **dict(zip(("hot", "hot_pairs"), hot_keys(blocks, model, n["all"], most), strict=True)))
    hots, pairs = len(model.hot) + 1, len(model.hot_pairs)

    packed = blocks.select("block", "texts", "tokens")
    counted = stored(_grouped(packed.mapInArrow(_pack(model, False), ROW), buckets, lambda at, rows, m=model: count_bucket(at, rows, m)), "counted", "uncompressed")
    below = Sums(counted)
    static = [np.zeros(len(GRID)), below.fit(1), below.fit(2)]
    pair_c, pair_t = below.pairs("pair", pairs)
    model = replace(model, pair_c=pair_c, pair_t=pair_t)
    rooted = stored(_grouped(counted.where("kind = 'first'"), model.word_buckets, lambda at, rows, m=model: first_root(at, rows, m)), "rooted", "uncompressed")
    links = rooted.where("kind = 'link'")
    above = Sums(rooted)
    (v, _), (c0, t0) = above.pairs("known", 1), above.pairs("root", 1)
    hot_c, hot_t = above.pairs("hot", hots)
    model = replace(model, words=int(v[0]), root=(int(c0[0]), int(t0[0])), hot_c=hot_c, hot_t=hot_t)
    state, root = counted.where("kind IN ('fixed', 'state')"), rooted
    rng = np.random.default_rng(seed)
    models: list[Model] = []
    tables: list[DataFrame] = []
    for i in range(burn_in + samples):
        keep = i - burn_in if i >= burn_in else None
        old = tables
        swept = stored(
            _grouped(state.unionByName(root.where("kind = 'reply'")), buckets, lambda at, rows, m=model, i=i, keep=keep: sweep_bucket(at, rows, m, np.random.default_rng([seed, i, at, 0]), keep)),
            "swept", "uncompressed",
        )
        below = Sums(swept)
        pair_t = pair_t + below.pairs("pair", pairs)[1]
        root = stored(
            _grouped(
                root.where("kind = 'root state'").unionByName(swept.where("kind = 'change'")), model.word_buckets, lambda at, rows, m=model, i=i,
                keep=keep: sweep_root(at, rows, m, np.random.default_rng([seed, i, at, 1]), keep)
            ),
            "root", "uncompressed",
        )
        above = Sums(root)
        (c0, t0), (hot_c, hot_t) = above.pairs("root", 1), above.pairs("hot", hots)
        fits = [
            strength_fit(c0, t0),
            static[1] + below.fit(1) + strength_fit(hot_c, hot_t),
            static[2] + below.fit(2) + strength_fit(pair_c, pair_t),
        ]
        model = replace(model, root=(int(c0[0]), int(t0[0])), hot_c=hot_c, hot_t=hot_t, pair_t=pair_t, strengths=strengths or tuple(draw_strength(rng, f) for f in fits))
        state, tables = swept.where("kind IN ('fixed', 'state')"), [swept, root]
        drop_stored(spark, *(old or [counted]))
        if keep is not None:
            models.append(model)
    answers = stored(_grouped(root.where("kind = 'root state'").unionByName(links), model.word_buckets, lambda at, rows, k=samples: answer_all(at, rows, k)), "answers", "uncompressed")
    drop_stored(spark, root, rooted)
    tokens = packed.mapInArrow(_pack(model, True), ROW)
    sums = _grouped(tokens.unionByName(state.where("kind = 'state'")).unionByName(answers), buckets, lambda at, rows, m=models: score_bucket(at, rows, m))

    def finish(texts: pa.Table, got: pa.Table) -> pa.Table:
        ids = texts.column("ids").combine_chunks()
        order = np.argsort(got.column("of").to_numpy())
        blobs = got.column("blob")
        return sum_block((ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten(), texts.column("texts")[0].as_py(), (blobs[int(i)].as_py() for i in order), "id", n["train"])

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = blocks.select(F.col("block").alias("at"), "ids", "texts").groupBy("at").cogroup(sums.select("at", "of", "blob").groupBy("at")).applyInArrow(finish, schema)
    return out.withColumnRenamed("id", id_col)
