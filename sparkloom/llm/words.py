"""Vectorised word spans and rolling fingerprints over Arrow text columns.

Every function here works on one slice of an Arrow batch inside a Spark task.
Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes, so the text itself is
never copied into Python strings.  Fingerprints are polynomial sums modulo
2**64 passed through a bijective mixer; two independent ones give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds the memory of the numpy temporaries.
SLICE_BYTES = 500_000
#: Powers that a worker keeps; more, for very long texts, are worked out anew.
KEPT_POWERS = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.where(_SPACE, U64(0), _BYTE)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_LOWER = _PLAIN[_FOLD]
#: For letters and digits only, as passages are compared: everything else in ASCII parts words.
_PUNCT = np.zeros(256, bool)
_PUNCT[:128] = True
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_ALNUM = np.where(_PUNCT, U64(0), _BYTE)[_FOLD]
_R1, _R2, _R3 = (U64(int(x) | 1) for x in _rng.integers(2**62, 2**63, 3))
_powers: dict[int, np.ndarray] = {}


def powers(r: np.uint64, n: int) -> np.ndarray:
    """r**0 .. r**(n-1) modulo 2**64; kept up to KEPT_POWERS and grown on demand."""
    have = _powers.get(int(r))
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), r, U64)
        x[0] = 1
        have = np.cumprod(x, dtype=U64)
        if len(have) <= KEPT_POWERS:
            _powers[int(r)] = have
    return have[:n]


def inverse(r: np.uint64) -> np.uint64:
    return U64(pow(int(r), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """The words of some consecutive rows: offsets are bytes in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: row r has the words first[r] .. first[r + 1] - 1
    first: np.ndarray
    #: the value of each byte in a word's fingerprint, where it isn't the usual
    values: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A fingerprint of each word; with lower, A-Z count as a-z.

        Words are worked on by the stretch of bytes, so a very long text needs room
        for its words and not several times its bytes.
        """
        table = self.values if self.values is not None else _LOWER if lower else _PLAIN
        out = np.zeros(len(self.start), U64)
        i = 0
        while i < len(out):
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.start, a + SLICE_BYTES)))
            v = table[self.data[a : self.end[j - 1]]]
            s = self.start[i:j] - a
            seg = np.diff(np.append(s, len(v)))
            at = np.arange(len(v)) - np.repeat(s, seg)
            v *= powers(_R1, int(seg.max()))[at]
            out[i:j] = mix(np.add.reduceat(v, s) + (self.end[i:j] - self.start[i:j]).astype(U64) * U64(0x9E3779B97F4A7C15))
            i = j
        return out

    def joined(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """The words of a row with one space between, where keep is set."""
        a, b = self.first[row], self.first[row + 1]
        raw = self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().split()
        return b" ".join(raw if keep is None else [w for w, k in zip(raw, keep[a:b], strict=True) if k])


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return raw[lo:hi], offsets - lo


def split_words(data: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> Words:
    """The words of each row; with alnum, lower-cased runs of letters and digits."""
    values = _ALNUM if alnum else None
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64), values)
    solid = ~(_PUNCT if alnum else _SPACE)[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), values)


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``most`` bytes."""
    data, offsets = text_buffers(col)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def windows(h: np.ndarray, k: int, r: np.uint64 = _R2) -> np.ndarray:
    """A fingerprint of each k consecutive entries of h, at the index of the first."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(r, len(h)), out=p[1:])
    return mix((p[k:] - p[:n]) * powers(inverse(r), n))


def spans(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.uint64) -> np.ndarray:
    """Fingerprints of the entries a..b-1, from the sums that span_prefix() gives."""
    return mix((prefix[b] - prefix[a]) * powers(inverse(r), len(prefix))[a] + (b - a).astype(U64) * U64(0xD1342543DE82EF95))


def span_prefix(h: np.ndarray, r: np.uint64) -> np.ndarray:
    p = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(r, len(h)), out=p[1:])
    return p


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows at 0, 1, ... lie within one row."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(n + 1, np.int32)
    lens = np.diff(first)
    has = lens >= k
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, np.minimum(first[1:][has] - k + 1, n), -1)
    return np.cumsum(ok[:-1]) > 0


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of k that begins at one of starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + k, -1)
    return np.cumsum(d[:-1]) > 0


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive bounds."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return np.diff(c[bounds])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s), bool)
    eq = s[1:] == s[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    out = np.zeros(len(keys), bool)
    out[order] = same
    return out
