"""Byte-level BPE ids of whole texts, and token counts by section.

A text is cut at white space into units, as the vocabulary's own pattern does
(a unit is an optional space with the run of other characters behind it, or a
run of white space); no token crosses a unit.  Each worker keeps the ids of the
units that it has met, so a unit is encoded once and texts are assembled by
array lookups.  The strings of the vocabulary's added tokens are cut out first
and have their own ids, so ids equal those of encoding the whole text at once.

``section_tokens`` attributes tokens to sections.  A whole text is encoded
once; byte spans follow from the tokens' lengths; an interval join by binary
search finds the sections that a token touches.  Rule for a token that crosses
a boundary: it counts for the section that holds most of its bytes, the
earliest of these on a tie.

Defined cases: a null or empty text has no tokens and one empty section;
sections are \\n-ended lines, the newline belonging to its line; rows are never
merged, so repeated rows each give their sections.  A very long text is encoded
whole by one task, which needs some 50 bytes for each of its words.  Extra
columns take no part, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units, and their characters, kept by a worker before it starts anew; a cache, without influence on results.
CACHE_UNITS, CACHE_CHARS = 300_000, 8_000_000
_UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space for Python but not for the vocabulary's pattern.
_ODD = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter by which such vocabularies write each byte: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks of byte strings, ids of added tokens) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters = _byte_letters()
    added = {t["content"]: t["id"] for t in data["added_tokens"]}
    odd = [t["content"] for t in data["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd or data["model"]["type"] != "BPE" or data["normalizer"] or data["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path}: only plain byte-level BPE is known, and added tokens taken literally")
    vocab = {k: v for k, v in data["model"]["vocab"].items() if k not in added}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in data["model"]["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: ids must follow the order of merges")
    return {bytes(letters[c] for c in k): v for k, v in vocab.items()}, added


class _Units(dict):
    """unit -> number; a new unit gets the next number and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks, self.added = read_vocabulary(path)
        self._bpe = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.newline = ranks[b"\n"]
        most = max([*ranks.values(), *self.added.values()])
        self.bytes_of = np.zeros(most + 1, np.int32)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.bytes_of[i] = len(token)
        self._type = np.uint16 if most < 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        self._units = _Units()
        self._ids = np.zeros(1 << 16, self._type)
        self._ends = np.zeros(1 << 16, np.int64)
        self._done = self._chars = 0

    def _whole(self, text: str) -> np.ndarray:
        """The ids of a text without the units kept: those with added tokens, or odd white space."""
        parts = self._cut.split(text) if self._cut else [text]
        return np.array([i for p in parts for i in ([self.added[p]] if p in self.added else self._bpe.encode_ordinary(p))], np.uint32)

    def _learn(self) -> None:
        """Encodes the new units, words together with newlines between."""
        new = self._units.new
        if not new:
            return
        solid = np.array([not u.isspace() for u in new])
        got = np.asarray(self._bpe.encode_to_numpy("\n".join(u for u, s in zip(new, solid, strict=True) if s)), np.int64)
        cuts = np.flatnonzero(got == self.newline)
        sizes = np.zeros(len(new), np.int64)
        if solid.any():
            sizes[solid] = np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1
            got = np.delete(got, cuts)
        spaces = [self._bpe.encode_ordinary(u) for u, s in zip(new, solid, strict=True) if not s]
        sizes[~solid] = [len(x) for x in spaces]
        total = int(sizes.sum())
        flat = np.zeros(total, np.int64)
        from_words = np.repeat(solid, sizes)
        flat[from_words] = got
        flat[~from_words] = [i for x in spaces for i in x]
        base = int(self._ends[self._done - 1]) if self._done else 0
        while base + total > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while self._done + len(new) > len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
        self._ids[base : base + total] = flat
        self._ends[self._done : self._done + len(new)] = base + np.cumsum(sizes)
        self._done += len(new)
        self._chars += sum(map(len, new))
        new.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds): text i has ids[bounds[i]:bounds[i + 1]]."""
        if self._done > CACHE_UNITS or self._chars > CACHE_CHARS:
            self._reset()
        number = self._units.__getitem__
        found, counts, odd = [], [], {}
        for i, t in enumerate(texts):
            if _ODD.search(t) or any(x in t for x in self.added):
                odd[i] = self._whole(t)
                counts.append(0)
                continue
            u = _UNIT.findall(t)
            found.append(np.fromiter(map(number, u), np.int64, len(u)))
            counts.append(len(u))
        self._learn()
        units = np.concatenate(found) if found else np.zeros(0, np.int64)
        end = self._ends[units]
        start = np.where(units > 0, self._ends[units - 1], 0)
        size = end - start
        ids = self._ids[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].astype(np.uint32)
        c = np.concatenate([[0], np.cumsum(size)])
        bounds = c[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        if odd:
            parts = [odd.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_groups(col: pa.Array, most_chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with about most_chars characters; a null is an empty text."""
    first, held, size = 0, [], 0
    for i in range(len(col)):
        t = col[i].as_py() or ""
        if held and size + len(t) > most_chars:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token span, whether the span crosses a boundary).

    Section i holds bytes bounds[i] .. bounds[i + 1] - 1.
    """
    a = np.searchsorted(bounds, starts, "right") - 1
    b = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = a != b
    for i in np.flatnonzero(crossing):
        s = np.arange(a[i], b[i] + 1)
        share = np.minimum(ends[i], bounds[s + 1]) - np.maximum(starts[i], bounds[s])
        a[i] = s[np.argmax(share)]
    return a, crossing


def section_tokens(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """For each line of each text: its number, byte span, tokens and those that cross a boundary.

    Blocks of lines come from one task, so no shuffle is needed.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for r0, texts in text_groups(b.column(1)):
                ids, bounds = enc.encode(texts)
                raw = [t.encode() for t in texts]
                sizes = np.array([len(x) for x in raw], np.int64)
                base = np.concatenate([[0], np.cumsum(sizes)])
                data = np.frombuffer(b"".join(raw), np.uint8)
                cuts = np.flatnonzero(data == 10) + 1
                # a section begins at a text's first byte and behind each newline that isn't its last byte
                begins = np.concatenate([base[:-1], cuts])
                row = np.concatenate([np.arange(len(texts)), np.searchsorted(base, cuts - 1, "right") - 1])
                fits = np.concatenate([np.ones(len(texts), bool), cuts < base[row[len(texts) :] + 1]])
                begins, row = begins[fits], row[fits]
                order = np.lexsort((begins, row))
                begins, row = begins[order], row[order]
                last = np.append(row[1:] != row[:-1], True)
                ends = np.append(begins[1:], 0)
                ends[last] = base[row[last] + 1]
                first_of = np.searchsorted(row, np.arange(len(texts) + 1))
                n_tokens, n_cross = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                e = np.cumsum(enc.bytes_of[ids], dtype=np.int64)
                s = e - enc.bytes_of[ids]
                if len(ids):
                    # spans of all texts follow one another, and so do their sections: one search for all
                    filled = ends > begins
                    at = np.flatnonzero(filled)
                    sec, crossing = attribute(s, e, np.append(begins[filled], base[-1]))
                    n_tokens[at] = np.bincount(sec, minlength=len(at))
                    n_cross[at] = np.bincount(sec[crossing], minlength=len(at))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row + r0)), *(pa.array(x) for x in (np.arange(len(row)) - first_of[row], begins - base[row], ends - base[row], n_tokens, n_cross))],
                    [id_col, "section", "start_byte", "end_byte", "n_tokens", "n_crossing"],
                )

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, section long, start_byte long, end_byte long, n_tokens long, n_crossing long"
    return df.select(F.col(id_col), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
