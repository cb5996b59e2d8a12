"""Quality rules as a short-circuit cascade.

Each rule is a vectorised predicate over a slice of texts that says which of
them it rejects.  Costs (seconds a text) and rejections are measured on a random
sample of the texts that pass the base rules, for that is what the cascade sees.
The sample's texts are counted by the set of rules that reject them, so the
order is greedy by what each rule still rejects behind those before it, per
cost.  Each rule sees only the texts that all earlier ones let pass; words and
code points are worked out once and handed on with the survivors.  The verdict
is a conjunction, so it doesn't depend on the order, which only decides the work.

Defined cases: a null or empty text has no words, fails the word floor and is
not kept.  Rows are never merged, so repeated rows and ids each get a row.  An
empty table gives an empty result.  Very long texts are judged whole; a slice
holds at least one text, so memory grows with the longest.  Extra columns take
no part, whatever their names.  Rules with equal gain keep their listed order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Texts, about, on which costs and rejections are measured.
SAMPLE_ROWS = 2000
#: Rules that a cascade can have: the sample is counted by the set of rules that reject a text.
MAX_RULES = 16
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_kinds: list[np.ndarray] = []
LETTER, UPPER, DIGIT = 1, 2, 4


def kinds() -> np.ndarray:
    """What each code point is: letters, upper-case letters and digits; worked out once a worker."""
    if not _kinds:
        points = [chr(i) for i in range(0x110000)]
        flags = (np.fromiter(map(f, points), bool, len(points)) for f in (str.isalpha, str.isupper, str.isdigit))
        _kinds.append(sum(f.astype(np.uint8) * np.uint8(bit) for f, bit in zip(flags, (LETTER, UPPER, DIGIT), strict=True)))
    return _kinds[0]


class Texts:
    """A slice of texts with what the rules need of them, each worked out when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: W.Words | None = None):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        self._words = words

    @cached_property
    def words(self) -> W.Words:
        return self._words if self._words is not None else W.split_words(self.data, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return W.per_row(~W._SPACE[self.data] & ((self.data & 0xC0) != 0x80), self.offsets)

    @cached_property
    def kind(self) -> np.ndarray:
        """The kind of each byte's code point at its first byte, 0 at the bytes that follow."""
        begins = (self.data & 0xC0) != 0x80
        out = np.zeros(len(self.data), np.uint8)
        out[begins] = kinds()[np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)]
        return out

    def count(self, kind: int) -> np.ndarray:
        return W.per_row((self.kind & kind) > 0, self.offsets)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte that isn't white space, end behind the last one, row) of each line with a word."""
        w = self.words
        start, _, row = line_spans(self.data, self.offsets)
        first = np.searchsorted(w.start, start)
        limit = np.append(first[1:], len(w.start))
        # a line's words are those from its own first to the next line's first
        has = limit > first
        return w.start[first[has]], w.end[limit[has] - 1], row[has]

    def subset(self, keep: np.ndarray) -> Texts:
        """The rows where keep is set, with their words."""
        size = np.diff(self.offsets)
        w = self.words
        of = w.row
        shift = (self.offsets[:-1] - (np.cumsum(np.where(keep, size, 0)) - np.where(keep, size, 0)))[of]
        on = keep[of]
        data, offsets = self.data[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])])
        first = np.concatenate([[0], np.cumsum(np.diff(w.first)[keep])])
        out = Texts(data, offsets, W.Words(data, offsets, (w.start - shift)[on], (w.end - shift)[on], first))
        if "kind" in self.__dict__:
            out.kind = self.kind[np.repeat(keep, size)]
        return out

    def prepare(self) -> None:
        """Works out all that several rules use."""
        _ = self.n_words, self.word_chars, self.kind, self.lines


@dataclass(frozen=True)
class Rule:
    """rejects(texts) gives a boolean for each text."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the \\n-split lines of each row."""
    cuts = np.flatnonzero(data == 10)
    row_of_cut = np.searchsorted(offsets, cuts, "right") - 1
    start = np.concatenate([offsets[:-1], cuts + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), row_of_cut])
    order = np.argsort(row, kind="stable")
    order = order[np.lexsort((start[order], row[order]))]
    start, row = start[order], row[order]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end = np.append(start[1:] - 1, 0) if len(row) else start
    end[last] = offsets[row[last] + 1]
    return start, end, row


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier line of the row) for each row."""
    n = len(offsets) - 1
    start, end, row = line_spans(data, offsets)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~W._SPACE[data], out=solid[1:])
    has = solid[end] > solid[start]
    start, end, row = start[has], end[has], row[has]
    total = np.bincount(row, minlength=n)
    if not len(row):
        return total, np.zeros(n, np.int64)
    v = W._BYTE[data]
    v *= W.powers(W._R3, int((offsets[1:] - offsets[:-1]).max()))[np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))]
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(v, out=p[1:])
    inv = W.powers(W.inverse(W._R3), int((offsets[1:] - offsets[:-1]).max()) + 1)
    h = W.mix((p[end] - p[start]) * inv[start - offsets[row]] + (end - start).astype(np.uint64))
    order = np.lexsort((h, row))
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    return total, total - np.bincount(row[order][first], minlength=n)


def repeat_words(w: W.Words, k: int = WINDOW) -> np.ndarray:
    """Words of each row in k-word windows found twice or more in the row."""
    ok = W.inside(w.first, k)
    if not ok.any():
        return np.zeros(w.rows, np.int64)
    at = np.flatnonzero(ok)
    h = W.windows(w.hashes(), k)[at]
    row = w.row[at]
    twice = at[W.repeated(W.mix(h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))]
    return W.per_row(W.covered(twice, k, int(w.first[-1])), w.first)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_stats(t: Texts) -> dict[str, np.ndarray]:
    """The base's figures of each text."""
    found = (t.n_words, t.word_chars, W.per_row(_SYMBOL[t.data], t.offsets), duplicate_lines(t.data, t.offsets)[1], repeat_words(t.words))
    return {k: v.astype(np.int64) for k, v in zip(BASE, found, strict=True)}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def many_symbols(t: Texts) -> np.ndarray:
    """More than a symbol for ten words."""
    return 10 * W.per_row(_SYMBOL[t.data], t.offsets) > t.n_words


def odd_word_length(t: Texts) -> np.ndarray:
    """Words of less than 2 or more than 15 characters on average."""
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)


def shouting(t: Texts) -> np.ndarray:
    """More than half of the letters are capitals."""
    return 2 * t.count(UPPER) > t.count(LETTER)


def few_letters(t: Texts) -> np.ndarray:
    """Less than half of the characters in words are letters."""
    return 2 * t.count(LETTER) < t.word_chars


def many_digits(t: Texts) -> np.ndarray:
    """More than three in ten characters in words are digits."""
    return 10 * t.count(DIGIT) > 3 * t.word_chars


def few_words_with_letters(t: Texts) -> np.ndarray:
    """Less than six in ten words have a letter."""
    w = t.words
    letters = np.concatenate([[0], np.cumsum((t.kind & LETTER) > 0)])
    return 10 * W.per_row(letters[w.end] > letters[w.start], w.first) < 6 * t.n_words


def repeated_lines(t: Texts) -> np.ndarray:
    """Three or more lines, and three in ten, that equal an earlier one."""
    total, dup = duplicate_lines(t.data, t.offsets)
    return (dup >= 3) & (10 * dup > 3 * total)


#: What a list's line begins with, and what a line that breaks off ends with, in UTF-8.
BULLETS = (b"-", b"*", "\u2022".encode(), "\u25cf".encode(), "\u25aa".encode())
BREAKS = (b"...", "\u2026".encode())


def _at(data: np.ndarray, place: np.ndarray, what: bytes) -> np.ndarray:
    ok = (place >= 0) & (place + len(what) <= len(data))
    for i, x in enumerate(what):
        ok[ok] = data[place[ok] + i] == x
    return ok


def list_lines(t: Texts) -> np.ndarray:
    """Five or more lines, nine in ten of which begin like those of a list."""
    start, _, row = t.lines
    n = np.bincount(row, minlength=t.rows)
    hit = np.logical_or.reduce([_at(t.data, start, b) for b in BULLETS])
    return (n >= 5) & (10 * np.bincount(row[hit], minlength=t.rows) > 9 * n)


def broken_lines(t: Texts) -> np.ndarray:
    """Three or more lines, and three in ten, that break off."""
    _, end, row = t.lines
    n = np.bincount(row, minlength=t.rows)
    hit = np.logical_or.reduce([_at(t.data, end - len(b), b) for b in BREAKS])
    broken = np.bincount(row[hit], minlength=t.rows)
    return (broken >= 3) & (10 * broken > 3 * n)


def one_word(t: Texts) -> np.ndarray:
    """One word makes three in ten words."""
    h, row = t.words.hashes(lower=True), t.words.row
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    most = np.zeros(t.rows, np.int64)
    np.maximum.at(most, row[new], np.diff(np.append(new, len(h))))
    return 10 * most > 3 * t.n_words


RULES: tuple[Rule, ...] = tuple(
    Rule(f.__name__, f) for f in (many_symbols, odd_word_length, shouting, few_letters, many_digits, few_words_with_letters, repeated_lines, list_lines, broken_lines, one_word)
)


@dataclass(frozen=True)
class Sample:
    """Seconds a text of each rule, and the sample's texts by the set of rules that reject them, as bits."""

    cost: dict[str, float]
    sets: dict[int, int]


def measure(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 8) -> Sample:
    """The rules' costs and rejections on about sample_rows random texts, wherever they stand in the table.

    One map-only pass; the driver gets a row for each rule and each set of rules.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"a cascade has at most {MAX_RULES} rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, sets, n = np.zeros(len(rules)), {}, 0
        for b in batches:
            for _, _, data, offsets in W.slices(b.column(0)):
                t = Texts(data, offsets)
                t = t.subset(~base_failed(base_stats(t)))
                if not t.rows:
                    continue
                n += t.rows
                # what rules share is charged to none of them, so that a rule costs the same wherever it stands
                t.prepare()
                bits = np.zeros(t.rows, np.int64)
                for i, r in enumerate(rules):
                    began = time.perf_counter()
                    gone = r.rejects(t)
                    seconds[i] += time.perf_counter() - began
                    bits |= gone.astype(np.int64) << i
                for k, c in zip(*np.unique(bits, return_counts=True), strict=True):
                    sets[int(k)] = sets.get(int(k), 0) + int(c)
        if n:
            yield pa.RecordBatch.from_pydict(
                {
                    "rule": pa.array([*range(len(rules)), *[-1] * len(sets)], pa.int64()), "bits": pa.array([*[-1] * len(rules), *sets], pa.int64()),
                    "x": pa.array([*seconds.tolist(), *map(float, sets.values())], pa.float64())
                }
            )

    rows = df.count()
    share = min(1.0, sample_rows / rows) if rows else 1.0
    got = df.select(F.col(text).cast("string").alias("t")).sample(share, seed).mapInArrow(run, "rule long, bits long, x double")
    sums = got.groupBy("rule", "bits").agg(F.sum("x").alias("x")).collect()  # at most a row for each rule and each set of rules in the sample
    sets = {r.bits: int(r.x) for r in sums if r.rule < 0}
    n = max(sum(sets.values()), 1)
    return Sample({rules[r.rule].name: r.x / n for r in sums if r.rule >= 0}, sets)


def ordered(rules: Sequence[Rule], sample: Sample) -> list[Rule]:
    """By what each rule rejects of what those before it let pass, per cost; greedy, best first."""
    left, passed, out = list(range(len(rules))), dict(sample.sets), []
    while left:
        gains = [sum(n for bits, n in passed.items() if bits >> i & 1) / max(sample.cost.get(rules[i].name, 1.0), 1e-12) for i in left]
        costs = [sample.cost.get(rules[i].name, 1.0) for i in left]
        # where nothing is rejected any more, cheap rules come first
        best = max(range(len(left)), key=lambda k: (gains[k], -costs[k], -k))
        i = left.pop(best)
        out.append(rules[i])
        passed = {bits: n for bits, n in passed.items() if not bits >> i & 1}
    return out


def cascade(t: Texts, rules: Sequence[Rule], alive: np.ndarray) -> np.ndarray:
    """Which texts of those alive pass all rules; each rule sees only survivors."""
    alive = alive.copy()
    at = np.flatnonzero(alive)
    if len(at) < t.rows:
        t = t.subset(alive)
    for r in rules:
        if not len(at):
            break
        gone = r.rejects(t)
        if gone.any():
            alive[at[gone]] = False
            at, t = at[~gone], t.subset(~gone)
    return alive


def quality_rules(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base figures, base verdict and the cascade's verdict for each row."""
    plan = ordered(rules, measure(df, rules, text, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r0, r1, data, offsets in W.slices(b.column(1)):
                t = Texts(data, offsets)
                s = base_stats(t)
                failed = base_failed(s)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(r0, r1 - r0), *(pa.array(s[k]) for k in BASE), pa.array(failed), pa.array(cascade(t, plan, ~failed))],
                    [id_col, *BASE, "base_failed", "kept"],
                )

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {', '.join(f'{k} long' for k in BASE)}, base_failed boolean, kept boolean"
    return df.select(F.col(id_col), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
