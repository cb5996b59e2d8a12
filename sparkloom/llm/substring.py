"""Substring dedup by seed and extend.

Seeds are winnowed k-word anchors: of each window of ``min_words`` words, the
anchor is the leftmost k-gram with the least fingerprint, so equal windows have
equal anchors at equal places, whatever documents they stand in.  One anchor
occurrence stands for a run of windows, and its *context* is what it can extend
to: the words from the first of these windows to the end of the last.

Extension works by meeting instead of by pairs, so that a group of n equal
passages costs n rows and not n * n:

1. anchors that occur once are dropped (a counting shuffle with map-side sums);
2. occurrences with the same context (128 bits) are one class; in a class of
   two or more, the whole context repeats;
3. where one anchor has several classes, one representative of each class is
   extended to both sides, window by window, and the windows meet by 128-bit
   fingerprints; those found in two classes repeat for all members;
4. the repeated windows of a document are merged into maximal repeats.

Defined cases: a null text has no words; texts under min_words can't repeat;
a repeat within one document counts; rows that repeat (the same id as well) are
occurrences of their own, and each such row is returned; ids may be null.  An
empty table gives an empty result.  Equal windows tie by their leftmost anchor.
A very long text is read whole by one task, which needs some 60 bytes a word.
Extra columns take no part, whatever their names; ``remove_repeats`` keeps them.

Seeds, windows and classes with many occurrences don't gather: their counts are
summed on the map side, and the rows of hot ones stay dealt out in each join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import stored, temporary
from .skew import join_unique

MIN_WORDS = 35
#: Words of an anchor.  Any window of MIN_WORDS has MIN_WORDS - SEED_WORDS + 1 of them.
SEED_WORDS = 12


def sliding_argmin(g: np.ndarray, w: int) -> np.ndarray:
    """For each i, the leftmost place of the least of g[i : i + w]."""
    at = np.arange(len(g))
    size = 1
    val = g
    while size < w:
        step = min(size, w - size)
        a, b = val[:-step], val[step:]
        right = b < a
        at = np.where(right, at[step:], at[:-step])
        val = np.where(right, b, a)
        size += step
    return at


def anchors(w: W.Words, min_words: int, k: int) -> dict[str, np.ndarray]:
    """Anchor occurrences: row, first and last window (in words of the row), seed and context."""
    none = np.zeros(0, np.int64)
    ok = W.inside(w.first, min_words)
    if not ok.any():
        return {"row": none, "lo": none, "hi": none, "seed": none, "c1": none, "c2": none}
    h = w.hashes()
    starts = np.flatnonzero(ok)
    at = sliding_argmin(W.windows(h, k), min_words - k + 1)[starts]
    row = w.row[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(starts)) - 1
    lo, hi, p = starts[i], starts[j], at[i]
    end = hi + min_words
    place = (p - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    c = [W.mix(W.spans(W.span_prefix(h, r), lo, end, r) + place) for r in (W._R2, W._R3)]
    base = w.first[row[i]]
    q = W.spans(W.span_prefix(h, W._R1), p, p + k, W._R1)
    return {"row": row[i], "lo": lo - base, "hi": hi - base, "seed": q.view(np.int64), "c1": c[0].view(np.int64), "c2": c[1].view(np.int64)}


def _anchor_rows(min_words: int, k: int, seeds_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text_hash = b.column(0), b.column(1)
            for r0, r1, data, offsets in W.slices(b.column(2)):
                a = anchors(W.split_words(data, offsets), min_words, k)
                if not len(a["row"]):
                    continue
                if seeds_only:
                    yield pa.RecordBatch.from_arrays([pa.array(a["seed"]), pa.array(a["c1"])], ["seed", "c1"])
                else:
                    pick = pa.array(a["row"] + r0)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pick), text_hash.take(pick), *(pa.array(a[c].astype(np.int32)) for c in ("lo", "hi")), *(pa.array(a[c]) for c in ("seed", "c1", "c2"))],
                        ["id", "th", "lo", "hi", "seed", "c1", "c2"],
                    )

    return run


def _window_rows(min_words: int):
    """Windows of the listed classes of each document, with 128-bit fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, bounds = lists.flatten(), lists.offsets.to_numpy()
            lo, hi, seed, c1, c2 = (flat.field(i).to_numpy() for i in range(5))
            for r0, r1, data, offsets in W.slices(b.column(0)):
                w = W.split_words(data, offsets)
                h = w.hashes()
                e0, e1 = bounds[r0] - bounds[0], bounds[r1] - bounds[0]
                base = np.repeat(w.first[:-1], np.diff(bounds[r0 : r1 + 1]))
                n = hi[e0:e1] - lo[e0:e1] + 1
                of = np.repeat(np.arange(e0, e1), n)
                off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                s = np.repeat(base + lo[e0:e1], n) + off
                f = [W.spans(W.span_prefix(h, r), s, s + min_words, r).view(np.int64) for r in (W._R2, W._R3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[0]), pa.array(f[1]), pa.array(seed[of]), pa.array(c1[of]), pa.array(c2[of]), pa.array(np.left_shift(np.int64(1), off.astype(np.int64)))],
                    ["w1", "w2", "seed", "c1", "c2", "bit"],
                )

    return run


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """(id, th, lo, mask): the window at word lo + b of a document repeats where bit b is set.

    th is xxhash64 of the text; with the id it names the document.
    """
    if not 0 <= min_words - seed_words < 63:
        raise ValueError("min_words - seed_words must be from 0 to 62")
    with temporary(df.sparkSession) as made:
        return made.keep(_repeated_windows(df, id_col, text, min_words, seed_words), "repeats")


def _repeated_windows(df: DataFrame, id_col: str, text: str, min_words: int, seed_words: int) -> DataFrame:
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    seeds = docs.mapInArrow(_anchor_rows(min_words, seed_words, True), "seed long, c1 long")
    seeds = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("c1").alias("least"), F.max("c1").alias("most"))
    seeds = stored(seeds.where("n > 1").select("seed", "n", (F.col("least") != F.col("most")).alias("several")), "seeds")
    found = docs.mapInArrow(_anchor_rows(min_words, seed_words, False), f"id {id_type}, th long, lo int, hi int, seed long, c1 long, c2 long")
    found = stored(join_unique(found, seeds, ["seed"], F.xxhash64("id", "th", "lo")), "anchors")

    classes = found.groupBy("seed", "c1", "c2").agg(
        F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("id", "th", "lo", "hi", "several"))
    )
    classes = stored(classes.where("n > 1 OR several"), "classes")
    to_extend = classes.where("several").groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi", "seed", "c1", "c2")).alias("at"))
    texts = docs.join(to_extend, [docs["id"].eqNullSafe(to_extend["id"]), docs["th"] == to_extend["th"]]).select("text", "at")
    wins = stored(texts.mapInArrow(_window_rows(min_words), "w1 long, w2 long, seed long, c1 long, c2 long, bit long"), "windows")
    twice = wins.groupBy("w1", "w2").agg(F.min("c1").alias("a"), F.max("c1").alias("b"), F.min("c2").alias("c"), F.max("c2").alias("d"), F.count(F.lit(1)).alias("n"))
    twice = stored(twice.where("a != b OR c != d").select("w1", "w2", "n"), "twice")
    masks = join_unique(wins, twice, ["w1", "w2"], F.xxhash64("seed", "c1", "c2", "bit")).groupBy("seed", "c1", "c2").agg(F.bit_or("bit").alias("part"))
    whole = F.expr("shiftleft(1L, hi - lo + 1) - 1L")
    masks = (
        classes.join(masks, ["seed", "c1", "c2"], "left")
        .select("seed", "c1", "c2", "n", F.when(F.col("n") > 1, whole).otherwise(F.col("part")).alias("mask"))
        .where("mask IS NOT NULL")
    )
    return join_unique(found, stored(masks, "masks"), ["seed", "c1", "c2"], F.xxhash64("id", "th", "lo")).groupBy("id", "th", "lo").agg(F.bit_or("mask").alias("mask"))


def _apply(min_words: int, width: int, id_name: str, want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(width, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            flat, bounds = lists.flatten(), lists.offsets.to_numpy()
            lo, mask = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            count = np.where(np.asarray(lists.is_null()), 0, np.diff(bounds))
            pos = np.concatenate([[0], np.cumsum(count)])
            n_words, n_removed, digest, texts = [], [], [], []
            for r0, r1, data, offsets in W.slices(b.column(0)):
                w = W.split_words(data, offsets)
                e0, e1 = pos[r0], pos[r1]
                base = np.repeat(w.first[:-1], count[r0:r1])
                on = (mask[e0:e1, None] >> bits) & 1 == 1
                s = ((base + lo[e0:e1])[:, None] + bits)[on]
                gone = W.covered(s, min_words, int(w.first[-1])) if len(s) else np.zeros(int(w.first[-1]), bool)
                removed = W.per_row(gone, w.first)
                n_words.append(np.diff(w.first))
                n_removed.append(removed)
                for r in range(w.rows):
                    a, z = w.first[r], w.first[r + 1]
                    if not want_text:
                        digest.append(hashlib.sha256(w.joined(r, ~gone if removed[r] else None)).hexdigest())
                    elif not removed[r]:
                        texts.append(None)
                    else:
                        g = np.flatnonzero(np.diff(np.concatenate([[1], gone[a:z].astype(np.int8), [1]])))
                        cut = [data[w.start[a + x] : (w.start[a + y] if a + y < z else offsets[r + 1])].tobytes() for x, y in zip(g[::2], g[1::2], strict=True)]
                        texts.append(b"".join(cut).decode())
            keep = [b.column(i) for i in range(2, b.num_columns)]
            names = b.schema.names[2:]
            out = pa.array(texts, pa.string()) if want_text else pa.array(digest, pa.string())
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), out], [*names, "n_words", "n_removed", "result"])

    return run


def _with_marks(df: DataFrame, id_col: str, text: str, min_words: int, seed_words: int, want_text: bool) -> DataFrame:
    marks = repeated_windows(df, id_col, text, min_words, seed_words)
    marks = marks.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "mask")).alias("marks"))
    left = df.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.col(text).cast("string").alias("_text"))
    both = left.join(marks, [left["_id"].eqNullSafe(marks["id"]), left["_th"] == marks["th"]], "left")
    carried = both.select("_text", "marks", *(["row"] if want_text else [F.col("_id").alias("id")]))
    kept_schema = f"row {left.schema['row'].dataType.simpleString()}" if want_text else f"id {left.schema['_id'].dataType.simpleString()}"
    return carried.mapInArrow(_apply(min_words, min_words - seed_words + 1, id_col, want_text), f"{kept_schema}, n_words long, n_removed long, result string")


def substring_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """For each row: words, removed words, and the SHA-256 of the kept words joined by one space."""
    got = _with_marks(df, id_col, text, min_words, seed_words, False)
    return got.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("result").alias("kept_sha256"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """The rows of df, with repeated passages cut out of the text; other texts stay as they are."""
    got = _with_marks(df, id_col, text, min_words, seed_words, True)
    new = F.coalesce(F.col("result"), F.col("row").getField(text))
    return got.select(*(new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns))
