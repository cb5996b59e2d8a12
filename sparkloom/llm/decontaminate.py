"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. An n-gram is a pair of words, next to each other or with one word between.
   Every n-gram of the test items is counted over all documents (in how many it
   occurs), with sums on the map side.
2. Each item seeds with the n-grams at its rarest places, as many of them as no
   match can do without (see below), so rarity saves work and loses nothing.
3. Seeds join documents to items; hits on near diagonals give one region, which
   holds every alignment of a match that goes through one of them.
4. The region is aligned with the item; the score is the Smith-Waterman score
   over that of the item with itself, from 0 to 1.  Pairs at ``MIN_SCORE`` or
   more are matches, and all such pairs are found.

Why no match is lost: an alignment of an item of L words that matches M words
with E edits scores 2 M - E; at a score of s or more, E <= 2 M - 2 s L.  If x of
the M - 1 gaps between matches hold at most one edit, E >= 2 (M - 1 - x), so
x >= s L - 1.  The two words around such a gap are an n-gram in both texts, and
each begins at another of the item's L - 1 places.  So of any L - ceil(s L - 1)
places at least one is the beginning of an n-gram that the document has.  As
E <= 2 L (1 - s), the alignment lies within that many words of the hit's
diagonal.

The items are broadcast where their n-grams number at most ``BROADCAST_GRAMS``
(checked by a count); with more, seeds meet documents in shuffled joins.  Both
give the same rows: an n-gram is counted once for each document row that has it,
and ``n_hits`` is the number of different pairs of a place in the document and a
seed's place in the item.

Words are lower-cased runs of letters and digits.  Defined cases: null or empty
texts match nothing; items of so few words that one of them would do for a match
(one or two words) have their whole sequence as the seed and match texts that
are nothing else; documents that repeat give a match each; ids may be null.  Of
places with equally rare n-grams the earlier is rarer.  A very long text is read
whole by one task, which needs some 100 bytes a word.  Extra columns take no
part, whatever their names; ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import stored
from .skew import join_dealt

MIN_SCORE = 0.5
BROADCAST_GRAMS = 1_000_000
#: Smith-Waterman scores; the seeds' guarantee is for these.
MATCH, MISMATCH, GAP = 2, -1, -1
_CELLS = 1_000_000


def short_items(min_score: float) -> int:
    """Items of up to so many words would match by a single word."""
    return int(1 / min_score + 1e-9)


def drift(length: int, min_score: float) -> int:
    """How many words an alignment of a match may be off a hit's diagonal, to either side."""
    return math.ceil(MATCH * length * (1 - min_score))


def grams(w: W.Words, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, row, place in the row) of each n-gram; a row of up to ``short`` words also has itself, at -1."""
    h, of = w.hashes(), w.row
    g, row, at = [], [], []
    for d in (1, 2):
        ok = np.flatnonzero(W.inside(w.first, d + 1))
        g.append(W.mix(h[ok] * W._R2 + h[ok + d]))
        row.append(of[ok])
        at.append(ok - w.first[of[ok]])
    size = np.diff(w.first)
    few = np.flatnonzero((size > 0) & (size <= short))
    if len(few):
        g.append(W.spans(W.span_prefix(h, W._R3), w.first[few], w.first[few + 1], W._R3))
        row.append(few)
        at.append(np.full(len(few), -1))
    return np.concatenate(g), np.concatenate(row), np.concatenate(at)


def _gram_rows(short: int):
    """(id, th, place, gram, n_words) of each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r0, _, data, offsets in W.slices(b.column(2)):
                w = W.split_words(data, offsets, alnum=True)
                g, row, at = grams(w, short)
                pick = pa.array(row + r0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pick), b.column(1).take(pick), pa.array(at), pa.array(g.view(np.int64)), pa.array(np.diff(w.first)[row])],
                    ["id", "th", "place", "gram", "n_words"]
                )

    return run


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, words): the hashes of each item's words."""
    for b in batches:
        for r0, r1, data, offsets in W.slices(b.column(2)):
            w = W.split_words(data, offsets, alnum=True)
            lists = pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(w.hashes().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(r0, r1 - r0), b.column(1).slice(r0, r1 - r0), lists], ["id", "th", "words"])


def _grams_of_rows(short: int):
    """Each n-gram of each row, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in W.slices(b.column(0)):
                g, row, _ = grams(W.split_words(data, offsets, alnum=True), short)
                order = np.lexsort((g, row))
                g, row = g[order], row[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64))], ["gram"])

    return run


def _member(table: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which g are in the sorted table, their places there)."""
    if not len(table):
        return np.zeros(len(g), bool), np.zeros(len(g), np.int64)
    i = np.searchsorted(table, g)
    i[i == len(table)] = 0
    return table[i] == g, i


def _count_known(table: np.ndarray, short: int):
    """In how many documents each n-gram of the table occurs, summed for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(table), np.int64)
        for b in batches:
            for _, _, data, offsets in W.slices(b.column(0)):
                g, row, _ = grams(W.split_words(data, offsets, alnum=True), short)
                hit, i = _member(table, g)
                once = np.unique(row[hit] * len(table) + i[hit])
                np.add.at(total, once % max(len(table), 1), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(table[at].view(np.int64)), pa.array(total[at])], ["gram", "df"])

    return run


def align(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of a word sequence against each row of regions (0 pads)."""
    n, width = regions.shape
    drop = np.arange(width) * -GAP
    prev = np.zeros((n, width + 1), np.int32)
    best = np.zeros(n, np.int32)
    for word in item:
        here = prev[:, :-1] + np.where(regions == word, MATCH, MISMATCH)
        np.maximum(here, prev[:, 1:] + GAP, out=here)
        np.maximum(here, 0, out=here)
        # a gap along the region: the best of all earlier places less the distance
        here = np.maximum.accumulate(here + drop, axis=1) - drop
        prev = np.concatenate([np.zeros((n, 1), np.int32), here.astype(np.int32)], axis=1)
        np.maximum(best, prev.max(axis=1), out=best)
    return best


def regions_of(diagonals: np.ndarray, length: int, slack: int) -> list[tuple[int, int]]:
    """Word ranges to align, from the diagonals of the seeds' hits; overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for d in np.unique(diagonals).tolist():
        a, b = d - slack, d + length + slack
        # joined up to twice the width, so that a text of repeats has regions of bounded size
        if out and a <= out[-1][0] + length + 2 * slack and b - out[-1][0] <= 2 * (length + 2 * slack):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def scores(h: np.ndarray, item: np.ndarray, tasks: list[tuple[int, int, int, int]]) -> dict[int, int]:
    """The best score of each owner; tasks are (owner, start of text, a, b) with a..b in words of h."""
    best: dict[int, int] = {}
    width = max((b - a for _, _, a, b in tasks), default=0)
    step = max(1, _CELLS // max(width, 1))
    for i in range(0, len(tasks), step):
        some = tasks[i : i + step]
        m = np.zeros((len(some), width), np.uint64)
        for k, (_, _, a, b) in enumerate(some):
            m[k, : b - a] = h[a:b]
        for (owner, *_), s in zip(some, align(item, m).tolist(), strict=True):
            best[owner] = max(best.get(owner, 0), s)
    return best


class Items:
    """The test items as they are broadcast."""

    def __init__(self, names: list, words: list[np.ndarray], seed: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(seed, kind="stable")
        self.names, self.words = names, words
        self.seed, self.item, self.place = seed[order], item[order], place[order]


def _match(shared, short: int, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = shared.value
        table, begin = np.unique(it.seed, return_index=True)
        count = np.diff(np.append(begin, len(it.seed)))
        for b in batches:
            for r0, _, data, offsets in W.slices(b.column(2)):
                w = W.split_words(data, offsets, alnum=True)
                g, row, at = grams(w, short)
                hit, i = _member(table, g)
                if not hit.any():
                    continue
                row, at, i = row[hit], at[hit], i[hit]
                # a seed may stand in several items
                each = np.repeat(np.arange(len(row)), count[i])
                k = begin[i][each] + np.arange(len(each)) - np.repeat(np.cumsum(count[i]) - count[i], count[i])
                item, place, at, row = it.item[k], it.place[k], at[each], row[each]
                h = w.hashes()
                order = np.lexsort((place, at, row, item))
                item, place, at, row = item[order], place[order], at[order], row[order]
                # both n-grams of a place may be the same
                new = np.ones(len(item), bool)
                new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1]) | (place[1:] != place[:-1])
                item, diagonal, row = item[new], (at - place)[new], row[new]
                cut = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (row[1:] != row[:-1])]))
                tasks: dict[int, list[tuple[int, int, int, int]]] = {}
                hits = {}
                for x, y in zip(cut, np.append(cut[1:], len(item)), strict=True):
                    r, m = int(row[x]), int(item[x])
                    lo, hi = int(w.first[r]), int(w.first[r + 1])
                    hits[m, r] = int(y - x)
                    for a, z in regions_of(diagonal[x:y], len(it.words[m]), drift(len(it.words[m]), min_score)):
                        tasks.setdefault(m, []).append((r, lo, max(lo, lo + a), min(hi, lo + z)))
                found = []
                for m, todo in tasks.items():
                    most = MATCH * len(it.words[m])
                    found += [(r, m, s / most, hits[m, r]) for r, s in scores(h, it.words[m], todo).items() if s >= min_score * most]
                if found:
                    r, m, s, c = zip(*found, strict=True)
                    pick = pa.array(np.array(r) + r0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pick), b.column(1).take(pick),
                            pa.array([it.names[x] for x in m], it.names.type if isinstance(it.names, pa.Array) else None), pa.array(s, pa.float64()),
                            pa.array(c, pa.int64())
                        ],
                        ["id", "th", "item", "score", "n_hits"]
                    )

    return run


def _align_pairs(min_score: float):
    """For rows (id, th, item, diagonals, text, item's text, n_hits): the alignment where hits come from joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, score = [], []
            for i in range(b.num_rows):
                one = [W.split_words(*W.text_buffers(b.column(c).slice(i, 1)), alnum=True) for c in (4, 5)]
                h, item = one[0].hashes(), one[1].hashes()
                d = b.column(3).slice(i, 1).flatten().to_numpy()
                todo = [(0, 0, max(0, a), min(len(h), z)) for a, z in regions_of(d, len(item), drift(len(item), min_score))]
                s = scores(h, item, todo).get(0, 0) / (MATCH * len(item))
                if s >= min_score:
                    found.append(i)
                    score.append(s)
            pick = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in range(3)), pa.array(score, pa.float64()), b.column(6).take(pick)], ["id", "th", "item", "score", "n_hits"])

    return run


def find_matches(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_score: float = MIN_SCORE, broadcast_grams: int = BROADCAST_GRAMS
) -> DataFrame:
    """(id, th, item, score, n_hits) of each document and item that match; th is xxhash64 of the text."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    tests = items.select(F.col(item_id).alias("id"), F.xxhash64(F.col(item_text)).alias("th"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    doc_type, item_type = docs.schema["id"].dataType.simpleString(), tests.schema["id"].dataType.simpleString()
    short = short_items(min_score)
    item_grams = tests.mapInArrow(_gram_rows(short), f"id {item_type}, th long, place long, gram long, n_words long").where(f"(n_words <= {short}) = (place < 0)")
    small = item_grams.limit(broadcast_grams + 1).count() <= broadcast_grams

    distinct = item_grams.select("gram").distinct()
    if small:
        table = np.sort(np.array([r.gram for r in distinct.collect()], np.int64).view(np.uint64))
        known = docs.select("text").mapInArrow(_count_known(table, short), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    else:
        doc_grams = docs.mapInArrow(_gram_rows(short), f"id {doc_type}, th long, place long, gram long, n_words long")
        # summed before the join, so that a common n-gram doesn't gather
        counts = docs.select("text").mapInArrow(_grams_of_rows(short), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        known = stored(counts.join(distinct, "gram"), "known")
    # places whose n-grams no document has are the rarest; they take part in the choice and give no seed
    ranked = item_grams.join(known, "gram", "left").na.fill(0, ["df"]).withColumn("weight", F.sum("df").over(Window.partitionBy("id", "th", "place")))
    rarest = Window.partitionBy("id", "th").orderBy("weight", "place")
    enough = F.col("n_words") - F.greatest(F.ceil(F.col("n_words") * min_score - 1 - 1e-9), F.lit(0))
    seeds = ranked.withColumn("k", F.dense_rank().over(rarest)).where((F.col("k") <= enough) & (F.col("df") > 0)).select("id", "th", "place", "gram").distinct()
    schema = f"id {doc_type}, th long, item {item_type}, score double, n_hits long"

    if small:
        rows = seeds.collect()
        seeding = {(r.id, r.th) for r in rows}
        # a number a word, of items with n-grams alone, so the bound on n-grams holds for these as well
        hashed = tests.mapInArrow(_hashed_words, f"id {item_type}, th long, words array<long>").where("size(words) > 0")
        words_of = {(r.id, r.th): np.array(r.words, np.int64).view(np.uint64) for r in hashed.collect() if (r.id, r.th) in seeding}
        names, words = list(words_of), list(words_of.values())
        number = {k: i for i, k in enumerate(names)}
        shared = spark.sparkContext.broadcast(
            Items(
                [k[0] for k in names], words, np.array([r.gram for r in rows], np.int64).view(np.uint64),
                np.array([number[r.id, r.th] for r in rows], np.int64), np.array([r.place for r in rows], np.int64)
            )
        )
        found = docs.mapInArrow(_match(shared, short, min_score), schema)
    else:
        seeds = stored(seeds.select(F.col("id").alias("item"), F.col("th").alias("item_th"), F.col("place").alias("at"), "gram"), "seeds")
        weights = stored(known.join(seeds.select("gram").distinct(), "gram"), "weights")
        hits = join_dealt(doc_grams.drop("n_words"), seeds, ["gram"], F.xxhash64("id", "th", "place"), weights, "df")
        # a text and an item of repeats have as many hits as places times places, but no more diagonals than places
        lines = hits.withColumn("diagonal", F.col("place") - F.col("at")).groupBy("id", "th", "item", "item_th", "diagonal").agg(F.count_distinct("place").alias("n"))
        pairs = lines.groupBy("id", "th", "item", "item_th").agg(F.collect_list("diagonal").alias("diagonals"), F.sum("n").alias("n_hits"))
        pairs = pairs.join(docs.select(F.col("id").alias("d"), F.col("th").alias("dt"), F.col("text").alias("dtext")), [F.col("id").eqNullSafe(F.col("d")), F.col("th") == F.col("dt")])
        pairs = pairs.join(tests.select(F.col("id").alias("i"), F.col("th").alias("it"), F.col("text").alias("itext")), [F.col("item").eqNullSafe(F.col("i")), F.col("item_th") == F.col("it")])
        found = pairs.select("id", "th", "item", "diagonals", "dtext", "itext", "n_hits").mapInArrow(_align_pairs(min_score), schema)
    return found


def contamination_report(df: DataFrame, items: DataFrame, id_col: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """The matches, one row for each document row and item."""
    return find_matches(df, items, id_col, item_id=item_id).select(F.col("id").alias(id_col), F.col("item").alias(item_id), "score", "n_hits")


def drop_contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that match no item."""
    gone = find_matches(df, items, id_col, text).select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    return df.join(gone, [df[id_col].eqNullSafe(gone["_id"]), F.xxhash64(df[text]) == gone["_th"]], "left_anti")
