"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so a packing problem of any size
is a histogram of at most ``capacity`` counts.  Only that histogram comes to
the driver.  There a branch-and-bound search completes bins around the largest
length left: it enumerates undominated fillings, applies one as often as the
counts allow, and prunes a branch whose waste reaches that of the best packing
known.  The first incumbent is best-fit decreasing, worked on counts.  The
packing is a list of (lengths of a bin, how many such bins); pieces are then
dealt to bins by their rank among the pieces of their length, which Spark
computes from counts of each partition, without a global sort.

The search is bounded by its parameters: ``nodes`` states in all, ``branches``
fillings tried in each, and ``steps`` of enumeration for these.  A state that is
cut off by them only costs quality: the best packing known is always whole.

Defined cases: a null text is empty and gives one piece, the end id; rows that
repeat are packed each for itself; an empty table gives an empty result; of
packings with equally many bins the first found stays.  A very long text is
encoded whole by one task.  Extra columns take no part, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .tokens import default_vocabulary, encoder, text_groups

CAPACITY = 1024
END_ID = 2
#: States of the search, fillings tried at each, and steps to enumerate these: bounds of the driver's work.
NODES, BRANCHES, STEPS = 1500, 4, 600

Packing = list[tuple[tuple[int, ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing on counts: equal bins are handled together."""
    open_bins: dict[int, list[list]] = {}
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            room = min((r for r, g in open_bins.items() if r >= size and g), default=None)
            if room is None:
                each, have, content = capacity // size, None, ()
                room = capacity
            else:
                content, have = open_bins[room].pop()
                each = room // size
            bins = left // each if have is None else min(have, left // each)
            if bins:
                open_bins.setdefault(room - each * size, []).append([content + (size,) * each, bins])
                left -= bins * each
                if have is not None and have > bins:
                    open_bins.setdefault(room, []).append([content, have - bins])
            else:
                # fewer pieces than one bin takes
                open_bins.setdefault(room - left * size, []).append([content + (size,) * left, 1])
                if have is not None and have > 1:
                    open_bins.setdefault(room, []).append([content, have - 1])
                left = 0
    return [(tuple(c), n) for g in open_bins.values() for c, n in g if n]


def dominated(filling: tuple[int, ...], waste: int, counts: dict[int, int], sizes: list[int]) -> bool:
    """Whether one piece, or two, of a filling could be exchanged for a larger free piece that fits."""
    if not waste:
        return False
    used = {s: filling.count(s) for s in set(filling)}
    free = sorted(s for s in sizes if counts[s] > used.get(s, 0))
    parts = {*used, *(x + y for x in used for y in used if x < y), *(2 * x for x, n in used.items() if n > 1)}
    return any(i < len(free) and free[i] <= p + waste for p in parts for i in (bisect_right(free, p),))


def fillings(counts: dict[int, int], sizes: list[int], room: int, most: int, steps: int = STEPS) -> list[tuple[int, ...]]:
    """Undominated fillings of room, fullest first and among equals the fewest pieces.

    Sizes come in descending order, so large pieces are tried first; the search
    ends with ``most`` full fillings, or after a number of steps.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    todo: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    full = 0
    while todo and full < most and steps:
        steps -= 1
        i, left, taken = todo.pop()
        used = taken.count(sizes[i]) if i < len(sizes) else 0
        next_ = [(k, left - sizes[k], (*taken, sizes[k])) for k in range(i, len(sizes)) if sizes[k] <= left and (used if k == i else 0) < counts[sizes[k]]]
        if next_:
            # more than the steps left can't be looked at
            todo.extend(reversed(next_[:steps]))
        elif not dominated(taken, left, counts, sizes):
            found.append((left, taken))
            full += left == 0
    found.sort(key=lambda x: (x[0], len(x[1])))
    return list(dict.fromkeys(f for _, f in found))[:most]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, branches: int = BRANCHES, steps: int = STEPS) -> Packing:
    """Bins for all pieces: counts[length] pieces of each length."""
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    least = max(-(-total // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    left = nodes
    sizes = sorted(counts, reverse=True)
    stack: list[tuple[dict[int, int], int, int, Packing]] = [(counts, 0, 0, [])]
    while stack and left and fewest > least:
        left -= 1
        now, bins, waste, done = stack.pop()
        # bins * capacity = filled + waste: a branch must end with fewer bins than the best
        if waste > (fewest - 1) * capacity - total:
            continue
        live = [s for s in sizes if now.get(s)]
        if not live:
            best, fewest = done, bins
            continue
        if left % 50 == 0:
            tail = best_fit(now, capacity)
            if bins + sum(n for _, n in tail) < fewest:
                best, fewest = done + tail, bins + sum(n for _, n in tail)
        top = live[0]
        now[top] -= 1
        options = fillings(now, [s for s in live if now[s]], capacity - top, branches, steps)
        now[top] += 1
        for f in reversed(options):
            take: dict[int, int] = {top: 1}
            for s in f:
                take[s] = take.get(s, 0) + 1
            times = min(now[s] // k for s, k in take.items())
            after = dict(now)
            for s, k in take.items():
                after[s] -= k * times
            lost = capacity - top - sum(f)
            stack.append((after, bins + times, waste + lost * times, [*done, ((top, *f), times)]))
    return best


def pieces(df: DataFrame, id_col: str, text: str, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    """Pieces of each text's ids; part and nth number the pieces of a length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for r0, texts in text_groups(b.column(1)):
                ids, bounds = enc.encode(texts)
                row, number, start, size, crc = [], [], [], [], []
                raw = np.insert(ids, bounds[1:], end_id).astype("<u4").tobytes()
                begins = bounds[:-1] + np.arange(len(texts))
                for r, (a, n) in enumerate(zip(begins.tolist(), (np.diff(bounds) + 1).tolist(), strict=True)):
                    at, k = 0, 0
                    while at < n:
                        take = (n % capacity or capacity) if at == 0 else capacity
                        row.append(r0 + r)
                        number.append(k)
                        start.append(at)
                        size.append(take)
                        crc.append(zlib.crc32(raw[4 * (a + at) : 4 * (a + at + take)]))
                        at, k = at + take, k + 1
                length = np.array(size, np.int64)
                order = np.argsort(length, kind="stable")
                s = length[order]
                nth = np.empty(len(s), np.int64)
                nth[order] = np.arange(len(s)) - np.searchsorted(s, s) + seen[s]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length),
                        pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)
                    ],
                    ["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    schema = f"id {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return df.select(F.col(id_col), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None,
    nodes: int = NODES, branches: int = BRANCHES, steps: int = STEPS
) -> DataFrame:
    """Each piece with its sequence and its place there; the last three bound the search."""
    cut = stored(pieces(df, id_col, text, capacity, end_id, vocabulary or default_vocabulary()), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    packing = bin_completion(counts, capacity, nodes, branches, steps)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in packing:
        offset = 0
        for s in lengths:
            slots.setdefault(s, []).append((used.get(s, 0), sequence, offset))
            used[s] = used.get(s, 0) + times
            offset += s
        sequence += times
    # rows of the lookup: (length, first rank) -> sequence of that rank and offset; bounded by the capacity
    key = np.array([s for s in sorted(slots) for _ in slots[s]], np.int64)
    table = np.array([x for s in sorted(slots) for x in slots[s]], np.int64).reshape(-1, 3)
    first = np.searchsorted(key, np.arange(capacity + 2))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.zeros(len(length), np.int64)
            for s in np.unique(length):
                on = length == s
                at[on] = first[s] + np.searchsorted(table[first[s] : first[s + 1], 0], rank[on], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(table[at, 1] + rank - table[at, 0]), pa.array(table[at, 2])],
                [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)
