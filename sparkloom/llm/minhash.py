"""MinHash near-dedup: one-permutation hashing, optimal densification, star candidates.

1. Each text's set of word shingles gives a one-permutation signature of
   BANDS * ROWS bins; an empty bin takes the value of the first filled bin on a
   probe sequence that depends on the bin alone (optimal densification).
2. Texts with equal sets (128-bit set fingerprints) are one class; from here on
   only one representative of each class takes part.
3. Bands of the signature are buckets.  A bucket's hub is its member that meets
   most others in all its buckets, and candidates are (member, hub) only, so a
   bucket of n texts gives n - 1 pairs.
4. Star candidates are confirmed on full sets.
5. Two members of a bucket can be alike while one of them isn't like the hub H.
   Let D(A) be the shingles that A and H don't share.  A and B differ in
   |D(A)| + |D(B)| - 2 |D(A) & D(B)| shingles, and are a link only if that is at
   most (100 - percent) / (100 + percent) of |A| + |B|.  As A isn't like H, they
   must share members of D, as many as this asks for.  So only the members that
   some other one has as well count, pairs are found by the rarest of these
   (as many as no link can do without), and are kept where the bound leaves room
   for a link.  Exactly these pairs are confirmed as well.  No member is
   dropped, and copies that differ from the hub by their own edits share none of
   them, so the pairs stay few.
6. Components of the confirmed links give the classes.

With 40 bands of 8 rows two sets at similarity 0.85 miss all common buckets
with a probability of about 3e-6, less where they are more alike.

Defined cases: a text of fewer words than a shingle has its whole sequence as
one; an empty or null text has no shingles, is linked with nothing and is kept.
Rows with a null id are linked with nothing and kept, their component is null.
Rows that repeat are one class; all rows that carry the class's least id are
kept by ``kept``; ``keep_one`` keeps a single row of each component, of equal
ids the one with the least hash of its text.  A very long text is read whole by
one task, which needs some 60 bytes a word.  Extra columns take no part,
whatever their names; ``keep_one`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import stored, temporary
from .skew import join_dealt, join_unique

SHINGLE = 5
BANDS, ROWS = 40, 8
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
_PROBES = 256
U64 = np.uint64


def shingle_sets(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bounds): the sorted distinct shingles of each row."""
    h = w.hashes(lower=True)
    n = np.diff(w.first)
    ok = np.flatnonzero(W.inside(w.first, k))
    row, g = w.row[ok], W.windows(h, k)[ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = W.spans(W.span_prefix(h, W._R3), w.first[short], w.first[short + 1], W._R3)
        row, g = np.concatenate([row, short]), np.concatenate([g, whole])
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], np.searchsorted(row[new], np.arange(w.rows + 1))


def signatures(g: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures; rows without shingles have the largest value everywhere."""
    rows = len(bounds) - 1
    most = U64(2**64 - 1)
    sig = np.full(rows * bins, most, U64)
    v = W.mix(g ^ U64(0xA5A5A5A55A5A5A5A))
    at = np.repeat(np.arange(rows), np.diff(bounds)) * bins + ((v >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    np.minimum.at(sig, at, W.mix(v) >> U64(1))
    sig = sig.reshape(rows, bins)
    filled = sig != most
    some = filled.any(axis=1)
    r, b = np.nonzero(~filled & some[:, None])
    for t in range(1, _PROBES + 1):
        if not len(r):
            break
        to = (W.mix(b.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(t)) % U64(bins)).astype(np.int64)
        hit = filled[r, to]
        sig[r[hit], b[hit]] = sig[r[hit], to[hit]]
        r, b = r[~hit], b[~hit]
    step = 1
    while len(r):  # few shingles: the first filled bin to the right of the last probe
        to = ((W.mix(b.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(_PROBES)) + U64(step)) % U64(bins)).astype(np.int64)
        hit = filled[r, to]
        sig[r[hit], b[hit]] = sig[r[hit], to[hit]]
        r, b, step = r[~hit], b[~hit], step + 1
    return sig


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r0, r1, data, offsets in W.slices(b.column(2)):
                g, bounds = shingle_sets(W.split_words(data, offsets), k)
                n = np.diff(bounds)
                f = []
                for salt in (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B):
                    c = np.zeros(len(g) + 1, U64)
                    np.cumsum(W.mix(g ^ U64(salt)), out=c[1:])
                    f.append(pa.array((c[bounds[1:]] - c[bounds[:-1]]).view(np.int64)))
                sig = signatures(g, bounds, bands * rows).reshape(len(n), bands, rows)
                key = np.zeros((len(n), bands), U64)
                for i in range(rows):
                    key = W.mix(key * U64(31) + sig[:, :, i])
                key = W.mix(key + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r0, r1 - r0), b.column(1).slice(r0, r1 - r0), pa.array(n.astype(np.int64)), *f, lists], ["id", "th", "n", "f1", "f2", "bands"])

    return run


def _compare(k: int, apart: bool):
    """For rows (a, b, text of a, text of b): set sizes and overlap, or the shingles that they don't share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                sets = []
                for c in (2, 3):
                    parts = [shingle_sets(W.split_words(data, offsets), k) for _, _, data, offsets in W.slices(b.column(c))]
                    sets.append([g[i:j] for g, bounds in parts for i, j in zip(bounds[:-1], bounds[1:], strict=True)])
                if apart:
                    lists = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(*sets, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int64()))], ["a", "b", "apart"])
                else:
                    both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([len(x) for x in v], pa.int64()) for v in sets), pa.array(both, pa.int64())], ["a", "b", "na", "nb", "both"])

    return run


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with both texts; b may be the hub of very many, whose text then goes to each of its parts."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    hubs = stored(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "hubs")
    return join_dealt(pairs.select("a", "b").join(ta, "a"), tb, ["b"], F.col("a"), hubs).select("a", "b", "ta", "tb")


def _linked(p: DataFrame, percent: int) -> F.Column:
    return F.lit(100) * p["both"] >= F.lit(percent) * (p["na"] + p["nb"] - p["both"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, th, n, component, label) for each row; th is xxhash64 of the text, label numbers the components."""
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    with temporary(df.sparkSession) as made:
        signed = stored(docs.mapInArrow(_sign(shingle, bands, rows), f"id {id_type}, th long, n long, f1 long, f2 long, bands array<long>"), "signed", "snappy")
        sets = made.keep(signed.select("id", "th", "n", "f1", "f2"), "sets")
        named = made.keep(_named_classes(docs, signed, shingle, percent), "named")
    out = join_unique(sets, named, ["f1", "f2", "n"], F.xxhash64("id", "th"), weight="copies", how="left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select("id", "th", "n", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"), F.when(~alone, F.col("label")).alias("label"))


def _named_classes(docs: DataFrame, signed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(f1, f2, n, component, label, copies) of each distinct set of shingles."""
    # one node for each distinct set
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.min_by("th", "id").alias("rep_th"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    of_node = classes.select(F.col("rep").alias("id"), F.col("rep_th").alias("th"), "node")
    keys = signed.select("id", "th", "bands").join(of_node, ["id", "th"]).select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("key", "size", F.col("size").alias("n"))
    met = stored(join_unique(keys, stored(shared, "shared"), ["key"], F.col("node")), "met")
    weight = met.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = met.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"), F.count(F.lit(1)).alias("n"))
    star = stored(join_unique(met, stored(hubs, "hubs"), ["key"], F.col("node")).where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "star")

    used = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    wanted = of_node.join(used, "node")
    texts = stored(docs.join(wanted, ["id", "th"]).select("node", "text").dropDuplicates(["node"]), "texts")
    compared = "a long, b long, na long, nb long, both long"
    checked = stored(_texts_of(star, texts).mapInArrow(_compare(shingle, False), compared), "checked")
    links = checked.where(_linked(checked, percent)).select("a", "b")
    label = components(links)

    # members of hubs that have members unlike them
    mixed = checked.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.bool_and(_linked(checked, percent)).alias("like")).where("NOT like").select("b", "n")
    group = join_unique(checked, stored(mixed, "mixed"), ["b"], F.col("a"))
    group = group.select("a", "b", "na", F.col("nb").alias("h"), (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("d"), _linked(group, percent).alias("near"))
    group = group.join(label.select(F.col("node").alias("a"), "label"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    group = stored(group, "group")
    apart = _texts_of(group, texts).mapInArrow(_compare(shingle, True), "a long, b long, apart array<long>")
    tokens = apart.select("a", "b", F.explode("apart").alias("token"))
    tokens = stored(tokens.join(group, ["a", "b"]), "apart")
    # what one member alone has joins nothing; those are most
    seen = tokens.groupBy("b", "token").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.bool_and("near").alias("all_near")).where("n > 1")
    seen = stored(seen.select("b", "token", "n", F.col("n").alias("rank"), F.expr("l0 != l1 AND NOT all_near").alias("joins")), "seen")
    tokens = join_unique(tokens, seen, ["b", "token"], F.col("a"))
    # v: the shingles apart from the hub that others have as well; a member unlike the hub is
    # a link only with those that share about half of what it has too many of
    v = Window.partitionBy("a", "b")
    tokens = tokens.withColumns({"v": F.count(F.lit(1)).over(v), "place": F.row_number().over(v.orderBy("rank", "token"))})
    least = f"greatest(1, CASE WHEN near THEN 1 ELSE CAST(ceil(({100 + percent} * d - {100 - percent} * (na + h)) / {2 * (100 + percent)}.0 - 1e-9) AS BIGINT) END)"
    tokens = stored(tokens.where(f"joins AND place <= v - {least} + 1").select("a", "b", "token", "na", "d", "v", "near", "label"), "tokens")
    one, two = (tokens.select("b", "token", *(F.col(c).alias(f"{c}{i}") for c in ("a", "na", "d", "v", "near", "label"))) for i in "12")
    room = f"{100 + percent} * (d1 + d2 - 2 * least(v1, v2)) <= {100 - percent} * (na1 + na2)"
    more = one.where("NOT near1").join(two, ["b", "token"]).where(f"label1 != label2 AND (near2 OR a1 < a2) AND {room}")
    more = stored(more.select(F.col("a1").alias("a"), F.col("a2").alias("b")).distinct(), "more")
    rechecked = _texts_of(more, texts).mapInArrow(_compare(shingle, False), compared)
    more_links = stored(rechecked.where(_linked(rechecked, percent)).select("a", "b"), "links")
    if more_links.limit(1).count():
        label = components(links.union(more_links))

    named = classes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("nodes"))
    return join_unique(named, stored(least, "components"), ["label"], F.col("node"), weight="nodes").select("f1", "f2", "n", "component", "label", "copies")


def near_duplicate_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """For each row: its set's size, the least id that its links reach, and whether that is its own."""
    got = near_duplicates(df, id_col, text, percent=percent)
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """df with one row of each component, that with the least id; rows without words or id all stay.

    Texts that share an id without being alike are documents of their own.
    """
    got = near_duplicates(df, id_col, text, percent=percent, bands=bands, rows=rows).where("label IS NOT NULL")
    best = got.groupBy("label").agg(F.min(F.struct("id", "th")).alias("best")).select("label", F.col("best.id").alias("_id"), F.col("best.th").alias("_th"))
    alone = F.col(id_col).isNull() | ~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    whole = df.select(F.struct("*").alias("row"), F.col(id_col).alias("_i"), F.xxhash64(F.col(text)).alias("_t"), alone.alias("_alone"))
    kept = whole.where("NOT _alone").join(best, [F.col("_i") == F.col("_id"), F.col("_t") == F.col("_th")])
    # rows that repeat in full leave one
    once = kept.groupBy("label").agg(F.first("row").alias("row")).select("row")
    return once.union(whole.where("_alone").select("row")).select("row.*")
