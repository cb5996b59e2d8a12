"""Source divergence audit: how far the terms of each source lie from those of others in its language.

1. Partitions count their terms by language and source, with the documents that
   hold them: the terms of many rows are numbered and sorted as whole numbers, so
   a count costs some 40 bytes and is handed on once.  Counts are dealt by language
   and term, so that they are summed by source, and then pivoted, without another
   shuffle: one row for a term of a language, with a map from sources to counts.
2. Terms in at least ``MIN_DOCS`` documents of a language stay.  A layout row for
   each language holds its sources in order, their totals and the number of terms.
3. Terms meet their layout on the language and a salt, so a language with most
   terms is dealt out; Spark broadcasts the layout only where its size allows.
4. With its layout a term's map becomes a wide vector, one share for each source.
   A vector gives a row for each source and ``BLOCK`` others, whose contributions
   are worked out inside the sums; these are combined on the map side, so a task
   sends each pair once.
5. The terms that a source has most in excess of its language are the first 200
   by value, for which Spark keeps 200 a group before it shuffles.

Arithmetic is in whole numbers: shares are in thousand-millionths, rounded down,
and a contribution is (p - q)**2 / q, rounded down.

Defined cases: null text, language and source count as ''; a language without
kept terms has pairs of value 0; a language with one source has no pairs.  Rows
that repeat count as often as they stand.  A result holds all pairs of a
language's sources, so its rows grow with their square; vectors hold a number
for each source.  Empty tables give an empty result.  A very long text is
counted whole by one task.  Extra columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored, temporary
from .words import SLICE_BYTES, slices

MIN_DOCS = 3
#: The thousand-millionths in which shares are counted, and what is added to each count.
SCALE, PRIOR = 1_000_000_000, 1
#: Ranks of a source's terms that are reported.
TERM_RANKS = 200
#: Bytes of terms, and of the numbers kept for them, that a partition holds at most before it hands on their counts; counting takes some twice as much besides.
MAX_HELD = 1 << 27
#: Pairs whose contributions one row of the sums holds.
BLOCK = 16

#: What becomes of a byte: letters and bytes over 0x7F stay, A-Z are lower-cased, the rest parts terms.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of some consecutive rows: their bytes end to end, their lengths, and how many each row has."""
    low = _FOLD[data]
    solid = low != 32
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(low))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begins)
    return low[solid], (np.flatnonzero(ends) + 1 - start).astype(np.int32), np.diff(np.searchsorted(start, offsets))


def _summed(data: np.ndarray, lengths: np.ndarray, each: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of each term of a group; ``each`` and ``group`` are a row's."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    terms = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    each, group = each[each > 0], group[each > 0]
    own, group = np.unique(group, return_inverse=True)
    rows = len(group)
    # term, group and row as one number: MAX_HELD keeps the product of their counts under 2**62, and a text beyond it stands alone
    key = terms.indices.to_numpy().astype(np.int64)
    key *= len(own)
    key += np.repeat(group, each)
    key *= rows
    key += np.repeat(np.arange(rows), each)
    key.sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    key //= rows
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    term, of = np.divmod(key[at], len(own))
    return own[of], terms.dictionary.take(pa.array(term)).cast(pa.string()), np.diff(np.append(at, len(key))), np.add.reduceat(fresh, at, dtype=np.int64)


def _count(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def handed() -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            if parts and len(parts[1]):
                group, terms, n, docs = _summed(*parts)
                langs, sources = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(group)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

        for b in batches:
            of = np.array([groups.setdefault(g, len(groups)) for g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.int64)
            for i, j, data, offsets in slices(b.column(2), min(most, SLICE_BYTES)):
                found = terms_of(data, offsets)
                more = len(found[0]) + 24 * len(found[1]) + 64 * (j - i)
                if held and size + more > most:
                    yield from handed()
                    size = 0
                held.append((*found, of[i:j]))
                size += more
        yield from handed()

    return run


def term_counts(df: DataFrame, max_held: int = MAX_HELD) -> DataFrame:
    """(lang, term, docs, by): of each term of a language its documents, and a map from sources to occurrences."""
    found = df.select("lang", "source", "text").mapInArrow(_count(max_held), "lang string, source string, term string, n long, docs long")
    # a partition has summed its counts already: no sums before the shuffle, and one shuffle for both groupings
    of_source = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return of_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by"))


def layouts(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, sources, totals, total, terms): a row for each language, sources in order."""
    n = terms.select("lang", F.explode("by").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    full = groups.join(n, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    rows = full.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"), F.sum("n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    return rows.join(kept, "lang", "left").select("lang", F.col("g.source").alias("sources"), F.col("g.n").alias("totals"), "total", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))


def share(count: Column, total: Column, terms: Column, scale: int = SCALE, prior: int = PRIOR) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * terms)), exactly: beyond 64 bits in decimals of 38 digits."""
    most = ((1 << 63) - 1) // scale - prior
    all_of = total + prior * terms
    wide = F.call_function("div", F.lit(scale).cast("decimal(12,0)") * (count + prior).cast("decimal(19,0)"), all_of.cast("decimal(19,0)"))
    return F.when(count <= most, F.call_function("div", F.lit(scale).cast("long") * (count + prior), all_of)).otherwise(wide) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and the terms that a source has in excess."""
    docs = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    spark = df.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with temporary(spark) as made:
        terms = stored(term_counts(docs).where(F.col("docs") >= min_docs), "terms")
        groups = docs.select("lang", "source").distinct()
        layout = made.keep(layouts(groups, terms), "layouts")
        salted = layout.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        wide = terms.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"])
        counts = F.transform("sources", lambda s: F.coalesce(F.element_at("by", s), F.lit(0).cast("long")))
        wide = wide.withColumn("counts", counts)
        shares = F.transform(F.arrays_zip("counts", "totals"), lambda x: share(x["counts"], x["totals"], F.col("terms")))
        all_of = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        wide = wide.withColumn("p", shares).withColumn("q", share(all_of, F.col("total"), F.col("terms")))
        wide = made.keep(wide.select("lang", "term", "sources", "counts", "p", "q"), "vectors")
    # a row for each source and block of others, whose contributions are summed side by side
    rows = wide.select("lang", "p", F.posexplode("p").alias("i", "own")).select("lang", "i", "own", "p", F.explode(F.sequence(F.lit(0), F.call_function("div", F.size("p") - 1, F.lit(BLOCK)).cast("int"))).alias("b"))
    sums = rows.groupBy("lang", "i", "b").agg(*(F.sum(_gap(F.col("own"), F.get("p", F.col("b") * BLOCK + k))).alias(f"s{k}") for k in range(BLOCK)))
    sums = sums.select("lang", "i", "b", F.posexplode(F.array(*(f"s{k}" for k in range(BLOCK)))).alias("k", "value")).select("lang", "i", (F.col("b") * BLOCK + F.col("k")).alias("j"), "value")
    named = layout.select("lang", F.posexplode("sources").alias("i", "source"), "sources").select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i != j")
    pairs = named.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    each = wide.select("lang", "term", "q", "sources", "counts", F.posexplode("p").alias("i", "own")).where((F.col("own") > F.col("q")) & (F.get("counts", "i") > 0))
    most = each.select("lang", F.get("sources", "i").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("own"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [d.withColumn("rank", F.row_number().over(order)) for d in (pairs, most)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= ranks))
