"""Document fingerprints: one-permutation MinHash with packed low-order bits, in DataFrame functions only.

1. A text's lower-cased words (``[^\\x20\\x09-\\x0D]+``) give shingles of five
   words, each hashed once; the upper bits of the hash name its bin.
2. The hashes are sorted together with one sentinel a bin, the largest value
   that the bin can hold.  The first value of each bin is then its minimum, or
   the sentinel where the bin is empty.
3. Optimal densification: an empty bin takes the value of the first filled bin
   on a sequence of probes that depends on the bin alone: ``PROBES`` drawn ones,
   and then all bins in the order of a hash of the two.
4. ``BITS`` low-order bits of a hash of each bin's value and number are packed
   into words of 64 bits; the number keeps bins apart that share a value, so that
   values of short texts can't agree in all bins by one chance.

Two fingerprints of BINS values agree by chance in one of 2**BITS places, so the
share m of places that agree estimates the similarity as (m - c) / (1 - c) with
c = 2**-BITS, cut at 0.  Its standard error is at most 0.024 with 512 bins of 4 bits.

Defined cases: a null text counts as empty; a text of fewer words than a shingle
has its whole sequence as one; a text without words has an empty fingerprint,
which is like another empty one by 1 and like any other by 0.  A very long text
is worked on by one task, whose arrays hold its words and hashes.  Extra columns
take no part, whatever their names.

``with_successor`` finds the next row by id without a global sort: quantiles of
the ids are bucket bounds, which are ids of the table, so the row that begins a
bucket is known by its id and is copied to the end of the bucket before.  Null
ids come first; rows that share an id are ordered by 52 bits of xxhash64 of the text; an id
with so many rows that it spans several buckets is cut by that hash as well.
Only rows equal in both stay together.  The driver sees the bounds alone.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
BINS, BITS = 512, 4
PROBES = 32
_BLANK = " \t\n\x0b\f\r"
#: Buckets of rows for each shuffle partition.
SPREAD = 4


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _probes(bins: int) -> list[int]:
    """PROBES draws for each bin, fixed by a seed."""
    return np.random.default_rng(bins).integers(0, bins, bins * PROBES).tolist()


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """df with the packed fingerprint of a text column, an array of 64-bit words.

    Bins are a power of two, and bits 1, 2, 4 or 8.  The steps are columns of
    their own that the next step names several times, so Catalyst keeps them
    apart and no lambda works one out again.
    """
    if bins & (bins - 1) or bits not in (1, 2, 4, 8) or bins * bits % 64:
        raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8, and both fill words of 64 bits")
    shift = 64 - bins.bit_length() + 1
    most, codes = (1 << shift) - 1, 64 // bits
    none = F.slice(F.array(F.lit(0).cast("long")), 1, 0)
    plain = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_BLANK))
    step = df.withColumn("_plain", plain)
    step = step.withColumn("_w", F.when(F.length("_plain") > 0, F.split("_plain", r"[ \t\n\x0B\f\r]+", -1)).otherwise(F.slice(F.array(F.lit("")), 1, 0))).drop("_plain")
    begins = F.slice("_w", 1, F.size("_w") - (shingle - 1))
    hashes = F.transform(begins, lambda x, i: F.xxhash64(x, *(F.get("_w", i + j) for j in range(1, shingle))))
    step = step.withColumn("_h", F.when(F.size("_w") >= shingle, hashes).when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(none)).drop("_w")
    # hashes are signed; a sequence over all 64 bits at once would overflow
    low, high = F.sequence(F.lit(most - (1 << 63)), F.lit(-1), F.lit(1 << shift)), F.sequence(F.lit(most), F.lit((1 << 63) - 1), F.lit(1 << shift))
    step = step.withColumn("_s", F.sort_array(F.concat("_h", low, high))).drop("_h")
    bin_of = lambda x: F.shiftright(x, shift)
    step = step.withColumn("_m", F.filter("_s", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get("_s", i - 1))))).drop("_s")
    step = step.withColumn("_d", F.transform("_m", lambda x: F.when(x.bitwiseAND(F.lit(most)) != most, x))).drop("_m")
    step = step.withColumn("_full", F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.get("_d", b).isNotNull()))
    table = _constant(_probes(bins), "array<int>")

    def code(x: Column, b: Column) -> Column:
        drawn = (F.get("_d", F.get(table, b * PROBES + t)) for t in range(PROBES))
        first = F.array_min(F.transform("_full", lambda f: F.xxhash64(b, f).bitwiseAND(F.lit(-bins)).bitwiseOR(f.cast("long"))))
        value = F.coalesce(x, *drawn, F.get("_d", first.bitwiseAND(F.lit(bins - 1)).cast("int")))
        return F.xxhash64(value, b).bitwiseAND(F.lit((1 << bits) - 1))

    step = step.withColumn("_f", F.when(F.size("_full") > 0, F.transform("_d", code)).otherwise(none)).drop("_d", "_full")
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(bins // codes - 1)),
        lambda j: F.aggregate(F.slice("_f", j * codes + 1, codes), F.lit(0).cast("long"), lambda a, c: F.shiftleft(a, bits).bitwiseOR(c))
    )
    return step.withColumn(out, F.when(F.size("_f") > 0, packed).otherwise(none)).drop("_f")


def hex_text(packed: str | Column) -> Column:
    """A fingerprint's bytes as lower-case hexadecimal digits."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: str, b: str, bins: int = BINS, bits: int = BITS) -> Column:
    """The similarity that two packed fingerprints show, corrected for chance, from 0 to 1."""
    ones = sum(1 << k for k in range(0, 64, bits))
    ones -= (ones >> 63) << 64  # as a signed number

    def differ(z: Column) -> Column:
        spread = z
        for k in range(1, bits):
            spread = spread.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(spread.bitwiseAND(F.lit(ones)))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0).cast("long"), lambda n, z: n + differ(z))
    c = 2.0**-bits
    shown = F.greatest(F.lit(0.0), ((F.lit(float(bins)) - apart) / bins - c) / (1 - c))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shown)


def _bounds(keyed: DataFrame, buckets: int) -> list[tuple[int, list[int]]]:
    """(id, hashes) of the rows that begin buckets; an id has several hashes where it spans several buckets."""
    shares = [i / buckets for i in range(1, buckets)]
    quantiles = F.percentile_approx("_k", shares, F.lit(max(10_000, 20 * buckets))) if shares else F.array().cast("array<long>")
    least, inner = keyed.agg(F.min("_k"), quantiles).first()
    if least is None:
        return [(0, [0])]
    times = Counter(inner or [])
    if any(abs(k) > 1 << 53 for k in times if k != -(1 << 63)):
        # quantiles are formed in doubles: the rows that begin buckets are looked up
        near = _constant(sorted({least, *times}), "array<bigint>")
        begin = keyed.groupBy(F.size(F.filter(near, lambda c: c <= F.col("_k"))).alias("_b")).agg(F.min("_k").alias("_k"))
        times = Counter({r["_k"]: times[r["_k"]] or 1 for r in begin.collect()})
    hot = {k: n for k, n in times.items() if n > 1}
    cuts: dict[int, list[int]] = {k: [] for k in {least, *times}}
    if hot:
        parts = max(hot.values())
        within = F.percentile_approx("_th", [i / parts for i in range(1, parts)], F.lit(max(10_000, 20 * parts)))
        for k, first, rest in keyed.where(F.col("_k").isin(*hot)).groupBy("_k").agg(F.min("_th"), within).collect():
            # as many cuts as the id has buckets
            cuts[k] = sorted({first, *rest[:: max(1, parts // hot[k])]})
    return sorted(cuts.items())


def with_successor(df: DataFrame, id_col: str, text: str, columns: dict[str, str], buckets: int | None = None) -> DataFrame:
    """df with columns of the next row by id under new names; the last row is followed by the first."""
    spark = df.sparkSession
    buckets = buckets or SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = {"_k": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_th": F.shiftright(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 12)}
    bounds = _bounds(df.select(*(c.alias(k) for k, c in keys.items())), buckets)
    ids = [k for k, _ in bounds]
    # two short searches instead of a long one
    width = max(1, int(len(ids) ** 0.5))
    groups = _constant([ids[i : i + width] for i in range(0, len(ids), width)], "array<array<bigint>>")
    firsts, hashes = _constant(ids[::width], "array<bigint>"), _constant([h for _, h in bounds], "array<array<bigint>>")
    sizes = np.array([max(1, len(h)) for _, h in bounds])
    starts, total = _constant((np.cumsum(sizes) - sizes).tolist(), "array<int>"), int(sizes.sum())
    rows = df.withColumns(keys)
    rows = rows.withColumn("_g", F.size(F.filter(firsts, lambda c: c <= F.col("_k"))) - 1)
    rows = rows.withColumn("_i", F.col("_g") * width + F.size(F.filter(F.get(groups, F.col("_g")), lambda c: c <= F.col("_k"))) - 1)
    rows = rows.withColumn("_at", F.get(_constant(ids, "array<bigint>"), F.col("_i")) == F.col("_k")).withColumn("_cut", F.get(hashes, F.col("_i")))
    inside = F.greatest(F.size(F.filter("_cut", lambda c: ~F.col("_at") | (c <= F.col("_th")))) - 1, F.lit(0))
    rows = rows.withColumn("_b", F.get(starts, F.col("_i")) + inside)
    begins = F.col("_at") & ((F.size("_cut") == 0) | F.array_contains("_cut", F.col("_th")))
    here = F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy"))
    before = F.struct(F.pmod(F.col("_b") - 1, F.lit(total)).alias("b"), F.lit(True).alias("copy"))
    dealt = rows.withColumn("_to", F.explode(F.when(begins, F.array(here, before)).otherwise(F.array(here)))).drop("_g", "_i", "_at", "_cut", "_b")
    order = Window.partitionBy("_to.b").orderBy("_to.copy", "_k", "_th", text)
    return dealt.withColumns({new: F.lead(old).over(order) for old, new in columns.items()}).where("NOT _to.copy").drop("_to", "_k", "_th")


def fingerprint_report(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, and that of the text whose last quarter is replaced by the next document's beginning."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = with_fingerprint(docs, "text", "own")
    both = with_successor(own, "id", "text", {"text": "after", "own": "next"})
    both = both.withColumn("n", F.length("text").cast("long"))
    quarter = F.expr("CAST(n DIV 4 AS INT)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - quarter), F.substring("after", F.lit(1), quarter))
    both = both.select("id", "n", "own", "next", edited.alias("edited"))
    both = with_fingerprint(both, "edited", "changed")
    return both.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hex_text("own").alias("fingerprint"), hex_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next").alias("near_next")
    )
