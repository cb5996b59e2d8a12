"""Divergence, resampling and fingerprints against plain versions, on awkward documents and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import divergence, fingerprint, importance

from .helpers import SCHEMA, corpus, frame, lower, prose, words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return corpus() + [(2000, " ".join(prose(rng, 30_000, 5_000))), (2001, "ÀB cd\x00EF x1y É"), (2002, "Ab-aB ab")]


@pytest.fixture(scope="module")
def lettered(rows):
    """Terms have no digits: the same texts with letters in their place."""
    return [(i, t and t.translate(str.maketrans("0123456789", "abcdefghij"))) for i, t in rows]


def labelled(rows):
    """(lang, source, text) as helpers.frame sets them, with sources of the test's own."""
    return [(("aa" if i % 2 else "bb") if i is not None and i % 9 else "", f"s{i % 4}" if i is not None and i % 5 else "", t or "") for i, t in rows]


def plain_divergence(docs):
    """Part -> rows, by the contract's words."""
    count, holds = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        count[lang, source].update(terms)
        holds[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in count}:
        kept = [t for t, n in holds[lang].items() if n >= 3]
        of = {s: count[g, s] for g, s in count if g == lang}
        whole = sum(of.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))

        shares = {s: {t: p(c, t) for t in kept} for s, c in of.items()}
        of_lang = {t: p(whole, t) for t in kept}
        for s in of:
            pairs = [(o, sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept)) for o in of if o != s]
            most = [(t, (shares[s][t] - of_lang[t]) ** 2 // of_lang[t]) for t in kept if of[s][t] and shares[s][t] > of_lang[t]]
            for part, items, limit in (("pair", pairs, 10**9), ("term", most, 200)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items[:limit])]
    return out


def test_divergence(spark, lettered):
    docs = labelled(lettered)
    df = frame(spark, lettered).withColumn("source", F.when(F.expr("doc_id % 5 <> 0"), F.concat(F.lit("s"), F.expr("doc_id % 4"))))
    got = [tuple(r) for r in divergence.divergence(df).collect()]
    assert Counter(got) == Counter(plain_divergence(docs))
    assert divergence.divergence(df).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_language_without_kept_terms_has_pairs_of_value_0(spark):
    df = spark.createDataFrame([("x", "a", "one"), ("x", "b", "two"), ("y", "a", None)], "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.divergence(df).collect()) == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]


def test_counts_don_t_depend_on_what_a_partition_may_hold(spark, lettered):
    df = frame(spark, lettered).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    a, b = ({(r.lang, r.term): (r.docs, r.by) for r in divergence.term_counts(df, n).collect()} for n in (3, 10**6))
    assert a == b and len(a) > 100


def counted(rows, most):
    """What a partition of (lang, source, text) hands on, and in how many rows."""
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["lang", "source", "text"])
    got = [tuple(r.values()) for b in divergence._count(most)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    n, docs = Counter(), Counter()
    for *key, k, d in got:
        n[tuple(key)] += k
        docs[tuple(key)] += d
    return n, docs, len(got)


def test_a_partition_hands_on_each_count_once():
    """Many counts in a partition: each used to be handed on again and again, for Spark to sum."""
    terms = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(210_000)]
    rows = [("x", "a", " ".join(terms)), ("x", "a", " ".join(terms[::-1]))]
    n, docs, handed = counted(rows, divergence.term_counts.__defaults__[0])
    assert handed == len(n) == 210_000 and set(n.values()) == set(docs.values()) == {2}


def test_counts_are_shuffled_once(spark, lettered):
    df = frame(spark, lettered)
    before, after = (d._jdf.queryExecution().executedPlan().toString().count("Exchange ") for d in (df, divergence.term_counts(df)))
    assert after - before == 1


@pytest.mark.parametrize("most", [1, 500, 1 << 27])
def test_counts_of_a_partition_against_plain_ones(most):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB \n0@[`{\x7fé漢\x00") for _ in range(rng.choice((0, 1, 2, 9, 40)))) for _ in range(400)] + ["", "ab", "AB", "", "ab " * 1000]
    rows = [(rng.choice(("", "x", "y")), rng.choice(("", "a", "b")), t) for t in texts]
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        n.update({(lang, source, t): k for t, k in found.items()})
        docs.update({(lang, source, t): 1 for t in found})
    assert counted(rows, most)[:2] == (n, docs)
    assert counted([("x", "a", ""), ("x", "a", " 1")], most)[2] == 0


def test_divergence_against_its_sql(spark, sf):
    import duckdb

    from sparkloom.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = con.execute(SQL["op11_source_divergence"])
    cols = [c[0] for c in got.description]
    want = got.fetchall()
    assert want and Counter(want) == Counter(tuple(r[c] for c in cols) for r in QUERIES["op11_source_divergence"](spark, sf).collect())


def plain_resample(rows, target, length, buckets=10_000, percent=10, least=20):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return w, [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, length + 1) if i + k <= len(w)]

    def totals(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])

    s, t = totals(x for _, x in rows), totals(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        w, f = features(x)
        weight = sum(gain[zlib.crc32(y.encode()) % buckets] for y in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("length, most", [(1, 200_000), (3, 50)])
def test_resample(spark, rows, length, most):
    rows = [(i, t) for i, t in rows if i not in (7, 8)] + [(i + 5000, t) for i, t in rows if i is not None]
    target = ["w1x w2x", None, "", "tiny Été", "w7x w8x w9x"]
    got = importance.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), length=length, max_nodes=most)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_resample(rows, [t or "" for t in target], length))


def test_resample_of_nothing(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert importance.resample(none, none).count() == 0
    got = importance.resample(frame(spark, rows[:3]), none, min_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]


def xxh(seed, *values):
    """xxhash64 as Spark chains it, signed."""
    for v in values:
        raw = v if isinstance(v, bytes) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_fingerprint(text):
    bins, shift = fingerprint.BINS, 64 - fingerprint.BINS.bit_length() + 1
    w = [x.encode() for x in words((text or "").lower())]
    if not w:
        return []
    least = {}
    for s in [w[i : i + 5] for i in range(len(w) - 4)] or [w]:
        h = xxh(42, *s)
        b = (h >> shift) + bins // 2
        least[b] = min(h, least.get(b, h))
    probes, out = fingerprint._probes(bins), []
    for b in range(bins):
        to = next((x for x in [b, *probes[b * fingerprint.PROBES : (b + 1) * fingerprint.PROBES]] if x in least), None)
        if to is None:
            to = min((xxh(42, (b, 4), (f, 4)) & -bins) | f for f in least) & (bins - 1)
        out.append(xxh(42, (least[to], 8), (b, 4)) & 15)
    return out


def alike(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    m = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return max(0.0, (m - 1 / 16) / (1 - 1 / 16))


def in_order(rows):
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (-(2**63) if r[0] is None else r[0], xxh(42, r[1].encode()) >> 12, r[1].encode()))


def test_fingerprints(spark, rows):
    docs = in_order(rows)
    want = []
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, e, n = (plain_fingerprint(x) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:x}" for x in a), "".join(f"{x:x}" for x in e), round(alike(a, e), 9), round(alike(a, n), 9)))
    got = fingerprint.fingerprint_report(frame(spark, rows)).collect()
    assert Counter((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == Counter(want)
    assert fingerprint.fingerprint_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_likeness_is_near_the_sets_own(spark):
    rng = random.Random(9)
    base = prose(rng, 300, 10**6)
    texts = {k: " ".join(base[: 300 - k] + prose(rng, k, 10**6)) for k in (0, 10, 40, 100, 150, 300)}
    both = spark.createDataFrame([(k, texts[0], t) for k, t in texts.items()], "k int, a string, b string")
    both = fingerprint.with_fingerprint(fingerprint.with_fingerprint(both, "a", "x"), "b", "y")
    for r in both.select("k", fingerprint.likeness("x", "y").alias("near")).collect():
        kept = max(0, 296 - r.k)
        assert abs(r.near - kept / (2 * 296 - kept)) < 0.1
        assert r.k or r.near == 1.0


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
def test_successors_with_hot_ids(spark, buckets):
    rng = random.Random(buckets)
    ids = [None] * 40 + [7] * 60 + [rng.randrange(-50, 50) for _ in range(60)]
    rows = [(i, f"text {k % 90}") for k, i in enumerate(ids)]
    docs = in_order(rows)
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = fingerprint.with_successor(df, "id", "text", {"text": "after"}, buckets)
    want = [(i, t, after) for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True)]
    assert Counter((-(2**63) if r.id is None else r.id, r.text, r.after) for r in got.collect()) == Counter((-(2**63) if i is None else i, t, a) for i, t, a in want)


def test_successors_with_ids_that_doubles_can_t_hold(spark):
    ids = [2**60 + 3 * k for k in range(200)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").repartition(3)
    got = {r.id: r.after for r in fingerprint.with_successor(df, "id", "text", {"id": "after"}, 9).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_the_main_path_is_native(spark, sf):
    from sparkloom.llm.queries import QUERIES

    plan = QUERIES["op13_fingerprints"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("percent, bands, rows", [(85, 40, 8), (80, 50, 6)])
def test_recall_of_near_duplicates_by_similarity(spark, percent, bands, rows):
    """Planted pairs with similarities around the threshold: all at or above it are linked, none below."""
    from sparkloom.llm.minhash import near_duplicates

    rng, docs, pairs = random.Random(12), [], []
    fresh = lambda: f"t{rng.randrange(10**7)}"
    for k in range(80):
        w = [fresh() for _ in range(rng.choice([60, 150, 300]))]
        v, target = w[:], 0.78 + 0.002 * k
        while True:
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
            if len(a & b) <= target * len(a | b):
                break
            if len(w) > 100 and rng.random() < 0.7:
                v[rng.randrange(len(v))] = fresh()
            else:
                v.append(fresh())
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        pairs.append((2 * k, 100 * len(a & b) >= percent * len(a | b)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.id: r.component for r in near_duplicates(df, percent=percent, bands=bands, rows=rows).collect()}
    assert [got[i] == got[i + 1] for i, _ in pairs] == [linked for _, linked in pairs] and len({linked for _, linked in pairs}) == 2
