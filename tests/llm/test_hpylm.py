"""The language model's parts against enumeration and plain code, and the whole on Spark."""

import math
import zlib
from collections import Counter, defaultdict
from dataclasses import replace
from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import hpylm as H

from .helpers import frame, lower, words

END = None


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def trigrams(text):
    t = [END, END, *words(lower(text)), END]
    return [(t[k - 2], t[k - 1], t[k]) for k in range(2, len(t))]


def stirling(most):
    s = {(0, 0): Fraction(1)}
    for c in range(most):
        for t in range(c + 2):
            s[c + 1, t] = s.get((c, t - 1), 0) + (c - Fraction(t, 2)) * s.get((c, t), 0)
    return s


@pytest.mark.parametrize("c, t", [(1, 1), (5, 3), (64, 20), (65, 64), (70, 1)])
def test_stirling_numbers(c, t):
    f = stirling(c)[c, t]
    assert float(H.log_stirling(c, t)) == pytest.approx(math.log(f.numerator) - math.log(f.denominator), abs=1e-8)


@pytest.mark.parametrize("x", [0.01, 0.5, 1, 2.5, 10, 1e5, 1e9])
def test_lgamma(x):
    assert float(H.lgamma(x)) == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-9)


def conditional(c, others, strength, up, base):
    """The probabilities of 1..c tables, from Stirling numbers by their recursion."""
    s, p = stirling(max(c, (up[0] + c) if up else 0)), []
    for t in range(1, c + 1):
        x = math.log(s[c, t]) + sum(math.log(strength + (others + j) / 2) for j in range(t))
        if up is None:
            x += t * math.log(base)
        else:
            same, tables, rest, top = up
            f = s.get((same + t, tables), 0)
            x = x + math.log(f) - sum(math.log(top + rest + j) for j in range(t)) if f else -math.inf
        p.append(x)
    p = np.exp(np.array(p) - max(p))
    return p / p.sum()


@pytest.mark.parametrize("c", [2, 3, 64, 65, 130])
@pytest.mark.parametrize("up", [None, (7, 5, 90, 2.0), (0, 3, 40, 0.5), (2, 1, 2, 30.0)])
def test_draws_follow_the_conditional(c, up, monkeypatch):
    """On both sides of every bound of the sampler, cut ranges included."""
    if up and up[0] + c < up[1]:
        return
    n, base = 20_000, 0.05
    want = conditional(c, 4, 1.5, up, base)
    for full in (H.FULL, 1):
        monkeypatch.setattr(H, "FULL", full)
        u = up and H.Up(*(np.full(n, x) for x in up[:3]), up[3])
        got = H.draw(np.random.default_rng(c), np.full(n, c), np.full(n, 4), 1.5, u, base)
        seen = np.bincount(got, minlength=c + 1)[1:] / n
        assert np.abs(seen - want).sum() / 2 < 0.02 and got.mean() == pytest.approx((want * np.arange(1, c + 1)).sum(), rel=0.03)


def test_draws_of_mixed_rows_and_many_customers():
    rng = np.random.default_rng(1)
    c = np.array([1, 400, 2, 1, 399, 1_000_000, 0])
    got = H.draw(rng, c, np.zeros(7, int), 50.0, None, 0.3)
    assert got[[0, 3, 6]].tolist() == [1, 1, 0] and (got <= c).all() and 20 < got[5] < 200


def test_strength_fit():
    c, t = np.array([1, 5, 5, 9, 2]), np.array([1, 2, 2, 9, 1])
    want = [sum(sum(math.log(s + j / 2) for j in range(1, b)) - sum(math.log(s + j) for j in range(1, a)) for a, b in zip(c.tolist(), t.tolist(), strict=True)) for s in H.GRID]
    assert H.strength_fit(c, t) == pytest.approx(want, rel=1e-9)


def test_freeze():
    a = {
        "none": np.zeros(0, np.int64), "low": np.array([-1, 300]), "up": np.array([3, 3, 70_000, 2**40]), "mixed": np.array([70_000, 2, -(2**20)]),
        "hash": np.array([1, 2**64 - 1], np.uint64), "x": np.array([1.5])
    }
    got = H.thaw(H.freeze(**a))
    assert all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in a.items())


def test_runs():
    v, x = np.array([1, 1, 4, 4, 4, 9]), np.array([2, 7, 0, 0, 3, 1])
    assert H.in_runs(v, x).tolist() == [2, 5, 0, 0, 3, 1] and H.from_runs(v, H.in_runs(v, x)).tolist() == x.tolist()


def test_local_numbers(monkeypatch):
    a, b = np.array([5, 900, 5]), np.array([7, 5])
    for table in (H._TABLE, 1):
        monkeypatch.setattr(H, "_TABLE", table)
        words, (p, q) = H.local_numbers(a, b)
        assert words.tolist() == [5, 7, 900] and p.tolist() == [0, 2, 0] and q.tolist() == [1, 0]


class Local:
    """A run on lists of rows instead of Spark's tables."""

    def __init__(self, docs, buckets=1, hot=(), pairs=(), strengths=H.STRENGTHS):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([out(i) for i, _ in docs]), pa.array([t for _, t in docs], pa.string())], ["id", "held", "text"])
        self.docs = docs
        train = sum(len(trigrams(t)) for i, t in docs if not out(i))
        none = H.Model(buckets, np.zeros(0, np.int64), np.zeros(0, np.uint64), tokens=train, strengths=strengths)
        encoded = [tuple(b.column(k)[0].as_py() for k in (0, 4, 5)) + (b.column(1)[0].values,) for b in H._encode(50)(iter([batch]))]
        named = self.grouped([r for b, _, tokens, _ in encoded for r in H.ask_names(b, tokens, none)], lambda at, rows: H.name_words(at, rows, none))
        self.blocks, self.number = [], {}
        of_hash = {}
        for b, texts, tokens, ids in encoded:
            renamed = H.rename_block(tokens, {r[2]: r[3] for r in named if r[1] == b}, none)
            old, new = H.thaw(tokens), H.thaw(renamed)
            of_hash |= dict(zip(old["h"][old["tokens"]].tolist(), new["words"][new["tokens"]].tolist(), strict=True))
            self.blocks.append((b, texts, renamed, ids))
        assert len(set(of_hash.values())) == len(of_hash)
        h = lambda w: H._END[0] if w is END else H.W.split_words(*H.W.text_buffers(pa.array([w]))).hashes(lower=True)[0]
        self.number = {w: of_hash[int(h(w))] for _, t in docs for g in trigrams(t) for w in g}
        at = lambda w: np.array([self.number[w]])
        self.model = replace(none, hot=np.sort(np.array([self.number[w] for w in hot], np.int64)), hot_pairs=np.sort(np.array([H.pair_key(at(v), at(x))[0] for v, x in pairs], np.uint64)))
        counted = self.grouped(self.packed(False), lambda at, rows: H.count_bucket(at, rows, self.model))
        n = len(self.model.hot_pairs)
        self.model = replace(self.model, pair_c=self.sums(counted, "pair", n)[0], pair_t=self.sums(counted, "pair", n)[1])
        rooted = self.grouped([r for r in counted if r[0] == "first"], lambda at, rows: H.first_root(at, rows, self.model))
        self.model = replace(self.model, words=self.sums(rooted, "known", 1)[0][0], **self.above(rooted))
        self.links = [r for r in rooted if r[0] == "link"]
        self.state, self.root = counted, rooted
        self.models = []

    def packed(self, with_texts):
        return [r for b, texts, tokens, _ in self.blocks for r in H.pack_block(b, texts, tokens, self.model, with_texts)]

    @staticmethod
    def grouped(rows, work):
        by = defaultdict(list)
        for r in rows:
            by[r[1]].append(r)
        return [x for at in by for x in work(at, sorted(by[at], key=lambda r: (r[0], r[2])))]

    @staticmethod
    def sums(rows, kind, size):
        c, t = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r in rows:
            if r[0] == kind:
                c[r[1]] += round(r[4])
                t[r[1]] += round(r[5])
        return c, t

    def above(self, rows):
        (c0, t0), (c, t) = self.sums(rows, "root", 1), self.sums(rows, "hot", len(self.model.hot) + 1)
        return {"root": (int(c0[0]), int(t0[0])), "hot_c": c, "hot_t": t}

    def sweep(self, i, keep=None, seed=1):
        m = self.model
        swept = self.grouped(
            [r for r in self.state if r[0] in ("fixed", "state")] + [r for r in self.root if r[0] == "reply"], lambda at,
            rows: H.sweep_bucket(at, rows, m, np.random.default_rng([seed, i, at, 0]), keep)
        )
        self.root = self.grouped(
            [r for r in self.root if r[0] == "root state"] + [r for r in swept if r[0] == "change"], lambda at,
            rows: H.sweep_root(at, rows, m, np.random.default_rng([seed, i, at, 1]), keep)
        )
        self.state = swept
        self.model = replace(m, pair_t=m.pair_t + self.sums(swept, "pair", len(m.pair_t))[1], **self.above(self.root))
        if keep is not None:
            self.models.append(self.model)

    def tables(self):
        """({(x, v, w): t}, {(v, w): t}, {w: t}) of the state as it is, by words."""
        name = {n: w for w, n in self.number.items()}
        at = lambda numbers: [name[int(n)] for n in numbers]
        two, one, root = {}, {}, {}
        states = {r[1]: H.thaw(r[3]) for r in self.state if r[0] == "state"}
        packed = defaultdict(list)
        for r in self.packed(False):
            packed[r[1]].append(r[3])
        for k, s in states.items():
            b, _ = H.merge_rows(packed[k], self.model)
            w = at(b.words)
            t2 = (b.c > 0).astype(int)
            t2[b.live2] = s["t2"]
            two |= {(w[x], w[v], w[y]): int(t) for x, v, y, t in zip(b.x, b.v, b.w, t2, strict=True) if t}
            t1 = (b.kids > 0).astype(int)
            t1[b.live1] = s["t1"]
            word = at(b.entry_w[b.e1])
            one |= {(w[v], y): int(t) for v, y, t, here in zip(b.v1, word, t1, b.here, strict=True) if here and t}
        hot = [END, *at(self.model.hot)]
        for r in self.root:
            if r[0] == "root state":
                s = H.thaw(r[3])
                w = at(s["words"])
                root |= {x: int(t) for x, t in zip(w, s["rt"], strict=True) if t}
                one |= {(hot[p], w[y]): int(t) for p, y, t in zip(s["hot_p"], s["hot_w"], s["t1"], strict=True) if t}
        return two, one, root

    def scores(self):
        answers = self.grouped([r for r in self.root if r[0] == "root state"] + self.links, lambda at, rows: H.answer_all(at, rows, len(self.models)))
        sums = self.grouped(self.packed(True) + [r for r in self.state if r[0] == "state"] + answers, lambda at, rows: H.score_bucket(at, rows, self.models))
        got = []
        for b, texts, _, ids in self.blocks:
            t = H.sum_block(ids, texts, [r[3] for r in sums if r[1] == b], "id", self.model.tokens)
            got += t.to_pylist()
        return got


def plain_score(docs, samples, strengths):
    """Scores of texts, token by token, from tables by words."""
    count = Counter(g for i, t in docs if not out(i) for g in trigrams(t))
    known = {g[2] for g in count}

    def probability(x, v, w, tables, s):
        two, one, root = tables
        c1, c0 = Counter(), Counter()
        for (_, b, c), t in two.items():
            c1[b, c] += t
        for (_, c), t in one.items():
            c0[c] += t

        def step(c, t, members, tabled, strength, parent):
            return (max(c - t / 2, 0) + (strength + sum(tabled) / 2) * parent) / (strength + sum(members))

        p = step(c0[w], root.get(w, 0), c0.values(), root.values(), s[0], 1 / (len(known) + 1))
        p = step(c1[v, w], one.get((v, w), 0), [n for g, n in c1.items() if g[0] == v], [n for g, n in one.items() if g[0] == v], s[1], p)
        return step(count[x, v, w], two.get((x, v, w), 0), [n for g, n in count.items() if g[:2] == (x, v)], [n for g, n in two.items() if g[:2] == (x, v)], s[2], p)

    memo = {}

    def mean(g):
        if g not in memo:
            memo[g] = sum(probability(*g, tables, s) for tables, s in zip(samples, strengths, strict=True)) / len(samples)
        return memo[g]

    return [(i, sum(math.log10(mean(g)) for g in trigrams(t))) for i, t in docs]


DOCS = [
    (i, " ".join(t)) for i,
    t in enumerate(["a b a b c", "a b a", "b a b", "c a b", "a b c a b", "q a b r", "a a a b b", "", "A B", "x y z a b c", "c", "c", "a b a b a b"] * 2)
] + [(None, "a b"), (77, None), (5, "a b"), (5, "a b")]


@pytest.mark.parametrize("buckets, hot, pairs", [(1, (), ()), (5, (), ()), (5, ("a", END), ()), (3, ("a", "b", END), (("b", "a"), (END, END)))])
def test_scores_against_plain_code(buckets, hot, pairs):
    run = Local(DOCS, buckets, hot, pairs)
    samples = []
    for i in range(4):
        run.sweep(i, i - 2 if i > 1 else None)
        if i > 1:
            samples.append(run.tables())
        two, one, root = run.tables()
        # each table is a customer of the parent, and no word has more tables than customers
        count = Counter(g for d, t in DOCS if not out(d) for g in trigrams(t))
        below1, below0 = Counter(), Counter()
        for (_, v, w), t in two.items():
            below1[v, w] += t
        for (_, w), t in one.items():
            below0[w] += t
        assert set(two) == set(count) and all(1 <= t <= count[g] for g, t in two.items())
        assert set(one) == set(below1) and all(1 <= t <= below1[g] for g, t in one.items())
        assert set(root) == set(below0) and all(1 <= t <= below0[g] for g, t in root.items())
        assert run.model.root == (sum(below0.values()), sum(root.values()))
    want = Counter((i, round(s, 9)) for i, s in plain_score(DOCS, samples, [H.STRENGTHS] * 2))
    assert Counter((r["id"], round(r["score"], 9)) for r in run.scores()) == want


@pytest.mark.parametrize("buckets, hot, pairs", [(1, (), ()), (4, (), ()), (4, ("a", END), (("b", "a"),))])
def test_samples_follow_the_posterior(buckets, hot, pairs, monkeypatch):
    """Average tables of a tiny corpus, against all states enumerated with their weights."""
    monkeypatch.setattr(H, "PARTS", 40)  # hardly two rows at once
    docs = [(d, t) for d, t in zip((i for i in range(50) if not out(i)), ["a b", "a b", "a b", "c b", "b"], strict=False)]
    strengths = (3.0, 1.0, 0.5)
    count = Counter(g for _, t in docs for g in trigrams(t))
    s = stirling(12)

    def rise(start, step, n):
        return math.prod(start + step * j for j in range(n))

    def weight(level, rows):
        """rows: (restaurant, customers, tables)."""
        c, t, p = Counter(), Counter(), 1.0
        for r, a, b in rows:
            c[r] += a
            t[r] += b
            p *= float(s.get((a, b), 0))
        return p * math.prod(rise(strengths[level], 0.5, t[r]) / rise(strengths[level], 1, c[r]) for r in c)

    two = list(count)
    one = sorted({g[1:] for g in two}, key=str)
    root = sorted({g[1] for g in one}, key=str)
    base, total, sums = 1 / (len(root) + 1), 0.0, Counter()
    for t2 in product(*(range(1, count[g] + 1) for g in two)):
        w2 = weight(2, [(g[:2], count[g], t) for g, t in zip(two, t2, strict=True)])
        c1 = Counter()
        for g, t in zip(two, t2, strict=True):
            c1[g[1:]] += t
        for t1 in product(*(range(1, c1[g] + 1) for g in one)):
            w1 = weight(1, [(g[0], c1[g], t) for g, t in zip(one, t1, strict=True)])
            c0 = Counter()
            for g, t in zip(one, t1, strict=True):
                c0[g[1]] += t
            for t0 in product(*(range(1, c0[g] + 1) for g in root)):
                w = w2 * w1 * weight(0, [(0, c0[g], t) for g, t in zip(root, t0, strict=True)]) * base ** sum(t0)
                total += w
                for key, t in zip([*two, *one, *root], [*t2, *t1, *t0], strict=True):
                    sums[key] += w * t
    run = Local(docs, buckets, hot, pairs, strengths)
    seen, n = Counter(), 1500
    for i in range(n):
        run.sweep(i)
        a, b, c = run.tables()
        for key, t in (a | b | c).items():
            seen[key] += t
    for key in [*two, *one, *root]:
        # buckets that draw side by side see each other's tables a sweep late
        assert seen[key] / n == pytest.approx(sums[key] / total, rel=0.05 if buckets == 1 else 0.08), key


def test_on_spark_as_locally(spark):
    """Spark's tables hold what lists hold: the same scores, whatever the partitions and blocks."""
    strengths, hot = (4.0, 1.5, 0.7), 15
    want = None
    for parts, size in ((1, 10**6), (4, 40)):
        got = H.train_and_score(frame(spark, DOCS, parts), buckets=4, hot_tokens=hot, block_tokens=size, strengths=strengths).collect()
        rows = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in got)
        assert want is None or rows == want
        want = rows
    tokens = [g for _, t in DOCS for g in trigrams(t)]
    before, pair = Counter(g[1] for g in tokens), Counter(g[1::-1] for g in tokens)
    run = Local(DOCS, 4, [w for w, n in before.items() if n > hot], [vx for vx, n in pair.items() if n > hot], strengths)
    assert len(run.model.hot) > 1 and len(run.model.hot_pairs) > 0
    for i in range(H.BURN_IN + H.SAMPLES):
        run.sweep(i, i - H.BURN_IN if i >= H.BURN_IN else None)
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in run.scores()) == want


def test_predictions_sum_to_one():
    root = H.predict(np.array([5, 3, 2, 0]), np.array([2, 1, 1, 0]), 10, 4, 2.0, np.full(4, 0.25))
    assert root.sum() == pytest.approx(1)
    assert H.predict(np.array([4, 2, 0, 0]), np.array([2, 1, 0, 0]), 6, 3, 0.7, root).sum() == pytest.approx(1)


def test_a_corpus_teaches(spark):
    """Held-out texts of the corpus's own kind are more probable than the base has them."""
    rng = __import__("random").Random(3)
    phrases = [" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(6)) for _ in range(12)]
    docs = [(i, " ".join(rng.choice(phrases) for _ in range(4))) for i in range(120)]
    got = [r for r in H.train_and_score(frame(spark, docs)).collect() if r.held_out]
    assert len(got) > 5 and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)
