"""Each dealt operator against a plain version, on awkward documents and on empty tables."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import decontaminate, hpylm, langid, minhash, packing, quality, substring, tokens, urlfilter, warc

from .helpers import components, corpus, frame, group_numbers, lower, prose, repeated_cover, words


@pytest.fixture(scope="module")
def rows():
    return corpus()


def same(got, want):
    assert Counter(got) == Counter(want)


def test_substring(spark, rows):
    cover = repeated_cover(rows)
    want = [(i, len(words(t)), sum(c), hashlib.sha256(" ".join(w for w, x in zip(words(t), c, strict=True) if not x).encode()).hexdigest()) for (i, t), c in zip(rows, cover, strict=True)]
    same([tuple(r) for r in substring.substring_report(frame(spark, rows)).collect()], want)


@pytest.mark.parametrize("min_words, seed_words", [(6, 3), (10, 10), (12, 1)])
def test_substring_of_other_lengths(spark, rows, min_words, seed_words):
    want = [(i, sum(c)) for (i, _), c in zip(rows, repeated_cover(rows, min_words), strict=True)]
    got = substring.substring_report(frame(spark, rows), min_words=min_words, seed_words=seed_words)
    same([(r.doc_id, r.n_removed) for r in got.collect()], want)


def test_substring_cuts_texts(spark):
    rng = __import__("random").Random(1)
    p = " ".join(prose(rng, 40))
    rows = [(1, f"alpha\nbeta  {p}\ngamma"), (2, f"{p} delta"), (3, "nothing\n here")]
    got = {r.doc_id: r.text for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: "alpha\nbeta  gamma", 2: "delta", 3: "nothing\n here"}
    assert substring.remove_repeats(frame(spark, rows)).columns == frame(spark, rows).columns


def test_section_tokens(spark, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in tokens.section_tokens(frame(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, t in {i: t for i, t in rows if i not in (7, 8)}.items():
        t = t or ""
        lines = t.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        have = sorted(got[i], key=lambda r: r.section)
        assert [t.encode()[r.start_byte : r.end_byte].decode() for r in have] == lines
        spans, at = [], 0
        enc = whole.encode(t, add_special_tokens=False)
        for tok in enc.tokens:
            spans.append((at, at + len(tok)))
            at += len(tok)  # a byte-level token has one character for each byte
        n, cross = [0] * len(lines), [0] * len(lines)
        for a, b in spans:
            shares = [max(0, min(b, r.end_byte) - max(a, r.start_byte)) for r in have]
            k = shares.index(max(shares))
            n[k] += 1
            cross[k] += sum(x > 0 for x in shares) > 1
        assert [(r.n_tokens, r.n_crossing) for r in have] == list(zip(n, cross, strict=True))


def test_tokens_that_cross_sections():
    got, crossing = tokens.attribute(np.array([0, 2, 5]), np.array([2, 5, 7]), np.array([0, 3, 4, 7]))
    assert got.tolist() == [0, 0, 2] and crossing.tolist() == [False, True, False]
    assert tokens.attribute(np.array([2]), np.array([6]), np.array([0, 3, 6]))[0].tolist() == [1]


def test_encoder_equals_tokenizers(rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = tokens.Encoder(tokens.default_vocabulary())
    texts = [t or "" for _, t in rows] + [
        "a\n b", "a  b \n\n c d", " 's don't 12ab-- \t", "日本語 テスト　x", "x\x1cy \x1fz", "🙂🙂 é", "x <|endoftext|> y", "<|endoftext|><|endoftext|>",
        "a<|endoftext|b <|endoftext|>\x1c<|endoftext|>\n"
    ]
    for _ in range(2):
        ids, bounds = enc.encode(texts)
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(3)
    for _ in range(20):
        item, region = rng.integers(1, 5, 8).astype(np.uint64), rng.integers(1, 5, (3, 15)).astype(np.uint64)
        assert decontaminate.align(item, region).tolist() == [brute_align(item.tolist(), r.tolist()) for r in region]


@pytest.mark.parametrize("limit", [10**6, 5])
def test_decontamination(spark, rows, limit):
    rng = __import__("random").Random(9)
    items = [(k, " ".join(prose(rng, 30, 10**6))) for k in range(4)] + [(4, "two words"), (5, ""), (6, None)]
    edited = items[1][1].split()
    for p in (4, 11, 17, 23):
        edited[p] = "other"
    docs = rows + [
        (2000, "Intro. " + items[0][1].upper() + " more text"), (2001, "x y " + " ".join(edited)), (2002, items[2][1][:60]),
        (2003, items[0][1] + " " + items[3][1])
    ] + [(3000 + k, f"n{k} " + items[3][1]) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_matches(frame(spark, docs), bench, broadcast_grams=limit).collect()
    found = {(r.id, r.item) for r in got}
    assert found == {(2000, 0), (2001, 1), (2003, 0), (2003, 3)} | {(3000 + k, 3) for k in range(40)}
    assert {r.score for r in got if r.item != 1} == {1.0}
    left = decontaminate.drop_contaminated(frame(spark, docs), bench)
    same([r.doc_id for r in left.collect()], [i for i, _ in docs if i is None or i < 2000 or i == 2002])


@pytest.mark.parametrize("limit", [10**6, 5])
def test_decontamination_finds_all_that_scores_enough(spark, limit):
    """Verbatim copies beside evenly and randomly edited ones: exactly the pairs that brute force scores at least half."""
    rng = __import__("random").Random(21)
    items = [prose(rng, n, 60 if n < 12 else 400) for n in (3, 4, 5, 8, 11, 24, 30, 38, 59)]
    copies = []
    for w in items:
        copies += [w, [x for i, x in enumerate(w) if i % 3 != 1], ["e%d" % i if i % 3 == 2 else x for i, x in enumerate(w)]]
        copies += [sum(([x, "i%d" % i] if i % 2 else [x] for i, x in enumerate(w)), []), sum(([x, "j%d" % i] for i, x in enumerate(w)), [])]
        for share in (0.15, 0.3, 0.4, 0.5):
            c = []
            for i, x in enumerate(w):
                kind = rng.randrange(3) if rng.random() < share else 3
                c += [[], ["s%d" % i], ["n%d" % i, x], [x]][kind]
            copies.append(c)
    docs = [(i, " ".join(prose(rng, rng.choice([0, 20, 300])) + c + prose(rng, 20))) for i, c in enumerate(copies)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    got = decontaminate.find_matches(frame(spark, docs), bench, broadcast_grams=limit).collect()
    scored = {(i, k): brute_align(w, t.split()) / (2 * len(w)) for i, t in docs for k, w in enumerate(items)}
    want = {pair: s for pair, s in scored.items() if s >= 0.5}
    assert 60 < len(want) and sum(s < 0.6 for s in want.values()) > 10
    assert {(r.id, r.item): r.score for r in got} == want and len(got) == len(want)


def test_decontamination_is_alike_on_both_paths(spark):
    """Full rows, with repeated rows and words: broadcast items give what joined ones give."""
    rng = __import__("random").Random(23)
    items = [(k, " ".join(prose(rng, 30, v))) for k, v in enumerate((10**6, 10**6, 8, 3))] + [(9, "one two three four five six seven eight"), (10, "a b b c a b b c"), (11, "so it"), (12, "p q " * 40)]
    docs = [(43, "p q " * 300)] + [(k, "x y " + t) for k, t in items] + [(20 + k, t + " z " + t) for k, t in items] + [(40, items[0][1][:90] + " " + items[1][1])] * 5 + [(41, items[0][1]), (42, "so it")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    small, large = (sorted((r.id, r.th, r.item, r.score, r.n_hits) for r in decontaminate.find_matches(frame(spark, docs), bench, broadcast_grams=n).collect()) for n in (10**6, 5))
    assert small == large and [r[0] for r in small].count(40) == 5 * len({r[2] for r in small if r[0] == 40})
    # every second place of the text, for each of the item's seeds
    assert [r[4] > 79 // 2 * 299 for r in small if (r[0], r[2]) == (43, 12)] == [True]
    # 8 - ceil(8 / 2 - 1) = 5 of the item's places seed
    assert [r[4] for r in small if (r[0], r[2]) == (9, 9)] == [5] and (42, 11) in {(r[0], r[2]) for r in small}


def test_near_duplicates(spark, rows):
    want = [(i, c, i is None or i == c) for (i, _), c in zip(rows, components(rows), strict=True)]
    got = minhash.near_duplicate_report(frame(spark, rows)).collect()
    same([(r.doc_id, r.component_id, r.kept) for r in got], want)


def test_near_duplicates_of_a_large_group(spark):
    """Copies with own edits, chains of edits, and copies of copies: hubs alone wouldn't link all."""
    rng = __import__("random").Random(4)
    base = prose(rng, 150, 10**6)
    docs = []
    for i in range(120):
        w = base[:]
        for p in rng.sample(range(150), rng.choice([0, 1, 1, 2, 2, 3, 5])):
            w[p] = f"e{i}p{p}"
        docs.append((i, " ".join(w)))
    w = base[:]
    for i in range(40):
        w[3 * i] = f"step{i}"
        docs.append((500 + i, " ".join(w)))
    for k in range(3, 75, 4):  # shortened copies: alike without sharing anything that a hub lacks
        docs.append((800 + k, " ".join(base[: 150 - k])))
        docs.append((900 + k, " ".join(base[k:])))
    got = minhash.near_duplicate_report(frame(spark, docs)).collect()
    same([(r.doc_id, r.component_id) for r in got], [(i, c) for (i, _), c in zip(docs, components(docs), strict=True)])


def test_one_of_each_component_stays(spark, rows):
    kept = minhash.keep_one(frame(spark, rows))
    best = {}
    for (i, t), g in zip(rows, group_numbers(rows), strict=True):
        if i is not None and words(t):
            best[g] = min(best.get(g, i), i)
    want = [*best.values(), *(i for i, t in rows if i is None or not words(t))]
    assert [i for i, _ in rows].count(8) == want.count(8) == 2  # two texts under one id
    same([r.doc_id for r in kept.collect()], want)
    assert kept.columns == frame(spark, rows).columns


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 900, dtype=np.uint64)
    g = [np.concatenate([shared, rng.integers(0, 2**63, 50, dtype=np.uint64)]) for _ in range(2)]
    sig = minhash.signatures(np.concatenate(g), np.array([0, 950, 1900]), 320)
    assert abs((sig[0] == sig[1]).mean() - 0.9) < 0.06
    few = minhash.signatures(np.array([5, 5, 9], np.uint64), np.array([0, 1, 3]), 320)
    assert (few != np.uint64(2**64 - 1)).all() and 0.2 < (few[0] == few[1]).mean() < 0.8


def test_language_model(spark, rows):
    got = hpylm.train_and_score(frame(spark, rows), buckets=5).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not out(i) for w in [*words(lower(t)), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        w = [*words(lower(t)), None]
        want[i, out(i), len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_url_filters(spark):
    events = spark.createDataFrame(
        [
            ("bad.org", "spam", "add", "2024-01-10"), ("bad.org", "spam", "add", "2024-01-12"), ("bad.org", "spam", "remove", "2024-01-20"),
            ("a.bad.org", "ads", "add", "2024-01-15"), ("x.com", "ads", "add", "2024-02-01"), ("x.com", "ads", "remove", "2024-02-01"),
            (None, "ads", "add", "2024-01-01")
        ],
        "pattern string, list string, action string, date string",
    ).selectExpr("pattern", "list", "action", "CAST(date AS DATE) AS date")
    captures = [
        (1, "http://bad.org/x", "2024-01-09"), (2, "https://u@BAD.org:80/", "2024-01-10"), (3, "http://a.bad.org", "2024-01-19"),
        (4, "http://a.bad.org", "2024-01-20"), (5, "http://notbad.org", "2024-01-15"), (6, "http://x.com", "2024-02-01"), (7, None, "2024-01-15"),
        (8, "nonsense", "2024-01-15"), (9, "http://bad.org", None), (2, "https://u@BAD.org:80/", "2024-01-10")
    ]
    df = spark.createDataFrame(captures, "page_id bigint, url string, fetched string").selectExpr(
        "page_id", "url", "CAST(fetched AS DATE) AS fetched", "'clash' AS host", "'clash' AS pattern", "1 AS row"
    )
    got = urlfilter.verdicts(df, events).collect()
    same(
        [(r.page_id, r.lists, r.blocked) for r in got],
        [(1, "", False), (2, "spam", True), (2, "spam", True), (3, "ads,spam", True), (4, "ads", True), (5, "", False), (6, "", False), (7, "", False), (8, "", False), (9, "", False)]
    )


def pages():
    return [
        (1, "http://a/ü", "<p>x</p>"), (5, "http://b", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "http://c\r\nX: y", None), (6, "http://d", ""),
        (7, "http://e", "é" * 5000), (None, "http://f", "<p>x</p>"), (None, "http://g", "alone"), (7, "http://e", "é" * 5000),
        (8, "u", "\x1f\x8b\x08 not gzip WARC/1.0")
    ]


@pytest.mark.parametrize("split, least", [(1 << 20, 0), (64, 0), (300, 100)])
def test_warc(spark, split, least):
    df = spark.createDataFrame(pages(), "page_id bigint, url string, html string").repartition(2)
    folder = warc.new_folder(spark, "warc")
    warc.write_archives(warc.with_roles(df, "page_id", "url", "html", least), folder).write.parquet(folder + "-files")
    got = warc.read_archives(spark, folder, spark.read.parquet(folder + "-files"), split).collect()
    groups = defaultdict(list)
    for i, u, h in pages():
        groups[(h or "").encode()].append(i)
    want = []
    for p, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None) if len(ids) > 1 and len(p) >= least else None
        for i in ids:
            revisit = top is not None and i != top
            want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None, b"" if revisit else p))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got], want)


def test_quality_figures(spark, rows):
    want = Counter()
    for i, t in rows:
        w, t = words(t), t or ""
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        want[i, len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover), failed] += 1
    got = quality.quality_rules(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def rejected_by(t):
    """The rules that reject a text, by plain code."""
    w = words(t)
    chars = "".join(w)
    letters, capitals, digits = (sum(map(f, chars)) for f in (str.isalpha, str.isupper, str.isdigit))
    lines = [x for x in t.split("\n") if words(x)]
    dup = len(lines) - len(set(lines))
    inner = [x.strip(" \t\r\x0b\x0c") for x in lines]
    broken = sum(x.endswith(("...", "\u2026")) for x in inner)
    return {
        "many_symbols": 10 * sum(map(t.count, "#*$%&|<>")) > len(w),
        "odd_word_length": not 2 * len(w) <= len(chars) <= 15 * len(w),
        "shouting": 2 * capitals > letters,
        "few_letters": 2 * letters < len(chars),
        "many_digits": 10 * digits > 3 * len(chars),
        "few_words_with_letters": 10 * sum(any(map(str.isalpha, x)) for x in w) < 6 * len(w),
        "repeated_lines": dup >= 3 and 10 * dup > 3 * len(lines),
        "list_lines": len(lines) >= 5 and 10 * sum(x.startswith(("-", "*", "\u2022", "\u25cf", "\u25aa")) for x in inner) > 9 * len(lines),
        "broken_lines": broken >= 3 and 10 * broken > 3 * len(lines),
        "one_word": 10 * max(Counter(map(lower, w)).values(), default=0) > 3 * len(w),
    }


GOOD = "Plain words of a text that nobody has any reason to reject at all, one line."
BAD = {
    "many_symbols": "some ### of *** all %%% " * 9,
    "odd_word_length": "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "shouting": "THIS TEXT IS ALL SHOUTED OUT LOUD " + " ".join(f"WORD{c}" for c in "ABCDEFGHIJKLMNOPQ"),
    "few_letters": "\U0001f600\U0001f601\U0001f602 " * 30,
    "many_digits": " ".join(f"nr{i}" for i in range(100, 140)),
    "few_words_with_letters": " ".join(f"{i}.. lang" for i in "()[]{}!?.,;:+=~^_") + " ..!? ;;:: (()) [[]] -- ,,",
    "repeated_lines": "same line here\n" * 3 + "x y z\n" + "same line here\n" * 3,
    "list_lines": "\n".join(f" - point {c} of the list" for c in "abcdefg"),
    "broken_lines": "\n".join(f"a line {c} that breaks off{e}" for c, e in zip("abcdef", ["...", "\u2026 ", "", "... \t", "...", ""], strict=True)),
    "one_word": " ".join(f"buy {c}ord BUY Buy" for c in "abcdefghijk"),
}


def odd_texts():
    rng = __import__("random").Random(11)
    parts = ["word", "Été", "ЖЖ", "\u4e00\u4e8c", "x1", "99", "#", "...", "\n- ", "\n", "LOUD", "\u2022 item", "end\u2026\n", "\U0001f600", "plain", "text"]
    return [" ".join(rng.choice(parts) for _ in range(rng.choice([20, 25, 60]))) for _ in range(300)] + [*BAD.values(), GOOD, GOOD * 3000, "\u3002\uff0c " * 40]


def test_quality_verdicts(spark):
    texts = odd_texts()
    got = quality.quality_rules(frame(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        by = rejected_by(texts[r.doc_id])
        assert r.kept == (not r.base_failed and not any(by.values())), (texts[r.doc_id], by)
    assert sum(r.kept for r in got) > 1 and sum(not r.kept and not r.base_failed for r in got) > 20


def texts_of(rows):
    import pyarrow as pa

    from sparkloom.llm import words as W

    return quality.Texts(*W.text_buffers(pa.array(rows, pa.string())))


@pytest.mark.parametrize("name", list(BAD))
def test_quality_rules_reject(name):
    for text, reject in ((BAD[name], True), (GOOD, False)):
        t = texts_of([GOOD, text, None])
        for rule in quality.RULES:
            want = rejected_by(text)[rule.name]
            assert bool(rule.rejects(t)[1]) == want and (not reject or want or rule.name != name)
    assert quality.cascade(texts_of([GOOD, BAD[name], GOOD]), quality.RULES, np.ones(3, bool)).tolist() == [True, False, True]


def test_cascade_order_and_verdict():
    asked = []

    def rule(name, bad):
        def rejects(t):
            asked.append((name, t.rows))
            texts = [t.data[a:b].tobytes().decode() for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)]
            assert [t.words.joined(r).decode().split() for r in range(t.rows)] == [words(x) for x in texts]
            return np.array([bad in x for x in texts], bool)

        return quality.Rule(name, rejects)

    rules = [rule("slow", "s"), rule("fast", "f"), rule("new", "n"), rule("twin", "f")]
    # twin rejects as many as fast and costs more: behind fast it has nothing left to reject
    plan = quality.ordered(rules, quality.Sample({"slow": 1.0, "fast": 0.01, "new": 0.1, "twin": 0.011}, {0b0001: 50, 0b1010: 40, 0b0000: 10}))
    assert [r.name for r in plan] == ["fast", "slow", "twin", "new"]
    t = texts_of(["f", "s", "fs a", "ok", None, "n"])
    assert quality.cascade(t, plan, np.array([True] * 6)).tolist() == [False, False, False, True, True, False]
    assert asked == [("fast", 6), ("slow", 4), ("twin", 3), ("new", 3)]
    assert quality.cascade(t, plan, np.zeros(6, bool)).tolist() == [False] * 6


def test_the_sample_is_no_prefix(spark):
    """A table sorted so that all shouting stands behind: the sample sees it all the same."""
    rows = [(i, GOOD + f" number {i} and a few words more than before") for i in range(900)] + [(i, BAD["shouting"] + f" {i}") for i in range(900, 1200)]
    sample = quality.measure(frame(spark, rows, 1).orderBy("doc_id"), sample_rows=200)
    bit = [r.name for r in quality.RULES].index("shouting")
    n = sum(sample.sets.values())
    assert 100 < n < 320 and 0.12 < sum(c for b, c in sample.sets.items() if b >> bit & 1) / n < 0.4


def test_packing(spark, rows):
    docs = rows + [(4000, " ".join(prose(__import__("random").Random(2), 1500, 10**6))), (4001, "one <|endoftext|> two<|endoftext|>")]
    got = packing.pack_documents(frame(spark, docs)).collect()
    from tokenizers import Tokenizer

    import public_tokenizers

    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, bins = Counter(), defaultdict(list)
    for i, t in docs:
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 1


def test_bin_completion_is_optimal_on_small_cases():
    from functools import lru_cache
    from itertools import combinations

    def optimum(sizes, cap):
        @lru_cache(None)
        def go(left):
            if not left:
                return 0
            first, rest = left[0], left[1:]
            best = len(left)
            for k in range(len(rest) + 1):
                for c in combinations(range(len(rest)), k):
                    if first + sum(rest[i] for i in c) <= cap:
                        best = min(best, 1 + go(tuple(x for i, x in enumerate(rest) if i not in c)))
            return best

        return go(tuple(sorted(sizes, reverse=True)))

    rng = __import__("random").Random(6)
    for _ in range(60):
        sizes = [rng.randrange(1, 11) for _ in range(rng.randrange(0, 9))]
        for method in (packing.bin_completion, packing.best_fit):
            made = method(dict(Counter(sizes)), 12)
            assert Counter(s for b, n in made for s in b for _ in range(n)) == Counter(sizes)
            assert all(sum(b) <= 12 for b, _ in made)
        assert sum(n for _, n in packing.bin_completion(dict(Counter(sizes)), 12)) == optimum(tuple(sizes), 12)


def test_packing_of_many_pieces_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    counts = dict(Counter(rng.integers(1, 1025, 200_000).tolist()))
    made = packing.bin_completion(counts)
    assert sum(n for _, n in made) <= 1.01 * max(-(-sum(s * n for s, n in counts.items()) // 1024), sum(n for s, n in counts.items() if s > 512))
    assert sum(len(b) for b, _ in made) < 50_000  # what the driver holds doesn't follow the pieces


LANGS = {"aa": ["zorba", "kalimera", "nero", "psomi"], "bb": ["hvordan", "gaar", "det", "venner"]}


def labelled(n=60):
    rng = __import__("random").Random(8)
    return [(i, " ".join(rng.choice(LANGS["aa" if i % 2 else "bb"]) for _ in range(12))) for i in range(n)]


def test_language_id(spark):
    docs = labelled() + [(900, None), (901, ""), (902, "12 34 !!"), (903, "nero " * 5000), (None, "venner gaar"), (901, "")]
    got = {(r.doc_id, r.lang_pred): r for r in langid.language_report(frame(spark, docs)).collect()}
    assert {k for k in got if k[0] is not None and k[0] < 60} == {(i, "aa" if i % 2 else "bb") for i in range(60)}
    assert got[900, "und"].score == got[901, "und"].score == got[902, "und"].score == 0
    assert got[903, "aa"].score > 0.9 and (None, "bb") in got
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())


def test_forward_sums_all_segmentations():
    pieces = ["▁".encode(), "▁a".encode(), b"a", b"b", b"ab", b"ba"]
    keys = np.sort(np.array([langid.piece_hash(p) for p in pieces], np.uint64))
    prob = np.zeros(len(keys))
    for p, x in zip(pieces, (0.3, 0.1, 0.2, 0.1, 0.2, 0.1), strict=True):
        prob[np.searchsorted(keys, np.uint64(langid.piece_hash(p)))] = x
    table = dict(zip(pieces, (0.3, 0.1, 0.2, 0.1, 0.2, 0.1), strict=True))

    def brute(rest):
        return 1.0 if not rest else sum(x * brute(rest[len(p) :]) for p, x in table.items() if rest.startswith(p))

    mark = "▁".encode()
    for w in (b"a", b"ab", b"abab", b"bba"):
        lat = langid.Lattice([mark + w, mark + b"aaaaaaa"], keys, 4)
        assert np.exp(lat.totals(prob[:, None]))[0, 0] == pytest.approx(brute(mark + w), rel=1e-4)
    # expected counts over all segmentations: each byte is covered once
    lat = langid.Lattice([mark + b"abab"], keys, 4)
    e = lat.expected(prob, np.array([1.0]))
    size = {langid.piece_hash(p): len(p) for p in pieces}
    assert sum(e[i] * size[int(k)] for i, k in enumerate(keys)) == pytest.approx(len("▁abab".encode()), rel=1e-3)


def test_empty_tables(spark, rows):
    none = frame(spark, rows).limit(0)
    bench = spark.createDataFrame([(1, "some test item of a few words")], "item_id bigint, text string")
    for df in (
        substring.substring_report(none), substring.remove_repeats(none), tokens.section_tokens(none), minhash.near_duplicate_report(none), minhash.keep_one(none),
        hpylm.train_and_score(none), quality.quality_rules(none), packing.pack_documents(none), langid.language_report(none),
        decontaminate.contamination_report(none, bench), decontaminate.contamination_report(frame(spark, rows), bench.limit(0)),
        warc.archive_report(spark.createDataFrame([], "page_id bigint, url string, html string")),
    ):
        assert df.collect() == []


def test_rules_are_measured_without_what_they_share(spark, rows):
    def free(t):
        return np.full(t.rows, not {"kind", "lines", "n_words", "word_chars"} <= set(t.__dict__))

    sample = quality.measure(frame(spark, rows), [quality.Rule("free", free), *quality.RULES[:3]])
    assert sum(n for bits, n in sample.sets.items() if bits & 1) == 0 < sum(sample.sets.values())


def test_survivors_keep_their_code_points():
    from sparkloom.llm import words as W

    data, offsets = W.text_buffers(__import__("pyarrow").array(["Été 12", "abc", "", "ÀÉ x"]))
    t = quality.Texts(data, offsets)
    t.prepare()
    some = t.subset(np.array([True, False, True, True]))
    alone = quality.Texts(some.data, some.offsets)
    assert "kind" in some.__dict__ and some.kind.tolist() == alone.kind.tolist() and some.words.first.tolist() == alone.words.first.tolist()


def test_the_prior_counts_all_texts(spark):
    df = spark.createDataFrame([(i, "alpha beta" if i % 4 else "gamma", "a" if i % 4 else "b") for i in range(400)], "doc_id bigint, text string, lang string")
    model = langid.fit(df, train_rows=20, rounds=1)
    assert model.langs == ["a", "b"] and model.prior.tolist() == pytest.approx([0.75, 0.25])


def test_long_words_are_learnt_in_stretches(monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 7)
    raw = "▁àéàéàéabc".encode()
    parts = list(langid.stretches(raw))
    assert b"".join(parts) == raw and all(p.decode() and len(p) <= 7 for p in parts) and len(parts) > 2


def test_untrained_language_model_and_id(spark):
    only_out = [(i, "a b") for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    assert all(r.n_known == 0 and r.base_score == 0 for r in hpylm.train_and_score(frame(spark, only_out)).collect())
    unlabelled = frame(spark, [(9, "some text")])
    assert [(r.lang_pred, r.score) for r in langid.language_report(unlabelled).collect()] == [("und", 0.0)]


@pytest.mark.parametrize("letters", [10, 30, 60, 200, 5000])
def test_long_words_are_scored_whole(letters, monkeypatch):
    """The sum over all segmentations, by exact fractions, wherever the word is cut into stretches."""
    from fractions import Fraction

    rng = __import__("random").Random(letters)
    word = "▁".encode() + "".join(rng.choice("abcé") for _ in range(letters)).encode()
    pieces = {"▁".encode(): 0.3, "▁a".encode(): 0.1, b"a": 0.2, b"ab": 0.2, b"bca": 0.05, "é".encode(): 0.15}
    keys = np.sort(np.array([langid.piece_hash(p) for p in pieces], np.uint64))
    prob = np.zeros((len(keys), 2))
    for p, x in pieces.items():
        prob[np.searchsorted(keys, np.uint64(langid.piece_hash(p)))] = x, x / 2
    exact = {p: Fraction(x) for p, x in pieces.items()}
    if letters <= 200:
        sums = [Fraction(1)]
        for e in range(1, len(word) + 1):
            sums.append(sums[e - 1] * Fraction(langid.UNKNOWN) + sum(sums[e - len(p)] * x for p, x in exact.items() if word[:e].endswith(p) and len(p) <= e))
        want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
        assert langid.Lattice([word], keys, 4).totals(prob)[0, 0] == pytest.approx(want, rel=1e-9)
    whole = langid.Lattice([word], keys, 4).log_forward(prob)[-1, 0]
    assert np.isfinite(whole).all()
    monkeypatch.setattr(langid, "STRETCH", 7)
    assert langid.long_total(word, keys, 4, prob) == pytest.approx(whole, rel=1e-9)


def test_a_words_score_does_not_depend_on_its_text():
    model = langid.Model(["x", "y"], np.array([0.5, 0.5]), np.sort(np.array([langid.piece_hash(p) for p in (b"donau", b"dampf", b"schiff")], np.uint64)), np.array([[0.1, 0.2]] * 3), 6)
    alone, within = "donaudampfschifffahrtsgesellschaft", "donaudampfschifffahrtsgesellschaft " + "und " * 40
    one = [langid._score(langid.text_words(t), model)[0] for t in (alone, within)]
    assert langid.text_words(within)[0] == alone and (one[0] == one[1]).all()
    # unknown letters alone: the languages tie, and the first by name wins
    assert langid.predictor(model)(["\u4e00" * 24])[0] == ["x"]


@pytest.mark.parametrize("seed, percent", [(1, 80), (2, 85), (3, 80), (4, 60)])
def test_variants_of_one_text(spark, seed, percent):
    """A hub with many members around the threshold, with common and own edits: no link is lost, whatever the hub settles."""
    rng = __import__("random").Random(seed)
    base, lines = prose(rng, 90, 10**6), [prose(rng, 12, 10**6) for _ in range(3)]
    texts = []
    for _ in range(70):
        w = base[:]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([1, 1, 3])] = [f"own{rng.randrange(10**6)}"] * rng.choice([0, 1])
        for line in rng.sample(lines, rng.choice([0, 1, 1, 2, 3])):
            at = rng.choice([0, len(w) // 2, len(w)])
            w[at:at] = line
        if rng.random() < 0.3:
            w = w[rng.choice([0, 5, 15]) : len(w) - rng.choice([0, 8, 20])]
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    got = {r.id: r.component for r in minhash.near_duplicates(frame(spark, docs), percent=percent, bands=64, rows=2 if percent == 60 else 4).collect()}
    assert [got[i] for i, _ in docs] == components(docs, percent)


@pytest.fixture(scope="module")
def long_text():
    """A text several times as long as what is hashed at once, with a passage of its own twice."""
    rng = __import__("random").Random(9)
    w = [f"q{rng.randrange(10**7)}é" for _ in range(150_000)]
    w[100_000:100_040] = w[10:50]
    return w


def test_a_very_long_text(spark, long_text):
    from sparkloom.llm import words as W

    text = " ".join(long_text)
    assert len(text.encode()) > 2 * W.SLICE_BYTES
    df = frame(spark, [(1, text), (2, text), (3, " ".join(long_text[:60])), (4, "short")], 2)
    n = len(long_text)
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring.substring_report(df).collect()}
    assert cut == {1: (n, n), 2: (n, n), 3: (60, 60), 4: (1, 0)}
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicate_report(df).collect()}
    assert near[1] == near[2] == (len({tuple(long_text[i : i + 5]) for i in range(n - 4)}), 1) and near[3][1] == 3
    base = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality.quality_rules(df).collect()}
    assert base[1] == (n, 80) and base[3] == (60, 0)
    scored = {r.doc_id: r for r in hpylm.train_and_score(df, buckets=3).collect()}
    assert scored[1].n_tokens == n + 1 and scored[1].score == pytest.approx(scored[2].score) and math.isfinite(scored[1].score)
    got = defaultdict(int)
    for r in packing.pack_documents(df).collect():
        got[r.doc_id] += r.length
    sections = {r.doc_id: r.n_tokens for r in tokens.section_tokens(df).collect()}
    assert all(got[i] == sections[i] + 1 for i in (1, 2, 3, 4))
    items = spark.createDataFrame([(7, " ".join(long_text[70_000:70_030]))], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.score) for r in decontaminate.contamination_report(df, items).collect()} == {(1, 7, 1.0), (2, 7, 1.0)}


def test_hashes_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    from sparkloom.llm import words as W

    w = W.split_words(*W.text_buffers(pa.array(["one Two  three", None, "x" * 300 + " é y", ""])))
    whole = [w.hashes(), w.hashes(lower=True)]
    monkeypatch.setattr(W, "SLICE_BYTES", 4)
    monkeypatch.setattr(W, "KEPT_POWERS", 8)
    monkeypatch.setattr(W, "_powers", {})
    assert all((a == b).all() for a, b in zip(whole, [w.hashes(), w.hashes(lower=True)], strict=True))


@pytest.mark.parametrize("limit", [10**6, 5])
def test_all_matches_against_brute_force(spark, limit):
    """Every document against every item, whatever words they share: the same pairs and scores."""
    import re

    rng = __import__("random").Random(21)
    vocabulary = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 12])))) for i in range(12)] + [(50, None), (51, " -- ")]
    docs = []
    for i in range(40):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 6, 30]))]
        if i % 2:  # an item with edits inside
            own = items[i % 12][1].split()
            for _ in range(rng.choice([0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 else " ".join(w)))
    docs += [(None, docs[1][1]), (1, docs[1][1]), (99, None)]
    plain = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = []
    for d, t in docs:
        for k, x in items:
            a, b = plain(x), plain(t)
            if not a or not b:
                continue
            # items of one or two words match texts that are nothing else
            score = float(a == b) if len(a) <= 2 else brute_align(a, b) / (2 * len(a))
            if score >= 0.5:
                want.append((d, k, round(score, 9)))
    got = decontaminate.find_matches(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_grams=limit)
    same([(r.id, r.item, round(r.score, 9)) for r in got.collect()], want)
    assert len(want) > 20


def plain_sums(word, prob, unknown):
    """Sums over the segmentations of each beginning and each end of a word, in plain loops."""
    n = len(word)
    a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for e in range(1, n + 1):
        a[e] = a[e - 1] * unknown + sum(a[s] * prob[word[s:e]] for s in range(e) if word[s:e] in prob)
    for s in range(n - 1, -1, -1):
        b[s] = b[s + 1] * unknown + sum(b[e] * prob[word[s:e]] for e in range(s + 1, n + 1) if word[s:e] in prob)
    return a, b


def test_language_id_against_plain_em(spark):
    """The whole fit and prediction, on the real pieces, against plain expectation-maximisation."""
    learn = [("en", "the cat sat on the mat"), ("en", "The dog and the cat"), ("en", "a mat"), ("de", "die Katze saß auf der Matte"), ("de", "der Hund und die Katze")]
    asked = ["the dog sat", "der Hund saß", "Matte mat", "und", "12 !"]
    pieces = langid.read_pieces(langid.default_vocabulary())
    model = {}
    for lang in ("de", "en"):
        words = Counter(w for k, t in learn if k == lang for w in langid.text_words(t))
        prob = dict.fromkeys(pieces, 1 / len(pieces))
        for _ in range(langid.ROUNDS):
            total = dict.fromkeys(pieces, langid.SMOOTHING)
            for w, n in words.items():
                raw = ("▁" + w).encode()
                a, b = plain_sums(raw, prob, langid.UNKNOWN)
                for s in range(len(raw)):
                    for e in range(s + 1, len(raw) + 1):
                        if raw[s:e] in prob:
                            total[raw[s:e]] += n * a[s] * prob[raw[s:e]] * b[e] / a[-1]
            whole = sum(total.values())
            prob = {p: x / whole for p, x in total.items()}
        model[lang] = prob
    prior = {lang: sum(k == lang for k, _ in learn) / len(learn) for lang in model}
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(learn)], "doc_id bigint, text string, lang string")
    got = {r.row.text: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame([(t,) for t in asked], "text string"), langid.fit(df)).collect()}
    for t in asked:
        words = langid.text_words(t)
        if not words:
            assert got[t] == ("und", 0.0)
            continue
        logs = {k: math.log(prior[k]) + sum(math.log(plain_sums(("▁" + w).encode(), p, langid.UNKNOWN)[0][-1]) for w in words) for k, p in model.items()}
        best = max(logs, key=logs.get)
        assert got[t][0] == best and got[t][1] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), rel=1e-6)
