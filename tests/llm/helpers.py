"""Small documents with the awkward cases, and slow plain versions of the operators."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row string, th string, `_id` string, kept string, node bigint"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def corpus(seed=5, n=60):
    """Rows (doc_id, text): copies, near copies, shared passages, repeats, odd spaces and letters."""
    rng = random.Random(seed)
    shared = prose(rng, 70)
    base = prose(rng, 120)
    out = []
    for i in range(n):
        kind = i % 10
        w = prose(rng, rng.choice([1, 4, 5, 34, 35, 36, 90, 200]))
        if kind == 1:
            w = base[:]
        elif kind == 2:
            w = base[:]
            for _ in range(rng.choice([1, 2, 6])):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
        elif kind == 3:
            w = w + shared[: rng.choice([34, 35, 50, 70])] + prose(rng, 20)
        elif kind == 4:
            w = w + w
        elif kind == 5:
            w = ["Été", "ÀÉ", "naïve", "it's", "#", "$1", "|"] + w
        out.append((i, rng.choice([" ", "\n", "\t ", "  ", "\x1c ", "\r\n"]).join(w)))
    return out + [
        (1000, None), (1001, ""), (1002, " \n\t"), (1003, "tiny"), (1004, "a " * 300), (1005, "a " * 300), (None, " ".join(base)), (7, out[7][1]),
        (7, out[7][1]), (8, "another text under a used id")
    ]


def frame(spark, rows, partitions=3):
    full = [(i, t, None if i is None or i % 9 == 0 else ("aa" if i % 2 else "bb"), None, None, "clash", "clash", "clash", "clash", "clash", 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def shingles(text, k=5):
    w = words(lower(text))
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(rows, percent=85):
    """For each row, the least id that its set reaches; ids aren't links."""
    return _groups(rows, percent)[0]


def group_numbers(rows, percent=85):
    """For each row, a number of its component."""
    return _groups(rows, percent)[1]


def _groups(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [None if d is None else least[find(i)] for i, (d, _) in enumerate(rows)], [find(i) for i in range(len(rows))]


def repeated_cover(rows, k=35):
    """For each row, which words a repeated window of k covers."""
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in texts for i in range(len(w) - k + 1))
    out = []
    for w in texts:
        cover = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                cover[i : i + k] = [True] * k
        out.append(cover)
    return out
