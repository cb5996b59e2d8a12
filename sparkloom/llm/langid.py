"""Language ID by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary.  Each language has a
probability for each piece; the probability of a word is the sum over all its
segmentations into pieces, which a forward recursion over its bytes gives, and
the score of a text is the product over its words and the language's prior.
Piece probabilities are fitted by expectation-maximisation: forward and
backward sums give each piece's expected count over all segmentations.

Words are lower-cased maximal runs of letters, with a word mark in front, as in
the vocabulary.  A word is scored whole, however long it or its text is.  The
recursion runs for all distinct words of a slice at once: in plain numbers where
a word has too few bytes to underflow, in logarithms otherwise, and in stretches
that hand on their last sums where a word is very long; all three give the same.

Training takes at most ``TRAIN_ROWS`` texts of each language, those with the
least hashes of their ids; the prior counts all texts that could be learnt from.
A word longer than ``STRETCH`` bytes is learnt in stretches.  Scoring reads whole
texts of all rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows without a language, or with a null text, aren't learnt from; without any
training row every text is ``und``.  Rows that repeat each get a row.  Of equal
posteriors the language first by name wins.  Very long texts are scored whole,
with memory for the distinct words of a batch of texts.  Extra columns, whatever
their names, take no part; ``identify`` carries them in ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the training sample: texts for each language.
TRAIN_ROWS = 1000
#: Bound of the languages that are learnt; more are an error.
MAX_LANGS = 500
ROUNDS = 3
#: Added to each piece's expected count.
SMOOTHING = 0.05
#: Probability of a byte that no piece covers.
UNKNOWN = 1e-7
#: Words of up to so many bytes can't underflow: UNKNOWN ** PLAIN_BYTES is a normal number.
PLAIN_BYTES = 40
#: Places of a very long word that are worked on at once.
STRETCH = 1 << 16
#: Bounds of a group of words of like size: words, and bytes of their matrix.
GROUP_WORDS, GROUP_CELLS = 4000, 400_000
UND = "und"
_WORD = re.compile(r"[^\W\d_]+")
_MARK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Model:
    """Piece probabilities: prob[piece, language]; keys are the pieces' sorted hashes."""

    langs: list[str]
    prior: np.ndarray
    keys: np.ndarray
    prob: np.ndarray
    longest: int


_R = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def read_pieces(path: str) -> list[bytes]:
    """The lower-case pieces of letters, and all single bytes that a lower-case letter has."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = set()
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        body = p.removeprefix(_MARK)
        if (p == _MARK or (_WORD.fullmatch(body) and body == body.lower())) and _MARK not in body:
            pieces.add(p.encode())
    return sorted(pieces)


def piece_hash(p: bytes) -> int:
    h = 0
    for b in p:
        h = (h * int(_R) + int(_BYTE[b])) & (2**64 - 1)
    return h


def word_matrix(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of marked words, padded to the longest."""
    size = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(raw), int(size.max())), np.uint8)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    row = np.repeat(np.arange(len(raw)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


class Lattice:
    """Which piece, if any, stands at each place of each word: piece[n][start] for length n."""

    def __init__(self, raw: list[bytes], keys: np.ndarray, longest: int):
        self.text, self.size = word_matrix(raw)
        n, width = self.text.shape
        code = _BYTE[self.text]
        h = np.zeros((n, width), np.uint64)
        self.at: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in range(1, min(longest, width) + 1):
            m = width - length + 1
            h = h[:, :m] * _R + code[:, length - 1 : length - 1 + m]
            flat = h.ravel()
            i = np.searchsorted(keys, flat)
            i[i == len(keys)] = 0
            hit = (keys[i] == flat) & (np.arange(m)[None, :] + length <= self.size[:, None]).ravel()
            where = np.flatnonzero(hit)
            self.at.append((length, where // m, where % m, i[where]))
        # by end place, for the forward sums
        end = np.concatenate([s + k for k, _, s, _ in self.at])
        start = np.concatenate([s for _, _, s, _ in self.at])
        word = np.concatenate([w for _, w, _, _ in self.at])
        piece = np.concatenate([p for _, _, _, p in self.at])
        order = np.lexsort((word, end))
        self.start, self.word, self.piece = start[order], word[order], piece[order]
        self.bounds = np.searchsorted(end[order], np.arange(width + 2))
        self.end = end[order]

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[place, word, language]: the sum over segmentations of the first bytes."""
        n, width = self.text.shape
        a = np.zeros((width + 1, n, prob.shape[1]))
        a[0] = 1.0
        for e in range(1, width + 1):
            a[e] = a[e - 1] * UNKNOWN
            i, j = self.bounds[e], self.bounds[e + 1]
            if i < j:
                w = self.word[i:j]
                v = a[self.start[i:j], w] * prob[self.piece[i:j]]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                a[e, w[first]] += np.add.reduceat(v, first, axis=0)
        return a

    def log_forward(self, prob: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """The logarithms of forward(); with before, the sums at the first places are given."""
        n, width = self.text.shape
        begin = np.zeros((1, n, prob.shape[1])) if before is None else before
        a = np.concatenate([begin, np.zeros((width + 1 - len(begin), *begin.shape[1:]))])
        unknown = np.log(UNKNOWN)
        for e in range(len(begin), width + 1):
            a[e] = a[e - 1] + unknown
            i, j = self.bounds[e], self.bounds[e + 1]
            if i < j:
                w = self.word[i:j]
                # relative to the place before, from which no other place of a piece is far
                v = np.exp(a[self.start[i:j], w] - a[e - 1, w]) * prob[self.piece[i:j]]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                a[e, w[first]] = a[e - 1, w[first]] + np.log(UNKNOWN + np.add.reduceat(v, first, axis=0))
        return a

    def totals(self, prob: np.ndarray) -> np.ndarray:
        """The log of each word's probability in each language."""
        at = self.size, np.arange(len(self.size))
        return np.log(self.forward(prob)[at]) if self.text.shape[1] <= PLAIN_BYTES else self.log_forward(prob)[at]

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces; weight[word] counts its occurrences."""
        a = self.log_forward(prob[:, None])[:, :, 0]
        width = a.shape[0] - 1
        # b[place]: the log of the sum over segmentations of what follows, less that of the whole
        b = np.full_like(a, -np.inf)
        b[self.size, np.arange(len(self.size))] = -a[self.size, np.arange(len(self.size))]
        unknown = np.log(UNKNOWN)
        by_start = np.lexsort((self.word, self.start))
        start, word, piece, end = (x[by_start] for x in (self.start, self.word, self.piece, self.end))
        bounds = np.searchsorted(start, np.arange(width + 2))
        for p in range(width - 1, -1, -1):
            ends_here = self.size == p
            b[p] = np.where(ends_here, b[p], b[p + 1] + unknown)
            i, j = bounds[p], bounds[p + 1]
            if i < j:
                w = word[i:j]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                v = np.exp(b[end[i:j], w] - b[p, w]) * prob[piece[i:j]]
                b[p, w[first]] += np.log1p(np.add.reduceat(v, first))
        share = np.exp(a[self.start, self.word] + b[self.end, self.word]) * prob[self.piece] * weight[self.word]
        return np.bincount(self.piece, share, minlength=len(prob))


def long_total(raw: bytes, model_keys: np.ndarray, longest: int, prob: np.ndarray) -> np.ndarray:
    """totals() of one very long word: stretches hand on the sums of their last places."""
    last, at, scale = np.zeros((1, 1, prob.shape[1])), 0, np.zeros(prob.shape[1])
    while at < len(raw):
        begin = at - (len(last) - 1)
        a = Lattice([raw[begin : at + STRETCH]], model_keys, longest).log_forward(prob, last)
        at = min(at + STRETCH, len(raw))
        scale += a[-1, 0]
        last = a[-(longest + 1) :] - a[-1]
    return scale


def stretches(raw: bytes) -> Iterator[bytes]:
    """A word's bytes in parts of at most STRETCH bytes, cut between characters."""
    i = 0
    while i < len(raw):
        j = min(i + STRETCH, len(raw))
        while j < len(raw) and raw[j] & 0xC0 == 0x80:
            j -= 1
        yield raw[i:j]
        i = j


def text_words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def groups(raw: list[bytes]) -> Iterator[np.ndarray]:
    """Places of words of like size, few enough for one matrix."""
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        j = min(len(order), i + GROUP_WORDS)
        while j > i + 1 and (j - i) * size[order[j - 1]] > GROUP_CELLS:
            j = i + max(1, (j - i) // 2)
        yield order[i:j]
        i = j


def fit(df: DataFrame, lang: str = "lang", id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """Learns from at most train_rows texts of each language of df.

    The sample is bounded, so one task for each language fits it.  Languages are
    counted first; only rows whose hash is among about twice the sample's share
    are shuffled, so what meets in a language's task doesn't grow with the input.
    """
    path = vocabulary or default_vocabulary()
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")).alias("rank"), F.col(text).cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"there are more than {MAX_LANGS} languages")
    # the share of all hashes below which about twice train_rows texts of a language lie
    cuts = [x for k, n in counts.items() for x in (F.lit(k), F.lit(min(2 * train_rows * 2**64 // n, 2**64 - 1) - 2**63))]
    if cuts:
        rows = rows.where(F.col("rank") <= F.create_map(*cuts)[F.col("lang")])
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))).where(F.col("n") <= train_rows)

    def em(group: pd.DataFrame) -> pd.DataFrame:
        pieces = read_pieces(path)
        hashes = np.array([piece_hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        keys, longest = hashes[order], max(map(len, pieces))
        words: dict[str, int] = {}
        for t in group["text"]:
            for w in text_words(t):
                words[w] = words.get(w, 0) + 1
        prob = np.full(len(keys), 1 / len(keys))
        counted = [(x, n) for w, n in words.items() for x in stretches((_MARK + w).encode())]
        raw, weight = [x for x, _ in counted], np.array([n for _, n in counted], float)
        for _ in range(rounds if raw else 0):
            total = np.full(len(keys), SMOOTHING)
            for at in groups(raw):
                total += Lattice([raw[i] for i in at], keys, longest).expected(prob, weight[at])
            prob = total / total.sum()
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "n": [len(group)], "prob": [prob.tobytes()]})

    got = sorted(few.groupBy("lang").applyInPandas(em, "lang string, n long, prob binary").collect(), key=lambda r: r.lang)
    pieces = read_pieces(path)
    keys = np.sort(np.array([piece_hash(p) for p in pieces], np.uint64))
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two pieces share a hash")
    # all rows that could be learnt from count, not only the sampled ones
    prior = np.array([float(counts[r.lang]) for r in got])
    prob = np.stack([np.frombuffer(r.prob) for r in got], axis=1) if got else np.zeros((len(keys), 0))
    return Model([r.lang for r in got], prior / max(prior.sum(), 1), keys, prob, max(map(len, pieces)))


#: Words whose scores a worker keeps before it starts anew; without influence on results.
CACHE_WORDS = 200_000


def predictor(model: Model):
    """A function from texts to (predictions, posteriors) that keeps the scores of words."""
    known: dict[str, int] = {}
    scores = np.zeros((0, len(model.langs)))

    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        nonlocal scores
        if len(known) > CACHE_WORDS:
            known.clear()
            scores = scores[:0]
        index, counts, new = [], [], []
        for t in texts:
            words = text_words(t) if t else []
            at = []
            for w in words:
                i = known.get(w)
                if i is None:
                    i = known[w] = len(known)
                    new.append(w)
                at.append(i)
            index.append(np.array(at, np.int64))
            counts.append(len(at))
        parts = [scores]
        for i in range(0, len(new), 20_000):
            # words of like size together keep the matrices narrow
            parts.append(_score(new[i : i + 20_000], model))
        scores = np.concatenate(parts)
        n = np.array(counts)
        logp = np.zeros((len(texts), len(model.langs)))
        if n.sum() and model.langs:
            has = n > 0
            begin = (np.cumsum(n) - n)[has]
            logp[has] = np.add.reduceat(scores[np.concatenate(index)], begin, axis=0)
        logp += np.log(np.maximum(model.prior, 1e-12))
        if not model.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        top = logp.argmax(axis=1)
        post = 1 / np.exp(logp - logp.max(axis=1, keepdims=True)).sum(axis=1)
        return [model.langs[k] if c else UND for k, c in zip(top, counts, strict=True)], np.where(n > 0, post, 0.0)

    return predict


def _score(words: list[str], model: Model) -> np.ndarray:
    out = np.empty((len(words), len(model.langs)))
    raw = [(_MARK + w).encode() for w in words]
    for at in groups(raw):
        if len(at) == 1 and len(raw[at[0]]) > STRETCH:
            out[at[0]] = long_total(raw[at[0]], model.keys, model.longest, model.prob)
        else:
            out[at] = Lattice([raw[i] for i in at], model.keys, model.longest).totals(model.prob)
    return out


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df's rows as a struct ``row``, with lang_pred and score; a text travels once, within its row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a vocabulary of fixed size by the languages
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value)
        for b in batches:
            names, post = [], []
            texts = b.column(0).field(place)
            for r in range(0, b.num_rows, 200):
                got = predict(texts.slice(r, 200).cast(pa.string()).to_pylist())
                names += got[0]
                post.append(got[1])
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(post))], ["row", "lang_pred", "score"])

    rows = df.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def language_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fits on the rows that aren't held out and predicts all rows."""
    model = fit(df.where(F.coalesce(~held_out(id_col), F.lit(False))), lang, id_col, text)
    rows = df.select(F.col(id_col).alias(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    got = identify(rows, model)
    return got.select(F.col("row").getField(id_col).alias(id_col), F.col("row.held_out").alias("held_out"), "lang_pred", "score")
