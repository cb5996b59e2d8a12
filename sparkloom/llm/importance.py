"""Target-distribution importance resampling: word features hashed to buckets, gains per bucket, Gumbel draws.

1. Each partition keeps a trie of its words: a node is a run of words, with the
   number of its occurrences and the state of the CRC of its UTF-8 bytes, so a
   longer run goes on from its parent's state and hashes only its last word.
   When the trie has ``MAX_NODES`` nodes its counts are added to the partition's
   bucket totals and it starts anew, so memory is bounded and no run is lost.
2. Bucket totals of all partitions are summed; the driver sees BUCKETS numbers.
3. A bucket's gain is 1000 times the log ratio of its smoothed shares of the
   target and of the corpus, rounded down.
4. Documents are scored by walking a trie again, whose nodes carry the gain of
   their bucket.
5. The score is the weight and a Gumbel number drawn from a hash of the id, so
   that the highest scores are a draw without replacement in proportion to the
   exponential of the weight.  Ranks come from a range-partitioned sort and the
   counts of its ranges; no task or driver sees all scores.

Defined cases: a null text has no features, weight 0 and no words; it counts for
the draw only where ``min_words`` is 0.  A null id is hashed as an empty one and
comes first among ties, rows that share an id are ordered by their features and
weight.  Empty tables give an empty result; an empty target has no counts and is
smoothed all the same.  A very long text is walked whole by one task.  Extra
columns take no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored, temporary
from .words import text_buffers

BUCKETS = 10_000
#: Words of a feature at most.
LENGTH = 1
#: Draw so many of a hundred documents with at least so many words.
PERCENT, MIN_WORDS = 10, 20
SEED = "2024"
#: Nodes of a trie at most; some 300 bytes each.
MAX_NODES = 200_000

#: For bytes.translate: lower-case letters, digits and bytes over 0x7F stay, A-Z are lower-cased, the rest parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: A node: what it carries (occurrences, or the gain), the CRC of its run, the nodes of runs longer by a word.
Node = list


class Trie:
    """Runs of up to ``length`` words; ``value`` gives what a new node carries, from the CRC of its run."""

    def __init__(self, length: int, value: Callable[[int], int]):
        self.length, self.value = length, value
        self.clear()

    def clear(self) -> None:
        self.root: Node = [0, 0, {}]
        self.nodes: list[Node] = []

    def longer(self, node: Node, word: bytes) -> Node:
        crc = crc32(word, crc32(b" ", node[1])) if node is not self.root else crc32(word)
        made = node[2][word] = [self.value(crc), crc, {}]
        self.nodes.append(made)
        return made

    def runs(self, words: list[bytes], start: int, count: int) -> Iterator[Node]:
        """The nodes of runs that begin at one of ``count`` words from start on, one for each occurrence."""
        for i in range(start, min(start + count, len(words))):
            node = self.root
            for w in words[i : i + self.length]:
                node = node[2].get(w) or self.longer(node, w)
                yield node


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def _texts(col: pa.Array) -> Iterator[bytes]:
    data, offsets = text_buffers(col)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b].tobytes()


def _count(length: int, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(length, lambda crc: 0), np.zeros(buckets, np.int64)

        def merge() -> None:
            np.add.at(totals, [n[1] % buckets for n in trie.nodes], [n[0] for n in trie.nodes])
            trie.clear()

        for b in batches:
            for raw in _texts(b.column(0)):
                words = words_of(raw)
                # a stretch of words at a time, so that one text can't outgrow the bound either
                for i in range(0, len(words), most):
                    for node in trie.runs(words, i, most):
                        node[0] += 1
                    if len(trie.nodes) > most:
                        merge()
        merge()
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], ["bucket", "n"])

    return run


def bucket_counts(df: DataFrame, text: str = "text", length: int = LENGTH, buckets: int = BUCKETS, max_nodes: int = MAX_NODES) -> np.ndarray:
    """The features of all texts in each bucket."""
    got = df.select(F.col(text).cast("string").alias("text")).mapInArrow(_count(length, buckets, max_nodes), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in got.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Each bucket's log ratio of target and corpus, in thousandths, rounded down."""
    k = len(corpus)
    s_all, t_all = float(corpus.sum() + k), float(target.sum() + k)
    return [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def _score(length: int, gains: list[int], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(length, lambda crc: gains[crc % len(gains)])
        for b in batches:
            words, features, weights = [], [], []
            for raw in _texts(b.column(1)):
                found, n, weight = words_of(raw), 0, 0
                for i in range(0, len(found), most):
                    for node in trie.runs(found, i, most):
                        weight += node[0]
                        n += 1
                    if len(trie.nodes) > most:
                        trie.clear()
                words.append(len(found))
                features.append(n)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights))], ["id", "n_words", "n_features", "weight"])

    return run


def weights(df: DataFrame, gains: list[int], id_col: str = "doc_id", text: str = "text", length: int = LENGTH, max_nodes: int = MAX_NODES) -> DataFrame:
    """(id, n_words, n_features, weight) of each document."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(length, gains, max_nodes), f"id {kind}, n_words long, n_features long, weight long")


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their rank from 1; ranges of the order are sorted apart and begin where the ones before end."""
    keys = [F.col(c).desc() if c == "score" else F.col(c).asc() for c in order]
    sorted_rows = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    counts = sorted_rows.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    # one row a range
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return sorted_rows.join(F.broadcast(starts), F.shiftright("_m", 33) == F.col("_p")).select(*rows.columns, (F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, buckets: int = BUCKETS, percent: int = PERCENT,
    min_words: int = MIN_WORDS, seed: str = SEED, max_nodes: int = MAX_NODES
) -> DataFrame:
    """(id, n_features, weight, score, rank) of each document; rank is null where it isn't drawn."""
    gains = bucket_gains(bucket_counts(df, text, length, buckets, max_nodes), bucket_counts(target, text, length, buckets, max_nodes))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    with temporary(df.sparkSession) as made:
        scored = made.keep(weights(df, gains, id_col, text, length, max_nodes).withColumn("score", F.col("weight") + gumbel), "scored")
        able = F.col("n_words") >= min_words
        n = scored.where(able).count()
        ranks = made.keep(_ranked(scored.where(able), ["score", "id", "n_features", "weight"]), "ranks")
    out = ranks.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank"))).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
