"""Generation without an input: batches of seeds until enough rows are accepted."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.session import settled

from .enrich import seeds
from .order import POS
from .table import limit

#: Seeds of a batch at most.
BATCH_SEEDS = 500
#: Batches in a row without an accepted row after which a loop gives up.
IDLE_BATCHES = 20


class Shortfall(RuntimeError):
    """A generation loop that ended before it had enough rows."""


@dataclass
class Yield:
    """What seeds have brought so far; before any are spent, one is taken to bring its fan-out."""

    fanout: int
    seeds: int = 0
    rows: int = 0
    idle: int = 0

    def spend(self, seeds: int, rows: int) -> None:
        self.seeds += seeds
        self.rows += rows
        self.idle = 0 if rows else self.idle + 1

    def needed(self, missing: int) -> int:
        """Seeds that should bring the missing rows, by the mean of what was seen and one seed of full yield."""
        return max(1, math.ceil(missing * (self.seeds + 1) / (self.rows + self.fanout)))


def generate(
    spark: SparkSession, count: int, synth: Callable[[DataFrame, int], DataFrame], middle: Callable[[DataFrame, int], DataFrame] = lambda d, _: d, fanout: int = 1,
    batch_seeds: int = BATCH_SEEDS, idle_batches: int = IDLE_BATCHES, max_batches: int | None = None,
) -> DataFrame:
    """count rows from synth(seeds, batch) and what middle(rows, batch) lets pass.

    The loop goes on as long as rows are accepted.  It ends with a Shortfall
    after idle_batches batches in a row without any, or after max_batches where
    that is given; what was accepted is never returned as if it were all.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    seen, kept = Yield(fanout), []
    while seen.rows < count:
        batch = len(kept)
        if seen.idle >= idle_batches or (max_batches is not None and batch >= max_batches):
            raise Shortfall(f"{seen.rows} of {count} rows were accepted in {batch} batches of {seen.seeds} seeds")
        n = min(seen.needed(count - seen.rows), batch_seeds)
        good = settled(middle(settled(synth(seeds(spark, n, seen.seeds), batch)), batch))
        kept.append(good)
        seen.spend(n, good.count())
    return limit(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept), count)


def is_linear(kinds: list[str]) -> bool:
    """Whether a chain of node kinds can generate: synth first, output last, table or judge nodes between."""
    return len(kinds) >= 2 and kinds[0] == "llm_synth" and kinds[-1] == "output" and set(kinds[1:-1]) <= {"auto_process", "qc"}


def seed_trace(run: str, node: str) -> F.Column:
    return F.concat(F.lit(f"run{run}:{node}:"), F.array_join(F.transform(POS, lambda x: x.cast("string")), "."))
