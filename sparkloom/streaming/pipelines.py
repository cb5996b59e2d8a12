"""Table operations, keep-first duplicates, sessions and windows over streams.  An addition: batch pipelines are the core.

Operations that look at one row act on the stream itself.  Duplicates are kept
out by state, a value for each key, so they are found across micro-batches.
What needs all rows at once (samples, shuffles, whole-table code) is refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sparkloom.functions.values import col
from sparkloom.operators.order import POS, visible, with_positions
from sparkloom.operators.table import apply_operations

#: Operations that see one row at a time.
ROW_OPERATIONS = frozenset({"rename", "drop", "concat", "cast", "filter"})
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeepFirst(StatefulProcessor):
    """Gives the first row of each key, in order, and none for a key that came before.

    With keep (milliseconds of event time) a timer forgets a key so long after
    its row; later rows of the key then count as new.
    """

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            for _ in rows:
                pass
            return
        first, place = None, None
        for part in rows:
            orders = [tuple(p) for p in part["place"]]
            i = min(range(len(orders)), key=orders.__getitem__)
            if place is None or orders[i] < place:
                first, place = part.iloc[[i]], orders[i]
        self.seen.update((0,))
        if self.keep is not None:
            self.handle.registerTimer(max(0, timerValues.getCurrentWatermarkInMs()) + self.keep)
        yield first

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def keep_first(stream: DataFrame, columns: Sequence[str], keep_ms: int | None = None) -> DataFrame:
    """The first row of each key of a stream with positions, across micro-batches; keep_ms needs a watermark."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    # the frames that a processor gets have names only where these are identifiers
    short = {c: "place" if c == POS else f"c{i}" for i, c in enumerate(stream.columns)}
    named = stream.select(*(col(c).alias(n) for c, n in short.items()))
    first = named.groupBy(*(short[c] for c in columns)).transformWithStateInPandas(KeepFirst(keep_ms), named.schema, "Append", "None" if keep_ms is None else "EventTime")
    return first.toDF(*stream.columns)


def over_stream(source: DataFrame, operations: Sequence[dict], order: str | None = None) -> DataFrame:
    """The operations over a stream; dedup needs a whole-number column that orders the rows."""
    stream = source if POS in source.columns or order is None else with_positions(source, order)
    for op in operations:
        if op.get("op") == "dedup":
            if POS not in stream.columns:
                raise ValueError("dedup on a stream needs an order")
            stream = keep_first(stream, op.get("columns") or [c for c in stream.columns if c != POS])
        elif op.get("op") in ROW_OPERATIONS:
            stream = apply_operations(stream, [op])
        else:
            raise ValueError(f"{op.get('op')!r} needs all rows and can't act on a stream")
    return stream


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch, once, to path/batch=id, until what is there has been read."""

    def each(batch: DataFrame, number: int) -> None:
        # a batch that runs again overwrites its own folder
        visible(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_stream(source: DataFrame, operations: Sequence[dict], path: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    return append_batches(over_stream(source, operations, order), path, checkpoint)


def windowed_counts(source: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Rows by tumbling window and keys; events later than the watermark are left out."""
    return source.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(source: DataFrame, time: str, late: str, keys: Sequence[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return source.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
