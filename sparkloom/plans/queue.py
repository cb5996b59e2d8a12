"""Runs that wait for each other, and the calls that runs may have in flight together."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class CallSlots:
    """At most ``capacity`` calls in flight over all nodes and runs that share it; without one there is no bound.

    A node takes as many slots as it can use and are free, at least one, and
    gives them back when its calls are settled.  A thread that holds slots gets
    more only where some are free: it doesn't wait for itself.
    """

    def __init__(self, capacity: int | None = None):
        self.capacity, self.used, self.free = capacity, 0, threading.Condition()
        self.mine = threading.local()

    @contextmanager
    def taken(self, wanted: int) -> Iterator[int]:
        wanted, held = max(1, int(wanted)), getattr(self.mine, "held", 0)
        if self.capacity is None:
            yield wanted
            return
        with self.free:
            if held:
                # what is held already serves: the outer calls wait for the inner ones
                got, used = min(wanted, held), 0
            else:
                self.free.wait_for(lambda: self.used < self.capacity)
                got = used = min(wanted, self.capacity - self.used)
                self.used += used
        self.mine.held = held or got
        try:
            yield got
        finally:
            self.mine.held = held
            with self.free:
                self.used -= used
                self.free.notify_all()


@dataclass
class _Run:
    jobs: deque = field(default_factory=deque)
    stop: Callable[[], None] | None = None
    active: bool = False
    ended: threading.Event = field(default_factory=threading.Event)


class RunQueue:
    """Jobs of one run one after the other, those of different runs side by side.

    Each run has a driver thread and a scheduler pool of its own name, which
    share the cluster fairly where ``spark.scheduler.mode`` is FAIR.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.lock = spark, threading.Lock()
        self.runs: dict[str, _Run] = {}
        self.errors: dict[str, list[Exception]] = {}

    def submit(self, run: str, job: Callable[[], object], stop: Callable[[], None] | None = None) -> dict:
        """Queues a job; stop ends it while it runs.  Says whether it must wait, and for how many others."""
        with self.lock:
            own = self.runs.get(run)
            if new := own is None:
                own = self.runs[run] = _Run()
            position = len(own.jobs) + own.active
            own.jobs.append((job, stop))
            if new:
                InheritableThread(target=self._drain, args=(run, own), daemon=True).start()
        return {"queued": position > 0, "position": position}

    def _drain(self, run: str, own: _Run) -> None:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", run)
        while True:
            with self.lock:
                if not own.jobs:
                    self.runs.pop(run, None)
                    own.ended.set()
                    return
                job, own.stop = own.jobs.popleft()
                own.active = True
            try:
                job()
            except Exception as e:
                self.errors.setdefault(run, []).append(e)
            finally:
                with self.lock:
                    own.active, own.stop = False, None

    def cancel(self, run: str) -> None:
        """Forgets what waits and stops what runs."""
        with self.lock:
            own = self.runs.get(run)
            if own is None:
                return
            own.jobs.clear()
            stop = own.stop
        if stop:
            stop()

    def wait(self, run: str, timeout: float | None = None) -> bool:
        """Until a run has no job left; at once for one that is unknown or has ended."""
        with self.lock:
            own = self.runs.get(run)
        return own is None or own.ended.wait(timeout)
