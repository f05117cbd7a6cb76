"""Live updates by Structured Streaming: file events to committed revisions."""

from __future__ import annotations

import os
import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import deletions, diff
from ..operators.ids import saved
from ..sources import files
from ..sources.store import Store

EVENT = "path string, kind string, at timestamp"
RECONCILE, VECTORS = 30.0, 0.5


class Stopped(RuntimeError):
    """A batch that came after stop() or pause(): it is not acknowledged, so it comes again."""


def coalesced(batch: DataFrame) -> DataFrame:
    """The last event of each path of a micro-batch; later time wins."""
    return batch.where("path IS NOT NULL").groupBy("path").agg(F.max_by("kind", "at").alias("kind"))


class Every(threading.Thread):
    """Calls something at a pace until it is told to end; what goes wrong is told and does not end it."""

    def __init__(self, seconds: float, call: Callable[[], object], wrong: Callable[[Exception], None]):
        super().__init__(daemon=True)
        self.seconds, self.call, self.wrong, self.over = seconds, call, wrong, threading.Event()

    def run(self) -> None:
        while not self.over.wait(self.seconds):
            try:
                self.call()
            except Exception as e:
                self.wrong(e)

    def end(self) -> None:
        self.over.set()


class Live:
    """Applies batches of events, compares the whole scope with the index every `reconcile` seconds, and reads again what changed while it was read."""

    def __init__(self, spark: SparkSession, store: Store, roots: list[str], patterns: list[str] | None = None, reconcile: float = RECONCILE, changed: Callable[[int], None] | None = None):
        self.spark, self.store, self.roots, self.patterns = spark, store, files.distinct_roots(roots), patterns or []
        self.seconds, self.changed, self.generation, self.pending = reconcile, changed, 0, 0
        self.errors: deque[str] = deque(maxlen=20)
        self.unstable: set[str] = set()
        self.whole = False
        self.state, self.query, self.timer, self.one = "idle", None, None, threading.RLock()
        self._again: tuple | None = None

    def status(self) -> dict:
        return {"state": self.state, "pending": self.pending + len(self.unstable), "generation": self.generation, "errors": list(self.errors)}

    def _wrong(self, e: Exception) -> None:
        self.errors.append(f"{type(e).__name__}: {e}"[:300])

    def _commit(self, before: int, after: int) -> None:
        if after != before:
            self.generation += 1
            if self.changed:
                self.changed(after)

    def apply(self, batch: DataFrame, _id: int = 0) -> None:
        """Upsert what exists of the named paths, delete what does not; a folder among them asks for a comparison of the whole scope."""
        with self.one:
            if self.state in ("stopped", "paused"):
                raise Stopped(self.state)
            # a few paths come to the driver; of more only that there are so many
            named = [r["path"] for r in coalesced(batch).limit(files.NAMED + 1).collect()]
            self.pending = len(named)
            try:
                if self.whole or len(named) > files.NAMED or any(os.path.isdir(p) for p in named):
                    self.reconcile()
                elif named or self.unstable:
                    self._update(sorted({*named, *self.unstable}))
            except Exception as e:
                self._wrong(e)
                raise
            finally:
                self.pending = 0

    def _update(self, paths: list[str]) -> None:
        before = self.store.revision
        rows = saved(files.parsed(files.listed(self.spark, paths, self.roots, self.patterns, content=True)))
        # a file that changed while it was read is left for the next time
        now = files.listed(self.spark, paths, self.roots, self.patterns)
        same = rows.join(now.select("path", F.col("mtime").alias("_m"), F.col("file_size").alias("_s")), "path").where("abs(mtime - _m) <= 0.001 and file_size = _s").drop("_m", "_s")
        self.unstable = {r[0] for r in rows.join(same.select("path"), "path", "left_anti").select("path").collect() if os.path.exists(r[0])}
        # what is gone with its whole root is not deleted
        good = files.available(self.roots)[0]
        gone = [p for p in paths if not os.path.exists(p) and any(p.startswith(r.rstrip("/") + "/") for r in good)]
        lost = self.spark.createDataFrame([(p,) for p in gone], "path string") if gone else None
        self._commit(before, self.store.upsert(same, time.time(), lost))

    def reconcile(self) -> dict:
        """Scan and index compared: new and changed files are parsed, vanished ones deleted unless their root is unavailable."""
        with self.one:
            before = self.store.revision
            good, unavailable = files.available(self.roots)
            scanned = files.scan(self.spark, good, self.patterns)
            change = saved(diff(scanned, self.store.table("documents")))
            fresh = files.contents(self.spark, change.where(F.col("change").isin("new", "changed")), good, self.patterns)
            gone = deletions(change, unavailable)
            counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
            self._commit(before, self.store.upsert(files.parsed(fresh), time.time(), gone))
            self.whole, self.unstable = False, set()
        return {"indexed": counts.get("new", 0) + counts.get("changed", 0), "deleted": counts.get("deleted", 0) if not unavailable else None, "scanned": sum(v for k, v in counts.items() if k != "deleted"), "unavailable_directories": unavailable}

    def configure(self, roots: list[str], patterns: list[str] | None = None) -> None:
        """Other folders or exclusions: what runs is let end first, what comes is judged by the new ones, and the whole scope is compared next."""
        with self.one:
            self.roots, self.patterns, self.whole = files.distinct_roots(roots), patterns or [], True

    def start(self, events: DataFrame, checkpoint: str, every: str | None = "350 milliseconds") -> StreamingQuery:
        """events: a stream with path, kind and at. every: the pause that gathers bursts; None takes what is there and ends."""
        self._again = (events, checkpoint, every)
        self.state = "watching"
        writer = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        if every and self.seconds:
            self.timer = Every(self.seconds, self.reconcile, self._wrong)
            self.timer.start()
        return self.query

    def _halt(self, state: str) -> None:
        self.state = state
        if self.timer is not None:
            self.timer.end()
        if self.query is not None and self.query.isActive:
            self.query.stop()

    def pause(self) -> None:
        """The stream ends; events that come meanwhile wait."""
        self._halt("paused")

    def resume(self) -> StreamingQuery:
        """From where the stream was paused."""
        if self._again is None:
            raise RuntimeError("it was not started")
        return self.start(*self._again)

    def stop(self) -> None:
        """The stream ends; a batch that is not done stays unacknowledged."""
        self._halt("stopped")


class VectorUpkeep:
    """Vectors follow the index: whenever its revision is not the one the vectors were made from, the missing ones are encoded and published."""

    def __init__(self, store: Store, build: Callable[[], int], seconds: float = VECTORS):
        self.store, self.build, self.errors = store, build, deque(maxlen=20)
        self.timer = Every(seconds, self.once, lambda e: self.errors.append(f"{type(e).__name__}: {e}"[:300]))

    def once(self) -> bool:
        """Whether vectors were published. An index that changes meanwhile is tried again next time."""
        state = self.store.state
        if state["vector_revision"] == state["revision"]:
            return False
        self.build()
        return True

    def start(self) -> None:
        self.timer.start()

    def stop(self) -> None:
        self.timer.end()


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of event files (JSON lines)."""
    return spark.readStream.schema(EVENT).json(folder)


def bursts(events: DataFrame, pause: str = "1 second", late: str = "1 hour") -> DataFrame:
    """A stream of bursts per path: session windows with a watermark, late events up to `late` are counted."""
    return events.withWatermark("at", late).groupBy("path", F.session_window("at", pause)).agg(F.count("*").alias("events"), F.max_by("kind", "at").alias("last_kind")).select("path", F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("closed_at"), "events", "last_kind")


def change_rates(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """A stream of counts per kind and window of event time."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "kind").agg(F.count("*").alias("events")).select(F.col("window.start").alias("from"), "kind", "events")
