"""The rungs of a live stream: a query for each, on its own checkpoint; one that has failed stays out."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources import storage


class _Failures(StreamingQueryListener):
    """Writes down which rung ended with an error, and with which."""

    def __init__(self, rungs: Rungs):
        self.rungs = rungs

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        name = self.rungs.ids.get(str(event.id))
        if name and event.exception:
            self.rungs.mark(name, event.exception)


class Rungs:
    """STR-08, SNK-21: the outputs of a live stream, each a function that makes the writer of its own reading of the stream.

    Rungs neither wait for one another nor share state: each has a query on a checkpoint below ``path``. What ended a rung is written
    down there, and it isn't started again, as what it missed would be a hole in its output; ``forgive`` lets it go on
    from its checkpoint. When all rungs have failed, ``wait`` fails.
    """

    def __init__(self, spark: SparkSession, path: str, rungs: dict[str, Callable[[], Any]]):
        self.spark, self.path, self.rungs = spark, path, dict(rungs)
        self.ids: dict[str, str] = {}
        self.queries: dict[str, Any] = {}
        self._listener = _Failures(self)

    def mark(self, name: str, error: str) -> None:
        storage.put(f"{self.path}/{name}/failed", error.encode())

    def forgive(self, name: str) -> None:
        storage.drop(f"{self.path}/{name}/failed")

    @property
    def failed(self) -> dict[str, str]:
        """What ended each of the rungs that failed, in this run or before."""
        found = {name: storage.get(f"{self.path}/{name}/failed") for name in self.rungs}
        return {name: error.decode() for name, error in found.items() if error is not None}

    def start(self, **trigger: Any) -> Rungs:
        """A query for each rung that has not failed; ``trigger`` as in ``DataStreamWriter.trigger``, by default all there is now."""
        self.spark.streams.addListener(self._listener)
        dead = self.failed
        for name, writer in self.rungs.items():
            if name not in dead:
                query = writer().queryName(name).option("checkpointLocation", f"{self.path}/{name}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
                self.ids[str(query.id)] = name
                self.queries[name] = query
        return self

    def wait(self, seconds: float = 3600) -> None:
        """Until every query has ended, or for so long."""
        until = time.monotonic() + seconds
        for name, query in self.queries.items():
            try:
                query.awaitTermination(max(0.001, until - time.monotonic()))
            except Exception as e:  # what ends one rung must not end the others
                self.mark(name, str(e))
        self._done()

    def stop(self) -> None:
        for query in self.queries.values():
            query.stop()
        self._done()

    def _done(self) -> None:
        if not any(q.isActive for q in self.queries.values()):
            self.spark.streams.removeListener(self._listener)
        failed = self.failed
        if self.rungs and len(failed) == len(self.rungs):
            raise RuntimeError("every rung failed: " + "; ".join(f"{k}: {v.splitlines()[0]}" for k, v in failed.items()))
