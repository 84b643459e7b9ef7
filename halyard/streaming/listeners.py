"""Callbacks on the progress of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class ProgressListener(StreamingQueryListener):
    """Calls back after each micro-batch with the stream's name, the batch's number and its rows, and once more, with -1 rows, when it ends.

    Register it with ``spark.streams.addListener``. Calls come from one thread, in order for each stream.
    """

    def __init__(self, callback: Callable[[str | None, int, int], None]):
        self.callback = callback
        self._names: dict[str, str | None] = {}
        self._last: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._last[str(p.id)] = p.batchId
        self.callback(p.name, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        key = str(event.id)
        self.callback(self._names.pop(key, None), self._last.pop(key, -1), -1)
