"""Step events: what a stream or a build by parts has done so far, told while it runs.

Measures are observed as the rows pass (`observe`), so a step costs no pass of its own, and what is built is the same with or without a listener.
"""

from __future__ import annotations

import queue
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Steps(StreamingQueryListener):
    """Puts the observed measures of each batch, and the end, of one query on a queue."""

    def __init__(self, name: str) -> None:
        self.name, self.events, self.run = name, queue.Queue(), None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.events.put(("step", str(event.progress.runId), event.progress.batchId, found.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.events.put(("end", str(event.runId), None, event.exception))


def stepped(stream: DataFrame, name: str, measures: dict[str, Column], start: Callable[[DataFrame], StreamingQuery]) -> Iterator[dict[str, Any]]:
    """Events of a stream in the order of its batches, while it runs: step (the batch) and the measures of its rows. start starts a query on the stream it is given.

    A batch without rows gives no step; a query that fails raises after the steps that were done. A caller that stops listening stops the query."""
    spark = stream.sparkSession
    heard = Steps(name)
    spark.streams.addListener(heard)
    query = None
    try:
        query = start(stream.observe(name, *[c.alias(n) for n, c in measures.items()]))
        run, last = str(query.runId), -1
        while True:
            kind, of, step, told = heard.events.get()
            if of != run:
                continue
            if kind == "end":
                if told:
                    raise RuntimeError(f"the stream ended after step {last}: {told}")
                return
            if step > last:  # progress without new rows repeats the batch
                last = step
                yield {"step": step, **told}
    finally:
        spark.streams.removeListener(heard)
        if query is not None and query.isActive:
            query.stop()


def built(parts: Iterator[tuple[Any, DataFrame]], measures: dict[str, Column], write: Callable[[Any, DataFrame], None]) -> Iterator[dict[str, Any]]:
    """Events of a build by parts: each part (its name and rows) is written by `write`, and the measures of the rows that passed are told: step, part and measures. A part that is not asked for is not built."""
    for step, (part, rows) in enumerate(parts):
        seen = Observation(f"part {step}")
        write(part, rows.observe(seen, *[c.alias(n) for n, c in measures.items()]))
        yield {"step": step, "part": part, **seen.get}
