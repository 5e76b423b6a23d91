"""Counters of running streams (T5, A9): observed at a job's end, added up by a listener."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from fwlog.operators.parse import parser_counters
from fwlog.functions.render import formatter_counters

PARSER, FORMATTER = "parser", "formatter"


def counted(translated: DataFrame) -> DataFrame:
    """The last step of a streaming translation: its counters go to the listeners."""
    return translated.observe(PARSER, *parser_counters()).observe(FORMATTER, *formatter_counters())


class CounterListener(StreamingQueryListener):
    """Running totals by component; a batch that is run again after a restart counts once.

    ``totals`` is kept by this driver. A new listener of the same query goes on from the
    batch and the totals it is given.
    """

    def __init__(self, totals: dict[str, dict[str, int]] | None = None, last_batch: dict[str, int] | None = None):
        self._lock = threading.Lock()
        self._totals = {name: Counter(counts) for name, counts in (totals or {}).items()}
        self._last = dict(last_batch or {})

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        query = str(progress.id)
        with self._lock:
            if not progress.observedMetrics or progress.batchId <= self._last.get(query, -1):
                return
            self._last[query] = progress.batchId
            for name, row in progress.observedMetrics.items():
                self._totals.setdefault(name, Counter()).update(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def last_batch(self) -> dict[str, int]:
        with self._lock:
            return dict(self._last)

    @property
    def totals(self) -> dict[str, dict[str, int]]:
        with self._lock:
            return {name: dict(counts) for name, counts in self._totals.items()}

    def rows(self, spark: SparkSession) -> DataFrame:
        """``component metric value`` so far."""
        found = [(name, metric, int(n)) for name, counts in sorted(self.totals.items()) for metric, n in sorted(counts.items())]
        return spark.createDataFrame(found, "component string, metric string, value long")
