"""Intake limits on a stream (T1, T3) as stateful processors; every row comes out with its reason.

State is kept per sender. A sender's rows of a micro-batch arrive in chunks in any order, so
their times are gathered first (16 bytes a row), numbered in the order ``(recv_ts, msg_id)``,
and the chunks are given out again with the numbers. Chunks beyond the first wait in list
state, which lies on disk, so a task holds one chunk of rows however hot the sender.

``refused`` is null, ``no_time``, ``late``, ``source_cap`` or ``request_cap``. A row is late if
it is more than ``late_seconds`` behind its sender's newest row of earlier micro-batches. A
sender that was silent for that long by the clock is forgotten by a timer; the watermark is
on the time of the micro-batch, which no row is behind, so Spark drops none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fwlog import vocab
from fwlog.operators.anchored import numbered

LATE_SECONDS = 3600


class Cap(StatefulProcessor):
    """Reasons for a sender's rows; subclasses keep the windows."""

    REASON: str

    def __init__(self, limit: int, seconds: int, late_seconds: int, start_micros: int = 0):
        self.names: list[str] = []
        self.limit, self.width, self.start = limit, seconds * 1_000_000, start_micros
        self.late, self.silence = late_seconds * 1_000_000, late_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, until long")
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def numbers(self, t: np.ndarray) -> np.ndarray:
        """Numbers within their windows, from 1, of sorted times; counted on in the state."""
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, until = self.newest.get()
        if until > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(until)
        else:
            self.newest.clear()
            self.forget()
        return iter(())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        thin, first = [], None
        for chunk in rows:
            chunk.columns = self.names  # names that are no Python names arrive as positions
            thin.append(chunk[["__micros", "__tie", "__now"]])
            if first is None:
                first = chunk
            else:
                self.waiting.appendValue((_packed(chunk),))
        if first is None:
            return
        reasons = self._reasons(pd.concat(thin, ignore_index=True))
        given, at = first, 0
        later = self.waiting.get() if len(thin) > 1 else iter(())
        while given is not None:
            out = given.drop(columns=["__micros", "__tie", "__now", "__seen"])
            out["refused"] = reasons[at:at + len(given)]
            at += len(given)
            yield out
            kept = next(later, None)
            given = None if kept is None else _unpacked(kept[0])
        if len(thin) > 1:
            self.waiting.clear()

    def _reasons(self, thin: pd.DataFrame) -> np.ndarray:
        timed = thin["__micros"].notna().to_numpy()
        t = thin["__micros"].fillna(0).astype("int64").to_numpy()
        before = self.newest.get()
        reasons = np.full(len(t), None, object)
        reasons[~timed] = "no_time"
        late = timed & (t < before[0] - self.late) if before is not None else np.zeros(len(t), bool)
        reasons[late] = "late"
        counted = np.flatnonzero(timed & ~late)
        if len(counted):
            order = counted[np.lexsort((thin["__tie"].to_numpy()[counted], t[counted]))]
            over = self.numbers(t[order]) > self.limit
            reasons[order[over]] = self.REASON
            newest, until = int(t[order[-1]]), int(thin["__now"].iloc[0]) + self.silence
            if before is None:
                self.handle.registerTimer(until)
            self.newest.update((newest if before is None else max(newest, before[0]), until))
        return reasons

    def close(self) -> None:
        pass


class TumblingCap(Cap):
    """Windows of fixed places: rows so far by window, for windows that are not late."""

    REASON = "source_cap"

    def open(self, handle):
        self.used = handle.getValueState("used", "windows array<long>, rows array<long>")

    def forget(self):
        self.used.clear()

    def numbers(self, t):
        windows, first, sizes = np.unique((t - self.start) // self.width, return_index=True, return_counts=True)
        used = dict(zip(*(self.used.get() or ([], []))))
        before = np.array([used.get(w, 0) for w in windows.tolist()])
        used.update(zip(windows.tolist(), (before + sizes).tolist()))
        oldest = (max(used) * self.width - self.late) // self.width
        kept = {w: n for w, n in used.items() if w >= oldest}
        self.used.update((list(kept), list(kept.values())))
        return np.arange(1, len(t) + 1) - np.repeat(first - before, sizes)


class AnchoredCap(Cap):
    """Windows anchored at the sender's rows: the last anchor and its rows so far."""

    REASON = "request_cap"

    def open(self, handle):
        self.window = handle.getValueState("window", "anchor long, rows long")

    def forget(self):
        self.window.clear()

    def numbers(self, t):
        before = self.window.get()
        state = None if before is None else ("", *before)
        counts, state = numbered(pa.array([""]).take(pa.array(np.zeros(len(t), np.int64))), t, state, self.width)
        self.window.update(state[1:])
        return counts


def _packed(chunk: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(chunk, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_pandas()


def _limited(df: DataFrame, processor: Cap, source: str, ts: str, tie: str) -> DataFrame:
    processor.names = [*df.columns, "__micros", "__tie", "__now", "__seen"]
    now = F.current_timestamp()
    keyed = df.select(
        "*", F.unix_micros(ts).alias("__micros"), F.col(tie).alias("__tie"), F.unix_millis(now).alias("__now"), now.alias("__seen"))
    out = T.StructType([*df.schema.fields, T.StructField("refused", T.StringType())])
    marked = keyed.withWatermark("__seen", "0 seconds")
    return marked.groupBy(source).transformWithStateInPandas(processor, out, "Append", "EventTime")


def tumbling_reasons_stream(
    df: DataFrame, per_source: int = vocab.SOURCE_CAP, seconds: int = vocab.SOURCE_CAP_SECONDS, start_micros: int = 0,
    late_seconds: int = LATE_SECONDS, source: str = "client_ip", ts: str = "recv_ts", tie: str = "msg_id",
) -> DataFrame:
    """Every row with ``refused``: over ``per_source`` rows of a sender in a tumbling window."""
    return _limited(df, TumblingCap(per_source, seconds, late_seconds, start_micros), source, ts, tie)


def anchored_reasons_stream(
    df: DataFrame, limit: int = vocab.REQUEST_CAP, seconds: int = vocab.REQUEST_CAP_SECONDS,
    late_seconds: int = LATE_SECONDS, source: str = "client_ip", ts: str = "recv_ts", tie: str = "msg_id",
) -> DataFrame:
    """Every row with ``refused``: over ``limit`` rows of a sender in a window anchored at its first row."""
    return _limited(df, AnchoredCap(limit, seconds, late_seconds), source, ts, tie)


def admitted(reasons: DataFrame) -> DataFrame:
    return reasons.filter(F.col("refused").isNull()).drop("refused")


def admit_tumbling_stream(df: DataFrame, *args, **options) -> DataFrame:
    """First rows of a sender per tumbling window; options as in `tumbling_reasons_stream`."""
    return admitted(tumbling_reasons_stream(df, *args, **options))


def admit_anchored_stream(df: DataFrame, *args, **options) -> DataFrame:
    """First rows of a sender per anchored window; options as in `anchored_reasons_stream`."""
    return admitted(anchored_reasons_stream(df, *args, **options))
