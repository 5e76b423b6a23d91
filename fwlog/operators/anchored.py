"""The request cap whose windows are anchored at a sender's own rows.

An anchor is the first row of a sender at least one width after the previous anchor, so
anchors form a chain per sender. The rows are range-partitioned and sorted by (sender, time,
tie): a hot sender fills many partitions, and every partition holds a stretch of the order.
What the rows before a stretch mean to it is one state (sender, anchor, rows so far), and a
stretch is a function from the state it is entered with to the state it is left with:

* a stretch with several senders forgets how it was entered;
* a stretch of one sender is a step function of the moment from which a new anchor may come.

Such functions compose to functions of the same kind. They are combined level by level, FAN
neighbours at a time, and the states are handed down the same tree, so no task sees more
than one stretch of rows or FAN functions. With its state, a partition numbers its rows batch
by batch. The rows are shuffled once and written to the shared checkpoint folder, so that
both passes over them see the same stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fwlog.session import checkpointed

#: Functions combined by one task.
FAN = 64

#: (sender, anchor, rows of that window so far)
State = tuple[str, int, int]

_STRETCH = (
    "part long, first string, last string, start long, rows long, until array<long>, "
    "exits array<long>, counts array<long>"
)
_ENTRY = "part long, sender string, anchor long, used long"


@dataclass
class Stretch:
    """How rows in the order (sender, time) turn the state before them into the one after them.

    ``until``, ``exits`` and ``counts`` are the steps: entered so that a new anchor may come
    from x, the first step with ``until >= x`` tells the last anchor and the rows since then;
    past all steps no row starts a window. A stretch of several senders has one step.
    """

    first: str
    last: str
    start: int
    rows: int
    until: np.ndarray
    exits: np.ndarray
    counts: np.ndarray

    @property
    def single(self) -> bool:
        return self.first == self.last

    def after(self, state: State | None, width: int) -> State:
        if state is None or state[0] != self.first:
            return self.last, int(self.exits[0]), int(self.counts[0])
        if not self.single:
            return self.last, int(self.exits[0]), int(self.counts[0])
        step = int(np.searchsorted(self.until, state[1] + width))
        if step < len(self.until):
            return self.last, int(self.exits[step]), int(self.counts[step])
        return self.last, state[1], state[2] + self.rows

    def then(self, other: Stretch, width: int) -> Stretch:
        if not (self.single and other.single and self.first == other.first):
            # whatever comes in, the state after both is the same
            _, anchor, used = other.after(self.after(None, width), width)
            return Stretch(self.first, other.last, self.start, 0, *(np.array([x], np.int64) for x in (self.start, anchor, used)))
        step = np.searchsorted(other.until, self.exits + width)
        hit, at = step < len(other.until), np.minimum(step, len(other.until) - 1)
        exits = np.where(hit, other.exits[at], self.exits)
        counts = np.where(hit, other.counts[at], self.counts + other.rows)
        # entered later than the last row here, but still within a width of the first one
        late = (other.until > self.until[-1]) & (self.until[-1] < self.start + width)
        return _steps(
            self.first, self.start, self.rows + other.rows, np.r_[self.until, other.until[late]],
            np.r_[exits, other.exits[late]], np.r_[counts, other.counts[late]], width,
        )


def _steps(sender, start, rows, until, exits, counts, width) -> Stretch:
    """A stretch of one sender, without steps that cannot be entered or that repeat the next one."""
    n = min(int(np.searchsorted(until, start + width)) + 1, len(until))
    until, exits, counts = until[:n], exits[:n], counts[:n]
    keep = np.append(exits[1:] != exits[:-1], True)
    return Stretch(sender, sender, start, rows, until[keep], exits[keep], counts[keep])


def _last_of_chain(times: np.ndarray, width: int) -> np.ndarray:
    """Position of the last anchor of the chain from every position, by pointer doubling."""
    after = np.searchsorted(times, times + width)
    last = np.where(after < len(times), after, np.arange(len(times)))
    while True:
        again = last[last]
        if np.array_equal(again, last):
            return last
        last = again


def one_sender(sender: str, t: np.ndarray, width: int) -> Stretch:
    """The stretch of sorted times of one sender."""
    times = t[np.r_[True, t[1:] != t[:-1]]]
    last = _last_of_chain(times, width)
    exits = times[last]
    return _steps(sender, int(t[0]), len(t), times, exits, len(t) - np.searchsorted(t, exits), width)


def numbered(senders: pa.Array, t: np.ndarray, state: State | None, width: int) -> tuple[np.ndarray, State]:
    """Number of each row within its window, from 1, and the state after the rows."""
    n = len(t)
    starts = np.r_[True, pc.not_equal(senders[1:], senders[:-1]).to_numpy(zero_copy_only=False)]
    # Of a gap only matters whether it is a width; two widths part the senders.
    gap = np.r_[0, np.minimum(np.diff(t), width)]
    gap[starts] = 2 * width
    distance = np.cumsum(gap)
    following = np.searchsorted(distance, distance + width).tolist()
    i = 0
    if state is not None and senders[0].as_py() == state[0]:
        own = np.flatnonzero(starts[1:])
        i = int(np.searchsorted(t[:own[0] + 1 if len(own) else n], state[1] + width))
    numbers, anchors = np.arange(1, n + 1), []
    if i:
        numbers[:i] += state[2]
    while i < n:
        anchors.append(i)
        i = following[i]
    if not anchors:
        return numbers, (state[0], state[1], state[2] + n)
    sizes = np.diff([*anchors, n])
    numbers[anchors[0]:] -= np.repeat(anchors, sizes)
    return numbers, (senders[n - 1].as_py(), int(t[anchors[-1]]), n - anchors[-1])


def _table(part: int, s: Stretch) -> pa.RecordBatch:
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (s.until, s.exits, s.counts)]
    plain = [pa.array([part]), pa.array([s.first]), pa.array([s.last]), pa.array([s.start]), pa.array([s.rows])]
    return pa.RecordBatch.from_arrays(plain + lists, names=[f.split()[0] for f in _STRETCH.split(", ")])


def _stretches(table: pa.Table) -> list[tuple[int, Stretch]]:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    lists = ("until", "exits", "counts")
    return [
        (r["part"], Stretch(*(r[c] for c in ("first", "last", "start", "rows")), *(np.array(r[c], np.int64) for c in lists)))
        for r in rows
    ]


def _summary(width: int):
    """The stretch of a partition; only the times of its last sender are held."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = start = None
        times: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            senders, t = batch.column("sender"), batch.column("t").to_numpy()
            end = senders[-1].as_py()
            tail = pc.sum(pc.equal(senders, end)).as_py()
            if part is None:
                part, first, start = batch.column("part")[0].as_py(), senders[0].as_py(), int(t[0])
            if end != last or tail < len(t):
                times = []
            last = end
            times.append(t[len(t) - tail:])
        if part is None:
            return
        own = one_sender(last, np.concatenate(times), width)
        if first != last:  # whatever comes before, the last sender starts here
            _, anchor, used = own.after(None, width)
            own = Stretch(first, last, start, 0, *(np.array([x], np.int64) for x in (start, anchor, used)))
        yield _table(part, own)

    return summarise


def _combined(width: int, fan: int):
    def combine(table: pa.Table) -> pa.Table:
        found = _stretches(table)
        total = found[0][1]
        for _, s in found[1:]:
            total = total.then(s, width)
        return pa.Table.from_batches([_table(found[0][0] // fan, total)])

    return combine


def _handed_down(width: int):
    """States before the members of a group, from the state before the group."""

    def hand_down(members: pa.Table, entry: pa.Table) -> pa.Table:
        state, rows = None, []
        if entry.num_rows and entry["sender"][0].as_py() is not None:
            state = tuple(entry[c][0].as_py() for c in ("sender", "anchor", "used"))
        for part, stretch in _stretches(members) if members.num_rows else []:
            rows.append((part, *(state or (None, None, None))))
            state = stretch.after(state, width)
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "sender", "anchor", "used"])

    return hand_down


def states_before(stretches: DataFrame, parts: int, width: int, fan: int = FAN) -> DataFrame:
    """The state before each part, from the stretches of all parts, as a tree."""
    levels, group = [stretches], F.floor(F.col("part") / fan)
    while parts > fan:
        levels.append(checkpointed(levels[-1].groupBy(group).applyInArrow(_combined(width, fan), _STRETCH)))
        parts = -(-parts // fan)
    nothing = pa.table({"sender": pa.array([], pa.string())})
    root = _handed_down(width)
    entries = levels[-1].groupBy(group).applyInArrow(lambda members: root(members, nothing), _ENTRY)
    for level in reversed(levels[:-1]):
        entries = level.groupBy(group).cogroup(entries.groupBy(F.col("part"))).applyInArrow(_handed_down(width), _ENTRY)
    return entries


def _refusals(names: list[str], limit: int, width: int):
    def refuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = begun = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                begun = True
                if batch.column("__entry")[0].as_py() is not None:
                    state = tuple(batch.column(c)[0].as_py() for c in ("__entry", "__anchor", "__used"))
            timed = pc.is_valid(batch.column("__t")).to_numpy(zero_copy_only=False)
            reason = np.full(len(timed), "no_time", object)
            if timed.any():
                senders, t = (batch.column(c).filter(pa.array(timed)) for c in ("__sender", "__t"))
                numbers, state = numbered(senders, t.to_numpy(), state, width)
                reason[timed] = np.where(numbers > limit, "request_cap", None)
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(reason, pa.string())], names=[*names, "refused"])

    return refuse


def anchored_reasons(
    df: DataFrame, limit: int, seconds: int, source: str = "client_ip", ts: str = "recv_ts", tie: str = "msg_id", fan: int = FAN,
) -> DataFrame:
    """Every row with ``refused``: null, ``request_cap`` or ``no_time``.

    A missing sender counts as one sender. Rows that agree in time and tie are taken in any order.
    """
    width = seconds * 1_000_000
    sender: Column = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    order = ["__sender", "__t", F.col(tie)]
    keyed = df.select("*", sender.alias("__sender"), F.unix_micros(ts).alias("__t"))
    rows = checkpointed(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().cast("long").alias("__part"))
    )
    thin = rows.filter(F.col("__t").isNotNull()).select(
        F.col("__part").alias("part"), F.col("__sender").alias("sender"), F.col("__t").alias("t"))
    stretches = thin.mapInArrow(_summary(width), _STRETCH)
    parts = rows.rdd.getNumPartitions()
    if parts > fan:
        stretches = checkpointed(stretches)
    entries = states_before(stretches, parts, width, fan).select(
        F.col("part").alias("__part"), F.col("sender").alias("__entry"), F.col("anchor").alias("__anchor"),
        F.col("used").alias("__used"))
    # one row per partition
    entered = rows.join(F.broadcast(entries), "__part", "left")
    schema = T.StructType([*df.schema.fields, T.StructField("refused", T.StringType())])
    return entered.mapInArrow(_refusals(df.columns, limit, width), schema)
