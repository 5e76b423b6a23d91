"""The anchored request cap: composed stretches and whole tables against a plain loop."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fwlog.operators import anchored


def looped(rows, width, limit):
    """(sender, time, id) in order -> ids over the limit."""
    state, over = {}, set()
    for sender, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        anchor, used = state.get(sender, (None, 0))
        if anchor is None or t - anchor >= width:
            anchor, used = t, 0
        state[sender] = (anchor, used + 1)
        if used >= limit:
            over.add(i)
    return over


@pytest.mark.parametrize("seed", range(6))
def test_stretches_compose(seed):
    rnd, width = random.Random(seed), 1000
    rows, t = [], 0
    for sender in ("", "=a", "=b"):
        for _ in range(rnd.choice([1, 5, 300])):
            t += rnd.choice([0, 1, 90, 400, 999, 1000, 2500])
            rows.append((sender, t))
    cuts = sorted(rnd.sample(range(1, len(rows)), min(len(rows) - 1, rnd.choice([1, 7, 40]))))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    stretches, state, states, numbers = [], None, [], []
    for part in parts:
        batches = [pa.RecordBatch.from_pylist([{"part": 0, "sender": s, "t": x} for s, x in part[i:i + 3]]) for i in range(0, len(part), 3)]
        (summary,) = anchored._summary(width)(iter(batches))
        stretches.append(anchored._stretches(pa.Table.from_batches([summary]))[0][1])
        found, state = anchored.numbered(pa.array([s for s, _ in part]), np.array([x for _, x in part]), state, width)
        numbers += found.tolist()
        states.append(state)
    for limit in (1, 2, 5):
        over = looped([(s, x, i) for i, (s, x) in enumerate(rows)], width, limit)
        assert {i for i, n in enumerate(numbers) if n > limit} == over
    total, entered = stretches[0], None
    for k, s in enumerate(stretches):
        entered = s.after(entered, width)
        total = s if k == 0 else total.then(s, width)
        assert entered == states[k] == total.after(None, width)
    # any bracketing, entered in any way
    middle = [stretches[i].then(stretches[i + 1], width) if i + 1 < len(stretches) else stretches[i] for i in range(0, len(stretches), 2)]
    for start in (None, ("", -400, 3), ("=", 0, 1)):
        one = two = start
        for s in stretches:
            one = s.after(one, width)
        for s in middle:
            two = s.after(two, width)
        assert one == two


@pytest.mark.parametrize("fan", [2, 64])
def test_a_hot_sender_over_many_partitions(spark, fan):
    rnd = random.Random(fan)
    rows = []
    for i in range(6000):
        t = rnd.choice([rnd.randrange(60_000_000), rnd.randrange(20) * 500_000])
        sender = "hot" if rnd.random() < 0.4 else rnd.choice([None, "", "=", *(f"s{k}" for k in range(40))])
        rows.append((sender, None if i % 97 == 0 else t, i))
    df = spark.createDataFrame([(i, t, s, s) for s, t, i in rows], "msg_id long, t long, client_ip string, refused_by string").select(
        "msg_id", F.timestamp_micros("t").alias("recv_ts"), "client_ip", "refused_by").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = anchored.anchored_reasons(df, 3, 1, fan=fan).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.msg_id: r.client_ip for r in got} == {i: s for s, _, i in rows} and len(got) == len(rows)
    assert {r.msg_id for r in got if r.refused == "no_time"} == {i for _, t, i in rows if t is None}
    over = looped([r for r in rows if r[1] is not None], 1_000_000, 3)
    assert {r.msg_id for r in got if r.refused == "request_cap"} == over and len(over) > 500


def test_no_rows(spark):
    df = spark.createDataFrame([], "msg_id long, recv_ts timestamp, client_ip string")
    assert anchored.anchored_reasons(df, 3, 1).count() == 0
    none = spark.createDataFrame([(1, None, "a")], df.schema)
    assert [r.refused for r in anchored.anchored_reasons(none, 3, 1).collect()] == ["no_time"]
