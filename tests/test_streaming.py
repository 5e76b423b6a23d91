import tempfile
import time

from pyspark.sql import functions as F

from fwlog.operators import admission, stats
from fwlog.plans import fixtures as fx
from fwlog.plans.translate import translate_live
from fwlog.sources import lists
from fwlog.sources.files import not_blank, read_stream
from fwlog.operators.anchored import anchored_reasons
from fwlog.streaming.admission import (
    admit_anchored_stream, admit_tumbling_stream, anchored_reasons_stream, tumbling_reasons_stream,
)
from fwlog.operators.delivery import delivery_counts, logical_delivery
from fwlog.streaming import live
from fwlog.streaming.live import start_delivery, translate_stream
from fwlog.streaming.progress import CounterListener

SMALL = "/root/testdata/sf0.001"


def _landed(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    lines = fx.session_lines(spark, SMALL).withColumnRenamed("value", "line")
    rows = fx.traffic(spark, SMALL).join(lines, "msg_id").select(
        "msg_id", "recv_ts", "client_ip", F.col("line").alias("value")
    )
    rows.repartition(2).write.parquet(f"{folder}/in")
    return folder


def _ids(spark, stream, folder, name):
    query = (
        stream.select("msg_id").writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-cp")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return {r["msg_id"] for r in spark.read.parquet(f"{folder}/{name}").collect()}


def test_caps_agree_with_batch(spark):
    folder = _landed(spark)
    raw = spark.read.parquet(f"{folder}/in")
    stream = read_stream(spark, f"{folder}/in")
    want = {r["msg_id"] for r in admission.admit_tumbling(raw).collect()}
    assert _ids(spark, admit_tumbling_stream(stream), folder, "tumbling") == want
    want = {r["msg_id"] for r in admission.admit_anchored(raw).collect()}
    assert _ids(spark, admit_anchored_stream(stream), folder, "anchored") == want


def _reasons(spark, make, folder, name):
    query = (
        make(read_stream(spark, f"{folder}/in")).select("msg_id", "refused", "value").writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-cp").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return spark.read.parquet(f"{folder}/{name}").collect()


def test_stream_caps_give_every_row_a_reason(spark):
    """Two micro-batches, one hot sender over many chunks, null senders, rows without a time and late ones."""
    folder, before = tempfile.mkdtemp(prefix="run-"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        i = F.col("id")
        rows = spark.range(6000).select(
            i.alias("msg_id"),
            F.when(i % 53 != 0, F.timestamp_micros(1_700_000_000_000_000 + i * 1300 + F.floor(i / 500) * 800_000)).alias("recv_ts"),
            F.when(i % 3 == 0, "hot").when(i % 3 == 1, F.concat(F.lit("s"), i % 7)).alias("client_ip"),
            F.concat(F.lit("m"), i).alias("value"),
        )
        late = spark.range(1).select(
            F.lit(-1).cast("long").alias("msg_id"), F.timestamp_seconds(F.lit(1_600_000_000)).alias("recv_ts"),
            F.lit("hot").alias("client_ip"), F.lit("m-1").alias("value"))
        first, second = rows.filter("msg_id < 2500"), rows.filter("msg_id >= 2500").unionByName(late)
        tumbling, _ = admission.cap_reasons(rows, None, 30, 10**6, 1)
        wants = {
            "tumbling": {r.msg_id: r.refused for r in tumbling.collect()},
            "anchored": {r.msg_id: r.refused for r in anchored_reasons(rows, 30, 1).collect()},
        }
        makes = {
            "tumbling": lambda s: tumbling_reasons_stream(s, 30, 1),
            "anchored": lambda s: anchored_reasons_stream(s, 30, 1),
        }
        got = {}
        for part in (first, second):
            part.repartition(3).write.mode("append").parquet(f"{folder}/in")
            for name, make in makes.items():
                got[name] = _reasons(spark, make, folder, name)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for name, want in wants.items():
        assert {r.msg_id: r.refused for r in got[name]} == {**want, -1: "late"}
        assert len(got[name]) == 6001 and all(r["value"] == f"m{r.msg_id}" for r in got[name])
        assert sum(v is not None for v in want.values()) > 1000


def test_delivery_agrees_with_batch(spark):
    folder = _landed(spark)
    done = translate_stream(read_stream(spark, f"{folder}/in"), "core")
    start_delivery(done, f"{folder}/out", "a, b", f"{folder}/cp", f"{folder}/dead").awaitTermination(120)
    batch = translate_live(not_blank(spark.read.parquet(f"{folder}/in")), "core")
    want = sorted(r["syslog"] for r in batch.filter(F.col("syslog").isNotNull()).collect())
    out = spark.read.text(f"{folder}/out/delivered")
    for destination in ("a", "b"):
        rows = out.filter(F.col("destination") == destination).collect()
        assert sorted(r["value"] for r in rows) == want
    assert spark.read.text(f"{folder}/dead").count() == batch.filter("reason IS NOT NULL").count()


def _caps(rows, per_source, max_sources, seconds):
    """The two caps counted row by row in arrival order."""
    used, tracked, reasons = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["recv_ts"], r["msg_id"])):
        window = int(r["recv_ts"].timestamp() // seconds)
        known = tracked.setdefault(window, set())
        if r["client_ip"] not in known and len(known) >= max_sources:
            reasons[r["msg_id"]] = "sender_cap"
            continue
        known.add(r["client_ip"])
        n = used[window, r["client_ip"]] = used.get((window, r["client_ip"]), 0) + 1
        reasons[r["msg_id"]] = None if n <= per_source else "source_cap"
    return reasons


def test_cap_reasons_against_brute_force(spark):
    raw = fx.traffic(spark, SMALL)
    raw = raw.withColumn("client_ip", F.when(F.col("msg_id") % 11 != 0, F.col("client_ip"))).cache()
    rows, counts = admission.cap_reasons(raw, None, 40, 3, 1)
    want = _caps(raw.collect(), 40, 3, 1)
    assert {r["msg_id"]: r["refused"] for r in rows.collect()} == want
    assert set(want.values()) == {None, "source_cap", "sender_cap"}
    assert counts.agg(F.sum("used")).first()[0] == sum(v is None for v in want.values())


def test_intake_agrees_with_batch_over_several_batches(spark):
    """Windows cross the batches, one destination fails, one row comes too late."""
    folder = tempfile.mkdtemp(prefix="run-")
    lines = fx.session_lines(spark, SMALL).withColumnRenamed("value", "line")
    raw = fx.traffic(spark, SMALL).join(lines, "msg_id").select(
        "msg_id", "recv_ts", "client_ip",
        F.when(F.col("msg_id") % 19 == 0, " ").when(F.col("msg_id") % 23 == 0, F.repeat(F.lit("x"), 9000))
        .otherwise(F.col("line")).alias("value"),
    ).cache()
    third = F.when(F.col("msg_id") < 1700, 0).when(F.col("msg_id") < 3900, 1).otherwise(2)
    nets = spark.range(1).select(F.lit("10.10.0.1,10.10.0.4").alias("list"))
    nets = lists.networks(nets, "list")
    late = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("msg_id"), F.timestamp_seconds(F.lit(0)).alias("recv_ts"),
        F.lit("10.10.0.1").alias("client_ip"), F.lit("m").alias("value"))

    def send(messages, destination, to):
        if destination == "b":
            raise OSError("refused")
        live.write_destination(messages, destination, to)

    for k in range(3):
        part = raw.filter(third == k)
        part = part.unionByName(late) if k == 2 else part
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live.start_intake(
            read_stream(spark, f"{folder}/in"), f"{folder}/out", "a, b", f"{folder}/cp", nets, "core",
            f"{folder}/dead", send, per_source=40, max_sources=3, seconds=1,
        ).awaitTermination(120)

    staged = {r["msg_id"]: r for r in spark.read.parquet(f"{folder}/out/staged").collect()}
    rows, caps = raw.collect(), _caps(raw.collect(), 40, 3, 1)
    translated = {r["msg_id"]: r for r in translate_live(raw, "core").collect()}
    assert len(staged) == len(rows) + 1
    assert (staged.pop(-1)["reason"]) == "late"
    for r in rows:
        got = staged[r["msg_id"]]
        want = caps[r["msg_id"]]
        if want is None and r["client_ip"] not in ("10.10.0.1", "10.10.0.4"):
            want = "not_allowed"
        if want is None and not r["value"].strip():
            want = "blank"
        if want is None and len(r["value"]) > 8192:
            want = "line_too_long"
        if want is not None:
            assert (got["kind"], got["reason"]) == ("refused", want)
        elif translated[r["msg_id"]]["reason"]:
            assert (got["kind"], got["reason"]) == ("dead", translated[r["msg_id"]]["reason"])
        else:
            assert (got["kind"], got["text"]) == ("message", translated[r["msg_id"]]["syslog"])
    sent = sorted(r["text"] for r in staged.values() if r["kind"] == "message")
    assert sorted(r["value"] for r in spark.read.text(f"{folder}/out/delivered").collect()) == sent
    outcomes = live.delivery_outcomes(spark, f"{folder}/out")
    assert {tuple(r) for r in delivery_counts(outcomes).collect()} == {("a", len(sent), 0), ("b", 0, len(sent))}
    assert tuple(logical_delivery(outcomes).first()) == (len(sent), 0)
    counters = {r["metric"]: r["value"] for r in live.live_counters(spark, f"{folder}/out").collect()}
    assert counters["formatted"] == len(sent) and counters["late"] == 1
    assert counters["source_cap"] == sum(v == "source_cap" for v in caps.values())
    assert spark.read.text(f"{folder}/dead").count() == counters["failed"]


def test_only_failed_destinations_are_sent_again(spark):
    folder, calls = tempfile.mkdtemp(prefix="run-"), []
    staged = spark.createDataFrame(
        [(i, "message" if i % 3 else "dead", None if i % 3 else "no_recognized_fields", f"t{i}") for i in range(30)],
        "msg_id long, kind string, reason string, text string").coalesce(1)

    def send(messages, destination, to):
        calls.append(destination)
        if destination == "b" and calls.count("b") == 1:
            raise OSError("refused")
        live.write_destination(messages, destination, to)

    for want in ({"a": 20, "b": 0, "c": 20}, {"a": 20, "b": 20, "c": 20}):
        live.deliver_staged(staged, 0, folder, "a, b, c", None, send)
        sent = {r.vector: r.sent for r in delivery_counts(live.delivery_outcomes(spark, folder)).collect()}
        assert sent == want
    assert sorted(calls) == ["a", "b", "b", "c"]
    assert spark.read.text(f"{folder}/delivered").groupBy("destination").count().collect()[0]["count"] == 20


def test_listener_counts_a_batch_once(spark):
    listener = CounterListener()
    spark.streams.addListener(listener)
    try:
        folder = _landed(spark)
        done = translate_stream(read_stream(spark, f"{folder}/in", 1), "core")
        start_delivery(done, f"{folder}/out", "a", f"{folder}/cp").awaitTermination(120)
        batch = translate_live(not_blank(spark.read.parquet(f"{folder}/in")), "core")
        want = stats.parser_stats(batch).first().asDict()
        for _ in range(100):
            if listener.totals.get("parser", {}).get("total") == want["total"]:
                break
            time.sleep(0.2)
        assert listener.totals["parser"] == want
        rows = {(r.component, r.metric): r.value for r in listener.rows(spark).collect()}
        assert rows["formatter", "formatted"] == stats.formatter_stats(batch).first()["formatted"]
    finally:
        spark.streams.removeListener(listener)
    assert set(listener.last_batch.values()) == {1}
    again = CounterListener(listener.totals, listener.last_batch)
    assert again.totals == listener.totals
