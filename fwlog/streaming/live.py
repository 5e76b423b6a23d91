"""Continuous translation (T4, T5): intake limits, translation and delivery of a stream.

Every micro-batch goes through the batch plans. What one leaves for the next is a small
table of counts beside the checkpoint, so a batch that is run again finds the counts it
started from and overwrites its own results.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions.text import strip
from fwlog.operators import addresses, admission
from fwlog.plans.translate import translate_live
from fwlog.sinks import writers
from fwlog.sources.files import not_blank
from fwlog.sources.lists import destination_array, is_safe_destination
from fwlog.streaming.progress import counted

LATE_SECONDS = 3600
#: Destinations that are sent to at the same time.
AT_ONCE = 8
_COUNTS = "__source string, __of bigint, used bigint, newest bigint"
log = logging.getLogger(__name__)


def translate_stream(df: DataFrame, mode: str = "cef", **envelope) -> DataFrame:
    """Gate and translate RAW messages; stateless, so it needs no watermark."""
    gated = not_blank(df).filter(admission.fits_line_limit(F.col("value")))
    return counted(translate_live(gated, mode, **envelope))


def too_long(df: DataFrame) -> DataFrame:
    """Side output of the line gate: ``(reason, raw)``."""
    return df.filter(~admission.fits_line_limit(F.col("value"))).select(
        F.lit("line_too_long").alias("reason"), F.col("value").alias("raw")
    )


def gate_reasons(rows: DataFrame, networks: DataFrame | None) -> DataFrame:
    """Fills ``refused`` of rows that passed the caps: allow-list, blank and size gates, in this order."""
    given = rows.columns
    if networks is not None:
        rows = addresses.split_by_allow_list(rows, "client_ip", networks)
    else:
        rows = rows.select("*", F.lit(True).alias("allowed"))
    text = F.coalesce(F.col("value"), F.lit(""))
    gates = (
        F.when(~F.col("allowed"), "not_allowed")
        .when(strip(text) == "", "blank")
        .when(~admission.fits_line_limit(text), "line_too_long")
    )
    kept = [F.col(c) for c in given if c != "refused"]
    return rows.select(*kept, F.coalesce("refused", gates).alias("refused"))


def staged_rows(rows: DataFrame, mode: str = "cef", **envelope) -> DataFrame:
    """Every row of ``rows`` once, as ``(msg_id, kind, reason, text)``.

    kind: ``message`` (text = what is delivered), ``dead`` (did not parse), ``skipped``
    (parsed, but nothing to format) or ``refused`` (never parsed).
    """
    line = F.when(F.col("refused").isNull(), F.col("value"))  # refused rows are not parsed
    done = translate_live(rows.select("*", line.alias("__line_in")), mode, value="__line_in", **envelope)
    syslog = F.col("syslog")
    if envelope.get("passphrase") is not None:
        syslog = F.base64(syslog)
    return _staged(done.withColumn("syslog", syslog), F.col("refused"))


def _staged(done: DataFrame, refused) -> DataFrame:
    kind = (
        F.when(refused.isNotNull(), "refused").when(F.col("reason").isNotNull(), "dead")
        .when(F.col("syslog").isNull(), "skipped").otherwise("message")
    )
    text = F.when((refused.isNull()) & F.col("syslog").isNotNull(), F.col("syslog")).otherwise(strip(F.col("value")))
    return done.select(
        "msg_id", kind.alias("kind"), F.coalesce(refused, F.col("reason")).alias("reason"), text.alias("text")
    )


def write_destination(messages: DataFrame, destination: str, folder: str) -> None:
    """One destination's messages, a folder of its own below ``folder``."""
    (
        messages.select(F.col("text").alias("value"), F.lit(destination).alias("destination"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("destination").text(folder)
    )


def _safe_destinations(spark: SparkSession, destinations: str) -> list[str]:
    safe = F.filter(destination_array(F.lit(destinations)), is_safe_destination)
    return list(dict.fromkeys(spark.range(1).select(safe.alias("d")).first()["d"]))


def deliver_staged(
    staged: DataFrame, number: int, out: str, destinations: str,
    dead_letter_path: str | None = None, send: Callable = write_destination,
) -> None:
    """Delivers one micro-batch.

    The rows are computed once, for one table split by ``kind``; everything else reads
    that table. Destinations get theirs at the same time, each in a folder of its own. A
    destination that fails is logged and counted as failed for each message of the batch;
    the others are not held up. Its outcomes are a destination's commit: when a batch is
    run again, only destinations without a good outcome are sent to.
    """
    spark = staged.sparkSession
    own = f"batch={number}"
    staged.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/staged/{own}")
    schema = "msg_id bigint, reason string, text string, kind string"
    table = spark.read.schema(schema).parquet(f"{out}/staged/{own}")
    messages = table.filter("kind = 'message'")

    def deliver(place: int, destination: str) -> None:
        done = f"{out}/outcomes/{own}/to={place}"
        if _was_sent(spark, done):
            return
        try:
            send(messages, destination, f"{out}/delivered/{own}/to={place}")
            ok = True
        except Exception:  # one destination must not stop the others; its failure is counted
            log.exception("delivery of batch %d to %s failed", number, destination)
            ok = False
        outcome = messages.select("msg_id", F.lit(destination).alias("vector"), F.lit(ok).alias("ok"))
        outcome.write.mode("overwrite").parquet(done)
        if ok:
            spark.range(1).write.mode("overwrite").parquet(f"{done}/_sent")

    names = _safe_destinations(spark, destinations)
    with ThreadPoolExecutor(max(1, min(len(names), AT_ONCE))) as pool:
        list(pool.map(inheritable_thread_target(deliver), range(len(names)), names))
    counts = table.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{out}/counts/{own}")
    if dead_letter_path:
        dead = table.filter("kind = 'dead'").select("reason", F.col("text").alias("raw"))
        writers.write_dead_letters(dead, f"{dead_letter_path}/{own}", mode="overwrite")


def _was_sent(spark: SparkSession, done: str) -> bool:
    """Whether a destination has its good outcome; ``_sent`` is written last and is no data to other readers."""
    try:
        return spark.read.schema("id bigint").parquet(f"{done}/_sent").count() > 0
    except AnalysisException:
        return False


def live_counters(spark: SparkSession, out: str) -> DataFrame:
    """Counters of all batches so far: ``component metric value`` (A1-A3, T5)."""
    parts = spark.read.parquet(f"{out}/counts")
    kind, n = F.col("kind"), F.col("n")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    row = parts.agg(
        total(kind != "refused").alias("total"), total(kind.isin("message", "skipped")).alias("parsed"),
        total(kind == "dead").alias("failed"), total(kind == "message").alias("formatted"),
        total(kind == "skipped").alias("skipped"), total(kind != "refused").alias("messages_received"),
        *[total(F.col("reason").eqNullSafe(r) & (kind == "refused")).alias(r)
          for r in ("late", "no_time", "source_cap", "sender_cap", "not_allowed", "blank", "line_too_long")],
    )
    from fwlog.operators.stats import long_rows

    return long_rows(row, {
        "parser": ["total", "parsed", "failed"], "formatter": ["formatted", "skipped"],
        "receiver": ["messages_received", "late", "no_time", "source_cap", "sender_cap", "not_allowed",
                     "blank", "line_too_long"],
    })


def delivery_outcomes(spark: SparkSession, out: str) -> DataFrame:
    """The delivery log ``(msg_id, vector, ok)`` of all batches so far."""
    schema = "msg_id bigint, vector string, ok boolean"
    return spark.read.schema(schema).parquet(f"{out}/outcomes").select("msg_id", "vector", "ok")


def start_delivery(
    translated: DataFrame, out: str, destinations: str, checkpoint: str,
    dead_letter_path: str | None = None, send: Callable = write_destination, **trigger,
):
    """Deliver a translated stream to every destination, one folder each per batch (K3)."""

    def deliver(batch: DataFrame, number: int) -> None:
        staged = _staged(batch, F.lit(None).cast("string"))
        deliver_staged(staged, number, out, destinations, dead_letter_path, send)

    return _start(translated, deliver, checkpoint, trigger)


def start_intake(
    raw: DataFrame, out: str, destinations: str, checkpoint: str,
    networks: DataFrame | None = None, mode: str = "cef", dead_letter_path: str | None = None,
    send: Callable = write_destination, per_source: int = vocab.SOURCE_CAP,
    max_sources: int = vocab.TRACKED_SOURCES_CAP, seconds: int = vocab.SOURCE_CAP_SECONDS,
    start_micros: int = 0, late_seconds: int = LATE_SECONDS, trigger: dict | None = None, **envelope,
):
    """The whole message path of a RAW stream.

    Source cap, cap of tracked senders, allow-list, blank, size, parse, format, envelope,
    deliver. Refused rows stay in the staged table with their reason. A row more than
    ``late_seconds`` behind the newest arrival of the batches before is refused as
    ``late``: the count of its window is gone by then. Counts of a batch go to one of two
    folders in turn, so those of the batch before are still there if it is run again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # read for the cuts and for the rows; the batch before may still be needed
        raw_copy, schema = f"{checkpoint}/raw/{number % 2}", batch.schema
        batch.write.mode("overwrite").parquet(raw_copy)
        batch = spark.read.schema(schema).parquet(raw_copy)
        before = None
        newest = None
        if number > 0:
            before = spark.read.schema(_COUNTS).parquet(f"{checkpoint}/counts/{(number - 1) % 2}")
            newest = before.agg(F.max("newest")).first()[0]
            before = before.filter(F.col("__of").isNotNull()).drop("newest")
        micros = F.unix_micros("recv_ts")
        oldest = None if newest is None else newest - late_seconds * 1_000_000
        late = F.lit(False) if oldest is None else F.coalesce(micros < oldest, F.lit(False))
        rows, counts = admission.cap_reasons(
            batch.filter(~late), before, per_source, max_sources, seconds, start_micros)
        rows = rows.unionByName(batch.filter(late).withColumn("refused", F.lit("late")))
        deliver_staged(
            staged_rows(gate_reasons(rows, networks), mode, **envelope),
            number, out, destinations, dead_letter_path, send)
        latest = batch.agg(F.max(micros)).first()[0]
        latest = max([x for x in (newest, latest) if x is not None], default=None)
        if latest is not None:
            ends = start_micros + (F.col("__of") + 1) * seconds * 1_000_000
            counts = counts.filter(ends > latest - late_seconds * 1_000_000)
        mark = spark.range(1).select(
            F.lit(None).cast("string").alias("__source"), F.lit(None).cast("bigint").alias("__of"),
            F.lit(None).cast("bigint").alias("used"), F.lit(latest).cast("bigint").alias("newest"))
        counts = counts.withColumn("newest", F.lit(None).cast("bigint")).unionByName(mark)
        counts.write.mode("overwrite").parquet(f"{checkpoint}/counts/{number % 2}")

    return _start(raw, run, checkpoint, trigger)


def _start(df: DataFrame, run: Callable, checkpoint: str, trigger: dict | None):
    return (
        df.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
