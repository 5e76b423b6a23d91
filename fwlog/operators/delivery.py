"""Fan-out and delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fwlog.operators.admission import slot
from fwlog.sources.lists import destination_array, is_safe_destination

BUCKET_SECONDS = 60
#: Longest dyadic interval of a session's cover: 2**14 minutes, about eleven days.
TOP_LEVEL = 14


def fan_out(messages: DataFrame, destinations: str | Column) -> DataFrame:
    """One row per message and destination, made in place: no join and no shuffle."""
    text = F.lit(destinations) if isinstance(destinations, str) else destinations
    safe = F.filter(destination_array(text), is_safe_destination)
    return messages.select("*", F.explode(safe).alias("destination"))


def _cover(first: Column, end: Column) -> Column:
    """Dyadic intervals (level, node) that make up the slots from first up to end."""
    def odd(x):
        return x.bitwiseAND(F.lit(1).cast("bigint")) == 1

    parts = []
    for k in range(TOP_LEVEL):
        lo, hi = F.shiftright(first + ((1 << k) - 1), k), F.shiftright(end, k)
        for taken, node in ((odd(lo), lo), (odd(hi), hi - 1)):
            parts.append(F.when((lo < hi) & taken, F.struct(F.lit(k).alias("level"), node.alias("node"))))
    lo, hi = F.shiftright(first + ((1 << TOP_LEVEL) - 1), TOP_LEVEL), F.shiftright(end, TOP_LEVEL)
    whole = F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
    top = F.transform(whole, lambda n: F.struct(F.lit(TOP_LEVEL).alias("level"), n.alias("node")))
    return F.concat(F.array_compact(F.array(*parts)), top)


def session_intervals(sessions: DataFrame, until: Column) -> DataFrame:
    """Every session as dyadic intervals of minutes: at most about 28, and one per further eleven days."""
    width = BUCKET_SECONDS * 1_000_000
    opened = sessions.select(
        "collector_id", "connected_at",
        F.coalesce("disconnected_at", until).alias("disconnected_at"),
    ).filter(F.col("connected_at") < F.col("disconnected_at"))
    first = slot(F.unix_micros("connected_at"), width)
    last = slot(F.unix_micros("disconnected_at") - 1, width)
    return opened.select("*", F.inline(_cover(first, last + 1)).alias("__level", "__node"))


def _salts(level: Column) -> Column:
    """Parts that the messages of an interval of ``2**level`` minutes are dealt to: 1 up to 128."""
    return F.call_function("shiftleft", F.lit(1), F.shiftright(level, 1))


def deliver_to_sessions(
    messages: DataFrame,
    sessions: DataFrame,
    ts: str = "recv_ts",
    until: Column | None = None,
) -> DataFrame:
    """Every message to every collector connected at that moment; others are dropped.

    Interval join by equality on (level, node) of the sessions' dyadic intervals, with the
    exact bounds as a filter. A message probes the levels that occur, which are one row of
    at most 15 numbers. Messages of a long interval meet under many keys: they are dealt to
    salts by a hash, and the interval of a session is repeated for each of them, so a session
    that is always open gathers no messages in one task. ``until`` closes sessions that are
    still open.
    """
    width = BUCKET_SECONDS * 1_000_000
    opened = session_intervals(sessions, F.current_timestamp() if until is None else until)
    opened = opened.select("*", F.explode(F.sequence(F.lit(0), _salts(F.col("__level")) - 1)).alias("__salt"))
    levels = opened.agg(F.collect_set("__level").alias("__levels"))
    keyed = messages.select("*", slot(F.unix_micros(ts), width).alias("__slot")).crossJoin(F.broadcast(levels))
    hashed = [f.name for f in messages.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = keyed.select("*", F.xxhash64(*hashed).alias("__dealt"), F.explode("__levels").alias("__level"))
    keyed = keyed.select(
        *messages.columns, "__level", F.expr("shiftright(__slot, __level)").alias("__node"),
        F.pmod(F.col("__dealt"), _salts(F.col("__level"))).cast("int").alias("__salt"))
    inside = (F.col("connected_at") <= F.col(ts)) & (F.col(ts) < F.col("disconnected_at"))
    return keyed.join(opened, ["__level", "__node", "__salt"]).filter(inside).select(
        *messages.columns, "collector_id"
    )


def delivery_counts(log: DataFrame) -> DataFrame:
    """Sent and failed per vector of a log ``(msg_id, vector, ok)``."""
    return log.groupBy("vector").agg(
        F.count_if("ok").alias("sent"), F.count_if(~F.col("ok")).alias("failed")
    )


def logical_delivery(log: DataFrame) -> DataFrame:
    """A message counts once: sent if any vector delivered it."""
    per_message = log.groupBy("msg_id").agg(F.bool_or("ok").alias("ok"))
    return per_message.agg(
        F.count_if("ok").alias("messages_sent"), F.count_if(~F.col("ok")).alias("messages_failed")
    )


def collector_counts(sessions: DataFrame, deliveries: DataFrame, at: Column) -> DataFrame:
    """Counters of the collector side.

    ``sessions`` has a flag ``allowed`` and ``deliveries`` a flag ``ok``; ``at`` is
    the moment for which connected collectors are counted.
    """
    open_now = F.col("allowed") & (F.col("connected_at") <= at) & (
        F.col("disconnected_at").isNull() | (at < F.col("disconnected_at"))
    )
    by_session = sessions.agg(
        F.count_if("allowed").alias("collectors_total"),
        F.count_if(~F.col("allowed")).alias("collectors_rejected_ip"),
        F.count_if(open_now).alias("collectors_connected"),
    )
    by_delivery = deliveries.agg(
        F.count_if("ok").alias("messages_sent"), F.count_if(~F.col("ok")).alias("messages_dropped")
    )
    return long_form(by_session, "output_server").unionByName(
        long_form(by_delivery, "output_server")
    )


def long_form(counters: DataFrame, component: str) -> DataFrame:
    """One row of counters -> rows ``(component, metric, value)``."""
    items = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in counters.columns)
    return counters.selectExpr(
        f"stack({len(counters.columns)}, {items}) AS (metric, value)"
    ).select(F.lit(component).alias("component"), "metric", "value")
