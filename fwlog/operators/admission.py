"""Intake limits in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.operators.anchored import anchored_reasons

SALTS = 32


def fits_line_limit(value: Column) -> Column:
    return F.octet_length(value) <= vocab.LINE_MAX_BYTES


def slot(micros: Column, width: int) -> Column:
    """Number of the slot of that width, in exact integer steps."""
    return ((micros - F.pmod(micros, F.lit(width))) / width).cast("bigint")


def window_number(ts: Column, seconds: int, start_micros: int = 0) -> Column:
    """Number of the tumbling window a time falls in; windows start at ``start_micros``."""
    return slot(F.unix_micros(ts) - start_micros, seconds * 1_000_000)


def admit_tumbling(
    df: DataFrame,
    per_source: int = vocab.SOURCE_CAP,
    max_sources: int = vocab.TRACKED_SOURCES_CAP,
    seconds: int = vocab.SOURCE_CAP_SECONDS,
    start_micros: int = 0,
    source: str = "client_ip",
    ts: str = "recv_ts",
    tie: str = "msg_id",
) -> DataFrame:
    """First ``per_source`` rows of a source in a window, first ``max_sources`` sources.

    The row limit is pushed below the shuffle (WindowGroupLimit), so a hot source
    ships at most ``per_source`` rows per map task and window.
    """
    order = [F.col(ts), F.col(tie)]
    numbered = df.select("*", window_number(F.col(ts), seconds, start_micros).alias("__window"))
    by_source = Window.partitionBy(source, "__window").orderBy(*order)
    capped = numbered.select("*", F.row_number().over(by_source).alias("__n")).filter(
        F.col("__n") <= per_source
    )
    # Rank of a source = arrival of its first row. Ranking inside salted slices
    # first leaves at most SALTS x max_sources rows for the ranking of a window.
    firsts = numbered.groupBy(source, "__window").agg(F.min(F.struct(ts, tie)).alias("__first")).select(
        source, "__window", "__first.*", F.pmod(F.xxhash64(source), F.lit(SALTS)).alias("__salt")
    )
    slice_order = Window.partitionBy("__window", "__salt").orderBy(*order)
    window_order = Window.partitionBy("__window").orderBy(*order)
    tracked = (
        firsts.select("*", F.row_number().over(slice_order).alias("__r"))
        .filter(F.col("__r") <= max_sources)
        .select(source, "__window", F.row_number().over(window_order).alias("__r"))
        .filter(F.col("__r") <= max_sources)
        .select(source, "__window")
    )
    # a missing sender counts as one sender; rows without a time have no window
    tracked = tracked.select(F.col(source).alias("__source"), F.col("__window").alias("__of"))
    same = F.col(source).eqNullSafe(F.col("__source")) & (F.col("__window") == F.col("__of"))
    return capped.join(tracked, same, "left_semi").select(*df.columns)


def cap_reasons(
    df: DataFrame,
    seen: DataFrame | None = None,
    per_source: int = vocab.SOURCE_CAP,
    max_sources: int = vocab.TRACKED_SOURCES_CAP,
    seconds: int = vocab.SOURCE_CAP_SECONDS,
    start_micros: int = 0,
    source: str = "client_ip",
    ts: str = "recv_ts",
    tie: str = "msg_id",
) -> tuple[DataFrame, DataFrame]:
    """Both caps over every row, none lost, counted on from ``seen``.

    Returns the rows with ``refused`` (null, ``no_time``, ``sender_cap`` or ``source_cap``)
    and the counts afterwards. ``seen`` and the counts are rows ``(__source, __of, used)``,
    one per tracked sender and window.

    A sender's rows of a window are cut at its last admitted ``(ts, tie)``. The cuts are
    found below the limit of the ranking, so no task sorts all rows of a hot sender, and
    joined back as one row per sender and window. ``(ts, tie)`` must not repeat.
    """
    at = F.struct(ts, tie)
    numbered = df.select("*", window_number(F.col(ts), seconds, start_micros).alias("__window"))
    thin = numbered.filter(F.col("__window").isNotNull()).select(
        F.col(source).alias("__source"), F.col("__window").alias("__of"), at.alias("__at")
    )
    order = Window.partitionBy("__source", "__of").orderBy("__at")
    early = thin.select("*", F.row_number().over(order).alias("__n")).filter(F.col("__n") <= per_source)
    if seen is None:
        early = early.select("*", F.lit(None).cast("bigint").alias("used"))
    else:
        known = seen.select(F.col("__source").alias("__s"), F.col("__of").alias("__w"), "used")
        same = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__of") == F.col("__w"))
        early = early.join(known, same, "left").select(*early.columns, "used")
    room = F.col("__n") <= per_source - F.coalesce("used", F.lit(0))
    cuts = early.groupBy("__source", "__of").agg(
        F.min("__at").alias("__first"), F.max(F.when(room, F.col("__at"))).alias("__cut"),
        F.count_if(room).alias("__taken"), F.max("used").alias("used"),
    )
    # New senders of a window by first arrival: salted slices first, as in `admit_tumbling`.
    salt = F.pmod(F.xxhash64("__source"), F.lit(SALTS))
    in_slice = Window.partitionBy("__of", "__salt").orderBy("__first")
    in_window = Window.partitionBy("__of").orderBy("__first")
    fresh = (
        cuts.filter(F.col("used").isNull()).select("__source", "__of", "__first", salt.alias("__salt"))
        .select("*", F.row_number().over(in_slice).alias("__r")).filter(F.col("__r") <= max_sources)
        .select("__source", "__of", F.row_number().over(in_window).alias("__r"))
        .filter(F.col("__r") <= max_sources)
    )
    if seen is not None:
        taken = seen.groupBy("__of").agg(F.count(F.lit(1)).alias("__tracked"))
        fresh = fresh.join(taken, "__of", "left").filter(
            F.col("__r") <= max_sources - F.coalesce("__tracked", F.lit(0))
        )
    fresh = fresh.select(F.col("__source").alias("__s"), F.col("__of").alias("__w"), F.lit(True).alias("__new"))
    same = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__of") == F.col("__w"))
    cuts = cuts.join(fresh, same, "left").select(
        *cuts.columns, (F.col("used").isNotNull() | F.col("__new").isNotNull()).alias("__tracked"),
    )
    here = F.col(source).eqNullSafe(F.col("__source")) & (F.col("__window") == F.col("__of"))
    refused = (
        F.when(F.col("__window").isNull(), "no_time")
        .when(~F.col("__tracked"), "sender_cap")
        .when(F.col("__cut").isNull() | (at > F.col("__cut")), "source_cap")
    )
    rows = numbered.join(cuts, here, "left").select(*df.columns, refused.alias("refused"))
    counts = cuts.filter("__tracked").select("__source", "__of", F.col("__taken").alias("used"))
    if seen is not None:
        counts = counts.unionByName(seen).groupBy("__source", "__of").agg(F.sum("used").alias("used"))
    return rows, counts


def admit_anchored(
    df: DataFrame,
    limit: int = vocab.REQUEST_CAP,
    seconds: int = vocab.REQUEST_CAP_SECONDS,
    source: str = "client_ip",
    ts: str = "recv_ts",
    tie: str = "msg_id",
) -> DataFrame:
    """First ``limit`` rows of a source in each window anchored at its first row.

    A missing sender counts as one sender; rows without a time have no window.
    """
    rows = anchored_reasons(df, limit, seconds, source, ts, tie)
    return rows.filter(F.col("refused").isNull()).select(*df.columns)
