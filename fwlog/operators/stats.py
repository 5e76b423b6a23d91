"""Counters over parsed and formatted lines (A1-A5, A9, A10) and D1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fwlog.functions.text import DIGIT, WS, extract, strip
from fwlog.functions.render import formatter_counters
from fwlog.operators.delivery import long_form
from fwlog.operators.parse import fenced, parser_counters


def parser_stats(parsed: DataFrame) -> DataFrame:
    return parsed.agg(*parser_counters())


def formatter_stats(formatted: DataFrame, message: str = "message") -> DataFrame:
    return formatted.agg(*formatter_counters(message))


def receiver_stats(admitted: DataFrame) -> DataFrame:
    """Counts of messages that survived the caps, by the gate they reach (A3).

    Needs the flag ``allowed``; blank messages of allowed senders count nowhere.
    """
    filled = strip(F.col("value")) != ""
    return admitted.agg(
        F.count_if(F.col("allowed") & filled).alias("messages_received"),
        F.count_if(~F.col("allowed")).alias("connections_rejected_ip"),
    )


def batch_summary(lines: DataFrame, message: str = "message") -> DataFrame:
    """``lines`` is every physical line, blank and header lines included (A4)."""
    done = F.count_if(F.col(message).isNotNull())
    return lines.agg(
        F.count(F.lit(1)).alias("total"),
        done.alias("translated"),
        (F.count(F.lit(1)) - done).alias("failed"),
    )


def bulk_summary(results: DataFrame) -> DataFrame:
    """Per request: lines and translated lines (A5)."""
    return results.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("message").isNotNull()).alias("translated"),
    )


def snapshot(parts: dict[str, list[DataFrame]]) -> DataFrame:
    """All counters in one long table ``component metric value``."""
    rows = [long_form(df, name) for name, dfs in parts.items() for df in dfs]
    return reduce(DataFrame.unionByName, rows)


def long_rows(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """One row of counters as ``component metric value``, read once."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("component"), F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value"))
        for name, own in columns.items() for c in own
    ])))


def count_by(parsed: DataFrame, column: str) -> DataFrame:
    """Rows per value of ``src``, ``dport`` or ``action`` (A10); partial counts are
    made before the shuffle, so a hot value costs one row per task. Missing values go by
    their count of 0: a filter on them would repeat the parser inside its condition."""
    counts = parsed.groupBy(F.col(column).alias("key")).agg(F.count(F.col(column)).alias("messages"))
    return counts.filter("messages > 0")


# Fixed value: the documented pattern over translated lines, and its groups.
_WORD = r"[\p{L}\p{N}_]"
TRANSLATED = (
    rf"proto=({_WORD}+){WS}+src=([{DIGIT}\.]+){WS}+dst=([{DIGIT}\.]+){WS}+sport=({DIGIT}+)"
    rf"{WS}+dport=({DIGIT}+){WS}+action=({_WORD}+)(?:{WS}+app=({_WORD}+))?"
    rf"(?:{WS}+[^\n]*?hostname=([\p{{L}}\p{{N}}_\-]+))?"
)
TRANSLATED_FIELDS = (
    "protocol", "source_address", "destination_address", "source_port",
    "destination_port", "action", "application", "device_name",
)


def extract_fields(df: DataFrame, message: str = "message") -> DataFrame:
    """Fields of translated lines (D1); lines the pattern does not match are left out."""
    kept = fenced(df.select("*", extract(F.col(message), TRANSLATED, 0).alias("__hit")), "__hit")
    kept = kept.filter(F.col("__hit") != "")
    return kept.select(
        *df.columns,
        *[
            F.nullif(extract(F.col("__hit"), TRANSLATED, i), F.lit("")).alias(n)
            for i, n in enumerate(TRANSLATED_FIELDS, 1)
        ],
    )
