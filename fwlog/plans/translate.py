"""Whole translations: file, request and message path (section 3 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog.functions.crypto import DEFAULT_KEY, encrypt, key_table
from fwlog.functions.render import add_envelope, add_message
from fwlog.operators.csvlog import is_data, parse_csv
from fwlog.operators.parse import fenced, parse
from fwlog.sinks import writers
from fwlog.session import checkpointed
from fwlog.sources import files, requests


def translate(df: DataFrame, mode: str = "cef", value: str = "value") -> DataFrame:
    """Record columns, ``reason`` and ``message`` for every line; no shuffle."""
    return fenced(add_message(parse(df, value), mode), "message")


def translate_csv(df: DataFrame, mode: str = "cef", every_line: bool = False) -> DataFrame:
    parsed = parse_csv(df, every_line=every_line)
    return fenced(add_message(parsed, mode), "message")


def format_records(records: DataFrame, mode: str = "cef") -> DataFrame:
    """Messages of records that can be formatted."""
    return fenced(add_message(records, mode), "message").filter(F.col("message").isNotNull())


def translate_live(
    df: DataFrame,
    mode: str = "cef",
    facility: str = "local0",
    severity: str = "info",
    include_timestamp: bool = True,
    passphrase: str | None = None,
    value: str = "value",
) -> DataFrame:
    """The message path: parse, format, envelope, encrypt. Adds ``syslog`` (T4)."""
    done = add_envelope(translate(df, mode, value), mode, facility, severity, include_timestamp)
    if passphrase is None:
        return done
    keys = key_table(df.sparkSession, {DEFAULT_KEY: passphrase})
    return encrypt(done, keys, "syslog", "syslog").select(*done.columns)


def translate_file(
    spark: SparkSession, path: str, out: str, mode: str = "cef", dead_letter_path: str | None = None
) -> DataFrame:
    """Batch translation of a log file or CSV export; returns the line counts (K1, K2, A4).

    Every line is parsed once: messages, dead letters and counts are read from one staged
    table in the shared checkpoint folder.
    """
    lines = files.read_lines(spark, path)
    if files.is_csv_path(path):
        done, data = translate_csv(lines, mode, every_line=True), is_data("value")
    else:
        done, data = translate(lines, mode), F.col("value") != ""
    kept = [c for c in ("value", "raw", "reason", "csv_reason", "message") if c in done.columns]
    staged = checkpointed(done.select(*kept, data.alias("data")))
    writers.write_messages(staged, out)
    if dead_letter_path:
        writers.write_dead_letters(writers.dead_letters(staged.filter("data").drop("data")), dead_letter_path)
    total, translated = F.count(F.lit(1)), F.count("message")
    return staged.agg(total.alias("total"), translated.alias("translated"), (total - translated).alias("failed"))


def translate_bulk(request_rows: DataFrame) -> DataFrame:
    """Lines of the accepted bulk requests, always in key-value form."""
    return translate(requests.bulk_lines(request_rows), "extended")


def translate_single(request_rows: DataFrame) -> DataFrame:
    """Adds ``line status message`` and the record to single requests."""
    lines = request_rows.select("*", requests.raw_line(F.col("body")).alias("line"))
    lines = lines.select("*", requests.single_status(F.col("body"), F.col("line")).alias("__refused"))
    # refused bodies are not parsed
    lines = lines.select("*", F.when(F.col("__refused").isNull(), F.col("line")).alias("__line_in"))
    done = translate(lines, "extended", "__line_in")
    status = F.coalesce(
        F.col("__refused"), F.when(F.col("reason").isNull(), 200).otherwise(422)
    )
    return done.select("*", status.alias("status")).drop("__refused", "__line_in")
