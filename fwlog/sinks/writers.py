"""Sinks (K1-K3, K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog.functions.crypto import DEFAULT_KEY, decrypt, encrypt, key_table
from fwlog.functions.text import strip


def write_messages(df: DataFrame, path: str, message: str = "message", mode: str = "error") -> None:
    """Translated text, one message per line (K1)."""
    df.filter(F.col(message).isNotNull()).select(message).write.mode(mode).text(path)


def dead_letters(parsed: DataFrame, raw: str = "value") -> DataFrame:
    """``(reason, raw)`` of failed lines; a failed CSV line gives two rows."""
    blank = F.col("reason") == "empty_line"
    text = F.when(blank, F.coalesce(F.col(raw), F.lit(""))).otherwise(strip(F.col(raw)))
    failed = parsed.filter(F.col("reason").isNotNull())
    if "csv_reason" not in parsed.columns:
        return failed.select("reason", text.alias("raw"))
    text = F.when(blank, F.col("raw")).otherwise(strip(F.col("raw")))
    entries = F.array(
        F.struct(F.col("reason").alias("reason"), text.alias("raw")),
        F.struct(F.col("csv_reason").alias("reason"), F.col("value").alias("raw")),
    )
    return failed.select(F.inline(entries))


def write_dead_letters(
    letters: DataFrame, path: str, at: Column | None = None, mode: str = "append"
) -> None:
    """Lines ``time | reason | raw`` in one folder per UTC day (K2)."""
    at = F.current_timestamp() if at is None else at
    utc = F.to_utc_timestamp(at, F.current_timezone())
    (
        letters.select(
            F.concat(
                F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
                F.lit(" | "), F.col("reason"), F.lit(" | "), F.col("raw"),
            ).alias("value"),
            F.to_date(utc).alias("failed_date"),
        )
        .write.mode(mode).partitionBy("failed_date").text(path)
    )


def write_fan_out(df: DataFrame, path: str, message: str = "message", mode: str = "append") -> None:
    """One folder per destination (K3)."""
    df.select(F.col(message).alias("value"), "destination").write.mode(mode).partitionBy(
        "destination"
    ).text(path)


def write_encrypted(
    df: DataFrame, path: str, passphrase: str, message: str = "message", mode: str = "error"
) -> None:
    """Encrypted messages at rest (K5)."""
    keys = key_table(df.sparkSession, {DEFAULT_KEY: passphrase})
    encrypt(df.select(message), keys, message, "data").select("data").write.mode(mode).parquet(path)


def read_encrypted(spark: SparkSession, path: str, passphrase: str) -> DataFrame:
    keys = key_table(spark, {DEFAULT_KEY: passphrase})
    return decrypt(spark.read.parquet(path), keys, "data", "message").select("message")
