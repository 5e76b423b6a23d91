"""Comma-separated configuration lists as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions.net import allows_all, list_entries, network


def networks(df: DataFrame, column: str) -> DataFrame:
    """One row per valid entry: the given columns plus ``entry family bits lo hi``.

    Invalid entries are left out, and so is everything from a list that says to
    allow all. A list left without any network allows every address.
    """
    entries = df.filter(~allows_all(F.col(column))).select(
        *df.columns, F.explode(list_entries(F.col(column))).alias("entry")
    )
    entries = entries.select("*", network(F.col("entry")).alias("__net"))
    return entries.filter(F.col("__net").isNotNull()).select(
        *df.columns, "entry", "__net.family", "__net.bits", "__net.lo", "__net.hi"
    )


def destination_array(text: Column) -> Column:
    """Destinations of a list; an empty list stands for this machine."""
    entries = list_entries(text)
    return F.when(F.size(entries) > 0, entries).otherwise(
        F.array(F.lit(vocab.DEFAULT_DESTINATION))
    )


def is_safe_destination(host: Column) -> Column:
    """No line end and no NUL inside."""
    return (host != "") & ~F.rlike(host, F.lit(r"[\n\r\x00]"))


def destinations(df: DataFrame, column: str) -> DataFrame:
    rows = df.select(
        *df.columns, F.posexplode(destination_array(F.col(column))).alias("position", "destination")
    )
    return rows.filter(is_safe_destination(F.col("destination")))
