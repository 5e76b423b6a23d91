"""CSV log export lines.

One physical line is one record, so the fields are cut with patterns that follow
the usual quoting rules: doubled quotes inside a quoted field, text after the
closing quote kept as it is, an open quote running to the end of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions.text import after, extract, none_if_empty, replaced, strip, strip_line
from fwlog.operators.parse import parse

_QUOTED = r'"([^"]*+(?:""[^"]*+)*+)(?:"([^,]*+)|\z)'
_ANY = rf'(?:{_QUOTED}|([^",][^,]*+|))'
FIRST_TWO = rf"(?s)^{_ANY},{_ANY},"
# a quoted field up to its closing quote, and what follows that
QUOTED_PART = r'^"[^"]*+(?:""[^"]*+)*+'
QUOTED_REST = r'^"([^,]*+)'
PLAIN_FIELD = r"(?s)^[^,]*+"


def _unquote(c: Column) -> Column:
    return F.replace(c, F.lit('""'), F.lit('"'))


def _field(head: Column, number: int) -> Column:
    g = 3 * (number - 1)
    return F.concat(
        _unquote(extract(head, FIRST_TWO, g + 1)),
        extract(head, FIRST_TWO, g + 2),
        extract(head, FIRST_TWO, g + 3),
    )


def split_csv(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``csv_ts``, ``csv_host`` and ``csv_raw``; all null under three fields."""
    keep = df.columns
    df = df.select("*", extract(F.col(value), FIRST_TWO, 0).alias("__head"))
    df = df.select(
        "*", F.when(F.col("__head") != "", after(F.col(value), F.col("__head"))).alias("__tail")
    )
    head, tail, part = F.col("__head"), F.col("__tail"), F.col("__part")
    # a long field is matched once, and its doubled quotes are looked for before they are replaced
    df = df.select("*", F.when(F.startswith(tail, F.lit('"')), extract(tail, QUOTED_PART, 0)).alias("__part"))
    df = df.select("*", F.substring(part, 2, 2**31 - 1).alias("__inner"), extract(after(tail, part), QUOTED_REST, 1).alias("__rest"))
    df = df.select("*", F.when(part.isNotNull(), F.concat(replaced(F.col("__inner"), '""', '"'), F.col("__rest")))
                   .otherwise(extract(tail, PLAIN_FIELD, 0)).alias("__third"))
    present = tail.isNotNull()
    return df.select(
        *keep,
        F.when(present, strip(_field(head, 1))).alias("csv_ts"),
        F.when(present, strip(_field(head, 2))).alias("csv_host"),
        strip_line(F.col("__third")).alias("csv_raw"),
    )


def is_data(value: str) -> Column:
    """Neither the header row nor an empty line, which no counter sees (F2)."""
    return (F.col(value) != "") & ~F.startswith(value, F.lit("Timestamp"))


def parse_csv(df: DataFrame, value: str = "value", every_line: bool = False) -> DataFrame:
    """Record columns of CSV lines; lines with under three fields are parsed whole.

    The header row and empty lines are left out, or with ``every_line`` kept as empty lines.
    ``raw`` is the text that went through the parser and ``csv_reason`` the second
    dead-letter reason of a failed line.
    """
    given = df.columns
    df = split_csv(df if every_line else df.filter(is_data(value)), value)
    raw = F.coalesce("csv_raw", value)
    df = df.select("*", (F.when(is_data(value), raw) if every_line else raw).alias("raw"))
    df = parse(df, "raw")
    has_three = F.col("csv_ts").isNotNull()
    host = F.coalesce(F.col("hostname"), none_if_empty(F.col("csv_host")))
    return df.select(
        *given,
        "raw",
        *vocab.SESSION_COLUMNS,
        F.when(F.col("reason").isNull(), host).alias("hostname"),
        "action",
        *vocab.HEADER_COLUMNS,
        *vocab.SYSTEM_COLUMNS,
        "extras",
        "reason",
        F.when(F.col("reason").isNull(), F.col("csv_ts")).alias("_csv_timestamp"),
        F.when(
            F.col("reason").isNotNull(),
            F.when(has_three, "csv_payload_unparsable").otherwise("csv_insufficient_fields"),
        ).alias("csv_reason"),
    )
