"""Request documents (S4, S5, F8, L2): rows of ``(request_id, body)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.operators.parse import fenced

BULK_MAX_BYTES = 10 * 1024 * 1024


def _kind(v: Column) -> Column:
    """JSON type of a variant: OBJECT, ARRAY, STRING, VOID and so on."""
    return F.split_part(F.schema_of_variant(v), F.lit("<"), F.lit(1))


def raw_line(body: Column) -> Column:
    """Line of a single request: ``raw`` of a JSON object, else the whole body."""
    # only a text that opens with a brace can be an object; for any other the reader would raise and catch an error
    opened = F.rlike(body, F.lit(r"^[ \t\n\r]*+\{"))
    parsed = F.when(opened, F.try_parse_json(body))
    raw = F.get_json_object(body, "$.raw")
    return F.when(_kind(parsed) == "OBJECT", F.coalesce(raw, F.lit(""))).otherwise(body)


def single_status(body: Column, line: Column) -> Column:
    """Refusal of a single request before parsing, null when it may be parsed."""
    return (
        F.when(F.octet_length(body) > vocab.SINGLE_BODY_MAX_BYTES, 413)
        .when(body.isNull() | (body == ""), 400)
        .when(line == "", 400)
    )


def with_bulk_lines(requests: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``status`` (200 or the refusal) and ``lines`` (null when refused).

    A request with too many lines is refused as a whole, never cut.
    """
    keep = requests.columns
    df = requests.select("*", F.try_parse_json(body).alias("__doc"))
    df = df.select(
        *keep,
        _kind(F.col("__doc")).alias("__kind"),
        _kind(F.try_variant_get("__doc", "$.lines", "variant")).alias("__lines_kind"),
        F.try_variant_get("__doc", "$.lines", "array<string>").alias("__lines"),
    )
    count = F.size("__lines")
    status = (
        F.when(F.octet_length(body) > BULK_MAX_BYTES, 413)
        .when(F.col("__kind").isNull(), 400)
        # valid JSON that is no object has no fields to look up
        .when(F.col("__kind") != "OBJECT", 500)
        .when(F.coalesce(F.col("__lines_kind"), F.lit("")) != "ARRAY", 400)
        .when((count == 0) | (count > vocab.BULK_MAX_LINES), 400)
        .otherwise(200)
    )
    # a filter on the status or the lines, which a step that explodes them adds by itself, would otherwise read every
    # document once more for each of its conditions, and even below the steps that make the documents
    df = fenced(df.select(*keep, F.struct(status.alias("status"), F.col("__lines").alias("lines")).alias("__read")), "__read")
    status, lines = F.col("__read.status"), F.col("__read.lines")
    return df.select(*keep, status.alias("status"), F.when(status == 200, lines).alias("lines"))


def bulk_lines(requests: DataFrame, body: str = "body") -> DataFrame:
    """One row per line of the accepted bulk requests: ``request_id index value``."""
    accepted = with_bulk_lines(requests, body).filter(F.col("status") == 200)
    return accepted.select("request_id", F.posexplode("lines").alias("index", "value"))
