"""Response documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fwlog import vocab

_KEEP_NULLS = {"ignoreNullFields": "false"}


def public_fields() -> Column:
    """Record as JSON without metadata and absent keys; unknown keys are metadata."""
    return F.to_json(F.struct(*vocab.PUBLIC_COLUMNS))


def _line_result() -> Column:
    """JSON of one line; only a line that failed to parse has an ``error``."""
    text = F.col("message").alias("translated")
    done = F.to_json(F.struct("index", text), _KEEP_NULLS)
    failed = F.to_json(F.struct("index", text, F.lit("unparsable").alias("error")), _KEEP_NULLS)
    return F.when(F.col("reason").isNull(), done).otherwise(failed)


def bulk_documents(translated: DataFrame) -> DataFrame:
    """One document per request, results in line order.

    A request has at most 1000 lines, so a group is small by rule.
    """
    lines = translated.select(
        "request_id", "index", _line_result().alias("json"),
        F.col("message").isNotNull().cast("int").alias("done"),
    )
    grouped = lines.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("done").alias("translated"),
        F.array_sort(F.collect_list(F.struct("index", "json"))).alias("results"),
    )
    return grouped.select(
        "request_id", "count", "translated",
        F.concat(
            F.lit('{"count":'), F.col("count"), F.lit(',"translated":'), F.col("translated"),
            F.lit(',"results":['), F.array_join(F.col("results.json"), ","), F.lit("]}"),
        ).alias("document"),
    )
