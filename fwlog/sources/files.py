"""Files and landed streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fwlog.functions.text import strip

RAW_SCHEMA = T.StructType([
    T.StructField("msg_id", T.LongType()),
    T.StructField("recv_ts", T.TimestampType()),
    T.StructField("client_ip", T.StringType()),
    T.StructField("value", T.StringType()),
])


def decoded(data: Column) -> Column:
    """Bytes of a line as text: every maximal ill-formed part becomes one replacement character; outer blanks go."""
    return strip(F.make_valid_utf8(data.cast("string")))


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Every physical line, with broken UTF-8 replaced and outer blanks gone."""
    lines = spark.read.text(path)
    return lines.select(decoded(F.col("value")).alias("value"))


def not_blank(df: DataFrame, value: str = "value") -> DataFrame:
    return df.filter(strip(F.col(value)) != "")


def read_log(spark: SparkSession, path) -> DataFrame:
    return not_blank(read_lines(spark, path))


def is_csv_path(path: str) -> bool:
    return path.lower().endswith(".csv")


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed RAW files as a stream; the file cap bounds the rows in flight."""
    return (
        spark.readStream.schema(RAW_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def read_topic(
    spark: SparkSession, servers: str, topic: str, offsets_per_batch: int = 5_000_000
) -> DataFrame:
    """A message topic as a RAW stream: key = sender address, value = line.

    Needs the Kafka connector on the class path.
    """
    rows = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", offsets_per_batch)
        .load()
    )
    return rows.select(
        # one number per row: partition in the high bits, offset below
        (F.shiftleft(F.col("partition").cast("long"), 48) + F.col("offset")).alias("msg_id"),
        F.col("timestamp").alias("recv_ts"),
        F.col("key").cast("string").alias("client_ip"),
        F.make_valid_utf8(F.col("value").cast("string")).alias("value"),
    )
