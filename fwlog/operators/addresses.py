"""Address against network lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fwlog.functions.net import address_hex, masked_prefix
from fwlog.functions.text import strip


def flag_member(df: DataFrame, address: str, networks: DataFrame, name: str) -> DataFrame:
    """Adds a flag: is the address inside any of the networks?

    Matched by equality on (prefix length, masked prefix) over the distinct addresses, so
    no pair of address and network is ever enumerated. The prefix lengths in use are one
    row of at most 33 + 129 numbers.
    """
    sizes = networks.agg(F.collect_set("bits").alias("__sizes"))
    nets = networks.select("family", "bits", F.col("lo").alias("prefix")).distinct()
    seen = df.select(F.col(address).alias("__address")).distinct()
    seen = seen.select("*", address_hex(F.col("__address")).alias("__hex")).filter(F.col("__hex").isNotNull())
    probes = seen.crossJoin(F.broadcast(sizes)).select(
        "__address",
        F.when(F.length("__hex") == 8, 4).otherwise(6).alias("family"),
        "__hex",
        F.explode("__sizes").alias("bits"),
    ).filter(F.col("bits") <= F.length("__hex") * 4)
    probes = probes.select(
        "__address", "family", "bits", masked_prefix(F.col("__hex"), F.col("bits")).alias("prefix")
    )
    members = (
        probes.join(nets, ["family", "bits", "prefix"], "left_semi")
        .select("__address").distinct().withColumn("__in", F.lit(True))
    )
    # One row per address on the right, so a hot sender only makes a large left
    # side, which AQE splits.
    joined = df.join(members, F.col(address) == F.col("__address"), "left")
    return joined.select(*df.columns, F.coalesce("__in", F.lit(False)).alias(name))


def split_by_allow_list(df: DataFrame, address: str, networks: DataFrame) -> DataFrame:
    """Adds ``allowed``. No network at all allows every row, even an invalid address."""
    empty = networks.agg((F.count(F.lit(1)) == 0).alias("__empty"))  # one row
    flagged = flag_member(df, address, networks, "__member").crossJoin(F.broadcast(empty))
    return flagged.select(*df.columns, (F.col("__member") | F.col("__empty")).alias("allowed"))


def allowed(df: DataFrame, address: str, networks: DataFrame) -> DataFrame:
    return split_by_allow_list(df, address, networks).filter("allowed").drop("allowed")


def rejected(df: DataFrame, address: str, networks: DataFrame) -> DataFrame:
    return split_by_allow_list(df, address, networks).filter("NOT allowed").drop("allowed")


def first_hop(forwarded: Column) -> Column:
    return strip(F.split_part(forwarded, F.lit(","), F.lit(1)))


def with_client_address(
    df: DataFrame, trusted: DataFrame, peer: str = "peer", forwarded: str = "xff"
) -> DataFrame:
    """Adds ``client_ip``: the first forwarded hop if a trusted proxy names a valid
    one, else the peer (J6)."""
    from fwlog.functions.net import is_address

    hop = first_hop(F.col(forwarded))
    flagged = flag_member(df, peer, trusted, "__trusted")
    return flagged.select(
        *df.columns,
        F.when(F.col("__trusted") & is_address(hop), hop)
        .otherwise(F.col(peer)).alias("client_ip"),
    )
