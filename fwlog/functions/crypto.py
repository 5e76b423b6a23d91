"""Encryption of message text, AES-256 in GCM mode.

Secrets are columns, never literals: they come from a key table, so no plan text and no
event log shows one. Every row is encrypted under a key of its own, derived from the secret
and a random salt that is stored in front of the cipher text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Passphrases that are refused.
_REFUSED = ("", "CHANGE_ME_USE_A_STRONG_PASSPHRASE", "changeme")
#: Rounds of the derivation of a secret from a passphrase.
ROUNDS = 200_000
#: What is stored before the cipher text: a nonce and a tag of an empty text.
SALT_BYTES = 28
DEFAULT_KEY = "default"


def secret_of(key_id: str, passphrase: str) -> bytearray:
    if passphrase in _REFUSED:
        raise ValueError("encryption needs a real passphrase")
    return bytearray(hashlib.pbkdf2_hmac("sha256", passphrase.encode(), f"fwlog:{key_id}".encode(), ROUNDS))


def key_table(spark: SparkSession, passphrases: dict[str, str]) -> DataFrame:
    """``(key_id, secret)`` of the given passphrases; a key table may as well be read from a store."""
    return spark.createDataFrame([(k, secret_of(k, p)) for k, p in passphrases.items()], "key_id string, secret binary")


def _row_key(salt: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.col("__secret"), salt), 256))


def _with_secret(df: DataFrame, keys: DataFrame, key_id: Column) -> DataFrame:
    # a key table is configuration: a row per key
    named = F.broadcast(keys.select(F.col("key_id").alias("__key_id"), F.col("secret").alias("__secret")))
    return df.join(named, key_id == F.col("__key_id"), "left")


def _bound(key_id: Column, aad: Column | None) -> Column:
    """What the cipher text is bound to: the key's name, and a text of the caller's choice."""
    return F.concat_ws(":", key_id, *([] if aad is None else [aad.cast("string")]))


def encrypt(df: DataFrame, keys: DataFrame, column: str, name: str, key_id: Column | str = DEFAULT_KEY, aad: Column | None = None) -> DataFrame:
    """df with ``name``: salt and cipher text of a text column under each row's key.

    An unknown key gives an error, a null text null.
    """
    key_id = F.lit(key_id) if isinstance(key_id, str) else key_id
    given = [c for c in df.columns if c != name]
    known = _with_secret(df, keys, key_id).withColumn("__bound", _bound(key_id, aad)).withColumn("__secret", F.coalesce(
        "__secret", F.raise_error(F.concat(F.lit("no key "), F.coalesce(key_id, F.lit("null")))).cast("binary")))
    salted = known.withColumn("__salt", F.aes_encrypt(F.lit(""), "__secret", F.lit("GCM")))
    data = F.aes_encrypt(
        F.col(column), _row_key(F.col("__salt")), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col("__bound"))
    return salted.select(*given, F.concat("__salt", data).alias(name))


def decrypt(df: DataFrame, keys: DataFrame, column: str, name: str, key_id: Column | str = DEFAULT_KEY, aad: Column | None = None) -> DataFrame:
    """df with ``name``: the text behind a column made by `encrypt` with the same keys and bindings."""
    key_id = F.lit(key_id) if isinstance(key_id, str) else key_id
    given = [c for c in df.columns if c != name]
    salt = F.substring(column, 1, SALT_BYTES)
    text = F.aes_decrypt(
        F.substring(F.col(column), SALT_BYTES + 1, F.lit(2**31 - 1)), _row_key(salt), F.lit("GCM"), F.lit("DEFAULT"), F.col("__bound"))
    known = _with_secret(df, keys, key_id).withColumn("__bound", _bound(key_id, aad))
    return known.select(*given, text.cast("string").alias(name))
