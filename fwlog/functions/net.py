"""Addresses and networks.

An address becomes fixed-width lower-case hex text, 8 digits for IPv4 and 32 for
IPv6, so that a network is a range of text and one BETWEEN serves both families.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9a-fA-F]{1,4}"


def _v6_pattern() -> str:
    # Without '::' eight groups, or six and a dotted quad.
    shapes = [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{_V4}"]
    # With '::' at most seven groups in all; a dotted quad stands for two.
    for left in range(8):
        head = "" if left == 0 else rf"{_H}" + (rf"(?::{_H}){{{left - 1}}}" if left > 1 else "")
        room = 7 - left
        tails = [""]
        if room >= 1:
            tails.append(rf"(?:{_H}:){{0,{room - 1}}}{_H}")
        if room >= 2:
            tails.append(rf"(?:{_H}:){{0,{room - 2}}}{_V4}")
        shapes.append(rf"{head}::(?:{'|'.join(reversed(tails))})")
    return rf"(?:{'|'.join(shapes)})(?:%[^%/]+)?"


V4_PATTERN = rf"^{_V4}\z"
V6_PATTERN = rf"^(?s:{_v6_pattern()})\z"
ADDRESS_PATTERN = rf"^(?s:{_V4}|{_v6_pattern()})\z"


def is_v4(c: Column) -> Column:
    return F.rlike(c, F.lit(V4_PATTERN))


def is_address(c: Column) -> Column:
    """Valid IPv4 or IPv6 text; most addresses are decided by the cheap pattern."""
    return F.rlike(c, F.lit(V4_PATTERN)) | (
        F.contains(c, F.lit(":")) & F.rlike(c, F.lit(V6_PATTERN))
    )


def _hex(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def _v4_hex(c: Column) -> Column:
    parts = [F.split_part(c, F.lit("."), F.lit(i)).cast("bigint") for i in range(1, 5)]
    number = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    return _hex(number, 8)


def _groups(c: Column) -> Column:
    padded = F.transform(F.split(c, ":"), lambda g: F.lpad(F.lower(g), 4, "0"))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(padded)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once and written once into the plan."""
    return F.get(F.transform(F.array(value), body), 0)


def _quad_as_groups(bare: Column, quad: Column) -> Column:
    digits = _v4_hex(quad)
    return F.concat(
        F.substring(bare, F.lit(1), F.length(bare) - F.length(quad)),
        F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4),
    )


def _filled(left: Column, right: Column) -> Column:
    zeros = F.array_repeat(F.lit("0000"), F.lit(8) - F.size(left) - F.size(right))
    return F.concat(left, zeros, right)


def _v6_hex(c: Column) -> Column:
    def expand(plain):
        both = _let(
            F.struct(
                _groups(F.split_part(plain, F.lit("::"), F.lit(1))).alias("left"),
                _groups(F.split_part(plain, F.lit("::"), F.lit(2))).alias("right"),
            ),
            lambda g: _filled(g["left"], g["right"]),
        )
        return F.array_join(
            F.when(F.contains(plain, F.lit("::")), both).otherwise(_groups(plain)), ""
        )

    bare = F.split_part(c, F.lit("%"), F.lit(1))
    return _let(
        bare,
        lambda b: _let(
            F.regexp_extract(b, rf"({_V4})\z", 1),
            lambda q: _let(F.when(q == "", b).otherwise(_quad_as_groups(b, q)), expand),
        ),
    )


def address_hex(c: Column) -> Column:
    """Fixed-width hex of a valid address, null for anything else."""
    return F.when(is_v4(c), _v4_hex(c)).when(
        F.contains(c, F.lit(":")) & F.rlike(c, F.lit(V6_PATTERN)), _v6_hex(c)
    )


def _masked(hex_text: Column, bits: Column, fill: str) -> Column:
    """First ``bits`` bits of ``hex_text``, the rest set to ``fill`` (0 or f)."""
    whole = F.floor(bits / 4).cast("int")
    rest = (bits % 4).cast("int")
    digit = F.conv(F.substring(hex_text, whole + 1, F.lit(1)), 16, 10).cast("int")
    low = F.call_function("shiftright", F.lit(15), rest)
    kept = digit.bitwiseAND(F.lit(15).bitwiseXOR(low))
    mixed = F.lower(F.hex(kept if fill == "0" else kept.bitwiseOR(low)))
    head = F.concat(F.substring(hex_text, F.lit(1), whole), F.when(rest > 0, mixed).otherwise(""))
    return F.rpad(head, F.length(hex_text), fill)


def masked_prefix(hex_text: Column, bits: Column) -> Column:
    return _masked(hex_text, bits, "0")


def network(entry: Column) -> Column:
    """One list entry -> struct(family, bits, lo, hi); null when it is not a network.

    A bare host gets ``/32`` in either family, host bits are masked off, and the
    mask of an IPv4 network may also be a dotted net mask or host mask.
    """
    slashes = F.length(entry) - F.length(F.replace(entry, F.lit("/"), F.lit("")))
    host = F.split_part(entry, F.lit("/"), F.lit(1))
    mask = F.when(slashes == 1, F.substring_index(entry, "/", -1)).when(slashes == 0, "32")

    def of_host(h):
        is4 = F.length(h["hex"]) == 8
        number = F.when(F.rlike(h["mask"], F.lit(r"^[0-9]{1,9}\z")), h["mask"].cast("int"))
        dotted = F.when(is4 & is_v4(h["mask"]), _dotted_bits(h["mask"]))
        return _let(
            F.struct(h["hex"].alias("hex"), is4.alias("is4"), F.coalesce(number, dotted).alias("bits")),
            ranged,
        )

    def ranged(n):
        fits = n["bits"] <= F.when(n["is4"], 32).otherwise(128)
        return F.when(
            n["hex"].isNotNull() & fits,
            F.struct(
                F.when(n["is4"], 4).otherwise(6).alias("family"),
                n["bits"].alias("bits"),
                _masked(n["hex"], n["bits"], "0").alias("lo"),
                _masked(n["hex"], n["bits"], "f").alias("hi"),
            ),
        )

    return _let(F.struct(address_hex(host).alias("hex"), mask.alias("mask")), of_host)


def _dotted_bits(mask: Column) -> Column:
    def bits(text):
        ones = F.length(F.replace(text, F.lit("0"), F.lit("")))
        return (
            F.when(F.rlike(text, F.lit(r"^1*0*\z")), ones)
            .when(F.rlike(text, F.lit(r"^0*1*\z")), 32 - ones)
        )

    return _let(F.lpad(F.conv(_v4_hex(mask), 16, 2), 32, "0"), bits)


def list_entries(c: Column) -> Column:
    """Comma-separated text -> array of trimmed, non-empty entries."""
    from fwlog.functions.text import strip

    return F.filter(F.transform(F.split(c, ","), strip), lambda e: e != "")


def allows_all(c: Column) -> Column:
    from fwlog.functions.text import strip

    return strip(c).isin("0.0.0.0", "0.0.0.0/0")
