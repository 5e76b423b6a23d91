"""Text helpers shared by all expressions.

Patterns use explicit character classes instead of ``\\s`` and ``\\d``: the log
format counts every Unicode blank and digit, Java's shorthands only the ASCII
ones, and a spelled-out class is faster than the ``(?U)`` flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of every character that counts as a blank.
_BLANK_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
BLANKS = "".join(map(chr, _BLANK_POINTS))
# Latin-1 blanks go into one bit set and the others behind a range test, so that
# an ordinary character is decided in two or three steps instead of thirty.
_LATIN_BLANKS = "".join(rf"\x{p:02x}" for p in _BLANK_POINTS if p < 0x100)
_WIDE_BLANKS = "".join(r"\x{%x}" % p for p in _BLANK_POINTS if p >= 0x100)
_BLANK_SET = rf"{_LATIN_BLANKS}[[\x{{1680}}-\x{{3000}}]&&[{_WIDE_BLANKS}]]"

WS = f"[{_BLANK_SET}]"
NWS = rf"[\x21-\x7e[^\x21-\x7e{_BLANK_SET}]]"
DIGIT = r"\p{Nd}"

# Control characters that never reach an output value.
CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_line(c: Column) -> Column:
    """`strip` of a bare column of long texts.

    Trimming a set of characters walks a whole text and keeps every character's place. A text between two printable
    ASCII characters has no blank at its ends, which its first and last bytes tell.
    """
    ends = [F.substring(c.cast("binary"), F.lit(at), F.lit(1)) for at in (1, -1)]
    printable = [(end >= F.lit(b"!")) & (end <= F.lit(b"~")) for end in ends]
    return F.when(printable[0] & printable[1], c).otherwise(strip(c))


def replaced(c: Column, old: str, new: str) -> Column:
    """`replace` in a bare column; a text without ``old``, which is told sooner, stays as it is."""
    return F.when(F.contains(c, F.lit(old)), F.replace(c, F.lit(old), F.lit(new))).otherwise(c)


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def extract(c: Column, pattern: str, group: int) -> Column:
    """Group of the first match; ``''`` when there is none."""
    return F.regexp_extract(c, pattern, group)


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def apart(c: Column) -> Column:
    """A plain column itself, in a projection that is compiled on its own.

    Neighbouring projections are fused into one method, and the JVM never compiles a method of over 8000
    bytes, however often it runs. A projection with a lambda stays out of that and gets short methods.
    What is inside the lambda's argument is interpreted, so it is for bare columns.
    """
    return F.get(F.transform(F.array(c), lambda x: x), 0)


def after(c: Column, prefix: Column) -> Column:
    """What follows a known prefix of ``c``; both are bare columns.

    Bytes are cut where that is the same, as characters are counted from the start of a text to its end.
    """
    everything = F.lit(2**31 - 1)
    cut = F.substring(c.cast("binary"), F.octet_length(prefix) + 1, everything).cast("string")
    return F.when(prefix == "", c).when(F.startswith(c, prefix), cut).otherwise(
        F.substring(c, F.length(prefix) + 1, everything))


def contains_any(c: Column, words) -> Column:
    hit = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def first_hit(c: Column, table, default: Column) -> Column:
    """Ordered ``(result, words)`` table: the first row with a word inside ``c``."""
    expr = None
    for result, words in table:
        cond = contains_any(c, words)
        expr = F.when(cond, result) if expr is None else expr.when(cond, result)
    return expr.otherwise(default)


def lookup(c: Column, table: dict, default=None) -> Column:
    """Constant dictionary as an expression; no join and no shuffle."""
    items = ", ".join(
        f"{sql_text(k)}, {v if isinstance(v, int) else sql_text(v)}" for k, v in table.items()
    )
    hit = F.try_element_at(F.expr(f"map({items})"), c)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def sql_text(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(texts) -> str:
    return "array(" + ", ".join(map(sql_text, texts)) + ")"
