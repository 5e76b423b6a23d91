"""Log line -> flat record (P1-P10, P22, J1), as a chain of projections.

Each step adds a few columns that the next one reads more than once, so the
optimizer keeps the steps apart and evaluates every pattern once per line. There
is no shuffle and no Python on this path, and columns nobody asks for are pruned.
"""

from __future__ import annotations

import string
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions.actions import session_action
from fwlog.functions.memo import once
from fwlog.functions.net import is_address
from fwlog.functions.text import (
    DIGIT, NWS, WS, after, apart, extract, none_if_empty, replaced, sql_array, strip, strip_line,
)
from fwlog.operators import syslogs

# The header shapes.
_BSD = rf"[A-Z][a-z]{{2}}{WS}+{DIGIT}{{1,2}}{WS}+{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"
_ISO = (
    rf"{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}}T{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"
    rf"(?:\.{DIGIT}+)?(?:Z|[+-]{DIGIT}{{2}}:{DIGIT}{{2}})?"
)
_QUAD = rf"{DIGIT}+\.{DIGIT}+\.{DIGIT}+\.{DIGIT}+"
_MODULE = rf"(?:VsysId:{DIGIT}+{WS}+)?({NWS}+):{WS}*"

# priority, version digit (only before an ISO time), time
PREFIX = (
    rf"^(?:<({DIGIT}{{1,3}})>)?(?:({DIGIT}){WS}+(?={_ISO}{WS}+))?(?:({_BSD}|{_ISO}){WS}+)?"
)
# [address facility] hostname %%n [VsysId:n] module:
HEADER = rf"^(?:({_QUAD}){WS}+{NWS}+{WS}+)?({NWS}+){WS}+%%{DIGIT}{{1,4}}{WS}*{_MODULE}"
# everything up to and including the first %%n
MARKER = rf"(?s)^.*?%%{DIGIT}{{1,4}}+{WS}*+"
MARKER_TAIL = rf"%%{DIGIT}{{1,4}}{WS}*\z"
MODULE = rf"^{_MODULE}"
# Key(n)=value. The look-behind keeps the scan linear on hostile text.
_LETTER = "[A-Za-z_]"
FIELD = rf"(?<!{_LETTER})({_LETTER}+\({DIGIT}+\))={WS}*+([^;]*?){WS}*(?=;|\z)"
# A payload of plain pairs, one in every segment: no control character and no blank but spaces. Characters are spelled
# out, as a class without ranges is one bit set, and loops are greedy, as those over a class are the fast ones.
_KEY_CHARS = string.ascii_letters + "_"
_ASCII = "".join(rf"\x{p:02x}" for p in range(0x20, 0x7F) if chr(p) != ";")
_WIDE = r"\x{a1}-\x{167f}\x{3001}-\x{d7ff}"
PLAIN_PAIRS, WIDE_PAIRS = (
    rf"^(?:[{_KEY_CHARS}]+\([0123456789]+\)=[{chars}]*(?:;|\z))*+\z" for chars in (_ASCII, _ASCII + _WIDE)
)

_COLUMN_KEYS = {column: key for key, column in vocab.FIELD_COLUMNS.items()}
# Record columns that a system log may fill as well.
_SHARED = ("proto", "category", "event", "user", "src", "dst", "app")
_TEMP = "__"


def _t(name: str) -> Column:
    return F.col(_TEMP + name)


def _named(**columns: Column) -> list[Column]:
    return [c.alias(_TEMP + n) for n, c in columns.items()]


def _add(df: DataFrame, columns: list[Column]) -> DataFrame:
    return df.select("*", *columns)


@once
def _header_steps() -> list[list[Column]]:
    """``__line``, the header pieces and ``__payload``, one list per projection."""
    marked = F.contains(_t("rest"), F.lit("%%"))
    no_header = marked & (_t("header") == "")
    none = F.lit("")
    return [
        _named(prefix=extract(_t("line"), PREFIX, 0)),
        _named(rest=after(_t("line"), _t("prefix")), blank=_t("line").isNull() | (_t("line") == "")),
        _named(header=F.when(marked, extract(_t("rest"), HEADER, 0)).otherwise(none)),
        _named(marker=F.when(no_header, extract(_t("rest"), MARKER, 0)).otherwise(none)),
        _named(
            module_text=F.when(
                _t("marker") != "", extract(after(_t("rest"), _t("marker")), MODULE, 0)
            ).otherwise(none)
        ),
        _named(lead=F.concat(_t("header"), _t("marker"), _t("module_text"))),
        _named(payload=after(_t("rest"), _t("lead"))),
    ]


@once
def header_columns() -> dict[str, Column]:
    """Header metadata, read from the short header pieces and their groups only."""
    header, module_text = _t("header"), _t("module_text")
    before = strip(F.regexp_replace(_t("marker"), MARKER_TAIL, ""))

    def of_prefix(group):
        return none_if_empty(F.get(_t("prefix_groups"), group - 1))

    def of_header(group):
        return F.get(_t("header_groups"), group - 1)

    return {
        "_pri": of_prefix(1),
        "_rfc5424_ver": of_prefix(2),
        "_syslog_timestamp": of_prefix(3),
        "_src_ip": F.when(header != "", none_if_empty(of_header(1))).when(
            module_text != "", none_if_empty(extract(before, rf"^({_QUAD})(?={WS}|\z)", 1))
        ),
        "hostname": F.when(header != "", of_header(2)).when(
            module_text != "", none_if_empty(extract(before, rf"({NWS}+)\z", 1))
        ),
        "_module": F.when(header != "", of_header(3)).when(module_text != "", extract(module_text, MODULE, 1)),
    }


@once
def _group_step() -> list[Column]:
    """The groups of the prefix and of the header, matched once; no group holds the character they are cut at."""
    pieces = {"prefix": (PREFIX, ";"), "header": (HEADER, "\n")}
    return _named(**{
        f"{name}_groups": F.when(_t(name) != "", F.split(F.regexp_replace(_t(name), pattern, end.join(("$1", "$2", "$3"))), end))
        for name, (pattern, end) in pieces.items()
    })


def _module() -> Column:
    """The module alone, for the lines that may be system logs."""
    header, module_text = _t("header"), _t("module_text")
    return F.when(header != "", extract(header, HEADER, 3)).when(module_text != "", extract(module_text, MODULE, 1))


def _value(column: str) -> Column:
    """Value of the last occurrence of a column's key, null for an absent key."""
    return _value_at(F.array_position(_t("keys"), _COLUMN_KEYS[column]), F.lit(len(_COLUMN_KEYS[column])))


def _value_at(position: Column, key_length: Column) -> Column:
    pair = F.get(_t("pairs"), position.cast("int") - 1)
    return F.trim(F.substring(pair, key_length + 2, F.lit(2**31 - 1)))


def _usable(value: Column) -> Column:
    return (value == "") | is_address(value)


def _last_address(column: str) -> Column:
    """Last occurrence that is empty or a valid address.

    ``__last_<column>`` holds the last occurrence; only a line where that one is
    invalid looks at the earlier ones.
    """
    key, last = _COLUMN_KEYS[column], _t(f"last_{column}")
    named = F.filter(_t("pairs"), lambda p: F.startswith(p, F.lit(f"{key}=")))
    values = F.transform(named, lambda p: F.trim(F.substring(p, F.lit(len(key) + 2), F.lit(2**31 - 1))))
    return F.when(last.isNull() | _usable(last), last).otherwise(F.get(F.filter(values, _usable), 0))


@once
def _unknown_steps() -> list[list[Column]]:
    """``__unknown``, the keys of no column, and for lines with any the pairs as one text, which is searched sooner."""
    pairs = F.concat(F.lit(";"), F.array_join(_t("pairs"), ";"))
    return [
        _named(unknown=F.array_except(_t("keys"), _known_keys())),
        _named(joined=F.when(F.size(_t("unknown")) > 0, pairs)),
    ]


@once
def _extras() -> Column:
    """Unknown keys with their last value (P7); no pair holds a semicolon."""
    return F.map_from_entries(
        F.transform(
            _t("unknown"),
            lambda k: F.struct(
                F.concat(F.lit(vocab.UNKNOWN_KEY_PREFIX), k),
                F.trim(F.substring_index(
                    F.split_part(_t("joined"), F.concat(F.lit(";"), k, F.lit("=")), F.lit(2)), ";", 1)),
            ),
        )
    )


def _known_keys() -> Column:
    return F.expr(sql_array(_COLUMN_KEYS.values()))


def parser_counters() -> list[Column]:
    """Aggregates over ``reason`` (A1), for ``agg`` or, at a job's end, for ``observe``."""
    reason = F.col("reason")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(reason.isNull()).alias("parsed"),
        F.count_if(reason.isNotNull()).alias("failed"),
    ]


def fenced(df: DataFrame, column: str) -> DataFrame:
    """The same rows, such that filters on ``column`` stay above the step that computes it.

    Pushed further down, such a filter would repeat the whole chain of patterns inside its
    condition. Filters on the columns a frame came with still pass, down to the scan.
    """
    return df.select(*[F.explode(F.array(apart(F.col(c)))).alias(c) if c == column else c for c in df.columns])


@once
def _pair_steps() -> list[list[Column]]:
    """P5: ``__pairs``, every ``key=value``, last occurrence first, and their ``__keys``.

    A payload of plain pairs is cut at its semicolons; any other one is searched for keys.
    """
    payload, cut, bare, flat, plain = _t("payload"), _t("cut"), _t("bare"), _t("flat"), _t("plain")
    uncut = F.substring(payload.cast("binary"), F.lit(1), F.octet_length(payload) - 1).cast("string")
    ends = [f(cut, F.lit(c)) for f in (F.startswith, F.endswith) for c in "; "]
    none = F.array().cast("array<string>")
    heads, tails = (F.regexp_extract_all(payload, F.lit(FIELD), F.lit(g)) for g in (1, 2))
    searched = F.zip_with(heads, tails, lambda k, v: F.concat(k, F.lit("="), v))
    return [
        # trimming a set of characters walks a whole text, so it is for the payloads that need it
        _named(cut=F.when(F.contains(payload, F.lit(")=")), F.when(F.endswith(payload, F.lit(";")), uncut).otherwise(payload))),
        _named(bare=F.when(reduce(or_, ends), F.btrim(cut, F.lit("; "))).otherwise(cut)),
        _named(flat=replaced(bare, "; ", ";")),
        _named(plain=F.rlike(flat, F.lit(PLAIN_PAIRS)) | F.rlike(flat, F.lit(WIDE_PAIRS))),
        _named(pairs=F.when(plain, F.reverse(F.split(flat, ";"))).when(flat.isNotNull(), F.reverse(searched)).otherwise(none)),
        _named(keys=F.transform(_t("pairs"), lambda p: F.substring_index(p, "=", 1))),
    ]


@once
def _address_steps() -> list[list[Column]]:
    """``__last_<column>``, then ``__<column>``, per address column; whether there is a key that is no address."""
    others = [key for column, key in _COLUMN_KEYS.items() if column not in vocab.ADDRESS_COLUMNS]
    return [
        _named(
            **{f"last_{c}": _value(c) for c in vocab.ADDRESS_COLUMNS},
            # most lines have the first key, which is found sooner than any of a set
            known=F.array_contains(_t("keys"), others[0]) | F.arrays_overlap(_t("keys"), F.expr(sql_array(others))),
        ),
        _named(**{c: _last_address(c) for c in vocab.ADDRESS_COLUMNS}),
    ]


@once
def _system_steps() -> list[list[Column]]:
    """P11-P20 for lines without a recognised field whose module has a slash.

    They come before the record's other columns, while the rows are narrow, and so does ``reason``.
    """
    any_address = F.coalesce(*[_t(c) for c in vocab.ADDRESS_COLUMNS]).isNotNull()
    gate = ~_t("found") & F.contains(_t("module"), F.lit("/"))
    detail = syslogs.details(_t("kind"), _t("module"), _t("text"))
    return [
        _named(found=_t("known") | any_address),
        _named(module=F.when(~_t("found"), _module())),
        _named(text=F.when(gate, strip(_t("payload")))),
        _named(kind=F.when(_t("text").isNotNull(), syslogs.kind(_t("text")))),
        _named(sys=F.when(_t("kind").isNotNull(), detail)),
        [F.when(_t("blank"), "empty_line")
         .when(~_t("found") & _t("sys").isNull(), "no_recognized_fields").alias("reason")],
    ]


@once
def _record_columns() -> list[Column]:
    """The header and the values, all read from the pairs, the header pieces and the system record."""
    sys, heads = _t("sys"), header_columns()
    values = {c: _t(c) if c in vocab.ADDRESS_COLUMNS else _value(c) for c in vocab.SESSION_COLUMNS}
    return [
        *[(F.coalesce(v, sys[c]) if c in _SHARED else v).alias(c) for c, v in values.items()],
        heads["hostname"].alias("hostname"),
        _t("action").alias("action"),
        *[heads[c].alias(c) for c in vocab.HEADER_COLUMNS],
        *[sys[c].alias(c) for c in vocab.SYSTEM_COLUMNS],
        _extras().alias("extras"),
        F.col("reason"),
        F.lit(None).cast("string").alias("_csv_timestamp"),
    ]


@once
def _action() -> list[Column]:
    own = session_action(_t("fw_action"), _t("event"))
    # set apart by a bare column, as what is set apart is interpreted
    return _named(action=F.when(apart(F.col("reason")).isNull(), F.coalesce(_t("sys")["action"], own)))


def parse(df: DataFrame, value: str = "value", fence: bool = True) -> DataFrame:
    """Adds the record columns, ``extras`` and ``reason`` to every row.

    ``reason`` is null for a parsed line, else why it failed. Null means the key is
    absent, ``''`` that it is present without a value. Without the fence the rows are the
    same; the steps of columns nobody asks for, ``reason`` too, are then pruned, but a filter
    on ``reason`` would repeat the chain.
    """
    given = df.columns
    df = _add(df, _named(line=strip_line(F.col(value))))
    for step in _header_steps() + _pair_steps() + _address_steps() + _system_steps():
        df = _add(df, step)
    # the record's columns come after the fence: they are made of the lines that pass a filter on the reason
    if fence:
        df = fenced(df, "reason")
    else:
        # fused with the steps below, the record would make a method too long to be compiled
        df = df.select(*[apart(_t("header")).alias(c) if c == _TEMP + "header" else c for c in df.columns])
    for step in [_group_step(), *_unknown_steps()]:
        df = _add(df, step)
    df = _add(df, _named(fw_action=_value("fw_action"), event=_value("event")))
    df = _add(df, _action())
    return df.select(*given, *_record_columns())
