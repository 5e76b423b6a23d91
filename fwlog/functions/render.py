"""Record -> output text.

Sanitising is decided once per record: one pattern over the joined values tells
whether any of them needs it, and only such records pay for the field-by-field
clean-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions.actions import event_code
from fwlog.functions.memo import once
from fwlog.functions.text import CONTROL, apart, lookup, rstrip, sql_array, sql_text

_CONTROL_CHARS = "".join(map(chr, [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]))


def clean_kv(c: Column) -> Column:
    """Key-value text value: blanks to ``_``; control and separator characters out."""
    return F.translate(c, " ;=\n\r\t" + _CONTROL_CHARS, "_")


def clean_cef_header(c: Column) -> Column:
    """CEF header value: control characters out, ``\\`` and ``|`` escaped."""
    c = F.translate(c, _CONTROL_CHARS, "")
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def clean_cef_value(c: Column) -> Column:
    """CEF extension value: control characters out; ``\\``, ``=`` and line ends escaped."""
    c = F.translate(c, _CONTROL_CHARS, "")
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("="), F.lit("\\="))
    c = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.replace(c, F.lit("\r"), F.lit("\\n"))


def _shown(column: str) -> str:
    """Output value; null for absent, empty and placeholder."""
    return f"CASE WHEN `{column}` NOT IN ('', '--') THEN `{column}` END"


def _joined(separator: str, leads, columns) -> Column:
    """The output values behind their leads, as they are."""
    pairs = (f"concat({sql_text(lead)}, {_shown(c)})" if lead else _shown(c) for lead, c in zip(leads, columns))
    return F.expr(f"concat_ws({sql_text(separator)}, {', '.join(pairs)})")


def _cleaned(separator: str, leads, columns, clean) -> Column:
    """The output values behind their leads, each cleaned; for the few records that need it."""
    shown = F.expr(f"array({', '.join(map(_shown, columns))})")
    pairs = F.zip_with(F.expr(sql_array(leads)), F.transform(shown, clean), lambda lead, v: F.concat(lead, v))
    return F.concat_ws(separator, pairs)


def _staged(df: DataFrame, columns) -> DataFrame:
    """The output values as one text, which tells whether there are any and whether they are clean.

    The projection is set apart, which took less time when measured (README); why was not established.
    """
    given = [apart(F.col(c)).alias(c) if c == "proto" else F.col(c) for c in df.columns]
    return df.select(*given, _joined("", [""] * len(columns), columns).alias("__joined"))


def _formattable() -> Column:
    return F.col("proto").isNotNull() & (F.col("__joined") != "")


@once
def _key_values(columns: tuple) -> Column:
    """``k=v`` pairs in the given order, null when the record has no ``proto``."""
    leads = [f"{c}=" for c in columns]
    dirty = F.rlike("__joined", F.lit(r"[\x00-\x1f\x7f;=]"))
    # In a clean record only blanks change, so the joiner can be any control
    # character and the blanks of the whole text are replaced at once.
    quick = _joined("\x01", leads, columns)
    quick = F.replace(F.replace(quick, F.lit(" "), F.lit("_")), F.lit("\x01"), F.lit(" "))
    careful = _cleaned(" ", leads, columns, clean_kv)
    return F.when(_formattable(), F.when(dirty, careful).otherwise(quick))


def cef_severity(action: Column) -> Column:
    return lookup(action, vocab.ACTION_SEVERITY, vocab.DEFAULT_SEVERITY)


def cef_event_name(action: Column) -> Column:
    return lookup(action, vocab.ACTION_NAMES, vocab.DEFAULT_EVENT_NAME)


def cef_signature(event: Column, action: Column) -> Column:
    code = event_code(F.coalesce(event, F.lit("")))
    return F.when(
        code == "", F.concat(F.lit(vocab.ACTION_SIGNATURE_PREFIX), F.upper(action))
    ).otherwise(lookup(code, vocab.CODE_SIGNATURES, vocab.DEFAULT_SIGNATURE))


def _cef_leads():
    for _, key in vocab.CEF_KEYS:
        label = vocab.CEF_LABELS.get(key)
        yield f"{key}Label={label} {key}=" if label else f"{key}="


@once
def _cef() -> Column:
    """Full CEF message, null when the record has no ``proto`` or no value."""
    action = F.coalesce(F.col("action"), F.lit("unknown"))
    dirty = F.rlike("__joined", F.lit(rf"[{CONTROL}\\=\n\r]"))
    leads, columns = list(_cef_leads()), [c for c, _ in vocab.CEF_KEYS]
    values = F.when(dirty, _cleaned(" ", leads, columns, clean_cef_value)).otherwise(_joined(" ", leads, columns))
    message = F.concat(
        F.lit(vocab.CEF_PREFIX),
        clean_cef_header(cef_signature(F.col("event"), action)), F.lit("|"),
        cef_event_name(action), F.lit("|"),
        cef_severity(action).cast("string"), F.lit("|"),
        values,
    )
    return F.when(_formattable(), F.substring(message, 1, vocab.CEF_MAX_CHARS))


def formatter_counters(message: str = "message") -> list[Column]:
    """Aggregates over formatted parsed lines (A2)."""
    parsed = F.col("reason").isNull()
    return [
        F.count_if(parsed & F.col(message).isNotNull()).alias("formatted"),
        F.count_if(parsed & F.col(message).isNull()).alias("skipped"),
    ]


def add_message(df: DataFrame, mode: str = "cef", name: str = "message") -> DataFrame:
    """Adds the text of each record in mode core, extended or cef; any other mode
    means cef. Null for a record that cannot be formatted (X15)."""
    columns = {
        "core": vocab.CORE_COLUMNS,
        "extended": vocab.CORE_COLUMNS + vocab.EXTENDED_COLUMNS,
    }.get(mode.lower())
    text = _key_values(columns) if columns else _cef()
    shown = columns or tuple(c for c, _ in vocab.CEF_KEYS)
    return _staged(df, shown).select(*df.columns, text.alias(name))


def priority(facility: str | Column, severity: str | Column) -> Column:
    """Syslog PRI number (X11)."""
    facility = F.lit(facility) if isinstance(facility, str) else facility
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return (
        lookup(F.lower(facility), vocab.FACILITIES, vocab.DEFAULT_FACILITY_NUMBER) * 8
        + lookup(F.lower(severity), vocab.SEVERITIES, vocab.DEFAULT_SEVERITY_NUMBER)
    )


def envelope_host() -> Column:
    cleaned = F.regexp_replace(F.col("hostname"), r"[\x00-\x1f\x7f|<>\\]", "")
    return F.coalesce(
        F.substring(cleaned, 1, vocab.HOSTNAME_MAX_CHARS), F.lit(vocab.DEFAULT_HOSTNAME)
    )


def envelope_time() -> Column:
    """Export time, else header time; ``''`` when there is neither."""
    given = F.coalesce(
        F.nullif(F.col("_csv_timestamp"), F.lit("")), F.col("_syslog_timestamp"), F.lit("")
    )
    return F.substring(F.translate(given, _CONTROL_CHARS, ""), 1, vocab.TIMESTAMP_MAX_CHARS)


def add_envelope(
    df: DataFrame,
    mode: str = "cef",
    facility: str = "local0",
    severity: str = "info",
    include_timestamp: bool = True,
    message: str = "message",
    name: str = "syslog",
) -> DataFrame:
    """Adds ``<PRI>[TIME ]HOST TEXT`` around a message column; key-value text also
    gets a tag (X12-X14)."""
    tag = vocab.ENVELOPE_TAG if mode.lower() in ("core", "extended") else ""
    time = envelope_time()
    lead = F.when(time != "", F.concat(time, F.lit(" "))).otherwise("")
    return df.select(
        "*",
        F.concat(
            F.lit("<"), priority(facility, severity).cast("string"), F.lit(">"),
            lead if include_timestamp else F.lit(""),
            envelope_host(), F.lit(" " + tag), F.col(message),
        ).alias(name),
    )


def delivered(text: Column) -> Column:
    """Text as delivered: over 8192 bytes it is cut to 8192 characters."""
    cut = rstrip(F.substring(text, 1, vocab.DELIVERY_MAX))
    return F.when(F.octet_length(text) > vocab.DELIVERY_MAX, cut).otherwise(text)
