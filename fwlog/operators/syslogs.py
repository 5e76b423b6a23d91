"""Free-text system logs.

Reached only by lines without a recognised field whose module reads
``NAME/severity[/mnemonic]``. One ``kind`` column fixes which rule applies, then
each output column is a CASE over it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions.net import is_v4
from fwlog.functions.text import DIGIT, NWS, WS, extract, first_hit, strip

_QUAD = rf"{DIGIT}+\.{DIGIT}+\.{DIGIT}+\.{DIGIT}+"
_COMMAND = rf"User=([^;]+);{WS}*Command{WS}+is{WS}+([^\n]*)"

# The message shapes.
LOGIN = rf"(?iu)^({NWS}+){WS}+logged{WS}+(in|out){WS}+from{WS}+({_QUAD})"
COMMAND_DASHED = rf"(?iu)^-Line=({NWS}*)-IPAddr=({_QUAD})-{_COMMAND}"
COMMAND_LOOSE = rf"(?iu)^-?Line=({NWS}*){WS}*-?IPAddr=({_QUAD}){WS}*-?{_COMMAND}"
CHANGED_BY = rf"by{WS}+({NWS}+)"
INTERFACE = (
    r"(?iu)((?:GigabitEthernet|Ten-GigabitEthernet|Ethernet|Vlan-interface|LoopBack)"
    rf"{NWS}*){WS}+[^\n]{{0,100}}?(up|down)"
)
USER_WORD = rf"(?:user|username|User|Username)[=:{WS}]+({NWS}+)"


def kind(text: Column) -> Column:
    """Which rule applies, in strict first-match order."""
    lowered = F.lower(text)
    return (
        F.when(F.rlike(text, F.lit(LOGIN)), "login")
        .when(F.rlike(text, F.lit(COMMAND_DASHED)), "command_dashed")
        .when(F.rlike(text, F.lit(COMMAND_LOOSE)), "command_loose")
        .when(
            F.contains(lowered, F.lit("configuration")) & F.contains(lowered, F.lit("changed")),
            "config",
        )
        .when(F.rlike(text, F.lit(INTERFACE)), "interface")
        .otherwise("generic")
    )


def _clean_user(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), 1, vocab.USER_CHARS)


def _address(c: Column) -> Column:
    return F.when(is_v4(c), c)


def details(kind: Column, module: Column, text: Column) -> Column:
    """The system record of one message as a struct."""
    dashed, loose = kind == "command_dashed", kind == "command_loose"
    generic = kind == "generic"

    quads = F.filter(F.regexp_extract_all(text, F.lit(f"({_QUAD})"), F.lit(1)), is_v4)
    named = F.regexp_extract_all(text, F.lit(USER_WORD), F.lit(1))
    named_user = _clean_user(F.rtrim(F.get(named, 0), F.lit(".,;")))
    by_user = F.get(F.regexp_extract_all(text, F.lit(CHANGED_BY), F.lit(1)), 0)

    user = (
        F.when(kind == "login", _clean_user(extract(text, LOGIN, 1)))
        .when(dashed, _clean_user(strip(extract(text, COMMAND_DASHED, 3))))
        .when(loose, _clean_user(strip(extract(text, COMMAND_LOOSE, 3))))
        .when(kind == "config", _clean_user(by_user))
        .when(generic, named_user)
    )
    src = (
        F.when(kind == "login", _address(extract(text, LOGIN, 3)))
        .when(dashed, _address(extract(text, COMMAND_DASHED, 2)))
        .when(loose, _address(extract(text, COMMAND_LOOSE, 2)))
        .when(generic, F.get(quads, 0))
    )
    line = F.when(dashed, extract(text, COMMAND_DASHED, 1)).when(loose, extract(text, COMMAND_LOOSE, 1))
    app = (
        F.when(line == "", "CLI:unknown")
        .when(dashed | loose, F.concat(F.lit("CLI:"), line))
        .when(kind == "config", "CONFIGURATION")
        .when(kind == "interface", extract(text, INTERFACE, 1))
    )
    command = F.when(dashed, extract(text, COMMAND_DASHED, 4)).when(loose, extract(text, COMMAND_LOOSE, 4))

    name = F.upper(F.split_part(module, F.lit("/"), F.lit(1)))
    last = F.upper(F.substring_index(module, "/", -1))
    mnemonic = F.when(F.get(F.split(module, "/"), 2).isNotNull(), last).otherwise(name)
    known_party = F.get(quads, 0).isNotNull() | F.get(named, 0).isNotNull()
    action = (
        F.when(
            kind == "login",
            F.when(F.lower(extract(text, LOGIN, 2)) == "in", "permit").otherwise("close"),
        )
        .when(
            generic & known_party,
            first_hit(mnemonic, vocab.MNEMONIC_ACTIONS, F.lit("log")),
        )
        .otherwise("log")
    )
    return F.struct(
        F.lit("SYSLOG").alias("proto"),
        name.alias("category"),
        F.concat(
            module, F.lit(": "), F.substring(text, 1, vocab.SYSTEM_TEXT_CHARS)
        ).alias("event"),
        user.alias("user"),
        src.alias("src"),
        F.when(generic, F.get(quads, 1)).alias("dst"),
        app.alias("app"),
        action.alias("action"),
        F.lit("system").alias("_log_type"),
        F.substring(strip(command), 1, vocab.SYSTEM_TEXT_CHARS).alias("_command"),
        F.when(kind == "interface", F.upper(extract(text, INTERFACE, 2))).alias("_status"),
    )
