"""Action of a session record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions.text import DIGIT, extract, first_hit, lookup, strip


def event_code(event: Column) -> Column:
    """Leading ``(n)`` of an event text; ``''`` when there is none."""
    return extract(event, rf"^\(({DIGIT}+)\)", 1)


def event_action(event: Column) -> Column:
    """A code decides alone, known or not; only text without a code is searched."""
    code = event_code(event)
    by_text = first_hit(F.lower(event), vocab.TEXT_ACTIONS, F.lit("unknown"))
    return F.when(
        F.startswith(event, F.lit("(")) & (code != ""),
        lookup(code, vocab.CODE_ACTIONS, "unknown"),
    ).otherwise(by_text)


def session_action(fw_action: Column, event: Column) -> Column:
    direct = F.lower(strip(fw_action))
    return F.when(fw_action != "", direct).otherwise(
        event_action(F.coalesce(event, F.lit("")))
    )
