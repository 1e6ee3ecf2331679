"""Parsing, normalising and formatting of text columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions.numbers import half_up
from kerbside.vocab import SEVERITY_NAMES, WIND_BEARINGS


def lookup(value: Column, table: Mapping) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[value]


def blank_to_null(value: Column) -> Column:
    trimmed = F.trim(value.cast("string"))
    return F.when(trimmed != "", trimmed)


def first_value(*columns: Column) -> Column:
    """First column that is present and not blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def optional_double(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def normalise_header(header: str) -> str:
    """Column header without its ordinal, lower-case letters and digits only."""
    text = header.strip()
    digits = len(text) - len(text.lstrip("0123456789"))
    if digits and text[digits:digits + 1] == ".":
        text = text[digits + 1:]
    return "".join(ch for ch in text.lower() if ch.isascii() and ch.isalnum())


def f_to_c(value: Column) -> Column:
    return (value.cast("double") - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def first_number(value: Column) -> Column:
    """First token that reads as a number (``10 to 15 mph`` gives 10)."""
    tokens = F.split(F.trim(F.regexp_replace(value, "to", " ")), r"\s+")
    return F.get(F.filter(F.transform(tokens, lambda t: t.try_cast("double")), lambda n: n.isNotNull()), F.lit(0))


def wind_bearing(direction: Column) -> Column:
    return lookup(F.upper(direction), WIND_BEARINGS)


def parse_instant(value: Column) -> Column:
    """ISO instant with Z or an offset; a text without a zone is UTC, like the session."""
    return F.try_to_timestamp(value.cast("string"))


def parse_epoch(value: Column) -> Column:
    """Epoch seconds, or milliseconds from 1e10 on."""
    number = value.cast("double")
    return F.timestamp_micros(F.round(F.when(number >= 1e10, number * 1e3).otherwise(number * 1e6)).cast("long"))


def date_prefix(value: Column) -> Column:
    return F.to_date(F.substring(value, 1, 10), "yyyy-MM-dd")


def speech_text(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " "))


def speech_key(text: Column, voice: Column, speed: Column) -> Column:
    """Content address of a spoken line: normalised text, voice and speed."""
    return F.sha2(F.concat_ws("|", speech_text(text), voice, speed.cast("string")), 256)


def email_key(value: Column) -> Column:
    return F.lower(F.trim(value))


def clean_request_id(value: Column) -> Column:
    """Safe characters only; a missing, blank or overlong id is replaced by a new one."""
    usable = value.isNotNull() & (F.trim(value) != "") & (F.length(value) <= 64)
    return (F.when(usable, F.regexp_replace(value, r"[^A-Za-z0-9_.:-]", ""))
            .otherwise(F.expr("uuid()")))


def canonical_key(value: Column, aliases: Mapping[str, str], default: str | None = None,
                  strict: bool = True) -> Column:
    """Canonical name of an aliased key; an unknown key fails the row, or is null when not strict."""
    key = F.lower(F.trim(value))
    found = lookup(key, aliases)
    unknown = (F.raise_error(F.concat(F.lit("unknown key: "), key)).cast("string") if strict
               else F.lit(None).cast("string"))
    empty = value.isNull() | (key == "")
    return (F.when(empty, F.lit(default).cast("string"))
            .when(found.isNotNull(), found).otherwise(unknown))


def area_name(hazard: Column, severity: Column) -> Column:
    """``pm25_high`` style area id; a severity outside 1..4 fails the row."""
    name = F.element_at(F.array(*[F.lit(n) for n in SEVERITY_NAMES]), severity.cast("int"))
    return (F.when(severity.between(1, len(SEVERITY_NAMES)), F.concat_ws("_", hazard, name))
            .otherwise(F.raise_error(F.concat(F.lit("unsupported severity "), severity.cast("string")))
                       .cast("string")))


def fmt_offset(metres: Column) -> Column:
    return (F.when(metres >= 1000, F.format_string("%.1f km", metres / 1000))
            .otherwise(F.format_string("%.0f m", metres)))


def fmt_distance(metres: Column) -> Column:
    miles = metres / F.lit(1609.344)
    return (F.when(miles < 0.1, F.concat(half_up(metres).cast("long").cast("string"), F.lit(" m")))
            .otherwise(F.format_string("%.1f mi", miles)))


def fmt_duration(seconds: Column) -> Column:
    minutes = F.greatest(F.lit(1).cast("long"), half_up(seconds / 60).cast("long"))
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    return (F.when(minutes < 60, F.format_string("%d min", minutes))
            .when(rest > 0, F.format_string("%d hr %d min", hours, rest))
            .otherwise(F.format_string("%d hr", hours)))


def fmt_signed_percent(value: Column) -> Column:
    return (F.when(F.abs(value) < 0.05, F.lit("Same"))
            .when(value > 0, F.format_string("+%.1f%%", value))
            .otherwise(F.format_string("%.1f%%", value)))
