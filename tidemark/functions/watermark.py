"""Watermark types: the smallest step after a value, and typed literals."""

from __future__ import annotations

import datetime as dt
import decimal
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TIMESTAMP = "9999-12-31 23:59:59.999999"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_type(type_name: str) -> tuple[str, int | None, int | None]:
    """Split ``TIMESTAMP(3)``, ``NUMBER(10,2)``, ``DATE`` into (name, precision, scale).

    ``TIMESTAMP(n) WITH [LOCAL] TIME ZONE`` is read as ``TIMESTAMPTZ``, an instant.
    """
    plain, zoned = re.subn(r"\s+WITH\s+(LOCAL\s+)?TIME\s+ZONE\s*$", "", type_name.upper())
    if zoned:
        name, digits, _ = parse_type(plain)
        if name != "TIMESTAMP":
            raise ValueError(f"cannot read type {type_name!r}")
        return "TIMESTAMPTZ", digits, None
    m = re.fullmatch(r"\s*([A-Z][A-Z0-9_ ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\))?\s*", type_name.upper())
    if not m:
        raise ValueError(f"cannot read type {type_name!r}")
    name, a, b = m.groups()
    return name, int(a) if a else None, int(b) if b else None


def successor(col: Column | str, type_name: str) -> Column:
    """Next representable watermark, or NULL where none is defined.

    DATE steps one second, TIMESTAMP(n) 10^-n seconds, NUMBER(p,s) 10^-s. Spark timestamps hold
    microseconds, so TIMESTAMP(7..9) expects BIGINT nanoseconds. A zoned timestamp is an instant column. NUMBER without scale and binary
    doubles have no successor. The largest value has none either: such a window stays unsealed.
    """
    c = _c(col)
    name, first, second = parse_type(type_name)
    if name in ("DATE", "TIMESTAMP", "TIMESTAMPTZ"):
        digits = 0 if name == "DATE" else first
        kind = "timestamp" if name == "TIMESTAMPTZ" else "timestamp_ntz"
        if digits is None or not 0 <= digits <= 9:
            return F.lit(None).cast(kind)
        if digits > 6:
            step = 10 ** (9 - digits)
            return F.when(c <= F.lit(2**63 - 1 - step), c + F.lit(step))
        step_us = 10 ** (6 - digits)
        limit = F.lit(MAX_TIMESTAMP).cast(kind)
        room = c <= limit - F.make_dt_interval(secs=F.lit(decimal.Decimal(step_us).scaleb(-6)))
        return F.when(room, c + F.make_dt_interval(secs=F.lit(decimal.Decimal(step_us).scaleb(-6))))
    if name == "NUMBER" and first is not None:
        scale = second or 0
        step = decimal.Decimal(1).scaleb(-scale)
        top = decimal.Decimal(10) ** (first - scale) - step
        kind = T.DecimalType(first, scale)
        room = c < F.lit(top).cast(T.DecimalType(38, max(scale, 0)))
        return F.when(room, (c.cast(T.DecimalType(38, max(scale, 0))) + F.lit(step)).cast(kind))
    return F.lit(None).cast("double")


def typed_literal(value, type_name: str, timestamp_word: str = "TIMESTAMP") -> str:
    """SQL literal of exactly the watermark's type, so the source never converts implicitly.

    ``timestamp_word`` is TIMESTAMP_NTZ where the text is run by Spark itself.
    """
    name, _, _ = parse_type(type_name)
    if value is None:
        return "NULL"
    if name in ("DATE", "TIMESTAMP", "TIMESTAMPTZ"):
        if not isinstance(value, dt.datetime):
            raise TypeError(f"{type_name} literal needs a datetime, got {type(value).__name__}")
        if (value.utcoffset() is None) == (name == "TIMESTAMPTZ"):
            raise TypeError(f"{type_name} literal and the time zone of {value!r} do not go together")
        if name == "TIMESTAMPTZ":
            offset = value.strftime("%z")
            return f"TIMESTAMP '{value.strftime('%Y-%m-%d %H:%M:%S.%f')} {offset[:3]}:{offset[3:5]}'"
        if name == "DATE":
            return f"{timestamp_word} '{value.strftime('%Y-%m-%d %H:%M:%S')}'"
        return f"{timestamp_word} '{value.strftime('%Y-%m-%d %H:%M:%S.%f')}'"
    if name in ("NUMBER", "BIGINT", "INTEGER"):
        if isinstance(value, bool) or not isinstance(value, (int, decimal.Decimal)):
            raise TypeError(f"{type_name} literal needs an int or Decimal, got {type(value).__name__}")
        return f"{value:f}" if isinstance(value, decimal.Decimal) else str(value)
    if name in ("VARCHAR", "VARCHAR2", "CHAR"):
        return "'" + str(value).replace("'", "''") + "'"
    raise ValueError(f"no literal form for {type_name}")
