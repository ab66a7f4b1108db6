"""Canonical byte text of column values and the two-level row hash."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the hash format.
TAG_NULL = "00"
TAG_STRING = "01"
TAG_NUMBER = "02"
TAG_TIMESTAMP = "03"
TAG_BINARY = "04"
TAG_LOB = "05"
GROUP_MARK = "FE"
ROW_MARK = "FF"
GROUP_SIZE = 32
MAX_COLUMNS = 1024
DEFAULT_STRING_BYTES = 2000


@dataclass(frozen=True)
class ColumnRule:
    """How one mapped column takes part in the row hash.

    ``kind`` is STRING, CHAR, NUMBER, TIMESTAMP, BINARY or LOB; NUMBER needs a ``scale``. ``floating`` marks
    a binary floating-point column, whose NaN and infinities have a text of their own.
    """

    name: str
    kind: str
    precision: int = 38
    scale: int | None = None
    max_bytes: int = DEFAULT_STRING_BYTES
    floating: bool = False


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nfc(col: Column | str) -> Column:
    """Unicode NFC inside the JVM, by the ICU library that Spark ships for its collations.

    ASCII text (as many bytes as characters) is already normal and skips the call.
    """
    c = _c(col)
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    plain = c.isNull() | (F.octet_length(c) == F.char_length(c))
    return F.when(plain, c).otherwise(composed)


def canon_number(col: Column | str, precision: int = 38, scale: int = 0, floating: bool = False, strict: bool = True) -> Column:
    """Fixed decimal text: HALF_UP at ``scale``, exactly ``scale`` digits, no exponent, no ``-0``.

    Zero at scale 2 is written ``0.00``: the exact-digits rule wins over the bare ``0`` example.
    A negative scale rounds to that power of ten and prints no fraction. ``floating`` columns write NaN and
    the infinities as ``NaN``, ``Infinity`` and ``-Infinity``, so none of them equals NULL or another. A value with
    more than 38 digits at the scale is an error, or NULL where not ``strict``.
    """
    c, kind = _c(col), T.DecimalType(38, max(scale, 0))
    text = (F.round(c, scale).cast(kind) if strict else F.round(c, scale).try_cast(kind)).cast("string")
    if not floating:
        return text
    special = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(special, c.cast("string")).otherwise(text)


def canon_timestamp(col: Column | str) -> Column:
    """27-byte UTC text with microseconds. Wall-clock values are taken as UTC as they are."""
    return F.date_format(_c(col), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def canon_string(col: Column | str) -> Column:
    """UTF-8 bytes of the NFC text; the empty string counts as NULL."""
    c = _c(col)
    return nfc(F.when(c != "", c)).cast("binary")


def canon_char(col: Column | str) -> Column:
    """Blank-padded text: trailing spaces are not part of the value."""
    return canon_string(F.rtrim(_c(col)))


def canon_binary(col: Column | str) -> Column:
    """Raw bytes, unchanged."""
    return _c(col).cast("binary")


def canon_lob(col: Column | str) -> Column:
    """SHA-256 of large content, as 32 bytes."""
    return F.unhex(F.sha2(_c(col).cast("binary"), 256))


# Big-endian lengths 0…255 in one literal: short values take theirs by position.
_SHORT_LENGTHS = b"".join(n.to_bytes(4, "big") for n in range(256))


def _length_bytes(content: Column, short: bool) -> Column:
    n = F.octet_length(content)
    by_position = F.substring(F.lit(_SHORT_LENGTHS), n * 4 + 1, F.lit(4))
    if short:
        return by_position
    return F.when(n < 256, by_position).otherwise(F.unhex(F.lpad(F.hex(n), 8, "0")))


def frame(content: Column, tag: str, short: bool = False) -> Column:
    """TAG, 4-byte length, bytes; NULL becomes tag 00 with length 0.

    ``short`` promises fewer than 256 bytes, as numbers, timestamps and digests always have.
    """
    full = F.concat(F.lit(bytes.fromhex(tag)), _length_bytes(content, short), content)
    return F.coalesce(full, F.lit(bytes.fromhex(TAG_NULL + "00000000")))


def column_bytes(rule: ColumnRule) -> Column:
    """Framed bytes of one mapped column. Text longer than ``max_bytes`` takes the LOB path.

    A number that does not fit its rule has no bytes: NULL, which no value and no NULL value has.
    """
    kind = rule.kind.upper()
    if kind in ("STRING", "CHAR"):
        text = canon_string(rule.name) if kind == "STRING" else canon_char(rule.name)
        return F.when(F.octet_length(text) > rule.max_bytes, frame(canon_lob(text), TAG_LOB, short=True)
                      ).otherwise(frame(text, TAG_STRING))
    if kind == "NUMBER":
        if rule.scale is None:
            raise ValueError(f"{rule.name}: a NUMBER column needs a fixed scale")
        text = canon_number(rule.name, rule.precision, rule.scale, rule.floating, strict=False)
        fits = F.col(rule.name).isNull() | text.isNotNull()
        return F.when(fits, frame(text.cast("binary"), TAG_NUMBER, short=True))
    if kind == "TIMESTAMP":
        return frame(canon_timestamp(rule.name).cast("binary"), TAG_TIMESTAMP, short=True)
    if kind == "BINARY":
        return frame(canon_binary(rule.name), TAG_BINARY)
    if kind == "LOB":
        return frame(canon_lob(canon_string(rule.name)), TAG_LOB, short=True)
    raise ValueError(f"{rule.name}: {rule.kind} cannot be hashed")


def _count_bytes(n: int) -> Column:
    return F.lit(n.to_bytes(4, "big"))


def _digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def row_hash(rules: Sequence[ColumnRule]) -> Column:
    """Two-level SHA-256 over the mapped columns in mapping order, as lower-case hex.

    NULL for a row with a number that does not fit its rule: comparisons report such rows as UNCOMPARED.
    """
    if not rules:
        raise ValueError("row_hash needs at least one column")
    if len(rules) > MAX_COLUMNS:
        raise ValueError(f"{len(rules)} columns exceed the limit of {MAX_COLUMNS}")
    return combine([_digest(column_bytes(r)) for r in rules])


def combine(digests: Sequence[Column]) -> Column:
    """Second level of the row hash: column digests in groups of 32, group digests in one row digest."""
    groups = [digests[i:i + GROUP_SIZE] for i in range(0, len(digests), GROUP_SIZE)]
    group_digests = [
        _digest(F.concat(F.lit(bytes.fromhex(GROUP_MARK)), _count_bytes(len(g)), *g)) for g in groups
    ]
    return F.sha2(
        F.concat(F.lit(bytes.fromhex(ROW_MARK)), _count_bytes(len(digests)), *group_digests), 256)


def rules_from_schema(schema: T.StructType, columns: Sequence[str] | None = None,
                      scales: Mapping[str, int] | None = None) -> list[ColumnRule]:
    """Default mapping: integers at scale 0, decimals at their scale, doubles at the scale that ``scales`` gives.

    A floating-point column without a scale has no canonical text and is refused.
    """
    out = []
    for name in columns or schema.names:
        dt = schema[name].dataType
        if isinstance(dt, T.DecimalType):
            out.append(ColumnRule(name, "NUMBER", dt.precision, dt.scale))
        elif isinstance(dt, T.IntegralType):
            out.append(ColumnRule(name, "NUMBER", 38, 0))
        elif isinstance(dt, (T.DoubleType, T.FloatType)):
            if name not in (scales or {}):
                raise ValueError(f"{name}: a floating-point column needs a fixed scale")
            out.append(ColumnRule(name, "NUMBER", 38, scales[name], floating=True))
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(ColumnRule(name, "TIMESTAMP"))
        elif isinstance(dt, T.BinaryType):
            out.append(ColumnRule(name, "BINARY"))
        elif isinstance(dt, T.StringType):
            out.append(ColumnRule(name, "STRING"))
        else:
            raise ValueError(f"{name}: {dt.simpleString()} has no hash rule")
    return out
