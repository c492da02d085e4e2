"""Keys, values and small scalars.  Survey ids: F6, F9, F10, H6, H7, H9-H13, H16, W7, W11."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentinels of region bounds.
LOWEST, HIGHEST = "-oo", "+oo"


def compare(a: Column, b: Column) -> Column:
    """Sign of b against a in unsigned-byte order; the shorter of two tied keys is smaller."""
    return F.when(a == b, 0).when(a < b, 1).otherwise(-1)


def at_or_above(key: Column, bound: Column) -> Column:
    """key >= bound, where the bound may be an infinity."""
    return (bound == LOWEST) | ((bound != HIGHEST) & (key >= bound))


def below(key: Column, bound: Column) -> Column:
    """key < bound, where the bound may be an infinity."""
    return (bound == HIGHEST) | ((bound != LOWEST) & (key < bound))


def value_slice(value: Column, offset: Column | int, size: Column | int) -> Column:
    """``size`` characters (bytes for binary) from ``offset``, from 0."""
    offset, size = (x if isinstance(x, Column) else F.lit(x) for x in (offset, size))
    return F.substring(value, offset + 1, size)


def offset_too_large(value: Column, offset: Column | int) -> Column:
    return F.length(value) < (offset if isinstance(offset, Column) else F.lit(offset))


def bytes_remaining(value: Column, offset: Column | int, size: Column | int) -> Column:
    """What a slice leaves unread."""
    offset, size = (x if isinstance(x, Column) else F.lit(x) for x in (offset, size))
    return F.greatest(F.length(value) - offset - size, F.lit(0))


def put_at(value: Column, patch: Column, offset: Column | int) -> Column:
    """The value with ``patch`` written over it from ``offset``."""
    return F.overlay(value, patch, (offset if isinstance(offset, Column) else F.lit(offset)) + 1)


def segment_start(offset: Column, size: int) -> Column:
    return offset - offset % size  # H6


def padding(size: Column, unit: int) -> Column:
    """Bytes that fill a message up to whole units (H7)."""
    return F.pmod(-size, F.lit(unit))


def joined(*parts: Column) -> Column:
    """Concatenation that skips nulls (H9)."""
    return F.concat_ws("", *parts)


def parse_bool(text: Column) -> Column:
    """True, false or - for anything else - null."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "yes", "on", "1"), True).when(word.isin("false", "no", "off", "0"), False)


def host_of(server: Column) -> Column:
    """What stands before the last colon."""
    return F.regexp_replace(server, ":[^:]*$", "")


def is_subnet(text: Column) -> Column:
    """One to four dotted numbers of at most 255 with an optional closing dot."""
    part = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return text.rlike(rf"^{part}(\.{part}){{0,3}}\.?$")


def micros_between(a: Column, b: Column, round_up: bool = False) -> Column:
    """Elapsed microseconds, truncated, or plus one."""
    return F.timestamp_diff("MICROSECOND", a, b) + (1 if round_up else 0)
