"""Hashes with unsigned 64-bit wrap-around, as pairs of 32-bit halves in longs.

Each half stays far below 2^63, so nothing overflows under ANSI mode and no decimal
arithmetic is needed until the very end.  Survey ids: H1, H2, H3, H5, H8, H14, H15.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = (1 << 32) - 1
# Fixed values of the two hashes.
DJB2_START, DJB2_FACTOR = 5381, 33
FNV_OFFSET, FNV_PRIME_LOW = 0xCBF29CE484222325, 0x1B3  # the prime is 2^40 + 0x1B3


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK32).cast("long"))


def _halves(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))


def octets(value: Column) -> Column:
    """The bytes of a string or binary as an array of longs."""
    text = F.hex(value)
    at = F.slice(F.sequence(F.lit(0), F.octet_length(value)), F.lit(2), F.octet_length(value))
    return F.transform(at, lambda i: F.conv(F.substring(text, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))


def djb2(value: Column) -> Column:
    """djb2 as a struct (hi, lo) of 32-bit halves (H1)."""

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"] * DJB2_FACTOR + b
        return _halves(_low(h["hi"] * DJB2_FACTOR + F.shiftright(lo, 32)), _low(lo))

    return F.aggregate(octets(value), _halves(F.lit(0), F.lit(DJB2_START)), step)


def fnv64(number: Column) -> Column:
    """FNV over the eight little-endian octets of a long, as (hi, lo) (H2)."""
    parts = F.array(*[F.shiftrightunsigned(number.cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long")) for k in range(8)])

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        low = lo * FNV_PRIME_LOW
        high = h["hi"] * FNV_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return _halves(_low(high), _low(low))

    return F.aggregate(parts, _halves(F.lit(FNV_OFFSET >> 32), F.lit(FNV_OFFSET & MASK32)), step)


def unsigned(halves: Column) -> Column:
    """The 64-bit value as decimal(20,0)."""
    return (halves["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + halves["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")


def modulo(halves: Column, n: int) -> Column:
    """The 64-bit value modulo n (below 2^31), in long arithmetic (H5)."""
    return (halves["hi"] % n * ((1 << 32) % n) + halves["lo"]) % n


def letters(number: Column, width: int = 2) -> Column:
    """A number as base-26 letters, ``AA`` for 0."""
    parts = [F.chr((F.floor(number / 26**k) % 26 + 65).cast("long")) for k in reversed(range(width))]
    return F.concat(*parts)


def next_letters(prefix: Column, width: int) -> Column:
    """The following prefix, Z carrying to A."""
    number = F.lit(0)
    for k in range(1, width + 1):
        number = number * 26 + F.ascii(F.substring(prefix, k, 1)) - 65
    return letters((number + 1) % 26**width, width)


def bucket_key(key: Column, n: int) -> Column:
    """The key behind the two-letter prefix of its hash bucket (H3)."""
    return F.concat(letters(modulo(djb2(key), n)), key)


def key_name(number: Column, hashed: bool) -> Column:
    """A generated key's name: the number, or its FNV hash (H8)."""
    return unsigned(fnv64(number)).cast("string") if hashed else number.cast("string")
