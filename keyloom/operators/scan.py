"""Point reads and ordered scans over a state (key, value, ...).

Bounds are plain comparisons on ``key``, so they reach the Parquet scan; a limit plans as
a top-k.  Survey ids: R1-R16, F1-F6, T1, N6, Q1-Q5, Q8.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.keys import HIGHEST, LOWEST, bytes_remaining, offset_too_large, value_slice

HEADER_BYTES = 8


def get(state: DataFrame, key) -> DataFrame:
    return state.where(F.col("key") == F.lit(key))


def get_many(state: DataFrame, keys: DataFrame, offset: int = 0, size: int | None = None) -> DataFrame:
    """Each asked key with found flag, value slice, size, what is left and whether the offset is too large."""
    there = keys.select("key").distinct().join(state.select("key", "value", F.lit(True).alias("hit")), "key", "left")
    n = F.length("value")
    want = F.lit(size) if size is not None else F.greatest(n - offset, F.lit(0))
    return there.select(
        "key", F.coalesce("hit", F.lit(False)).alias("key_found"), value_slice(F.col("value"), F.lit(offset), want).alias("value"), n.alias("value_size"),
        bytes_remaining(F.col("value"), F.lit(offset), want).alias("bytes_remaining"), F.coalesce(offset_too_large(F.col("value"), offset), F.lit(False)).alias("offset_too_large"),
    )


def exists(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The asked keys that are there."""
    return keys.join(state.select("key"), "key", "left_semi")


def bounded(state: DataFrame, start=None, after: bool = False, stop=None, prefix: str | None = None) -> DataFrame:
    """Keys from ``start`` (``after``: without it) up to but without ``stop``, under a prefix."""
    if start is not None and start != LOWEST:
        state = state.where(F.col("key") > F.lit(start) if after else F.col("key") >= F.lit(start))
    if stop is not None and stop != HIGHEST:
        state = state.where(F.col("key") < F.lit(stop))
    if prefix is not None:
        state = state.where(F.col("key").startswith(prefix))
    return state


def scan(state: DataFrame, keys_only: bool = False, limit: int | None = None, **bounds) -> DataFrame:
    """An ordered scan; ``keys_only`` prunes the values away."""
    rows = bounded(state, **bounds)
    rows = rows.select("key") if keys_only else rows
    rows = rows.orderBy("key")
    return rows if limit is None else rows.limit(limit)


def seek_within_bytes(state: DataFrame, start, limit: int, budget: int, size: Column | None = None) -> DataFrame:
    """Up to ``limit`` rows from ``start`` whose running size stays within a reply of ``budget`` bytes.

    The limit comes first, so the running sum covers ``limit`` rows at most.
    """
    size = F.octet_length("key") + F.octet_length("value") + HEADER_BYTES if size is None else size
    rows = scan(state, start=start, limit=limit).withColumn("bytes", size.cast("long"))
    upto = Window.partitionBy(F.lit(0)).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("bytes").over(upto)).where(F.col("used") <= budget)


def within_region(state: DataFrame, regions: DataFrame, start: str, limit: int) -> DataFrame:
    """A seek that ends with the region that holds ``start``."""
    home = (regions.where((F.col("min_key") == LOWEST) | (F.col("min_key") <= start)).where((F.col("max_key") == HIGHEST) | (F.col("max_key") > start))).first()
    if home is None:
        return state.limit(0)
    return scan(state, start=start, stop=home["max_key"], limit=limit)


def cursor(state: DataFrame, **bounds) -> Iterator[Row]:
    """Rows in key order, one partition at a time on the driver."""
    return scan(state, **bounds).toLocalIterator()


def scan_fields(state: DataFrame, start, limit: int, names: list[str] | None = None) -> DataFrame:
    """(key, field, value) of the scanned records (key, record), named fields only if given."""
    rows = scan(state, start=start, limit=limit).select("key", F.explode("record").alias("field", "value"))
    return rows if names is None else rows.where(F.col("field").isin(*names))
