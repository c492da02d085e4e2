"""Mutation logs and the state they describe.

A log has (key, lsn, op, value) with op ``put``, ``put_if_exists`` or ``delete`` and one
total order by lsn.  Survey ids: D3, D4, W1-W6, W8, W10, S6, X1, X4, R5, J7, Q6, Q7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records
from .running import last_before

PUT, PUT_IF_EXISTS, DELETE = "put", "put_if_exists", "delete"


def put(rows: DataFrame) -> DataFrame:
    return rows.select("key", "lsn", F.lit(PUT).alias("op"), "value")


def put_if_exists(rows: DataFrame) -> DataFrame:
    return rows.select("key", "lsn", F.lit(PUT_IF_EXISTS).alias("op"), "value")


def delete(rows: DataFrame, value_type: str = "string") -> DataFrame:
    return rows.select("key", "lsn", F.lit(DELETE).alias("op"), F.lit(None).cast(value_type).alias("value"))


def current_state(log: DataFrame) -> DataFrame:
    """Newest value of every live key.

    A conditional put never changes whether a key exists, so the newest put or delete
    settles that, and whatever came last is the value.  The two maxima are longs: they
    are combined before the shuffle, a hot key is one row per task, and values are only
    fetched for the rows that won.
    """
    settles = F.col("op").isin(PUT, DELETE)
    marks = log.groupBy("key").agg(
        F.max(F.when(settles, F.col("lsn") * 2 + (F.col("op") == PUT).cast("long"))).alias("mark"), F.max("lsn").alias("lsn")
    )
    return log.join(marks.where(F.pmod("mark", F.lit(2)) == 1).select("key", "lsn"), ["key", "lsn"]).select("key", "lsn", "value")


def outcomes(log: DataFrame) -> DataFrame:
    """The log with ``applied``: false for a conditional put or delete of a key that is not there."""
    marked = last_before(log, ["key"], "lsn", F.when(F.col("op").isin(PUT, DELETE), F.col("op")), "settled")
    return marked.withColumn("applied", (F.col("op") == PUT) | F.coalesce(F.col("settled") == PUT, F.lit(False))).drop("settled")


def rejected(log: DataFrame) -> DataFrame:
    """Conditional puts on missing keys, reported and not applied."""
    return outcomes(log).where((F.col("op") == PUT_IF_EXISTS) & ~F.col("applied")).drop("applied")


def missing_deletes(log: DataFrame) -> DataFrame:
    """Deletes that found no key."""
    return outcomes(log).where((F.col("op") == DELETE) & ~F.col("applied")).drop("applied")


def replay(buffer: DataFrame) -> DataFrame:
    """State after replaying a log buffer; rows with lsn 0 or less are padding."""
    return current_state(buffer.where("lsn > 0"))


def read_modify_write(state: DataFrame, updates: DataFrame) -> DataFrame:
    """New records of (key, fields) merged into those of a state (key, record): the read-modify-write cycle."""
    both = updates.join(state, "key")
    unknown = records.unknown_fields(F.col("record"), F.col("fields"))
    return both.select("key", records.merge(F.col("record"), F.col("fields")).alias("record"), unknown.alias("unknown_fields"))
