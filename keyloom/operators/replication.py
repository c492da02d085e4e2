"""Replicated logs: buffers, translation of offsets, acknowledgement.  Survey ids: D11, D12, J6, N5, X3-X6, X14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import segment_start
from .running import sum_before


def translate(offsets: DataFrame, segments: DataFrame, size: int, offset: str = "offset") -> DataFrame:
    """Primary offsets moved into the replica's segments; null where a segment is not mapped."""
    at = offsets.withColumn("segment", segment_start(F.col(offset), size))
    return at.join(segments, "segment", "left").withColumn("new_offset", F.col("new_segment") + F.col(offset) % size)


def fill_buffers(log: DataFrame, size: int, bytes_: Column, region: str = "region") -> DataFrame:
    """Each record's buffer and place by the running byte sum of its region's log.

    A record belongs to the buffer in which it starts.  The sum runs over stretches of the
    log first, so a long region is no single task.
    """
    placed = sum_before(log.withColumn("bytes", bytes_.cast("long")), [region], "lsn", F.col("bytes"), "start")
    return placed.withColumn("buffer", F.floor(F.col("start") / size).cast("long")).withColumn("place", F.col("start") % size)


def contiguous(acks: DataFrame, first: int = 0) -> DataFrame:
    """Highest sequence number up to which everything from ``first`` is acknowledged, first - 1 if nothing.

    The first gap is the least acknowledged number whose successor is missing, at or
    above ``first``: an anti join, not a global window.
    """
    seen = acks.select(F.col("seq").cast("long").alias("seq")).where(F.col("seq") >= first).distinct()
    after = seen.union(acks.sparkSession.createDataFrame([(first - 1,)], "seq long")).distinct()
    ends = after.join(seen.select((F.col("seq") - 1).alias("seq")), "seq", "left_anti")
    return ends.agg(F.min("seq").alias("acknowledged"))
