"""Ordering of one long log: spread over tasks, held over restarts, with repeated, late and placeless records."""

from pyspark.sql import functions as F

from keyloom.streaming import logs as streams


def rows(ids):
    return ids.select(F.lit(7).cast("long").alias("region"), F.col("id").alias("lsn"), F.concat(F.lit("k"), "id").alias("key"), F.lit("put").alias("op"), (F.col("id") / 3).alias("value"))


def test_one_region_is_many_tasks(spark, tmp_path):
    size, gap = 10 * 65536 + 100, 8 * 65536 + 5
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def drained():
        stream = streams.read_files(spark, source, streams.LOG)
        return streams.drain(streams.in_order(stream, stalled_ms=None), out, state)

    early = rows(spark.range(1, size).where(F.col("id") != gap))
    nowhere = [(None, 1, "x", "put", 1.0), (7, None, "y", "put", 1.0)]
    early.union(spark.createDataFrame(nowhere, streams.LOG)).repartition(3, F.xxhash64("lsn")).write.parquet(source)
    assert drained().count() == 0
    rows(spark.range(1)).union(rows(spark.range(9))).coalesce(1).write.mode("append").parquet(source)  # some are held already
    got = drained()
    assert got.exceptAll(rows(spark.range(gap))).count() == 0 and got.count() == gap
    assert got.select(F.input_file_name()).distinct().count() > 1
    rows(spark.range(gap - 3, gap + 2)).coalesce(1).write.mode("append").parquet(source)  # late and waiting ones again
    got = drained()
    assert got.exceptAll(rows(spark.range(size))).count() == 0 and got.count() == size
