"""Measurements: latency histograms, percentiles, rates and resource use.

Survey ids: D14, D15, A1-A16, N1-N4, X13, C8-C10, Q14, Q15.  Percentiles follow one
rule: the first bucket whose cumulative count reaches floor(n * p), and 0 where that is
0.  They are computed from histograms, so what is shuffled and sorted is the number of
buckets, not of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import picks

MOST_LATENCY = 100_000
PERCENTILES = (0.5, 0.7, 0.9, 0.99, 0.999, 0.9999)


def name_of(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def histogram(samples: DataFrame, by: Sequence[str], most: int = MOST_LATENCY) -> DataFrame:
    """(by..., bucket, n), one bucket a microsecond; samples at or above ``most`` have bucket null."""
    bucket = F.when(F.col("latency_us") < most, F.col("latency_us").cast("long"))
    return samples.select(*by, bucket.alias("bucket")).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def summary(hist: DataFrame, by: Sequence[str], percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Count, missing, min, max, integer mean and percentiles of each histogram."""
    run = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = hist.where("bucket is not null").groupBy(*by).agg(F.sum("n").alias("total"))
    cum = hist.where("bucket is not null").withColumn("cum", F.sum("n").over(run)).join(total, list(by))
    rank = lambda p: F.floor(F.col("total") * F.lit(p))
    pick = [F.when(F.max(rank(p)) == 0, 0).otherwise(F.min(F.when(F.col("cum") >= rank(p), F.col("bucket")))).cast("long").alias(name_of(p)) for p in percentiles]
    known = cum.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("bucket").alias("min"), F.max("bucket").alias("max"), F.floor(F.sum(F.col("bucket") * F.col("n")) / F.sum("n")).cast("long").alias("avg"), *pick
    )
    missing = hist.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    return missing.join(known, list(by), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def thread_average(per_thread: DataFrame, by: Sequence[str], n_threads: int, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Statistics summed over threads and divided by their number; a silent thread counts 0 (A3)."""
    names = ["min", "max", "avg", *map(name_of, percentiles)]
    mean = [F.floor(F.coalesce(F.sum(c), F.lit(0)) / n_threads).cast("long").alias(c) for c in names]
    return per_thread.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), *mean)


def monitor_samples(samples: DataFrame) -> DataFrame:
    """Samples as the latency monitor keeps them: rounded up by one, none at or below 0 (A4)."""
    return samples.withColumn("latency_us", F.col("latency_us") + 1).where("latency_us > 0")


def sorted_picks(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The elements at n/2, 90n/100 and 99n/100 of the sorted samples (A5)."""
    place = lambda share: F.floor(F.col("size") * share / 100)
    return picks(samples, by, value, {"p50": place(50), "p90": place(90), "p99": place(99)})


def throughput(clients: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Operations, and operations a second, over clients (ops, seconds)."""
    return clients.groupBy(*by).agg(F.sum("ops").alias("ops"), (F.sum("ops") / F.max("seconds")).alias("ops_per_sec"))


def interval_rates(totals: DataFrame, by: Sequence[str], seconds: Column | None = None) -> DataFrame:
    """Change of a running total since the sample before, a second."""
    w = Window.partitionBy(*by).orderBy("ts")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6 if seconds is None else seconds
    return totals.withColumn("delta", F.col("total") - F.lag("total").over(w)).withColumn("rate", F.col("delta") / gap)


def tumbling_rates(events: DataFrame, width: str, seconds: float, by: Sequence[str] = ()) -> DataFrame:
    """Events a second in windows of fixed width; the same plan batch or streaming."""
    rows = events.groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), *by, "n", (F.col("n") / seconds).alias("rate"))


def counter_delta(start: DataFrame, stop: DataFrame, seconds: Column | float | None = None) -> DataFrame:
    """stop - start of each counter (key, value), and the rate."""
    both = start.select("key", F.col("value").alias("first")).join(stop.select("key", F.col("value").alias("last")), "key")
    delta = both.select("key", (F.col("last") - F.col("first")).alias("delta"))
    return delta if seconds is None else delta.withColumn("rate", F.col("delta") / seconds)


def request_sizes(samples: DataFrame) -> DataFrame:
    """Mean operations in flight and bytes per operation of each device, 0 where none ran."""
    # The steps of a running total sum to its last value less its first.
    moved = lambda c: F.max_by(c, "ts") - F.min_by(c, "ts")
    sums = samples.groupBy("device").agg(F.avg("in_flight").alias("in_flight"), moved("ops").alias("ops"), moved("bytes").alias("bytes"))
    return sums.select("device", "in_flight", F.when(F.col("ops") == 0, F.lit(0.0)).otherwise(F.col("bytes") / F.col("ops")).alias("request_bytes"))


def cpu_use(samples: DataFrame) -> DataFrame:
    """Mean user, system, I/O-wait and idle shares over the all-CPU samples (A10)."""
    return samples.where("cpu = 'all'").agg(*[F.avg(c).alias(c) for c in ("usr", "sys", "iowait", "idle")])


def device_use(samples: DataFrame) -> DataFrame:
    """Mean queue depth, request size and utilisation of each device, over its own samples."""
    return samples.groupBy("device").agg(*[F.avg(c).alias(c) for c in ("queue_depth", "request_size", "util")])


def sectors_to_mb(sectors: Column) -> Column:
    return 512 * sectors / (1024 * 1024)


def disk_traffic(before: DataFrame, after: DataFrame) -> DataFrame:
    """MB read and written by each device between two samples."""
    b = before.select("device", F.col("read_sectors").alias("r0"), F.col("write_sectors").alias("w0"))
    return after.join(b, "device").select("device", sectors_to_mb(F.col("read_sectors") - F.col("r0")).alias("read_mb"), sectors_to_mb(F.col("write_sectors") - F.col("w0")).alias("write_mb"))


def cycles_per_op(idle: Column, iowait: Column, cores: int, hz: float, ops_per_sec: Column, with_iowait: bool = False) -> Column:
    """CPU cycles an operation took, with or without the time spent waiting for I/O."""
    busy = 100 - idle if with_iowait else 100 - idle - iowait
    return busy / 100 * cores * hz / ops_per_sec


def series_sum(*series: DataFrame) -> DataFrame:
    """Sum of several (t, value) series by time."""
    rows = series[0]
    for other in series[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("t").agg(F.sum("value").alias("value"))


def key_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_keys"))  # A16
