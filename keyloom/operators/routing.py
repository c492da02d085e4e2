"""Routing keys to regions and buckets.  Survey ids: D5-D7, J1-J3, A8, A9, H3, H5, T4, T6, Q13, Q20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.keys import HIGHEST, LOWEST, at_or_above, below

#: A region table of so many rows at most is put into the plan as one sorted array.
MOST_REGIONS = 10_000


def _index(key: Column, bounds: Column) -> Column:
    """Number of sorted bounds at or below the key, by bisection."""

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(bounds, mid) <= key
        return F.when(s["lo"] >= s["hi"], s).when(right, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(bounds) + 1)).cast("int") + 1)
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi")), step, lambda s: s["lo"])


def _route_by_bounds(keys: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    bounds = regions.where(F.col("min_key") != LOWEST).select("min_key").distinct().orderBy(F.xxhash64("min_key"), "min_key").limit(MOST_REGIONS)
    pivots = F.array(*[F.lit(x) for x in sorted(r[0] for r in bounds.collect())])
    # A region starts between two bounds and may go on over the next ones.
    low = F.when(F.col("min_key") == LOWEST, 0).otherwise(_index(F.col("min_key"), pivots))
    high = F.when(F.col("max_key") == HIGHEST, F.size(pivots)).otherwise(_index(F.col("max_key"), pivots))
    r = regions.select(F.col("id").alias("region"), "min_key", "max_key", F.explode(F.sequence(low, F.greatest(low, high))).alias("_cell"))
    placed = keys.withColumn("_cell", _index(F.col(key), pivots))
    held = (placed["_cell"] == r["_cell"]) & at_or_above(F.col(key), F.col("min_key")) & below(F.col(key), F.col("max_key"))
    return placed.join(r, held, "left").drop("min_key", "max_key", "_cell")


def route(keys: DataFrame, regions: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` with the id of the region [min_key, max_key) that holds each, null where none does.

    A small region table becomes a sorted array in the plan and each key is placed by
    bisection: no nested loop, and no shuffle.  Of a larger one, MOST_REGIONS of its bounds
    are the plan's array; keys and regions get the number of bounds below them and are
    joined on that, so a key meets the few regions between two bounds.
    """
    rows = regions.select("id", "min_key", "max_key").limit(MOST_REGIONS + 1).collect()
    if len(rows) > MOST_REGIONS:
        return _route_by_bounds(keys, regions, key)
    rows.sort(key=lambda r: b"" if r["min_key"] == LOWEST else b"\1" + r["min_key"].encode())
    lit = lambda xs, kind: F.array(*map(F.lit, xs)).cast(f"array<{kind}>") if xs else F.expr(f"cast(array() as array<{kind}>)")
    low = [r["min_key"] for r in rows if r["min_key"] != LOWEST]
    open_ = len(rows) - len(low)
    at = _index(F.col(key), lit(low, "string")) + open_ - 1
    ends = lit([r["max_key"] for r in rows], "string")
    ids = lit([r["id"] for r in rows], regions.schema["id"].dataType.simpleString())
    end = F.get(ends, at)
    return keys.withColumn("region", F.when((at >= 0) & ((end == HIGHEST) | (F.col(key) < end)), F.get(ids, at)))


def hash_route(keys: DataFrame, n: int, key: str = "key") -> DataFrame:
    """``keys`` with the bucket djb2(key) mod n and the bucket's two-letter prefix."""
    bucket = hashing.modulo(hashing.djb2(F.col(key)), n)
    return keys.withColumn("bucket", bucket).withColumn("prefix", hashing.letters(F.col("bucket")))


def connect(routed: DataFrame, regions: DataFrame, servers: DataFrame) -> DataFrame:
    """Routed keys with their region's primary and its server row."""
    homes = regions.select(F.col("id").alias("region"), F.col("primary").alias("hostname"))
    return routed.join(homes, "region").join(servers, "hostname")


def load(routed: DataFrame, by: str = "region") -> DataFrame:
    """Requests per region, server or bucket."""
    return routed.groupBy(by).agg(F.count(F.lit(1)).alias("n_requests"))


def worker(hash_value: Column, n_workers: int, server_side: bool = False) -> Column:
    """Client tasks share the lower half of the workers, server tasks the upper half."""
    half = max(n_workers // 2, 1)
    return F.pmod(hash_value, F.lit(half)) + (n_workers - half if server_side else 0)


def least_loaded(queues: DataFrame) -> DataFrame:
    """The worker with the shortest queue, the smallest number on a tie."""
    return queues.groupBy().agg(F.min(F.struct("queue_len", "worker")).alias("x")).select("x.worker", "x.queue_len")
