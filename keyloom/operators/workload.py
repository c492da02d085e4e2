"""Workload generators as columns over a range of operation numbers.

Each takes a uniform column in [0, 1): ``F.rand(seed)`` for a run, ``uniform_of`` for
reproducible tests.  Survey ids: Y1-Y13, D13, D17, D18, H8.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, records

# Fixed value: the usual skew of the zipfian generator.
THETA = 0.99
# Shares of small and medium values of each size mix, and the sizes that are written.
SIZE_MIXES = {"s": (100, 0), "m": (0, 100), "l": (0, 0), "sd": (60, 20), "md": (20, 60), "ld": (20, 20), "sd40": (40, 30), "sd80": (80, 10)}
INSERT_SIZES, UPDATE_SIZES = (10, 120, 1200), (5, 120, 1200)


def counter(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    return spark.range(start, start + n).withColumnRenamed("id", "i")  # Y1


def uniform_of(i: Column) -> Column:
    """A reproducible uniform number of an integer."""
    return F.pmod(i * 2654435761, F.lit(1 << 32)) / float(1 << 32)


def uniform(u: Column, low: int, high: int) -> Column:
    """Integers in [low, high] (Y2)."""
    return low + F.floor(u * (high - low + 1))


def zeta(spark: SparkSession, n: int, theta: float = THETA) -> float:
    """Sum of 1 / i^theta, i up to n, by a distributed sum."""
    return spark.range(1, n + 1).agg(F.sum(1 / F.pow("id", F.lit(theta)))).first()[0] or 0.0


def zipfian(u: Column, n: int, zeta_n: float, theta: float = THETA) -> Column:
    """Ranks in [0, n) by the closed form of Gray et al.."""
    alpha, zeta_2 = 1 / (1 - theta), 1 + 0.5**theta
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta_2 / zeta_n)
    uz = u * zeta_n
    far = F.floor(n * F.pow(eta * u - eta + 1, F.lit(alpha)))
    return F.when(uz < 1, 0).when(uz < 1 + 0.5**theta, 1).otherwise(F.least(far, F.lit(n - 1))).cast("long")


def scrambled(rank: Column, n: int, base: int = 0) -> Column:
    """Ranks spread over the key space by FNV."""
    return base + hashing.modulo(hashing.fnv64(rank), n)


def latest(rank: Column, last: Column | int) -> Column:
    """Skew towards the newest key."""
    return (last if isinstance(last, Column) else F.lit(last)) - rank


def discrete(u: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """A weighted choice; weights need not sum to 1."""
    total, upto, choice = sum(w for _, w in weights), 0.0, None
    for name, w in weights[:-1]:
        upto += w / total
        choice = F.when(u < upto, name) if choice is None else choice.when(u < upto, name)
    return F.lit(weights[-1][0]) if choice is None else choice.otherwise(weights[-1][0])


def constant(value) -> Column:
    return F.lit(value)  # Y7


def record(n_fields: int, size: Column | int, prefix: str = "field") -> Column:
    """A map of ``n_fields`` fields of ``size`` characters."""
    size = size if isinstance(size, Column) else F.lit(size)
    names = F.array(*[F.lit(f"{prefix}{k}") for k in range(n_fields)])
    return F.map_from_entries(F.transform(names, lambda x: F.struct(x, F.repeat(F.lit("a"), size))))


def not_beyond(draws: DataFrame, last: Column, key: str = "draw") -> DataFrame:
    """Draws up to the last inserted key; oversample and drop the rest."""
    return draws.where(F.col(key) <= last)


def size_class(i: Column, mix: str) -> Column:
    """small, medium or large by i mod 10."""
    small, medium = SIZE_MIXES[mix]
    slot = F.pmod(i, F.lit(10)) * 10
    return F.when(slot < small, "small").when(slot < small + medium, "medium").otherwise("large")


def value_size(kind: Column, sizes: Sequence[int] = INSERT_SIZES) -> Column:
    return F.when(kind == "small", sizes[0]).when(kind == "medium", sizes[1]).otherwise(sizes[2])


def split_ops(n_ops: int, n_threads: int) -> list[int]:
    """Operations of each thread, what is left over going to the last."""
    return [n_ops // n_threads] * (n_threads - 1) + [n_ops // n_threads + n_ops % n_threads]


def scale(properties: dict[str, str], clients: int) -> dict[str, str]:
    """A workload's counts dealt to several clients."""
    return {k: str(int(v) // clients) if k in ("recordcount", "operationcount") else v for k, v in properties.items()}


def dispatch(state: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations (i, op, key, fields) on a state (key, record): what each read and what it writes.

    ``read`` and ``rmw`` give the record as ``was``; ``update`` and ``rmw`` merge their fields
    into a record that is there, and ``insert`` writes its fields alone.  Each sees the
    state as it was, as operations of concurrent clients may.
    """
    both = ops.join(state.withColumn("hit", F.lit(True)), "key", "left").withColumn("key_found", F.coalesce("hit", F.lit(False)))
    reads, merges = F.col("op").isin("read", "rmw"), F.col("op").isin("update", "rmw")
    becomes = F.when(F.col("op") == "insert", F.col("fields")).when(merges & F.col("key_found"), records.merge(F.col("record"), F.col("fields")))
    return both.select("i", "op", "key", "key_found", F.when(reads, F.col("record")).alias("was"), becomes.alias("becomes"))
