"""Running sums and carried values over long groups, in two levels.

A window over one hot group is one task.  Here a group is cut into stretches of its order,
each stretch is summed first, and the windows run over stretches and within them, so no
task holds more than one stretch or one row for each.  Survey ids: A5, N4, J7, W3, W4, X3.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of an order in one stretch.
STRETCH = 1 << 16


def _joined(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """A join in which null groups meet, too."""
    on = None
    for c in by:
        same = df[c].eqNullSafe(other[c])
        on = same if on is None else on & same
    return df.join(other, on).drop(*[other[c] for c in by])


def sum_before(df: DataFrame, by: Sequence[str], order: str, value: Column, out: str, stretch: int = STRETCH) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group that stand before; ``order`` is an integer."""
    keyed = df.withColumn("_value", value).withColumn("_part", F.floor(F.col(order) / stretch))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy(*by, "_part").agg(F.sum("_value").alias("_sum"))
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_sum").over(upto(*by).orderBy("_part")), F.lit(0))).drop("_sum")
    both = _joined(keyed, parts, [*by, "_part"])
    within = F.coalesce(F.sum("_value").over(upto(*by, "_part").orderBy(order)), F.lit(0))
    return both.withColumn(out, F.col("_ahead") + within).drop("_value", "_part", "_ahead")


def last_before(df: DataFrame, by: Sequence[str], order: str, value: Column, out: str, stretch: int = STRETCH) -> DataFrame:
    """``df`` with the newest value that is not null among the rows of its group that stand before."""
    keyed = df.withColumn("_value", value).withColumn("_part", F.floor(F.col(order) / stretch))
    newest = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = keyed.groupBy(*by, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_newest"))
    parts = parts.withColumn("_ahead", newest("_newest", Window.partitionBy(*by).orderBy("_part"))).drop("_newest")
    both = _joined(keyed, parts, [*by, "_part"])
    return both.withColumn(out, F.coalesce(newest("_value", Window.partitionBy(*by, "_part").orderBy(order)), "_ahead")).drop("_value", "_part", "_ahead")


def picks(samples: DataFrame, by: Sequence[str], value: str, at: dict[str, Column], slices: int = 100) -> DataFrame:
    """One row a group with the elements of its sorted values at some places (from 0; ``size`` is the group's).

    Bounds from an approximate quantile sketch cut each group into slices; slices are
    counted, and only those that hold a wanted place are sorted, as counted values.
    """
    known = samples.where(F.col(value).isNotNull())
    share = F.lit([k / slices for k in range(1, slices)])
    bounds = known.groupBy(*by).agg(F.percentile_approx(value, share, 10_000).alias("_bounds"), F.count(F.lit(1)).alias("size"))
    cut = _joined(known, bounds, by).withColumn("_slice", F.size(F.filter("_bounds", lambda b: b < F.col(value))))
    counted = cut.groupBy(*by, "size", "_slice", value).agg(F.count(F.lit(1)).alias("_n"))
    parts = counted.groupBy(*by, "_slice").agg(F.sum("_n").alias("_m"))
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = _joined(counted, parts, [*by, "_slice"])
    wanted = None
    for place in at.values():
        here = (place >= F.col("_ahead")) & (place < F.col("_ahead") + F.col("_m"))
        wanted = here if wanted is None else wanted | here
    upto = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = both.where(wanted).withColumn("_at", F.col("_ahead") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    pick = [F.max(F.when((place >= F.col("_at")) & (place < F.col("_at") + F.col("_n")), F.col(value))).alias(name) for name, place in at.items()]
    return placed.groupBy(*by).agg(*pick)
