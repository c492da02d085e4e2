"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is scaled to length 1 and hashed in TABLES tables; a table's bucket is the
cell of PROJECTIONS Gaussian (2-stable) projections cut at width WIDTH.  On the unit
sphere, the order by distance is the order by cosine.  A query visits perturbed buckets in
descending estimated success - the chance that a neighbour at the fitted distance falls
into the bucket, given where the query lies in its own cell - until the chances sum to
SUCCESS in each table.  Candidates of all tables are merged and ranked by their exact
cosine in double precision.

The neighbour distance is fitted on a bounded sample of the distinct vectors (FIT_ROWS in
hash order), and holds for most queries, not all.  A query whose k-th found neighbour is
farther, or that found fewer than k, is run again with that distance as its own (a bound of
the true one); one that still has fewer than k is compared with every vector.
Every row is indexed.  Equal vectors are stored once, with the k + 1 smallest ids, which
is all that a result can name.  Buckets and their queries are dealt in blocks of bounded
size, so a popular bucket is no single task.

Edge cases: null and zero vectors, and ones with null or non-finite components or of
another length than most, take no part; ties go to the smaller id; rows that repeat an id
are one candidate, at the best score of its vectors, and one query, by the least of its
vectors; columns besides id and vector, whatever their names, are not read; fewer
candidates than k give them all; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import map_arrow, stored, table

TABLES, PROJECTIONS, WIDTH, SUCCESS, REACH = 2, 6, 2.5, 0.83, 2
FIT_ROWS, FIT_QUERIES, FIT_SHARE = 4000, 400, 0.95
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000
K = 5
SEED = 11


@dataclass(frozen=True)
class Hashing:
    """Projections (tables x dim x projections), offsets and the neighbour distance."""

    planes: np.ndarray
    offsets: np.ndarray
    distance: float

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Position of each vector in units of cells: tables x rows x projections."""
        return (np.einsum("rd,tdp->trp", unit, self.planes) + self.offsets[:, None]) / WIDTH


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def fit(vectors: DataFrame, dim: int, k: int = K) -> Hashing:
    """Draw the projections and fit the distance on at most FIT_ROWS of distinct (vec)."""
    rng = np.random.default_rng(SEED)
    planes = rng.normal(size=(TABLES, dim, PROJECTIONS))
    offsets = rng.uniform(0, WIDTH, (TABLES, PROJECTIONS))
    sample = vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(FIT_ROWS).toArrow().column("vec").combine_chunks()
    distance = 1.0
    if len(sample) > k:
        unit = _unit(_matrix(sample))
        near = np.partition(-(unit[:FIT_QUERIES] @ unit.T), k, axis=1)[:, k]
        distance = float(np.quantile(np.sqrt(np.maximum(2 + 2 * near, 0)), FIT_SHARE))
    return Hashing(planes, offsets, max(distance, 0.05))


def _cell(cells: np.ndarray) -> np.ndarray:
    """One 64-bit name for each row of cell numbers (10 bits a projection)."""
    name = np.zeros(cells.shape[:-1], np.int64)
    for j in range(cells.shape[-1]):
        name = name << 10 | (cells[..., j] + 512).astype(np.int64) & 1023
    return name


def probes(hashing: Hashing, unit: np.ndarray, distance: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, table, buckets) in estimated success order, for each row's neighbour distance."""
    shifts = np.arange(-REACH, REACH + 1)
    cdf = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))
    grid = np.stack(np.meshgrid(*[np.arange(len(shifts))] * PROJECTIONS, indexing="ij"), -1).reshape(-1, PROJECTIONS)
    places = hashing.places(unit)
    for t in range(TABLES):
        home = np.floor(places[t])
        edge = (home[:, :, None] + np.arange(-REACH, REACH + 2) - places[t][:, :, None]) * (WIDTH / distance)[:, None, None]
        chance = np.diff(cdf(edge), axis=2)
        for r in range(len(unit)):
            all_ = np.ones(1)
            for j in range(PROJECTIONS):
                all_ = (all_[:, None] * chance[r, j]).ravel()
            order = np.argsort(-all_, kind="stable")
            upto = int(np.searchsorted(np.cumsum(all_[order]), SUCCESS)) + 1
            yield r, t, _cell(home[r] + shifts[grid[order[:upto]]])


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows; the sum's order depends on nothing but the pair."""
    return (q * c).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1)))


def _rank(base: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a block of candidates for each query of a block."""
    empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(base) or not len(asked):
        return empty
    c, q = np.stack(base["vec"].to_list()).astype(np.float64), np.stack(asked["vec"].to_list()).astype(np.float64)
    c /= np.abs(c).max(1, keepdims=True)  # powers of any size stay within range; cosines do not change
    q /= np.abs(q).max(1, keepdims=True)
    ids, qids = base["ids"].to_list(), asked["query"].to_numpy()
    near = _unit(q) @ _unit(c).T
    take = min(len(base), k + 1)
    out_q, out_id, out_s = [], [], []
    for r in range(len(q)):
        least = -np.partition(-near[r], take - 1)[take - 1]
        at = np.flatnonzero(near[r] >= least - 1e-9)
        score = _exact(np.broadcast_to(q[r], (len(at), q.shape[1])), c[at])
        found = [(-s, i) for s, a in zip(score.tolist(), at) for i in ids[a] if i != qids[r]]
        for s, i in sorted(found)[:k]:
            out_q.append(qids[r])
            out_id.append(i)
            out_s.append(-s)
    return pd.DataFrame({"query": np.array(out_q, np.int64), "id": np.array(out_id, np.int64), "score": np.array(out_s)}) if out_q else empty


def search(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of ``rows`` for each of ``queries``."""
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    base, asked = pick(rows), pick(queries)
    dim = base.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return rows.sparkSession.createDataFrame([], schema)
    base, asked = base.where(F.size("vec") == dim[0]), asked.where(F.size("vec") == dim[0])
    few = Window.partitionBy("vec").orderBy("id")
    one = base.distinct().withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = stored(one.select("vec", "ids"))
    hashing = fit(one, dim[0], k)
    shared = rows.sparkSession.sparkContext.broadcast(hashing)

    def index(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells = _cell(np.floor(shared.value.places(_unit(_matrix(batch.column(0))))))
        for t in range(TABLES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(cells[t])], names=["vec", "ids", "t", "cell"])

    def visit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, tab, cell = [], [], []
        for r, t, cells in probes(shared.value, _unit(_matrix(batch.column(1))), batch.column(2).to_numpy()):
            row.append(np.full(len(cells), r))
            tab.append(np.full(len(cells), t, np.int32))
            cell.append(cells)
        row = np.concatenate(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.concatenate(tab)), pa.array(np.concatenate(cell))], names=["query", "t", "cell"])

    indexed = stored(map_arrow(one, index, "vec array<double>, ids array<long>, t int, cell long"))
    filled = indexed.groupBy("t", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    asked = stored(asked.groupBy("id").agg(F.min("vec").alias("vec")).withColumnRenamed("id", "query"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")

    def compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _rank(a, b, k), "query long, id long, score double")

    def near(wanted: DataFrame) -> DataFrame:
        """Found by (query, vec, reach) in the buckets that their reach asks for."""
        # The visits name their query only; vectors join once the empty buckets are gone.
        visits = map_arrow(wanted.select("query", "vec", "reach"), visit, "query long, t int, cell long")
        visits = stored(visits.join(filled, ["t", "cell"]))
        loads = visits.groupBy("t", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("shares"))
        left = indexed.join(filled, ["t", "cell"]).join(loads, ["t", "cell"]).select("t", "cell", mine("vec", F.col("parts")).alias("part"), upto(F.col("shares")).alias("share"), "vec", "ids")
        right = visits.join(loads, ["t", "cell"]).select("t", "cell", upto(F.col("parts")).alias("part"), mine("query", F.col("shares")).alias("share"), "query").join(wanted.select("query", "vec"), "query")
        return compare(left, right, ["t", "cell", "part", "share"])

    def everywhere(wanted: DataFrame, n: int) -> DataFrame:
        """Found by (query, vec), n of them, among all vectors."""
        parts, shares = F.lit(math.ceil(one.count() / BLOCK_ROWS)), F.lit(math.ceil(n / BLOCK_QUERIES))
        left = one.select(mine("vec", parts).alias("part"), upto(shares).alias("share"), "vec", "ids")
        right = wanted.select(upto(parts).alias("part"), mine("query", shares).alias("share"), "query", "vec")
        return compare(left, right, ["part", "share"])

    def ranked(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return stored(found.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))

    def with_reach(found: DataFrame) -> DataFrame:
        """(query, vec, short, reach): whether fewer than k were found, and how far the k-th is."""
        so_far = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        short = F.coalesce(F.col("n"), F.lit(0)) < k
        reach = F.when(short, math.sqrt(2)).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))))
        return asked.join(so_far, "query", "left").select("query", "vec", short.alias("short"), reach.alias("reach"))

    found = ranked(near(asked.withColumn("reach", F.lit(hashing.distance))))
    again = stored(with_reach(found).where(F.col("short") | (F.col("reach") > hashing.distance)))
    if not again.isEmpty():
        found = ranked(found.drop("rank").unionByName(near(again)))
        again = stored(with_reach(found).where("short"))
        if n := again.count():
            found = ranked(found.drop("rank").unionByName(everywhere(again, n)))
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op3_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
