"""Mixing sources to target weights with exact block quotas.

Each source's documents are put in a fixed random order (by a hash of the id) and laid
end to end; a document's place is the number of words before it.  A source with target
T takes the stretch [0, T) of that line, going round a second time where T exceeds its
size, so its words are within half a document of T.  The stretch is cut into equal
blocks.  A multivariate-hypergeometric splitting tree deals every source's block quota
to the output shards: each node draws half of its blocks without replacement, and the
numbers drawn of each source are the quotas of its left half, so all quotas stay exact at
every level.  A shard then gets that many of the source's blocks, permuted and disjoint,
and is shuffled locally.  All draws are MD5 numbers, so that any engine can repeat them.

Only DataFrame functions are used.  Documents move once, by source and bucket of the
random order, so a hot source is spread over all of its buckets; prefix sums come from
per-bucket totals.  The plan holds sources and blocks as rows: one for each source, and
about ``per_shard << levels`` blocks more, however large the tables are.

Edge cases: null text has size 0, and a text of any length is counted whole; a null
source is one more source, sorted last; a source without words has target 0; repeated
rows are separate documents; columns that ``docs`` has keep their names, and those added
get longer ones; an empty table gives no rows.  Reruns with one seed agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import free_name, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
SHARD_LEVELS = 4
BLOCKS_PER_SHARD = 64
BUCKETS_HEX = 3
SLOTS = 64  # parts of a shard, so that a shard is no single task
SEED = 7

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _hex(text: Column, digits: int) -> Column:
    """A number of so many hexadecimal digits from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(k, null, src, size, target) of (null, src, size): shares by weight, capped, excess reshared.

    Sources are met in the order in which their caps bind as the common level rises, so the
    level at the first one that stays under its cap holds for all that follow.
    """
    everything = Window.partitionBy(F.lit(0))  # one row a source
    place = F.row_number().over(everything.orderBy("null", "src")) - 1
    named = sizes.select(place.alias("k"), "null", "src", "size").withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("k") % len(weights)))
    rising = everything.orderBy(F.col("cap") / F.col("weight"), "k")
    total = lambda c: F.sum(c).over(everything)
    before = lambda c: F.coalesce(F.sum(c).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (share * total("size") - before("cap")) / (total("weight") - before("weight"))
    levelled = named.withColumn("cap", most * F.col("size")).withColumn("level", level)
    under = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    final = F.first(under, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.select("k", "null", "src", "size", F.coalesce(F.least("cap", final * F.col("weight")), F.col("cap")).alias("target"))


def split(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(k, shard, quota) of (k, quota): the leaves of the splitting tree."""
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "k", "quota")
    for level in range(levels):
        each = nodes.select("node", "k", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("i"))
        key = F.md5(F.concat_ws(":", F.lit(seed), F.col("node") + (1 << level), "k", "i").cast("binary"))
        drawn = F.row_number().over(Window.partitionBy("node").orderBy(key, "k", "i"))
        half = F.floor(F.count(F.lit(1)).over(Window.partitionBy("node")) / 2)
        side = each.select((2 * F.col("node") + (drawn > half).cast("long")).alias("node"), "k")
        nodes = side.groupBy("node", "k").agg(F.count(F.lit(1)).alias("quota"))
    return nodes.select("k", F.col("node").cast("int").alias("shard"), "quota")


def source_plan(sizes: DataFrame, weights: Sequence[float], share: float, most: float, levels: int, per_shard: int, seed: int) -> DataFrame:
    """From (null, src, size): each source's target and the shard of each of its blocks."""
    wanted = stored(targets(sizes, weights, share, most))
    everything = Window.partitionBy(F.lit(0))
    block = F.greatest(F.sum("target").over(everything) / (per_shard << levels), F.lit(1.0))
    quotas = stored(wanted.select("k", F.ceil(F.col("target") / block).cast("long").alias("quota")).where("quota > 0"))
    # The shards' quotas of a source, one after the other, against its blocks in permuted order.
    permuted = Window.partitionBy("k").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.lit("block"), "k", "b").cast("binary")), "b")
    blocks = quotas.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("b")).withColumn("r", F.row_number().over(permuted))
    dealt = split(quotas, levels, seed).select("k", "shard", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("i"))
    dealt = dealt.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("shard", "i")))
    shards = blocks.join(dealt, ["k", "r"]).groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "shard"))), lambda x: x["shard"]).alias("shards"))
    none = F.expr("cast(array() as array<int>)")
    return wanted.join(shards, "k", "left").select("null", "src", F.col("size").alias("source_size"), "target", F.coalesce("shards", none).alias("shards"))


def draw(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
    most: float = MOST, levels: int = SHARD_LEVELS, per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED,
) -> tuple[DataFrame, str]:
    """``docs`` plus one struct column, whose name is returned: size, source_size, target and draws.

    ``draws`` is an array of (copy, shard, place), empty for a document that the mix leaves out;
    ``place`` orders a shard.  ``most`` is 2 at most: a document is taken twice at most.
    """
    if not 0 < most <= 2:
        raise ValueError("most must be above 0 and at most 2")
    name = free_name(docs, "mix")
    own = {c: free_name(docs, f"mix_{c}") for c in ("null", "src", "size", "key", "ident", "tie", "bucket", "before", "source_size", "target", "blocks", "parts", "offset")}
    c = {k: F.col(v) for k, v in own.items()}
    group = [own["null"], own["src"], own["bucket"]]
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    sized = docs.withColumns({
        own["null"]: F.col(source).isNull(), own["src"]: F.coalesce(F.col(source).cast("string"), F.lit("")), own["size"]: word_count(text),
        own["key"]: F.md5(F.concat(ident, F.lit(f":{seed}")).cast("binary")), own["ident"]: ident, own["tie"]: F.xxhash64(F.col(text)),
    })
    sized = sized.withColumn(own["bucket"], F.conv(F.substring(own["key"], 1, BUCKETS_HEX), 16, 10).cast("int"))
    sums = stored(sized.groupBy(c["null"].alias("null"), c["src"].alias("src"), c["bucket"].alias("bucket")).agg(F.sum(own["size"]).alias("n")))
    plan = stored(source_plan(sums.groupBy("null", "src").agg(F.sum("n").alias("size")), weights, share, most, levels, per_shard, seed))
    line = Window.partitionBy("null", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).join(plan, ["null", "src"])
    blocks = F.size("shards")
    at = lambda words: F.least(F.floor(words * blocks / F.col("target")), blocks - 1).cast("int")
    part = lambda words: F.when(  # noqa: E731  the shards of the blocks that a bucket's documents can start in
        (blocks > 0) & (words < F.col("target")), F.struct(at(words).alias("first"), F.slice("shards", at(words) + 1, at(words + F.col("n")) - at(words) + 1).alias("shards"))
    )
    places = places.select(
        *[F.col(k).alias(own[k]) for k in ("null", "src", "bucket", "before", "source_size", "target")], blocks.alias(own["blocks"]),
        F.array(part(F.col("before")), part(F.col("before") + F.col("source_size"))).alias(own["parts"]),
    )
    ahead = Window.partitionBy(*group).orderBy(own["key"], own["ident"], own["size"], own["tie"]).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(places, group).withColumn(own["offset"], c["before"] + F.coalesce(F.sum(own["size"]).over(ahead), F.lit(0)))
    o = lambda e: c["offset"] + e * c["source_size"]
    number = lambda e: F.least(F.floor(o(e) * c["blocks"] / c["target"]), c["blocks"] - 1).cast("int")
    shard = lambda e: F.get(F.get(c["parts"], F.lit(e))["shards"], number(e) - F.get(c["parts"], F.lit(e))["first"])
    taken = lambda e: F.when(  # noqa: E731  by its middle, so that the stretch is met within half a document
        2 * o(e) + c["size"] < 2 * c["target"],
        F.array(F.struct(F.lit(e).alias("copy"), shard(e).alias("shard"), _hex(F.concat_ws(":", c["key"], F.lit(e)), 15).alias("place"))),
    ).otherwise(F.expr("cast(array() as array<struct<copy:int,shard:int,place:long>>)"))
    mixed = F.struct(c["size"].alias("size"), c["source_size"].alias("source_size"), c["target"].alias("target"), F.concat(taken(0), taken(1)).alias("draws"))
    return placed.select(*[F.col(f"`{x}`") for x in docs.columns], mixed.alias(name)), name


def mix(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """The mixed rows, shard by shard in shuffled order, with a struct column (copy, shard, place)."""
    drawn, name = draw(docs, **options)
    rows = drawn.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.col(name)["draws"]).alias(name))
    shard, place = F.col(name)["shard"], F.col(name)["place"]
    return rows.repartition(shard, F.pmod(place, F.lit(SLOTS))).sortWithinPartitions(shard, place), name


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; ``draws`` lists copy:shard:place of each time that the mix takes it."""
    drawn, name = draw(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    m = F.col(name)
    draws = F.array_join(F.transform(m["draws"], lambda d: F.concat_ws(":", d["copy"], d["shard"], d["place"])), ",")
    return drawn.select(
        "doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * F.size(m["draws"])).alias("taken"), draws.alias("draws")
    )


def _split_sql() -> str:
    """The splitting tree and the permuted blocks, level by level."""
    parts = ["n0 AS (SELECT 0::BIGINT AS node, k, quota FROM quotas)"]
    for level in range(SHARD_LEVELS):
        parts.append(f"""n{level + 1} AS (
  SELECT node, k, count(*)::BIGINT AS quota FROM (
    SELECT 2 * node + (row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws(':', {SEED}, node + {1 << level}, k, i)), k, i) > count(*) OVER (PARTITION BY node) // 2)::BIGINT AS node, k
    FROM (SELECT node, k, unnest(range(1, quota + 1)) AS i FROM n{level})) GROUP BY ALL)""")
    return ",\n".join(parts)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR || ':7') AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS id,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS level
  FROM s WINDOW r AS (ORDER BY 2.0::DOUBLE * source_size / w, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, coalesce(least(cap, w * first_value(CASE WHEN level * w < cap THEN level END IGNORE NULLS)
           OVER (ORDER BY cap / w, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), cap) AS target FROM o),
quotas AS (
  SELECT id AS k, ceil(target / (SELECT greatest(sum(target) / 1024, 1.0) FROM f))::BIGINT AS quota FROM f WHERE target > 0),
{tree},
blocks AS (
  SELECT k, b, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws(':', 7, 'block', k, b)), b) AS r FROM (SELECT k, unnest(range(0, quota)) AS b FROM quotas)),
dealt AS (SELECT k, node, row_number() OVER (PARTITION BY k ORDER BY node, i) AS r FROM (SELECT k, node, unnest(range(1, quota + 1)) AS i FROM n4)),
shards AS (SELECT k AS id, b, node AS shard FROM blocks JOIN dealt USING (k, r)),
p AS (
  SELECT d.*, f.source_size, f.id, f.target, coalesce(quota, 0) AS n_blocks,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source LEFT JOIN quotas q ON q.k = f.id),
c AS (
  SELECT doc_id, copy, id, least(floor((off + copy * source_size) * n_blocks / target), n_blocks - 1)::BIGINT AS b,
         concat_ws(':', copy, '{{shard}}', ('0x' || substr(md5(concat_ws(':', key, copy)), 1, 15))::BIGINT) AS draw
  FROM p, (SELECT unnest([0, 1]) AS copy) WHERE 2 * (off + copy * source_size) + size < 2 * target),
g AS (SELECT doc_id, string_agg(replace(draw, '{{shard}}', shard::VARCHAR), ',' ORDER BY copy) AS draws FROM c JOIN shards USING (id, b) GROUP BY doc_id)
SELECT doc_id, size, source_size, target,
       (size * ((2 * off + size < 2 * target)::INT + (2 * (off + source_size) + size < 2 * target)::INT))::BIGINT AS taken, coalesce(draws, '') AS draws
FROM p LEFT JOIN g USING (doc_id)
""".replace("{tree}", _split_sql()).replace("{{shard}}", "{shard}")
