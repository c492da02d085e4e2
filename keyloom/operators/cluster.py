"""Cluster metadata as set algebra.  Survey ids: D5-D10, G1-G9 (G7 has no behaviour to keep), J4, J5, J8, T3, T5, U1-U3, Q11, Q12, Q19."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import letters
from ..functions.keys import HIGHEST, LOWEST, host_of


LOOK_AHEAD = 8


def layout(spark: SparkSession, n: int) -> DataFrame:
    """n regions over two-letter bounds, open at both ends (G1)."""
    i = F.col("id")
    low = F.when(i == 0, LOWEST).otherwise(letters(i - 1))
    high = F.when(i == n - 1, HIGHEST).otherwise(letters(i))
    return spark.range(n).select("id", low.alias("min_key"), high.alias("max_key"))


def random_layout(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n regions over random two-letter bounds, at most 677."""
    cuts = spark.range(26 * 26).orderBy(F.rand(seed), "id").limit(n - 1).select(letters(F.col("id")).alias("cut"))
    ends = spark.createDataFrame([(LOWEST, 0)], "cut string, k int").unionByName(cuts.withColumn("k", F.lit(1)))
    w = Window.partitionBy(F.lit(0)).orderBy("k", "cut")
    return ends.select((F.row_number().over(w) - 1).cast("long").alias("id"), F.col("cut").alias("min_key"), F.coalesce(F.lead("cut").over(w), F.lit(HIGHEST)).alias("max_key"))


def assign(regions: DataFrame, servers: DataFrame, backups: int) -> DataFrame:
    """(id, place, server): primary hosts[i mod H] at place 0, then the next servers on other hosts.

    ``servers`` has (position, server), positions 0..H-1.  Each position looks at its next
    LOOK_AHEAD servers; only those that see too few hosts there look further, four times as
    far each round, so the work follows the servers, not regions times servers.
    """
    h, wanted = servers.count(), backups + 1
    ring = servers.select("position", "server", host_of(F.col("server")).alias("host"))
    starts, found, ahead = servers.select(F.col("position").alias("start")), None, min(h, LOOK_AHEAD * wanted)
    while h:
        steps = starts.select("start", F.explode(F.sequence(F.lit(0), F.lit(ahead - 1))).alias("j")).withColumn("position", (F.col("start") + F.col("j")) % h)
        first = steps.join(ring, "position").groupBy("start", "host").agg(F.min(F.struct("j", "server")).alias("x"))
        near = first.groupBy("start").agg(F.slice(F.sort_array(F.collect_list("x")), 1, wanted).alias("near"))
        done = near if ahead >= h else near.where(F.size("near") >= wanted)
        found = done if found is None else found.unionByName(done)
        if ahead >= h or (short := near.where(F.size("near") < wanted).select("start")).isEmpty():
            break
        starts, ahead = short, min(h, 4 * ahead)
    if found is None:
        return regions.select("id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("server")).limit(0)
    homes = regions.select("id", F.pmod("id", F.lit(h)).alias("start")).join(found, "start")
    return homes.select("id", F.posexplode("near").alias("place", "x")).select("id", "place", F.col("x.server").alias("server"))


def newcomers(alive: DataFrame, known: DataFrame, name: str = "server") -> DataFrame:
    return alive.select(name).distinct().join(known.select(name), name, "left_anti")


def departed(alive: DataFrame, known: DataFrame, name: str = "server") -> DataFrame:
    return known.select(name).distinct().join(alive.select(name), name, "left_anti")


def health(replicas: DataFrame, alive: DataFrame) -> DataFrame:
    """Per region: replicas, failures, whether the primary is dead and whether all data are lost."""
    marked = replicas.join(alive.select("server", F.lit(True).alias("up")), "server", "left").withColumn("down", F.col("up").isNull().cast("long"))
    return marked.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_replicas"), F.sum("down").alias("n_failed"),
        F.coalesce(F.bool_or((F.col("place") == 0) & (F.col("down") == 1)), F.lit(False)).alias("primary_failed"), F.min(F.col("down") == 1).alias("data_lost"),
    )


def affected(replicas: DataFrame, failed: DataFrame) -> DataFrame:
    """The regions that any of the failed servers held, once each."""
    return replicas.join(failed.select("server"), "server", "left_semi").select("id").distinct()


def reassign(replicas: DataFrame, alive: DataFrame, wanted: int) -> DataFrame:
    """New replica lists: the first live replica is primary, and the least live servers on hosts
    that the group does not use yet fill it up to ``wanted`` (G4, J8).  Lost regions stay out.
    """
    up = replicas.join(alive.select("server"), "server", "left_semi").withColumn("host", host_of(F.col("server")))
    kept = up.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("place")) - 1)
    short = kept.groupBy("id").agg(F.count(F.lit(1)).alias("have"), F.collect_set("host").alias("hosts")).where(F.col("have") < wanted)
    # One spare per host, and only as many hosts as could ever be needed: the used ones and the missing ones.
    spares = alive.select("server").distinct().withColumn("host", host_of(F.col("server"))).groupBy("host").agg(F.min("server").alias("server"))
    first = spares.orderBy("server").limit(2 * wanted).groupBy().agg(F.sort_array(F.collect_list(F.struct("server", "host"))).alias("spares"))
    free = short.withColumn("one", F.lit(1)).join(F.broadcast(first.withColumn("one", F.lit(1))), "one")
    pick = F.slice(F.filter("spares", lambda s: ~F.array_contains("hosts", s["host"])), F.lit(1), F.lit(wanted) - F.col("have").cast("int"))
    added = free.select("id", "have", F.posexplode(pick).alias("k", "s")).select("id", (F.col("have") + F.col("k")).cast("int").alias("place"), F.col("s.server").alias("server"))
    return kept.select("id", F.col("place").cast("int").alias("place"), "server").unionByName(added)


def under_replicated(replicas: DataFrame, alive: DataFrame, wanted: int) -> DataFrame:
    """Every region checked, not only the first (Q19)."""
    up = replicas.join(alive.select("server"), "server", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_alive"))
    return replicas.select("id").distinct().join(up, "id", "left").select("id", F.coalesce("n_alive", F.lit(0)).alias("n_alive")).where(F.col("n_alive") < wanted)


def open_commands(replicas: DataFrame) -> DataFrame:
    """One OPEN command per replica of a fresh layout."""
    return replicas.select("server", F.lit("OPEN").alias("command"), "id", F.when(F.col("place") == 0, "PRIMARY").otherwise("BACKUP").alias("role"))


def election(nodes: DataFrame) -> DataFrame:
    """Each node's predecessor to watch; the first by name leads (T5, Q11).

    Election nodes are the members of one control plane: a handful of rows, whatever the data.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("node")
    return nodes.select("node", (F.row_number().over(w) == 1).alias("leader"), F.lag("node").over(w).alias("watches"))


def can_boot(alive: DataFrame, configured: int) -> DataFrame:
    """Whether enough servers are there for a first start."""
    return alive.agg((F.countDistinct("server") >= configured).alias("ready"))


def next_clock(clocks: DataFrame) -> DataFrame:
    return clocks.agg((F.coalesce(F.max("clock"), F.lit(0)) + 1).alias("clock"))  # G9


def distinct_hosts(servers: DataFrame) -> DataFrame:
    return servers.agg(F.countDistinct(host_of(F.col("server"))).alias("n_hosts"))  # U3
