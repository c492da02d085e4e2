"""Named queries over the driver's tables, each with an independent SQL oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, keys, records
from ..operators import cluster, log, replication, routing, running, scan, stats, workload
from ..sources import tables
from ..streaming import logs as streams

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


M = """m AS (SELECT user_id::VARCHAR AS key, event_id AS lsn, value,
  CASE WHEN event_type IN ('signup', 'click') THEN 'put' WHEN event_type = 'error' THEN 'delete' ELSE 'put_if_exists' END AS op FROM events),
o AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'put_if_exists' THEN op END IGNORE NULLS)
  OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'put', false) AS there FROM m),
st AS (SELECT key, lsn, value FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM o WHERE op <> 'put_if_exists' OR there)
  WHERE r = 1 AND op <> 'delete')"""
REGIONS = [(0, "-oo", "Customer#000000400"), (1, "Customer#000000400", "Customer#000001000"), (2, "Customer#000001000", "+oo")]


def _regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "id int, min_key string, max_key string")


# ---- state and reads -------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current value of every key in a range, first 20 in key order, each with its region."""
    state = log.current_state(tables.mutation_log(spark, sf_dir))
    regions = spark.createDataFrame([(0, "-oo", "4"), (1, "4", "7"), (2, "7", "+oo")], "id int, min_key string, max_key string")
    return routing.route(scan.scan(state, start="1", stop="9", limit=20), regions)


query(f"""WITH {M} SELECT key, lsn, value, CASE WHEN key < '4' THEN 0 WHEN key < '7' THEN 1 ELSE 2 END::INT AS region
FROM st WHERE key >= '1' AND key < '9' ORDER BY key LIMIT 20""")(flagship)


@query(f"WITH {M} SELECT * FROM st")
def kv_current_state(spark, sf_dir):
    return log.current_state(tables.mutation_log(spark, sf_dir))


@query(f"WITH {M} SELECT key, lsn, op, value FROM o WHERE op = 'put_if_exists' AND NOT there")
def kv_rejected_conditional_puts(spark, sf_dir):
    return log.rejected(tables.mutation_log(spark, sf_dir))


@query(f"WITH {M} SELECT key, lsn, op, value FROM o WHERE op = 'delete' AND NOT there")
def kv_missing_deletes(spark, sf_dir):
    return log.missing_deletes(tables.mutation_log(spark, sf_dir))


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name = 'Customer#000000042'")
def kv_point_get(spark, sf_dir):
    return scan.get(tables.customers(spark, sf_dir), "Customer#000000042").select("key", "value")


@query("""WITH k AS (SELECT DISTINCT 'Customer#' || lpad((o_custkey + 700)::VARCHAR, 9, '0') AS key FROM orders)
SELECT k.key, c_name IS NOT NULL AS key_found, substr(c_mktsegment, 3) AS value, coalesce(length(c_mktsegment), 0)::INT AS value_size,
  0::INT AS bytes_remaining, coalesce(length(c_mktsegment) < 2, false) AS offset_too_large
FROM k LEFT JOIN customer ON c_name = k.key""")
def kv_get_many_found_flag(spark, sf_dir):
    wanted = tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 700).cast("string"), 9, "0")).alias("key"))
    got = scan.get_many(tables.customers(spark, sf_dir), wanted, offset=2)
    return got.fillna({"value_size": 0, "bytes_remaining": 0})


@query("""SELECT DISTINCT 'Customer#' || lpad((o_custkey + 700)::VARCHAR, 9, '0') AS key FROM orders
WHERE 'Customer#' || lpad((o_custkey + 700)::VARCHAR, 9, '0') IN (SELECT c_name FROM customer)""")
def kv_exists(spark, sf_dir):
    wanted = tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 700).cast("string"), 9, "0")).alias("key")).distinct()
    return scan.exists(tables.customers(spark, sf_dir), wanted)


@query("""SELECT doc_id, substr(text, 101, 50) AS slice, length(text) < 100 AS offset_too_large, greatest(length(text) - 150, 0)::INT AS bytes_remaining FROM documents""")
def kv_value_slice(spark, sf_dir):
    v = F.col("text")
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id", keys.value_slice(v, 100, 50).alias("slice"), keys.offset_too_large(v, 100).alias("offset_too_large"), keys.bytes_remaining(v, 100, 50).alias("bytes_remaining")
    )


@query("SELECT doc_id, sha256(substr(text, 1, 20) || 'PATCHED' || substr(text, 28)) AS patched_sha256 FROM documents WHERE length(text) >= 20")
def kv_put_at_offset(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").where(~keys.offset_too_large(F.col("text"), 20))
    return docs.select("doc_id", F.sha2(keys.put_at(F.col("text"), F.lit("PATCHED"), 20), 256).alias("patched_sha256"))


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name >= 'Customer#000000100' ORDER BY c_name LIMIT 50")
def kv_seek_limit(spark, sf_dir):
    return scan.scan(tables.customers(spark, sf_dir).select("key", "value"), start="Customer#000000100", limit=50)


@query("""SELECT key, used FROM (SELECT url AS key, sum(octet_length(encode(url)) + octet_length(encode(html)) + 8) OVER (ORDER BY url)::BIGINT AS used
FROM (SELECT * FROM pages WHERE url >= 'http://m' ORDER BY url LIMIT 100)) WHERE used <= 60000""")
def kv_seek_limit_bytes(spark, sf_dir):
    return scan.seek_within_bytes(tables.pages(spark, sf_dir), "http://m", 100, 60_000).select("key", "used")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000300'")
def kv_range_scan_stop(spark, sf_dir):
    return scan.scan(tables.customers(spark, sf_dir).select("key", "value"), start="Customer#000000100", stop="Customer#000000300")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name > 'Customer#000000100' ORDER BY c_name LIMIT 16")
def kv_scan_greater(spark, sf_dir):
    return scan.scan(tables.customers(spark, sf_dir).select("key", "value"), start="Customer#000000100", after=True, limit=16)


@query("SELECT url AS key, page_id FROM pages WHERE url LIKE 'https://blog.%'")
def kv_prefix_scan(spark, sf_dir):
    return scan.scan(tables.pages(spark, sf_dir).select("key", "page_id"), prefix="https://blog.")


@query("SELECT url AS key FROM pages WHERE url LIKE 'http://th%'")
def kv_prefix_keys_only(spark, sf_dir):
    return scan.scan(tables.pages(spark, sf_dir), prefix="http://th", keys_only=True)


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name >= 'Customer#000000390' AND c_name < 'Customer#000000400' ORDER BY c_name LIMIT 50")
def kv_seek_within_region(spark, sf_dir):
    return scan.within_region(tables.customers(spark, sf_dir).select("key", "value"), _regions(spark), "Customer#000000390", 50)


# ---- routing and hashes ----------------------------------------------------------------

_ROUTED = "CASE WHEN c_name < 'Customer#000000400' THEN 0 WHEN c_name < 'Customer#000001000' THEN 1 ELSE 2 END::INT"
_DJB2 = """list_reduce(list_prepend(5381::HUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::HUGEINT)),
  lambda a, b: (a * 33 + b) % 18446744073709551616::HUGEINT)"""
_PREFIX = "chr((65 + b // 26)::INT) || chr((65 + b % 26)::INT)"


@query(f"SELECT c_name AS key, {_ROUTED} AS region FROM customer")
def route_range(spark, sf_dir):
    return routing.route(tables.customers(spark, sf_dir).select("key"), _regions(spark))


@query(f"SELECT {_ROUTED} AS region, count(*) AS n_requests FROM customer GROUP BY 1")
def region_load(spark, sf_dir):
    return routing.load(route_range(spark, sf_dir))


@query(f"SELECT key, h::VARCHAR AS hash, (h % 7)::BIGINT AS bucket FROM (SELECT c_name AS key, {_DJB2} AS h FROM customer)")
def route_hash_djb2(spark, sf_dir):
    h = hashing.djb2(F.col("key"))
    rows = tables.customers(spark, sf_dir).select("key", h.alias("h"))
    return rows.select("key", hashing.unsigned(F.col("h")).cast("string").alias("hash"), hashing.modulo(F.col("h"), 7).alias("bucket"))


@query(f"""WITH k AS (SELECT {_PREFIX} || c_name AS key FROM (SELECT c_name, ({_DJB2} % 5)::BIGINT AS b FROM customer))
SELECT CASE WHEN key < 'AA' THEN 0 WHEN key < 'AB' THEN 1 WHEN key < 'AC' THEN 2 WHEN key < 'AD' THEN 3 ELSE 4 END::BIGINT AS region, count(*) AS n_requests
FROM k GROUP BY 1""")
def route_hash_prefix_skew(spark, sf_dir):
    keyed = tables.customers(spark, sf_dir).select(hashing.bucket_key(F.col("key"), 5).alias("key"))
    return routing.load(routing.route(keyed, cluster.layout(spark, 5)))


@query("""SELECT o_orderkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, 8), lambda i: ((o_orderkey >> (8 * i)::INT) & 255)::HUGEINT)),
  lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::VARCHAR AS key FROM orders""")
def fnv_key_scramble(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", hashing.key_name(F.col("o_orderkey"), True).alias("key"))


_HOMES = [(0, "-oo", "Customer#000000400", "host000000:9000"), (1, "Customer#000000400", "Customer#000001000", "host000001:9002"), (2, "Customer#000001000", "+oo", "host000000:9003")]


@query(f"""WITH r AS (SELECT c_name AS key, {_ROUTED} AS region FROM customer)
SELECT key, region, CASE region WHEN 0 THEN 'host000000:9000' WHEN 1 THEN 'host000001:9002' ELSE 'host000000:9003' END AS hostname, s_acctbal
FROM r JOIN supplier ON s_suppkey = CASE region WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 3 END""")
def route_to_server(spark, sf_dir):
    regions = spark.createDataFrame(_HOMES, "id int, min_key string, max_key string, primary string")
    servers = tables.servers(spark, sf_dir).select(F.col("server").alias("hostname"), "s_acctbal")
    routed = routing.route(tables.customers(spark, sf_dir).select("key"), regions)
    return routing.connect(routed, regions, servers).select("key", "region", "hostname", "s_acctbal")


@query(f"SELECT key, b AS bucket, {_PREFIX} AS prefix FROM (SELECT c_name AS key, ({_DJB2} % 40)::BIGINT AS b FROM customer)")
def route_to_bucket(spark, sf_dir):
    return routing.hash_route(tables.customers(spark, sf_dir).select("key"), 40)


@query("SELECT o_orderkey, o_custkey % 4 + CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 0 END AS worker FROM orders")
def worker_of_task(spark, sf_dir):
    h, server = F.col("o_custkey"), F.col("o_orderkey") % 2 == 0
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", F.when(server, routing.worker(h, 8, True)).otherwise(routing.worker(h, 8)).alias("worker"))


@query("SELECT s_suppkey AS worker, floor(s_acctbal)::BIGINT AS queue_len FROM supplier ORDER BY floor(s_acctbal), s_suppkey LIMIT 1")
def least_loaded_worker(spark, sf_dir):
    return routing.least_loaded(tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), F.floor("s_acctbal").alias("queue_len")))


# ---- measurements ----------------------------------------------------------------------

_P = {"p50": 0.5, "p70": 0.7, "p90": 0.9, "p99": 0.99, "p99_9": 0.999, "p99_99": 0.9999}


def _percentiles(by: str) -> str:
    picks = ", ".join(f"CASE WHEN floor(any_value(total) * {p}::DOUBLE) = 0 THEN 0 ELSE min(CASE WHEN r >= floor(total * {p}::DOUBLE) THEN l END) END::BIGINT AS {n}" for n, p in _P.items())
    return f"""e AS (SELECT user_id % 4 AS thread, event_type AS op, floor(value * 100)::BIGINT AS l FROM events),
ok AS (SELECT {by}, l, row_number() OVER (PARTITION BY {by} ORDER BY l) AS r, count(*) OVER (PARTITION BY {by}) AS total FROM e WHERE l < 100000),
miss AS (SELECT {by}, count(*) FILTER (WHERE l >= 100000) AS missing FROM e GROUP BY ALL),
p AS (SELECT {by}, count(*) AS n, min(l) AS min, max(l) AS max, (sum(l) // count(*))::BIGINT AS avg, {picks} FROM ok GROUP BY {by})"""


@query(f"WITH {_percentiles('op')} SELECT p.*, missing FROM p JOIN miss USING (op)")
def lat_percentiles_histogram(spark, sf_dir):
    return stats.summary(stats.histogram(tables.latencies(spark, sf_dir), ["op"]), ["op"])


@query(f"""WITH {_percentiles('thread, op')} SELECT op, sum(n)::BIGINT AS n, sum(missing)::BIGINT AS missing,
{', '.join(f'(sum({c}) // 4)::BIGINT AS {c}' for c in ['min', 'max', 'avg', *_P])} FROM p JOIN miss USING (thread, op) GROUP BY op""")
def lat_percentiles_thread_avg(spark, sf_dir):
    each = stats.summary(stats.histogram(tables.latencies(spark, sf_dir), ["thread", "op"]), ["thread", "op"])
    return stats.thread_average(each, ["op"], 4)


@query("""SELECT op, max(v) FILTER (WHERE k = size // 2) AS p50, max(v) FILTER (WHERE k = size * 90 // 100) AS p90, max(v) FILTER (WHERE k = size * 99 // 100) AS p99
FROM (SELECT event_type AS op, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS size FROM events) GROUP BY op""")
def lat_sorted_picks(spark, sf_dir):
    return stats.sorted_picks(tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), "value"), ["op"], "value")


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) / 3600.0::DOUBLE AS rate FROM events GROUP BY 1")
def rate_tumbling(spark, sf_dir):
    return stats.tumbling_rates(tables.table(spark, sf_dir, "events"), "1 hour", 3600.0)


@query("""WITH t AS (SELECT event_type, date_trunc('day', ts) AS ts, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT event_type, ts, (sum(n) OVER (PARTITION BY event_type ORDER BY ts))::BIGINT AS total FROM t)
SELECT event_type, ts, total, total - lag(total) OVER w AS delta, (total - lag(total) OVER w) / 86400.0::DOUBLE AS rate FROM c
WINDOW w AS (PARTITION BY event_type ORDER BY ts) QUALIFY lag(total) OVER w IS NOT NULL""")
def rate_delta(spark, sf_dir):
    daily = tables.table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    total = daily.withColumn("total", F.sum("n").over(Window.partitionBy("event_type").orderBy("ts"))).drop("n")
    return stats.interval_rates(total, ["event_type"], F.lit(86400.0)).where("delta is not null")


@query("""SELECT user_id::VARCHAR AS key, arg_max(event_id, event_id) - arg_min(event_id, event_id) AS delta,
  (max(event_id) - min(event_id)) / 10.0::DOUBLE AS rate FROM events GROUP BY 1""")
def counter_delta(spark, sf_dir):
    grouped = tables.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("key"))
    return stats.counter_delta(grouped.agg(F.min("event_id").alias("value")), grouped.agg(F.max("event_id").alias("value")), 10.0)


@query("""SELECT user_id % 8 AS client, count(*) AS ops, count(*) / max(floor(value) + 1) AS ops_per_sec FROM events GROUP BY 1""")
def client_throughput(spark, sf_dir):
    clients = tables.table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("client"), F.lit(1).alias("ops"), (F.floor("value") + 1).alias("seconds"))
    return stats.throughput(clients, ["client"])


@query("""WITH r AS (SELECT user_id % 4 AS device, event_id AS ts, value AS in_flight, sum(length(props)) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS bytes,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS ops FROM events),
d AS (SELECT device, in_flight, bytes - lag(bytes) OVER w AS b, ops - lag(ops) OVER w AS o FROM r WINDOW w AS (PARTITION BY device ORDER BY ts))
SELECT device, round(avg(in_flight), 6) AS in_flight, round(CASE WHEN sum(o) = 0 THEN 0 ELSE sum(b) / sum(o) END, 6) AS request_bytes FROM d GROUP BY device""")
def device_request_sizes(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("device"), F.col("event_id").alias("ts"), F.col("value").alias("in_flight"), F.length("props").alias("size"))
    samples = running.sum_before(running.sum_before(rows, ["device"], "ts", F.col("size"), "bytes"), ["device"], "ts", F.lit(1), "ops")
    samples = samples.withColumn("bytes", F.col("bytes") + F.col("size")).withColumn("ops", F.col("ops") + 1)
    return stats.request_sizes(samples).select("device", F.round("in_flight", 6).alias("in_flight"), F.round("request_bytes", 6).alias("request_bytes"))


@query("""SELECT l_linestatus, round(avg(l_discount * 100), 6) AS idle, round(avg(l_tax * 100), 6) AS iowait,
  round((100 - avg(l_discount * 100) - avg(l_tax * 100)) / 100 * 32 * 2.4e9 / count(*), 3) AS cycles FROM lineitem GROUP BY 1""")
def cycles_per_operation(spark, sf_dir):
    g = tables.table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.avg(F.col("l_discount") * 100).alias("idle"), F.avg(F.col("l_tax") * 100).alias("iowait"), F.count(F.lit(1)).alias("n"))
    cycles = stats.cycles_per_op(F.col("idle"), F.col("iowait"), 32, 2.4e9, F.col("n"))
    return g.select("l_linestatus", F.round("idle", 6).alias("idle"), F.round("iowait", 6).alias("iowait"), F.round(cycles, 3).alias("cycles"))


@query("SELECT round(avg(l_discount * 100), 6) AS usr, round(avg(l_tax * 100), 6) AS sys, round(avg(l_quantity), 6) AS iowait, round(avg(100 - l_quantity), 6) AS idle FROM lineitem WHERE l_linenumber % 2 = 0")
def cpu_use(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, "all").otherwise("0").alias("cpu"), (F.col("l_discount") * 100).alias("usr"), (F.col("l_tax") * 100).alias("sys"),
        F.col("l_quantity").alias("iowait"), (100 - F.col("l_quantity")).alias("idle"),
    )
    return stats.cpu_use(rows).select(*[F.round(c, 6).alias(c) for c in ("usr", "sys", "iowait", "idle")])


@query("SELECT 'dev' || l_linenumber AS device, round(avg(l_quantity), 6) AS queue_depth, round(avg(l_extendedprice), 4) AS request_size, round(avg(l_discount * 100), 6) AS util FROM lineitem GROUP BY 1")
def device_use(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("dev"), "l_linenumber").alias("device"), F.col("l_quantity").alias("queue_depth"), F.col("l_extendedprice").alias("request_size"), (F.col("l_discount") * 100).alias("util")
    )
    return stats.device_use(rows).select("device", F.round("queue_depth", 6).alias("queue_depth"), F.round("request_size", 4).alias("request_size"), F.round("util", 6).alias("util"))


@query("""SELECT event_type AS device, (max(event_id) - min(event_id)) * 512 / 1048576.0::DOUBLE AS read_mb, (max(user_id) - min(user_id)) * 512 / 1048576.0::DOUBLE AS write_mb
FROM events GROUP BY 1""")
def disk_traffic(spark, sf_dir):
    by = tables.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("device"))
    before, after = (by.agg(f("event_id").alias("read_sectors"), f("user_id").alias("write_sectors")) for f in (F.min, F.max))
    return stats.disk_traffic(before, after)


@query("SELECT date_trunc('day', ts) AS t, count(*) AS value FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1")
def series_sum(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    one = lambda kind: events.where(F.col("event_type") == kind).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("t")).agg(F.count(F.lit(1)).alias("value"))
    return stats.series_sum(one("click"), one("view"), one("error"))


@query(f"WITH {M} SELECT count(*) AS n_keys FROM st")
def key_count(spark, sf_dir):
    return stats.key_count(log.current_state(tables.mutation_log(spark, sf_dir)))


@query("SELECT event_type AS op, count(*) AS n, sum(floor(value * 100)::BIGINT + 1)::BIGINT AS total_us FROM events WHERE floor(value * 100) + 1 > 0 GROUP BY 1")
def monitor_samples(spark, sf_dir):
    return stats.monitor_samples(tables.latencies(spark, sf_dir)).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_us").alias("total_us"))


# ---- replication -----------------------------------------------------------------------


@query("""SELECT l_orderkey AS "offset", l_orderkey - l_orderkey % 512 AS segment, (l_orderkey - l_orderkey % 512) * 3 + 4096 + l_orderkey % 512 AS new_offset, count(*) AS n
FROM lineitem GROUP BY ALL""")
def offset_translate(spark, sf_dir):
    offsets = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("offset"))
    segments = offsets.select(keys.segment_start(F.col("offset"), 512).alias("segment")).distinct().withColumn("new_segment", F.col("segment") * 3 + 4096)
    return replication.translate(offsets, segments, 512).groupBy("offset", "segment", "new_offset").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {M}, b AS (SELECT (key::BIGINT % 8) AS region, lsn, length(key) + 24 AS bytes FROM m),
s AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY region ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM b)
SELECT region, lsn, start, start // 1024 AS buffer, start % 1024 AS place FROM s""")
def log_replay_buffer_fill(spark, sf_dir):
    rows = tables.mutation_log(spark, sf_dir).withColumn("region", F.col("key").cast("long") % 8)
    return replication.fill_buffers(rows, 1024, F.length("key") + 24).select("region", "lsn", "start", "buffer", "place")


@query(f"""WITH {M.replace('FROM events)', 'FROM events WHERE event_id > 0)')} SELECT * FROM st""")
def log_replay_state(spark, sf_dir):
    return log.replay(tables.mutation_log(spark, sf_dir))


@query("SELECT coalesce(min(event_id) FILTER (WHERE value > 200), max(event_id) + 1) - 1 AS acknowledged FROM events")
def contiguous_ack(spark, sf_dir):
    acks = tables.table(spark, sf_dir, "events").where("value <= 200").select(F.col("event_id").alias("seq"))
    return replication.contiguous(acks)


# ---- cluster metadata ------------------------------------------------------------------

_S = """s AS (SELECT s_suppkey AS p, 'host' || lpad((s_suppkey // 5)::VARCHAR, 6, '0') AS host,
  'host' || lpad((s_suppkey // 5)::VARCHAR, 6, '0') || ':' || (9000 + s_suppkey % 5) AS server, s_acctbal >= 500 AS up FROM supplier),
h AS (SELECT count(*) AS n FROM s),
st AS (SELECT n_nationkey::BIGINT AS id, j, s.server, s.host, s.up FROM nation, h, range(0, (SELECT n FROM h)) t(j), s WHERE s.p = (n_nationkey + j) % h.n),
f AS (SELECT *, row_number() OVER (PARTITION BY id, host ORDER BY j) AS r FROM st),
rep AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY j) - 1 AS place, server, host, up FROM f WHERE r = 1 QUALIFY place <= 2)"""


def _replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return cluster.assign(regions, tables.servers(spark, sf_dir).select("position", "server"), 2)


def _alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.servers(spark, sf_dir).where("s_acctbal >= 500").select("server")


@query(f"WITH {_S} SELECT id, place::BIGINT AS place, server FROM rep")
def replica_assign(spark, sf_dir):
    return _replicas(spark, sf_dir).select("id", F.col("place").cast("long").alias("place"), "server")


@query(f"""WITH {_S}, k AS (SELECT server FROM s WHERE p % 3 <> 0) SELECT 'new' AS change, server FROM s WHERE up AND server NOT IN (SELECT server FROM k)
UNION ALL SELECT 'dead', server FROM k WHERE server NOT IN (SELECT server FROM s WHERE up)""")
def alive_set_diff(spark, sf_dir):
    alive, known = _alive(spark, sf_dir), tables.servers(spark, sf_dir).where("position % 3 <> 0").select("server")
    return cluster.newcomers(alive, known).select(F.lit("new").alias("change"), "server").union(cluster.departed(alive, known).select(F.lit("dead"), "server"))


@query(f"""WITH {_S} SELECT id, count(*) AS n_replicas, count(*) FILTER (WHERE NOT up) AS n_failed, bool_or(place = 0 AND NOT up) AS primary_failed, bool_and(NOT up) AS data_lost
FROM rep GROUP BY id""")
def replica_health(spark, sf_dir):
    return cluster.health(_replicas(spark, sf_dir), _alive(spark, sf_dir))


@query(f"WITH {_S} SELECT DISTINCT id FROM rep WHERE NOT up")
def affected_regions(spark, sf_dir):
    failed = tables.servers(spark, sf_dir).where("s_acctbal < 500").select("server")
    return cluster.affected(_replicas(spark, sf_dir), failed)


@query(f"""WITH {_S}, live AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS place, server, host FROM rep WHERE up),
c AS (SELECT id, count(*) AS have FROM live GROUP BY id HAVING count(*) < 3),
sp AS (SELECT host, min(server) AS server FROM s WHERE up GROUP BY host),
a AS (SELECT c.id, have + row_number() OVER (PARTITION BY c.id ORDER BY sp.server) - 1 AS place, sp.server FROM c, sp
      WHERE sp.host NOT IN (SELECT host FROM live l WHERE l.id = c.id))
SELECT id, place::BIGINT AS place, server FROM live UNION ALL SELECT id, place::BIGINT, server FROM a WHERE place < 3""")
def replica_reassign(spark, sf_dir):
    done = cluster.reassign(_replicas(spark, sf_dir), _alive(spark, sf_dir), 3)
    return done.select("id", F.col("place").cast("long").alias("place"), "server")


@query(f"WITH {_S} SELECT id, count(*) FILTER (WHERE up) AS n_alive FROM rep GROUP BY id HAVING count(*) FILTER (WHERE up) < 3")
def under_replicated_regions(spark, sf_dir):
    return cluster.under_replicated(_replicas(spark, sf_dir), _alive(spark, sf_dir), 3)


@query(f"WITH {_S} SELECT server, 'OPEN' AS command, id, CASE WHEN place = 0 THEN 'PRIMARY' ELSE 'BACKUP' END AS role FROM rep")
def open_commands(spark, sf_dir):
    return cluster.open_commands(_replicas(spark, sf_dir))


@query("""WITH r AS (SELECT i AS id, chr((65 + (i - 1) // 26)::INT) || chr((65 + (i - 1) % 26)::INT) AS lo, chr((65 + i // 26)::INT) || chr((65 + i % 26)::INT) AS hi FROM range(0, 40) t(i))
SELECT id, CASE WHEN id = 0 THEN '-oo' ELSE lo END AS min_key, CASE WHEN id = 39 THEN '+oo' ELSE hi END AS max_key FROM r""")
def region_layout(spark, sf_dir):
    return cluster.layout(spark, 40)


@query("SELECT n_name AS node, row_number() OVER (ORDER BY n_name) = 1 AS leader, lag(n_name) OVER (ORDER BY n_name) AS watches FROM nation")
def election_leader_watch(spark, sf_dir):
    return cluster.election(tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("node")))


@query("SELECT count(DISTINCT 'host' || lpad((s_suppkey // 5)::VARCHAR, 6, '0') || ':' || (9000 + s_suppkey % 5)) FILTER (WHERE s_acctbal >= 500) >= 50 AS ready FROM supplier")
def can_boot(spark, sf_dir):
    return cluster.can_boot(_alive(spark, sf_dir), 50)


@query("SELECT max(s_suppkey) + 1 AS clock FROM supplier")
def next_clock(spark, sf_dir):
    return cluster.next_clock(tables.servers(spark, sf_dir).select(F.col("position").alias("clock")))


@query("SELECT count(DISTINCT s_suppkey // 5) AS n_hosts FROM supplier")
def distinct_hosts(spark, sf_dir):
    return cluster.distinct_hosts(tables.servers(spark, sf_dir))


# ---- records and workloads -------------------------------------------------------------


def _part_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), records.to_text(fields).alias("value"), "p_size")


@query("SELECT p_partkey AS key, p_brand AS brand, p_size::VARCHAR AS size, NULL::VARCHAR AS colour FROM part")
def record_project_fields(spark, sf_dir):
    rows = _part_text(spark, sf_dir).select("key", records.to_map(F.col("value")).alias("r"))
    return rows.select("key", *records.project(F.col("r"), ["brand", "size", "colour"]))


@query("""SELECT p_partkey AS key, 'brand ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' colour red' ELSE '' END || ' size ' || (p_size + 1) || ' type ' || p_type AS record,
  CASE WHEN p_size % 2 = 0 THEN 'colour' ELSE '' END AS unknown_fields FROM part WHERE p_size % 3 = 0""")
def record_update_merge(spark, sf_dir):
    rows = _part_text(spark, sf_dir)
    size = F.create_map(F.lit("size"), (F.col("p_size") + 1).cast("string"))
    both = F.create_map(F.lit("size"), (F.col("p_size") + 1).cast("string"), F.lit("colour"), F.lit("red"))
    updates = rows.where("p_size % 3 = 0").select("key", F.when(F.col("p_size") % 2 == 0, both).otherwise(size).alias("fields"))
    done = log.read_modify_write(rows.select("key", records.to_map(F.col("value")).alias("record")), updates)
    return done.select("key", records.to_text(F.col("record")).alias("record"), F.array_join("unknown_fields", ",").alias("unknown_fields"))


@query("""WITH s AS (SELECT * FROM part WHERE p_partkey >= 100 ORDER BY p_partkey LIMIT 40)
SELECT p_partkey AS key, 'brand' AS field, p_brand AS value FROM s UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM s""")
def scan_record_fields(spark, sf_dir):
    rows = _part_text(spark, sf_dir).select("key", records.to_map(F.col("value")).alias("record"))
    return scan.scan_fields(rows, 100, 40, ["brand", "size"])


_ODD = "CASE o_orderkey % 5 WHEN 0 THEN ' YES ' WHEN 1 THEN 'off' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' END"


@query(f"""SELECT o_orderkey, (64 - (o_custkey % 64)) % 64 AS pad, CASE WHEN o_orderpriority = o_orderstatus THEN 0 WHEN o_orderpriority < o_orderstatus THEN 1 ELSE -1 END::INT AS sign,
  concat_ws('', o_orderstatus, {_ODD}, o_orderpriority) AS parts, CASE WHEN lower(trim({_ODD})) IN ('yes', '1') THEN 'true' WHEN lower(trim({_ODD})) = 'off' THEN 'false' ELSE '-' END AS flag,
  o_custkey % 400 <= 255 AS subnet, o_custkey * 1000000 + 1 AS micros FROM orders""")
def small_scalars(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    odd = F.when(k == 0, " YES ").when(k == 1, "off").when(k == 2, "1").when(k == 3, "maybe")
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    later = start + F.make_dt_interval(secs=F.col("o_custkey").cast("decimal(18,6)"))
    return tables.table(spark, sf_dir, "orders").select(
        "o_orderkey", keys.padding(F.col("o_custkey"), 64).alias("pad"), keys.compare(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("sign"),
        keys.joined(F.col("o_orderstatus"), odd, F.col("o_orderpriority")).alias("parts"), F.coalesce(keys.parse_bool(odd).cast("string"), F.lit("-")).alias("flag"),
        keys.is_subnet(F.concat(F.lit("10.1."), (F.col("o_custkey") % 400).cast("string"))).alias("subnet"), keys.micros_between(start, later, round_up=True).alias("micros"),
    )


_U = "((o_orderkey * 2654435761) % 4294967296) / 4294967296.0::DOUBLE"


@query("""SELECT CASE WHEN o_orderkey % 10 < 6 THEN 'small' WHEN o_orderkey % 10 < 8 THEN 'medium' ELSE 'large' END AS kind, count(*) AS n,
  sum(CASE WHEN o_orderkey % 10 < 6 THEN 10 WHEN o_orderkey % 10 < 8 THEN 120 ELSE 1200 END)::BIGINT AS bytes FROM orders GROUP BY 1""")
def value_size_mix(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders").select(workload.size_class(F.col("o_orderkey"), "sd").alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(workload.value_size(F.col("kind"))).alias("bytes"))


@query(f"SELECT CASE WHEN {_U} < 0.5 THEN 'read' WHEN {_U} < 0.75 THEN 'update' WHEN {_U} < 0.95 THEN 'scan' ELSE 'rmw' END AS op, count(*) AS n FROM orders GROUP BY 1")
def op_mix(spark, sf_dir):
    u = workload.uniform_of(F.col("o_orderkey"))
    op = workload.discrete(u, [("read", 50), ("update", 25), ("scan", 20), ("rmw", 5)])
    return tables.table(spark, sf_dir, "orders").groupBy(op.alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH z AS (SELECT sum(1 / pow(i, 0.99)) AS zn FROM range(1, 1001) t(i)),
u AS (SELECT ((i * 2654435761) % 4294967296) / 4294967296.0::DOUBLE AS u FROM range(0, 20000) t(i)),
e AS (SELECT u, zn, (1 - pow(2.0 / 1000, 0.01)) / (1 - (1 + pow(0.5, 0.99)) / zn) AS eta FROM u, z)
SELECT CASE WHEN u * zn < 1 THEN 0 WHEN u * zn < 1 + pow(0.5, 0.99) THEN 1 ELSE least(floor(1000 * pow(eta * u - eta + 1, 1 / (1 - 0.99::DOUBLE))), 999) END::BIGINT AS rank, count(*) AS n
FROM e GROUP BY 1""")
def zipf_counts(spark, sf_dir):
    draws = workload.counter(spark, 20_000).withColumn("u", workload.uniform_of(F.col("i")))
    rank = workload.zipfian(F.col("u"), 1000, workload.zeta(spark, 1000))
    return draws.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"))


_FNV = """(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, 8), lambda i: ((k >> (8 * i)::INT) & 255)::HUGEINT)),
  lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT))"""


@query(f"SELECT (1000 + {_FNV} % 500)::BIGINT AS key, count(*) AS n FROM (SELECT o_custkey AS k FROM orders) GROUP BY 1")
def scrambled_keys(spark, sf_dir):
    key = workload.scrambled(F.col("o_custkey"), 500, 1000)
    return tables.table(spark, sf_dir, "orders").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, 20000 - o_custkey AS newest FROM orders WHERE 20000 - o_custkey <= 19000")
def latest_keys(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", workload.latest(F.col("o_custkey"), 20_000).alias("newest"))
    return workload.not_beyond(rows, F.lit(19_000), "newest")


@query(f"SELECT (5 + floor({_U} * 16))::BIGINT AS length, count(*) AS n FROM orders GROUP BY 1")
def uniform_lengths(spark, sf_dir):
    length = workload.uniform(workload.uniform_of(F.col("o_orderkey")), 5, 20)
    return tables.table(spark, sf_dir, "orders").groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH o AS (SELECT o_orderkey AS i, o_custkey AS key, CASE WHEN {_U} < 0.5 THEN 'read' WHEN {_U} < 0.7 THEN 'update' WHEN {_U} < 0.8 THEN 'insert' ELSE 'rmw' END AS op FROM orders),
s AS (SELECT p_partkey AS key, 'brand ' || p_brand || ' size ' || p_size || ' type ' || p_type AS r, p_brand, p_type FROM part)
SELECT i, op, o.key, s.key IS NOT NULL AS key_found, CASE WHEN op IN ('read', 'rmw') THEN r END AS was,
  CASE op WHEN 'insert' THEN 'size ' || i WHEN 'update' THEN CASE WHEN s.key IS NOT NULL THEN 'brand ' || p_brand || ' size ' || i || ' type ' || p_type END
    WHEN 'rmw' THEN CASE WHEN s.key IS NOT NULL THEN 'brand ' || p_brand || ' size ' || i || ' type ' || p_type END END AS becomes
FROM o LEFT JOIN s USING (key)""")
def workload_dispatch(spark, sf_dir):
    """Every order an operation on the part of its customer's number: what it read, and what it writes."""
    op = workload.discrete(workload.uniform_of(F.col("o_orderkey")), [("read", 50), ("update", 20), ("insert", 10), ("rmw", 20)])
    ops = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), op.alias("op"), F.col("o_custkey").alias("key"), F.create_map(F.lit("size"), F.col("o_orderkey").cast("string")).alias("fields"))
    state = _part_text(spark, sf_dir).select("key", records.to_map(F.col("value")).alias("record"))
    done = workload.dispatch(state, ops)
    text = lambda c: F.when(F.col(c).isNotNull(), records.to_text(F.col(c))).alias(c)
    return done.select("i", "op", "key", "key_found", text("was"), text("becomes"))


# ---- streams ---------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{where.rstrip('/')}/streams-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)  # read until then
    return path.toString()


@query("""WITH r AS (SELECT event_id % 8 AS region, event_id // 8 AS lsn, user_id::VARCHAR AS key, value,
  CASE WHEN event_type IN ('signup', 'click') THEN 'put' WHEN event_type = 'error' THEN 'delete' ELSE 'put_if_exists' END AS op FROM events)
SELECT * FROM r QUALIFY lsn = row_number() OVER (PARTITION BY region ORDER BY lsn) - 1""")
def lsn_reorder_stream(spark, sf_dir):
    """Eight regions' logs, written in scrambled order, read as a stream and put back in lsn order."""
    folder = _scratch(spark)
    rows = tables.mutation_log(spark, sf_dir).select((F.col("lsn") % 8).alias("region"), F.floor(F.col("lsn") / 8).alias("lsn"), "key", "op", "value")
    rows.repartition(6, F.xxhash64("region", "lsn")).write.parquet(f"{folder}/in")
    stream = streams.read_files(spark, f"{folder}/in", streams.LOG, per_trigger=2)
    return streams.drain(streams.in_order(stream, stalled_ms=None), f"{folder}/out", f"{folder}/state")


@query("""WITH g AS (SELECT user_id::VARCHAR AS server, ts, coalesce((ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR)::INT, 0) AS new FROM events),
s AS (SELECT server, ts, sum(new) OVER (PARTITION BY server ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT server, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS failed_at, count(*) AS beats FROM s GROUP BY server, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
def session_failure(spark, sf_dir):
    """Sessions of each user's events as heartbeats, closed by a gap of six hours; one batch of many files, so none is late."""
    folder = _scratch(spark)
    beats = tables.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("server"), F.col("ts").cast("timestamp").alias("ts"))
    beats.write.parquet(f"{folder}/in")
    stream = streams.read_files(spark, f"{folder}/in", "server string, ts timestamp", per_trigger=1_000_000)
    done = streams.drain(streams.failures(stream, "6 hours"), f"{folder}/out", f"{folder}/state")
    return done.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("failed_at", F.col("failed_at").cast("timestamp_ntz"))
