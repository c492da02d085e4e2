"""Text sources, statistics, workloads and streams."""

import time

from pyspark.sql import functions as F

from keyloom.operators import log, stats, workload
from keyloom.sources import tables, text
from keyloom.streaming import logs as streams

from .conftest import DATA


def write(path, body):
    path.write_text(body)
    return str(path)


def test_metadata_files(spark, tmp_path):
    hosts = text.hosts_file(spark, write(tmp_path / "h", "# c\n\nh1:80:1 leader\nh2:81:2\n")).collect()
    assert [(r.server, r.epoch, r.leader) for r in hosts] == [("h1:80", 1, True), ("h2:81", 2, False)]
    regions = text.regions_file(spark, write(tmp_path / "r", "0 -oo AA h1:80 h2:81\n1 AA +oo h2:81\nbad\n")).collect()
    assert [(r.id, r.primary, r.backups) for r in regions] == [("0", "h1:80", ["h2:81"]), ("1", "h2:81", [])]
    props = {r.key: r.value for r in text.properties(spark, write(tmp_path / "p", "# x\n a = 1 \nb=2=3\na=4\n")).collect()}
    assert props == {"a": "4", "b": "2=3"}
    plan = text.execution_plan(spark, write(tmp_path / "e", "load_a load wa\nrun_a run wa\nx skip y\n")).collect()
    assert [(r.name, r.phase) for r in plan] == [("load_a", "load"), ("run_a", "run")]


def test_json_documents(spark):
    df = spark.createDataFrame([('{"id":"7","min_key":"-oo","max_key":"AA","primary":"h","backups":["x"],"status":0}',)], "value string")
    assert text.region_json(df).first().backups == ["x"]
    df = spark.createDataFrame([('{"hostname":"h","RDMA_IP_addr":"1.2.3.4","epoch":3}',), ('{"hostname":"g","rdma_ip_addr":"5"}',)], "value string")
    assert [r.rdma_ip_addr for r in text.server_json(df).collect()] == ["1.2.3.4", "5"]


def test_monitor_files(spark, tmp_path):
    body = "12:00:01 all 10,5 0 2.0 3.0 0 0 0 0 0 84.5\n12:00:01 0 1 0 2 3 0 0 0 0 0 94\nAverage: all 9 9 9 9 9 9 9 9 9 9\n"
    use = stats.cpu_use(text.mpstat(spark, write(tmp_path / "m", body))).first()
    assert (use.usr, use.sys, use.iowait, use.idle) == (10.5, 2.0, 3.0, 84.5)
    a = text.diskstats(spark, write(tmp_path / "d0", " 8 0 sda 1 0 100 0 1 0 200 0\n"))
    b = text.diskstats(spark, write(tmp_path / "d1", " 8 0 sda 1 0 2148 0 1 0 4296 0\n"))
    moved = stats.disk_traffic(a, b).first()
    assert (moved.read_mb, moved.write_mb) == (1.0, 2.0)
    n0, n1 = (text.counters(spark, write(tmp_path / f"c{k}", f"x\ntx_bytes: {v}\nrx: a\n")) for k, v in ((0, 5), (1, 25)))
    assert stats.counter_delta(n0, n1, 10.0).first().rate == 2.0
    ops = text.throughput_log(spark, write(tmp_path / "o", "1.0 sec 500 operations; 500.5 current ops/sec\nend\n")).first()
    assert (ops.sec, ops.operations, ops.ops_per_sec) == (1.0, 500, 500.5)
    again = spark.createDataFrame([(1.0, 500, 500.5), (2.5, 7, 0.0), (60.0, 10**9, 123456.25)], "sec double, operations long, ops_per_sec double")
    text.write_throughput_log(again, str(tmp_path / "w"))
    assert {tuple(r) for r in text.throughput_log(spark, str(tmp_path / "w")).collect()} == {tuple(r) for r in again.collect()}


def test_iostat(spark, tmp_path):
    body = "Linux x\n\nDevice  r/s  aqu-sz areq-sz %util\nsda 1,0 2,5 16.0 50,0\nsdb 1 1 8 10\n\nDevice  r/s  aqu-sz areq-sz %util\nsda 1.0 3.5 32.0 70.0\n"
    use = {r.device: r for r in stats.device_use(text.iostat(spark, write(tmp_path / "i", body))).collect()}
    assert (use["sda"].queue_depth, use["sda"].request_size, use["sda"].util) == (3.0, 24.0, 60.0) and use["sdb"].util == 10.0
    assert text.iostat(spark, write(tmp_path / "none", "x\n")).count() == 0


def test_trace_round_trip(spark, tmp_path):
    ops = spark.createDataFrame([("GET", "k1", None), ("PUT", "k2", "a b")], "op string, key string, value string")
    text.write_trace(ops, str(tmp_path / "t"))
    assert {tuple(r) for r in text.trace(spark, str(tmp_path / "t")).collect()} == {("GET", "k1", None), ("PUT", "k2", "a b")}
    text.discard(ops)
    text.write_histogram(ops.select("op"), str(tmp_path / "csv"))


def test_wire_requests(spark):
    get = bytes([1]) + (3).to_bytes(4, "big") + b"abc"
    put = bytes([text.PUT]) + (2).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"kkvvvv"
    df = spark.createDataFrame([(bytearray(get),), (bytearray(put),)], "frame binary").select(text.decode_request(F.col("frame")).alias("r")).select("r.*")
    got = [(r.type, bytes(r.key), r.value and bytes(r.value)) for r in df.collect()]
    assert got == [(1, b"abc", None), (text.PUT, b"kk", b"vvvv")]


def test_percentile_rule(spark):
    one = spark.createDataFrame([("a", 7)], "op string, latency_us long")
    r = stats.summary(stats.histogram(one, ["op"]), ["op"]).first()
    assert (r.p50, r.p99_99, r.max, r.n, r.missing) == (0, 0, 7, 1, 0)
    many = spark.range(1000).select(F.lit("a").alias("op"), F.col("id").alias("latency_us"))
    r = stats.summary(stats.histogram(many, ["op"], most=900), ["op"]).first()
    assert (r.p50, r.p90, r.n, r.missing) == (449, 809, 900, 100)
    assert stats.monitor_samples(spark.createDataFrame([(-5,), (0,)], "latency_us long")).count() == 1
    assert stats.series_sum(*[spark.createDataFrame([(1, v)], "t int, value int") for v in (2, 3)]).first().value == 5


def test_generators(spark):
    rows = workload.counter(spark, 2000).withColumn("u", workload.uniform_of(F.col("i")))
    rank = workload.zipfian(F.col("u"), 100, workload.zeta(spark, 100))
    hits = {r.r: r["count"] for r in rows.select(rank.alias("r")).groupBy("r").count().collect()}
    assert max(hits, key=hits.get) == 0 and min(hits) >= 0 and max(hits) < 100
    spread = rows.select(workload.scrambled(rank, 100).alias("k"), workload.latest(rank, 99).alias("n"), workload.uniform(F.col("u"), 5, 9).alias("x"))
    low = spread.agg(F.min("k"), F.max("k"), F.max("n"), F.min("x"), F.max("x")).first()
    assert low[0] >= 0 and low[1] < 100 and low[2] == 99 and low[3] == 5 and low[4] == 9
    assert workload.split_ops(10, 4) == [2, 2, 2, 4]
    assert workload.scale({"recordcount": "100", "x": "1"}, 4) == {"recordcount": "25", "x": "1"}
    assert spark.range(1).select(workload.record(2, 3)).first()[0] == {"field0": "aaa", "field1": "aaa"}
    assert workload.not_beyond(spark.range(10).withColumnRenamed("id", "draw"), F.lit(4)).count() == 5


def test_reordered_stream_equals_batch(spark, tmp_path):
    whole = tables.mutation_log(spark, DATA)
    rows = whole.select(F.lit(0).cast("long").alias("region"), "lsn", "key", "op", "value")
    rows.repartition(3, F.xxhash64("lsn")).write.parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), streams.LOG, per_trigger=1)
    done = streams.drain(streams.in_order(stream, stalled_ms=None), str(tmp_path / "out"), str(tmp_path / "state"))
    assert done.count() == whole.count()
    mine = {tuple(r) for r in log.current_state(done.select("key", "lsn", "op", "value")).collect()}
    assert mine == {tuple(r) for r in log.current_state(whole).collect()}


def test_held_records_keep_their_values(spark, tmp_path):
    """Records that wait in state come out as they went in: full precision, nulls and NaN apart."""
    values = [0.12345678901234567, 1e-12, None, float("nan"), -0.0, 1e300, 5e-324, 2.0]
    rows = [(0, k, None if k == 3 else f"k{k}", "put", v) for k, v in enumerate(values)]
    for part in (rows[4:], rows[1:4], rows[:1]):  # the first record comes last
        spark.createDataFrame(part, streams.LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), streams.LOG, per_trigger=1)
    done = streams.drain(streams.in_order(stream, stalled_ms=None), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted(map(repr, map(tuple, done))) == sorted(map(repr, rows))


def test_stalled_gap_is_given_up(spark, tmp_path):
    """With timers on, a region that waits too long goes on with the least record it has."""
    spark.createDataFrame([(0, k, "k", "put", 1.0) for k in (0, 1, 3, 4)], streams.LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), streams.LOG)
    progress = streams.Progress()
    spark.streams.addListener(progress)
    query = streams.in_order(stream, stalled_ms=500).writeStream.format("memory").queryName("stalled").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("stalled").count() < 4:
            time.sleep(0.5)
        assert sorted(r.lsn for r in spark.table("stalled").collect()) == [0, 1, 3, 4]
    finally:
        query.stop()
        until = time.time() + 30
        while time.time() < until and not progress.ended:
            time.sleep(0.2)
        spark.streams.removeListener(progress)
    assert progress.started == progress.ended == 1 and progress.rows == 4


def test_stream_of_rates_equals_batch(spark, tmp_path):
    events = tables.table(spark, DATA, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), "event_id long, ts timestamp", per_trigger=1000)
    done = streams.drain(streams.rates(stream, "1 hour", 3600.0, "1 minute"), str(tmp_path / "out"), str(tmp_path / "state"))
    whole = {tuple(r) for r in stats.tumbling_rates(events, "1 hour", 3600.0).collect()}
    mine = {tuple(r) for r in done.collect()}
    assert mine <= whole and len(whole) - len(mine) <= 1  # the last window is still open


def test_replication_stream(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("region"), F.col("id").alias("lsn"), F.lit("k").alias("key"), F.lit("put").alias("op"), F.lit(1.0).alias("value")).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = streams.read_files(spark, str(tmp_path / "in"), streams.LOG)
    streams.replicate(stream, [str(tmp_path / "b1"), str(tmp_path / "b2")], str(tmp_path / "c"), seen.append).awaitTermination()
    assert seen and all(spark.read.parquet(str(tmp_path / b)).count() == 20 for b in ("b1", "b2"))
