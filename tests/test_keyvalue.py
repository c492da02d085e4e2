"""Expectations on stores, scans, logs, routing and records."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import hashing, keys, records
from keyloom.operators import cluster, log, replication, routing, running, scan

LOG = "key string, lsn long, op string, value string"


def replayed(rows):
    """A sequential replay: state, rejected conditional puts, deletes without a key."""
    state, rejected, missing = {}, set(), set()
    for key, lsn, op, value in sorted(rows, key=lambda r: r[1]):
        if op == "put" or (op == "put_if_exists" and key in state):
            state[key] = (lsn, value)
        elif op == "put_if_exists":
            rejected.add(lsn)
        elif key in state:
            del state[key]
        else:
            missing.add(lsn)
    return state, rejected, missing


@pytest.mark.parametrize("seed", range(3))
def test_log_equals_sequential_replay(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"k{rnd.randrange(30)}", i, rnd.choice(["put", "put_if_exists", "delete"]), rnd.choice(["", "x", "yy"])) for i in range(1, 500)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), LOG)
    state, rejected, missing = replayed(rows)
    assert {r.key: (r.lsn, r.value) for r in log.current_state(df).collect()} == state
    assert {r.lsn for r in log.rejected(df).collect()} == rejected
    assert {r.lsn for r in log.missing_deletes(df).collect()} == missing
    assert {r.key for r in log.replay(df).collect()} == set(state)


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame([(f"#b{i}", f"v{i}") for i in range(1000, 2000)], "key string, value string").cache()


def listed(df):
    return [r.key for r in df.collect()]


def test_empty_store(spark):
    empty = spark.createDataFrame([], LOG)
    assert log.current_state(empty).count() == 0 and scan.scan(log.current_state(empty)).count() == 0


def test_scans(store):
    assert listed(scan.scan(store, start="#b1500", limit=3)) == ["#b1500", "#b1501", "#b1502"]
    assert listed(scan.scan(store, start="#b1500", after=True, limit=1)) == ["#b1501"]
    assert listed(scan.scan(store)) == [f"#b{i}" for i in range(1000, 2000)]
    assert scan.scan(store, stop="#b1500").count() == 500
    assert scan.scan(store, stop="+oo").count() == 1000
    assert listed(scan.scan(store, prefix="#b1234")) == ["#b1234"]
    assert scan.scan(store, prefix="#b12", keys_only=True).columns == ["key"]
    assert scan.scan(store, prefix="#b12").count() == 100
    assert [r.key for r in scan.cursor(store, start="#b1998")] == ["#b1998", "#b1999"]


def test_reply_bytes(store):
    got = scan.seek_within_bytes(store, "#b1000", 50, 100).collect()
    assert len(got) == 5 and got[-1].used <= 100  # 6 + 5 + 8 bytes a row


def test_deletes_and_empty_values(spark):
    rows = [(f"u{i:04d}", i + 1, "put", "") for i in range(200)] + [(f"u{i:04d}", 1000 + i, "delete", None) for i in range(1, 200, 2)]
    state = log.current_state(spark.createDataFrame(rows, LOG))
    assert listed(scan.scan(state)) == [f"u{i:04d}" for i in range(0, 200, 2)]
    assert {r.value for r in state.collect()} == {""}
    assert scan.scan(state, prefix="u0001").count() == 0


def test_store_survives_reopening(spark, store, tmp_path):
    from keyloom.sources import text

    regions = spark.createDataFrame([("0", "-oo", "#b1300"), ("1", "#b1300", "+oo")], "id string, min_key string, max_key string")
    text.write_store(routing.route(store, regions), str(tmp_path / "s"))
    again = text.open_store(spark, str(tmp_path / "s"))
    assert again.where("region = 0").count() == 300 and again.count() == 1000


def test_gets(spark, store):
    asked = spark.createDataFrame([("#b1001",), ("nope",)], "key string")
    got = {r.key: r for r in scan.get_many(store, asked, offset=1, size=2).collect()}
    assert got["#b1001"].value == "10" and got["#b1001"].bytes_remaining == 2 and got["#b1001"].key_found
    assert not got["nope"].key_found and got["nope"].value is None
    assert [r.key for r in scan.exists(store, asked).collect()] == ["#b1001"]
    wide = {r.key: r for r in scan.get_many(store, asked, offset=9).collect()}
    assert wide["#b1001"].offset_too_large


def test_slices_sum_to_the_value(spark):
    row = spark.range(1).select(F.lit("0123456789").alias("v"))
    parts = [keys.value_slice(F.col("v"), k, 3) for k in range(0, 10, 3)]
    assert row.select(F.concat(*parts)).first()[0] == "0123456789"
    assert row.select(keys.put_at(F.col("v"), F.lit("ab"), 4)).first()[0] == "0123ab6789"


def test_djb2_and_fnv(spark):
    def djb2(data):
        h = 5381
        for b in data:
            h = (h * 33 + b) % 2**64
        return h

    def fnv(n):
        h = 0xCBF29CE484222325
        for k in range(8):
            h = ((h ^ (n >> 8 * k & 255)) * 0x100000001B3) % 2**64
        return h

    texts = ["", "a", "user6284781860667377211", "é漢😀", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.unsigned(hashing.djb2(F.col("t"))).alias("h"), hashing.modulo(hashing.djb2(F.col("t")), 7).alias("m"))
    for r in df.collect():
        assert int(r.h) == djb2(r.t.encode()) and r.m == djb2(r.t.encode()) % 7
    numbers = [0, 1, 255, 256, 10**12, -1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", hashing.unsigned(hashing.fnv64(F.col("n"))).alias("h"))
    for r in df.collect():
        assert int(r.h) == fnv(r.n % 2**64)


def test_small_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(hashing.next_letters(F.lit("AAAZ"), 4)) == "AABA" and get(hashing.next_letters(F.lit("ZZ"), 2)) == "AA"
    assert [get(keys.compare(F.lit(a), F.lit(b))) for a, b in (("a", "b"), ("b", "a"), ("a", "a"), ("a", "ab"))] == [1, -1, 0, 1]
    assert get(keys.host_of(F.lit("h1:80:3"))) == "h1:80" and get(keys.padding(F.lit(130), 64)) == 62
    assert get(keys.parse_bool(F.lit(" TRUE "))) is True and get(keys.parse_bool(F.lit("maybe"))) is None
    assert get(keys.is_subnet(F.lit("192.168.4."))) and not get(keys.is_subnet(F.lit("300.1")))
    assert get(keys.joined(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "ab"


def test_routing(spark):
    regions = spark.createDataFrame([(0, "-oo", "b"), (1, "b", "d"), (3, "f", "+oo")], "id int, min_key string, max_key string")
    asked = spark.createDataFrame([(k,) for k in ["", "a", "b", "c", "d", "e", "f", "z", "+oo"]], "key string")
    got = {r.key: r.region for r in routing.route(asked, regions).collect()}
    assert got == {"": 0, "a": 0, "b": 1, "c": 1, "d": None, "e": None, "f": 3, "z": 3, "+oo": 0}
    many = spark.createDataFrame([(k, f"{k:04d}" if k else "-oo", f"{k + 1:04d}" if k < 499 else "+oo") for k in range(500)], "id int, min_key string, max_key string")
    keys_ = spark.range(0, 9999, 7).select(F.format_string("%05d", "id").substr(1, 4).alias("key"))
    wide = {r.key: r.region for r in routing.route(keys_, many).collect()}
    most, routing.MOST_REGIONS = routing.MOST_REGIONS, 1
    try:
        assert {r.key: r.region for r in routing.route(asked, regions).collect()} == got
        routing.MOST_REGIONS = 20
        plan = routing.route(keys_, many)
        assert {r.key: r.region for r in plan.collect()} == wide and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        routing.MOST_REGIONS = most


@pytest.mark.parametrize("stretch", [1, 7, 1 << 16])
def test_running_equals_one_window(spark, stretch):
    rnd = random.Random(stretch)
    rows = [(rnd.choice(["a", "b", None]), k, rnd.randrange(10), rnd.choice(["x", "y", None])) for k in range(300)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "g string, k long, v long, s string")
    done = running.last_before(running.sum_before(df, ["g"], "k", F.col("v"), "sum", stretch), ["g"], "k", F.col("s"), "last", stretch)
    sums, last, want = {}, {}, {}
    for g, k, v, s in rows:
        want[k] = (sums.get(g, 0), last.get(g))
        sums[g] = sums.get(g, 0) + v
        last[g] = s or last.get(g)
    assert {r.k: (r["sum"], r["last"]) for r in done.collect()} == want


def test_picks_equal_sorting(spark):
    rnd = random.Random(2)
    groups = {"ties": [1.0] * 500 + [2.0] * 3, "many": [rnd.random() for _ in range(5000)], "one": [7.0], None: [float(k % 10) for k in range(99)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("many", None)], "g string, v double")
    got = {r.g: (r.a, r.z) for r in running.picks(df, ["g"], "v", {"a": F.floor(F.col("size") / 2), "z": F.floor(F.col("size") * 99 / 100)}, 10).collect()}
    assert got == {g: (sorted(vs)[len(vs) // 2], sorted(vs)[len(vs) * 99 // 100]) for g, vs in groups.items()}


def test_assign_looks_as_far_as_it_must(spark):
    hosts = ["a"] * 30 + ["b"] + ["c"] * 5 + ["d", "a"]
    servers = spark.createDataFrame([(k, f"{h}:{k}") for k, h in enumerate(hosts)], "position long, server string")
    got = {}
    for r in cluster.assign(spark.range(80), servers, 2).collect():
        got.setdefault(r.id, []).append((r.place, r.server))
    for i in range(80):
        seen = {}
        for j in range(len(hosts)):
            p = (i + j) % len(hosts)
            seen.setdefault(hosts[p], f"{hosts[p]}:{p}")
        assert sorted(got[i]) == list(enumerate(list(seen.values())[:3]))
    assert cluster.assign(spark.range(3), servers.limit(0), 2).count() == 0


def test_records(spark):
    row = spark.range(1).select(records.to_map(F.lit("field0 aa field1 bb")).alias("r"))
    assert row.select(records.to_text(records.merge(F.col("r"), F.create_map(F.lit("field1"), F.lit("z"))))).first()[0] == "field0 aa field1 z"
    assert row.select(records.unknown_fields(F.col("r"), F.create_map(F.lit("q"), F.lit("z")))).first()[0] == ["q"]


def test_contiguous(spark):
    ack = lambda xs: replication.contiguous(spark.createDataFrame([(x,) for x in xs], "seq long")).first()[0]
    assert ack([0, 1, 2, 5, 6]) == 2 and ack([3, 4]) == -1 and ack([]) == -1 and ack([1, 0, 0, 2]) == 2


def test_translate_and_replay_agree(spark):
    """Shipping an index and rebuilding it give the same state."""
    rows = [(f"k{i % 20}", i, "put", str(i)) for i in range(1, 200)]
    primary = spark.createDataFrame(rows, LOG).withColumn("offset", F.col("lsn") * 40)
    segments = primary.select(keys.segment_start(F.col("offset"), 512).alias("segment")).distinct().withColumn("new_segment", F.col("segment") + 8192)
    moved = replication.translate(log.current_state(primary).join(primary.select("key", "lsn", "offset"), ["key", "lsn"]), segments, 512)
    rebuilt = log.replay(primary)
    assert {(r.key, r.value) for r in moved.collect()} == {(r.key, r.value) for r in rebuilt.collect()}
    assert all(r.new_offset == r.offset + 8192 for r in moved.collect())


def test_every_region_has_its_replicas_after_failures(spark):
    servers = spark.createDataFrame([(i, f"h{i // 2}:{i % 2}") for i in range(12)], "position long, server string")
    replicas = cluster.assign(cluster.layout(spark, 9).select("id"), servers, 2).cache()
    assert replicas.count() == 27
    alive = servers.where("position not in (0, 1, 5)").select("server")
    fixed = cluster.reassign(replicas, alive, 3)
    assert cluster.under_replicated(fixed, alive, 3).count() == 0
    hosts = fixed.select("id", keys.host_of(F.col("server")).alias("h")).distinct()
    assert hosts.count() == 27 and fixed.where("place = 0").count() == 9
    assert cluster.next_clock(spark.createDataFrame([(4,)], "clock long")).first()[0] == 5
    assert cluster.can_boot(alive, 9).first()[0] and not cluster.can_boot(alive, 10).first()[0]


def test_random_layout_covers_the_key_space(spark):
    rows = cluster.random_layout(spark, 12, 3).orderBy("id").collect()
    assert len(rows) == 12 and rows[0].min_key == "-oo" and rows[-1].max_key == "+oo"
    assert all(a.max_key == b.min_key and (a.min_key == "-oo" or a.min_key < b.min_key) for a, b in zip(rows, rows[1:]))
