"""Text and wire formats as DataFrames, and sinks.  Survey ids: C1-C11, D8, D9, D16-D18, F8, H13, X15."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("min_key", T.StringType()), T.StructField("max_key", T.StringType()),
    T.StructField("primary", T.StringType()), T.StructField("backups", T.ArrayType(T.StringType())), T.StructField("status", T.IntegerType()),
])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines without comments and blanks (F8)."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def _words(df: DataFrame, least: int = 1) -> DataFrame:
    return df.select(F.split("value", r"\s+").alias("w")).where(F.size("w") >= least)


def hosts_file(spark: SparkSession, path: str) -> DataFrame:
    """``host:port:epoch [leader]`` lines (FX7, C6)."""
    w = _words(lines(spark, path))
    epoch = F.element_at(F.split(F.col("w")[0], ":"), -1).cast("long")
    return w.select(F.regexp_replace(F.col("w")[0], ":[^:]*$", "").alias("server"), epoch.alias("epoch"), (F.get("w", F.lit(1)) == "leader").alias("leader")).fillna({"leader": False})


def regions_file(spark: SparkSession, path: str) -> DataFrame:
    """``id min_key max_key primary [backup...]`` lines; shorter ones are skipped (FX8, C6)."""
    w = _words(lines(spark, path), 4)
    return w.select(F.col("w")[0].alias("id"), F.col("w")[1].alias("min_key"), F.col("w")[2].alias("max_key"), F.col("w")[3].alias("primary"), F.slice("w", 5, F.size("w")).alias("backups"))


def region_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Region documents."""
    return df.select(F.from_json(column, REGION).alias("r")).select("r.*")


def server_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Server documents under either spelling of the address field."""
    field = lambda *names: F.coalesce(*[F.get_json_object(column, f"$.{n}") for n in names])
    return df.select(
        field("hostname").alias("hostname"), field("dataserver_name").alias("dataserver_name"), field("rdma_ip_addr", "RDMA_IP_addr").alias("rdma_ip_addr"),
        field("epoch").cast("long").alias("epoch"), field("leader").alias("leader"),
    )


def properties(spark: SparkSession, path: str) -> DataFrame:
    """``key=value`` lines, trimmed; the last of a repeated key counts (D17, FX10)."""
    parts = F.split("value", "=", 2)
    rows = lines(spark, path).withColumn("n", F.monotonically_increasing_id()).where("contains(value, '=')")
    rows = rows.select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"), "n")
    return rows.groupBy("key").agg(F.max(F.struct("n", "value"))["value"].alias("value"))


def execution_plan(spark: SparkSession, path: str) -> DataFrame:
    """``name load|run file`` lines."""
    w = _words(lines(spark, path), 3)
    return w.select(F.col("w")[0].alias("name"), F.col("w")[1].alias("phase"), F.col("w")[2].alias("file")).where("phase in ('load', 'run')")


def throughput_log(spark: SparkSession, path: str) -> DataFrame:
    """Interval lines ``<sec> sec <n> operations; <rate> current ops/sec`` (FX11, A11)."""
    number = lambda pattern: F.regexp_extract("value", pattern, 1)
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*[0-9.]+ sec"))
    return rows.select(number(r"^\s*([0-9.]+) sec").cast("double").alias("sec"), number(r"([0-9]+) operations").cast("long").alias("operations"), F.try_to_number(number(r"([0-9.]+) (?:current )?ops/sec"), F.lit("999999999999.99999")).cast("double").alias("ops_per_sec"))


def write_throughput_log(samples: DataFrame, path: str) -> None:
    """Interval lines of (sec, operations, ops_per_sec), as ``throughput_log`` reads them."""
    line = F.concat(F.col("sec").cast("string"), F.lit(" sec "), F.col("operations").cast("string"), F.lit(" operations; "), F.col("ops_per_sec").cast("decimal(20,4)").cast("string"), F.lit(" current ops/sec"))
    samples.select(line.alias("value")).write.mode("overwrite").text(path)


def mpstat(spark: SparkSession, path: str) -> DataFrame:
    """CPU samples of twelve-column mpstat output, decimal commas read as points, averages left out."""
    w = _words(lines(spark, path).where("not startswith(value, 'Average')"), 12).where("array_contains(w, 'all')")
    at = F.array_position("w", "all").cast("int")
    value = lambda k: F.regexp_replace(F.get("w", at - 1 + k), ",", ".").cast("double")
    return w.select(F.lit("all").alias("cpu"), value(1).alias("usr"), value(3).alias("sys"), value(4).alias("iowait"), value(10).alias("idle"))


def diskstats(spark: SparkSession, path: str) -> DataFrame:
    """Device counters: sectors read and written (C10, FX14)."""
    w = _words(spark.read.text(path).select(F.trim("value").alias("value")), 10)
    return w.select(F.col("w")[2].alias("device"), F.col("w")[5].cast("long").alias("read_sectors"), F.col("w")[9].cast("long").alias("write_sectors"))


def iostat(spark: SparkSession, path: str) -> DataFrame:
    """Device samples of extended iostat output, decimal commas read as points.

    Columns are found by the header's names, which differ between versions.
    """
    rows = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    header = rows.where("value rlike '^Device'").first()
    if header is None:
        return spark.createDataFrame([], "device string, queue_depth double, request_size double, util double")
    names = header[0].split()
    w = rows.where("not value rlike '^Device'").select(F.split("value", r"\s+").alias("w")).where(F.size("w") == len(names))
    value = lambda *wanted: F.try_element_at("w", F.lit(next((names.index(n) for n in wanted if n in names), len(names)) + 1))
    number = lambda *wanted: F.regexp_replace(value(*wanted), ",", ".").try_cast("double")
    parsed = w.select(F.col("w")[0].alias("device"), number("aqu-sz", "avgqu-sz").alias("queue_depth"), number("avgrq-sz", "areq-sz").alias("request_size"), number("%util").alias("util"))
    return parsed.where("util is not null")


def counters(spark: SparkSession, path: str) -> DataFrame:
    """``key: value`` counters (FX13, N2)."""
    parts = F.split("value", ":")
    rows = spark.read.text(path).where("contains(value, ':')")
    return rows.select(F.trim(parts[0]).alias("key"), F.expr("try_cast(trim(split(value, ':')[1]) as bigint)").alias("value")).where("value is not null")


def trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines ``GET n key`` and ``PUT n key n value``."""
    pattern = r"^(GET|PUT) [0-9]+ (\S+)(?: [0-9]+ (.*))?$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(part(1).alias("op"), part(2).alias("key"), F.when(part(1) == "PUT", part(3)).alias("value"))


def write_trace(ops: DataFrame, path: str) -> None:
    """Operations (op, key, value) as trace lines."""
    n = lambda c: F.octet_length(c).cast("string")
    line = F.when(F.col("op") == "PUT", F.concat_ws(" ", F.lit("PUT"), n("key"), "key", n("value"), "value")).otherwise(F.concat_ws(" ", F.lit("GET"), n("key"), "key"))
    ops.select(line.alias("value")).write.mode("overwrite").text(path)


def write_histogram(hist: DataFrame, path: str) -> None:
    """A latency histogram as CSV."""
    hist.write.mode("overwrite").option("header", True).csv(path)


def discard(df: DataFrame) -> None:
    """Run a plan and keep nothing (C11)."""
    df.write.format("noop").mode("overwrite").save()


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """A store's rows; one partition folder per region, so a routed read touches one."""
    return spark.read.parquet(path)


def write_store(state: DataFrame, path: str) -> None:
    """A routed state as Parquet, sorted by key within each region's folder, so key bounds skip row groups."""
    state.repartitionByRange("region", "key").sortWithinPartitions("region", "key").write.mode("overwrite").partitionBy("region").parquet(path)


def decode_request(frame: Column) -> Column:
    """A wire request: type byte, key length, then - for a put - value length, key and value (C4)."""
    number = lambda a: F.conv(F.hex(F.substring(frame, a, 4)), 16, 10).cast("int")
    kind = F.conv(F.hex(F.substring(frame, 1, 1)), 16, 10).cast("int")
    has_value = kind.isin(PUT, PUT_IF_EXISTS)
    key = F.when(has_value, F.substring(frame, F.lit(10), number(2))).otherwise(F.substring(frame, F.lit(6), number(2)))
    value = F.when(has_value, F.substring(frame, 10 + number(2), number(6)))
    return F.struct(kind.alias("type"), key.alias("key"), value.alias("value"))


# The request types of the wire protocol that carry a value.
PUT, PUT_IF_EXISTS = 3, 4
