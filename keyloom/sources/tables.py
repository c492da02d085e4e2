"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import DELETE, PUT, PUT_IF_EXISTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a mutation log: users are keys, event ids the order."""
    op = F.when(F.col("event_type").isin("signup", "click"), PUT).when(F.col("event_type") == "error", DELETE).otherwise(PUT_IF_EXISTS)
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("lsn"), op.alias("op"), "value")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), "c_custkey", "c_acctbal")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.col("html").alias("value"), "page_id")


def servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as servers: five on a host, host names from the number."""
    host = F.concat(F.lit("host"), F.lpad(F.floor(F.col("s_suppkey") / 5).cast("string"), 6, "0"))
    return table(spark, sf_dir, "supplier").select(F.concat(host, F.lit(":"), (9000 + F.col("s_suppkey") % 5).cast("string")).alias("server"), F.col("s_suppkey").alias("position"), "s_acctbal")


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as latencies of operations by four threads."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("thread"), F.col("event_type").alias("op"), F.floor(F.col("value") * 100).alias("latency_us"))
