import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def same(df, duck, sql):
    """Whether a Spark and a DuckDB result hold the same rows under the same names."""
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(str(v) for v in r)) for r in df.select(*cols).toPandas().astype(object).itertuples(index=False))
    other = duck.sql(sql).df()
    assert sorted(other.columns) == cols
    theirs = sorted(repr(tuple(str(v) for v in r)) for r in other[cols].astype(object).itertuples(index=False))
    return mine == theirs
