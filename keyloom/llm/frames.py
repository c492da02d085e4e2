"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a temporary folder is made.
    """
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if where.isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            path = tempfile.mkdtemp(prefix="keyloom-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        sc.setCheckpointDir(path)
        where = sc._jsc.sc().getCheckpointDir()
        remove_at_exit(spark, where.get())
    return where.get()


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder of the shared store removed when the driver ends; results may be read from it until then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Have shuffle files and checkpoints that nothing refers to any more removed now.

    Spark's cleaner follows the driver's garbage collector, which it starts itself only
    every half an hour; jobs of many steps would keep all of their intermediates until then.
    """
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: Rows and bytes of an Arrow batch, where the session leaves Spark's defaults: batches hold whole texts, and a longer one stands alone.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20
_BATCH = [("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES)]

_held: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task, such as a memo: one at a time, by key."""
    if key not in _held:
        _let_go()
        trim()
        _held[key] = make()
    return _held[key]


def _let_go() -> None:
    if _held:
        _held.clear()
        gc.enable()
        gc.collect()


def trim() -> None:
    """Give what a Python worker has freed back to the system: workers wait for the next task with what they kept."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, holds: bool = False) -> DataFrame:
    """``mapInArrow`` with a function of one batch.

    Workers are used again by other operators, so what one holds goes unless this one ``holds``, too.
    """
    conf = df.sparkSession.conf
    for name, default, most in _BATCH:
        if conf.get(name) == default:
            conf.set(name, str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            _let_go()
        trim()  # grouped functions leave what they freed
        for batch in batches:
            if batch.num_rows:
                yield from rows(batch)
                if holds:  # what it holds grows between what each batch frees
                    trim()
        trim()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
