"""Streams of mutations, operations and heartbeats.  Survey ids: X2, X3, X5, X11-X13, V1, V2."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stats import tumbling_rates

LOG = "region long, lsn long, key string, op string, value double"
STALLED_MS = 600_000
#: Numbers of one stretch of a region's log, and bytes of records that a task packs together.
STRETCH = 1 << 16
TOGETHER_BYTES = 64 << 20
#: The state store that Spark's stateful processors need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, schema: str, name: str = "*", per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream; ``per_trigger`` bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name).parquet(path)


def in_order(log: DataFrame, first: int = 0, stalled_ms: int | None = STALLED_MS) -> DataFrame:
    """Each region's records in lsn order: one is passed on only when its lsn is next.

    A region's log is cut into stretches of ``STRETCH`` numbers.  Records that came early wait
    in the state of their stretch, so no task holds more of a region than one stretch; the
    region's own state, its clock, has one bit for each record of stretches that are not
    passed on whole, and says how far each stretch may go.  What a batch passes on of a region
    is one unbroken run: in order inside a stretch, whose rows stand together, while several
    stretches may be several tasks'.  Records without region or lsn have no place and go.

    A region that waits for ``stalled_ms`` without any record gives up the gap and goes on with
    the least it has (X12), so a lost record does not hold state for ever.  Such timers keep a
    query running; None does without them, as a query over what is there now must.
    """

    def clock(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waits, stretches, bits = state.get if state.exists else (first, [], [])
        seen = dict(zip(stretches, map(bytes, bits)))
        parts: dict[int, tuple[int, int]] = {}
        if state.hasTimedOut:
            at = min(seen)
            waits = max(waits, at * STRETCH + int(np.flatnonzero(_bits(seen[at]))[0]))
        else:
            for rows in batches:
                for at, more in zip(rows["stretch"].tolist(), rows["bits"]):
                    if at < waits // STRETCH:  # what comes late to a stretch that was passed goes
                        parts[at] = ((at + 1) * STRETCH, (at + 1) * STRETCH)
                    else:
                        seen[at] = zlib.compress(np.packbits(_bits(seen[at]) | _bits(more)), 1) if at in seen else bytes(more)
        while (at := waits // STRETCH) in seen:
            own, begin = _bits(seen[at]), waits - at * STRETCH
            gap = np.flatnonzero(own[begin:] == 0)
            end = begin + int(gap[0]) if len(gap) else STRETCH
            waits = at * STRETCH + end
            parts[at] = (at * STRETCH + begin, waits)
            own[:end] = 0
            if own.any():
                seen[at] = zlib.compress(np.packbits(own), 1)
            else:
                del seen[at]
            if end < STRETCH:
                break
        state.update((waits, list(seen), list(seen.values())))
        if seen and stalled_ms is not None:
            state.setTimeoutDuration(stalled_ms)
        yield pd.DataFrame([(key[0], at, *part) for at, part in parts.items()], columns=["region", "stretch", "start", "upto"])

    timers = GroupStateTimeout.NoTimeout if stalled_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    kept = log.select("region", "lsn", "key", "op", "value").where("region is not null and lsn is not null")
    # Both readers below take all columns, so Spark reads the stream and deals it out once.
    dealt = kept.mapInArrow(_by_stretch, "region long, stretch long, records binary").repartition("region", "stretch")
    marks = dealt.mapInArrow(_marks, "region long, stretch long, bits binary")
    parts = marks.groupBy("region").applyInPandasWithState(
        clock, "region long, stretch long, start long, upto long", "waits long, stretches array<long>, bits array<binary>", "append", timers
    )
    none = F.lit(0).cast("long")
    both = dealt.select("region", "stretch", "records", none.alias("start"), none.alias("upto")).union(
        parts.select("region", "stretch", F.lit(None).cast("binary").alias("records"), "start", "upto")
    )
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    done = both.groupBy("region", "stretch").transformWithStateInPandas(_Hold(), "region long, records binary", "append", "None")
    return done.mapInArrow(_opened, LOG)


class _Hold(StatefulProcessor):
    """Records of one stretch wait here until the region's clock lets them go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stretch", "done long, held binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, held = self.state.get() or (key[1] * STRETCH, None)
        came, start, upto = [held] if held else [], done, done
        for part in rows:
            for records, a, b in zip(part["records"], part["start"].tolist(), part["upto"].tolist()):
                if records is not None:
                    came.append(records)
                else:
                    start, upto = a, b  # one a batch
        if came:
            both = pa.concat_tables(map(_unpacked, came))
            lsn, place = np.unique(both["lsn"].to_numpy(), return_index=True)  # of equal numbers the first stays
            go, stay = (lsn >= max(start, done)) & (lsn < upto), lsn >= max(upto, done)
            held = _packed(both.take(place[stay])) if stay.any() else None
            if go.any():
                yield pd.DataFrame({"region": [key[0]], "records": [_packed(both.take(place[go]))]})
        self.state.update((max(upto, done), held))

    def close(self) -> None:
        pass


def _packed(rows: pa.Table) -> bytes:
    """Records as compressed Arrow: exact values, and little to keep and to send."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(records: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(records))).read_all()


def _bits(packed: bytes) -> np.ndarray:
    """One number, 0 or 1, for each place of a stretch."""
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))


def _by_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records packed by region and stretch, as far as a task has them together."""

    def cut(rows: pa.Table) -> pa.RecordBatch:
        region, lsn = rows["region"].to_numpy(), rows["lsn"].to_numpy()
        order = np.lexsort((lsn // STRETCH, region))
        rows, region, stretch = rows.select(["lsn", "key", "op", "value"]).take(order), region[order], lsn[order] // STRETCH
        first = np.flatnonzero((np.diff(region, prepend=region[0]) != 0) | (np.diff(stretch, prepend=stretch[0] - 1) != 0))
        rows = rows.combine_chunks()
        records = [_packed(rows.slice(a, b - a)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)])]
        return pa.RecordBatch.from_arrays([pa.array(region[first]), pa.array(stretch[first]), pa.array(records, pa.binary())], names=["region", "stretch", "records"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > TOGETHER_BYTES:
            yield cut(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield cut(pa.Table.from_batches(held))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which places of their stretch packed records have."""
    for batch in batches:
        bits = []
        for stretch, records in zip(batch["stretch"].to_pylist(), batch["records"].to_pylist()):
            own = np.zeros(STRETCH, np.uint8)
            own[_unpacked(records)["lsn"].to_numpy() - stretch * STRETCH] = 1
            bits.append(zlib.compress(np.packbits(own), 1))
        yield pa.RecordBatch.from_arrays([batch["region"], batch["stretch"], pa.array(bits, pa.binary())], names=["region", "stretch", "bits"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of packed stretches as rows."""
    for batch in batches:
        for region, records in zip(batch["region"].to_pylist(), batch["records"].to_pylist()):
            for rows in _unpacked(records).to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), region, np.int64)), *rows.columns], names=["region", *rows.schema.names])


def failures(heartbeats: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of each server: it counts as failed once silent for the gap (X11)."""
    w = F.session_window("ts", gap)
    return heartbeats.withWatermark("ts", late).groupBy(w, "server").agg(F.count(F.lit(1)).alias("beats")).select("server", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("failed_at"), "beats")


def rates(ops: DataFrame, width: str = "5 seconds", seconds: float = 5.0, late: str = "10 seconds") -> DataFrame:
    """Operations a second in tumbling windows."""
    return tumbling_rates(ops.withWatermark("ts", late), width, seconds)


def replicate(log: DataFrame, backups: list[str], checkpoint: str, done: Callable[[int], None] | None = None) -> StreamingQuery:
    """Every batch written to each backup's folder; a batch's folder is overwritten when it is retried."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        for path in backups:
            df.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        df.unpersist()
        if done is not None:
            done(epoch)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """What a query's batches read, kept for the one who asks: the callbacks of a replica (V2)."""

    def __init__(self) -> None:
        self.started, self.rows, self.ended = 0, 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.started += 1

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended += 1


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and give what it wrote."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
