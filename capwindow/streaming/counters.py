"""The counter fold over streams: one value state a counter, with event-time timers that collect lapsed counters.

Within a micro-batch rows are ordered by number; between batches order is arrival, so files of a log come in the log's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from capwindow.schema import EXPIRY_GRACE, OPS, RESULTS

STATE = "value bigint, t bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CounterProcessor(StatefulProcessor):
    """Emits each operation with its result. With timers, a counter goes once the watermark passes its window's end and the grace."""

    def __init__(self, collect: bool):
        self.collect = collect

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counter", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, bs = key[0], int(key[1])
        batch = pd.concat(list(rows)).sort_values(["lsn", "pos"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        value, last = (int(held[0]), int(held[1])) if held else (0, None)
        results = []
        for op, t in zip(batch["op"], batch["t"]):
            if op == "DEL":
                results.append(int(last is not None))
                value, last = 0, None
                continue
            value = 1 if last is None or last < t - t % bs else value + 1
            last = int(t)
            results.append(value)
        if last is None:
            self.state.clear()
        else:
            self.state.update((value, last))
            if self.collect:
                for due in list(self.handle.listTimers()):
                    self.handle.deleteTimer(due)
                self.handle.registerTimer((last - last % bs + bs - 1 + EXPIRY_GRACE + 1) * 1000)
        out = batch[["lsn", "pos", "op", "t"]].assign(key=name, bs=bs, result=results)
        yield out[["lsn", "pos", "op", "key", "bs", "t", "result"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"lsn": [], "pos": [], "op": [], "key": [], "bs": [], "t": [], "result": []}).astype(
            {"lsn": "int64", "pos": "int32", "op": "object", "key": "object", "bs": "int64", "t": "int64", "result": "int64"}
        )

    def close(self) -> None:
        pass


def fold_stream(ops: DataFrame, collect: bool = False, watermark: str = "0 seconds") -> DataFrame:
    """A stream of operations with their results. With collect=True lapsed counters leave the state by event time."""
    ops.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if collect:
        ops = ops.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", watermark)
    keyed = ops.groupBy("key", "bs")
    return keyed.transformWithStateInPandas(CounterProcessor(collect), outputStructType=RESULTS, outputMode="Append", timeMode="EventTime" if collect else "None")


def follow_log(spark: SparkSession, path: str, applied: int) -> DataFrame:
    """A replica's stream of the operations after the high-water mark from a log folder that grows. The checkpoint remembers
    which files were read; a segment that is written again under another name repeats numbers, which the replica's sink drops by pending()."""
    return spark.readStream.schema(OPS).option("recursiveFileLookup", "true").parquet(path).where(F.col("lsn") > applied)


def window_stream(ops: DataFrame, bs: int, watermark: str) -> DataFrame:
    """Counts by event time of one window length; a single watermark suits a single length."""
    timed = ops.where(F.col("op") == "INCR").withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", watermark)
    counted = timed.groupBy("key", F.window("ts", f"{bs} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("key", F.unix_seconds("w.start").alias("window_start"), "n")


def drain(stream: DataFrame, checkpoint: str, out: str, mode: str = "append"):
    """Run a stream over what is there now into Parquet, and wait for its end. Restarts go on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_sink(path: str):
    """A foreachBatch function that writes the last state of each counter of a batch to a folder of its own; a batch
    that is repeated after a failure overwrites itself, and readers take the newest state by number."""

    def write(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("key", "bs").agg(F.max_by(F.struct("op", "t", "result", "lsn"), F.struct("lsn", "pos")).alias("s"))
        last.select("key", "bs", "s.*").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def newest(states: DataFrame) -> DataFrame:
    """The newest state of each counter over all batches of upsert_sink."""
    last = states.groupBy("key", "bs").agg(F.max_by(F.struct("op", "t", "result", "lsn"), "lsn").alias("s"))
    return last.select("key", "bs", "s.*")
