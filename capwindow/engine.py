"""The command interface: batches of command texts in, responses out, over a log in Parquet."""

from __future__ import annotations

import contextlib
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capwindow import schema
from capwindow.config import Config, parse_duration
from capwindow.functions import commands, windows
from capwindow.operators import counters, oplog, snapshot
from capwindow.sources import tables


def run_commands(df: DataFrame, history: DataFrame | None = None, max_message: int = schema.MAX_MESSAGE, state: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(lsn, query, response) of commands (lsn, t, query) that run in the order of lsn on the state that history leaves, an operation log,
    begun from state, a snapshot and its number. A WATCH answers with the first value that differs from the one at its time, and with null while
    there is none. One fold serves all commands."""
    parsed = commands.parse(df, "query", max_message)
    log = oplog.command_ops(parsed).withColumn("__asked", F.lit(True))
    if history is not None:
        log = log.unionByName(history.withColumn("__asked", F.lit(False)))
    if state is not None:
        log = snapshot.seeded(state[0], log, state[1])
    results = counters.next_values(counters.run_readings(log)).where("__asked")
    value = F.when(F.col("op") == "DEL", F.col("result").cast("string")).when(F.col("op") == "WATCH", F.col("seen").cast("string")).otherwise(commands.unsigned(F.col("result")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", value.alias("value"))))  # the pairs of one message
    by_lsn = results.groupBy("lsn").agg(ordered.alias("r")).select("lsn", F.when(~F.exists("r", lambda x: x["value"].isNull()), F.array_join("r.value", ";")).alias("result"))
    is_ = lambda name: F.col("command_id") == schema.COMMANDS[name]
    result = F.when(is_("MSGSIZE"), F.lit(str(max_message))).when(is_("MDEL"), F.coalesce("result", F.lit(""))).otherwise(F.col("result"))
    return parsed.join(by_lsn, "lsn", "left").select("lsn", "query", commands.respond(result, F.col("error")).alias("response"))


class Database:
    """A small stateful front end over a folder: log segments beside dumps. Each call answers from the newest dump and the log after it, and appends its
    changes to the log: before it returns where commits are synchronous, else with the next full batch or once the batch's time is over (flush)."""

    SEGMENT = 1000

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.log_path, self.dump_path = f"{self.path}/log", f"{self.path}/dumps"
        self._waiting: list[tuple] = []
        self._since = time.monotonic()  # of the oldest change that waits
        self.dump_version = max(tables.snapshot_versions(spark, self.dump_path), default=0)

    def _history(self) -> DataFrame:
        """The log, waiting changes included."""
        log = self.spark.createDataFrame(self._waiting, schema.OPS)
        if tables.exists(self.spark, self.log_path):
            log = log.unionByName(self.spark.read.schema(schema.OPS).parquet(self.log_path).drop("segment"))
        return log

    def run(self, queries: list[str], now: int | None = None) -> list[str | None]:
        history, (state, dumped) = self._history(), tables.read_snapshot(self.spark, self.dump_path)
        tail = history.where(F.col("lsn") > dumped)
        first = max(tail.agg(F.max("lsn")).first()[0] or 0, dumped) + 1
        t = int(time.time()) if now is None else now
        batch = self.spark.createDataFrame([(first + i, t, q) for i, q in enumerate(queries)], "lsn bigint, t bigint, query string")
        # As many rows as the caller's list has pairs.
        changes = oplog.command_ops(commands.parse(batch, "query", self.config.max_message)).where(F.col("op").isin("INCR", "DEL")).collect()
        if changes and not self.config.writable:
            raise PermissionError("a replica takes no changes")
        answers = {r["lsn"]: r["response"] for r in run_commands(batch, tail, self.config.max_message, (state, dumped)).collect()}
        if not self._waiting:
            self._since = time.monotonic()
        self._waiting.extend(map(tuple, changes))
        late = time.monotonic() - self._since > parse_duration(self.config.log.batch_timeout) if self.config.log else False
        if self.config.sync_commit or self.config.log and (len(self._waiting) >= self.config.log.batch_length or late):
            self.flush()
        return [answers[first + i] for i in range(len(queries))]

    def flush(self) -> None:
        """Append the waiting changes to the log."""
        if self._waiting:
            waiting = self.spark.createDataFrame(self._waiting, schema.OPS)
            tables.append_log(snapshot.segments(waiting, self.SEGMENT), self.log_path)
            self._waiting = []

    def dump(self, now: int | None = None, keep: int = 2) -> int:
        """Write a dump of the state, without counters whose windows and grace are over; then drop the log's segments that it makes superfluous and all
        dumps but the newest. Returns the dump's number."""
        self.flush()
        t = int(time.time()) if now is None else now
        history, (state, dumped) = self._history(), tables.read_snapshot(self.spark, self.dump_path)
        last = history.agg(F.max("lsn")).first()[0] or 0
        if last <= dumped:
            return dumped
        live = ~windows.collectable(F.col("tx_at"), F.col("batch_size"), F.lit(t))
        tables.write_snapshot(snapshot.advance(state, history, dumped, last).where(live), self.dump_path, last)
        self.dump_version = last
        gone = snapshot.removable(tables.read_log(self.spark, self.log_path), last).collect()  # one row a segment
        tables.drop_segments(self.spark, self.log_path, [r["segment"] for r in gone])
        tables.drop_snapshots(self.spark, self.dump_path, keep)
        return last

    def watch(self, query: str, order: threading.Lock | None = None, timeout: float = 30.0, pause: float = 0.1) -> str:
        """Wait for a value that differs from the one now, read again and again; changes between two readings that undo
        each other aren't seen. order is held during a reading, so that others can change the counter."""
        reading = "GET" + query.strip()[5:]

        def read() -> str:
            with order or contextlib.nullcontext():
                return self.run([reading])[0]

        first, until = read(), time.monotonic() + timeout
        while first.startswith("ok|") and time.monotonic() < until:
            if (now := read()) != first:
                return now
            time.sleep(pause)
        return first if first.startswith("err|") else "err|timeout"


def main(argv: list[str]) -> None:
    """A prompt over a folder: python -m capwindow.engine FOLDER, or over a server: --connect HOST:PORT. Lines are kept for the arrow keys where
    readline is there. A WATCH waits for 30 seconds. q, quit or exit ends it."""
    with contextlib.suppress(ImportError):
        import readline  # noqa: F401

    if argv[0] == "--connect":
        from capwindow.sources.server import CommandClient

        client = CommandClient(argv[1], 60.0)
        answer = lambda line: "|".join(client.send(line))
    else:
        from capwindow.session import build_session

        database = Database(build_session(), argv[0])
        answer = lambda line: database.watch(line) if line.split()[0].upper() == "WATCH" else database.run([line])[0] or "ok|"
    while (line := input("> ").strip()) not in ("q", "quit", "exit"):
        if not line:
            continue
        began = time.time()
        status, _, payload = answer(line).partition("|")
        print(f"{status}: {payload} ({time.time() - began:.3f} s)")


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
