"""Snapshots as of a log sequence number, recovery from a snapshot and the tail of the log, expiry and truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capwindow.functions import commands, windows
from capwindow.operators import counters
from capwindow.schema import COMMANDS, DUMP_PAGE


def snapshot_at(ops: DataFrame, lsn: int, fold_with=counters.fold) -> DataFrame:
    """The counters that exist after the operations up to lsn, exactly, whatever came later."""
    return _counters(fold_with(ops.where(F.col("lsn") <= lsn)))


def _counters(folded: DataFrame) -> DataFrame:
    state = counters.state_of(folded).where(F.col("op") == "INCR")
    return state.select("key", F.col("bs").alias("batch_size"), "value", F.col("t").alias("tx_at"), F.col("lsn").alias("tx"))


def seeded(snapshot: DataFrame, ops: DataFrame, lsn: int) -> DataFrame:
    """The operations after lsn behind the rows of the snapshot at lsn, which stand as INCR that add their __seed, the value, to the count.
    Other columns of ops are null there."""
    seeds = snapshot.select(
        F.col("tx").alias("lsn"), F.lit(-1).alias("pos"), F.lit("INCR").alias("op"), "key", F.col("batch_size").alias("bs"), F.col("tx_at").alias("t"), F.col("value").alias("__seed")
    )
    return seeds.unionByName(ops.where(F.col("lsn") > lsn), allowMissingColumns=True)


def advance(snapshot: DataFrame, ops: DataFrame, lsn: int, until: int) -> DataFrame:
    """The snapshot at until, from that at lsn and the operations between."""
    return _counters(counters.run_readings(seeded(snapshot, ops.where(F.col("lsn") <= until), lsn)))


def restore(snapshot: DataFrame, now: int) -> DataFrame:
    """The rows of a snapshot whose windows haven't lapsed."""
    return snapshot.where(~windows.expired(F.col("tx_at"), F.col("batch_size"), F.lit(now)))


def max_tx(snapshot: DataFrame) -> DataFrame:
    """One row with the largest tx; 0 for an empty snapshot."""
    return snapshot.agg(F.coalesce(F.max("tx"), F.lit(0)).cast("bigint").alias("max_tx"))


def recover(snapshot: DataFrame, ops: DataFrame, lsn: int) -> DataFrame:
    """The fold of the operations after lsn, begun from the snapshot at lsn."""
    return counters.run_readings(seeded(snapshot, ops, lsn)).where(F.col("__seed").isNull()).drop("__seed")


def live_after(ops: DataFrame, now: int, fold_with=counters.fold) -> DataFrame:
    """The counters that garbage collection at the time now keeps."""
    state = counters.state_of(fold_with(ops)).where(F.col("op") == "INCR")
    return state.where(~windows.collectable(F.col("t"), F.col("bs"), F.lit(now))).select("key", "bs", "value", "t")


def unexpired(ops: DataFrame, now: int) -> DataFrame:
    """The operations that a replay at the time now applies."""
    return ops.where(~windows.expired(F.col("t"), F.col("bs"), F.lit(now)))


def pages(snapshot: DataFrame, size: int = DUMP_PAGE) -> DataFrame:
    """(page, rows, first_key, last_key) of a snapshot sent in pages of this size, in the order of key and window length."""
    from capwindow.operators.oplog import assign_lsn

    numbered = assign_lsn(snapshot, "key", "batch_size")
    return numbered.groupBy(F.floor((F.col("lsn") - 1) / size).alias("page")).agg(F.count("*").alias("rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def segments(ops: DataFrame, size: int) -> DataFrame:
    """ops with the name of the log segment that holds them; a segment is named by the first of its numbers, times 1000."""
    return ops.withColumn("segment", F.concat(F.lit("wal_"), (F.floor((F.col("lsn") - 1) / size) * 1000).cast("string"), F.lit(".log")))


def removable(segmented: DataFrame, lsn: int) -> DataFrame:
    """(segment, last_lsn) of the segments that a snapshot at lsn makes superfluous: their last number is smaller."""
    return segmented.groupBy("segment").agg(F.max("lsn").alias("last_lsn")).where(F.col("last_lsn") < lsn)


def truncate(segmented: DataFrame, lsn: int) -> DataFrame:
    """The log without such segments."""
    return segmented.join(removable(segmented, lsn).select("segment"), "segment", "left_anti")


def segment_number(name: Column) -> Column:
    return F.regexp_extract(name, r"wal_([0-9]+)\.log", 1).cast("bigint")


def next_segment(names: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (name) with following, the first segment whose name is greater; empty if there is none. Names compare as text of equal form."""
    order = Window.orderBy("name", "asked").rowsBetween(1, Window.unboundedFollowing)  # names of files in one folder
    both = names.select("name", F.lit(1).alias("asked")).unionByName(asked.select("name", F.lit(2).alias("asked")))
    following = F.min(F.when(F.col("asked") == 1, F.col("name"))).over(order)
    return both.withColumn("following", F.coalesce(following, F.lit(""))).where(F.col("asked") == 2).select("name", "following")


def to_records(ops: DataFrame, *more: str) -> DataFrame:
    """Log records of single operations: the command's number, and key, window length and time in hex as arguments; more columns stay."""
    number = F.when(F.col("op") == "INCR", COMMANDS["INCR"]).otherwise(COMMANDS["DEL"])
    return ops.select("lsn", number.alias("command_id"), F.array("key", F.col("bs").cast("string"), commands.time_hex(F.col("t"))).alias("arguments"), *more)


def from_records(records: DataFrame) -> DataFrame:
    """Operations of log records. Multi-deletes carry their time first and any number of pairs; malformed records,
    and malformed pairs alone, are left out, and so are other commands."""
    args = F.col("arguments")
    multi = F.col("command_id") == COMMANDS["MDEL"]
    time = F.when(multi, F.get(args, F.lit(0))).otherwise(F.get(args, F.lit(2)))
    first, n = F.when(multi, F.lit(1)).otherwise(F.lit(0)), F.when(multi, F.floor((F.size(args) - 1) / 2)).otherwise(F.lit(1)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(args, first + 2 * i).alias("key"), F.get(args, first + 2 * i + 1).alias("bs")))
    name = F.when(F.col("command_id") == COMMANDS["INCR"], "INCR").when(F.col("command_id").isin(COMMANDS["DEL"], COMMANDS["MDEL"]), "DEL")
    shaped = F.when(multi, F.size(args) >= 3).otherwise(F.size(args) == 3)
    rows = records.where(name.isNotNull() & shaped & time.rlike(r"\A[0-9a-fA-F]{1,15}\z")).select("lsn", name.alias("op"), commands.hex_time(time).alias("t"), F.posexplode(pairs).alias("pos", "pair"))
    bs = commands.batch_size(F.col("pair.bs"))
    good = bs.isNotNull() & (bs >= 1) & (bs <= 4294967295)
    return rows.where(F.coalesce(good, F.lit(False))).select("lsn", "pos", "op", F.col("pair.key").alias("key"), bs.cast("bigint").alias("bs"), "t")
