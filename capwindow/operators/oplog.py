"""Ordered operation logs, built from tables or from parsed commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capwindow.functions import windows
from capwindow.schema import COMMANDS


def build_ops(df: DataFrame, lsn: Column, key: Column, t: Column, bs: int | Column, op: Column | None = None) -> DataFrame:
    """An operation log of one row a row of df."""
    return df.select(
        lsn.cast("bigint").alias("lsn"),
        F.lit(0).alias("pos"),
        (F.lit("INCR") if op is None else op).alias("op"),
        key.alias("key"),
        (F.lit(bs) if isinstance(bs, int) else bs).cast("bigint").alias("bs"),
        t.cast("bigint").alias("t"),
    )


def event_ops(events: DataFrame, bs: int | Column = 86400, permuted: bool = False, deletes: bool = True) -> DataFrame:
    """Events as operations of their user; errors delete. permuted swaps neighbours, so that time runs back at times."""
    lsn = F.col("event_id").bitwiseXOR(F.lit(7)) + 1 if permuted else F.col("event_id") + 1
    op = F.when(F.col("event_type") == "error", "DEL").otherwise("INCR") if deletes else None
    return build_ops(events, lsn, F.concat(F.lit("user_"), F.col("user_id").cast("string")), windows.epoch_seconds(F.col("ts")), bs, op)


def order_ops(orders: DataFrame, bs: int = 31536000) -> DataFrame:
    """Orders as increments of their customer, naturally out of order in time."""
    return build_ops(orders, F.col("o_orderkey") + 1, F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")), windows.epoch_seconds(F.col("o_orderdate")), bs)


def spread_windows(ops: DataFrame, sizes: list[int]) -> DataFrame:
    """Every operation on counters of several window lengths."""
    return ops.withColumn("bs", F.explode(F.array(*(F.lit(s).cast("bigint") for s in sizes))))


def _placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in the given order with __part and __at, a row's range and its place there. Written between where a folder for checkpoints is set, so that all
    that follows sees the same ranges."""
    ordered = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        ordered = ordered.checkpoint()
    return ordered.withColumn("__part", F.shiftright("__at", 33))


def _starts(sizes: DataFrame) -> DataFrame:
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    return F.broadcast(sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))


def assign_lsn(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with lsn 1, 2, 3 … in the given order. Ranks come from a range partitioning and the sizes of its parts,
    so no task holds more than one range."""
    ordered = _placed(df, *order)
    numbered = ordered.join(_starts(ordered.groupBy("__part").agg(F.count("*").alias("__n"))), "__part")
    return numbered.withColumn("lsn", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start") + 1).drop("__at", "__part", "__start")


def running_total(df: DataFrame, amount: str, *order: Column | str) -> DataFrame:
    """df with before, the sum of amount over all rows that come earlier in the given order; range by range as assign_lsn."""
    ordered = _placed(df, *order)
    totals = ordered.join(_starts(ordered.groupBy("__part").agg(F.sum(amount).alias("__n"))), "__part")
    inside = F.sum(amount).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    return totals.withColumn("before", F.col("__start") + F.coalesce(inside, F.lit(0))).drop("__at", "__part", "__start")


def command_ops(parsed: DataFrame) -> DataFrame:
    """The operations of valid parsed commands with lsn and t; each pair of a multi-delete is a DEL with its own pos.
    GET and WATCH stay in the log as readings."""
    args = F.col("arguments")
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size(args) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(args, (2 * i).cast("int")).alias("key"), F.get(args, (2 * i + 1).cast("int")).cast("decimal(20,0)").cast("bigint").alias("bs")),
    )
    name = F.when(F.col("command_id") == COMMANDS["INCR"], "INCR").when(F.col("command_id").isin(COMMANDS["DEL"], COMMANDS["MDEL"]), "DEL").when(F.col("command_id") == COMMANDS["GET"], "GET").when(F.col("command_id") == COMMANDS["WATCH"], "WATCH")
    valid = parsed.where(F.col("error").isNull() & name.isNotNull() & (F.size(args) >= 2))
    return valid.select("lsn", "t", name.alias("op"), F.posexplode(pairs).alias("pos", "pair")).select("lsn", "pos", "op", "pair.key", "pair.bs", "t")
