"""The counter fold and what reads it.

A counter is the number of increments since the last reset; an increment resets when the key is new or was deleted, or when the
operation before it lies before the start of the increment's own window. The test looks at the previous operation only, so
late operations join the newer window. That is a gaps-and-islands query over the log's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capwindow.functions import windows

KEY = ("key", "bs")
ORDER = ("lsn", "pos")


def _resets(op: Column, t: Column, bs: Column, last_op: Column, last_t: Column) -> Column:
    return F.when((op == "DEL") | last_op.isNull() | (last_op == "DEL") | (last_t < windows.window_start(t, bs)), 1).otherwise(0)


def _result(op: Column, last_op: Column, count: Column) -> Column:
    return F.when(op == "INCR", count).otherwise((last_op == "INCR").cast("bigint")).cast("bigint")


def fold(ops: DataFrame) -> DataFrame:
    """ops with result: the count after an INCR, 1 or 0 for a DEL that met a counter or none. One exchange on the key."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    lagged = ops.withColumns({"__last_op": F.lag("op").over(w), "__last_t": F.lag("t").over(w)})
    flagged = lagged.withColumn("__reset", _resets(F.col("op"), F.col("t"), F.col("bs"), F.col("__last_op"), F.col("__last_t")))
    grouped = flagged.withColumn("__island", F.sum("__reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.row_number().over(Window.partitionBy(*KEY, "__island").orderBy(*ORDER))
    return grouped.withColumn("result", _result(F.col("op"), F.coalesce("__last_op", F.lit("")), count)).drop("__last_op", "__last_t", "__reset", "__island")


def runs_in_chunks(ops: DataFrame, span: int, resets, keys: tuple = KEY) -> DataFrame:
    """ops with __count, the place of each row since the last reset of its key, and __last_op. A key's rows are dealt out by stretches of the
    log of this span; each stretch is counted on its own, and one summary row a stretch carries the last operation and the running
    count over, so that no task holds all rows of a key."""
    chunked = ops.withColumn("__chunk", F.floor(F.col("lsn") / span))
    by_chunk, by_key = [*keys, "__chunk"], Window.partitionBy(*keys).orderBy("__chunk")
    w = Window.partitionBy(*by_chunk).orderBy(*ORDER)
    last = chunked.groupBy(*by_chunk).agg(F.max_by(F.struct("op", "t"), F.struct(*ORDER)).alias("__tail"))
    before = last.select(*by_chunk, F.lag("__tail").over(by_key).alias("__before"))
    rows = chunked.join(before, by_chunk)
    rows = rows.withColumn("__previous", F.coalesce(F.lag(F.struct("op", "t")).over(w), F.col("__before")))
    rows = rows.withColumns({"__last_op": F.col("__previous.op"), "__last_t": F.col("__previous.t")})
    rows = rows.withColumn("__reset", resets(*map(F.col, ("op", "t", "bs", "__last_op", "__last_t")))).drop("__before", "__previous", "__last_t")
    rows = rows.withColumn("__island", F.sum("__reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__count", F.row_number().over(Window.partitionBy(*by_chunk, "__island").orderBy(*ORDER)))
    tails = rows.groupBy(*by_chunk).agg(F.max_by("__count", F.struct(*ORDER)).alias("__tail_count"), F.max("__island").alias("__resets"))
    tails = tails.withColumn("__group", F.sum(F.when(F.col("__resets") > 0, 1).otherwise(0)).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "__group").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, 0)
    carried = tails.withColumn("__sum", F.sum("__tail_count").over(run)).select(*by_chunk, F.coalesce(F.lag("__sum").over(by_key), F.lit(0)).alias("__carry"))
    rows = rows.join(carried, by_chunk)
    count = F.col("__count") + F.when(F.col("__island") == 0, F.col("__carry")).otherwise(F.lit(0))
    return rows.withColumn("__count", count).select(*ops.columns, "__count", "__last_op")


def fold_chunked(ops: DataFrame, span: int) -> DataFrame:
    """The same fold for logs in which a few keys hold much of the rows."""
    rows = runs_in_chunks(ops, span, _resets)
    return rows.withColumn("result", _result(F.col("op"), F.coalesce("__last_op", F.lit("")), F.col("__count"))).drop("__count", "__last_op")


def commit_places(ops: DataFrame, length: int, idle: int, span: int = 1 << 20) -> DataFrame:
    """(lsn, place): each operation's place, from 1, in the batch of a group commit that flushes when it is full or after idle seconds without an operation."""
    rows = runs_in_chunks(ops, span, lambda op, t, bs, last_op, last_t: F.when(last_t.isNull() | (t - last_t > idle), 1).otherwise(0), ())
    return rows.select("lsn", ((F.col("__count") - 1) % length + 1).alias("place"))


def fold_monotone(ops: DataFrame) -> DataFrame:
    """The fold of logs whose time never runs back within a key: the increment's place in its window since the last DEL."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    start = windows.window_start(F.col("t"), F.col("bs"))
    epochs = ops.withColumns({"__epoch": F.sum((F.col("op") == "DEL").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__last_op": F.lag("op").over(w)})
    place = F.row_number().over(Window.partitionBy(*KEY, "__epoch", start).orderBy(*ORDER))
    # The DEL that begins an epoch takes the first place of its own window.
    begins = F.first("op").over(Window.partitionBy(*KEY, "__epoch", start).orderBy(*ORDER)) == "DEL"
    return epochs.withColumn("result", _result(F.col("op"), F.coalesce("__last_op", F.lit("")), place - begins.cast("int"))).drop("__epoch", "__last_op")


def window_counts(ops: DataFrame) -> DataFrame:
    """Counts by event time, late or not: increments of each key and window. A partial aggregate, so hot keys don't matter."""
    start = windows.window_start(F.col("t"), F.col("bs"))
    return ops.where(F.col("op") == "INCR").groupBy(*KEY, start.alias("window_start")).agg(F.count("*").alias("n"))


def state_of(folded: DataFrame) -> DataFrame:
    """The last operation of each key with its value: (key, bs, op, t, value, lsn)."""
    last = folded.groupBy(*KEY).agg(F.max_by(F.struct("op", "t", "result", "lsn"), F.struct(*ORDER)).alias("s"))
    return last.select(*KEY, F.col("s.op").alias("op"), F.col("s.t").alias("t"), F.when(F.col("s.op") == "INCR", F.col("s.result")).otherwise(F.lit(0)).alias("value"), F.col("s.lsn").alias("lsn"))


def current(value: Column, t: Column, bs: Column, now: Column) -> Column:
    """The value as read now: 0 once the window of the last operation has lapsed."""
    return F.when(t < windows.window_start(now, bs), F.lit(0)).otherwise(value).cast("bigint")


def get_as_of(ops: DataFrame, now: int, until_lsn: int | None = None, fold_with=fold) -> DataFrame:
    """(key, bs, value) of every counter that exists, read at the time now after the operations up to until_lsn."""
    known = ops if until_lsn is None else ops.where(F.col("lsn") <= until_lsn)
    state = state_of(fold_with(known)).where(F.col("op") == "INCR")
    return state.select(*KEY, current(F.col("value"), F.col("t"), F.col("bs"), F.lit(now)).alias("value"))


def get_many(probes: DataFrame, ops: DataFrame, now: int, until_lsn: int | None = None) -> DataFrame:
    """probes with value; 0 for keys that were never written. Spark broadcasts the smaller side only if it is small."""
    return probes.join(get_as_of(ops, now, until_lsn), list(KEY), "left").withColumn("value", F.coalesce("value", F.lit(0)))


def multi_delete(deletes: DataFrame, ops: DataFrame, fold_with=fold) -> DataFrame:
    """(lsn, response): results of multi-deletes whose pairs (lsn, pos, key, bs, t) come in argument order."""
    parts = deletes.select("lsn", "pos", F.lit("DEL").alias("op"), "key", "bs", "t", F.lit(True).alias("__asked"))
    folded = fold_with(ops.withColumn("__asked", F.lit(False)).unionByName(parts)).where("__asked")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "result")))  # the pairs of one message
    return folded.groupBy("lsn").agg(F.concat(F.lit("ok|"), F.array_join(F.transform(ordered, lambda x: x["result"].cast("string")), ";")).alias("response"))


def run_readings(ops: DataFrame) -> DataFrame:
    """The results of a log in which readings (GET, WATCH) stand among the changes: each sees the last change before it. One exchange on the
    key. A column __seed, if there is one, gives what an INCR adds to the count in place of 1 where it isn't null."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    op, t, bs = F.col("op"), F.col("t"), F.col("bs")
    change = op.isin("INCR", "DEL")
    seen = ops.withColumn("__last", F.last(F.when(change, F.struct("op", "t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    last_op, last_t = F.col("__last.op"), F.col("__last.t")
    seen = seen.withColumn("__reset", F.when(change, _resets(op, t, bs, last_op, last_t)).otherwise(0))
    seen = seen.withColumn("__island", F.sum("__reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.when(change, F.coalesce("__seed", F.lit(1)) if "__seed" in ops.columns else F.lit(1)).otherwise(0)
    count = F.sum(one).over(Window.partitionBy(*KEY, "__island").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    read = F.when(last_op == "INCR", current(count, last_t, bs, t)).otherwise(F.lit(0))
    result = F.when(change, _result(op, F.coalesce(last_op, F.lit("")), count)).otherwise(read)
    return seen.withColumn("result", result.cast("bigint")).drop("__last", "__reset", "__island")


def next_values(results: DataFrame) -> DataFrame:
    """The rows of run_readings with seen, the first value after a WATCH that differs from its own: from 0 that of the next INCR; from more than
    0 the next change's, unless the window lapses before it or there is none, when it is 0. Null while a watch from 0 has no INCR after it.
    One backward pass over each key in the partitioning that run_readings leaves."""
    w = Window.partitionBy(*KEY).orderBy(*(F.desc(c) for c in ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    forward = Window.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    op, change = F.col("op"), F.col("op").isin("INCR", "DEL")
    held = F.last(F.when(change, F.col("t")), ignorenulls=True).over(forward)
    after = F.last(F.when(change, F.struct("op", "t", "result")), ignorenulls=True).over(w)
    rows = results.withColumns({"__held": held, "__after": after, "__incr": F.last(F.when(op == "INCR", F.col("result")), ignorenulls=True).over(w)})
    lapses = F.col("__after").isNull() | (F.col("__after.t") > windows.window_end(F.col("__held"), F.col("bs")))
    changed = F.when(lapses | (F.col("__after.op") == "DEL"), F.lit(0).cast("bigint")).otherwise(F.col("__after.result"))
    seen = F.when(op == "WATCH", F.when(F.col("result") > 0, changed).otherwise(F.col("__incr")))
    return rows.withColumn("seen", seen).drop("__held", "__after", "__incr")


def values_over_time(ops: DataFrame, fold_with=fold) -> DataFrame:
    """(key, bs, t, lsn, value): each counter's value from t on, with the drop to 0 when a window lapses before the next operation."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    after = fold_with(ops).select(*KEY, *ORDER, "t", F.when(F.col("op") == "INCR", F.col("result")).otherwise(F.lit(0)).alias("value"))
    after = after.withColumn("__next", F.lead("t").over(w))
    lapse = windows.window_end(F.col("t"), F.col("bs")) + 1
    lapsed = after.where((F.col("value") > 0) & (F.col("__next").isNull() | (F.col("__next") >= lapse))).select(*KEY, "lsn", F.lit(1 << 30).alias("pos"), lapse.alias("t"), F.lit(0).cast("bigint").alias("value"))
    return after.drop("__next").unionByName(lapsed)


def watch_changes(ops: DataFrame) -> DataFrame:
    """The moments at which a watcher sees another value than before; a counter starts at 0."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    before = F.coalesce(F.lag("value").over(w), F.lit(0))
    return values_over_time(ops).withColumn("before", before).where(F.col("value") != F.col("before")).select(*KEY, "lsn", "t", "before", "value")


def watch_first(ops: DataFrame, since: int) -> DataFrame:
    """(key, bs, initial, t, value): for a watch set at the time since on every key of the log, the first change after it."""
    series = values_over_time(ops)
    initial = series.where(F.col("t") <= since).groupBy(*KEY).agg(F.max_by("value", F.struct(*ORDER)).alias("initial"))
    later = series.where(F.col("t") > since).join(initial, list(KEY), "left").withColumn("initial", F.coalesce("initial", F.lit(0)))
    changed = later.where(F.col("value") != F.col("initial"))
    return changed.groupBy(*KEY).agg(F.min_by(F.struct("initial", "t", "value"), F.struct(*ORDER)).alias("c")).select(*KEY, "c.initial", "c.t", "c.value")
