"""Mixing sources to target weights over a time-varying curriculum.

Each source has a weight and a schedule by its place in the order of sources, both repeating; a source may be given a schedule of its own, and
without any the schedule is flat. Each source gets a target by weighted shares of the wanted total; targets stop at a multiple of the source's size and
the excess is shared again. Within a source, documents stand in the order of a hash. Their running sizes are its supply;
its demand over training time is the integral of its weight schedule, scaled to its target. Inverting the demand at a
document's place in the supply gives its training position in [0, 1]; passes after the first go on where the last ended.

The running sizes come from two levels: sums of (source, bucket) give each bucket its start, and only a bucket's rows
meet in one task. There are BUCKETS buckets a source, or as many as make some BUCKET_ROWS rows each if one source had all rows, so a hot source is spread over as many tasks.

A null source is a source of its own, last in order. Null sizes count as 0; documents of size 0 are never taken and have
no position. Ties in the hash are broken by the order columns, equal rows are interchangeable. An empty table gives an empty result. Texts aren't read here,
so their length doesn't matter. The columns added (source_size, target, taken, positions) replace columns of those names; others are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capwindow.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BUCKETS, BUCKET_ROWS = 512, 1 << 16
SEED = 20
#: Weight over training time: (time, multiplier) knots, linear between them, from 0 to 1. Sources take these in turn.
FLAT = ((0.0, 1.0), (1.0, 1.0))
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), FLAT, ((0.0, 0.5), (0.7, 0.5), (1.0, 2.5)))


def source_targets(sums: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """(key, source_size) with rank, weight and target. Sources may be many: ranks come from a range sort, and the common
    level from sums over sources, one small aggregate for each round of capping."""
    sized = common.cut(sums.orderBy("key").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = sized.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a partition
    before, offset = 0, F.lit(0).cast("long")
    for row in counts:
        offset = F.when(part == row["part"], F.lit(before)).otherwise(offset)
        before += row["count"]
    rank = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + offset
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    sized = sized.select("key", "source_size", rank.alias("rank"), weight.alias("weight"))
    cap = F.col("source_size") * F.lit(float(most))
    total = (sized.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:  # each round caps more sources, or is the last
        full = cap <= F.col("weight") * F.lit(level)
        row = sized.agg(F.count_if(full).alias("n"), F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], max(0.0, total - (row["held"] or 0.0)) / row["open"]
    return sized.withColumn("target", F.when(F.lit(level) > 0, F.least(cap, F.col("weight") * F.lit(level))).otherwise(F.lit(0.0)))


def invert(share: Column, knots: tuple) -> Column:
    """The time at which the integral of the schedule reaches this share of its whole."""
    pieces, whole = [], 0.0
    for (t, m), (t2, m2) in zip(knots, knots[1:]):
        area = (t2 - t) * (m + m2) / 2
        pieces.append((t, m, t2, m2, whole, area))
        whole += area
    reached = share * F.lit(whole)
    out = F.lit(float(knots[-1][0]))
    for t, m, t2, m2, done, area in reversed(pieces):
        rest, slope = F.greatest(F.lit(0.0), reached - done), (m2 - m) / (t2 - t)
        if slope == 0:
            at = F.lit(t) + rest / F.lit(m)
        else:
            at = F.lit(t) + (F.sqrt(F.greatest(F.lit(0.0), F.lit(m * m) + 2 * slope * rest)) - F.lit(m)) / F.lit(slope)
        out = F.when(reached <= done + area, F.least(at, F.lit(t2))).otherwise(out)
    return out


def mix(
    df: DataFrame,
    order_cols: list,
    source_col: str = "source",
    size_col: str = "size",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    schedules: tuple = SCHEDULES,
    own_schedules: dict | None = None,
    buckets: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """df with each document's part in the mix. taken counts repeats; where a source's target ends inside a document,
    that document is taken in part, or with whole=True all or not at all, whichever is nearer. positions has one entry for each pass
    that takes any of it. The columns order_cols fix the order inside a source; they should tell rows apart."""
    schedules, buckets = schedules or (FLAT,), buckets or max(BUCKETS, -(-df.count() // BUCKET_ROWS))
    hidden = {k: common.free_name(df, f"mix_{k}") for k in ("size", "key", "place", "bucket", "start", "end", "supply", "rank", "goal")}
    of = {k: F.col(name) for k, name in hidden.items()}
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    place = F.xxhash64(F.lit(SEED), *order_cols)
    # A part of the mixed hash that the order inside a bucket doesn't use.
    bucket = F.pmod(F.xxhash64(F.lit(SEED + 1), place), F.lit(buckets)).cast("int")
    keyed = df.withColumns({hidden["size"]: F.coalesce(F.col(size_col), F.lit(0)).cast("long"), hidden["key"]: key, hidden["place"]: place, hidden["bucket"]: bucket})
    sums = common.cut(keyed.groupBy(of["key"].alias("key"), of["bucket"].alias("bucket")).agg(F.sum(of["size"]).alias("sum")))
    targets = source_targets(sums.groupBy("key").agg(F.sum("sum").alias("source_size")), weights, share, most)
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(ahead), F.lit(0))).join(targets, "key")  # at most so many rows a source as buckets
    named = {"key": "key", "bucket": "bucket", "start": "start", "supply": "source_size", "rank": "rank", "goal": "target"}
    starts = starts.select(*(F.col(c).alias(hidden[k]) for k, c in named.items()))
    inside = Window.partitionBy(hidden["key"], hidden["bucket"]).orderBy(hidden["place"], *order_cols).rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(starts, [hidden["key"], hidden["bucket"]]).withColumn(hidden["end"], of["start"] + F.sum(of["size"]).over(inside))
    end, supply, goal, n = of["end"], of["supply"], F.floor(of["goal"]), of["size"]

    def when(at: Column) -> Column:
        turn = F.pmod(of["rank"], F.lit(len(schedules)))
        out = invert(at, schedules[-1])
        for k, knots in enumerate(schedules[:-1]):
            out = F.when(turn == k, invert(at, knots)).otherwise(out)
        for source, knots in (own_schedules or {}).items():
            out = F.when(F.col(source_col).eqNullSafe(F.lit(source)), invert(at, knots)).otherwise(out)
        return out

    parts, positions = [], []
    for k in range(int(-(-most // 1))):
        part = F.greatest(F.lit(0), F.least(goal, end + k * supply) - (end - n + k * supply))
        if whole:
            part = F.when(2 * part >= n, n).otherwise(F.lit(0))
        parts.append(part)
        positions.append(F.when(part > 0, when(F.least(F.lit(1.0), (end - n / 2 + k * supply) / of["goal"]))))
    out = placed.withColumns({"source_size": supply, "target": of["goal"], "taken": sum(parts[1:], parts[0]).cast("long"), "positions": F.filter(F.array(*positions), lambda p: p.isNotNull())})
    return out.drop(*hidden.values())


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    sized = common.cut(docs.select("doc_id", "source", size.alias("size")))
    mixed = mix(sized, ["doc_id", "size"])
    return (
        mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), "positions")
        .orderBy(F.asc_nulls_last("position"), "doc_id")
    )
