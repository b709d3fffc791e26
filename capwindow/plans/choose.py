"""Which form of the fold suits a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capwindow.operators import counters

#: A key with more operations than this is dealt out by stretches of the log.
HOT_ROWS = 5_000_000


def heaviest(ops: DataFrame) -> int:
    """The most operations of one counter; counts are partial before the shuffle."""
    return ops.groupBy(*counters.KEY).count().agg(F.max("count")).first()[0] or 0


def is_monotone(ops: DataFrame) -> bool:
    """Whether time never runs back within a counter."""
    w = Window.partitionBy(*counters.KEY).orderBy(*counters.ORDER)
    return ops.select((F.col("t") < F.lag("t").over(w)).alias("back")).where("back").isEmpty()


def planned_fold(ops: DataFrame, monotone: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The fold of a log. monotone is the caller's knowledge, as finding out costs as much as the fold; hot keys are counted here."""
    most = heaviest(ops)
    if most > hot_rows:
        return counters.fold_chunked(ops, max(1, hot_rows // 2))
    return counters.fold_monotone(ops) if monotone else counters.fold(ops)
