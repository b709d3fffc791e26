"""Replica catch-up, and how far a replica is from its master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capwindow.schema import RETRY_BASE, RETRY_CAP


def pending(ops: DataFrame, applied: int) -> DataFrame:
    """The operations after the high-water mark, each number once, whatever segments repeat them."""
    return ops.where(F.col("lsn") > applied).dropDuplicates(["lsn", "pos"])


def divergence(master: DataFrame, replica: DataFrame) -> DataFrame:
    """One row: the counters that only the master has, and that only the replica has."""
    ahead = master.exceptAll(replica).agg(F.count("*").alias("only_master"))
    return ahead.join(replica.exceptAll(master).agg(F.count("*").alias("only_replica")))  # one row each


def retry_delay(attempt: Column, base: int = RETRY_BASE, cap: int = RETRY_CAP) -> Column:
    """Seconds before the attempt, from 1: doubled each time up to the cap."""
    return F.least(F.lit(float(cap)), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(40)))).cast("bigint")
