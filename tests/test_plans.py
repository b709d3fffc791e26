"""Plans are what they should be: exchanges, pruned columns, pushed filters."""

import re

from pyspark.sql import functions as F

from capwindow.operators import counters, oplog
from capwindow.sources.tables import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_exchanges_once(spark):
    text = plan(counters.fold(oplog.event_ops(table(spark, SF, "events"))))
    assert len(re.findall(r"\bExchange\b", text)) == 1


def test_scan_reads_needed_columns_only(spark):
    text = plan(counters.window_counts(oplog.event_ops(table(spark, SF, "events"))))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert "props" not in schema and "value" not in schema


def test_key_filter_reaches_below_the_windows(spark):
    ops = table(spark, SF, "events").select((F.col("event_id") + 1).alias("lsn"), F.lit(0).alias("pos"), F.lit("INCR").alias("op"), F.col("event_type").alias("key"), F.lit(60).cast("bigint").alias("bs"), F.col("user_id").alias("t"))
    text = plan(counters.fold(ops).where(F.col("key") == "view"))
    assert "EqualTo(event_type,view)" in text


def test_as_of_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "ops")
    oplog.event_ops(table(spark, SF, "events")).write.parquet(path)
    text = plan(counters.get_as_of(spark.read.parquet(path), 1705320000, 500))
    assert "LessThanOrEqual(lsn,500)" in text
