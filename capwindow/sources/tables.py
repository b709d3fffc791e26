"""Parquet sources and sinks: the driver's tables, the partitioned log, versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capwindow.schema import SNAPSHOT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_log(segmented: DataFrame, path: str) -> None:
    """Append operations to the log, one folder a segment, so that truncation and catch-up prune by folder."""
    segmented.repartition("segment").write.mode("append").partitionBy("segment").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_snapshot(snapshot: DataFrame, path: str, lsn: int) -> None:
    """A new version beside the older ones. A version counts once its marker is there, so a failed write is never read."""
    snapshot.write.mode("overwrite").parquet(f"{path}/version={lsn}")


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return hadoop, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, root, fs = _folder(spark, path)
    return fs.exists(root)


def delete(spark: SparkSession, path: str) -> None:
    _, root, fs = _folder(spark, path)
    fs.delete(root, True)


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete versions, in order."""
    hadoop, root, fs = _folder(spark, path)
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(p.getName().removeprefix("version=")) for p in found if p.getName().startswith("version=") and fs.exists(hadoop.Path(p, "_SUCCESS")))


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The latest complete version and its number; an empty one and 0 if there is none."""
    versions = snapshot_versions(spark, path)
    if not versions:
        return spark.createDataFrame([], SNAPSHOT), 0
    return spark.read.schema(SNAPSHOT).parquet(f"{path}/version={versions[-1]}"), versions[-1]


def drop_snapshots(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all complete versions but the newest ones."""
    hadoop, _, fs = _folder(spark, path)
    for version in snapshot_versions(spark, path)[: -max(keep, 1)]:
        fs.delete(hadoop.Path(f"{path}/version={version}"), True)


def drop_segments(spark: SparkSession, path: str, names: list[str]) -> None:
    """Delete the folders of removable segments; there are as many names as segments, not rows."""
    hadoop, _, fs = _folder(spark, path)
    for name in names:
        fs.delete(hadoop.Path(f"{path}/segment={name}"), True)


def log_tail(spark: SparkSession, path: str, lsn: int) -> DataFrame:
    """The log after lsn; row groups before it are skipped by their statistics."""
    return read_log(spark, path).where(F.col("lsn") > lsn)
