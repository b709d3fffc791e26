"""What the operators share: reading tables, cutting lineage, span digests."""

from __future__ import annotations

import base64
import contextlib
import contextvars
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python; long documents make batches of thousands of rows too large.
ARROW_ROWS = 256
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by the rows of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in the warehouse, which executors share as well."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found.rstrip("/") if found else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cuts"


#: The part of the shared folder that cut() writes to just now.
_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="cuts")


@contextlib.contextmanager
def cuts_in(scope: str):
    """Let cut() write to a part of the shared folder that can be deleted by its name."""
    token = _scope.set(scope)
    try:
        yield
    finally:
        _scope.reset(token)


def _cuts(spark: SparkSession, scope: str):
    """The folder of a part as Hadoop's path, and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{scope}-{spark.sparkContext.applicationId}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard_cuts(spark: SparkSession, scope: str = "cuts") -> None:
    """Delete what cut() wrote to this part in this application; its results are of no use after that."""
    path, system = _cuts(spark, scope)
    system.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later stages don't depend on earlier executors. The
    application deletes its parts of the folder when it ends, discard_cuts() before."""
    spark = df.sparkSession
    path, system = _cuts(spark, _scope.get())
    system.deleteOnExit(path)
    table = f"{path.toString()}/{uuid.uuid4().hex}"
    df.write.parquet(table)
    return spark.read.schema(df.schema).parquet(table)


def cut_seen(df: DataFrame, *aggregates: Column) -> tuple[DataFrame, dict]:
    """cut(df), and the values of aggregates over it, which are computed as it is written."""
    seen = Observation()
    made = cut(df.observe(seen, *aggregates))
    return made, seen.get


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or a longer name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def sha_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
