"""From raw documents to training tokens: five stages, each over all that its predecessor kept.

All but the last return the columns of documents, whatever other columns their input has. Nulls, empty texts, repeated rows and empty tables are
as the operators define them. The mixing stage writes documents in training order; the order of rows in its files is all that tells it, and the
last stage returns each row's place in it.
"""

from __future__ import annotations

import contextvars
import functools
import hashlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capwindow.llm import bpe, common, mixing, neardup, quality, secrets

#: Words whose encodings the last stage shares; the driver holds earlier stages' plans as well.
SHARED_WORDS = 1 << 17
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


_run: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)


def stage(f):
    """A stage keeps its own intermediate tables until the next one of its run begins; by then its output is written. Stages that are called
    one by one, not by run(), belong to one run if they are called in one thread for one folder."""

    @functools.wraps(f)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scope = _run.get() or f"pipeline-{threading.get_ident()}-{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}"
        common.discard_cuts(spark, scope)
        with common.cuts_in(scope):
            return f(spark, docs, sf_dir)

    return begun


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose host passes."""
    # Written once: both uses read it, and no filter is pushed into the nested expressions of the counts.
    featured = common.cut(quality.with_features(docs.select(*DOCUMENT)))
    verdicts = quality.host_verdicts(featured)
    return quality.judge(featured, verdicts).where("kept").select(*DOCUMENT)


@stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicate(docs.select(*DOCUMENT))


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; n_chars follows a text that changed."""
    masked = secrets.mask_secrets(docs.select(*DOCUMENT, F.col("text").alias("raw")))
    changed = F.col("text") != F.col("raw")
    return masked.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")).select(*DOCUMENT)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each pass that takes them. Documents are taken whole. The files' rows stand in that order."""
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    sized = docs.select(*DOCUMENT, size.alias("size"), F.xxhash64("text").alias("fp"))
    mixed = mixing.mix(sized, ["doc_id", "fp"], whole=True)
    return mixed.withColumn("at", F.explode("positions")).orderBy("at", "doc_id").select(*DOCUMENT)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document: their number, and digests of the ids and of what these decode to; place is the row's place, from 1, in the
    training order, which is that of the files that docs is read from and of their rows."""
    import public_tokenizers

    coder = bpe.Coder(spark, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    found = bpe.digests(bpe.encode_texts(rows, coder, most=SHARED_WORDS), coder, ["doc_id", "file", "row"])
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long")
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return found.join(starts, "file").withColumn("place", F.col("start") + F.col("row") + 1).drop("file", "row", "start")


STAGES = [("quality rules", keep_quality), ("near-duplicates", keep_one_of_each), ("secrets", mask_secrets), ("mixing", mix_sources), ("byte-level BPE", encode)]

#: Merges of tokens are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result for documents. Each stage's output is written to the shared folder and read back; it is deleted when its
    successor's is written."""
    docs, name = common.table(spark, sf_dir, "documents"), f"pipeline-{uuid.uuid4().hex}"
    token = _run.set(name)
    try:
        for k, (_, apply) in enumerate(STAGES[:-1]):
            out = apply(spark, docs, sf_dir)
            with common.cuts_in(f"{name}-{k}"):
                docs = common.cut(out)
            common.discard_cuts(spark, f"{name}-{k - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _run.reset(token)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
