"""Binary log segments: frames of a 4-byte big-endian length and a protobuf batch of records.

A batch repeats field 1, a record; a record has field 1, its number, field 2, the command's number, and repeats field 3, an argument.
Segments are read in parallel, one file a task, through Spark's binaryFile source, and written in parallel through its text writer, so any file system
that Spark knows will do. A written segment ends in an empty frame, a batch without records.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capwindow.operators import oplog
from capwindow.schema import LOG

FRAME_MAX = 100 << 20
#: An empty frame: the length 0.
END = "\0\0\0\0"


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes((*out, n))


def take_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers and byte strings."""
    at = 0
    while at < len(data):
        tag, at = take_varint(data, at)
        if tag & 7 == 0:
            value, at = take_varint(data, at)
        elif tag & 7 == 2:
            size, at = take_varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("a field is cut short")
        else:
            at += {1: 8, 5: 4}[tag & 7]
            continue
        yield tag >> 3, value


def encode_record(lsn: int, command_id: int, arguments: list[str]) -> bytes:
    out = b"\x08" + put_varint(lsn) if lsn else b""
    out += b"\x10" + put_varint(command_id) if command_id else b""
    for a in arguments:
        out += b"\x1a" + put_varint(len(a.encode())) + a.encode()
    return out


def encode_frame(records: list[tuple[int, int, list[str]]]) -> bytes:
    body = b"".join(b"\x0a" + put_varint(len(r)) + r for r in (encode_record(*x) for x in records))
    return struct.pack(">I", len(body)) + body


def decode_segment(data: bytes) -> list[tuple[int, int, list[str]]]:
    """The records of all frames. A frame that is cut short at the end was never acknowledged and is left out."""
    out, at = [], 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        if size > FRAME_MAX:
            raise ValueError(f"a frame of {size} bytes")
        if at + 4 + size > len(data):
            break
        for number, record in fields(data[at + 4 : at + 4 + size]):
            if number == 1:
                parts = list(fields(record))
                found = dict(parts)
                out.append((found.get(1, 0), found.get(2, 0), [v.decode() for n, v in parts if n == 3]))
        at += 4 + size
    return out


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """All records below the path. They come unordered; the fold orders them by number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "wal_*.log").load(path).select("content")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                records = decode_segment(content.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in records], pa.int64()), pa.array([r[1] for r in records], pa.int32()), pa.array([r[2] for r in records], pa.list_(pa.string()))],
                    names=["lsn", "command_id", "arguments"],
                )

    return files.mapInArrow(decoded, LOG)


def segment_bytes(records: DataFrame, segment_col: str = "segment", frame: int = 100) -> DataFrame:
    """(segment, content): the file of each segment, its records in order in frames of this many. A segment is of bounded size, so it fits in a task."""

    def encoded(key: tuple, rows: pa.Table) -> pa.Table:
        ordered = rows.sort_by("lsn")
        records = list(zip(*(ordered.column(c).to_pylist() for c in ("lsn", "command_id", "arguments"))))
        content = b"".join(encode_frame(records[i : i + frame]) for i in range(0, len(records), frame))
        return pa.table({"segment": [key[0].as_py()], "content": pa.array([content], pa.binary())})

    kept = records.select(records[segment_col].alias("segment"), "lsn", "command_id", "arguments")
    return kept.groupBy("segment").applyInArrow(encoded, "segment string, content binary")


def _varint_size(n: Column) -> Column:
    return F.ceil(F.length(F.bin(n)) / 7).cast("bigint")


def record_size(lsn: Column, command_id: Column, arguments: Column) -> Column:
    """The bytes that a record takes in a frame."""
    texts = F.aggregate(arguments, F.lit(0).cast("bigint"), lambda n, a: n + 1 + _varint_size(F.octet_length(a)) + F.octet_length(a))
    inner = F.when(lsn != 0, 1 + _varint_size(lsn)).otherwise(F.lit(0)) + F.when(command_id != 0, 1 + _varint_size(command_id)).otherwise(F.lit(0)) + texts
    return 1 + _varint_size(inner) + inner


def rotate(records: DataFrame, most: int) -> DataFrame:
    """records with bytes, their size in a frame, and segment, the file that holds them: files of this many bytes in the order of lsn, so that none is
    larger by more than its last record and its frames' lengths. A file is named by its first lsn, in digits that sort as text."""
    sized = records.withColumn("bytes", record_size(F.col("lsn"), F.col("command_id"), F.col("arguments")))
    placed = oplog.running_total(sized, "bytes", "lsn").withColumn("__file", F.floor(F.col("before") / most))
    names = placed.groupBy("__file").agg(F.concat(F.lit("wal_"), F.lpad(F.min("lsn").cast("string"), 13, "0"), F.lit(".log")).alias("segment"))
    return placed.join(names, "__file").drop("__file", "before")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return hadoop, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def segment_names(spark: SparkSession, path: str) -> list[str]:
    _, root, fs = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n for n in names if n.startswith("wal_") and n.endswith(".log"))


def read_file(spark: SparkSession, path: str) -> bytes:
    """One segment, of bounded size."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def write_segments(files: DataFrame, path: str) -> list[str]:
    """Write (segment, content) rows as files, each by the task that holds the row; only names reach the driver, which is the log's one writer. The bytes
    go through Spark's text writer as they are; the separator that it puts behind them is an empty frame. A file appears whole under its name; one that is
    there already, a segment that has grown, is replaced. Two rows of one name are an error."""
    spark = files.sparkSession
    hadoop, root, fs = _file_system(spark, path)
    fs.mkdirs(root)
    incoming = hadoop.Path(root, f"_{uuid.uuid4().hex}")
    try:
        rows = files.select("segment", F.col("content").cast("string"))
        rows.write.partitionBy("segment").options(lineSep=END, compression="none", maxRecordsPerFile=1).text(incoming.toString())
        found, written = {}, fs.listFiles(incoming, True)
        while written.hasNext():
            file = written.next().getPath()
            folder = file.getParent().getName()
            if folder.startswith("segment="):
                name = unquote(folder.removeprefix("segment="))
                if name in found:
                    raise ValueError(f"two rows of segment {name}")
                found[name] = file
        for name, file in found.items():
            whole = hadoop.Path(root, name)
            fs.delete(whole, False)
            if not fs.rename(file, whole):
                raise OSError(f"{file.toString()} can't be renamed to {name}")
    finally:
        fs.delete(incoming, True)
    return list(found)
