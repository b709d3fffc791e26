"""Language identification by rank-order profiles.

A profile ranks the most frequent letter n-grams (n from 1 to 3, words padded by a blank) of a language. A document's own
ranking is compared to each profile by the out-of-place distance: the sum over its n-grams of the difference of ranks, and the largest one
where the profile lacks the n-gram. The nearest language wins, ties by its name.

Profiles come from at most SAMPLE labelled documents a language, the first by a hash of their ids and texts, with their whole texts; rows
without a label never train, equal rows count once, and null ids are ids. Texts that are null or without a letter are undetermined, with score 0, and so is every text where nothing was
learned. n-grams of equal counts rank by their letters. Equal texts get equal results; other columns are left alone, whatever their names. Very long
texts count whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capwindow.llm import common

#: Labelled documents a language that the profiles are learned from, at most.
SAMPLE = 400
#: n-grams of a profile.
RANKS = 300
UNKNOWN = "und"
_BITS, _BLANK = 21, 32


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams, ascending, and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters[points]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.where(is_letter, points, _BLANK)
    kept = is_letter | np.concatenate(([False], is_letter[:-1]))  # one blank after a word
    points = np.concatenate(([_BLANK], points[kept], [_BLANK]))
    if points[-2] == _BLANK:
        points = points[:-1]
    inner = points != _BLANK
    two = (points[:-1] << _BITS) | points[1:]
    three = ((two[:-1] << _BITS) | points[2:])[inner[1:-1]]
    return np.unique(np.concatenate((points[inner], two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The most frequent codes, ties by code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:most]]


class Profiles:
    """The rank of each n-gram in each language; RANKS where a profile lacks it."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.codes = np.array(sorted({c for p in profiles.values() for c in p}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), j] = np.arange(len(profiles[name]))

    def nearest(self, order: np.ndarray) -> tuple[str, float]:
        if not len(order) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, order)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == order, at, len(self.codes))
        found = self.ranks[at]
        away = np.where(found < 0, RANKS, np.abs(found - np.arange(len(order))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.names[best], round(1.0 - float(away[best]) / (RANKS * len(order)), 9)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages of labelled rows. Collects at most RANKS n-grams a language."""
    spark = labelled.sparkSession
    common.small_batches(spark)
    known = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    rows = labelled.where(known).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    # A part of each language by the hash, about four samples large, so that the exact choice sorts few rows whatever the language's size.
    # Distinct hashes count, as repeated rows share one.
    counts = rows.select(F.col("lang").alias("of"), "place").distinct().groupBy("of").agg(F.count("*").alias("all"))
    part = F.pmod("place", F.lit(1 << 30)) / (1 << 30) * F.col("all") < 4 * sample
    # One row a language goes to all tasks, so that the others are left out before anything is shuffled.
    few = rows.select("lang", "place").join(F.broadcast(counts), F.col("lang") == F.col("of")).where(part).select("lang", "place").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 30)), "place")
    chosen = common.cut(few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("lang", "place"))
    texts = rows.join(F.broadcast(chosen), ["lang", "place"], "left_semi").groupBy("lang", "place").agg(F.any_value("text").alias("text"))  # sample rows a language

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, counts = gram_counts(text, letters)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))], names=["lang", "code", "n"])

    sums = texts.select("lang", "text").mapInArrow(counted, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    profiles: dict[str, list[int]] = {}
    for row in sums.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= RANKS).orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["code"])
    return Profiles(profiles)


def predict(text: Column, profiles: Profiles) -> Column:
    """The struct (lang, score) of each text."""

    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = letter_table()
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
        for batch in batches:
            found = (profiles.nearest(ranked(*gram_counts(t or "", letters))) for t in batch.to_pylist())
            yield pa.array([{"lang": lang, "score": score} for lang, score in found], kind)

    return F.arrow_udf(predicted, "struct<lang:string,score:double>")(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    profiles = learn(docs.where(part != 1))
    out = docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), predict(F.col("text"), profiles).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
