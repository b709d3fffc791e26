"""Token counts of the fields or sections of documents.

Each document is encoded once, as a whole. The tokens' spans are joined to the sections by a merge of the two sorted
lists of boundaries, and a token that crosses boundaries is allocated by one explicit rule:

- start: to the section of its first byte (the default)
- end: to the section of its last byte
- share: to all sections that it touches, by the share of its bytes

Sections are lines (each with its line feed) or given fields, joined in order with nothing between. A null text is empty and has
one section without tokens; a null field is an empty one. Counts over a document's sections always sum to its tokens. Empty lines and fields are
sections, too; very long texts are encoded whole. Equal rows get equal counts; an empty table gives an empty result. Other columns are left
alone, whatever their names; the column added replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capwindow.llm import common

RULES = ("start", "end", "share")
COUNTS = "array<struct<section:int,start:int,end:int,n_tokens:double,n_crossing:int>>"


def section_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets of the ends of lines; one section at least."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def attribute(starts: np.ndarray, ends: np.ndarray, section_end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many of those it touches cross a boundary; all in bytes."""
    n = len(section_end)
    first = np.searchsorted(section_end, starts, "right")
    last = np.searchsorted(section_end, ends - 1, "right")
    crossing = np.flatnonzero(last > first)
    touched = np.zeros(n, np.int64)
    owned = np.bincount(last if rule == "end" else first, minlength=n).astype(float)
    for t in crossing:
        lo, hi = first[t], last[t]
        bounds = np.clip(np.concatenate(([starts[t]], section_end[lo:hi], [ends[t]])), starts[t], ends[t])
        part = np.diff(bounds)
        touched[lo : hi + 1] += part > 0
        if rule == "share":
            owned[lo] -= 1
            owned[lo : hi + 1] += part / part.sum()
    return owned, touched


def count_one(text: str, ends: np.ndarray | None, encode, lengths: np.ndarray, rule: str) -> list[dict]:
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = section_ends(raw) if ends is None else ends
    token_ends = np.cumsum(lengths[encode(text)]) if text else np.zeros(0, np.int64)
    owned, touched = attribute(np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends, token_ends, ends, rule)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[ends]
    begins = np.concatenate(([0], chars[:-1]))
    return [
        {"section": i, "start": int(b), "end": int(e), "n_tokens": float(n), "n_crossing": int(c)}
        for i, (b, e, n, c) in enumerate(zip(begins, chars, owned, touched))
    ]


def count_tokens(df: DataFrame, ranks: dict[bytes, int], pattern: str, columns: list[str], rule: str = "start", out: str = "sections", by_lines: bool = False) -> DataFrame:
    """df with the counts of its sections: the columns as fields, or, with by_lines, the lines of the only column."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if by_lines and len(columns) != 1:
        raise ValueError("lines are those of one column")
    spark = df.sparkSession
    common.small_batches(spark)
    shipped = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary, whatever the corpus
    alone = len(columns) == 1

    def counted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        import tiktoken

        vocabulary = shipped.value
        coder = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
        lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, rank in vocabulary.items():
            lengths[rank] = len(token)
        kind = pa.list_(pa.struct([("section", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.float64()), ("n_crossing", pa.int32())]))
        encode = lambda text: np.asarray(coder.encode_ordinary(text), np.int64)
        for batch in batches:
            rows = []
            for values in zip(*(c if isinstance(c, list) else c.to_pylist() for c in ((batch,) if alone else batch))):
                parts = [v or "" for v in values]
                ends = None if by_lines else np.cumsum([len(p.encode()) for p in parts])
                rows.append(count_one("".join(parts), ends, encode, lengths, rule))
            yield pa.array(rows, kind)

    if alone:

        def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return counted(batches)
    else:

        def udf(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            return counted(batches)

    return df.withColumn(out, F.arrow_udf(udf, COUNTS)(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = common.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    counted = count_tokens(docs, ranks, public_tokenizers.PATTERN, ["text"], by_lines=True)
    return counted.select("doc_id", F.explode("sections").alias("s")).select(
        "doc_id", F.col("s.section"), F.col("s.start"), F.col("s.end"), F.col("s.n_tokens").cast("long").alias("n_tokens"), F.col("s.n_crossing")
    )
