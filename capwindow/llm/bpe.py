"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is cut into words by the tokenizer's pattern. The merges of a word are a fold: its bytes' ids are the start, and each step
replaces the leftmost pair of lowest rank by its id, until no pair has a rank. Ranks come from a literal map from
pairs of ids to ids: flat arrays in which the pairs of a left token share one shift, so that a look-up costs two reads. The arrays
are the constants of one uncorrelated scalar subquery over a local relation, which keeps them out of the plans' texts.
Every split of a token into two tokens is in the map, so the pairs' ranks are those of the joined bytes.

The fold's time grows with the square of what it folds, so a word of more than LONG bytes is folded in parts, which gives the same ids: tokens side by side are a
text's encoding if each two neighbours are the encoding of their joined bytes, as no merge crosses the place between these. So parts of
LONG bytes are folded, then the stretches between the middles of neighbouring parts. Where two stretches still have the tokens on both sides of their common
middle that the part had there, that middle is a true boundary; at others the two stretches become one and are folded anew.

Words repeat, so the encodings of the most frequent distinct words (about TABLE_WORDS at most, whatever the corpus) are
folded once and shared in the same way; every other word is folded where it stands, with the same result.
Decoding maps ids to their binary pieces and joins these.

A null or empty text has no ids and decodes to no bytes. Equal texts get equal ids; an empty table gives an empty result. Other columns are left alone,
whatever their names; the column added replaces one of its name.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capwindow.llm import common
from capwindow.llm.common import read_ranks

#: Distinct words whose encodings are shared; about 100 bytes each in the driver and in every task.
TABLE_WORDS = 1 << 18
#: Longer words are not shared.
LONGEST = 40
#: Longer words, in bytes, are folded in parts of this length.
LONG = 64
#: Turns in which parts are joined where they don't fit; the last takes the word as one.
TURNS = 32
_ID_BITS = 17
_MASK = (1 << _ID_BITS) - 1
#: A rank and its place, for the least rank and the leftmost of its places at once.
_PLACE_BITS = 28
NO_RANK = 1 << 62


def java_pattern(pattern: str) -> str:
    """The pattern with white space in the sense of Unicode, as the tokenizers mean it."""
    return "(?U)" + pattern


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The id of each pair of tokens whose bytes join to a token."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[(left << _ID_BITS) | right] = rank
    return out


def rank_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """The literal rank map: the ranks of pairs with the same left token keep their distances, each such row is
    shifted to where its places are free, and each entry carries its left token, above room for a place. Returns the shifts and the entries."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for pair, rank in pair_ranks(ranks).items():
        rows.setdefault(pair >> _ID_BITS, []).append((pair & _MASK, rank))
    n, rng = len(ranks), random.Random(7)
    room = 4 * sum(map(len, rows.values())) + 64
    entries, shifts = [n << _ID_BITS] * (room + n + 1), [0] * (n + 1)
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        shift = rng.randrange(room)
        while any(entries[shift + right] != n << _ID_BITS for right, _ in row):
            shift = rng.randrange(room)
        shifts[left] = shift
        for right, rank in row:
            entries[shift + right] = (left << _ID_BITS) | rank
    return shifts, [e << _PLACE_BITS for e in entries]


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def buckets_of(words: pa.Table) -> pa.Array:
    """One array of maps from words to ids, in which a word's place is its hash modulo the number of maps."""
    n = len(words) + 1
    place = np.mod(words["h"].to_numpy(), n)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(n + 1)).astype(np.int32)
    taken = words.take(pa.array(order)).combine_chunks()
    whole = lambda c, kind: pa.concat_arrays(taken[c].chunks).cast(kind) if len(taken) else pa.array([], kind)
    maps = pa.MapArray.from_arrays(pa.array(starts), whole("w", pa.string()), whole("ids", pa.list_(pa.int32())))
    return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), maps)


class Coder:
    """Expressions that encode words and texts, and decode ids, for one vocabulary."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        if sorted(ranks.values()) != list(range(len(ranks))) or not all(bytes((b,)) in ranks for b in range(256)):
            raise ValueError("ranks must be 0, 1, 2 … and hold all single bytes")
        if len(ranks) >= _MASK:
            raise ValueError(f"at most {_MASK - 1} ranks")
        shifts, entries = rank_rows(ranks)
        pieces = sorted(ranks, key=ranks.__getitem__)
        self.spark, self.pattern = spark, java_pattern(pattern)
        self.byte_ids = F.lit([ranks[bytes((b,))] for b in range(256)]).cast("array<int>")
        kinds = {"shifts": (shifts, pa.int32()), "entries": (entries, pa.int64()), "lengths": ([len(p) for p in pieces], pa.int32())}
        self.tables = {k: pa.array([x], pa.list_(kind)) for k, (x, kind) in kinds.items()}
        self.merges = spark.createDataFrame(pa.table(self.tables))
        # A cast takes bytes as a string's without a look at them.
        self.pieces = spark.createDataFrame(pa.table({"pieces": pa.array([pieces], pa.list_(pa.binary()))})).select(F.col("pieces").cast("array<string>"))
        self.known: DataFrame | None = None

    @staticmethod
    def using(df: DataFrame, out: str, table: DataFrame, body) -> DataFrame:
        """df with body(the arrays in table's only row) in column out. A subquery can't stand inside a higher-order
        function, so it is a column that is read once, which the optimizer moves to its only use."""
        hidden = common.free_name(df, "constants")

        def bound(row: Column, names: list[str], held: list[Column]) -> Column:
            return let(row[names[0]], lambda x: bound(row, names[1:], [*held, x])) if names else body(*held)

        value = let(F.col(hidden), lambda row: bound(row, table.columns, []))
        return df.withColumn(hidden, table.select(F.struct("*")).scalar()).withColumn(out, value).drop(hidden)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    @staticmethod
    def rank(shifts: Column, entries: Column, left: Column, right: Column) -> Column:
        """The id of the joined pair above room for a place; more than any such where the entry is another pair's."""
        entry = F.get(entries, F.get(shifts, left) + right)
        return entry.bitwiseXOR(F.shiftleft(left.cast("bigint"), _ID_BITS + _PLACE_BITS))

    def fold(self, shifts: Column, entries: Column, lengths: Column, word: Column) -> Column:
        """The word's ids."""
        letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        rank = lambda a, b: self.rank(shifts, entries, a, b)
        short = lambda ids: self.fold_one_by_one(rank, ids)
        either = lambda ids: F.when(F.size(ids) <= LONG, short(ids)).otherwise(self.fold_parts(short, lengths, ids))
        return let(F.transform(letters, lambda c: F.get(self.byte_ids, F.ascii(c))), either)

    @staticmethod
    def fold_parts(short, lengths: Column, ids: Column) -> Column:
        """The state holds where the parts begin, each with the tokens expected on both sides, and the result once all are met."""

        def begin(at: Column, left: Column, right: Column) -> Column:
            return F.struct(at.cast("int").alias("at"), left.alias("left"), right.alias("right"))

        def state(begins: Column, out: Column) -> Column:
            return F.struct(begins.alias("begins"), out.cast("array<int>").alias("out"))

        none = F.lit(-1)
        first = begin(F.lit(0), none, none)

        def middle(part: Column, at: Column) -> Column:
            half = F.floor(F.size(part) / 2).cast("int")
            end = F.aggregate(F.slice(part, 1, half), at, lambda sum_, i: sum_ + F.get(lengths, i))
            return begin(end, F.get(part, half - 1), F.get(part, half))

        def middles(begins: Column, parts: Column) -> Column:
            cuts = F.transform(F.filter(F.arrays_zip(begins.alias("b"), parts.alias("p")), lambda x: F.size(x["p"]) > 1), lambda x: middle(x["p"], x["b"]["at"]))
            return F.concat(F.array(first), cuts)

        def true_ones(begins: Column, parts: Column) -> Column:
            met = lambda b, k: (F.element_at(F.get(parts, k - 1), -1) == b["left"]) & (F.get(F.get(parts, k), F.lit(0)) == b["right"])
            return F.filter(begins, lambda b, k: (k == 0) | met(b, k))

        def judged(begins: Column, parts: Column, left: Column) -> Column:
            all_met = F.size(left) == F.size(begins)
            return state(left, F.when(all_met, F.flatten(parts)))

        def step(at: Column, turn: Column) -> Column:
            begins = at["begins"]
            until = lambda k: F.coalesce(F.get(begins, k + 1)["at"], F.size(ids))
            parts = F.transform(begins, lambda b, k: short(F.slice(ids, b["at"] + 1, until(k) - b["at"])))
            go_on = lambda parts: (
                F.when(turn == 1, state(middles(begins, parts), F.lit(None)))
                .when(turn == TURNS - 1, state(F.array(first), F.lit(None)))
                .otherwise(let(true_ones(begins, parts), lambda left: judged(begins, parts, left)))
            )
            return F.when(at["out"].isNotNull(), at).otherwise(let(parts, go_on))

        starts = F.transform(F.sequence(F.lit(0), F.size(ids) - 1, F.lit(LONG)), lambda x: begin(x, none, none))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), state(starts, F.lit(None)), step, lambda at: at["out"])

    @staticmethod
    def fold_one_by_one(rank, ids: Column) -> Column:
        """The state holds ids and the least rank of neighbours with its place. Slices and concatenations of arrays are slow outside generated
        code, so a merge rewrites one place and filters out the next."""

        def state(ids: Column) -> Column:
            placed = lambda a, i: rank(a, F.get(ids, i + 1)).bitwiseOR(i)
            return F.struct(ids.alias("ids"), F.coalesce(F.array_min(F.transform(ids, placed)), F.lit(NO_RANK)).alias("least"))

        def merge(at: Column, p: Column) -> Column:
            put = F.transform(at["ids"], lambda x, i: F.when(i == p, F.shiftright(at["least"], _PLACE_BITS).cast("int")).otherwise(x))
            return let(let(p + 1, lambda q: F.filter(put, lambda _, i: i != q)), state)

        def step(at: Column, _: Column) -> Column:
            place = at["least"].bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
            return F.when(at["least"] >= 1 << (_ID_BITS + _PLACE_BITS), at).otherwise(let(place, lambda p: merge(at, p)))

        # As many steps as pairs.
        return F.aggregate(F.slice(ids, 2, F.size(ids)), state(ids), step, lambda at: at["ids"])

    def learn(self, words: DataFrame, most: int = TABLE_WORDS) -> None:
        """Share the encodings of the most frequent words; words has the column w, one row an occurrence.
        A histogram of counts gives the least count that is shared, and the part of words with the next lower one that still fits."""
        level = F.floor(F.log2("count") * 16)
        counted = common.cut(words.where(F.length("w") <= LONGEST).groupBy("w").count().where(F.col("count") > 1).withColumn("level", level))
        least, part, room = 0, 0.0, most
        for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # 16 rows for each doubling
            if row["count"] > room:
                least, part = row["level"] + 1, room / row["count"]
                break
            room -= row["count"]
        some = (F.col("level") == least - 1) & (F.pmod(F.xxhash64(F.lit(1), "w"), F.lit(1 << 20)) < int(part * (1 << 20)))
        words = counted.where((F.col("level") >= least) | some).repartition("w").select("w", F.xxhash64("w").alias("h"))
        # At most so many rows as the table has words.
        found = self.using(words, "ids", self.merges, lambda *merges: self.fold(*merges, F.col("w"))).toArrow()
        self.known = self.spark.createDataFrame(pa.table(self.tables | {"known": buckets_of(found)}))

    def with_ids(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        """df with the ids of its texts: of each word the shared ones, or its fold."""
        words = self.words(F.col(text_col))
        if self.known is None:
            return self.using(df, out, self.merges, lambda *merges: F.flatten(F.transform(words, lambda w: self.fold(*merges, w))))

        def ids(shifts: Column, entries: Column, lengths: Column, known: Column) -> Column:
            def of(w: Column) -> Column:
                place = F.pmod(F.xxhash64(w), F.size(known).cast("bigint")).cast("int")
                return F.coalesce(F.try_element_at(F.get(known, place), w), self.fold(shifts, entries, lengths, w))

            return F.flatten(F.transform(words, of))

        return self.using(df, out, self.known, ids)

    def with_bytes(self, df: DataFrame, ids_col: str, out: str) -> DataFrame:
        """df with the bytes that its ids stand for."""
        return self.using(df, out, self.pieces, lambda pieces: F.array_join(F.transform(ids_col, lambda i: F.get(pieces, i)), "").cast("binary"))


def encode_texts(df: DataFrame, coder: Coder, text_col: str = "text", out: str = "ids", most: int = TABLE_WORDS) -> DataFrame:
    """df with the ids of its texts in column out, which replaces a column of that name."""
    coder.learn(df.select(F.explode(coder.words(F.col(text_col))).alias("w")), most)
    return coder.with_ids(df, text_col, out)


def digests(df: DataFrame, coder: Coder, keep: list[str], ids_col: str = "ids") -> DataFrame:
    return coder.with_bytes(df, ids_col, "decoded").select(
        *keep,
        F.size(ids_col).cast("long").alias("n_tokens"),
        common.sha_hex(F.array_join(F.col(ids_col).cast("array<string>"), " ")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str, most: int = TABLE_WORDS) -> DataFrame:
    import public_tokenizers

    coder = Coder(spark, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_texts(docs, coder, most=most), coder, ["doc_id"])
