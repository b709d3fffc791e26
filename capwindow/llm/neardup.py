"""Near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct word shingles. Equal sets are one class from the start and go on as one set.
Each tree branches a set along few randomly chosen minwise tokens: a path's hash picks one coordinate of the set's minwise sketch,
or at times two, so that a pair at the wanted similarity keeps one common branch on average. Sets that meet in a node go on
together; nodes that are small are compared exhaustively on their sketches, larger ones branch on. The first levels, and
later ones of nodes too large for a task, branch in Spark; a node that fits in a task branches on inside it. Independent trees are repeated to reach
the target recall, a parameter: their number follows from the share of trees in which a pair at the wanted similarity survives the planned
levels. Trees find many groups again; one node of each small group goes on, told apart by the hashes of its members.

Every pair that the sketches don't rule out is confirmed on the full sets in the node's own task, unless it is connected there already; only links that
connect leave a task. Sets travel to nodes as their compressed texts, which are smaller. A broadcast bitmap of stated size tells which documents'
texts are needed; others stay where they are. Nodes are bounded by their sets and by their shingles.
Classes are the connected components of the confirmed links, found by alternating stars over distributed edges.

At the deepest level a node that is still large holds sets that are nearly all alike. Groups that share pivots connect most of what is
linked there at little cost. What they leave apart is compared exhaustively on the full sets, part by part: overlapping nodes of all trees
make one cluster, and every two parts of a cluster meet, unless both lie in one component already.

A null text, or one without words, has an empty set: it is alone in its class. A null id is no class's id while there is another; equal rows get equal results.
An empty table gives an empty result. Only the id and text columns are read, so other columns' names don't matter; ids need not be unique.
Very long texts count whole: groups whose sets together are large are dealt out by parts, and a set is never cut.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capwindow.llm import common

#: Coordinates of a sketch, levels that every set branches before nodes are looked at, and those that the number of trees is planned for.
WIDTH, FIRST_LEVELS, PLANNED_LEVELS = 128, 4, 8
#: The share of pairs at the wanted similarity that some tree keeps together over the planned levels.
RECALL = 0.999
#: Nodes up to LEAF sets are compared exhaustively; nodes up to NODE sets are handled in one task.
LEAF, NODE, DEEPEST, PIVOTS = 128, 2048, 18, 16
#: Shingles of a node in one task, and of a cluster's part, about; a part has about NODE / 2 sets at most.
NODE_SHINGLES, PART_SHINGLES = 1 << 22, 1 << 21
#: Pairs whose sketches agree this many standard deviations below the wanted similarity are still confirmed.
DEVIATIONS = 4.5
#: Bits of the bitmap of needed documents, 4 MB; where it fills up, more full sets than needed are made.
FILTER_BITS = 1 << 25

_U64 = np.uint64
_M1, _M2 = _U64(0xBF58476D1CE4E5B9), _U64(0x94D049BB133111EB)  # of the public splitmix64 finalizer


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _M1
        x = (x ^ (x >> _U64(27))) * _M2
        return x ^ (x >> _U64(31))


class Shingler:
    """Sets of hashed word shingles, and their sketches. Everything follows from fixed seeds."""

    def __init__(self, words: int):
        rng = np.random.default_rng(1905)
        self.words = words
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.base = _U64(int(rng.integers(1 << 40, 1 << 63)) | 1)
        self.powers = np.ones(64, np.uint64)
        self.factors = rng.integers(1, 1 << 32, WIDTH, dtype=np.uint32) | np.uint32(1)
        self.shifts = rng.integers(0, 1 << 32, WIDTH, dtype=np.uint32)

    def word_hashes(self, text: str) -> np.ndarray:
        raw = self.lower[np.frombuffer(text.encode(), np.uint8)]
        inside = ~self.space[raw]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        sizes = ends - starts
        with np.errstate(over="ignore"):
            if sizes.max() > len(self.powers):
                self.powers = np.cumprod(np.concatenate(([_U64(1)], np.full(int(sizes.max()) + 64, self.base))), dtype=np.uint64)
            elif self.powers[1] == 1:
                self.powers = np.cumprod(np.concatenate(([_U64(1)], np.full(63, self.base))), dtype=np.uint64)
            firsts = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
            terms = (raw[inside].astype(np.uint64) + _U64(1)) * self.powers[place]
            return mixed(np.add.reduceat(terms, firsts) + sizes.astype(np.uint64))

    def shingles(self, text: str) -> np.ndarray:
        """The distinct shingles' hashes, ascending; a text of fewer words has one shingle of all of them."""
        h = self.word_hashes(text)
        n = min(self.words, len(h))
        if not n:
            return h
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                out = mixed(out * self.base + h[k : len(h) - n + 1 + k])
        return np.unique(out)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """The minwise token of each coordinate, in 8 bits."""
        low = (shingles >> _U64(32)).astype(np.uint32)
        least = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(low), 512):
                part = low[at : at + 512, None] * self.factors + self.shifts
                least = np.minimum(least, part.min(axis=0))
        return (mixed(least.astype(np.uint64)) >> _U64(56)).astype(np.uint8)


def key_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def picks(path: np.ndarray, second: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The coordinates that paths branch along: for all one, for the share second of paths another one. (where, coordinates) pairs."""
    a = mixed(path + _U64(0x9E37))
    b = mixed(path ^ _U64(0x5BD1E995))
    more = np.flatnonzero((a >> _U64(40)).astype(np.float64) < second * (1 << 24))
    first = (a & _U64(WIDTH - 1)).astype(np.int64)
    other = (first + 1 + (b % _U64(WIDTH - 1)).astype(np.int64)) % WIDTH
    return [(np.arange(len(path)), first), (more, other[more])]


def children(path: np.ndarray, sketches: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sketches and the paths on which they go on."""
    rows, paths = [], []
    for where, at in picks(path, second):
        rows.append(where)
        with np.errstate(over="ignore"):
            paths.append(mixed(path[where] * _M1 + (at.astype(np.uint64) << _U64(16)) + sketches[where, at].astype(np.uint64) + _U64(1)))
    return np.concatenate(rows), np.concatenate(paths)


def sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def trees_for(recall: float, similarity: float, levels: int = PLANNED_LEVELS) -> int:
    """Trees such that a pair at this similarity shares a node at the last level of one of them with this probability. A path goes on along one
    coordinate, or at times two, each of which keeps the pair with the similarity as probability: a branching process."""
    second, lost = 1 / similarity - 1, 0.0
    for _ in range(levels):
        lost = (1 - similarity * (1 - lost)) * (1 - second * similarity * (1 - lost))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost))) if lost > 0 else 1


def linked_groups(n: int, a: list[int], b: list[int]) -> Iterator[list[int]]:
    """The connected groups of two or more among n items with these links."""
    parent = list(range(n))
    for x, y in zip(a, b):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    groups: dict[int, list[int]] = {}
    for x in {*a, *b}:
        y = x
        while parent[y] != y:
            y = parent[y]
        groups.setdefault(y, []).append(x)
    yield from groups.values()


def similar_groups(members: np.ndarray, sketches: np.ndarray, agree: int) -> Iterator[np.ndarray]:
    """Groups of a small node that are connected by pairs whose sketches agree in so many places."""
    s = sketches[members]
    same = np.zeros((len(s), len(s)), np.int16)
    for at in range(0, len(s), 16):
        same[at : at + 16] = (s[at : at + 16, None] == s[None]).sum(axis=2)
    a, b = np.nonzero(np.triu(same >= agree, 1))
    for group in linked_groups(len(s), a.tolist(), b.tolist()):
        yield members[group]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections, as products of incidence matrices over stretches of the shingles."""
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(sets), len(sets)))
    step = 8192
    cuts = np.searchsorted(place, np.arange(0, int(place[-1]) + 1 + step, step))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        has = np.zeros((len(sets), step), np.float32)
        has[owner[lo:hi], place[lo:hi] - k * step] = 1
        out += has @ has.T
    return out.astype(np.int64)


def pivot_groups(members: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of members, each together with the first members."""
    step = LEAF - PIVOTS
    for at in range(PIVOTS, len(members), step):
        yield np.concatenate((members[:PIVOTS], members[at : at + step]))


def connecting(sets: list[np.ndarray], roots: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect what the links among all pairs of sets connect, besides what has the same root. Two blocks of sets meet at a time."""
    names = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    part = np.array([names[r] for r in roots])  # the component of each set so far
    order = np.argsort(part, kind="stable")
    size = np.array([len(s) for s in sets])
    step = LEAF if len(sets) <= LEAF else max(1, LEAF // 2)
    blocks = [order[at : at + step] for at in range(0, len(order), step)]
    out = []
    for i, one in enumerate(blocks):
        for two in blocks[i + 1 :] if i or len(blocks) > 1 else [one[:0]]:
            here = np.concatenate((one, two))
            if (part[here] == part[here[0]]).all():
                continue
            both, sizes = overlaps([sets[k] for k in here]), size[here]
            a, b = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None] - both), 1))
            for group in linked_groups(len(here), a.tolist(), b.tolist()):
                for k in group[1:]:
                    x, y = int(here[group[0]]), int(here[k])
                    if part[x] != part[y]:
                        out.append((x, y))
                        part[part == part[y]] = part[x]
    return out


def leaves(path: int, sketches: np.ndarray, second: float, level: int) -> Iterator[np.ndarray]:
    """The members of the small nodes under one node, and of those that stay large at the deepest level."""
    todo = [(path, np.arange(len(sketches)), level)]
    while todo:
        path, members, level = todo.pop()
        if len(members) <= LEAF:
            yield members
            continue
        here = np.full(len(members), path, np.uint64)
        if level >= DEEPEST:
            yield members
            continue
        rows, paths = children(here, sketches[members], second)
        order = np.argsort(paths, kind="stable")
        rows, paths = rows[order], paths[order]
        cuts = np.flatnonzero(np.diff(paths)) + 1
        for part, p in zip(np.split(rows, cuts), paths[np.concatenate(([0], cuts))]):
            if len(part) > 1:
                todo.append((int(p), members[part], level + 1))


def by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal values in the first column, over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != node[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def sets_of(df: DataFrame, id_col: str, text_col: str, words: int, marks: dict[str, Column]) -> DataFrame:
    """(id, marks, n_shingles, set_key, sketch) of each document; key and sketch are null for empty sets."""
    common.small_batches(df.sparkSession)

    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(words)
        kind = pa.struct([("n", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary())])
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                s = shingler.shingles(text or "")
                rows.append({"n": len(s), "key": key_of(s), "sketch": shingler.sketch(s).tobytes()} if len(s) else {"n": 0, "key": None, "sketch": None})
            yield pa.array(rows, kind)

    made_udf = F.arrow_udf(made, "struct<n:bigint,key:binary,sketch:binary>")
    read = df.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in marks.items()), made_udf(F.col(text_col)).alias("s"))
    return read.select("id", *marks, F.col("s.n").alias("n_shingles"), F.col("s.key").alias("set_key"), F.col("s.sketch").alias("sketch"))


def branch(nodes: DataFrame, second: float, levels: int, trees: int = 0) -> DataFrame:
    """(node, set_key, n_shingles) one or more levels below: from the roots of so many trees, or from each row's node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sketches = batch.column("set_key"), sketches_of(batch.column("sketch"))
            if trees:
                path = np.repeat(mixed(np.arange(1, trees + 1).astype(np.uint64)), len(keys))
                row = np.tile(np.arange(len(keys)), trees)
            else:
                path, row = batch.column("node").to_numpy().view(np.uint64), np.arange(len(keys))
            for _ in range(levels):
                at, path = children(path, sketches[row], second)
                row = row[at]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), keys.take(at), batch.column("n_shingles").take(at)], names=["node", "set_key", "n_shingles"])

    return nodes.mapInArrow(run, "node bigint, set_key binary, n_shingles bigint")


def small_nodes(reps: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame | None]:
    """(node, level, set_key) of nodes that fit in a task, such that each pair that reaches the similarity meets in some node with the target recall;
    and the (near, set_key) of nodes that stay large at the deepest level, which are also among the first in parts that share a pivot."""
    second = 1 / similarity - 1
    rows = common.cut(branch(reps.select("set_key", "n_shingles", "sketch"), second, FIRST_LEVELS, trees_for(recall, similarity)))
    level, ready, dense = FIRST_LEVELS, None, None
    sums = F.count("*").alias("count"), F.sum("n_shingles").alias("shingles"), *(F.bit_xor(F.xxhash64(F.lit(k), "set_key")).alias(f"members{k}") for k in (1, 2))
    fits = (F.col("count") <= NODE) & (F.col("shingles") <= NODE_SHINGLES)
    while True:
        sizes, seen = common.cut_seen(rows.groupBy("node").agg(*sums).where(F.col("count") > 1), F.count_if(~fits).alias("large"))
        # Small nodes with the same members are compared once; larger ones branch on, each in its own way.
        once = sizes.where(fits & (F.col("count") <= LEAF)).groupBy("count", "members1", "members2").agg(F.min("node").alias("node")).select("node")
        nodes = once.unionByName(sizes.where(fits & (F.col("count") > LEAF)).select("node"))
        found = rows.join(nodes.hint("shuffle_hash"), "node", "left_semi").select("node", F.lit(level).alias("level"), "set_key")
        ready = found if ready is None else ready.unionByName(found)
        if not seen["large"]:
            return ready, dense
        over = rows.join(sizes.where(~fits).select("node", F.greatest(F.col("count") / (NODE // 2), F.col("shingles") / (NODE_SHINGLES // 2)).cast("long").alias("parts")), "node")
        if level >= DEEPEST:  # nearly all alike: groups of a task's size, which connect most
            dense = over.select(F.col("node").alias("near"), "set_key")
            part = F.pmod(F.xxhash64("set_key"), F.col("parts") + 1)
            ready = ready.unionByName(over.select(F.xxhash64("node", part).alias("node"), F.lit(level).alias("level"), "set_key"))
            pivots = over.groupBy("node").agg(F.min("set_key").alias("set_key"), F.max("parts").alias("parts"))
            spread = pivots.select("node", "set_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts"))).alias("part"))
            return ready.unionByName(spread.select(F.xxhash64("node", "part").alias("node"), F.lit(level).alias("level"), "set_key")), dense
        rows = common.cut(branch(over.select("node", "set_key", "n_shingles").join(reps.select("set_key", "sketch"), "set_key"), second, 1))
        level += 1


def compared(nodes: DataFrame, held: DataFrame, similarity: float, words: int, percent: int) -> DataFrame:
    """(a, b, near) of all nodes: links that connect what is linked, with near null; and, with b null, the members a of groups near that
    stayed large inside a task. held has (set_key, sketch, packed)."""
    second = 1 / similarity - 1
    agree = math.floor(WIDTH * (similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / WIDTH)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for node in by_node(batches):
            if node.num_rows < 2:
                continue
            keys, packed, sketches = node.column("set_key").to_pylist(), node.column("packed").to_pylist(), sketches_of(node.column("sketch"))
            path, level = int(node.column("node")[0].as_py()) & 0xFFFFFFFFFFFFFFFF, node.column("level")[0].as_py()
            part, sets, a, b, near = np.arange(len(keys)), {}, [], [], []
            for members in leaves(path, sketches, second, level):
                large = len(members) > LEAF
                if large:
                    name = int.from_bytes(hashlib.blake2b(b"".join(sorted(keys[i] for i in members)), digest_size=8).digest(), "big", signed=True)
                    a, b, near = a + [keys[i] for i in members], b + [None] * len(members), near + [name] * len(members)
                for some in pivot_groups(members) if large else (members,):
                    for group in similar_groups(some, sketches, agree):
                        if (part[group] == part[group[0]]).all():
                            continue
                        for i in group:
                            if i not in sets:
                                sets[i] = shingler.shingles(zlib.decompress(packed[i]).decode())
                        for x, y in connecting([sets[i] for i in group], part[group].tolist(), percent):
                            a, b, near = [*a, keys[group[x]]], [*b, keys[group[y]]], [*near, None]
                            part[part == part[group[y]]] = part[group[x]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(near, pa.int64())], names=["a", "b", "near"])

    placed = nodes.join(held, "set_key").select("node", "level", "set_key", "sketch", "packed")
    return placed.repartition("node").sortWithinPartitions("node", "set_key").mapInArrow(run, "a binary, b binary, near bigint").distinct()


def dense_parts(dense: DataFrame, reps: DataFrame, known: DataFrame) -> DataFrame:
    """(near, set_key, root): groups of two parts each, such that all pairs of a dense group that are not connected already meet.
    known has the (set_key, root) of connected sets."""
    first = dense.groupBy("near").agg(F.min("set_key").alias("b"))
    stars = dense.join(first, "near").select(F.col("set_key").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()
    joined = components(stars).select("set_key", F.col("root").alias("cluster"))
    clusters = joined.unionByName(joined.select(F.col("cluster").alias("set_key"), "cluster").distinct())
    placed = clusters.join(known, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")).join(reps.select("set_key", "n_shingles"), "set_key")
    several = placed.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi"))
    placed = common.cut(placed.join(several.select("cluster"), "cluster", "left_semi"))
    # A component that fills more than a part has parts of its own, which needn't meet each other.
    fill = F.greatest(F.count("*") / max(1, NODE // 2), F.sum("n_shingles") / PART_SHINGLES)
    large = placed.groupBy("cluster", "root").agg(fill.alias("fill")).where(F.col("fill") > 1).select("cluster", "root", F.col("root").alias("own"))
    owned = placed.join(large, ["cluster", "root"], "left")
    fills = owned.groupBy("cluster", "own").agg(fill.alias("fill")).select(F.col("cluster").alias("c"), F.col("own").alias("o"), F.ceil("fill").alias("parts"))
    dealt = owned.join(fills, (F.col("cluster") == F.col("c")) & F.col("own").eqNullSafe(F.col("o")))
    dealt = common.cut(dealt.select("cluster", "own", "root", "set_key", F.pmod(F.xxhash64("set_key"), "parts").alias("part")))
    parts = dealt.select("cluster", "own", F.struct("own", "part").alias("p")).distinct()
    other = parts.select("cluster", F.col("own").alias("own2"), F.col("p").alias("q"))
    # Null is not a component: parts of small ones meet each other and, if alone, themselves.
    met = parts.join(other, "cluster").where((F.col("p") <= F.col("q")) & ~F.coalesce(F.col("own") == F.col("own2"), F.lit(False)))
    met = met.select("cluster", F.explode(F.array_distinct(F.array("p", "q"))).alias("p"), F.xxhash64("cluster", "p.own", "p.part", "q.own", "q.part").alias("near"))
    return dealt.select("cluster", "root", "set_key", F.struct("own", "part").alias("p")).join(met, ["cluster", "p"]).select("near", "set_key", "root")


def needed_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The docs (id, text) whose ids are, or whose hashes agree with, some of ids. A bitmap of FILTER_BITS bits goes to all tasks."""

    def placed(df: DataFrame) -> DataFrame:
        bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
        return df.withColumns({"bucket": F.bitmap_bucket_number(bit), "bit": F.bitmap_bit_position(bit)})

    bits = placed(ids).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    held = placed(docs).join(F.broadcast(bits), "bucket")  # FILTER_BITS / 8 bytes at most
    return held.where("shiftright(ascii(decode(substring(bits, int(bit div 8) + 1, 1), 'ISO-8859-1')), int(bit % 8)) & 1 = 1").select("id", "text")


def full_texts(nodes: DataFrame, reps: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(set_key, sketch, packed) of the nodes' sets: the whole text of each, compressed, from docs (id, text)."""
    needed = common.cut(reps.join(nodes.select("set_key").distinct(), "set_key", "left_semi").select("set_key", "rep", "sketch"))
    ids = needed.select(F.col("rep").alias("id"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = [key_of(shingler.shingles(text or "")) for text in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([zlib.compress((text or "").encode(), 1) for text in texts], pa.binary())], names=["set_key", "packed"])

    made = needed_documents(docs, ids).mapInArrow(packed, "set_key binary, packed binary")
    return made.groupBy("set_key").agg(F.any_value("packed").alias("packed")).join(needed.select("set_key", "sketch"), "set_key")


def confirmed(groups: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): pairs that connect what the links of each group connect; links are pairs whose full sets reach the similarity. If groups
    have the column root, sets with the same root are connected already."""
    root = F.col("root") if "root" in groups.columns else F.col("set_key")
    members = groups.join(texts.drop("sketch"), "set_key").select("near", "set_key", "packed", root.alias("root"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for group in by_node(batches):
            texts = dict(zip(group.column("set_key").to_pylist(), group.column("packed").to_pylist()))
            if len(texts) < 2:
                continue
            keys, arrays = list(texts), [shingler.shingles(zlib.decompress(t).decode()) for t in texts.values()]
            at = dict(zip(group.column("set_key").to_pylist(), group.column("root").to_pylist()))
            links = [(keys[x], keys[y]) for x, y in connecting(arrays, [at[k] for k in keys], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

    return members.repartition("near").sortWithinPartitions("near", "set_key").mapInArrow(linked, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """(set_key, root) of every key in a link: the smallest key that it is connected with, by alternating large and small stars.
    Minima are taken before the shuffle; a hub's rows meet in joins only, which Spark splits where they are skewed."""
    seen = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    edges, now = common.cut_seen(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), *seen)
    before = None
    while before != now:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
        large = common.cut(large.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = small.select("u", F.col("m").alias("v")).unionByName(small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges, now = common.cut_seen(pairs.where(F.col("u") != F.col("v")).distinct(), *seen)
    return edges.select(F.col("u").alias("set_key"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, marks: dict[str, Column] | None = None, recall: float = RECALL
) -> DataFrame:
    """(id, marks, n_shingles, class_key, component_id) of each document; component_id is the smallest id of its class, class_key
    tells classes apart and is null for empty sets. marks are columns that tell documents with the same id apart."""
    marks = marks or {}
    made = common.cut(sets_of(docs, id_col, text_col, words, marks))
    full = made.where(F.col("set_key").isNotNull())
    sums = F.min("id").alias("rep"), F.min("sketch").alias("sketch"), F.min("n_shingles").alias("n_shingles")
    reps = common.cut(full.groupBy("set_key").agg(*sums))
    nodes, dense = small_nodes(reps, percent / 100, recall)
    nodes = common.cut(nodes)
    texts = common.cut(full_texts(nodes if dense is None else nodes.select("set_key").unionByName(dense.select("set_key")), reps, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words))
    found, seen = common.cut_seen(compared(nodes, texts, percent / 100, words, percent), F.count("near").alias("dense"))
    links = found.where(F.col("near").isNull()).select("a", "b")
    known = components(links)
    if seen["dense"] or dense is not None:
        inner = found.where(F.col("near").isNotNull()).select("near", F.col("a").alias("set_key"))
        rest, pairs = common.cut_seen(dense_parts(inner if dense is None else inner.unionByName(dense), reps, known), F.count("*").alias("n"))
        if pairs["n"]:
            late, more = common.cut_seen(confirmed(rest, texts, words, percent), F.count("*").alias("n"))
            known = components(links.unionByName(late)) if more["n"] else known
    roots = reps.select("set_key", "rep").join(known, "set_key", "left").withColumn("class_key", F.coalesce("root", "set_key"))
    roots = common.cut(roots.drop("root"))
    ids = roots.groupBy("class_key").agg(F.min("rep").alias("component_id"))
    classes = roots.join(ids, "class_key").select("set_key", "class_key", "component_id")
    out = ["id", *marks, "n_shingles", "class_key", "component_id"]
    # Empty sets join nothing, so that their null keys don't meet in one task.
    alone = made.where(F.col("set_key").isNull()).withColumns({"class_key": F.col("set_key"), "component_id": F.col("id")})
    return full.join(classes, "set_key").select(*out).unionByName(alone.select(*out))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """docs with one document of each class: the one with the smallest id, ties by its text's hash; of equal rows one
    stays. Documents with an empty set all stay. All columns are kept, whatever their names."""
    marks = {"fp": F.xxhash64(text_col), "fp2": F.xxhash64(F.lit(7), text_col)}
    found = near_duplicates(docs, id_col, text_col, words, percent, marks, recall).where(F.col("class_key").isNotNull())
    chosen = found.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *marks)).alias("first")).select("first.id", *(f"first.{m}" for m in marks))
    # Rows travel as one struct, so that no name of theirs meets one of these.
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), *(c.alias(m) for m, c in marks.items()), F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("has_word"))

    def same(one: DataFrame, other: DataFrame) -> Column:
        return (one["fp"] == other["fp"]) & (one["fp2"] == other["fp2"]) & one["id"].eqNullSafe(other["id"])

    # Rows that repeat in id and text are few; only these are put in order to keep one. All others pass by a hashed side of ids.
    repeated = found.groupBy("id", *marks).count().where(F.col("count") > 1)
    once, more = common.cut(chosen.join(repeated, same(chosen, repeated), "left_anti")), common.cut(chosen.join(repeated, same(chosen, repeated), "left_semi"))
    worded = marked.where("has_word")
    several = worded.join(more, same(worded, more), "left_semi").groupBy("id", *marks).agg(F.any_value("row").alias("row"))
    kept = worded.join(once.hint("shuffle_hash"), same(worded, once), "left_semi").select("row.*")
    return kept.unionByName(several.select("row.*")).unionByName(marked.where(~F.col("has_word")).select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, words=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The query in SQL: all pairs of sets that share a shingle, and the closure of their links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
sets AS (SELECT min(r) AS k, s, min(doc_id) AS rep, len(s) AS n FROM (SELECT r, doc_id, list_sort(s) AS s FROM shingled WHERE len(s) > 0) GROUP BY s),
items AS (SELECT k, unnest(s) AS x FROM sets),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS met FROM items a JOIN items b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k),
links AS (SELECT a, b FROM shared JOIN sets sa ON sa.k = a JOIN sets sb ON sb.k = b WHERE 100 * met >= 85 * (sa.n + sb.n - met)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT k, k FROM sets UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
roots AS (SELECT a AS k, min(rep) AS component_id FROM reach JOIN sets ON sets.k = reach.b GROUP BY a)
SELECT doc_id, CAST(len(shingled.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) IS NOT DISTINCT FROM doc_id AS kept
FROM shingled LEFT JOIN sets ON sets.s = list_sort(shingled.s) LEFT JOIN roots ON roots.k = sets.k
"""
