"""N-gram Jaccard join: a count-vector R-tree over shingle sets.

Documents with the same shingle set are one node.  Two nodes link when the
Jaccard similarity of their sets reaches a threshold.  The steps:

1. *Signatures*: each set gives its size, a 64-bit fingerprint (the node) and
   its count vector: shingles are hashed into ``GROUPS`` groups and counted.
2. *Routing*: two sets over the threshold share one of their first
   ``n - ceil(t n) + 1`` shingles in any common order.  The order is rarest
   bucket first, over bucket counts of the whole corpus, so that passages that
   many documents share route next to nothing.  Routing shingles travel packed,
   as sorted gaps per task and partition.  Nodes that share one form a block; a
   pair whose sizes and places in the order leave too few shingles in common is
   none.  Shingles of buckets far over the usual are dealt out by node instead,
   so no task ever holds a block of unbounded size.
3. *R-tree*: larger blocks are bulk-loaded into a tree of bounding boxes over the
   count vectors.  The overlap of two sets is at most the sum of coordinate
   minima, and that of a set with all below a box at most the sum of minima
   with the box's upper corner; both must reach ``t / (1 + t) * (n + m)``.
4. *Verification*: surviving pairs are checked on their full sets.

Where only reachability is wanted, steps 3 and 4 run in three passes.  The first
takes all pairs of blocks of up to ``SMALL`` nodes, and of larger ones a chain
and two stars, by the bound of single pairs.  The second loads blocks that still
hold several components into trees; it takes all surviving pairs of different
components of blocks with few, and of the others each node's best.  The last
takes all surviving pairs of different components of what is left.  Boxes whose
nodes all have the label of the query are skipped, and so are blocks with one
label.  So a group of thousands of near copies costs about as many pairs as it
has members, while no pair that could join two components is left out.

Blocks over ``BLOCK`` nodes are dealt out in chunks.  Nodes of the block's
largest component stand in their own chunk alone, the others in all chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import packed, tokens
from vellumine.operators.components import connected_components
from vellumine.plans.durable import discard, materialise
from vellumine.plans.skew import meet

#: Coordinates of a count vector.
GROUPS = 256
#: Corpus-wide frequency buckets; their counts (8 MB) are broadcast.
BUCKET_BITS = 20
#: Routing shingles per partition, about, and those that a task packs at once.
PART_KEYS, FLUSH_KEYS = 500_000, 1_000_000
#: Documents over a bucket's usual count from which its shingles are dealt out by node.
HOT = 50_000
#: Nodes of a chunk of a block, about; a task takes two chunks at once.
BLOCK = 2048
#: Blocks of up to so many members give all their pairs at once.
SMALL = 4
#: Surviving pairs per member up to which a larger block is decided in the first tree pass.
FEW = 4
#: Pairs that a task gathers before it passes them on.
PAIRS = 100_000
#: Children of a box.
FANOUT = 16
#: Ids that may be broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000


def _sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each row."""
    data, rows = tokens.utf8(batch.column(column))
    words, _, _, first = tokens.word_hashes(data, rows, tokens.SPACED)
    for i in range(batch.num_rows):
        yield np.unique(tokens.shingle_hashes(words[first[i] : first[i + 1]], width))


def _node(shingles: np.ndarray) -> int:
    """A fingerprint of a set."""
    with np.errstate(over="ignore"):
        weights = tokens.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        both = tokens.mix(np.array([weights.sum() ^ np.uint64(len(shingles)), np.bitwise_xor.reduce(weights)], dtype=np.uint64))
        return int(tokens.mix(both[:1] * np.uint64(3) + both[1:])[0].view(np.int64))


def _vector(shingles: np.ndarray) -> bytes:
    """Counts per group, in the fewest bits that hold them all: 4, 8, 16 or 32."""
    counts = np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    most = counts.max(initial=0)
    if most < 16:
        return (counts[0::2] << 4 | counts[1::2]).astype("u1").tobytes()
    return counts.astype("u1" if most < 256 else "<u2" if most < 65536 else "<u4").tobytes()


def _vectors(column: pa.Array) -> np.ndarray:
    out = np.empty((len(column), GROUPS), dtype=np.int32)
    for k, x in enumerate(column):
        raw = x.as_buffer()
        if raw.size < GROUPS:
            pairs = np.frombuffer(raw, dtype="u1")
            out[k, 0::2], out[k, 1::2] = pairs >> 4, pairs & 15
        else:
            out[k] = np.frombuffer(raw, dtype={1: "u1", 2: "<u2", 4: "<u4"}[raw.size // GROUPS])
    return out


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _needed(n: int, t: Fraction) -> int:
    return math.ceil(t * n)


def _signatures(id_column: str, text_column: str, width: int):
    def run(batches):
        totals = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in tokens.parts(batches, text_column):
            size, node, vector = [], [], []
            for s in _sets(batch, text_column, width):
                size.append(len(s))
                node.append(_node(s) if len(s) else None)
                vector.append(_vector(s) if len(s) else None)
                np.add.at(totals, _buckets(s), 1)
            none = pa.nulls(len(size), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(vector, pa.binary()), none], names=["doc_id", "n", "node", "vector", "totals"])
        if totals.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([totals.astype("<u4").tobytes()], pa.binary())], names=["doc_id", "n", "node", "vector", "totals"])

    return run


def _sum_totals(batches):
    """One partial sum per task, so that few vectors meet anywhere."""
    out = None
    for batch in batches:
        for x in batch.column("totals").to_pylist():
            x = np.frombuffer(x, dtype="<i8" if len(x) == 8 << BUCKET_BITS else "<u4").astype(np.int64)
            out = x if out is None else out + x
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<i8").tobytes()], pa.binary())], names=["totals"])


def _bucket_counts(totals: DataFrame) -> np.ndarray:
    """Shingles per bucket over the corpus: a vector of fixed size."""
    for n in (64, 8, 1):
        totals = totals.coalesce(n).mapInArrow(_sum_totals, "totals binary")
    rows = totals.collect()
    return np.frombuffer(rows[0][0], dtype="<i8") if rows else np.zeros(1 << BUCKET_BITS, dtype=np.int64)


def _route(text_column: str, width: int, t: Fraction, counts, bits: int, parts: int, excess: int):
    """Routing shingles as rows (part, payload): keys, nodes, sizes, and places in the common order.

    Keys are cut to ``bits`` bits, so rarely two shingles share one; that adds
    to blocks and takes nothing from them.  Parts from ``parts`` on are those of
    hot shingles, dealt by node.
    """

    def run(batches):
        weight = counts.value
        hot = np.median(weight) + excess
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush():
            keys, warm, lengths = (np.concatenate([h[k] for h in held]) if k < 2 else np.array([len(h[0]) for h in held]) for k in range(3))
            nodes = np.repeat(np.array([h[2] for h in held], dtype=np.int64), lengths)
            sizes = np.repeat(np.array([h[3] for h in held], dtype=np.uint32), lengths)
            places = (np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint32)
            part = np.where(warm, parts + (tokens.mix(nodes.view(np.uint64)) % np.uint64(parts)).astype(np.int64), (keys % np.uint64(parts)).astype(np.int64))
            order = np.lexsort((keys, part))
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            rows = [(int(part[x[0]]), packed.dump(packed.gaps(keys[x]), nodes[x], sizes[x], places[x])) for x in np.split(order, cuts)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "payload"])

        for batch in tokens.parts(batches, text_column):
            for s in _sets(batch, text_column, width):
                n = len(s)
                if not n or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                length = n - _needed(n, t) + 1
                rare = weight[_buckets(s)]
                near = np.flatnonzero(rare <= np.partition(rare, length - 1)[length - 1]) if length < n else np.arange(n)
                first = near[np.lexsort((s[near], rare[near]))[:length]]
                held.append((tokens.mix(s[first] ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(64 - bits), rare[first] > hot, node, n))
                size += length
                if size >= FLUSH_KEYS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


_MET = "kind string, a long, b long, key long, nodes array<long>"


def _met(kind: str, n: int, **columns) -> pa.Table:
    kinds = {"a": pa.int64(), "b": pa.int64(), "key": pa.int64(), "nodes": pa.list_(pa.int64())}
    return pa.table({"kind": pa.array([kind] * n, pa.string())} | {c: pa.array(columns[c], x) if c in columns else pa.nulls(n, x) for c, x in kinds.items()})


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, the smaller node first, each once."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[new], high[new]


def _meet(t: Fraction, parts: int, small: int):
    """Over the routing shingles of one part: pairs to check, and blocks of more than small nodes."""
    p, q = t.numerator, t.denominator

    def run(key, table):
        tokens.release()
        loaded = [packed.load(x.as_buffer()) for x in table.column("payload")]
        keys = np.concatenate([packed.keys(x[0]) for x in loaded])
        nodes, sizes, places = (np.concatenate([x[k] for x in loaded]) for k in (1, 2, 3))
        if key[0].as_py() >= parts:
            return _met("hot", len(keys), key=keys.view(np.int64), a=nodes)
        order = np.lexsort((places, nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        order = order[new]
        keys, nodes, sizes, places = keys[new], nodes[new], sizes[order].astype(np.int64), places[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        members = np.diff(np.append(first, len(keys)))
        left, right = [], []
        for m in range(2, small + 1):
            at = first[members == m]
            for i in range(m):
                for j in range(i + 1, m):
                    # all shingles in common stand at these places or after them, if this is the first
                    both = -(-p * (sizes[at + i] + sizes[at + j]) // (p + q))
                    ok = (sizes[at + i] - places[at + i] >= both) & (sizes[at + j] - places[at + j] >= both)
                    left.append(nodes[at + i][ok])
                    right.append(nodes[at + j][ok])
        blocks: dict[bytes, tuple[int, np.ndarray]] = {}
        for at, m in zip(first[members > small].tolist(), members[members > small].tolist()):
            own, n = nodes[at : at + m], sizes[at : at + m]
            if (raw := own.tobytes()) in blocks:
                continue
            blocks[raw] = int(keys[at]), own
            chain = np.lexsort((own, n))
            for hub in (0, int(chain[m // 2])):
                left.append(np.full(m, own[hub]))
                right.append(own)
            left.append(own[chain[:-1]])
            right.append(own[chain[1:]])
        a, b = _once(np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2
        a, b = a[a != b], b[a != b]
        lists = list(blocks.values())
        names = [int(tokens.mix(_signature(x)).view(np.int64)[0]) for _, x in lists]
        ends = np.cumsum([0, *(len(x) for _, x in lists)])
        flat = np.concatenate([x for _, x in lists]) if lists else np.zeros(0, np.int64)
        out = _met("block", len(lists), key=names, nodes=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())))
        return pa.concat_tables([_met("pair", len(a), a=a, b=b), out])

    return run


def _signature(nodes: np.ndarray) -> np.ndarray:
    """A hash of a sorted list of nodes: blocks with the same members have one name."""
    with np.errstate(over="ignore"):
        x = tokens.mix(nodes.view(np.uint64) + np.arange(len(nodes), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.array([x.sum() ^ np.uint64(len(nodes))], dtype=np.uint64)


class CountTree:
    """A static R-tree over count vectors, stored level by level.

    Points are packed in the order of (label, size, first coordinates), by label
    only where labels are shared.  A box
    keeps the upper corner, the range of sizes, and the label if it is one.
    """

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        few = len(np.unique(labels)) * 2 < len(labels)
        self.order = np.lexsort((vectors[:, 1], vectors[:, 0], sizes, labels if few else sizes))
        top, low, high, label = vectors[self.order], sizes[self.order], sizes[self.order], labels[self.order]
        mixed = np.zeros(len(low), dtype=bool)
        self.levels = [(top, low, high, label, mixed)]
        while len(low) > FANOUT:
            at = np.arange(0, len(low), FANOUT)
            first, last = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            mixed = np.logical_or.reduceat(mixed, at) | (first != last)
            top, low, high, label = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), first
            self.levels.append((top, low, high, label, mixed))

    def search(self, size: int, vector: np.ndarray, label: int, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """Points that may link with the query and have another label, with their bounds."""
        p, q = t.numerator, t.denominator
        found = np.arange(len(self.levels[-1][1]))
        bound = found
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, labels, mixed = self.levels[depth]
            keep = (mixed[found] | (labels[found] != label)) & (low[found] * p <= size * q) & (high[found] * q >= size * p)
            found = found[keep]
            bound = np.minimum(top[found], vector).sum(axis=1)
            keep = bound * (p + q) >= p * (size + np.maximum(low[found], -(-size * p // q)))
            found, bound = found[keep], bound[keep]
            if depth and len(found):
                found = (found[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                found = found[found < len(self.levels[depth - 1][1])]
        return self.order[found], bound


def _within_bound(t: Fraction):
    """Of pairs with both sizes and vectors, those whose bound does not rule a link out."""
    p, q = t.numerator, t.denominator

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                some = batch.slice(i, 4096)
                bound = np.minimum(_vectors(some.column("left")), _vectors(some.column("right"))).sum(axis=1)
                n, m = np.asarray(some.column("n")), np.asarray(some.column("m"))
                yield some.select(["a", "b"]).filter(pa.array(bound * (p + q) >= p * (n + m)))

    return run


def _propose(own, nodes, sizes, vectors, labels, first: bool, t: Fraction, mode: str, few: int) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Pairs of one cell that need a check, of an own node and one of another label; None if these are not all.

    Pairs of two own nodes are those of the chunk's first cell alone.
    """
    mine, pool = np.flatnonzero(own), np.arange(len(nodes)) if first else np.flatnonzero(~own)
    if not len(mine) or not len(pool):
        return
    tree = CountTree(sizes[pool], vectors[pool], labels[pool])

    def search(i):
        found, bound = tree.search(int(sizes[i]), vectors[i], int(labels[i]), t)
        found = pool[found]
        # two own nodes find each other
        keep = ~own[found] | (nodes[found] > nodes[i])
        return found, bound, found[keep]

    if mode == "best":
        held, best, total = [], [], 0
        for i in mine:
            found, bound, kept = search(i)
            total += len(kept)
            if total <= few * len(nodes):
                held.append((np.full(len(kept), nodes[i]), nodes[kept]))
            if len(found):
                best.append((nodes[i], nodes[found[np.argmax(bound / (sizes[i] + sizes[found] - bound))]]))
        if total <= few * len(nodes):
            yield from held
        else:
            yield tuple(np.array(best, dtype=np.int64).T)
            yield None
    else:
        for i in mine:
            kept = search(i)[2]
            yield np.full(len(kept), nodes[i]), nodes[kept]


def _chunk_pairs(t: Fraction, mode: str, few: int):
    """Over partitions sorted by (key, chunk, lane): propose pairs; (key, null) tells that a block is not decided."""

    def run(batches):
        tokens.release()
        held, name, out, size = [], None, [], 0

        def flush():
            own, nodes, sizes, vectors, labels = (np.concatenate([h[k] for h in held]) for k in range(5))
            for found in _propose(own, nodes, sizes, vectors, labels, name[2] == 0, t, mode, few):
                yield found or (np.array([name[0]]), None)

        def done():
            pairs = _once(*(np.concatenate([x[k] for x in out]) for k in (0, 1))) if out else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=["a", "b"])

        def gathered(found):
            nonlocal out, size
            for a, b in found:
                if b is None:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(1, pa.int64())], names=["a", "b"])
                    continue
                out.append((a, b))
                size += len(a)
                if size >= PAIRS:
                    yield done()
                    out, size = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([np.asarray(batch.column(c)) for c in ("key", "chunk", "lane")])
            own, nodes, sizes, labels = (np.asarray(batch.column(c)) for c in ("own", "node", "n", "label"))
            vectors = _vectors(batch.column("vector"))
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and name != tuple(place[:, a]):
                    yield from gathered(flush())
                    held = []
                name = tuple(place[:, a])
                held.append((own[a:b] == 1, nodes[a:b], sizes[a:b], vectors[a:b], labels[a:b]))
        if held:
            yield from gathered(flush())
        yield done()

    return run


def _full_sets(text_column: str, width: int):
    """The sets of rows that are the node that is wanted; an id may stand on other texts too."""

    def run(batches):
        for batch in tokens.parts(batches, text_column):
            sets = list(_sets(batch, text_column, width))
            right = pa.array([len(s) > 0 and _node(s) == node for s, node in zip(sets, batch.column("node").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"]).filter(right)

    return run


def _check(t: Fraction):
    p, q = t.numerator, t.denominator

    def run(batches):
        for batch in batches:
            keep = []
            for x, other in zip(batch.column("left"), batch.column("right")):
                x = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(other.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(q * both >= p * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Join:
    """The nodes of a table of documents, and what may link them."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str, width: int, threshold: float):
        self.t, self.width, self.spark = Fraction(threshold).limit_denominator(1000), width, docs.sparkSession
        self.docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        #: Tables to discard at the end, and those that results read.
        self.spent: list[str] = []
        self.read: list[str] = []
        signed = materialise(self.docs.mapInArrow(_signatures("doc_id", "text", width), "doc_id long, n long, node long, vector binary, totals binary"), self.read)
        self.totals = signed.where("totals is not null").select("totals")
        self.sizes = signed.where("totals is null")
        usable = self.sizes.where("node is not null and doc_id is not null")
        self.nodes = materialise(usable.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("vector").alias("vector")), self.spent)

    def candidates(self, small: int) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) within the bound, and blocks (key, node): all that may link, and is no such pair, shares a block."""
        t, spark, old = self.t, self.spark, []
        counts = spark.sparkContext.broadcast(_bucket_counts(self.totals))
        length = F.col("n") - F.floor((F.col("n") * t.numerator + t.denominator - 1) / t.denominator).cast("long") + 1
        total = self.nodes.agg(F.sum(length)).first()[0] or 0
        parts, bits = max(1, -(-total // PART_KEYS)), min(64, total.bit_length() + 16)
        routed = self.docs.where("doc_id is not null").select("text").mapInArrow(_route("text", self.width, t, counts, bits, parts, HOT), "part long, payload binary")
        met = materialise(routed.groupBy("part").applyInArrow(_meet(t, parts, small), _MET), old, partition_by=["kind"])
        lists = met.where("kind = 'block'").select("key", "nodes").dropDuplicates(["key"])
        hot = met.where("kind = 'hot'").select("key", F.col("a").alias("node")).distinct()
        blocks = materialise(lists.select("key", F.explode("nodes").alias("node")).union(hot), self.spent)
        hubs = hot.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("members"))
        stars = meet(hot, hubs, ["key"], "members", kept=self.spent).where("a != node").select("a", F.col("node").alias("b"))
        pairs = self.bounded(met.where("kind = 'pair'").select("a", "b").union(stars).distinct())
        discard(spark, old)
        return pairs, blocks

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose count vectors do not rule a link out."""
        left = self.nodes.select(F.col("node").alias("a"), F.col("n"), F.col("vector").alias("left"))
        right = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("vector").alias("right"))
        return materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "left", "right").mapInArrow(_within_bound(self.t), "a long, b long"), self.spent)

    def surviving(self, live: DataFrame, mode: str) -> DataFrame:
        """Pairs of different labels of blocks (key, members, others, largest, node, label), by trees over cells.

        All nodes of a block are dealt into chunks, and those outside its largest
        component into lanes too.  A cell is a chunk and a lane, so it holds a
        bounded number of nodes whatever the size of the block, and every pair of
        different components meets in one.
        """
        chunks, lanes = (F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int") for c in ("members", "others"))
        dealt = live.withColumn("chunks", chunks).withColumn("lanes", lanes)
        dealt = dealt.withColumn("home", F.pmod(F.hash("node"), F.col("chunks"))).withColumn("side", F.pmod(F.xxhash64("node"), F.col("lanes")).cast("int"))
        own = F.transform(F.sequence(F.lit(0), F.col("lanes") - 1), lambda x: F.struct(F.col("home").alias("chunk"), x.alias("lane")))
        other = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(x.alias("chunk"), F.col("side").alias("lane")))
        cells = F.when(F.col("label").eqNullSafe(F.col("largest")), own).otherwise(F.array_union(own, other))
        dealt = dealt.select("key", "node", "label", "home", F.inline(cells))
        dealt = dealt.join(self.nodes.select("node", "n", "vector"), "node").select("key", "chunk", "lane", (F.col("chunk") == F.col("home")).cast("int").alias("own"), "node", "n", "vector", "label")
        dealt = dealt.repartition("key", "chunk", "lane").sortWithinPartitions("key", "chunk", "lane")
        return materialise(dealt.mapInArrow(_chunk_pairs(self.t, mode, FEW), "a long, b long").distinct(), self.spent)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets link.  Only texts of nodes in pairs are moved."""
        old: list[str] = []
        ends = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(self.nodes.select("node", "rep"), "node"), old)
        small = ends.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        picked = self.docs.join(F.broadcast(ends) if small else ends, self.docs["doc_id"] == ends["rep"]).select("node", "text")
        # dealt by node once, for the rows that repeat an id and for both ends of the pairs
        sets = picked.mapInArrow(_full_sets("text", self.width), "node long, shingles binary").dropDuplicates(["node"])
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
        links = materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_check(self.t), "a long, b long"), self.spent)
        discard(self.spark, old)
        return links


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, threshold: float = 0.8, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of docs.

    ``keep`` collects the paths of the tables that the result reads, for a caller to discard.

    Words are runs of anything but white space, A-Z lowered; shingles are
    ``width`` consecutive words, or the whole sequence where it is shorter.
    ``component_id`` is the smallest id that links reach, itself included.

    Null and empty texts, and those of white space alone, have no shingles and
    link with nothing; rows with a null id link with nothing and have a null
    component.  Repeated rows are copies of one another; an id on several texts
    is each of them, and each row has the component of its own text.  Extra
    columns are ignored; an empty table gives an empty one.  Texts of any length
    are taken whole.
    """
    join = _Join(docs, id_column, text_column, width, threshold)
    spark, nodes = join.spark, join.nodes
    labels = nodes.select("node", F.col("node").alias("label"))
    pairs, blocks = join.candidates(SMALL)
    tried = pairs
    for mode in ("", "best", "all"):
        if mode:
            old: list[str] = []
            labelled = materialise(blocks.join(labels, "node"), old)
            held = labelled.groupBy("key", "label").agg(F.count("*").alias("k"))
            opened = held.groupBy("key").agg(F.sum("k").alias("members"), F.count("*").alias("labels"), (F.sum("k") - F.max("k")).alias("others"), F.max_by("label", "k").alias("largest")).where("labels > 1")
            live = materialise(meet(labelled, opened.drop("labels"), ["key"], "members", kept=old), old)
            if live.isEmpty():
                discard(spark, old)
                break
            found = join.surviving(live, mode)
            discard(spark, old)
            if mode == "best":
                blocks = materialise(blocks.join(found.where("b is null").select(F.col("a").alias("key")), "key"), join.spent)
            pairs = materialise(found.where("b is not null").join(tried, ["a", "b"], "left_anti"), join.spent)
            tried = tried.union(pairs)
        if not pairs.isEmpty():
            labels = materialise(_relabel(labels, join.verified(pairs)), join.spent)
    known = nodes.select("node", "rep", "copies").join(labels, "node")
    lowest = materialise(known.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), join.spent)
    found = materialise(meet(known, lowest, ["label"], "members", kept=join.spent).select("node", "component_id", "copies"), join.read)
    discard(spark, join.spent)
    named = meet(join.sizes, found, ["node"], "copies", "left", join.read)
    if keep is not None:
        keep += join.read
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def jaccard_links(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Every link: pairs ``(a, b)`` of classes, and ``(doc_id, class_id, n_links)`` per row of docs.

    A class holds the documents of one shingle set, and its id is a number of
    its own, as a smallest doc_id may stand on several texts.  ``n_links`` counts
    the other rows that a row links with, those of its own class included.
    Copies are not expanded into pairs; links between different sets are all
    found, so a group of n near copies gives up to n (n - 1) / 2 of them.

    Rows without shingles or with a null id have a null class and no links;
    the rest is as in ``jaccard_components``.
    """
    join = _Join(docs, id_column, text_column, width, threshold)
    pairs, blocks = join.candidates(SMALL)
    members = blocks.groupBy("key").agg(F.count("*").alias("members"), F.count("*").alias("others"))
    alone = meet(blocks, members, ["key"], "members", kept=join.spent).withColumn("label", F.col("node")).withColumn("largest", F.lit(None).cast("long"))
    found = join.surviving(alone, "all")
    links = join.verified(materialise(pairs.union(found).distinct(), join.spent))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = join.nodes.select(F.col("node").alias("b"), "copies")
    reach = both.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    classes = materialise(join.nodes.select("node", "copies").join(reach, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    named = join.sizes.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("node")))
    per_row = named.join(classes.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return links, per_row


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after joining the components that links connect."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    merged = connected_components(ends.select("x", "y"), "x", "y").select(F.col("node").alias("label"), "component")
    return labels.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of docs without those whose component has a smaller doc_id.

    Of rows that repeat a doc_id, all or none stay.
    """
    old: list[str] = []
    found = materialise(jaccard_components(docs, width=width, threshold=threshold, keep=old).where("doc_id != component_id").select("doc_id").distinct())
    discard(docs.sparkSession, old)
    small = found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(found) if small else found, "doc_id", "left_anti").select(*docs.columns)
