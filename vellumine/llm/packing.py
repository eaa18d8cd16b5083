"""Best-fit packing of token sequences, improved by swap-based local search.

Documents become ids of a public byte-level BPE; those over the capacity are
cut into pieces of exactly that many ids, of which only the first is shorter.
Pieces are dealt into shards of bounded size by their number, so that no shard
grows with rows that repeat, and each shard is packed on its own: best fit over decreasing lengths first, then a local search that
moves pieces between underfull bins (one for none, one for one, two for one),
each time raising the sum of squared fills, until the emptiest bins run dry or
no exchange helps.  A shard costs at most a bin or so against packing all at
once, and shards are many pieces wide.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import tokens
from vellumine.plans.durable import materialise

#: Pieces that are packed together, about.
SHARD = 50_000

#: Longer texts (in characters) go to the ``tokenizers`` file itself.
FAST_CHARS = 50_000

_encoders: dict[tuple[str, str], object] = {}


def encoder(vocabulary: str, ranks: str):
    """A function from texts to lists of ids, the ids of the ``tokenizers`` file.

    The rank file holds the same vocabulary and merges; its library is about
    four times as fast, but its stack does not hold very long white space, so
    long texts go to the ``tokenizers`` file.  The one special token is matched
    inside texts, as that file does by default.
    """
    if (vocabulary, ranks) not in _encoders:
        import public_tokenizers
        import tiktoken
        import tokenizers

        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {"<|endoftext|>": len(table)}
        known = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        slow = tokenizers.Tokenizer.from_file(str(public_tokenizers.path(vocabulary)))

        def encode(text: str) -> list[int]:
            if len(text) > FAST_CHARS:
                return slow.encode(text, add_special_tokens=False).ids
            return known.encode(text, allowed_special="all") if "<|" in text else known.encode_ordinary(text)

        _encoders[vocabulary, ranks] = encode
    return _encoders[vocabulary, ranks]


def _tokenise(vocabulary: str, ranks: str, end: int, capacity: int):
    def run(batches):
        from pyspark import TaskContext

        encode, number = encoder(vocabulary, ranks), TaskContext.get().partitionId() << 40
        for batch in tokens.parts(batches, "text"):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist()):
                ids = np.array([*encode(text), end], dtype="<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), number))
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.int64()] * 4))], names=["doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([i])
            b, left = len(bins) - 1, capacity - size
        else:
            had = rooms[at]
            b = room[had].pop()
            if not room[had]:
                rooms.pop(at)
            bins[b].append(i)
            left = had - size
        if left:
            if not room[left]:
                bisect.insort(rooms, left)
            room[left].append(b)
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound: pieces over half the capacity share no bin, and the small ones must fill what is left.

    For each threshold k, pieces over capacity - k stand alone, those over half
    the capacity take a bin each, and pieces of k or more compete for the rest.
    """
    sizes = np.sort(np.asarray(lengths, dtype=np.int64))
    ahead = np.concatenate([[0], np.cumsum(sizes)])
    best = -(-int(ahead[-1]) // capacity)
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    for k in np.unique(np.concatenate([[0], sizes[:half]])):
        alone = int(np.searchsorted(sizes, capacity - k, side="right"))
        small = int(np.searchsorted(sizes, k))
        room = (alone - half) * capacity - (ahead[alone] - ahead[half])
        rest = ahead[half] - ahead[min(small, half)] - room
        best = max(best, len(sizes) - half + max(0, -(-int(rest) // capacity)))
    return best


class _Search:
    """Local search over the underfull bins."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.capacity = bins, capacity
        self.length = np.asarray(lengths, dtype=np.int64)
        self.bin_of = np.empty(len(lengths), dtype=np.int64)
        for k, b in enumerate(bins):
            self.bin_of[b] = k
        self.fill = np.array([self.length[b].sum() for b in bins], dtype=np.int64)

    def _apply(self, a: int, b: int, gives: list[int], takes: list[int]) -> None:
        """Bin b takes items of a and gives some back."""
        for source, target, items in ((a, b, takes), (b, a, gives)):
            for i in items:
                self.bins[source].remove(i)
                self.bins[target].append(i)
                self.bin_of[i] = target
                self.fill[source] -= self.length[i]
                self.fill[target] += self.length[i]

    def _offers(self, a: int) -> list[tuple[int, list[int]]]:
        """What the bin can give: (size, items), one or two items, each size once, largest first."""
        firsts: dict[int, list[int]] = {}
        for i in self.bins[a]:
            firsts.setdefault(int(self.length[i]), []).append(i)
        out = {size: [items[0]] for size, items in firsts.items()}
        sizes = sorted(firsts)
        for x, size in enumerate(sizes):
            for other in sizes[x + (len(firsts[size]) < 2) :]:
                out.setdefault(size + other, [firsts[size][0], firsts[other][1 if other == size else 0]])
        return sorted(out.items(), reverse=True)

    def _improve(self, a: int, pool: np.ndarray) -> bool:
        """One exchange from bin a into a bin at least as full, the one that gains most."""
        if not self.bins[a]:
            return False
        others = pool[self.bin_of[pool] != a]
        others = others[self.fill[self.bin_of[others]] >= self.fill[a]]
        low, free = self.length[others], self.capacity - self.fill[self.bin_of[others]]
        bins = np.flatnonzero((self.fill < self.capacity) & (self.fill >= self.fill[a]))
        bins = bins[bins != a]
        for size, items in self._offers(a):
            fits = bins[self.capacity - self.fill[bins] >= size]
            if len(fits):
                self._apply(a, int(fits[np.argmax(self.fill[fits])]), [], items)
                return True
            fits = np.flatnonzero((low < size) & (low + free >= size))
            if len(fits):
                i = int(others[fits[np.argmin(low[fits])]])
                self._apply(a, int(self.bin_of[i]), [i], items)
                return True
        return False

    def run(self) -> list[list[int]]:
        """Empty bins from the least filled on, while an exchange raises the sum of squares."""
        bound = least_bins(self.length.tolist(), self.capacity)
        moved = True
        while moved and np.count_nonzero(self.fill) > bound:
            moved = False
            under = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            pool = np.flatnonzero(np.isin(self.bin_of, under))
            for a in under[np.argsort(self.fill[under], kind="stable")].tolist():
                while self._improve(a, pool):
                    moved = True
                if np.count_nonzero(self.fill) <= bound:
                    break
        return [b for b in self.bins if b]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers with at most capacity in each."""
    return _Search(best_fit(lengths, capacity), lengths, capacity).run()


def _pack_shards(capacity: int):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        tokens.release()
        rows = pa.Table.from_batches(batches).combine_chunks()
        shards = np.asarray(rows.column("shard"))
        for shard in np.unique(shards):
            part = rows.filter(pa.array(shards == shard)).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            lengths = part.column("length").to_pylist()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for b, members in enumerate(pack(lengths, capacity)):
                at = 0
                for i in members:
                    sequence[i], offset[i] = (int(shard) << 32) + b, at
                    at += lengths[i]
            part = part.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from part.to_batches()

    return run


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", end: int = 2) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A document's ids are those of its whole text, then ``end``; null and empty
    texts are that one id.  Documents over ``capacity`` are cut, nothing is
    dropped.  Rows with a null id and repeated rows are documents of their own;
    extra columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = materialise(rows.mapInArrow(_tokenise(vocabulary, ranks, end, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, number long"))
    shards = max(1, -(-pieces.count() // SHARD))
    # numbers are written, so a task that runs again deals alike; one shard to a partition or several whole ones
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards))).drop("number")
    return dealt.repartition(shards, "shard").mapInArrow(_pack_shards(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
