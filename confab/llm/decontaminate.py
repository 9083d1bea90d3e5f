"""Benchmark decontamination by SimHash windows the size of an item.

Every window of a document that holds at least one shingle of the benchmark gets a 64-bit SimHash of its weighted shingles, one
for each item size; a document shorter than an item, but not too short to reach the similarity, is one window.
Fingerprints are split into blocks; two within the radius agree up to radius // blocks bits in at least one
block, and a table of all values that near, block by block, finds every item within the radius. What is found is
verified by the exact similarity of the weighted shingle sets, the sum of the smaller counts over that of the larger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.common import lean
from confab.llm.texts import WordHash, shingles, texts_of

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
#: Pairs at SIMILARITY differ in 9.7 +- 2.9 bits; the radius lies 2.5 deviations above.
RADIUS = 17
BLOCKS = 6
#: Items an index holds; a larger benchmark is searched for in so many passes.
MAX_ITEMS = 5_000
FILTER_BITS = 22
#: Windows of a text that are compared at a time; bounds the memory that a long text takes.
STEP = 1 << 14


def bit_rows(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 signs (+1, -1) for each hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def simhash(hashes: np.ndarray) -> int:
    return int(packed(bit_rows(hashes).sum(axis=0, keepdims=True))[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


class ItemIndex:
    """Items by shingle length, window size and fingerprint."""

    def __init__(self, items: list[tuple[int | None, bytes]], radius: int = RADIUS, blocks: int = BLOCKS, threshold: float = SIMILARITY):
        words, self.radius, self.threshold = WordHash(), radius, threshold
        rows = []
        for item, text in items:
            hashed = words.of(text.lower().split())
            if len(hashed):
                size = min(SHINGLE, len(hashed))
                rows.append((item, size, shingles(hashed, size, salt=size)))
        self.items = [r[0] for r in rows]
        self.sets = [r[2] for r in rows]
        self.prints = np.array([simhash(s) for s in self.sets], dtype=np.uint64)
        self.classes = sorted({(r[1], len(r[2])) for r in rows})
        lanes = -(-len(rows) // 64)
        self.members = {}
        for c in self.classes:
            flags = np.zeros(lanes * 64, np.uint8)
            flags[[i for i, r in enumerate(rows) if (r[1], len(r[2])) == c]] = 1
            self.members[c] = np.packbits(flags, bitorder="little").view("<u8")
        self.known = {s: np.unique(np.concatenate([r[2] for r in rows if r[1] == s])) for s in {r[1] for r in rows}}
        self.filters = {}
        for s, hashes in self.known.items():
            table = np.zeros(1 << FILTER_BITS, bool)
            table[hashes & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.filters[s] = table
        edges = np.linspace(0, BITS, blocks + 1).astype(int)
        self.cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        self.tables = [self._near(lo, hi - lo, radius // blocks, lanes) for lo, hi in self.cuts]

    def _near(self, low: int, width: int, reach: int, lanes: int) -> np.ndarray:
        """For each block value, the items (as bits) whose block differs in at most ``reach`` bits."""
        flips = [sum(1 << b for b in c) for r in range(reach + 1) for c in combinations(range(width), r)]
        table = np.zeros((1 << width, lanes), np.uint64)
        for i, value in enumerate(((self.prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).tolist()):
            table[[value ^ f for f in flips], i // 64] |= np.uint64(1 << (i % 64))
        return table

    def candidates(self, prints: np.ndarray, members: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in ``prints``, item number) of all pairs within the radius."""
        found = np.zeros((len(prints), len(members)), np.uint64)
        for (lo, hi), table in zip(self.cuts, self.tables, strict=True):
            found |= table[(prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)]
        found &= members
        at, lane = np.nonzero(found)
        for lo in range(0, len(at), STEP):
            w, k = at[lo : lo + STEP], lane[lo : lo + STEP]
            i, bit = np.nonzero(np.unpackbits(found[w, k].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            w, items = w[i], k[i] * 64 + bit
            near = np.bitwise_count(prints[w] ^ self.prints[items]) <= self.radius
            yield from zip(w[near].tolist(), items[near].tolist(), strict=True)

    def _near_windows(self, hashes: np.ndarray, hits: np.ndarray, classes: list[tuple[int, int]], size: int, lo: int) -> Iterator[tuple[int, int, int]]:
        """(width, start, item number) of the candidates among the windows that start in ``lo`` to ``lo`` + STEP and hold a benchmark shingle."""
        votes = None
        for m, width in classes:
            hi = min(lo + STEP, len(hits) - width)
            starts = lo + np.flatnonzero(hits[lo + width : hi + width] > hits[lo:hi]) if hi > lo else hits[:0]
            if not len(starts):
                continue
            if votes is None:
                longest = max(w for _, w in classes)
                own = bit_rows(hashes[lo : lo + STEP + longest])
                votes = np.zeros((len(own) + 1, BITS), np.int32)
                np.cumsum(own, axis=0, out=votes[1:])
            prints = packed(votes[starts - lo + width] - votes[starts - lo])
            for w, item in self.candidates(prints, self.members[(size, m)]):
                yield width, int(starts[w]), item

    def search(self, words: np.ndarray) -> list[tuple[int | None, int, float]]:
        """(item, start, similarity) of the best window of each item found in a text's word hashes, by item, null last; the first on ties."""
        best: dict[int, tuple[float, int]] = {}
        for size, known in self.known.items():
            hashes = shingles(words, size, salt=size)
            hit = self.filters[size][hashes & np.uint64((1 << FILTER_BITS) - 1)]
            if not hit.any():
                continue
            some = hashes[hit]
            hit[hit] = known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some
            if not hit.any():
                continue
            hits = np.r_[0, np.cumsum(hit)]
            classes = [(m, min(m, len(hashes))) for s, m in self.classes if s == size and min(m, len(hashes)) / m >= self.threshold]
            for lo in range(0, len(hashes), STEP):
                for width, at, item in self._near_windows(hashes, hits, classes, size, lo):
                    sim = similarity(hashes[at : at + width], self.sets[item])
                    if sim >= self.threshold and (sim, -at) > (best.get(item, (0.0, 0))[0], -best.get(item, (0.0, 0))[1]):
                        best[item] = (sim, at)
        return sorted(((self.items[i], at, sim) for i, (sim, at) in best.items()), key=lambda f: (f[0] is None, f[0] or 0, *f[1:]))


def indexes(benchmark: DataFrame, **options) -> list:
    """Broadcast indexes over all items, MAX_ITEMS or so in each. Items without an id are searched for as well; null texts hold nothing."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null")
    parts = max(1, -(-items.count() // MAX_ITEMS))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    out = []
    for p in range(parts):
        rows = items.filter(slot == p).collect()
        out.append(spark.sparkContext.broadcast(ItemIndex(sorted(((r["item_id"], r["text"].encode()) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])), **options)))
    return out


def _hits(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for batch in batches:
        out: list[list] = [[], [], [], []]
        at = []
        for i, text in enumerate(texts_of(batch)):
            hashed = words.of(text.lower().split())
            for item, start, sim in held.value.search(hashed):
                at.append(i)
                for column, value in zip(out, (item, start, sim), strict=False):
                    column.append(value)
        if at:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["doc_id", "item_id", "start_word", "similarity"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, start_word, similarity: for every item in a document, its best window.

    Words are A-Z lower-cased; shingles have five words, or all of an item that has fewer. Null and empty texts hold
    nothing; repeated rows are found each; an item's window keeps the item's length in words, or is the whole
    of a shorter text. Texts are searched whole and where they lie, without a shuffle.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text")
    found = [rows.mapInArrow(lean(lambda b, held=held: _hits(b, held)), f"doc_id {kind}, item_id bigint, start_word bigint, similarity double") for held in indexes(benchmark, **options)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _clean(batches: Iterator[pa.RecordBatch], held: list) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for batch in batches:
        keep = []
        for text in texts_of(batch):
            hashed = words.of(text.lower().split())
            keep.append(not any(h.value.search(hashed) for h in held))
        yield batch.filter(pa.array(keep, pa.bool_()))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no item is found."""
    held = indexes(benchmark, **options)
    return docs.mapInArrow(lean(lambda b: _clean(b, held)), docs.schema)
