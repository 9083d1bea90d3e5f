"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, sorted-array intersection; links as components.

1. A document's sorted shingle hashes make its set; equal sets share a node. In one order of all shingles a set's first
   n - ceil(t n) + 1 shingles are its prefix: two sets at similarity t share a shingle of their prefixes. The order goes by
   exact counts: of each set the shingles with the lowest hashes, COUNTED times as many as the prefix takes, are dealt by shingle, and
   what more than one set has goes back to its nodes with its count, the rarest first. Shingles beyond those follow by hash, and last
   come those that a sample finds frequent. Under each shared shingle of the prefixes and each size band nodes join the group of
   the smallest, so that every pair that could link meets in some group. Nothing that is held or broadcast grows with the
   number of shingles.
2. Groups are cut into tiles by size band and slice. Tiles of neighbouring bands are compared through bitmaps of the
   sets: each bit that only one side has is a shingle the other lacks, which bounds the overlap from above. Each tile meets
   the bands' first tiles, and nodes that pass with nobody there meet all tiles. Those without a partner then leave.
3. The sets of those that stay are compared exactly, first each tile with the bands' first tiles; nodes that this doesn't
   connect to their group's main part are then compared with every tile. Pairs already connected are skipped: what is
   asked for is which documents are linked, not by how many links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from confab.llm.common import Scratch, free_names, groups, lean, text_key
from confab.llm.components import components
from confab.llm.texts import MIX, WordHash, bitmap, mixed, shingle_set, signed, texts_of

#: Nodes of a tile.
TILE = 256
#: Parts that a group of more than TILE members is dealt in where its members look up what is known of it: so many small rows for each of its bands.
SALTS = 64
#: Least bits of a signature.
SIGNATURE = 256
#: Documents sampled for frequent shingles, in how many of those a shingle must occur to be one, and how many are told apart at most
#: (the most frequent). Only the order depends on it, no link.
SAMPLE, FREQUENT, MOST = 10_000, 4, 1 << 16
#: Shingles of a set that are counted, as a multiple of its prefix.
COUNTED = 2.0
#: Members of a frequent shingle that are dealt to one place.
DEALT = 4096
#: Bits for each wanted document of the filter that picks texts for exact comparison, and the most bits that are broadcast; beyond that all sets go to the join that decides.
WANTED_BITS, MOST_BITS = 16, 1 << 29


def _set(words: WordHash, text: bytes, n: int) -> np.ndarray:
    return shingle_set(words.of(text.lower().split()), n)


def _sampled(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for batch in batches:
        held = [own for t in texts_of(batch) if len(own := _set(words, t, n))]
        if held:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(at)), pa.array(times)], names=["s", "n"])


def counted_below(threshold: float) -> np.uint64:
    """Shingles with hashes below it are counted."""
    return np.uint64(min(int(COUNTED * (1 - threshold) * 2.0**64), 2**64 - 1))


class Order:
    """One order of all shingles: the counted ones (by count, then hash), the others (by hash), the frequent ones (by rank, then hash). ``parts``: what the frequent ones' members are dealt in."""

    def __init__(self, frequent: np.ndarray, times: np.ndarray, each: float):
        order = np.argsort(frequent)
        self.frequent = frequent[order]
        self.rank = 2 + np.floor(np.log2(np.maximum(times[order], 1))).astype(np.int64)
        self.parts = np.ceil(times[order] * each / DEALT).astype(np.int32)

    def split(self, own: np.ndarray, threshold: float) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a sorted set: how many counted shingles its prefix takes, the counted ones, the others and the frequent ones of the prefix, and the latter's parts."""
        size = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1
        rank = (own >= counted_below(threshold)).astype(np.int64)
        at = rank
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, own), len(self.frequent) - 1)
            rank = np.where(self.frequent[at] == own, self.rank[at], rank)
        counted = own[rank == 0]
        known = np.argsort(rank, kind="stable")[len(counted) : size]
        many = rank[known] > 1
        return min(size, len(counted)), counted, own[known[~many]], own[known[many]], self.parts[at[known[many]]] if many.any() else self.parts[:0]


def shingle_order(docs: DataFrame, n: int) -> Order:
    """The order, from a sample of about SAMPLE rows drawn one by one; MOST rows reach the driver at most."""
    every = max(1, docs.count())
    share = min(1.0, SAMPLE / every)
    rows = docs.select("text") if share == 1 else docs.select("text").sample(False, share, 11)
    counts = rows.mapInArrow(lean(lambda b: _sampled(b, n)), "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    got = counts.orderBy(F.desc("n"), "s").limit(MOST).toArrow()
    return Order(got.column("s").to_numpy().view(np.uint64), got.column("n").to_numpy(), 1 / share)


def signature(own: np.ndarray) -> np.ndarray:
    """A bitmap with two to four bits for each shingle, so that long sets don't fill theirs."""
    return bitmap(own, max(SIGNATURE, 1 << int(2 * len(own) - 1).bit_length()))


def folded(marks: np.ndarray, lanes: int) -> np.ndarray:
    """Bitmaps (rows) as those of fewer lanes: both sizes are powers of two, so halves lie on each other."""
    return np.bitwise_or.reduce(marks.reshape(len(marks), -1, lanes), axis=1)


def _node(own: np.ndarray) -> int:
    """A set's 63-bit name."""
    return xxh3_64_intdigest(own.tobytes()) >> 1


LISTED = "doc_id {kind}, key string, node bigint, n bigint, sig binary, open int, counted array<bigint>, rare array<bigint>, common array<bigint>, parts array<int>"


def _listed(batches: Iterator[pa.RecordBatch], held, n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Every document's node and set size; a partition's first document of a node also brings its signature and what may be its prefix."""
    words, seen = WordHash(), set()
    lists, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    for batch in batches:
        rows = []
        for text in texts_of(batch):
            own = _set(words, text, n)
            node = _node(own) if len(own) else None
            if node is None or node in seen:
                rows.append((node, len(own), *[None] * 6))
                continue
            seen.add(node)
            few, counted, rare, common, parts = held.value.split(own, threshold)
            rows.append((node, len(own), signature(own).tobytes(), few, *(signed(c) if len(c) else None for c in (counted, rare, common)), parts if len(parts) else None))
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), lists, lists, lists, ints]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "key", "node", "n", "sig", "open", "counted", "rare", "common", "parts"])


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of the rows that share their ``s`` with another row, from rows sorted by it; a run comes whole. What is held is a batch and the run that its end cuts."""
    parts: list[list[np.ndarray]] = []

    def shared() -> Iterator[list[np.ndarray]]:
        rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
        same = rows[0][1:] == rows[0][:-1]
        more = np.r_[False, same] | np.r_[same, False]
        if more.any():
            yield [c[more] for c in rows]

    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in names]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut or (parts and parts[-1][0][-1] != rows[0][0]):
            parts.append([c[:cut] for c in rows])
            yield from shared()
            parts = []
        parts.append([c[cut:] for c in rows])
    if parts:
        yield from shared()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, s, level: shingles of more than one node go back to each, with their count's binary logarithm."""
    for s, node in _runs(batches, ("s", "node")):
        order = np.lexsort((node, s))
        s, node = s[order], node[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (node[1:] != node[:-1])]
        s, node = s[new], node[new]
        _, at, times = np.unique(s, return_inverse=True, return_counts=True)
        times = times[at]
        kept = times > 1
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(s[kept]), pa.array(np.log2(times[kept]).astype(np.int32))], names=["node", "s", "level"])


def bands(n: np.ndarray, threshold: float) -> np.ndarray:
    """Sets of similarity ``threshold`` lie in the same or neighbouring bands; these are a little wider, against rounding."""
    return np.floor(np.log(n) / max(0.01, math.log(1 / threshold) * (1 + 1e-6))).astype(np.int64)


def grouped(s: np.ndarray, node: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """g, node, n, home: every node under its shingle in its own band's group, where it is at home, and in the next one's. Groups are named after
    their smallest node; those of one node, or with nobody at home, have no pair that doesn't meet elsewhere."""
    own = bands(n, threshold)
    home = np.r_[np.ones(len(s), np.int32), np.zeros(len(s), np.int32)]
    s, node, n, j = np.r_[s, s], np.r_[node, node], np.r_[n, n], np.r_[own, own + 1]
    order = np.lexsort((node, j, s))
    s, node, n, j, home = s[order], node[order], n[order], j[order], home[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (j[1:] != j[:-1])]
    head = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    least, most = node[head], node[np.r_[head[1:], len(node)] - 1]
    kept = ((least < most) & (np.maximum.reduceat(home, head) > 0))[run]
    g = signed(mixed(least[run][kept].view(np.uint64) * MIX[0] ^ j[kept].view(np.uint64)) >> np.uint64(1))
    node, n, home = node[kept], n[kept], home[kept]
    order = np.lexsort((node, g))
    g, node, n, home = g[order], node[order], n[order], home[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (node[1:] != node[:-1])] if len(g) else np.zeros(0, bool)
    return g[new], node[new], n[new], home[new]


def _met(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """g, node, n, home from rows (s, node, n) sorted by s."""
    for rows in _runs(batches, ("s", "node", "n")):
        found = grouped(*rows, threshold)
        if len(found[0]):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["g", "node", "n", "home"])


class Links:
    """Union-find over a tile pair's rows."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def possible(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (rows of ``left`` and ``right`` bitmaps, sizes a and b) whose overlap, bounded from above, could reach the threshold."""
    need = threshold / (1 + threshold) * (a[:, None] + b[None, :]) - 1e-6
    own = np.bitwise_count(left).sum(axis=1, dtype=np.int32)
    other = np.bitwise_count(right).sum(axis=1, dtype=np.int32)
    both = np.zeros((len(left), len(right)), np.int32)
    for lane in range(left.shape[1]):
        both += np.bitwise_count(left[:, lane, None] & right[None, :, lane])
    bound = np.minimum(a[:, None] - (own[:, None] - both), b[None, :] - (other[None, :] - both))
    return (bound >= need) & (np.minimum(a[:, None], b[None, :]) >= threshold * np.maximum(a[:, None], b[None, :]) - 1e-6)


KEYS = ["g", "lb", "ls", "rb", "rs"]
#: Sides of a tile pair that a row is on.
RIGHT, LEFT, BOTH = 0, 1, 2


def _screened(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """g, node: nodes with a partner in the tile pair that the bitmaps let pass."""
    for t in groups(batches, KEYS):
        node, n, side = (t.column(c).to_numpy() for c in ("node", "n", "side"))
        left, right = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
        if t.num_rows < 2 or not len(left) or not len(right):
            continue
        own = t.column("load").to_pylist()
        lanes = np.array([len(x) // 8 for x in own])
        kept = []
        for wide in np.unique(lanes).tolist():
            a = left[lanes[left] == wide]
            # Similar sets are at most twice as large, and their bitmaps too.
            for other in (wide // 2, wide, wide * 2):
                b = right[lanes[right] == other]
                if len(a) and len(b):
                    few = min(wide, other)
                    x, y = (folded(np.frombuffer(b"".join(own[i] for i in side_), "<u8").reshape(len(side_), -1), few) for side_ in (a.tolist(), b.tolist()))
                    ok = possible(x, y, n[a], n[b], threshold) & (node[a][:, None] != node[b][None, :])
                    kept += [node[a][ok.any(axis=1)], node[b][ok.any(axis=0)]]
        found = np.unique(np.concatenate(kept)) if kept else node[:0]
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), t.column("g")[0].as_py())), pa.array(found)], names=["g", "node"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """a, b: links that connect a tile pair's nodes, a spanning forest of all there are between its sides and within the left one."""
    for t in groups(batches, KEYS):
        nodes, at = np.unique(t.column("node").to_numpy(), return_index=True)
        if len(nodes) < 2:
            continue
        own = t.column("load").to_pylist()
        sets = [np.frombuffer(own[i], "<u8") for i in at.tolist()]
        n = np.array([len(s) for s in sets])
        bits = max(SIGNATURE, 1 << int(2 * n.max() - 1).bit_length())
        marks = np.stack([bitmap(s, bits) for s in sets])
        links, a, b = Links(len(nodes)), [], []
        for lo in range(0, len(nodes), 64):
            ok = possible(marks[lo : lo + 64], marks, n[lo : lo + 64], n, threshold)
            for i, j in zip(*np.nonzero(ok), strict=True):
                i, j = int(i) + lo, int(j)
                if i < j and links.root(i) != links.root(j) and overlap(sets[i], sets[j]) * (1 + threshold) >= threshold * (n[i] + n[j]) - 1e-9:
                    links.join(i, j)
                    a.append(nodes[i])
                    b.append(nodes[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a)), pa.array(np.array(b))], names=["a", "b"])


def band(n: Column, threshold: float) -> Column:
    """Sets of similarity ``threshold`` lie in the same or neighbouring bands; these are a little wider, against rounding."""
    return F.floor(F.log(n.cast("double")) / max(0.01, math.log(1 / threshold) * (1 + 1e-6))).cast("int")


def salt() -> Column:
    """A node's part of its group."""
    return F.pmod(F.xxhash64(F.lit("part"), F.col("node")), F.lit(SALTS)).cast("int").alias("salt")


def salted(rows: DataFrame) -> DataFrame:
    """``rows``, one or a few for each large group, for every part of it."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def tiled(members: DataFrame, threshold: float) -> DataFrame:
    """g, node, n, home with band, slice and tiles; a group of up to TILE members is one tile, in a larger one each band has a slice for each TILE of its members or so."""
    banded = members.withColumn("band", band(F.col("n"), threshold))
    counts = banded.groupBy("g", "band").agg(F.count(F.lit(1)).alias("c"))
    large = counts.groupBy("g").agg(F.sum("c").alias("all")).filter(F.col("all") > TILE).select("g")
    sizes = salted(counts.join(large, "g").select("g", "band", F.ceil(F.col("c") / TILE).cast("int").alias("tiles")))
    sliced = banded.withColumn("salt", salt()).join(sizes, ["g", "band", "salt"], "left").drop("salt")
    placed = sliced.withColumn("band", F.when(F.col("tiles").isNotNull(), F.col("band")).otherwise(-1)).withColumn("tiles", F.coalesce("tiles", F.lit(0)))
    return placed.withColumn("slice", F.pmod(F.xxhash64("node"), F.greatest("tiles", F.lit(1))).cast("int"))


def facing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of all pairs of a left and a right tile of one group and of the same or neighbouring bands, one of them at home.

    A group of one tile comes once, from ``right``. A row's place in a pair is its side.
    """
    single = right.filter("tiles = 0").select("g", F.lit(-1).alias("lb"), F.lit(0).alias("ls"), F.lit(-1).alias("rb"), F.lit(0).alias("rs"), F.lit(BOTH).alias("side"), "node", "n")
    left, right = left.filter("tiles > 0"), right.filter("tiles > 0")
    rows = lambda tiles: tiles.select("g", F.col("band").alias("at"), F.col("slice").alias("own"), "node", "n", "home", salt())
    near = lambda tiles, name: salted(tiles.select("g", "band", "slice", "home").distinct().withColumn("at", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))).select("g", "at", F.col("home").alias("there"), F.col("band").alias(f"{name}b"), F.col("slice").alias(f"{name}s")))
    met = lambda tiles, others: tiles.join(others, ["g", "at", "salt"]).filter("home + there > 0")
    a = met(rows(left), near(right, "r")).select("g", F.col("at").alias("lb"), F.col("own").alias("ls"), "rb", "rs", F.lit(LEFT).alias("side"), "node", "n")
    b = met(rows(right), near(left, "l")).select("g", "lb", "ls", F.col("at").alias("rb"), F.col("own").alias("rs"), F.lit(RIGHT).alias("side"), "node", "n")
    return single.unionByName(a).unionByName(b)


def dealt(pairs: DataFrame, loads: DataFrame) -> DataFrame:
    """``pairs`` with their nodes' ``load`` (node, load), partitioned and sorted by tile pair; loads travel last, once for each pair they are in."""
    return pairs.join(loads, "node").repartition(*KEYS).sortWithinPartitions(*KEYS)


def wanted_filter(keys: DataFrame) -> tuple[np.ndarray | None, int]:
    """A bitmap of about WANTED_BITS bits for each row of ``keys`` (key) that has every key and few others, and its size; None where it would be larger than MOST_BITS."""
    bits = 1 << max(16, (keys.count() * WANTED_BITS - 1).bit_length())
    if bits > MOST_BITS:
        return None, bits
    cells = keys.select(cell(F.col("key"), bits).alias("cell")).distinct().groupBy(F.call_function("div", F.col("cell"), F.lit(1 << 16)).alias("chunk")).agg(F.collect_list((F.col("cell") % (1 << 16)).cast("int")).alias("low"))
    out = np.zeros(bits, bool)
    for row in cells.toLocalIterator():
        out[(row["chunk"] << 16) + np.array(row["low"])] = True
    return np.packbits(out, bitorder="little"), bits


def cell(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)).cast("bigint")


def _sets(batches: Iterator[pa.RecordBatch], marks, n: int) -> Iterator[pa.RecordBatch]:
    """node, load: sets of documents that the filter may know. Their texts stay where they are; what it got wrong goes in a join by node."""
    words = WordHash()
    for batch in batches:
        if marks is not None:
            cells = batch.column("cell").to_numpy()
            known = (marks.value[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(known.astype(bool)))
        own = [s for t in texts_of(batch) if len(s := _set(words, t, n))]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in own], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in own], pa.binary())], names=["node", "load"])


def jaccard_components(docs: DataFrame, n: int = 3, threshold: float = 0.9) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) for every row of ``docs`` (doc_id, text; others aren't carried).

    Words are A-Z lower-cased. A set holds a text's distinct shingles of ``n`` words, or its whole sequence if it has fewer;
    null texts and texts without words have none and link with nothing. Two documents link when |A & B| >= threshold * |A | B|;
    shingles are compared by 64-bit hashes. Repeated rows and equal texts share a node, and null doc_ids never name a
    component that has others.
    """
    rows, named = _components(docs, n, threshold)
    smallest = named.select("node", F.col("least.doc_id").alias("component_id"))
    linked = rows.filter("node is not null").join(smallest, "node")
    single = rows.filter("node is null").withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(single.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def memberships(listed: DataFrame, threshold: float) -> DataFrame:
    """g, node, n, home: the groups in which all nodes meet that share a shingle of their prefixes and could be similar by their sizes."""
    by_shingle = lambda rows: rows.repartition("s").sortWithinPartitions("s")
    counted = by_shingle(listed.filter("counted is not null").select(F.explode("counted").alias("s"), "node"))
    back = counted.mapInArrow(lean(_counts), "node bigint, s bigint, level int")
    # Those that no other node has come first in the order. They aren't sent back, but they fill the prefix.
    info = listed.filter("counted is not null").select("node", "n", "open", F.size("counted").alias("all")).dropDuplicates(["node"])
    own = Window.partitionBy("node")
    placed = back.withColumns({"place": F.row_number().over(own.orderBy("level", "s")), "shared": F.count(F.lit(1)).over(own)})
    first = placed.join(info, "node").filter(F.col("place") + F.col("all") - F.col("shared") <= F.col("open")).select("s", "node", "n")
    rare = listed.filter("rare is not null").select(F.explode("rare").alias("s"), "node", "n")
    few = by_shingle(first.unionByName(rare)).mapInArrow(lean(lambda b: _met(b, threshold)), "g bigint, node bigint, n bigint, home int")
    # A frequent shingle's members are too many for one place: each band's smallest one is found by partial minima and sent to all of its parts.
    pairs = F.explode(F.arrays_zip(F.col("common").alias("s"), F.col("parts").alias("parts"))).alias("c")
    own = band(F.col("n"), threshold)
    common = listed.filter("common is not null").select(pairs, "node", "n").select("c.s", "c.parts", "node", "n", F.posexplode(F.array(own, own + 1)).alias("away", "j"))
    least = common.groupBy("s", "j").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.max("parts").alias("parts"), F.min("away").alias("away")).filter("least < most and away = 0")
    spread = least.select("s", "j", "least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    many = common.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("node")), F.col("parts")).cast("int")).join(spread, ["s", "j", "part"])
    return few.unionByName(many.select(F.shiftrightunsigned(F.xxhash64("least", "j"), 1).alias("g"), "node", "n", (1 - F.col("away")).alias("home"))).distinct()


def _components(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, key (128 bits of the text), node and n of every row, and for every node its label and the least row (null ids last) of its component."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must lie in 0.5 to 1")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    order = spark.sparkContext.broadcast(shingle_order(docs, n))
    kind = dict(docs.dtypes)["doc_id"]
    listed = scratch.table(rows.mapInArrow(lean(lambda b: _listed(b, order, n, threshold)), LISTED.format(kind=kind)), "sets")
    order.destroy()
    first = listed.filter("sig is not null")

    members = scratch.table(memberships(listed, threshold), "members")
    tiles = scratch.table(tiled(members, threshold), "tiles")
    scratch.drop(members)
    # Partitions may each have brought a node.
    sigs = scratch.table(first.select("node", F.col("sig").alias("load")).join(tiles.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "signatures")
    screened = lambda left, right: dealt(facing(left, right), sigs).mapInArrow(lean(lambda b: _screened(b, threshold)), "g bigint, node bigint")
    able = scratch.table(screened(tiles.filter("slice = 0"), tiles).distinct(), "able")
    unmet = scratch.table(tiles.filter("tiles > 0").join(able, ["g", "node"], "left_anti"), "unmet")
    if not unmet.isEmpty():
        again = tiles.withColumn("salt", salt()).join(salted(unmet.select("g").distinct()), ["g", "salt"]).drop("salt")
        able = scratch.table(able.unionByName(screened(unmet, again)).distinct(), "able")
    wanted = scratch.table(able.select("node").distinct().join(tiles.select("node", "n").distinct(), "node"), "wanted")
    scratch.keep_only(listed, able, wanted)

    keys = listed.filter("node is not null").select("node", "key").distinct().join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    bitmap_, bits = wanted_filter(keys)
    marks = None if bitmap_ is None else spark.sparkContext.broadcast(bitmap_)
    found = rows.select(cell(F.col("key"), bits).alias("cell"), "text").mapInArrow(lean(lambda b: _sets(b, marks, n)), "node bigint, load binary")
    sets = scratch.table(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "able-sets")
    # Groups that share a node become one, so that a set travels once.
    whole = components(able.select(F.col("g").alias("a"), F.col("node").alias("b")), scratch).withColumnRenamed("label", "g")
    loaded = scratch.table(tiled(wanted.join(whole, "node").withColumn("home", F.lit(1)), threshold), "loaded")
    scratch.keep_only(listed, sets, loaded)
    verified = lambda left, right: dealt(facing(left, right), sets).mapInArrow(lean(lambda b: _verified(b, threshold)), "a bigint, b bigint")
    tight = scratch.table(verified(loaded.filter("slice = 0"), loaded), "links")
    labels = scratch.table(components(tight, scratch), "labels")
    placed = scratch.table(loaded.filter("tiles > 0").select("g", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    main = placed.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max(F.struct("c", "label")).alias("m")).select("g", F.col("m.label").alias("main"))
    apart = scratch.table(placed.withColumn("salt", salt()).join(salted(main), ["g", "salt"]).filter("label <> main").select("g", "node"), "apart")
    if not apart.isEmpty():
        rest = loaded.join(apart, ["g", "node"])
        again = loaded.withColumn("salt", salt()).join(salted(apart.select("g").distinct()), ["g", "salt"]).drop("salt")
        # Written first: one task of both comparing and contracting would hold a Python worker for each.
        more = scratch.table(verified(rest, again), "more")
        labels = scratch.table(components(tight.unionByName(more), scratch), "labels")

    # The least row of each node, then of each component; both by partial minima.
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    own = listed.filter("node is not null").groupBy("node").agg(F.min(at).alias("own")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = own.groupBy("label").agg(F.min("own").alias("least"))
    named = scratch.table(own.select("node", "label").join(least, "label"), "named")
    if marks is not None:
        marks.destroy()
    scratch.keep_only(listed, named)
    return listed.select("doc_id", "key", "node", "n"), named


def without_near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stand for their component: one row each, that with its smallest doc_id.

    Null doc_ids come last. Of a component's texts under one doc_id, or of all its texts where none has one, the one whose MD5 is
    smallest stays, and of rows that agree in doc_id and text one. Empty texts link with nothing: each doc_id keeps one.
    """
    rows, named = _components(docs, n, threshold)
    none = rows.filter("node is null").select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("least"))
    missing, own, key = free_names(docs, "_missing", "_own", "_key")
    standing = named.select("least").unionByName(none).distinct().select(F.col("least.none").alias(missing), F.coalesce("least.doc_id", F.lit(0)).alias(own), F.col("least.key").alias(key))
    keyed = docs.withColumns({missing: F.col("doc_id").isNull(), own: F.coalesce("doc_id", F.lit(0)), key: text_key(F.col("text"))})
    return keyed.join(standing, [missing, own, key], "left_semi").dropDuplicates([missing, own, key]).select(*docs.columns)
