"""Substring deduplication: windows of words that start earlier elsewhere, by a Count-min prefilter and an exact pass.

A window is WINDOW consecutive words. Documents are dealt to parts, once. Pass one counts windows in Count-min sketches, one a part,
with CELLS_A_BYTE cells for each byte of text: the sketch grows with the input and so its load doesn't. It stays in the
cluster: parts send the cells that they hit, cell ranges are merged apart, and each part gets back those of its own cells
that are hit more than once. Estimates never fall below true counts, so a window with an estimate of 1 occurs once. Pass two
groups all other windows by their full hashes (two of 64 bits) and finds each one's first start; those of one anchor, the run of
ANCHOR words inside a window whose hash is smallest (the first on ties), travel together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.llm.texts import MIX, WordHash, mixed, signed, texts_of

WINDOW = 20
ANCHOR = 10
#: Rows of the sketch, and cells of each for every byte of text: about three for each window.
DEPTH, CELLS_A_BYTE = 2, 0.5
#: Ranges that the cells are merged in: so many at least, and of so many cells at most.
RANGES, RANGE = 256, 1 << 24
#: Text of a partition that documents are dealt to, and parts of a partition.
DEALT, PARTS = 24 << 20, 8
#: A part's sketch is sent on when it holds so many windows, and candidates when there are so many.
HELD = 1 << 20
#: A gap between cells that continues in the next number.
FILLER = np.uint16(0xFFFF)


def windows(words: np.ndarray, window: int) -> np.ndarray:
    """Hash of every run of ``window`` words: differences of a polynomial's running sums, modulo 2^64, brought to one power."""
    if len(words) < window:
        return words[:0]
    powers = _powers(int(MIX[0]), len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mixed(words) * powers, out=sums[1:])
    back = _powers(pow(int(MIX[0]), -1, 1 << 64), len(words))
    return mixed((sums[window:] - sums[:-window]) * back[: len(words) - window + 1])


_known_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; a worker keeps those it has."""
    out = _known_powers.get(base)
    if out is None or len(out) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, np.uint64(base))
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _known_powers[base] = out
    return out[:n]


def anchors(words: np.ndarray, at: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The hash of the anchor of each window that starts in ``at``."""
    runs = windows(words, anchor)
    return sliding_window_view(runs, window - anchor + 1)[at].min(axis=1)


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """A window's cell in a row of 2^``bits``."""
    return (hashes if row == 0 else mixed(hashes ^ MIX[row])) >> np.uint64(64 - bits)


def told(at: np.ndarray) -> bytes:
    """Sorted cell numbers as 16-bit gaps."""
    gaps = np.diff(at.astype(np.int64), prepend=0)
    more, rest = np.divmod(gaps, int(FILLER))
    out = np.full(len(at) + int(more.sum()), FILLER, "<u2")
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def heard(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, "<u2")
    return np.cumsum(gaps, dtype=np.int64)[gaps != FILLER]


def in_ranges(at: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, numbers in it) of sorted cell numbers."""
    if len(at):
        which = at >> width
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            yield int(which[a]), at[a:b] & ((1 << width) - 1)


SKETCH = "row int, range bigint, part int, once binary, more binary"


def _sketched(batches: Iterator[pa.RecordBatch], window: int, bits: int, width: int) -> Iterator[pa.RecordBatch]:
    """Parts' sketches by range: cells hit once and cells hit more often."""
    words, held, n = WordHash(), {}, 0
    schema = pa.schema([("row", pa.int32()), ("range", pa.int64()), ("part", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])

    def emitted() -> Iterator[pa.RecordBatch]:
        for part, own in held.items():
            hashes = np.concatenate(own)
            for row in range(DEPTH):
                at, times = np.unique(cells(hashes, row, bits).astype(np.int64), return_counts=True)
                found: dict[int, list] = {}
                for i, some in enumerate((at[times == 1], at[times > 1])):
                    for key, inside in in_ranges(some, width):
                        found.setdefault(key, [b"", b""])[i] = told(inside)
                yield pa.RecordBatch.from_pydict({"row": [row] * len(found), "range": list(found), "part": [part] * len(found), "once": [x[0] for x in found.values()], "more": [x[1] for x in found.values()]}, schema=schema)

    for batch in batches:
        for part, text in zip(batch.column("part").to_pylist(), texts_of(batch), strict=True):
            own = windows(words.of(text.split()), window)
            if len(own):
                held.setdefault(part, []).append(own)
                n += len(own)
            if n >= HELD:
                yield from emitted()
                held, n = {}, 0
    if n:
        yield from emitted()


def _merged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """row, range, part, cells: of each part's cells in a range those with a merged count above 1. Batches come sorted by row and range; one range is held."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    last, counts = None, np.zeros(1 << width, np.uint8)
    schema = pa.schema([("row", pa.int32()), ("range", pa.int64()), ("part", pa.int32()), ("cells", pa.binary())])

    def answered() -> pa.RecordBatch:
        for _, once, more in held:
            at = heard(once)
            counts[at] = np.minimum(counts[at], 1) + 1
            counts[heard(more)] = 2
        parts, out = [], []
        for part, once, more in held:
            at = heard(once)
            hit = at[counts[at] > 1]
            if more:
                hit = np.union1d(hit, heard(more))
            if len(hit):
                parts.append(part)
                out.append(told(hit))
        counts[:] = 0
        return pa.RecordBatch.from_pydict({"row": [last[0]] * len(parts), "range": [last[1]] * len(parts), "part": parts, "cells": out}, schema=schema)

    for batch in batches:
        for row, key, part, once, more in zip(*(batch.column(c) for c in ("row", "range", "part", "once", "more")), strict=True):
            own = (row.as_py(), key.as_py())
            if held and own != last:
                yield answered()
                held = []
            last = own
            held.append((part.as_py(), once.as_py(), more.as_py()))
    if held:
        yield answered()


def within(sorted_: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``some`` are in the sorted array."""
    if not len(sorted_):
        return np.zeros(len(some), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, some), len(sorted_) - 1)] == some


def repeated(hashes: np.ndarray, known: list[np.ndarray], bits: int) -> np.ndarray:
    """Places of the windows whose estimate, the least of their rows', is above 1."""
    at = np.arange(len(hashes))
    for row, own in enumerate(known):
        at = at[within(own, cells(hashes[at], row, bits).astype(np.int64))]
    return at


ROWS = "part int, doc bigint, _h bigint, pos int, n int, h2 bigint, h1 array<bigint>"


def _runs(*same: np.ndarray) -> np.ndarray:
    """Starts of the stretches in which all columns repeat; the last column counts up by one instead."""
    if not len(same[-1]):
        return np.zeros(0, np.int64)
    cut = same[-1][1:] != same[-1][:-1] + 1
    for c in same[:-1]:
        cut |= c[1:] != c[:-1]
    return np.r_[0, np.flatnonzero(cut) + 1]


def _combined(parts: list[tuple], part: int) -> pa.RecordBatch:
    """A batch's windows: of equal ones the earliest start goes on as a candidate, the others are known to be later ones.

    So a window has no more candidates than there are batches, however often it occurs. Candidates with one anchor travel together:
    pos is the first, n is 0, h2 the anchor, h1 the hash of each. Known ones are runs of n starts under a key of their own.
    """
    doc, digest, pos, h1, h2 = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(h1, kind="stable")  # they come by document and place
    s1, s2, sd, sp = h1[order], h2[order], doc[order], pos[order]
    same = np.r_[False, (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])]
    firsts = np.flatnonzero(~same)[np.cumsum(~same) - 1]
    # Repeated rows of one document start at the same place: none of them is later than the other.
    later = (sd != sd[firsts]) | (sp != sp[firsts])
    known, open_ = np.sort(order[later]), np.sort(order[~later])
    cuts = _runs(doc[known], digest[known], pos[known])
    runs = known[cuts]
    lengths = np.diff(np.r_[cuts, len(known)])
    spread = signed(mixed((doc[runs].astype(np.uint64) ^ digest[runs].view(np.uint64)) + pos[runs].astype(np.uint64)))
    cuts = _runs(doc[open_], digest[open_], h2[open_], pos[open_])
    heads = open_[cuts]
    both = np.r_[heads, runs]
    ends = np.r_[cuts, len(open_), len(open_) + 1 + np.arange(len(runs))].astype(np.int32)
    hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.r_[signed(h1[open_]), spread]))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(both), part, np.int32)), pa.array(doc[both]), pa.array(digest[both]), pa.array(pos[both].astype(np.int32)), pa.array(np.r_[np.zeros(len(heads)), lengths].astype(np.int32)), pa.array(np.r_[signed(h2[heads]), spread]), hashes],
        names=["part", "doc", "_h", "pos", "n", "h2", "h1"],
    )


def _found(left: pa.Table, right: pa.Table, window: int, anchor: int, bits: int, width: int) -> pa.Table:
    """A part's windows that are estimated to repeat, as ``_combined`` packs them."""
    known: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
    for row, key, own in zip(*(right.column(c) for c in ("row", "range", "cells")), strict=True):
        known[row.as_py()].append((key.as_py() << width) + heard(own.as_py()))
    sorted_ = [np.sort(np.concatenate(k)) if k else np.zeros(0, np.int64) for k in known]
    if not left.num_rows or not all(map(len, sorted_)):
        return EMPTY
    part, words, parts, n, out = left.column("part")[0].as_py(), WordHash(), [], 0, []
    left = left.sort_by([("doc", "ascending"), ("_h", "ascending")])
    for batch in left.to_batches():
        for doc, digest, text in zip(batch.column("doc").to_pylist(), batch.column("_h").to_pylist(), texts_of(batch), strict=True):
            hashed = words.of(text.split())
            own = windows(hashed, window)
            at = repeated(own, sorted_, bits)
            if len(at):
                parts.append((np.full(len(at), doc, np.int64), np.full(len(at), digest, np.int64), at, own[at], anchors(hashed, at, window, anchor)))
                n += len(at)
            if n >= HELD:
                out.append(_combined(parts, part))
                parts, n = [], 0
    if n:
        out.append(_combined(parts, part))
    return pa.Table.from_batches(out) if out else EMPTY


EMPTY = pa.table({"part": pa.array([], pa.int32()), "doc": pa.array([], pa.int64()), "_h": pa.array([], pa.int64()), "pos": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), "h2": pa.array([], pa.int64()), "h1": pa.array([], pa.list_(pa.int64()))})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later starts of a batch as runs: neighbours that stand alone become one run."""
    for batch in batches:
        part, doc, digest, pos, n = (batch.column(c).to_numpy() for c in ("part", "doc", "_h", "pos", "n"))
        long, one = np.flatnonzero(n > 1), np.flatnonzero(n == 1)
        one = one[np.lexsort((pos[one], digest[one], doc[one], part[one]))]
        cuts = _runs(part[one], doc[one], digest[one], pos[one].astype(np.int64))
        at = np.r_[long, one[cuts]]
        sizes = np.r_[n[long], np.diff(np.r_[cuts, len(one)])].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(doc[at]), pa.array(digest[at]), pa.array(pos[at]), pa.array(sizes)], names=["part", "doc", "_h", "pos", "n"])


def _cut(left: pa.Table, right: pa.Table, window: int, kind: pa.DataType) -> pa.Table:
    """A part's documents without the words that its runs cover."""
    doc, digest, pos, n = (right.column(c).to_numpy() for c in ("doc", "_h", "pos", "n"))
    order = np.lexsort((digest, doc))
    doc, digest, pos, n = doc[order], digest[order], pos[order].astype(np.int64), n[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])]) if len(doc) else np.zeros(0, np.int64)
    runs = {(int(doc[a]), int(digest[a])): slice(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=False)}
    out: list[list] = [[], [], []]
    for batch in left.to_batches():
        for own, h, text in zip(batch.column("doc").to_pylist(), batch.column("_h").to_pylist(), texts_of(batch), strict=True):
            words, at = text.split(), runs.get((own, h))
            kept = words
            if at is not None:
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, pos[at], 1)
                np.add.at(edges, pos[at] + n[at] - 1 + window, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
            for column, value in zip(out, (len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")), strict=True):
                column.append(value)
    ids = left.column("doc_id").cast(kind)
    return pa.table([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of ``docs`` (doc_id, text; other columns aren't carried).

    Removes each word that a window covers whose words also start earlier: in a document with a smaller doc_id, or further up in
    its own. Windows are judged on the input. Null and short texts have no window and keep all; a null doc_id counts
    as the smallest; repeated rows of one doc_id start at the same places, so neither removes the other's words. ``bits``: a row of the
    sketch has 2^bits cells; by default it grows with the texts.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    bits = bits or max(16, int(size * CELLS_A_BYTE).bit_length())
    width = max(8, bits - max(RANGES, (1 << bits) // RANGE).bit_length() + 1)
    tasks = max(1, -(-size // DEALT))
    least = F.lit(-(1 << 63)).cast("bigint")
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), least).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    # Repeated rows lie in the parts of their input partitions. All passes read this one exchange of the texts.
    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("doc", "_h", F.spark_partition_id()), F.lit(tasks * PARTS)).cast("int")).repartition(tasks, "part")
    sketch = dealt.mapInArrow(lambda b: _sketched(b, window, bits, width), SKETCH)
    answers = sketch.repartition("row", "range").sortWithinPartitions("row", "range").mapInArrow(lambda b: _merged(b, width), "row int, range bigint, part int, cells binary")
    found = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda a, b: _found(a, b, window, anchor, bits, width), ROWS)
    each = found.repartition("h2").select("part", "doc", "_h", "pos", "n", "h2", F.posexplode("h1").alias("i", "h1")).select("part", "doc", "_h", (F.col("pos") + F.col("i")).alias("pos"), "n", "h1", "h2")
    # Equal windows have equal anchors: the exchange by anchor serves the window function too.
    first = F.min(F.struct("doc", "pos")).over(Window.partitionBy("h2", "h1"))
    judged = each.withColumn("_first", first).filter((F.col("n") > 0) | (F.struct("doc", "pos") > F.col("_first"))).select("part", "doc", "_h", "pos", F.greatest("n", F.lit(1)).alias("n"))
    runs = judged.mapInArrow(_joined, "part int, doc bigint, _h bigint, pos int, n int")
    kind = dict(docs.dtypes)["doc_id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    return dealt.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(lambda a, b: _cut(a, b, window, arrow), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")
