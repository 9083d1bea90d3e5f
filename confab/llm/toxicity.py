"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words without their outer punctuation and the words' first letters, hashed. The
machine adds a weight for each term and an inner product for each pair of them, so that terms which only mean
something together, an insult and a group it is aimed at, count as that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from confab.llm.common import Scratch, lean
from confab.llm.texts import CACHE, texts_of

BUCKETS = 1 << 18
FACTORS = 6
#: Labelled rows that are fitted on, at most; of more, those that come first by a hash of their id.
MAX_LABELLED = 8_000
#: Terms the machine knows: seen in so many labelled documents, and of those the most telling, besides what tells in pairs.
MIN_SEEN, MAX_TERMS = 3, 4096
#: Chi-squared (one degree of freedom) that a term's tie to the label must reach.
TELLING = 10.0
#: The most frequent terms, so many, are also tried in pairs; this chance of any pair that passes without a tie is accepted.
PAIRED, PAIR_CHANCE = 2048, 0.01
PREFIX = 5
EPOCHS, RATE, DECAY = 60, 0.15, 1e-3
CUT = 0.3
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_"


def terms_of(word: bytes) -> tuple[int, int]:
    """Buckets of a word and of its first letters."""
    plain = word.strip(EDGES).lower()
    head = plain.decode("utf-8", "replace").lower()
    return xxh3_64_intdigest("w" + head) % BUCKETS, xxh3_64_intdigest("p" + head[:PREFIX]) % BUCKETS


class Codes(dict):
    """word -> a number that stands for its terms, in ``pairs``; forgets at CACHE words."""

    def __init__(self, known: np.ndarray | None = None):
        super().__init__()
        self.known, self.pairs, self.numbers = known, [], {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        pair = terms_of(word)
        if self.known is not None:
            pair = tuple(int(t) for t in self.known[list(pair)] if t >= 0)
        code = self.numbers.setdefault(pair, len(self.pairs))
        if code == len(self.pairs):
            self.pairs.append(pair)
        self[word] = code
        return code

    def terms(self, text: bytes) -> list[int]:
        """Distinct terms of a text, sorted."""
        return sorted({t for code in set(map(self.__getitem__, text.split())) for t in self.pairs[code]})


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's number of rows and of toxic ones for each term; term -1 stands for all rows."""
    codes, flat, marks = Codes(), [], []
    for batch in batches:
        for mark, text in zip(batch.column("toxic").to_pylist(), texts_of(batch), strict=True):
            flat.append(np.array([-1, *codes.terms(text)], np.int32))
            marks.append(np.full(len(flat[-1]), mark))
    if flat:
        terms, at = np.unique(np.concatenate(flat), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.bincount(at).astype(float)), pa.array(np.bincount(at, weights=np.concatenate(marks)))], names=["term", "n", "pos"])


def _featured(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    codes = Codes(known.value)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([codes.terms(t) for t in texts_of(batch)], pa.list_(pa.int32()))], names=["toxic", "terms"])


class Machine:
    """known: bucket -> term or -1; w0, w, v: the machine's parameters."""

    def __init__(self, known: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.known, self.w0, self.w, self.v = known, w0, w, v

    def score(self, terms: list[int]) -> float:
        v = self.v[terms]
        total = v.sum(axis=0)
        z = self.w0 + self.w[terms].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def telling(seen: np.ndarray, hit: np.ndarray, n: int, pos: float) -> np.ndarray:
    """bucket -> term or -1: the terms whose tie to the label is the strongest by chi-squared, from the rows and toxic rows that hold each."""
    known = np.full(len(seen), -1, np.int32)
    a, b, c, d = hit, seen - hit, pos - hit, n - pos - (seen - hit)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num(n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)))
    chi[seen < MIN_SEEN] = 0
    chosen = np.sort(np.argsort(-chi, kind="stable")[:MAX_TERMS])
    chosen = chosen[chi[chosen] >= TELLING]
    known[chosen] = np.arange(len(chosen))
    return known


def frequent(seen: np.ndarray) -> np.ndarray:
    """The PAIRED buckets that most rows hold, of those seen often enough, in order; the first on ties."""
    most = np.argsort(-seen, kind="stable")[:PAIRED]
    return np.sort(most[seen[most] >= MIN_SEEN])


def paired(rows: list[np.ndarray], labels: np.ndarray, size: int, block: int = 512) -> np.ndarray:
    """Which of the terms 0 to ``size`` (others in ``rows`` are left out) tell something in a pair, whatever they tell alone.

    Rows that hold both terms of a pair should be toxic no more often than those that hold the worse of the two. Chernoff's bound on the chance that
    they are as often as seen, times the number of pairs, must lie below PAIR_CHANCE. Rows with the same terms count once.
    """
    own = {(r[r < size].tobytes(), y): r[r < size] for r, y in zip(rows, labels.tolist(), strict=True)}
    marks = np.array([y for _, y in own])
    if size < 2 or not marks.sum():
        return np.zeros(size, bool)
    held = np.zeros((len(own), size), np.float32)
    for i, r in enumerate(own.values()):
        held[i, r] = 1
    toxic = held[marks > 0]
    alone = (toxic.sum(axis=0) + 0.5) / (held.sum(axis=0) + 1.0)
    best = np.zeros(size)
    for lo in range(0, size, block):
        both, hit = held[:, lo : lo + block].T @ held, toxic[:, lo : lo + block].T @ toxic
        worse, share = np.maximum(alone[lo : lo + block, None], alone), hit / np.maximum(both, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.nan_to_num(share * np.log(share / worse)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - worse)))
        best[lo : lo + block] = np.where(share > worse, both * gain, 0.0).max(axis=1)
    return best >= np.log(size * (size - 1) / 2 / PAIR_CHANCE)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, known: np.ndarray, seed: int = 7) -> Machine:
    """Adagrad on the log loss with decay, full batch, from small random factors; the same for the same rows (terms that ``known`` names) in the same order."""
    n, pos, terms = len(rows), float(labels.sum()), int(known.max(initial=-1)) + 1
    rate = (pos + 0.5) / (n + 1.0)
    w0 = float(np.log(rate / (1 - rate)))
    if not n or not pos or pos == n:
        return Machine(np.full(len(known), -1, np.int32), w0, np.zeros(0), np.zeros((0, FACTORS)))
    term = np.concatenate(rows).astype(np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    rng = np.random.default_rng(seed)
    w, v = np.zeros(terms), rng.normal(0, 0.01, (terms, FACTORS))
    gw, gv, g0 = np.full(terms, 1e-8), np.full(v.shape, 1e-8), 1e-8
    add = lambda values, at, size: np.bincount(at, weights=values, minlength=size)
    for _ in range(EPOCHS):
        # A factor at a time: what is held beside the rows is a few numbers for each of their terms.
        z = w0 + add(w[term], doc, n)
        total = np.empty((n, FACTORS))
        for f in range(FACTORS):
            vx = v[term, f]
            total[:, f] = add(vx, doc, n)
            z += 0.5 * (total[:, f] ** 2 - add(vx * vx, doc, n))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        own = err[doc]
        dw = add(own, term, terms) + DECAY * w / 10
        dv = np.stack([add(own * (total[doc, f] - v[term, f]), term, terms) for f in range(FACTORS)], axis=1) + DECAY * v
        d0 = float(err.sum())
        gw, gv, g0 = gw + dw * dw, gv + dv * dv, g0 + d0 * d0
        w, v, w0 = w - RATE * dw / np.sqrt(gw), v - RATE * 0.3 * dv / np.sqrt(gv), w0 - RATE * d0 / float(np.sqrt(g0))
    return Machine(known, w0, w, v)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine:
    """``labels``: doc_id, toxic (0/1; nulls are skipped, of repeated ids the largest counts). At most ``max_labelled`` of them,
    broadcast by their id, select the texts, one for each id (of several the least). Terms are counted in the cluster, so that the driver
    gets a row a bucket and then, for each labelled id, its telling and frequent terms; of the latter those stay that tell something alone or in a pair."""
    named = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(rows, "labelled")
    counts = rows.mapInArrow(lean(_seen), "term int, n double, pos double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toArrow()
    terms, seen, hit = (counts.column(c).to_numpy() for c in ("term", "n", "pos"))
    every = terms < 0
    by_bucket = np.zeros((2, BUCKETS))
    by_bucket[:, terms[~every]] = seen[~every], hit[~every]
    known, usual = telling(*by_bucket, int(seen[every].sum()), float(hit[every].sum())), frequent(by_bucket[0])
    # The frequent terms come first, then the other telling ones.
    asked = np.r_[usual, np.setdiff1d(np.flatnonzero(known >= 0), usual)]
    place = np.full(BUCKETS, -1, np.int32)
    place[asked] = np.arange(len(asked))
    held = docs.sparkSession.sparkContext.broadcast(place)
    got = rows.mapInArrow(lean(lambda b: _featured(b, held)), "toxic double, terms array<int>").toArrow()
    held.destroy()
    scratch.drop(rows)
    lists = got.column("terms").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    marks, ends, flat = got.column("toxic").to_numpy(), np.asarray(lists.offsets), np.asarray(lists.values)
    split = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    more = paired(split, marks, len(usual))
    chosen = np.union1d(np.flatnonzero(known >= 0), usual[more])
    known = np.full(BUCKETS, -1, np.int32)
    known[chosen] = np.arange(len(chosen))
    final = known[asked]
    split = [np.sort(own[own >= 0]) for own in (final[r] for r in split)]
    # The rows come in no fixed order; the sums are to be the same each time.
    order = sorted(range(len(split)), key=lambda i: (xxh3_64_intdigest(split[i].tobytes()), marks[i]))
    return fit_rows([split[i] for i in order], marks[order] if order else np.zeros(0), known)


def _scored(batches: Iterator[pa.RecordBatch], machine, names: list[str]) -> Iterator[pa.RecordBatch]:
    codes = Codes(machine.value.known)
    for batch in batches:
        scores = [machine.value.score(codes.terms(t)) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], names=[*names, "score"])


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` and score (0 to 1) of every whole text, row by row where it lies.

    Null and empty texts, and texts without a known term, score the labels' base rate. Neither ids nor labels enter. A column
    named score among ``keep`` would clash and must be left out. The broadcast machine has a fixed size.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    names = list(keep)
    kinds = ", ".join(f"`{n}` {dict(docs.dtypes)[n]}" for n in names)
    rows = docs.select(*names, *([] if "text" in names else ["text"]))
    return rows.mapInArrow(lean(lambda b: _scored(b, held, names)), f"{kinds}, score double")


def _passed(batches: Iterator[pa.RecordBatch], machine, cut: float) -> Iterator[pa.RecordBatch]:
    codes = Codes(machine.value.known)
    for batch in batches:
        yield batch.filter(pa.array([machine.value.score(codes.terms(t)) < cut for t in texts_of(batch)], pa.bool_()))


def without_toxic(docs: DataFrame, machine: Machine, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``cut``; no column is added, so no name can clash."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.mapInArrow(lean(lambda b: _passed(b, held, cut)), docs.schema)
