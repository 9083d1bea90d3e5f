"""Mixing sources to target weights by drawing packed blocks.

Each source's documents, in a pseudorandom but fixed order, form one stream of words that is cut into blocks of equal
length, shorter ones in a source too small for LEAST_BLOCKS. Output shards draw how many slots each source fills (multinomial, held to the sources' quotas); a source's
slots, numbered on, map through a keyed permutation of its block numbers, a fresh one for every pass over the
source; slots and blocks meet in a join by block number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.llm.common import free_names, lean, let, rank_key, running, small_table
from confab.llm.texts import mixed

BLOCK = 64
#: A source has so many blocks, if it has the words: quotas are whole blocks.
LEAST_BLOCKS = 32
SHARDS = 64
#: A source's words are taken at most this often.
PASSES = 3
WEIGHTS = (1, 2, 3)
#: Slots that one input row of the permutation stands for.
RUN = 1 << 16
#: The plan holds a row per source on the driver; more sources than this raise.
MAX_SOURCES = 100_000
SPACE = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of sum(sizes) by weight; none above PASSES times its size, the excess reshared by weight among the others."""
    caps = [PASSES * s for s in sizes]
    fixed: dict[int, float] = {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        rest, total = sum(sizes) - sum(fixed.values()), sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total > caps[i]]
        if not over:
            return [fixed[i] if i in fixed else rest * weights[i] / total for i in range(len(sizes))]
        fixed |= {i: float(caps[i]) for i in over}


def draws(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: slot counts. Every shard draws from a multinomial whose chances are the quotas still open, is held to
    them, and gives what was cut to the sources with the most left; the shards' sums are the quotas."""
    rng = np.random.default_rng(seed)
    left = np.array(quotas, dtype=np.int64)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    for j in range(shards):
        slots = int(left.sum()) // (shards - j)
        if j == shards - 1 or not slots:
            got = left.copy() if j == shards - 1 else np.zeros_like(left)
        else:
            got = np.minimum(rng.multinomial(slots, left / left.sum()), left)
            for i in np.argsort(got - left, kind="stable"):
                more = min(slots - int(got.sum()), int(left[i] - got[i]))
                got[i] += more
        out[j], left = got, left - got
    return out


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..size-1 at ``index``: a four-round Feistel network on the next even power of two, walked until it falls inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    rounds = mixed(np.arange(1, 5, dtype=np.uint64) + np.uint64(key % (1 << 60)) * np.uint64(8))
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in rounds:
            left, right = right, left ^ (mixed(right ^ r) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= size
    return out.astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ordinal = np.arange(row["first"], row["first"] + row["n"], dtype=np.int64)
            rounds, place = ordinal // row["blocks"], ordinal % row["blocks"]
            block = np.empty_like(place)
            for p in np.unique(rounds):
                at = rounds == p
                block[at] = permuted(place[at], row["blocks"], ((seed * 1_000_003 + row["src"]) * 8 + int(p)))
            n = len(ordinal)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["shard"], np.int32)), pa.array(row["slot"] + np.arange(n)), pa.array(np.full(n, row["src"], np.int32)), pa.array(block), pa.array(rounds.astype(np.int32))],
                names=["shard", "slot", "src", "block", "round"],
            )


def row_key(docs: DataFrame) -> Column:
    """A rank_key of whole rows, 128 bits of all columns: only equal rows share one (null and empty texts pass for equal)."""
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return rank_key(text, F.to_json(F.struct(*[c for c in docs.columns if c != "text"])))


class Mix:
    """The mix of ``docs`` (doc_id, source and text; other columns ride along unused).

    A document's size is its number of words; null texts and texts without words have none and are never taken. A null source is
    a source, ordered last. Documents take their places by a hash of their rows, so that reruns agree; equal rows
    are interchangeable. ``sources`` holds one row per source: src, source, source_size, target, blocks, quota, length (words in a block).
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 7, weights: tuple[float, ...] = WEIGHTS):
        self.seed = seed
        spark = docs.sparkSession
        body = F.coalesce(F.col("text"), F.lit(""))
        sized = docs.select("doc_id", "source", F.regexp_count(body, F.lit(SPACE)).cast("bigint").alias("size"), row_key(docs).alias("_rank"))
        self.placed = running(sized, "source", "_rank", ["doc_id", "size"], F.col("size"), "start")
        found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["n"] for r in found]
        aims = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))]) if found else []
        lengths = [max(1, min(block, n // LEAST_BLOCKS)) for n in sizes]
        blocks = [-(-n // length) for n, length in zip(sizes, lengths, strict=True)]
        quotas = [min(PASSES * b, max(1, round(t * b / n))) if n and t > 0 else 0 for t, b, n in zip(aims, blocks, sizes, strict=True)]
        self.sources = small_table(
            spark, [(i, r["source"], r["n"], t, b, q, w) for i, (r, t, b, q, w) in enumerate(zip(found, aims, blocks, quotas, lengths, strict=True))], "src int, source string, source_size bigint, target double, blocks bigint, quota bigint, length bigint"
        )
        self.plan = draws(quotas, shards, seed) if found else np.zeros((shards, 0), np.int64)
        self.blocks_of = blocks

    def slots(self) -> DataFrame:
        """shard, slot (from 0 in each shard), src, block, round: what every slot of the output holds."""
        spark = self.placed.sparkSession
        taken = np.cumsum(self.plan, axis=0) - self.plan
        place = np.cumsum(self.plan, axis=1) - self.plan
        rows = [(j, int(place[j, s]), s, int(taken[j, s]), int(n), self.blocks_of[s]) for j in range(len(self.plan)) for s, n in enumerate(self.plan[j]) if n]
        plan = small_table(spark, rows, "shard int, slot bigint, src int, first bigint, n bigint, blocks bigint")
        runs = plan.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN).cast("bigint"))))
        runs = runs.select("shard", (F.col("slot") + F.col("o")).alias("slot"), "src", (F.col("first") + F.col("o")).alias("first"), F.least(F.col("n") - F.col("o"), F.lit(RUN)).alias("n"), "blocks")
        seed = self.seed
        # The rows are tiny but stand for up to RUN slots each: a task for about so many, which Spark mustn't merge.
        tasks = max(1, -(-int(self.plan.sum()) // RUN))
        return runs.repartition(tasks, "shard", "src", "first").mapInArrow(lean(lambda b: _slots(b, seed)), "shard int, slot bigint, src int, block bigint, round int")

    def pieces(self) -> DataFrame:
        """src, block, start (the document's place in its source), doc_id, size, a, b: words a to b (exclusive) of the document lie in the block."""
        known = self.placed.join(self.sources.select("src", F.col("source").alias("_s"), "length"), F.col("source").eqNullSafe(F.col("_s")))
        rows = known.filter(F.col("size") > 0)
        each = rows.withColumn("block", F.explode(F.sequence(F.call_function("div", F.col("start"), F.col("length")), F.call_function("div", F.col("start") + F.col("size") - 1, F.col("length")))))
        a = F.greatest(F.col("block") * F.col("length") - F.col("start"), F.lit(0))
        b = F.least((F.col("block") + 1) * F.col("length") - F.col("start"), F.col("size"))
        return each.select("src", "block", "start", "doc_id", "size", a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def taken(self) -> DataFrame:
        """doc_id, size, source, source_size, target, taken for every document."""
        times = self.slots().groupBy("src", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")  # many rows from a small plan, which would pass for small
        words = self.pieces().join(times, ["src", "block"]).groupBy("src", "start").agg(F.sum(F.col("times") * (F.col("b") - F.col("a"))).alias("taken")).hint("merge")
        named = self.placed.join(self.sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        hit = words.withColumn("_some", F.lit(1)).hint("merge")
        joined = named.withColumn("_some", F.when(F.col("size") > 0, 1)).join(hit, ["src", "start", "_some"], "left")
        return joined.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """shard, slot, source, text: the blocks of the output, their words joined by a space."""
        (key,) = free_names(docs, "_r")
        body = docs.select(row_key(docs).alias(key), F.coalesce(F.col("text"), F.lit("")).alias("body")).dropDuplicates([key])
        keyed = self.placed.select("source", "start", F.col("_rank").alias(key), "size").filter(F.col("size") > 0).join(self.sources.select("src", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).select("src", "start", key)
        # A text is cut into words once for each row that the mix places, and that row's pieces come out of it.
        own = self.pieces().groupBy("src", "start").agg(F.collect_list(F.struct("block", "a", "b")).alias("cuts"))
        cut = F.explode(pieces_of(F.col("body"), F.col("cuts"))).alias("p")
        parts = own.join(keyed, ["src", "start"]).join(body, key).select("src", "start", cut).select("src", "start", "p.*")
        packed = parts.groupBy("src", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "words"))), lambda x: x["words"]), " ").alias("text"))
        return self.slots().hint("merge").join(packed, ["src", "block"]).join(self.sources.select("src", "source"), "src").select("shard", "slot", "source", "text")


def words_of(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(SPACE), F.lit(0))


def cut_words(words: Column, p: Column) -> Column:
    return F.slice(words, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))


def pieces_of(body: Column, cuts: Column) -> Column:
    """array<struct<block, words>> of a text's pieces (block, a, b), words joined by a space."""
    return let(words_of(body), lambda words: F.transform(cuts, lambda p: F.struct(p["block"].alias("block"), F.array_join(cut_words(words, p), " ").alias("words"))))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with ``docs``'s columns: one row for each pass that takes words of a document.

    A pass that takes a document whole repeats its row as it is. One that takes some of its blocks holds those
    blocks' words in order, joined by a space, and their number of characters as n_chars where ``docs`` has that column.
    Equal rows share a key, and one of them stands for all that was taken of them, a row for each.
    """
    key, first, of, size, parts = free_names(docs, "_r", "_start", "_n", "_size", "_parts")
    mix = Mix(docs, **options)
    hits = mix.pieces().join(mix.slots().select("src", "block", "round").hint("merge"), ["src", "block"])
    rounds = hits.groupBy("src", "start", "round").agg(F.sum(F.col("b") - F.col("a")).alias(of), F.array_sort(F.collect_list(F.struct("a", "b"))).alias(parts))
    places = mix.placed.join(mix.sources.select("src", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).filter(F.col("size") > 0)
    wanted = rounds.join(places.select("src", "start", "size", F.col("_rank").alias(key)), ["src", "start"]).select(key, F.col("start").alias(first), of, F.col("size").alias(size), F.when(F.col(of) < F.col("size"), F.col(parts)).alias(parts)).hint("merge")
    each = docs.withColumn(key, row_key(docs)).dropDuplicates([key]).join(wanted, key)
    whole = F.col(parts).isNull()
    cut = let(words_of(F.coalesce(F.col("text"), F.lit(""))), lambda words: F.array_join(F.flatten(F.transform(F.col(parts), lambda p: cut_words(words, p))), " "))
    out = each.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)
