"""Quality rules: fixed counts of a text, then a log-likelihood ratio of hashed n-grams between trusted and raw text.

Two multinomials over hash buckets of words and word pairs are counted, one over the trusted documents, one over the
whole corpus. A document's score is the mean log ratio of its n-grams; it is kept from a fixed threshold on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.texts import WordHash, shingles, texts_of

BUCKETS = 1 << 16
#: Pseudo-counts a bucket: the target's model leans on the raw one where the target is thin.
PRIOR = 0.5
THRESHOLD = -0.12
#: Trusted documents that the target's model is fitted on, at most; of more, those that come first by a hash of their id. Bounds the broadcast at 8 MB.
MAX_TRUSTED = 1_000_000
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\v\f\r"
WINDOW = 3
REPORT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
_NO_WORD = re.compile(rb"[^ \t-\r]")


def buckets(words: np.ndarray) -> np.ndarray:
    """Bucket of every word and of every pair of neighbours."""
    return np.concatenate([shingles(words, 1, salt=1), shingles(words, 2, salt=2)]) % np.uint64(BUCKETS)


def _counted(batches: Iterator[pa.RecordBatch], trusted) -> Iterator[pa.RecordBatch]:
    """A partition's sketch: for each bucket seen, its count in all and in trusted texts."""
    words, raw, good = WordHash(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        marked = np.isin(ids.fill_null(0).to_numpy(), trusted.value) & ids.is_valid().to_numpy(zero_copy_only=False)
        own = [buckets(words.of(text.lower().split())).view(np.int64) for text in texts_of(batch)]
        for total, some in ((raw, own), (good, [x for x, is_good in zip(own, marked.tolist(), strict=True) if is_good])):
            if some:
                total += np.bincount(np.concatenate(some), minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(good[seen])], names=["bucket", "raw", "good"])


def fit(docs: DataFrame, trusted: DataFrame, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """log(p_trusted / p_raw) a bucket; the raw counts cover every document, the trusted ones those named in ``trusted`` (doc_id).

    Partitions send at most one row a bucket, and the driver gets BUCKETS rows whatever the corpus. No trusted document, or
    no text at all: zeros.
    """
    ids = trusted.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    known = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).toArrow().column("doc_id").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(np.sort(known))
    rows = docs.select("doc_id", "text").mapInArrow(lambda b: _counted(b, held), "bucket int, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.sum():
        return np.zeros(BUCKETS)
    base = (raw + PRIOR) / (raw.sum() + PRIOR * BUCKETS)
    # The raw model is the prior of the target's, worth PRIOR counts a bucket.
    return np.log((good + PRIOR * BUCKETS * base) / (good.sum() + PRIOR * BUCKETS) / base)


def base_counts(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - sum(map(text.count, (WHITE[i : i + 1] for i in range(len(WHITE)))))
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif _NO_WORD.search(line):
            seen.add(line)
    repeat = 0
    if n > WINDOW:
        _, at, times = np.unique(shingles(hashes, WINDOW), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[at] > 1)
        if len(starts):
            mask = np.zeros(n, bool)
            for i in range(WINDOW):
                mask[starts + i] = True
            repeat = int(mask.sum())
    return n, chars, symbols, dup, repeat, n < MIN_WORDS or 100 * repeat > 50 * n


def _judged(batches: Iterator[pa.RecordBatch], model, threshold: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    cased, lower, weights = WordHash(), WordHash(), model.value
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for text in texts_of(batch, "text"):
            words = text.split()
            base = base_counts(text, words, cased.of(words))
            grams = buckets(lower.of(text.lower().split())).view(np.int64)
            score = float(weights[grams].mean()) if len(grams) else 0.0
            for column, value in zip(out, (*base, score, not base[-1] and score >= threshold), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        added = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added], names=[*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"])


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    Words are cased for the counts, A-Z lower-cased for the model. A null or empty text has no words, an llr of 0 and fails the
    base rules (n_words < 50). Every row is judged where it lies, repeated rows alike; the model is a broadcast of fixed size.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, trusted))
    names = list(keep)
    rows = docs.select(*names, "text")
    kinds = ", ".join(f"`{n}` {dict(docs.dtypes)[n]}" for n in names)
    return rows.mapInArrow(lambda b: _judged(b, model, threshold, names), f"{kinds}, {REPORT}, llr double, kept boolean")
