"""Token counts of documents in flat, unindexed token files, by a vectorised scan for the end-of-document id.

A token file is nothing but ids, little-endian and of fixed width, every document closed by the separator. It is read
in blocks of fixed size that cut documents anywhere. Each block is searched on its own; what a block can't know, how
many documents ended before it and where the last one did, comes from a prefix scan over the blocks' summaries.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.llm.common import staged

#: The vocabulary's path, on the driver, is a parameter; this is where the box keeps one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256
WIDTH = 2
BLOCK = 1 << 20
#: The published pre-tokenisation pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Blocks that the first level of the prefix scan spans.
SPAN = 1024
#: Files up to this size come through Spark's own reader of whole files, larger ones by ranges.
WHOLE = 1 << 30


@lru_cache(maxsize=2)
def encoding(ranks: bytes):
    """The tokenizer of a ranks file's content; built once a worker."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _packed(batches: Iterator[pa.RecordBatch], ranks, separator: int, width: int, block: int) -> Iterator[pa.RecordBatch]:
    """A file per partition, as rows (file, block, data, ids): ids are the documents that end in the block, in order."""
    encode, kind = encoding(ranks.value).encode_ordinary, np.dtype(f"<u{width}")
    file, number, held, ids = TaskContext.get().partitionId(), 0, bytearray(), []
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])
    step = block * width

    def row(data: bytes, own: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [file], "block": [number], "data": [data], "ids": [own]}, schema=schema)

    for batch in batches:
        for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            tokens = np.asarray(encode(text.as_py() or ""), dtype=kind)
            if (tokens == separator).any():
                raise ValueError("the separator id occurs within a document")
            held += tokens.tobytes()
            while len(held) >= step:
                yield row(bytes(held[:step]), ids)
                del held[:step]
                ids, number = [], number + 1
            held += np.asarray([separator], dtype=kind).tobytes()
            ids.append(key.as_py())
            while len(held) >= step:
                yield row(bytes(held[:step]), ids)
                del held[:step]
                ids, number = [], number + 1
    if held or ids:
        yield row(bytes(held), ids)


def pack(docs: DataFrame, path: str = VOCABULARY, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Documents as flat token files, one a partition: file, block, data, and ids, a manifest beside the data.

    ``block`` counts tokens. Null and empty texts hold no token, only their separator. The texts are encoded as ordinary
    text, so that a separator's own spelling in a text isn't one. The vocabulary is read on the driver and broadcast (a megabyte or two).
    """
    rows = docs.select("doc_id", "text")
    ranks = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    return rows.mapInArrow(lambda b: _packed(b, ranks, separator, width, block), "file bigint, block bigint, data binary, ids array<bigint>")


def _ranges(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            store, path = fs.FileSystem.from_uri(file)
            with store.open_input_file(path) as source:
                source.seek(block * step)
                yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "data": [source.read(step)]})


def read_token_files(spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """Flat token files below ``path`` as file (its name), block, data; files may have any size.

    Spark lists them without their content. Files of up to ``whole`` bytes are read by Spark from whatever store it knows; of larger ones each
    task reads its ranges, which takes a store that Arrow opens too (local, HDFS, S3, GCS).
    """
    step = block * width
    found = spark.read.format("binaryFile").load(path)
    last = F.greatest(F.ceil(F.col("length") / step) - 1, F.lit(0).cast("bigint"))
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block")
    small = found.filter(F.col("length") <= whole).select(F.col("path").alias("file"), "content", numbers).select("file", "block", F.substring("content", (F.col("block") * step + 1).cast("int"), F.lit(step)).alias("data"))
    ranges = found.filter(F.col("length") > whole).select(F.col("path").alias("file"), numbers)
    large = ranges.repartition("file", "block").mapInArrow(lambda b: _ranges(b, step), "file string, block bigint, data binary")
    return small.unionByName(large)


def _searched(batches: Iterator[pa.RecordBatch], separator: int, width: int) -> Iterator[pa.RecordBatch]:
    kind = np.dtype(f"<u{width}")
    for batch in batches:
        sizes = [len(x.as_py()) // width for x in batch.column("data")]
        ends = [np.flatnonzero(np.frombuffer(x.as_py(), dtype=kind, count=n) == separator) for x, n in zip(batch.column("data"), sizes, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array([e.tolist() for e in ends], pa.list_(pa.int64()))], names=["file", "block", "size", "ends"]
        )


def block_offsets(found: DataFrame) -> DataFrame:
    """file, block, base (tokens before the block), seen (separators before it), open (the place of the last one before it, or -1).

    A prefix scan in two levels over three numbers a block: within spans of SPAN blocks, then over the spans, so that even a file that
    holds everything gives no task more than its share.
    """
    blocks = found.select("file", "block", F.floor(F.col("block") / SPAN).alias("span"), "size", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    # Separators grow along a file, so the last one before a block is the largest so far.
    before = lambda key, order: Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = before(["file", "span"], "block")
    inner = blocks.withColumn("b", F.coalesce(F.sum("size").over(own), F.lit(0))).withColumns({"s": F.coalesce(F.sum("n").over(own), F.lit(0)), "o": F.max(F.col("b") + F.col("last")).over(own)})
    spans = inner.groupBy("file", "span").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max(F.col("b") + F.col("last")).alias("last"))
    outer = before(["file"], "span")
    spans = spans.withColumn("base", F.coalesce(F.sum("size").over(outer), F.lit(0))).withColumns({"seen": F.coalesce(F.sum("n").over(outer), F.lit(0)), "open": F.max(F.col("base") + F.col("last")).over(outer)})
    joined = inner.select("file", "span", "block", "b", "s", "o").join(spans.select("file", "span", "base", "seen", "open"), ["file", "span"])
    return joined.select("file", "block", (F.col("base") + F.col("b")).alias("base"), (F.col("seen") + F.col("s")).alias("seen"), F.coalesce(F.col("base") + F.col("o"), "open", F.lit(-1)).alias("open"))


def document_tokens(files: DataFrame, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """file, ordinal (0 for a file's first document), start (its offset in tokens), n_tokens for every closed document.

    ``files`` has file, block (0, 1, ... within a file) and data. Tokens after a file's last separator belong to no document, and bytes
    after its last whole token to none. Blocks may be of any size and a document may span many; empty files have no documents.
    """
    found = searched(files, separator, width)
    return _closed(found, block_offsets(found))


def searched(files: DataFrame, separator: int, width: int) -> DataFrame:
    """file, block, size, ends of every block, as a table: it is read for the scan and for the documents."""
    kind = dict(files.dtypes)["file"]
    return staged(files.select("file", "block", "data").mapInArrow(lambda b: _searched(b, separator, width), f"file {kind}, block bigint, size bigint, ends array<bigint>"), "separators")


def _closed(found: DataFrame, offsets: DataFrame) -> DataFrame:
    each = found.filter(F.size("ends") > 0).join(offsets, ["file", "block"]).select("file", "base", "seen", "open", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1)) + 1
    return each.select("file", (F.col("seen") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, file, start of every row of ``docs`` (repeated rows count each): packed, scanned and matched to the manifest by ordinal."""
    files = staged(pack(docs, path=path, block=block), "tokens")
    found = searched(files, SEPARATOR, WIDTH)
    offsets = block_offsets(found)
    listed = files.select("file", "block", "ids").filter(F.size("ids") > 0).join(offsets.select("file", "block", "seen"), ["file", "block"])
    names = listed.select("file", "seen", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("seen") + F.col("i")).alias("ordinal"), "doc_id")
    return names.join(_closed(found, offsets), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start")
