"""Jump consistent hashing of stable keys to shards, without a ring table. Native: expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.llm.common import free_names, rank_key, running

#: The generator's multiplier and modulus, as published for this hash.
MULTIPLIER = "2862933555777941757BD"
MODULUS = "18446744073709551616BD"


def key_hash(key: Column) -> Column:
    """The first 64 bits of the key's MD5, unsigned; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def jump_hash(seed: Column, shards: int) -> Column:
    """The shard (int) that the jumps of ``seed`` (decimal(20,0), below 2^64) end in.

    A key's next jump goes to floor((b + 1) / r) for a uniform r, which is as if each appended shard drew its fair part
    of all keys: with one shard more, a key stays or moves into the new one. A key jumps about ln(shards) times; the fold
    has room for the worst case of one jump a shard and idles once the target lies beyond the last one.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        grown = ((s["k"] * F.expr(MULTIPLIER) + F.expr("1BD")) % F.expr(MODULUS)).cast("decimal(20,0)")
        draw = (F.floor(grown / F.expr("8589934592BD")) + 1).cast("double")
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / draw)).cast("bigint")
        go = s["j"] < shards
        return F.struct(F.when(go, grown).otherwise(s["k"]).alias("k"), F.when(go, s["j"]).otherwise(s["b"]).alias("b"), F.when(go, to).otherwise(s["j"]).alias("j"))

    start = F.struct(seed.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, shard, slot and grown_shard (the shard among ``shards`` + 1) added or replaced.

    size: UTF-8 bytes of the text plus 1; a null text counts as empty. The key alone decides the shard: null keys share
    one, and repeated rows stay together. Slots number a shard's rows from 0 without gaps, in a pseudorandom order of
    key and text, the same on every run; buckets of that order are ranked apart, so that a hot shard or key costs no
    single task. Rows that agree in key and text take neighbouring slots in no fixed order. Other columns ride along.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    clash = [c for c in docs.columns if c.lower() in ("size", "text_crc32", "shard", "slot", "grown_shard")]
    (rank,) = free_names(docs, "_rank")
    seed = key_hash(F.col(key))
    placed = (
        docs.drop(*clash)
        .withColumn("size", (F.octet_length(body) + 1).cast("bigint"))
        .withColumn("text_crc32", F.crc32(body.cast("binary")))
        .withColumn("shard", jump_hash(seed, shards))
        .withColumn("grown_shard", jump_hash(seed, shards + 1))
        .withColumn(rank, rank_key(F.col(key), F.col("text_crc32")))
    )
    return running(placed, "shard", rank, [key, "text_crc32", "size"], F.lit(1), "slot").drop(rank)
