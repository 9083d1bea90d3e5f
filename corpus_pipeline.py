"""The corpus pipeline: documents through toxicity, near duplicates, decontamination, mixing and sharding.

Each stage is a function of (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as
Parquet and read again before the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from confab.llm import decontaminate, jaccard, mixing, sharding, toxicity
from confab.llm.common import own_folder, removed, shipped
from confab.llm.queries import table, training_labels

SHARDS = 16


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; labels of held-out rows teach nothing."""
    machine = toxicity.fit(docs, training_labels(spark, sf_dir))
    return toxicity.without_toxic(docs, machine)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row: that with the smallest doc_id, of its texts under one id the least by MD5."""
    return jaccard.without_near_duplicates(docs, n=5, threshold=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of the documents, a row for each pass over a document."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and the slot in it."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", shipped(toxicity_stage)),
    ("ngram_jaccard_join", shipped(jaccard_stage)),
    ("decontamination", shipped(decontamination_stage)),
    ("mixing", shipped(mixing_stage)),
    ("sharding", shipped(sharding_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written to the shared folder and read again, and goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{own_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            removed(spark, before)
        before = f"{base}/{name}"
    return docs


#: The learned score of the first stage and the pseudorandom draws of the mix have no SQL form; tests check the stages.
ORACLE_SQL = None
