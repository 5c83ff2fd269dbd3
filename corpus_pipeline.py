"""From raw documents to sharded training data, in five stages.

Every stage works on what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.llm import decontaminate, mixing, sharding, simhash, toxicity  # noqa: E402
from plumbline.llm.queries import MIX, NEW_SHARDS, old_shard, shard_folder  # noqa: E402
from plumbline.session import ensure_checkpoint_dir  # noqa: E402
from plumbline.sources.catalog import table  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose expected severity is too high. Null and empty texts have no
    evidence and are judged by the intercept; copies are judged alike; with too few labels
    (``toxicity.MIN_LABELLED``) nothing is rejected."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.not_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies. Null and empty
    texts are copies of each other; ties are resolved as ``simhash.one_of_each`` states."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item. Null and empty texts hold
    none; rows of one id are judged each by its own text."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each source to its temperature weight, as many tokens as came in. A null source is
    a source; texts without tokens are used once; repeated rows are each used."""
    return mixing.mix(docs, added=False, **MIX)


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a place in it for every document, moving the fewest bytes; affected
    shards are written below the checkpoint folder and read back. Null texts are of size 1,
    copies of a row are rows of their own, null ids are ids."""
    return sharding.rewritten(docs, old_shard(), shard_folder(spark), NEW_SHARDS).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.col("old").alias("old_shard")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]

#: SQL can express neither the fitted classifier nor the flow; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. What a stage returns is written below the
    shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
