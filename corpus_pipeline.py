"""From raw documents to packed sequences: each stage is one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from noticeboard.llm import decontaminate, linededup, neardup, pack, toxicity
from noticeboard.llm.common import scratch, shared_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document has are deleted; documents of which nothing is left go."""
    return linededup.deduplicated(docs, length_col="n_chars")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8) the document with the least id stays."""
    return neardup.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return pack.packed(docs)


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("pack", pack_stage)]
#: no stage but decontamination can be said in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents. What a stage stores on its way goes when its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
