"""The corpus pipeline: documents from raw text to sharded training data.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the
documents are written as Parquet and read again. All stages but the last return the columns of
documents. The mix draws words by seeded multinomials, which SQL can't restate, so there is no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.decontam import decontaminate
from recollect.llm.mixing import mixed_documents
from recollect.llm.neardup import unique_documents
from recollect.llm.quality import keep_quality
from recollect.llm.sharding import shards
from recollect.llm.staging import Staged
from recollect.sources.tables import table

SHARD_BYTES = 8 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    teaches = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return keep_quality(docs, table(spark, sf_dir, "labels"), teaches)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return unique_documents(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, one row for each pass over it."""
    return mixed_documents(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return shards(docs, SHARD_BYTES)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Staged(stage(spark, docs, sf_dir), f"stage-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
