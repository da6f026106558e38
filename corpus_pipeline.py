"""The corpus pipeline: quality, near copies, benchmark passages, source mixture, packed token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardmap.llm.decontaminate import without_contaminated
from wardmap.llm.mixing import mixed
from wardmap.llm.near_copies import without_near_copies
from wardmap.llm.packing import packed
from wardmap.llm.quality import good_documents
from wardmap.llm.tables import table
from wardmap.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the rules or that the classifier rejects."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


#: Similarity of near copies in the pipeline: five words, 0.8 or more.
NEAR = {"shingle": 5, "similarity": (80, 100)}


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return without_near_copies(docs, **NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window of ten words with a benchmark item, or a whole item of five to nine."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), least_words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their targets."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed into rows."""
    return packed(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("pack", pack)]
#: Trained verdicts and packing have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
