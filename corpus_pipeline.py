"""A corpus pipeline: drop toxic documents, keep one of each group of near copies, mix sources, pack sequences.

Every stage takes and returns whole rows with the columns of ``documents``,
whatever further columns there are, up to the packing. Null texts, empty tables,
ties, repeated rows and rows without an id have a stated result in each stage
(see the functions); an empty table of documents gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltloom.llm import mixing, ngram_join, packing, toxicity
from voltloom.llm.durable import Workspace
from voltloom.llm.registry import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones, does not reject.

    Null and empty texts stay; repeated rows and rows without an id are judged
    like any other; without labels nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_on_labels(docs, labels))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by shingle similarity.

    Of repeated rows one stays; a null id comes after all others; documents
    without words are in no group and all stay.
    """
    return ngram_join.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's budget takes it.

    A null source is a source, the last one; documents without words give
    nothing to the mix; repeated rows and rows without an id count for themselves.
    """
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, with their token ids; ties on the curve go by row."""
    return packing.pack_along_curve(docs, tokenizer())


#: Stages in order; each takes (spark, docs, sf_dir), and its result is written and read again for the next.
STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_similar), ("mixing", mix_sources), ("packing", pack)]
#: Models and token ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
