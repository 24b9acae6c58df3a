"""A training corpus from raw documents, stage by stage.

Each stage is one operator of ``quernstone.llm`` applied to all that the stage before it
kept; what it returns is written as Parquet and read again. All stages but the last keep
the columns of ``documents``; the last returns the packed pieces.

Defined cases: rows with a null in any column, with an empty text or one of any length are
documents like any other; a stage that gets an empty table returns one; further columns
are carried along by all stages but the last, whatever their names. Repeated rows and rows
without an id are named at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import mixing, ngrams, packing, quality, suffixes
from quernstone.llm.common import Scratch, intermediates


def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. A null text is scored as an
    empty one; repeated rows are scored each; a row without an id can't have a label."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones, that with the smallest id. Of rows
    that repeat an id and text one stays; two texts with one id are two documents; rows
    without words or without an id all stay."""
    return ngrams.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of the texts what an earlier place already holds. Rows without an id come
    last; rows that repeat an id and text are one document; a null text stays null; a
    document that loses its whole text stays, with an empty one."""
    return suffixes.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their target weights. A null
    source is a source of its own; rows with one id (or none) and one source are taken
    alike, so the repeated rows of a document are."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences. A null or empty text is its end token;
    each row is packed, so copies are; a null id stays null."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good_text),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokenising and the fitted classifier are beyond SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with intermediates():
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
