"""A training corpus from documents: language, exact and near copies, mix, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over the rows that the one before
it kept; all but the last return the columns of documents.  Rows may have nulls in any column,
texts may be empty, rows repeated; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import curve_packing, exact_dedup, language, mixing, simhash
from eventloom.runtime import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language (null or letterless texts) go; a lang that is null is filled in."""
    return language.identified(docs.select(*COLUMNS))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the smallest doc_id stays."""
    return exact_dedup.first_of_each(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal fingerprints (loose ones, of several families), the smallest doc_id stays."""
    return simhash.one_of_each(docs.select(*COLUMNS), families=simhash.FAMILIES, loose=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a document taken again is a row again (right after it), one taken in part is cut.

    Rows aren't laid out by shard here, since the next stage orders them along its curve.
    """
    return mixing.Mix(docs.select(*COLUMNS)).documents().select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, in curve order; what the mix takes again comes in a pass of its own."""
    return curve_packing.pack(docs.select("doc_id", "text"), apart=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("packing", packing)]
#: Models, streams and random draws aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two stages is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
