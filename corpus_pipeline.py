"""A corpus from raw documents to packed sequences, stage by stage.

Every stage takes any table with doc_id, text, lang and source, whatever other columns it has and
whatever these are called, and all but the last give back the same columns with their values.  An empty table
gives an empty result.  Ids may be null or repeat: rows are then numbered and judged one by one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verstore.llm import exact_dedup, langid, minhash, mixing, packing
from verstore.llm.common import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or without a language that is likelier than not, go.

    Rows with equal texts stay or go together.  Texts of any length are judged as a whole.
    """
    return langid.known_language(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: that of the largest doc_id, or the last row where ids are null or repeat.

    A null text equals the empty one; rows equal in all columns become one.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (5 words, 0.8) stays: that of the smallest doc_id, or the first row where ids are null or repeat.

    Null texts and texts without words are near nothing and stay.  Of rows with equal texts one stays.
    """
    return minhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, twice at most; those that it doesn't take, and those without words, go.

    A null source is a source.  Rows that share an id are drawn one by one; ties in the
    draw go by id, so reruns agree.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text is the end id alone; longer texts than a sequence are cut.  Rows that repeat are packed each.
    """
    return packing.pack(docs, gather=2 << 20, cache=100_000, batch=2500)  # earlier stages leave less memory


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; what passes between stages is cut off in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k + 1 < len(STAGES) else docs
    return docs


ORACLE_SQL = None
