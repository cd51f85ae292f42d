"""Exact deduplication by 128-bit content hash with byte comparison (native)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verstore.llm.common import cut, read, with_rows, without

#: Copies beyond which a text's group is large, at least; large groups are broadcast, MANY at most.
LARGE, MANY = 1000, 1000


def content_classes(keyed: DataFrame) -> DataFrame:
    """One row per distinct text: h, sha, keep_id, group_size.

    Rows meet by content hash; the text is part of the grouping key, so the
    aggregation compares bytes and texts with one hash stay apart.  Copies
    collapse before the shuffle, so a group of any size sends one row per task.
    Two texts with one SHA-256 digest could not be told apart by their
    digest; that raises an error.
    """
    texts = keyed.groupBy("h", "sha", "t").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    digests = texts.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("texts"), F.max("keep").alias("keep_id"), F.max("n").alias("n"))
    size = F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("texts share the digest "), "sha")).cast("long"))
    return digests.select("h", "sha", "keep_id", size.alias("group_size"))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.sha2(text, 256).alias("sha"))
    return rows.withColumn("h", F.substring("sha", 1, hash_bits // 4))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of equal texts is kept.  A null text equals the
    empty one.  Texts of any length are compared in full.  Rows with one id and one text are the same document: all are
    marked kept.  A null id never is the largest; a group of null ids only has
    keep_id null and its rows are kept.  Other columns are not read.  An empty
    table gives an empty result.
    """
    keyed = keyed_rows(docs, id_col, text_col, hash_bits)
    classes = cut(content_classes(keyed))  # hashes and numbers only
    # A large group's rows would meet in one task below: they get its class from a broadcast, and go anywhere.
    large = classes.where(F.col("group_size") > max(LARGE, docs.count() // MANY)).select("h", "sha", F.struct("keep_id", "group_size").alias("known"))
    rows = keyed.select("id", "h", "sha").join(F.broadcast(large), ["h", "sha"], "left")
    key = F.when(F.col("known").isNull(), F.col("sha")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    found = classes.select(F.col("sha").alias("of"), F.struct("keep_id", "group_size").alias("found"))
    rows = rows.withColumn("of", key).join(found, "of", "left").select("id", "sha", F.coalesce("known", "found").alias("of")).select("id", "sha", "of.*")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each text, with all its columns.

    The row with the largest doc_id stays; where ids are null or repeat, rows
    are numbered and the last row of each text stays, so rows that
    are equal in every column are one row in the result.  A null text equals the empty
    one.  An empty table stays empty; columns of any name are kept.
    """
    rows, row = with_rows(docs)
    gone = exact_dedup(rows.select(F.col(row).alias("doc_id"), "text")).where("not kept").select("doc_id")
    return without(rows, row, gone, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
