"""Operation logs (key, seq, kind, value) from tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One put per event of a user, a tombstone per error event; event_id is the sequence number."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_type") == "error"
    value = F.when(~gone, F.concat_ws(":", "event_type", F.coalesce("props", F.lit(""))))
    return e.select(F.format_string("user:%08d", "user_id").alias("key"), F.col("event_id").alias("seq"), gone.cast("int").alias("kind"), value.alias("value"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order's priority per customer; a finished order ('F') deletes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    gone = F.col("o_orderstatus") == "F"
    return o.select(F.format_string("cust:%08d", "o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), gone.cast("int").alias("kind"), F.when(~gone, F.col("o_orderpriority")).alias("value"))


def turns_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations; seq counts within a key only."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.format_string("conv:%08d", "conv_id").alias("key"), F.col("turn").alias("seq"), F.lit(0).alias("kind"), F.col("text").alias("value"))


def letters(number: Column, length: int = 100) -> Column:
    """Small letters that depend on the number only: hex digits of hashes, with letters in place of 0 to 9."""
    digits = F.concat(*[F.md5(F.concat(number.cast("string"), F.lit(f":{k}"))) for k in range(-(-length // 32))])
    return F.left(F.translate(digits, "0123456789", "ghijklmnop"), F.lit(length))


def filled(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    """n puts of user:%08d from `start` on, each with a value of 100 letters that depends on the number only."""
    i = spark.range(start, start + n)
    return i.select(F.format_string("user:%08d", "id").alias("key"), F.col("id").alias("seq"), F.lit(0).alias("kind"), letters(F.col("id")).alias("value"))
