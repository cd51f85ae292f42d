"""The live view of a log that grows: late entries count by seq, not by arrival."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verstore.operators.reads import live
from verstore.sources.shared import new_folder

SCHEMA = "key string, seq long, kind int, value string"


def latest_stream(log: DataFrame) -> DataFrame:
    """A streaming log's newest version per key (complete or update mode)."""
    last = F.max_by(F.struct("seq", "kind", "value"), "seq").alias("last")
    return log.groupBy("key").agg(last).select("key", "last.seq", "last.kind", "last.value")


def drain(log: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs all that is available through latest_stream() and returns the live rows.

    Each micro-batch writes the keys that it changed to `folder` (in the shared folder by default), in a place of its own that
    a second try overwrites; the newest row of each key there is the view.  Nothing goes through the driver.
    """
    spark = log.sparkSession
    folder = folder or new_folder(spark, "latest")

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    latest_stream(log).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return live(spark.read.schema(SCHEMA).parquet(f"{folder}/rows"))
