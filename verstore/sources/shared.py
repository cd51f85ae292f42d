"""The folder that the driver and all executors share, and results settled in it."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or of the context; only where neither is set, a folder of our own.

    That is a temporary one where driver and executors are one process, else one below the warehouse, which they share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own:
            own = tempfile.mkdtemp(prefix="verstore-") if sc.master.split("[")[0] == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints"
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: ranges and numbers made on the way are the same in all uses, and outlive executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
