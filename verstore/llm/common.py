"""Shared helpers: tables, the shared folder, bounded chunks and word arrays."""
from __future__ import annotations

import ctypes
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verstore.sources.shared import settled

#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK = 8 << 20
#: Numbers of rows that are broadcast at most, some 25 MB.
SMALL = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that the session names in spark.checkpoint.dir."""
    return settled(df)


def held_out(doc_id):
    """True for the documents that no model may learn from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def trim() -> None:
    """Gives memory that a finished task has freed back to the system: reused Python workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def in_batches(df: DataFrame, rows: int = 2500) -> DataFrame:
    """df, computed now in Arrow batches of at most `rows` rows: more long texts would fill a worker's memory.

    The session's own setting is back when this returns; what is computed lies in the shared folder.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    own = conf.get(name)
    conf.set(name, str(rows if int(own) <= 0 else min(rows, int(own))))
    try:
        return cut(df)
    finally:
        conf.set(name, own)


def share(spark: SparkSession, value):
    """A broadcast of value as bytes, pickled by value: executors need not have this package.  taken() gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def taken(shared):
    return pickle.loads(shared.value)


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that is in none of the columns, whatever its case."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column of long integers that tells all its rows apart.

    That is doc_id where it is an integer, never null and never repeated.  Else it is a
    number of its own in a copy of docs in the shared folder, so that equal rows,
    rows without an id and rows that share an id are told apart for good.
    """
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
            return docs, "doc_id"
    row = fresh(docs.columns, "__row")
    return cut(docs.withColumn(row, F.monotonically_increasing_id())), row


def without(docs: DataFrame, row: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of docs, `columns` only, whose number is not in the one column of gone.

    gone is settled and counted first: up to SMALL numbers are broadcast, more make both sides move.
    """
    own = fresh(docs.columns, "__of")
    gone = cut(gone.toDF(own))
    return docs.join(F.broadcast(gone) if gone.count() <= SMALL else gone, F.col(row) == F.col(own), "left_anti").select(*columns)


def tidy(function):
    """A function of Arrow batches that trims its worker's memory at the end of a task."""

    def run(batches):
        yield from function(batches)
        trim()

    return run


def gathered(batches, limit: int, column: str = "text"):
    """The batches joined to ones of about `limit` bytes of `column`: work by distinct word repeats less."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.fill_null(pc.binary_length(batch.column(column)), 0)).as_py() or 0
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def chunks(batches, column: str = "text", limit: int = CHUNK):
    """The batches' rows in slices of about `limit` bytes of `column`, at least one row each."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets by row and the words `[^\\x20\\x09-\\x0D]+` of all rows; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, at = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    count = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return count[at - at[0]], flat.filter(full)


def spans(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    start = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(start, lengths)

