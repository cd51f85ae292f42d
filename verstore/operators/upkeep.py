"""Maintenance as queries: flushing, compaction, recovery of the catalogue and of logs."""
from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from verstore.functions.codec import PUT, entry_size
from verstore.operators.reads import at_or_after, live
from verstore.sources.shared import settled


def compacted(log: DataFrame) -> DataFrame:
    """What a compaction of the whole log keeps: live versions with their own seq."""
    return live(log).withColumn("kind", F.lit(PUT))


def version_debt(log: DataFrame) -> DataFrame:
    """Versions, versions that compaction drops, and tombstones of each key."""
    alive = F.max_by("kind", "seq") == PUT
    return log.groupBy("key").agg(F.count(F.lit(1)).alias("versions"), (F.count(F.lit(1)) - alive.cast("long")).alias("dropped"), F.sum(F.col("kind").cast("long")).alias("tombstones"))


def reclaimed(log: DataFrame) -> DataFrame:
    """Bytes before and after a compaction."""
    size = F.coalesce(F.sum(entry_size(F.col("key"), F.col("value"))), F.lit(0))
    return log.agg(size.alias("bytes_before")).crossJoin(compacted(log).agg(size.alias("bytes_after")))  # one row each


def resurrected(log: DataFrame) -> DataFrame:
    """Puts right after a tombstone of their key."""
    before = F.lag("kind").over(Window.partitionBy("key").orderBy("seq"))
    return log.withColumn("was", before).where((F.col("was") == 1) & (F.col("kind") == PUT)).select("key", "seq")


def running_size(log: DataFrame, width: int = 4096) -> DataFrame:
    """seq and the bytes of all entries up to it, by sums of seq ranges and of ranges of ranges: no task holds the log.

    The only window over everything has one row per width * width sequence numbers.
    """
    sized = log.select("seq", entry_size(F.col("key"), F.col("value")).alias("size"), F.floor(F.col("seq") / width).alias("cell"))
    before = lambda w: F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = sized.groupBy("cell").agg(F.sum("size").alias("s")).withColumn("block", F.floor(F.col("cell") / width))
    blocks = cells.groupBy("block").agg(F.sum("s").alias("s")).select("block", before(Window.orderBy("block")).alias("far"))
    cells = cells.withColumn("near", before(Window.partitionBy("block").orderBy("cell"))).join(blocks, "block").select("cell", (F.col("far") + F.col("near")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("cell").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return sized.join(cells, "cell").select("seq", (F.col("before") + inside).alias("running_bytes"))


def _range_map(sizes: np.ndarray, full: int) -> list[tuple[int, int, int]]:
    """What a range of rows does to the groups: (upto, last, closed) in ascending order of upto.

    A group that reaches `full` at d bytes from the range's start closes at the first row whose running sum is d or
    more; the first entry with upto >= d tells where the last group of the range then closes and how
    many do.  Later starts close no earlier, so few answers differ; beyond the last entry no group closes.
    """
    ends = np.cumsum(sizes)
    follow = np.searchsorted(ends, ends + full)
    n = len(ends)
    jump, last, closed = np.append(follow, n), np.append(np.arange(n), n), np.append(np.ones(n, np.int64), 0)
    while (jump < n).any():  # twice as far at a time
        closed, last = closed + closed[jump], np.where(jump < n, last[jump], last)
        jump = jump[jump]
    able = int(np.searchsorted(ends, full)) + 1  # a group is open for `full` bytes at most
    key = np.stack([ends[last[:n][:able]], closed[:n][:able]]) if n else np.zeros((2, 0), np.int64)
    keep = np.flatnonzero(np.append((np.diff(key, axis=1) != 0).any(axis=0), True)) if n else np.zeros(0, int)
    return [(int(ends[i]), int(key[0, i]), int(key[1, i])) for i in keep]


def greedy_groups(rows: DataFrame, order: list, size: str, full: int) -> DataFrame:
    """rows with generation: a group closes once its sum of size reaches `full`, checked before the next row.

    Each group starts where the last one overshot, yet ranges of the ordered rows need not
    wait for each other: each works out where its last group closes for every state that it may be entered
    in, the driver strings these answers together (a few numbers a range), and all ranges number their rows.
    """
    spark, schema = rows.sparkSession, rows.schema
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    staged = settled(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()))

    def survey(batches):
        number, sizes = None, []
        for batch in batches:
            if batch.num_rows:
                number = batch.column("__range")[0].as_py()
                sizes.append(batch.column(size).to_numpy().astype(np.int64))
        if number is not None:
            own = np.concatenate(sizes)
            steps = _range_map(own, full)
            columns = [pa.array([number], pa.int32()), pa.array([int(own.sum())], pa.int64()), pa.array([[list(x) for x in steps]], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "total", "steps"])

    found = staged.select("__range", size).mapInArrow(survey, "range int, total long, steps array<array<long>>").orderBy("range").collect()
    due, generation, state = full, 0, {}
    for r in found:
        state[r.range] = (due, generation)
        step = bisect_left(r.steps, due, key=lambda x: x[0])
        if step < len(r.steps):
            due, generation = r.steps[step][1] + full, generation + r.steps[step][2]
        due -= r.total

    def number(batches):
        at = due = generation = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                (due, generation), at = state[batch.column("__range")[0].as_py()], 0
            sums = at + np.cumsum(batch.column(size).to_numpy().astype(np.int64))
            ends, i = [], int(np.searchsorted(sums, due))
            while i < len(sums):
                ends.append(sums[i])
                due = int(sums[i]) + full
                i = int(np.searchsorted(sums, due))
            out = generation + np.searchsorted(np.array(ends, np.int64), sums)
            generation, at = generation + len(ends), int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out.astype(np.int64))], names=[*batch.schema.names[:-1], "generation"])

    return staged.mapInArrow(number, StructType([*schema.fields, StructField("generation", LongType())]))


def flush_plan(log: DataFrame, threshold: int) -> DataFrame:
    """The table that each entry is flushed to, in order of seq."""
    sized = log.select("key", "seq", entry_size(F.col("key"), F.col("value")).alias("size"))
    return greedy_groups(sized, ["seq"], "size", threshold)


def flush_tables(log: DataFrame, threshold: int) -> DataFrame:
    """generation, entries, bytes, first and last key, largest seq of each flushed table."""
    return flush_plan(log, threshold).groupBy("generation").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.max("seq").alias("max_seq"))


def l0_trace(tables: DataFrame, trigger: int = 4) -> DataFrame:
    """Tables in level 0 after each flush, and whether it was compacted then.

    The first compaction comes with the trigger-th table; one table stays, so
    the next ones come every trigger - 1 flushes.
    """
    n = F.col("generation") + 1
    hit = (n >= trigger) & ((n - trigger) % (trigger - 1) == 0) if trigger > 1 else F.lit(trigger == 1)
    left = F.when(n < trigger, n).otherwise((n - trigger) % max(1, trigger - 1) + 1)
    return tables.select("generation", hit.alias("compacts"), left.cast("long").alias("l0_tables"))


def block_layout(entries: DataFrame, block: int = 4096) -> DataFrame:
    """block, entries, bytes, last key of blocks filled greedily in the order of entries."""
    sized = entries.select("key", "seq", entry_size(F.col("key"), F.col("value")).alias("size"))
    return greedy_groups(sized, ["key", F.desc("seq")], "size", block).groupBy(F.col("generation").alias("block")).agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"), F.max("key").alias("last_key"))


def block_of(layout: DataFrame, probes: DataFrame) -> DataFrame:
    """The first block whose last key is at or after the probe."""
    lasts = layout.groupBy(F.col("last_key").alias("key")).agg(F.min("block").alias("block"))
    return at_or_after(lasts, probes, "block")


def fold_edits(edits: DataFrame) -> DataFrame:
    """level, file_num of the files alive after edits (pos, add_files, del_files): the last action counts, deletions after additions of one edit."""
    add = edits.select("pos", F.lit(0).alias("gone"), F.explode("add_files").alias("f"))
    dels = edits.select("pos", F.lit(1).alias("gone"), F.explode("del_files").alias("f"))
    last = add.unionByName(dels).groupBy("f.level", "f.file_num").agg(F.max_by("gone", F.struct("pos", "gone")).alias("gone"))
    return last.where("gone = 0").select("level", "file_num")


def fold_counters(edits: DataFrame) -> DataFrame:
    """The last values of the counters that are not 0, which means unchanged."""
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c) > 0, F.col("pos"))), F.lit(0)).cast("long").alias(c)
    return edits.agg(last("next_file_num"), last("last_seq"))


def valid_prefix(records: DataFrame) -> DataFrame:
    """Records (pos, ok, ...) before a broken tail; a broken record that is not the last is an error."""
    ends = records.agg(F.struct(F.min(F.when(~F.col("ok"), F.col("pos"))).alias("bad"), F.max("pos").alias("last"))).scalar()
    bad = ends["bad"]
    torn = F.when(bad.isNull() | (bad == ends["last"]), bad).otherwise(F.raise_error(F.lit("log damaged before its tail")).cast("long"))
    return records.where(F.coalesce(F.col("pos") < torn, F.lit(True)))


def orphans(files: DataFrame, version: DataFrame) -> DataFrame:
    """Files that no version names."""
    return files.join(version, "file_num", "left_anti")


def next_seq(*sources: DataFrame) -> DataFrame:
    """One more than any source's largest seq."""
    tops = [s.agg(F.max("seq").alias("m")) for s in sources]
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    return every.agg((F.coalesce(F.max("m"), F.lit(-1)) + 1).alias("next_seq"))
