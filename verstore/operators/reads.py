"""Reads of an operation log (key, seq, kind, value).

Range and snapshot conditions stand below the choice of the newest version, so
they reach the scan; tombstones go after it.  The newest version is an aggregate
with partial sums: a key with any number of versions is one row per task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verstore.functions.codec import DELETE, DELETED, FOUND, MISSING, PUT, kind_name
from verstore.sources.shared import settled


def in_range(key: Column, start: str | None, stop: str | None) -> Column:
    """start <= key < stop; None or empty is open."""
    low = key >= start if start else F.lit(True)
    return low & (key < stop) if stop else low


def newest(log: DataFrame, snapshot: int | None = None, start: str | None = None, stop: str | None = None) -> DataFrame:
    """The newest version of each key with seq < snapshot, tombstones too."""
    seen = log.where(in_range(F.col("key"), start, stop))
    seen = seen if snapshot is None else seen.where(F.col("seq") < snapshot)
    last = F.max_by(F.struct("seq", "kind", "value"), "seq").alias("last")
    return seen.groupBy("key").agg(last).select("key", "last.seq", "last.kind", "last.value")


def live(log: DataFrame, snapshot: int | None = None, start: str | None = None, stop: str | None = None, seqs: bool = True) -> DataFrame:
    """key, seq, value of the keys alive; an unknown kind of a newest version is an error."""
    last = newest(log, snapshot, start, stop)
    known = F.when(F.col("kind").isin(PUT, DELETE), F.col("kind")).otherwise(F.raise_error(F.lit("unknown kind")).cast("int"))
    return last.where(known == PUT).select("key", "seq", "value")


def scan(log: DataFrame, snapshot: int | None = None, start: str | None = None, stop: str | None = None, limit: int | None = None) -> DataFrame:
    """live() in ascending order of keys, the first `limit` rows."""
    rows = live(log, snapshot, start, stop).orderBy("key")
    return rows if limit is None else rows.limit(limit)


def get(log: DataFrame, key: str, snapshot: int | None = None) -> DataFrame:
    """At most one row: the value of a key."""
    if not key:
        raise ValueError("empty key")
    return live(log.where(F.col("key") == key), snapshot)


def get_state(log: DataFrame, probes: DataFrame) -> DataFrame:
    """key, state (0 found, 1 deleted, 2 missing) and value for each row of probes.

    The log is first cut down to the keys asked for, so only their versions are aggregated.
    """
    asked = probes.select("key").distinct()
    found = probes.select("key").join(newest(log.join(asked, "key", "left_semi")), "key", "left")
    return found.select("key", F.coalesce("kind", F.lit(MISSING)).cast("int").alias("state"), F.when(F.col("kind") == FOUND, F.col("value")).alias("value"))


def hit_rate(log: DataFrame, probes: DataFrame) -> DataFrame:
    """One row: probes, those found, deleted and missing."""
    n = lambda state, name: F.count(F.when(F.col("state") == state, 1)).alias(name)
    return get_state(log, probes).agg(F.count(F.lit(1)).alias("probes"), n(FOUND, "hits"), n(DELETED, "deleted"), n(MISSING, "misses"))


def get_as_of(log: DataFrame, probes: DataFrame) -> DataFrame:
    """As get_state() for probes (key, as_of_seq), over versions with seq <= as_of_seq; null sees all.

    Probes meet the log by key and are aggregated by (key, as_of_seq): the
    distinct probes of a key, not their repetitions, multiply its versions.
    """
    asked = probes.select("key", "as_of_seq").distinct()
    match = asked.join(log.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("as_of_seq").isNull() | (F.col("seq") <= F.col("as_of_seq"))), "left")
    last = match.groupBy("key", "as_of_seq").agg(F.max_by(F.struct("seq", "kind", "value"), "seq").alias("last"))
    rows = probes.select("key", "as_of_seq").join(last.withColumnsRenamed({"key": "k", "as_of_seq": "a"}), (F.col("key") == F.col("k")) & F.col("as_of_seq").eqNullSafe(F.col("a")))
    return rows.select("key", "as_of_seq", F.coalesce("last.kind", F.lit(MISSING)).cast("int").alias("state"), F.when(F.col("last.kind") == FOUND, F.col("last.value")).alias("value"), F.col("last.seq").alias("seq"))


def at_or_after(points: DataFrame, probes: DataFrame, value: str) -> DataFrame:
    """key, `value` for each distinct key of probes: the value of the first of points (key, value) at or after it, null past the end.

    Points and probes are one ordered run, cut into ranges; a window inside a range finds
    the next point.  Past a range's end, the first point of any later range answers: a running minimum over one row a range.
    """
    spark = points.sparkSession
    given = points.select("key", F.struct("key", value).alias("point"), F.lit(False).alias("asked"))
    asked = probes.select("key").distinct().select("key", F.lit(None).cast(given.schema["point"].dataType).alias("point"), F.lit(True).alias("asked"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    run = settled(given.unionByName(asked).repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()))
    ahead = Window.partitionBy("part").orderBy(F.col("key").desc(), "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = run.withColumn("next", F.last("point", True).over(ahead)).where("asked")
    # One row for each range: bounded by the number of partitions, as is what is broadcast.
    first = run.groupBy("part").agg(F.min("point").alias("first"))
    later = first.withColumn("beyond", F.min("first").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))).select("part", "beyond")
    return inside.join(F.broadcast(later), "part").select("key", F.coalesce("next", "beyond")[value].alias(value))


def seek(log: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """probe, key: the first live key >= the probe, null past the end."""
    keys = live(log, snapshot).select("key", F.col("key").alias("found"))
    return at_or_after(keys, probes, "found").select(F.col("key").alias("probe"), F.col("found").alias("key"))


def seek_entry(log: DataFrame, key: str, seq: int) -> DataFrame:
    """The first entry at or after (key, seq) in the order of entries."""
    at = (F.col("key") > key) | ((F.col("key") == key) & (F.col("seq") <= seq))
    return log.where(at).orderBy("key", F.desc("seq")).limit(1)


def merge(*sources: DataFrame) -> DataFrame:
    """All sources' entries in the order of entries: key ascending, seq descending."""
    every = sources[0]
    for other in sources[1:]:
        every = every.unionByName(other)
    return every.orderBy("key", F.desc("seq"))


def labelled(log: DataFrame) -> DataFrame:
    """Every version with tombstone, shadowed or current; a group aggregate marks the newest, no key is sorted as a whole."""
    last = log.groupBy("key").agg(F.max("seq").alias("top"))
    rows = log.join(last, "key")
    label = F.when(F.col("kind") == DELETE, "tombstone").when(F.col("seq") < F.col("top"), "shadowed").otherwise("current")
    return rows.select("key", "seq", "kind", kind_name(F.col("kind")).alias("kind_name"), label.alias("label"))


def ranked(log: DataFrame) -> DataFrame:
    """key, seq, position: the place of each entry in the order of entries, from 1.

    Keys are cut into ranges; sums over the ranges (one row each), over the keys of a range and inside a key add up.
    """
    spark = log.sparkSession
    ahead = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = log.groupBy("key").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, "key")
    keys = settled(keys.withColumn("part", F.spark_partition_id()))
    starts = keys.groupBy("part").agg(F.sum("n").alias("n")).select("part", ahead("n", Window.orderBy("part")).alias("before"))
    own = keys.withColumn("own", ahead("n", Window.partitionBy("part").orderBy("key")))
    start = own.join(F.broadcast(starts), "part").select("key", (F.col("before") + F.col("own")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return log.select("key", "seq").join(start, "key").select("key", "seq", (F.col("start") + inside).alias("position"))


def repeated_entries(log: DataFrame) -> DataFrame:
    """(key, seq, n) of entries that are there more than once, which no log should have."""
    return log.groupBy("key", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_missing(log: DataFrame, prefix: str = "user:", digits: int = 8) -> DataFrame:
    """first_missing: the smallest number, from 0 on, whose key `prefix` and `digits` digits is not alive.

    It is 0 or follows a number that is alive, so only these are looked at: no range is searched, and none bounds it.
    """
    number = F.substring("key", len(prefix) + 1, 18)
    alive = live(log, start=prefix).where(F.col("key").startswith(prefix) & number.rlike(f"^[0-9]{{{digits},}}$"))
    named = F.concat(F.lit(prefix), F.lpad(F.col("i").cast("string"), F.greatest(F.lit(digits), F.length(F.col("i").cast("string"))), F.lit("0")))
    numbers = alive.select("key", number.cast("long").alias("i")).where(named == F.col("key")).select("i")
    zero = log.sparkSession.range(1).select(F.col("id").alias("i"))
    return numbers.select((F.col("i") + 1).alias("i")).unionByName(zero).join(numbers, "i", "left_anti").agg(F.min("i").alias("first_missing"))


def snapshot_diff(log: DataFrame, older: int, newer: int) -> DataFrame:
    """Keys whose live value differs between two snapshots."""
    a, b = (live(log, s).select("key", F.col("value").alias(n)) for s, n in ((older, "was"), (newer, "now")))
    both = a.join(b, "key", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("key", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"), "was", "now")


def stats(log: DataFrame) -> DataFrame:
    """One row: entries, tombstones, keys, bytes, largest seq and the next one."""
    size = F.octet_length("key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))
    return log.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("kind").cast("long")).alias("tombstones"), F.countDistinct("key").alias("keys"), F.sum(size.cast("long")).alias("bytes"), F.max("seq").alias("max_seq"), (F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))
