"""The queries of the engine over the tables, and the same in SQL."""
from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verstore.functions import bloom, codec, display
from verstore.operators import reads, upkeep
from verstore.sources.oplogs import events_log, filled, orders_log, turns_log
from verstore.streaming.latest import drain

SNAPSHOT, OLDER, START, STOP, FULL, BLOCK = 5000, 2500, "user:00000010", "user:00000050", 16384, 4096
PROBES = 4000

LOG = """WITH log AS (SELECT 'user:' || lpad(user_id::VARCHAR, 8, '0') AS key, event_id AS seq, (event_type = 'error')::INT AS kind,
  CASE WHEN event_type <> 'error' THEN event_type || ':' || coalesce(props, '') END AS value FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log),
newest AS (SELECT key, seq, kind, value FROM ranked WHERE rn = 1), live AS (SELECT key, seq, value FROM newest WHERE kind = 0),
sized AS (SELECT key, seq, kind, value, (strlen(key) + 8 + coalesce(strlen(value), 0))::BIGINT AS size FROM log)"""


def _as_of(where: str) -> str:
    return f"(SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM log WHERE {where}) WHERE n = 1 AND kind = 0)"


def _probes(spark: SparkSession) -> DataFrame:
    """Keys there and not there, each asked as of three moments and of now."""
    p = spark.range(0, PROBES).select(F.format_string("user:%08d", F.col("id") * 2).alias("key"), "id")
    return p.withColumn("as_of_seq", F.when(F.col("id") % 4 < 3, (F.col("id") % 4 + 1) * 2500))


PROBE = f"probe AS (SELECT 'user:' || lpad((i * 2)::VARCHAR, 8, '0') AS key, CASE WHEN i % 4 < 3 THEN (i % 4 + 1) * 2500 END AS as_of_seq FROM range({PROBES}) t(i))"


def _sources(log: DataFrame) -> list[DataFrame]:
    return [log.where(F.col("seq") % 3 == k) for k in range(3)]


def _edits(log: DataFrame) -> DataFrame:
    """Made-up edits: each hundredth entry adds a file, and from the third on deletes the one two before."""
    k = F.floor(F.col("seq") / 100)
    f = lambda n: F.struct(F.lit(0).alias("level"), n.alias("file_num"))
    none = F.array().cast("array<struct<level:int,file_num:bigint>>")
    return log.where(F.col("seq") % 100 == 0).select(k.alias("pos"), F.array(f(k)).alias("add_files"), F.when(k % 3 == 2, F.array(f(k - 2))).otherwise(none).alias("del_files"), F.when(k % 5 == 0, F.lit(0)).otherwise(k + 1).alias("next_file_num"), F.col("seq").alias("last_seq"))


EDITS = "edits AS (SELECT seq // 100 AS k, seq FROM log WHERE seq % 100 = 0)"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    single = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")
    gone = F.col("event_type") == "error"
    log = single.select(F.format_string("user:%08d", "user_id").alias("key"), F.col("event_id").alias("seq"), gone.cast("int").alias("kind"), F.when(~gone, F.concat_ws(":", "event_type", F.coalesce("props", F.lit("")))).alias("value"))
    return drain(log)


def _seek_entry(log: DataFrame) -> DataFrame:
    return reads.seek_entry(log, START, SNAPSHOT).select("key", "seq", "kind")


def _codec(log: DataFrame) -> DataFrame:
    i = log.select("key", "seq", "kind", codec.internal_key(F.col("key"), F.col("seq"), F.col("kind")).alias("internal_key"))
    seq, kind = codec.trailer(F.col("internal_key"))
    return i.select("internal_key", codec.user_key(F.col("internal_key")).alias("key"), seq.alias("seq"), kind.alias("kind"), codec.uvarint_size(F.col("seq")).alias("seq_varint_bytes"))


def _bloom_hits(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """The filter's size and how many of the keys asked for it lets pass."""
    own = bloom.build(keys)
    hits = bloom.may_contain(own, asked).agg(F.count(F.lit(1)).alias("asked"), F.count(F.when(F.col("maybe"), 1)).alias("maybe"))
    return hits.select(F.lit(own.bits).cast("long").alias("bits"), F.lit(own.probes).alias("probes"), "asked", "maybe")


def _false_positives(log: DataFrame, spark: SparkSession) -> DataFrame:
    strangers = spark.range(PROBES * 10).select(F.format_string("out:%08d", "id").alias("key"))
    return _bloom_hits(log, strangers).withColumn("below_two_percent", F.col("maybe") < 0.02 * F.col("asked"))


#: 32-bit FNV-1a of the column key, and the same filter in SQL: one row (bits) and its set positions.
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
BLOOM = f"""members AS (SELECT DISTINCT key FROM log), shape AS (SELECT ((greatest(count(*) * 10, 64) + 7) // 8 * 8)::BIGINT AS bits FROM members),
hashed AS (SELECT 'own' AS kind, key, {FNV} AS h FROM members UNION ALL SELECT 'other', key, {FNV} FROM (SELECT 'out:' || lpad(i::VARCHAR, 8, '0') AS key FROM range({PROBES * 10}) t(i))),
spots AS (SELECT kind, key, ((h + i * ((h >> 17) + ((h & 131071) << 15))) % 4294967296) % bits AS position FROM hashed, shape, range(6) t(i)),
lit AS (SELECT DISTINCT position FROM spots WHERE kind = 'own'),
judged AS (SELECT kind, key, bool_and(l.position IS NOT NULL) AS maybe FROM spots LEFT JOIN lit l USING (position) GROUP BY kind, key),
passed AS (SELECT kind, count(*) AS asked, count(*) FILTER (maybe) AS maybe FROM judged GROUP BY kind)"""


def _shown(log: DataFrame) -> DataFrame:
    n = codec.entry_size(F.col("key"), F.col("value"))
    return log.select("key", "seq", display.preview(F.coalesce("value", F.lit(""))).alias("shown"), display.size(n * F.col("seq")).alias("size"), display.bar(n / 200.0, 20).alias("bar"))


def _names(log: DataFrame) -> DataFrame:
    name = codec.file_name(F.col("seq"), "sst")
    return log.select(name.alias("name"), codec.file_number(name).alias("number"))


def _overlay(log: DataFrame) -> DataFrame:
    return reads.live(upkeep.compacted(log.where(F.col("seq") < SNAPSHOT)).unionByName(log.where(F.col("seq") >= SNAPSHOT)))


def _wal(log: DataFrame) -> DataFrame:
    """The log as records of which the last is damaged."""
    last = log.agg(F.max("seq")).scalar()
    return upkeep.valid_prefix(log.select(F.col("seq").alias("pos"), "key", "kind", (F.col("seq") < last).alias("ok"))).drop("ok")


def _source_of(log: DataFrame) -> DataFrame:
    parts = [s.withColumn("source", F.lit(n)) for s, n in zip((log.where(F.col("seq") < OLDER), log.where((F.col("seq") >= OLDER) & (F.col("seq") < SNAPSHOT)), log.where(F.col("seq") >= SNAPSHOT)), ("l0", "imm", "mem"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("key").agg(F.max_by(F.struct("source", "kind"), "seq").alias("x")).select("key", "x.source", F.col("x.kind").alias("state"))


#: name: (function of (spark, log, sf_dir), SQL or None)
TABLE = {
    "scan_live": (lambda s, g, d: reads.live(g), f"{LOG} SELECT * FROM live"),
    "scan_range": (lambda s, g, d: reads.live(g, start=START, stop=STOP), f"{LOG} SELECT * FROM live WHERE key >= '{START}' AND key < '{STOP}'"),
    "scan_from": (lambda s, g, d: reads.live(g, start=STOP), f"{LOG} SELECT * FROM live WHERE key >= '{STOP}'"),
    "scan_to": (lambda s, g, d: reads.live(g, stop=START), f"{LOG} SELECT * FROM live WHERE key < '{START}'"),
    "scan_empty_range": (lambda s, g, d: reads.live(g, start=STOP, stop=START), f"{LOG} SELECT * FROM live WHERE FALSE"),
    "scan_limit": (lambda s, g, d: reads.scan(g, limit=30), f"{LOG} SELECT * FROM live ORDER BY key LIMIT 30"),
    "scan_snapshot": (lambda s, g, d: reads.live(g, SNAPSHOT), f"{LOG} SELECT * FROM {_as_of(f'seq < {SNAPSHOT}')}"),
    "scan_snapshot_range": (lambda s, g, d: reads.live(g, SNAPSHOT, START, STOP), f"{LOG} SELECT * FROM {_as_of(f'seq < {SNAPSHOT}')} WHERE key >= '{START}' AND key < '{STOP}'"),
    "scan_snapshot_diff": (
        lambda s, g, d: reads.snapshot_diff(g, OLDER, SNAPSHOT),
        f"{LOG} SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change, a.value AS was, b.value AS now FROM {_as_of(f'seq < {OLDER}')} a FULL JOIN {_as_of(f'seq < {SNAPSHOT}')} b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value",
    ),
    "scan_live_orders": (
        lambda s, g, d: reads.live(orders_log(s, d)),
        "SELECT key, seq, value FROM (SELECT 'cust:' || lpad(o_custkey::VARCHAR, 8, '0') AS key, o_orderkey AS seq, o_orderstatus = 'F' AS gone, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND NOT gone",
    ),
    "scan_live_turns": (
        lambda s, g, d: reads.live(turns_log(s, d)),
        "SELECT key, seq, value FROM (SELECT 'conv:' || lpad(conv_id::VARCHAR, 8, '0') AS key, turn AS seq, text AS value, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1",
    ),
    "point_get": (lambda s, g, d: reads.get(g, START), f"{LOG} SELECT * FROM live WHERE key = '{START}'"),
    "get_state": (
        lambda s, g, d: reads.get_state(g, _probes(s)),
        f"{LOG}, {PROBE} SELECT p.key, coalesce(n.kind, 2)::INT AS state, CASE WHEN n.kind = 0 THEN n.value END AS value FROM probe p LEFT JOIN newest n ON p.key = n.key",
    ),
    "get_as_of": (
        lambda s, g, d: reads.get_as_of(g, _probes(s)).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("as_of_seq", "seq")}),
        f"{LOG}, {PROBE}, m AS (SELECT p.key, p.as_of_seq, g.seq, g.kind, g.value, row_number() OVER (PARTITION BY p.key, p.as_of_seq ORDER BY g.seq DESC NULLS LAST) AS n FROM probe p LEFT JOIN log g ON g.key = p.key AND (p.as_of_seq IS NULL OR g.seq <= p.as_of_seq)) SELECT key, coalesce(as_of_seq, -1)::BIGINT AS as_of_seq, coalesce(kind, 2)::INT AS state, CASE WHEN kind = 0 THEN value END AS value, coalesce(seq, -1)::BIGINT AS seq FROM m WHERE n = 1",
    ),
    "get_source": (
        lambda s, g, d: _source_of(g),
        f"{LOG} SELECT key, CASE WHEN seq < {OLDER} THEN 'l0' WHEN seq < {SNAPSHOT} THEN 'imm' ELSE 'mem' END AS source, kind AS state FROM newest",
    ),
    "seek_first_geq": (
        lambda s, g, d: reads.seek(g, _probes(s)),
        f"{LOG}, {PROBE} SELECT p.key AS probe, (SELECT min(key) FROM live WHERE live.key >= p.key) AS key FROM probe p",
    ),
    "seek_internal": (lambda s, g, d: _seek_entry(g), f"{LOG} SELECT key, seq, kind FROM log WHERE key > '{START}' OR (key = '{START}' AND seq <= {SNAPSHOT}) ORDER BY key, seq DESC LIMIT 1"),
    "raw_scan": (lambda s, g, d: reads.merge(g), f"{LOG} SELECT * FROM log"),
    "raw_scan_labeled": (
        lambda s, g, d: reads.labelled(g),
        f"{LOG} SELECT key, seq, kind, CASE kind WHEN 0 THEN 'put' ELSE 'delete' END AS kind_name, CASE WHEN kind = 1 THEN 'tombstone' WHEN rn > 1 THEN 'shadowed' ELSE 'current' END AS label FROM ranked",
    ),
    "internal_key_rank": (lambda s, g, d: reads.ranked(g), f"{LOG} SELECT key, seq, row_number() OVER (ORDER BY key, seq DESC) AS position FROM log"),
    "merge_sources": (lambda s, g, d: reads.merge(*_sources(g)), f"{LOG} SELECT * FROM log"),
    "resurrected_keys": (lambda s, g, d: upkeep.resurrected(g), f"{LOG} SELECT key, seq FROM (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY seq) AS was FROM log) WHERE was = 1 AND kind = 0"),
    "version_debt": (
        lambda s, g, d: upkeep.version_debt(g),
        f"{LOG} SELECT key, count(*) AS versions, count(*) - sum((rn = 1 AND kind = 0)::INT)::BIGINT AS dropped, sum(kind)::BIGINT AS tombstones FROM ranked GROUP BY key",
    ),
    "mem_running_size": (lambda s, g, d: upkeep.running_size(g), f"{LOG} SELECT seq, sum(size) OVER (ORDER BY seq)::BIGINT AS running_bytes FROM sized"),
    "flush_plan": (lambda s, g, d: upkeep.flush_plan(g, FULL), None),
    "flush_tables": (lambda s, g, d: upkeep.flush_tables(g, FULL), None),
    "l0_trace": (lambda s, g, d: upkeep.l0_trace(upkeep.flush_tables(g, FULL)), None),
    "block_layout": (lambda s, g, d: upkeep.block_layout(g, BLOCK), None),
    "block_index_seek": (lambda s, g, d: upkeep.block_of(upkeep.block_layout(g, BLOCK), _probes(s).select("key")).withColumn("block", F.coalesce("block", F.lit(-1))), None),
    "compact_full": (lambda s, g, d: upkeep.compacted(g), f"{LOG} SELECT key, seq, value, 0::INT AS kind FROM live"),
    "compact_reclaimed": (
        lambda s, g, d: upkeep.reclaimed(g),
        f"{LOG} SELECT (SELECT sum(size)::BIGINT FROM sized) AS bytes_before, (SELECT sum(size)::BIGINT FROM sized JOIN live USING (key, seq)) AS bytes_after",
    ),
    "compact_then_overlay": (lambda s, g, d: _overlay(g), f"{LOG} SELECT * FROM live"),
    "version_fold": (
        lambda s, g, d: upkeep.fold_edits(_edits(g)),
        f"{LOG}, {EDITS} SELECT 0::INT AS level, a.k AS file_num FROM edits a WHERE NOT EXISTS (SELECT 1 FROM edits b WHERE b.k % 3 = 2 AND b.k - 2 = a.k)",
    ),
    "version_counters": (
        lambda s, g, d: upkeep.fold_counters(_edits(g)),
        f"{LOG}, {EDITS} SELECT (SELECT max(k) + 1 FROM edits WHERE k % 5 <> 0)::BIGINT AS next_file_num, (SELECT max(seq) FROM edits)::BIGINT AS last_seq",
    ),
    "next_seq_recovery": (lambda s, g, d: upkeep.next_seq(*_sources(g)), f"{LOG} SELECT max(seq) + 1 AS next_seq FROM log"),
    "wal_valid_prefix": (lambda s, g, d: _wal(g), f"{LOG} SELECT seq AS pos, key, kind FROM log WHERE seq < (SELECT max(seq) FROM log)"),
    "orphan_segments": (
        lambda s, g, d: upkeep.orphans(_edits(g).select(F.col("pos").alias("file_num")), upkeep.fold_edits(_edits(g))),
        f"{LOG}, {EDITS} SELECT a.k AS file_num FROM edits a WHERE EXISTS (SELECT 1 FROM edits b WHERE b.k % 3 = 2 AND b.k - 2 = a.k)",
    ),
    "store_stats": (
        lambda s, g, d: reads.stats(g),
        f"{LOG} SELECT count(*) AS entries, sum(kind)::BIGINT AS tombstones, count(DISTINCT key) AS keys, sum(size)::BIGINT AS bytes, max(seq) AS max_seq, max(seq) + 1 AS next_seq FROM sized",
    ),
    "key_codec_roundtrip": (
        lambda s, g, d: _codec(g),
        f"{LOG}, x AS (SELECT *, lpad(printf('%X', seq * 256 + kind), 16, '0') AS t FROM log) SELECT hex(encode(key)) || substr(t, 15, 2) || substr(t, 13, 2) || substr(t, 11, 2) || substr(t, 9, 2) || substr(t, 7, 2) || substr(t, 5, 2) || substr(t, 3, 2) || substr(t, 1, 2) AS internal_key, key, seq, kind, greatest(1, ceil(length(bin(seq)) / 7.0))::INT AS seq_varint_bytes FROM x",
    ),
    "fnv1a_hash": (lambda s, g, d: g.select("key").distinct().select("key", codec.fnv1a(F.col("key")).alias("hash")), f"{LOG} SELECT key, {FNV} AS hash FROM (SELECT DISTINCT key FROM log)"),
    "bloom_false_negatives": (lambda s, g, d: _bloom_hits(g, g), f"{LOG}, {BLOOM} SELECT bits, 6::INT AS probes, asked, maybe FROM passed, shape WHERE kind = 'own'"),
    "bloom_fp_rate": (lambda s, g, d: _false_positives(g, s), f"{LOG}, {BLOOM} SELECT bits, 6::INT AS probes, asked, maybe, maybe < 0.02 * asked AS below_two_percent FROM passed, shape WHERE kind = 'other'"),
    "bloom_positions": (
        lambda s, g, d: bloom.build(g).set.withColumn("position", F.col("position").cast("long")),
        f"{LOG}, {BLOOM} SELECT position FROM lit",
    ),
    "value_preview": (
        lambda s, g, d: _shown(g),
        f"""{LOG}, n AS (SELECT *, coalesce(value, '') AS v, size * seq AS b, floor(least(size / 200.0::DOUBLE, 1.0) * 20)::INT AS w FROM sized)
        SELECT key, seq, '"' || replace(replace(left(v, 24), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || CASE WHEN length(v) > 24 THEN '"…' ELSE '"' END AS shown,
        CASE WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0::DOUBLE) ELSE b::VARCHAR || ' B' END AS size, repeat('█', w) || repeat('░', 20 - w) AS bar FROM n""",
    ),
    "file_numbers": (lambda s, g, d: _names(g), f"{LOG} SELECT lpad(seq::VARCHAR, 9, '0') || '.sst' AS name, seq AS number FROM log"),
    "repeated_entries": (
        lambda s, g, d: reads.repeated_entries(g.unionByName(g.where(F.col("seq") % 7 == 0))),
        f"{LOG} SELECT key, seq, count(*) AS n FROM (SELECT key, seq FROM log UNION ALL SELECT key, seq FROM log WHERE seq % 7 = 0) GROUP BY key, seq HAVING count(*) > 1",
    ),
    "get_mem_state": (
        lambda s, g, d: reads.get_state(g.where(F.col("seq") >= SNAPSHOT), _probes(s)),
        f"{LOG}, {PROBE}, mem AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM log WHERE seq >= {SNAPSHOT}) SELECT p.key, coalesce(m.kind, 2)::INT AS state, CASE WHEN m.kind = 0 THEN m.value END AS value FROM probe p LEFT JOIN mem m ON p.key = m.key AND m.n = 1",
    ),
    "get_hit_rate": (
        lambda s, g, d: reads.hit_rate(g, _probes(s)),
        f"{LOG}, {PROBE} SELECT count(*) AS probes, count(*) FILTER (kind = 0) AS hits, count(*) FILTER (kind = 1) AS deleted, count(*) FILTER (kind IS NULL) AS misses FROM probe p LEFT JOIN newest n ON p.key = n.key",
    ),
    "fill_keys": (
        lambda s, g, d: filled(s, 10_000),
        f"SELECT 'user:' || lpad(i::VARCHAR, 8, '0') AS key, i AS seq, 0::INT AS kind, left(translate(md5(i || ':0') || md5(i || ':1') || md5(i || ':2') || md5(i || ':3'), '0123456789', 'ghijklmnop'), 100) AS value FROM range(10000) t(i)",
    ),
    "probe_key_max": (
        lambda s, g, d: reads.first_missing(g),
        f"{LOG} SELECT min(i) AS first_missing FROM range(0, (SELECT count(*) + 1 FROM live)) t(i) WHERE 'user:' || lpad(i::VARCHAR, 8, '0') NOT IN (SELECT key FROM live)",
    ),
    "count_live": (lambda s, g, d: reads.live(g).agg(F.count(F.lit(1)).alias("live_keys"), F.greatest(F.count(F.lit(1)) - 30, F.lit(0)).alias("beyond_limit")), f"{LOG} SELECT count(*) AS live_keys, greatest(count(*) - 30, 0) AS beyond_limit FROM live"),
    "stream_latest": (lambda s, g, d: _stream(s, d), f"{LOG} SELECT * FROM live"),
}


def _greedy(order: str, full: int) -> str:
    return f"""{LOG}, o AS (SELECT key, seq, size, row_number() OVER (ORDER BY {order}) AS i FROM sized),
g AS (WITH RECURSIVE g(i, total, generation) AS (SELECT i, size, 0::BIGINT FROM o WHERE i = 1 UNION ALL
  SELECT o.i, CASE WHEN g.total >= {full} THEN o.size ELSE g.total + o.size END, g.generation + (g.total >= {full})::BIGINT FROM g JOIN o ON o.i = g.i + 1) SELECT i, generation FROM g),
p AS (SELECT key, seq, size, generation FROM o JOIN g USING (i))"""


FLUSH = "SELECT generation, count(*) AS entries, sum(size)::BIGINT AS bytes, min(key) AS first_key, max(key) AS last_key, max(seq) AS max_seq FROM p GROUP BY generation"
LAYOUT = "SELECT generation AS block, count(*) AS entries, sum(size)::BIGINT AS bytes, max(key) AS last_key FROM p GROUP BY generation"
SEQUENTIAL = {
    "flush_plan": f"{_greedy('seq', FULL)} SELECT * FROM p",
    "flush_tables": f"{_greedy('seq', FULL)} {FLUSH}",
    "l0_trace": f"{_greedy('seq', FULL)}, t AS (SELECT DISTINCT generation FROM p) SELECT generation, generation >= 3 AND generation % 3 = 0 AS compacts, CASE WHEN generation < 3 THEN generation + 1 ELSE generation % 3 + 1 END AS l0_tables FROM t",
    "block_layout": f"{_greedy('key, seq DESC', BLOCK)} {LAYOUT}",
    "block_index_seek": f"{_greedy('key, seq DESC', BLOCK)}, l AS ({LAYOUT}), {PROBE} SELECT p.key, coalesce(min(l.block), -1)::BIGINT AS block FROM probe p LEFT JOIN l ON l.last_key >= p.key GROUP BY p.key",
}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return TABLE[name][0](spark, events_log(spark, sf_dir), sf_dir)


def queries():
    return {name: partial(_run, name) for name in TABLE}


def oracle_sql():
    return {name: sql for name, (_, sql) in TABLE.items() if sql} | SEQUENTIAL
