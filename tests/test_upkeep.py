import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verstore.functions import bloom, codec, display
from verstore.operators import upkeep

LOG = "key string, seq long, kind int, value string"
FILES = "array<struct<level:int,file_num:bigint>>"


def test_flush_overshoots_by_one_entry(spark):
    g = spark.createDataFrame([("k", i, 0, "x" * 11) for i in range(7)], LOG)  # 20 bytes each
    assert [r.generation for r in upkeep.flush_plan(g, 50).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert [r.running_bytes for r in upkeep.running_size(g, 3).orderBy("seq").collect()] == [20, 40, 60, 80, 100, 120, 140]


def test_level_zero_after_each_flush(spark):
    got = upkeep.l0_trace(spark.range(8).withColumnRenamed("id", "generation"), 4).orderBy("generation").collect()
    assert [r.l0_tables for r in got] == [1, 2, 3, 1, 2, 3, 1, 2]
    assert [r.compacts for r in got] == [False, False, False, True, False, False, True, False]


def test_fold_of_edits(spark):
    rows = [(0, [(0, 3), (0, 5)], [], 6, 0), (1, [(1, 7)], [(0, 3), (0, 5)], 8, 42), (2, [], [], 0, 0)]
    edits = spark.createDataFrame(rows, f"pos int, add_files {FILES}, del_files {FILES}, next_file_num long, last_seq long")
    assert [tuple(r) for r in upkeep.fold_edits(edits).collect()] == [(1, 7)]
    assert tuple(upkeep.fold_counters(edits).collect()[0]) == (8, 42)


def test_valid_prefix(spark):
    frame = lambda oks: spark.createDataFrame(list(enumerate(oks)), "pos int, ok boolean")
    assert upkeep.valid_prefix(frame([True, True, False])).count() == 2
    assert upkeep.valid_prefix(frame([True, True])).count() == 2
    with pytest.raises(PySparkException):
        upkeep.valid_prefix(frame([True, False, True])).collect()


def test_codec(spark):
    df = spark.createDataFrame([("a", 1, 0), ("ab", 72057594037927935, 1)], "key string, seq long, kind int")
    coded = df.withColumn("i", codec.internal_key(F.col("key"), F.col("seq"), F.col("kind")))
    assert coded.collect()[0].i == "61" + "0001000000000000"
    seq, kind = codec.trailer(F.col("i"))
    assert [tuple(r) for r in coded.select(codec.user_key(F.col("i")), seq, kind).collect()] == [("a", 1, 0), ("ab", 72057594037927935, 1)]
    for bad in (("", 1, 0), ("a", 2**56, 0), ("a", 1, 2)):
        with pytest.raises(PySparkException):
            spark.createDataFrame([bad], "key string, seq long, kind int").select(codec.checked(F.col("key"), F.col("seq"), F.col("kind"))).collect()


def test_fnv1a_and_bloom(spark):
    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    words = ["", "a", "foobar", "user:00000001", "é"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", codec.fnv1a(F.col("w")).alias("h"), bloom.positions(codec.fnv1a(F.col("w")), 640).alias("p")).collect()
    for r in got:
        h = fnv(r.w)
        step = (h >> 17) | (h << 15) % 2**32
        assert r.h == h and list(r.p) == [(h + i * step) % 2**32 % 640 for i in range(6)]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in (0, 127, 128, 16384)], "v long").select(codec.uvarint_size(F.col("v"))).collect()] == [1, 1, 2, 3]


def test_bloom_filter_of_ten_thousand_keys(spark):
    own = spark.range(10_000).select(F.format_string("in:%08d", "id").alias("key"))
    other = spark.range(100_000).select(F.format_string("out:%08d", "id").alias("key"))
    f = bloom.build(own)
    assert (f.bits, f.probes) == (100_000, 6) and bloom.bits_of(1) == 64 and bloom.bits_of(7) == 72 and bloom.probes_of(1) == 1 and bloom.probes_of(100) == 30
    assert bloom.may_contain(f, own).where("not maybe").count() == 0
    assert 0 < bloom.may_contain(f, other).where("maybe").count() < 2000
    for lost in (bloom.Filter(f.bits, 31, f.set), bloom.Filter(f.bits, 0, f.set), bloom.Filter(0, 6, f.set), bloom.Filter(64, 6, None)):
        assert bloom.may_contain(lost, other.limit(5)).where("maybe").count() == 5


@pytest.mark.parametrize("seed", range(4))
def test_greedy_groups_against_a_loop(spark, seed):
    """Ranges that no group, one group or many groups close in; rows larger than a group."""
    r = random.Random(seed)
    full = r.choice([5, 60, 900, 100_000])
    rows = [(f"k{r.randrange(300):03d}", i, r.choice([1, 3, 8, 20, 40, 300 if seed % 2 else 9])) for i in range(1500)]
    want, total, generation = {}, 0, 0
    for key, seq, size in sorted(rows, key=lambda x: (x[0], -x[1])):
        if total >= full:
            total, generation = 0, generation + 1
        total += size
        want[key, seq] = generation
    got = upkeep.greedy_groups(spark.createDataFrame(rows, "key string, seq long, size long"), ["key", F.desc("seq")], "size", full)
    assert {(x.key, x.seq): x.generation for x in got.collect()} == want
    assert upkeep.greedy_groups(got.drop("generation").where("false"), ["key"], "size", full).count() == 0


def test_names_and_display(spark):
    row = spark.range(1).select(codec.file_name(F.lit(42), "sst").alias("n"), codec.file_number(F.lit("000000042.wal")).alias("i"), display.preview(F.lit('a"b\\' + "x" * 30)).alias("p"), display.preview(F.lit("")).alias("e"), *[display.size(F.lit(n)).alias(f"s{n}") for n in (0, 1023, 1536, 3 << 20)], *[display.bar(F.lit(x), 4).alias(f"b{k}") for k, x in enumerate((-1.0, 0.5, 7.0))]).collect()[0]
    assert row.n == "000000042.sst" and row.i == 42 and row.p == '"a\\"b\\\\' + "x" * 20 + '"…' and row.e == '""'
    assert (row.s0, row.s1023, row.s1536, row["s3145728"]) == ("0 B", "1023 B", "1.5 KB", "3.0 MB") and (row.b0, row.b1, row.b2) == ("░░░░", "██░░", "████")
    for bad in ("42.sst", "000000042.json", "00000004x.sst"):
        with pytest.raises(PySparkException):
            spark.range(1).select(codec.file_number(F.lit(bad))).collect()
    assert spark.createDataFrame([("", 1, 0)], "key string, seq long, kind int").select(codec.checked(F.col("key"), F.col("seq"), F.col("kind"), on=False)).count() == 1


def test_blocks_of_probes(spark):
    layout = spark.createDataFrame([(0, "b"), (1, "d"), (2, "d"), (3, "f")], "block long, last_key string")
    probes = spark.createDataFrame([(k,) for k in ("a", "b", "c", "d", "e", "f", "g", "a")], "key string")
    assert {r.key: r.block for r in upkeep.block_of(layout, probes).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 3, "f": 3, "g": None}
