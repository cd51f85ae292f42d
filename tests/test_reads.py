import random

import pytest
from pyspark.errors import PySparkException

from verstore.operators import reads, upkeep

LOG = "key string, seq long, kind int, value string"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def pairs(df):
    return [(r.key, r.value) for r in df.orderBy("key").collect()]


VIEW = [("apple", 305, 0, "gold"), ("banana", 304, 1, None), ("cherry", 303, 0, "dark"), ("apple", 2, 0, "green"), ("apple", 0, 0, "red"), ("banana", 1, 0, "yellow"), ("date", 3, 0, "brown")]
HISTORY = [("alice", 11, 0, "70"), ("alice", 7, 0, "100"), ("bob", 12, 0, "80"), ("bob", 8, 0, "50"), ("carol", 13, 1, None), ("carol", 9, 0, "5"), ("dave", 10, 0, "1"), ("erin", 4, 1, None), ("erin", 3, 0, "9")]


def test_live_keeps_newest_and_its_seq(spark):
    rows = [tuple(r) for r in reads.live(log(spark, VIEW)).orderBy("key").collect()]
    assert rows == [("apple", 305, "gold"), ("cherry", 303, "dark"), ("date", 3, "brown")]


def test_snapshot_is_exclusive_and_below_the_choice(spark):
    g = log(spark, HISTORY)
    assert pairs(reads.live(g, 10)) == [("alice", "100"), ("bob", "50"), ("carol", "5")]
    assert pairs(reads.live(g, 10, start="b")) == [("bob", "50"), ("carol", "5")]
    assert pairs(reads.live(g)) == [("alice", "70"), ("bob", "80"), ("dave", "1")]


@pytest.mark.parametrize(
    "rows, alive",
    [
        ([], []),
        ([("a", 1, 1, None)], []),
        ([("a", 2, 1, None), ("a", 1, 0, "x"), ("b", 3, 0, "y")], [("b", "y")]),
        ([("a", 3, 0, "back"), ("a", 2, 1, None), ("a", 1, 0, "old")], [("a", "back")]),
        ([("a", 1, 0, "")], [("a", "")]),
    ],
)
def test_tombstones(spark, rows, alive):
    assert pairs(reads.live(log(spark, rows))) == alive


def test_unknown_kind_is_an_error_only_when_newest(spark):
    assert pairs(reads.live(log(spark, [("a", 2, 0, "x"), ("a", 1, 7, "?")]))) == [("a", "x")]
    with pytest.raises(PySparkException):
        reads.live(log(spark, [("a", 2, 7, "x")])).collect()


def test_scan_is_ordered_half_open_and_limited(spark):
    g = log(spark, [(k, i, 0, k) for i, k in enumerate("dbacae")])
    assert [r.key for r in reads.scan(g, start="b", stop="d").collect()] == ["b", "c"]
    assert [r.key for r in reads.scan(g, limit=2).collect()] == ["a", "b"]
    assert reads.scan(g, start="d", stop="b").count() == 0


def test_states_and_as_of(spark):
    g = log(spark, [("cat", 0, 0, "purr"), ("dog", 1, 0, "woof"), ("big", 2, 0, "big"), ("empty", 3, 0, ""), ("dog", 4, 1, None), ("cat", 5, 0, "meow")])
    asked = spark.createDataFrame([(k,) for k in ("cat", "dog", "empty", "bee")], "key string")
    assert {r.key: (r.state, r.value) for r in reads.get_state(g, asked).collect()} == {"cat": (0, "meow"), "dog": (1, None), "empty": (0, ""), "bee": (2, None)}
    k = log(spark, [("k", 9, 0, "v9"), ("k", 5, 0, "v5"), ("k", 1, 0, "v1")])
    asked = spark.createDataFrame([("k", n) for n in (10, 9, 7, 2, 0, None)], "key string, as_of_seq long")
    assert {r.as_of_seq: (r.state, r.value) for r in reads.get_as_of(k, asked).collect()} == {10: (0, "v9"), 9: (0, "v9"), 7: (0, "v5"), 2: (0, "v1"), 0: (2, None), None: (0, "v9")}
    with pytest.raises(ValueError):
        reads.get(k, "")


def test_seek_and_order_of_entries(spark):
    g = log(spark, [(k, s, 0, "x") for k in ("a", "ab", "abc", "b") for s in (1, 2, 9)])
    assert [f"{r.key}@{r.seq}" for r in reads.merge(g).collect()] == "a@9 a@2 a@1 ab@9 ab@2 ab@1 abc@9 abc@2 abc@1 b@9 b@2 b@1".split()
    asked = spark.createDataFrame([("",), ("aa",), ("ab",), ("b",), ("c",)], "key string")
    assert {r.probe: r.key for r in reads.seek(g, asked).collect()} == {"": "a", "aa": "ab", "ab": "ab", "b": "b", "c": None}
    assert tuple(reads.seek_entry(g, "ab", 5).collect()[0])[:2] == ("ab", 2)


def test_labels(spark):
    got = {(r.key, r.seq): r.label for r in reads.labelled(log(spark, VIEW)).collect()}
    assert got[("apple", 305)] == "current" and got[("apple", 2)] == "shadowed" and got[("banana", 304)] == "tombstone" and got[("banana", 1)] == "shadowed"


def test_random_operations_against_a_dict(spark):
    for seed in range(3):
        r, model, rows = random.Random(seed), {}, []
        for i in range(300):
            k = f"k{r.randrange(60):03d}"
            if r.random() < 0.25:
                model.pop(k, None)
                rows.append((k, i, 1, None))
            else:
                model[k] = f"v{i}"
                rows.append((k, i, 0, f"v{i}"))
        g = log(spark, rows)
        assert pairs(reads.live(g)) == sorted(model.items())
        assert pairs(reads.live(upkeep.compacted(g))) == sorted(model.items())
        a, b = sorted(r.sample(range(60), 2))
        lo, hi = f"k{a:03d}", f"k{b:03d}"
        assert pairs(reads.live(g, start=lo, stop=hi)) == [x for x in sorted(model.items()) if lo <= x[0] < hi]
        split = [g.where(f"seq % 3 = {k}") for k in range(3)]
        assert pairs(reads.live(reads.merge(*split))) == sorted(model.items())


def test_first_missing_number(spark):
    rows = lambda ns: log(spark, [(f"user:{n:08d}", i, 0, "x") for i, n in enumerate(ns)] + [("user:7", 90, 0, "x"), ("user:00000007x", 91, 0, "x"), ("zzz", 92, 0, "x")])
    find = lambda ns: reads.first_missing(rows(ns)).collect()[0][0]
    assert [find(ns) for ns in ([], [1, 2], [0, 1, 2, 4], list(range(300)))] == [0, 0, 3, 300]
    assert reads.first_missing(log(spark, [("user:00000000", 0, 0, "x"), ("user:00000001", 1, 0, "x"), ("user:00000001", 2, 1, None)])).collect()[0][0] == 1


def test_ranks_and_repeated_entries(spark):
    r = random.Random(3)
    rows = [(f"k{r.randrange(40):02d}", i, 0, "x") for i in range(400)]
    got = {(x.key, x.seq): x.position for x in reads.ranked(log(spark, rows)).collect()}
    assert got == {(k, s): i for i, (k, s) in enumerate(sorted(((k, s) for k, s, _, _ in rows), key=lambda x: (x[0], -x[1])), 1)}
    assert [tuple(x) for x in reads.repeated_entries(log(spark, rows + rows[:1])).collect()] == [(*rows[0][:2], 2)]
    assert tuple(reads.hit_rate(log(spark, VIEW), spark.createDataFrame([("apple",), ("banana",), ("x",), ("apple",)], "key string")).collect()[0]) == (4, 2, 1, 1)
