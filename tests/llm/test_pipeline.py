"""The pipeline's stages on odd rows, and against brute force."""
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verstore.llm import langid, mixing

from .test_operators import components, split

REPO = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
CLASHING = ["lang_pred", "score", "__row", "__keep", "__drop", "__of", "__id", "__copy", "__copies", "row", "h", "id", "n", "keys", "size", "rank", "q", "took", "cell", "DOC_ID_"]
STAGES = dict(corpus_pipeline.STAGES)


def table(spark, rows):
    """(doc_id, text, lang, source) with columns whose names are used inside; their values must come through."""
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return out.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.length("text"), F.lit(-1)).cast("string")) for c in CLASHING})


def made(seed):
    r = random.Random(seed)
    parts = {"en": ["the", "ing", "tion", "er", "and"], "de": ["der", "sch", "ung", "keit", "und"]}
    rows = []
    for i in range(150):
        lang = r.choice(["en", "de"])
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 80))), lang, r.choice(["a", "b", "b", None])))
    for i in range(150, 200):
        _, text, lang, source = r.choice(rows[:150])
        own = text.split(" ")
        if r.random() < 0.5:
            own[r.randrange(len(own))] = "other"
        rows.append((i, " ".join(own), lang, source))
    long = " ".join("".join(r.choice(parts["en"]) for _ in range(2)) for _ in range(60_000))
    return rows + [(300, None, "en", "a"), (301, "", "en", "a"), (302, " \n", None, "b"), (303, "12 . 34", None, "b"), (304, long, "en", "b"), (305, long, "en", None), (306, "solo", None, None)]


ODD = [(1, "one two three four five six", "en", "a")] * 3 + [(1, "one two three four five seven eight nine ten", "en", "a"), (None, "no id at all here", "en", "b"), (None, "no id at all here", "en", "b"), (None, None, None, None), (2, None, None, None), (2, "one two three four five seven eight nine ten", "de", None), (None, "x y", "en", "b")]
TABLES = {"made": lambda: made(1), "odd": lambda: made(2)[:40] + ODD, "empty": list}


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", sorted(TABLES))
def test_stages(spark, name):
    docs = table(spark, TABLES[name]()).cache()
    texts = {r: r.text for r in docs.collect()}

    model = langid.train(docs)
    known = STAGES["language"](spark, docs, "")
    assert known.columns == docs.columns
    says = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert all(r.text and any(c.isalpha() for c in r.text) for r in known.collect())
    assert known.count() == sum(1 for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)) or "und" not in says.values()

    exact = STAGES["exact_dedup"](spark, docs, "").cache()
    kept = exact.collect()
    assert exact.columns == docs.columns and set(kept) <= set(texts)
    assert sorted(r.text or "" for r in kept) == sorted({t or "" for t in texts.values()})
    if name == "made":
        assert all(r.doc_id == max(o.doc_id for o in texts if (o.text or "") == (r.text or "")) for r in kept)

    near = STAGES["near_dedup"](spark, exact, "").cache()
    kept_near = near.collect()
    sets = {}
    for k, r in enumerate(kept):
        w = split("".join(c.lower() if c.isascii() else c for c in r.text or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups = {}
    for k, c in components(links, sets).items():
        groups.setdefault(c, []).append(kept[k])
    assert near.columns == docs.columns and len(kept_near) == len(groups)
    assert all(sum(r in own for r in kept_near) == 1 for own in groups.values())
    if name == "made":
        assert sorted(r.doc_id for r in kept_near) == sorted(min(r.doc_id for r in own) for own in groups.values())

    mixed = STAGES["mixing"](spark, near, "").cache()
    out = mixed.collect()
    assert mixed.columns == docs.columns and set(out) <= set(kept_near)
    if name == "made":
        took = {r.doc_id: r.taken for r in mixing.mix(near).collect()}
        words = {r.doc_id: len(split(r.text)) for r in kept_near}
        assert {i: sum(words[i] for r in out if r.doc_id == i) for i in words} == took
    assert all(out.count(r) <= 2 * kept_near.count(r) for r in kept_near)

    packed = STAGES["packing"](spark, mixed, "").collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert sum(r.start == 0 for r in packed) == len(out)


def test_equal_rows_and_shared_ids(spark):
    docs = table(spark, ODD)
    exact = STAGES["exact_dedup"](spark, docs, "")
    assert sorted((r.text or "") for r in exact.collect()) == ["", "no id at all here", "one two three four five seven eight nine ten", "one two three four five six", "x y"]
    near = STAGES["near_dedup"](spark, docs, "")
    assert len(near.collect()) == 6  # two empty texts are near nothing


def test_run_is_the_stages_in_a_row(spark, tmp_path):
    table(spark, made(3)).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
    assert rows_of(got.drop("sequence_id", "offset")) == rows_of(docs.drop("sequence_id", "offset")) and got.count() > 100


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7000")
def missing(_):
    try:
        import verstore
        yield False
    except ModuleNotFoundError:
        yield True
assert all(spark.sparkContext.parallelize(range(4), 4).mapPartitions(missing).collect())
names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()] + ["pipeline"]
print(len(names), *[n for n in names if __spark_entry__.queries()[n](spark, "/root/testdata/sf0.001").count() < 1])
assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7000"
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_executors_need_not_have_the_package(tmp_path):
    """Only the driver's path has the repository; its workers start elsewhere and cannot import it."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, folder=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0, got.stderr[-3000:]
    assert got.stdout.strip().splitlines()[-1] == "11"
