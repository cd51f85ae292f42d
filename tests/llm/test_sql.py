"""Operators against their own SQL on rows that the driver's tables do not hold."""
import random

import duckdb
import pytest

from verstore.llm import embedding_dedup, exact_dedup, mixing, minhash, url_filter

from .conftest import TEXTS


def agree(spark, folder, table, df, module):
    path = str(folder / f"{table}.parquet")
    df.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = module.query(spark, str(folder))
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({module.SQL})").fetchall()
    ours = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(map(repr, ours)) == sorted(map(repr, want))
    return [dict(zip(names, r)) for r in ours]


@pytest.mark.parametrize("seed", range(2))
def test_urls_with_links_across_hosts(spark, tmp_path, seed):
    r = random.Random(seed)
    hosts = [f"{n}.{r.choice(['com', 'net', 'org'])}" for n in ("example", "www.example", "a", "b", "c", "d", "e", "F", "g", "h")]
    rows = []
    for i in range(120):
        links = "".join(f"<a {r.choice(['href', 'HREF'])}={q}{r.choice(['https:', ''])}//{r.choice(hosts)}/x{q}>" for q in r.choices(['"', "'", ""], k=r.randint(0, 3)))
        rows.append((i, f"https://{r.choice(hosts)}/{r.choice(['en/', 'es/', 'fr/a', '', 'x?en/'])}", links))
    rows += [(500, None, None), (500, None, None), (501, "no scheme", "x"), (502, "http://", None), (503, "http://it's.org#x://y", None), (None, "http://x.org\n/a", "")]
    got = agree(spark, tmp_path, "pages", spark.createDataFrame(rows, "page_id long, url string, html string"), url_filter)
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_vectors_that_are_odd(spark, tmp_path):
    r = random.Random(3)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in base[i % 12]]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [None] + [1.0] * 7), (204, [float("nan")] * 8), (205, [float("inf")] + [1.0] * 7), (206, base[0][:5]), (207, base[0][:5]), (None, base[0])]
    got = agree(spark, tmp_path, "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<double>"), embedding_dedup)
    assert max(r["n_links"] for r in got) > 2


@pytest.mark.parametrize("module", [exact_dedup, minhash, mixing])
def test_documents_that_are_odd(spark, tmp_path, module):
    r = random.Random(5)
    rows = [(i, t, f"s{i % 4}" if i % 5 else None) for i, t in TEXTS if i is not None and i < 9]
    words = ["".join(r.choice("abcd") for _ in range(3)) for _ in range(40)]
    for i in range(100, 160):
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))), r.choice(["x", "y", "ÿ", None])))
        rows.append((i + 100, rows[-1][1] + " more" * r.randint(0, 2), "z"))
    agree(spark, tmp_path, "documents", spark.createDataFrame(rows, "doc_id long, text string, source string"), module)
