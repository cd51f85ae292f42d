"""Mixing sources to target weights by Pareto order sampling (native)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verstore.llm.common import cut, fresh, read, with_rows

#: Source weights by rank, repeating; share of all words to take; most copies of a source's words.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Cells of the ranking by which running sums are formed, at least, and rows of a cell, about.
CELLS, ROWS = 4096, 50_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """rank, source, source_size, target for rows of (source, size).

    A source is full where an even level times its weight passes `most` times
    its size; in order of that level, one running sum finds the final level.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name)).withColumn("w", w)
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    up = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.orderBy("level", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumn("even", (share * F.sum("source_size").over(every) - (F.sum("cap").over(up) - F.col("cap"))) / F.sum("w").over(down))
    per = per.withColumn("full", F.col("even") >= F.col("level"))
    rest = (share * F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)) / F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every)
    return per.withColumn("rest", rest).select("rank", "source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("rest") * F.col("w")).alias("target"))


def prefix(rows: DataFrame, part: list[str], weight: Column, budget: str) -> DataFrame:
    """`rows` with took: whether the running sum of weight in order of (q, id, row) inside `part` is within the budget.

    Sums by cell, then one window over cells and one inside each cell: no
    task holds the rows of a part together.
    """
    rows = rows.withColumn("weight", weight)
    cells = rows.groupBy(*part, "cell").agg(F.sum("weight").alias("s"))
    before = Window.partitionBy(*part).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("before", F.sum("s").over(before) - F.col("s")).drop("s")
    inside = Window.partitionBy(*part, "cell").orderBy("q", "id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(cells, [*part, "cell"]).withColumn("took", F.col("before") + F.sum("weight").over(inside) <= F.col(budget)).drop("before", "weight")


def fill(rows: DataFrame) -> DataFrame:
    """(row) of the documents that still fit one after the other, in order, once the prefixes are taken.

    rows: rank, row, id, q, cell, size, gap of those not taken with a size of the gap or less.  Of
    each size only the first gap / size documents can ever be taken, so a source
    needs gap * log(gap) of them at most, and its gap is less than its longest document: one row a source runs through them.
    """
    few = prefix(rows.withColumn("most", F.floor(F.col("gap") / F.col("size"))), ["rank", "size"], F.lit(1), "most").where("took")
    line = few.groupBy("rank").agg(F.first("gap").alias("gap"), F.array_sort(F.collect_list(F.struct("q", "id", "row", "size"))).alias("line"))
    none = F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda now, x: F.when(x["size"] <= now["gap"], F.struct((now["gap"] - x["size"]).alias("gap"), F.concat(now["taken"], F.array(x["row"])).alias("taken"))).otherwise(now)
    return line.select(F.explode(F.aggregate("line", none, step)["taken"]).alias("row"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies for each row of docs.

    Every document gets the whole copies its source is sure of.  The rest of the target, G
    words of a source of S words, goes to documents by Pareto order sampling: they are
    ranked by random odds divided by inclusion odds, and each one that still
    fits is taken, until nothing fits: a fixed number of words rather than of rows.
    The inclusion odds of a document of s words are (G + s) / (S - G): a document that alone takes
    s / G of the words is passed over that much more often, as it doesn't fit any more, so its odds
    are larger by that share, and all words of a source are about equally likely to be taken.
    Null or empty texts have size 0 and no copies; a null source is one source,
    the last; equal ids share their random number, ties go by id, and rows
    that are alike in both are interchangeable.  Other columns are not read.  An empty table gives an empty result.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))
    u = (F.conv(F.substring(key, 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    sized = docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"), u.alias("u"))
    rows = cut(sized.withColumn("row", F.monotonically_increasing_id()))
    cells = max(CELLS, rows.count() // ROWS)
    per = targets(rows, weights, share, most)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per = per.withColumn("base", base.cast("long")).withColumn("left", F.floor(F.col("target") - F.col("base") * F.col("source_size")).cast("long"))
    per = cut(per)
    small = per.count() < CELLS
    beside = lambda df: F.broadcast(df) if small else df
    q = (F.col("u") / (1 - F.col("u"))) * ((F.col("source_size") - F.col("left")) / (F.col("left") + F.col("size")))
    named = rows.withColumnRenamed("source", "own").join(beside(per), F.col("own").eqNullSafe(F.col("source"))).drop("own")
    opened = named.where("size > 0 and left > 0").withColumn("q", q).withColumn("cell", F.floor(F.col("q") / (1 + F.col("q")) * cells).cast("int"))
    first = cut(prefix(opened.select("rank", "row", "id", "size", "q", "cell", "left"), ["rank"], F.col("size"), "left"))
    gaps = first.groupBy("rank").agg((F.first("left") - F.sum(F.when(F.col("took"), F.col("size")).otherwise(0))).alias("gap"))
    rest = first.where("not took").join(beside(gaps), "rank").where("size <= gap").drop("took", "left")
    took = first.where("took").select("row").unionByName(fill(rest)).withColumn("took", F.lit(1))
    copies = F.col("base") + F.coalesce("took", F.lit(0))
    state = named.join(took, "row", "left")
    return state.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Each row, with all its columns, as often as the mix takes it.

    Rows that share an id, or have none, are drawn one by one, so the words put
    out are those that the mix took.  Rows without words go.  An
    empty table stays empty; columns of any name are kept.
    """
    rows, row = with_rows(docs)
    own, many, copy = (fresh(rows.columns, name) for name in ("__of", "__copies", "__copy"))
    drawn = mix(rows.select(F.col(row).alias("doc_id"), "text", "source")).where("copies > 0").select("doc_id", "copies").toDF(own, many)
    out = rows.join(drawn, F.col(row) == F.col(own))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(many)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("source", "copies")


SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
b AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM a),
c AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS w, 2 * source_size AS cap FROM b),
e AS (SELECT *, cap::DOUBLE / w AS level FROM c),
k AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER (ORDER BY level, rank ROWS UNBOUNDED PRECEDING) - cap)::DOUBLE)
             / (sum(w) OVER (ORDER BY level, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE >= level AS is_full FROM e),
m AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()::DOUBLE) / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()::DOUBLE AS rest FROM k),
t AS (SELECT rank, source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE rest * w::DOUBLE END AS target FROM m),
v AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS base FROM t),
x AS (SELECT *, floor(target - base * source_size)::BIGINT AS budget FROM v),
f AS MATERIALIZED (SELECT d.*, x.rank, x.source_size, x.target, x.base, x.budget, row_number() OVER () AS row FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
o AS MATERIALIZED (SELECT rank, row, size, budget, row_number() OVER (PARTITION BY rank ORDER BY (u / (1 - u)) * ((source_size - budget)::DOUBLE / (budget + size)::DOUBLE), doc_id) AS i FROM f WHERE size > 0 AND budget > 0),
g(rank, i, gap, row, took) AS (SELECT rank, i, CASE WHEN size <= budget THEN budget - size ELSE budget END, row, size <= budget FROM o WHERE i = 1
  UNION ALL SELECT o.rank, o.i, CASE WHEN o.size <= g.gap THEN g.gap - o.size ELSE g.gap END, o.row, o.size <= g.gap FROM g JOIN o ON o.rank = g.rank AND o.i = g.i + 1)
SELECT doc_id, size, source_size, target, size * (base + coalesce(took, FALSE)::BIGINT) AS taken FROM f LEFT JOIN g USING (row)
"""
