"""URL filters: host and path rules, and link-graph trust for the rest (native)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verstore.llm.common import cut, read

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Damping, rounds of propagation in the SQL, and how many times its trust a host's distrust must reach to be blocked.
DAMPING, ROUNDS, LIMIT = 0.85, 12, 1.0
#: Share of any host's score that a round may still add at the end, and rounds between two looks at it.
TOLERANCE, LOOK = 1e-6, 8
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """host and path of __url; both empty where there is no '://'."""
    rest = F.expr("CASE WHEN instr(__url, '://') > 0 THEN substring(__url, instr(__url, '://') + 3) ELSE '' END")
    both = pages.withColumn("__rest", F.regexp_extract(rest, r"(?s)^[^?#]*", 0)).withColumn("host", F.regexp_extract("__rest", r"(?s)^[^/]*", 0))
    return both.withColumn("path", F.expr("substring(__rest, length(host) + 1)")).withColumn("host", lower_ascii(F.col("host"))).drop("__rest")


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct(length, rule, verdict), or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, kind, score: personalised PageRank of each kind from its seeds.

    edges: kind, src, dst, share (of src's links); seeds: kind, host, seed.
    Each round joins the scores to the edges and sums them by (kind, dst);
    sums form before the shuffle, so a much-linked host is one row per task.
    Scores grow from the seeds' own share, so `last`, the score of the round before, is less
    wherever mass or a new host still arrives; rounds go on until none adds more than `tolerance` of a host's score.
    Hosts without links give their mass back to the seeds: that scales all scores of a kind by one number, so they are
    summed as if it were lost and then brought to a sum of 1.
    """
    own = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
    scores = own.withColumn("last", F.lit(0.0))
    while True:
        for _ in range(LOOK):
            sent = scores.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), *[(damping * F.col(c) * F.col("share")).alias(c) for c in ("score", "last")])
            scores = sent.unionByName(own.withColumn("last", F.col("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("last").alias("last"))
        scores = cut(scores)
        if scores.where(F.col("score") - F.col("last") > tolerance * F.col("score")).isEmpty():
            sums = scores.groupBy("kind").agg(F.sum("score").alias("all"))  # a row a kind
            return scores.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("score") / F.col("all")).alias("score"))


def host_scores(judged: DataFrame) -> DataFrame:
    """host, trust, distrust for every host of pages or links.

    Trust starts at hosts with allowed pages and follows links; distrust
    starts at hosts with blocked pages and goes against links, to those who link there.
    """
    pages = judged.where("host != ''")
    seeds = pages.where("verdict is not null").groupBy(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = cut(seeds.join(total, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed")))
    links = pages.select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("dst != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    links = cut(links)
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = cut(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    scores = propagate(edges, seeds)
    one = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return scores.groupBy("host").agg(one("trust"), one("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages.

    Null urls and urls without '://' have an empty host and path.  Where no rule
    fits, a host is blocked if its distrust is above 0 and `limit` times its trust or
    more; hosts that no seed reaches, and empty hosts, are allowed.  Null html has no
    links.  Rows are judged one by one, so repeated rows repeat.  Other columns are not read.
    """
    rows = with_parts(pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("__url"), F.col("html").alias("__html")))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    links = F.transform(F.coalesce(F.regexp_extract_all("__html", F.lit(LINK), F.lit(1)), F.array().cast("array<string>")), lower_ascii)
    scores = cut(host_scores(rows.select("host", F.col("best.verdict").alias("verdict"), links.alias("links"))))
    judged = rows.select("page_id", "host", "path", "best").join(scores, "host", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    own = F.when((distrust > 0) & (distrust >= limit * trust), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages")).drop("trust", "distrust")


def _round(step: int) -> str:
    return f"""
s{step} AS (SELECT kind, host, sum(score) AS score FROM (SELECT e.kind, e.dst AS host, {DAMPING}::DOUBLE * s.score * e.share AS score FROM s{step - 1} s JOIN edges e ON e.kind = s.kind AND e.src = s.host
  UNION ALL SELECT kind, host, (1 - {DAMPING}::DOUBLE) * seed FROM seeds) GROUP BY kind, host)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_LINK = LINK.replace("'", "''")
SQL = f"""
WITH r(v, h, p) AS (VALUES {_RULES}),
u AS (SELECT page_id, html, coalesce(url, '') AS url FROM pages),
t AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM u),
w AS (SELECT *, regexp_extract(rest, '^[^/]*') AS named FROM t),
d AS (SELECT page_id, html, {_LOWER("named")} AS host, substr(rest, length(named) + 1) AS path FROM w),
places AS (SELECT DISTINCT host, path FROM d),
fit AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
        FROM places JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
j AS (SELECT d.*, rule, verdict FROM d LEFT JOIN fit USING (host, path)),
n AS (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM j WHERE host <> '' AND verdict IS NOT NULL GROUP BY ALL),
seeds AS (SELECT kind, host, n::DOUBLE / (sum(n) OVER (PARTITION BY kind))::DOUBLE AS seed FROM n),
x AS (SELECT host AS src, {_LOWER("unnest(regexp_extract_all(html, '" + _LINK + "', 1))")} AS dst FROM j WHERE host <> ''),
links AS (SELECT src, dst, count(*) AS n FROM x WHERE dst <> '' AND src <> dst GROUP BY src, dst),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
edges AS (SELECT kind, src, dst, n::DOUBLE / (sum(n) OVER (PARTITION BY kind, src))::DOUBLE AS share FROM both_ways),
s0 AS (SELECT kind, host, seed AS score FROM seeds),{",".join(map(_round, range(1, ROUNDS + 1)))},
y AS (SELECT kind, host, score / (sum(score) OVER (PARTITION BY kind))::DOUBLE AS score FROM s{ROUNDS}),
z AS (SELECT host, sum(CASE kind WHEN 'trust' THEN score ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN score ELSE 0 END) AS distrust FROM y GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > 0 AND distrust >= {LIMIT}::DOUBLE * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN z USING (host)
"""
