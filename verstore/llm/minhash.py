"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verstore.llm.common import SMALL, chunks, cut, in_batches, read, tidy, with_rows, without, words
from verstore.llm.components import connected_components

#: Bands and registers of a band; mantissa bits of a register.
BANDS, ROWS, MANTISSA = 25, 5, 10
#: Members that one task compares with each other, and shingles they may hold together.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
WORDS, PERCENT = 5, 80

_rng = np.random.default_rng(7)
MULTIPLY = (_rng.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]
MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted 64-bit hashes; of fewer words the whole sequence is one."""
    at, flat = words(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    own = table[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    mixed = np.zeros(max(0, len(own) - n + 1), np.uint64)
    for k in range(n):
        mixed = scramble(mixed + own[k : len(own) - n + 1 + k] * MIX[k]) if len(mixed) else mixed
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(mixed[a : b - n + 1]))
        elif b > a:
            out.append(scramble(np.array([np.bitwise_xor.reduce(scramble(own[a:b] * MIX[n : n + b - a])) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(own[:0])
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one of each bucket's least hash, as 16 bits."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for i in range(0, x.shape[1], 2048):
        np.minimum(least, (x[:, i : i + 2048] * MULTIPLY + ADD).min(axis=1), out=least)
    exponent = np.frexp(least.astype(float))[1]
    zeros = (32 - exponent).astype(np.uint32)
    after = (least.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(2**32 - 1)
    return ((zeros << np.uint32(MANTISSA)) | (after >> np.uint64(32 - MANTISSA)).astype(np.uint32)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    parts = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = scramble(key * MIX[k] + parts[:, k])
    return key.view(np.int64)


def chance(n: float, m: float) -> float:
    """How often registers of unrelated sets of n and m agree: both minima in one cell."""
    zeros = np.arange(32)
    mass = lambda k: (1 - 0.5 ** (zeros + 1)) ** k - (1 - 0.5**zeros) ** k
    return float((mass(n) * mass(m)).sum() / 2**MANTISSA)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n, set_hash, keys: sizes, 128-bit set fingerprints and band keys (none for an empty set)."""

    def run(batches):
        for part in chunks(batches):
            sets = shingle_sets(part.column("text"), n)
            keys = [band_keys(registers(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            prints = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), prints, lists], names=["doc_id", "n", "set_hash", "keys"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n long, set_hash binary, keys array<long>")


def link_block(ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that join the block's components: pairs with 100 * intersection >= percent * union.

    label: a number for each member's component so far.  A pair is looked at only while its ends are apart:
    sizes, then the sketches' estimate corrected for chance agreement, five
    deviations below the threshold, then the full sets.
    """
    size = np.array([len(s) for s in sets], np.int64)
    regs = np.stack([registers(s) for s in sets])
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5
    label, edges = label.copy(), []
    for i in range(len(ids)):
        apart = np.flatnonzero(label != label[i])
        apart = apart[(100 * np.minimum(size[apart], size[i]) >= percent * np.maximum(size[apart], size[i]))]
        if not len(apart):
            continue
        base = chance(size[i], size[i])
        guess = ((regs[apart] == regs[i]).mean(axis=1) - base) / (1 - base)
        order = apart[np.argsort(-guess, kind="stable")]
        for j in order[: int((guess >= least).sum())]:
            if label[j] == label[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (size[i] + size[j] - shared):
                edges.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return edges


def confirmed(groups: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) within groups: rows (gid, block, id, n, component)."""
    groups = cut(groups)
    total, count = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    bins = max(1, total // 500_000)
    members = groups.select(F.pmod(F.xxhash64("gid", "block"), F.lit(bins)).alias("bin"), "gid", "block", F.col("id").alias("member"), "component")
    texts = docs.select(F.col("doc_id").alias("member"), "text")
    joined = texts.join(F.broadcast(members) if count <= SMALL else members, "member").repartition(int(min(bins, 20_000)), "bin", "gid", "block")

    def run(batches):
        # The rows of a (gid, block) come together after the sort; one block at a time is in memory.
        rows: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            gid, block = batch.column("gid").to_numpy(zero_copy_only=False), batch.column("block").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((np.diff(gid) != 0) | (np.diff(block) != 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
                if b == a:
                    continue
                key = (gid[a], block[a])
                if rows and key != last:
                    yield resolve(rows)
                    rows = []
                last = key
                rows.append(batch.slice(a, b - a))
        if rows:
            yield resolve(rows)

    def resolve(rows):
        table = pa.Table.from_batches(rows).combine_chunks()
        sets: list[np.ndarray] = []
        for part in chunks(table.to_batches()):
            sets += shingle_sets(part.column("text"), n)
        found = link_block(table.column("member").to_numpy(), sets, table.column("component").to_numpy(), percent)
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return joined.sortWithinPartitions("gid", "block").mapInArrow(tidy(run), "a long, b long")


def parts(count, shingles):
    """Blocks that a group is dealt to."""
    return F.greatest(F.ceil(count / F.lit(BLOCK)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("long")


def opposed(members: DataFrame) -> DataFrame:
    """(gid, block, id, n, component): blocks in which any two members of one bucket (key) but different components meet.

    members: key, id, n, component.  A bucket's largest component, by shingles, is never set against itself: its
    parts meet those of all the rest, and these each other.  So a huge group that shares a bucket
    with a few others is read as often as they fill blocks, mostly once.
    """
    per = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    per = per.groupBy("key").agg(F.max(F.struct("s", "c", "component")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    per = per.select("key", F.col("top.component").alias("top"), parts(F.col("top.c"), F.col("top.s")).alias("big"), parts(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("few"))
    big, few, own = F.col("big"), F.col("few"), F.col("own")
    numbers = lambda count: F.sequence(F.lit(0).cast("long"), count - 1)
    inside = F.col("component") == F.col("top")
    rows = members.join(per, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.when(inside, big).otherwise(few)))
    against = F.transform(numbers(big), lambda b: b * few + own)
    others = F.transform(F.filter(numbers(few), lambda o: o != own), lambda o: (big + F.least(o, own)) * few + F.greatest(o, own))
    blocks = F.when(inside, F.transform(numbers(few), lambda o: own * few + o)).otherwise(F.concat(against, others))
    return rows.select(F.col("key").alias("gid"), F.explode(blocks).alias("block"), "id", "n", "component")


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Documents are linked where 100 * intersection >= percent * union of their
    sets of n-word shingles (A-Z lower-cased); component_id is the smallest doc_id
    reachable.  Documents with one set are linked without comparison.
    Candidates share a band of registers; pairs of similarity 0.8 (0.85) miss every band with a
    probability of 5e-5 (4e-7).  First each bucket's members meet its smallest one; then
    in buckets that still hold several components all members of different ones are compared, in
    blocks of bounded size.  Null and empty texts have the empty set and no links.
    Rows with equal ids get the component of their set each; rows with a null id
    have a null component and are not kept apart: kept is null.  Other columns are not read.
    """
    sketch = in_batches(sketches(docs, n))
    ids = F.col("doc_id").cast("long")
    sets = sketch.where("n > 0 and doc_id is not null")
    reps = cut(sets.groupBy("set_hash").agg(F.min(F.struct(ids.alias("id"), "n", "keys")).alias("r")).select("set_hash", "r.*"))
    bands = reps.select("id", "n", F.explode("keys").alias("key"))
    leaders = bands.groupBy("key").agg(F.min("id").alias("gid"), F.min_by("n", "id").alias("gn"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    stars = cut(bands.join(leaders, "key").where("id <> gid").select("gid", "gn", "id", "n").where("100 * least(n, gn) >= {0} * greatest(n, gn)".format(percent)).distinct())
    sizes = stars.groupBy("gid", "gn").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).select("gid", "gn", parts(F.col("c"), F.col("s")).alias("blocks"))
    followers = stars.drop("gn").join(sizes.drop("gn"), "gid").select("gid", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "n")
    heads = sizes.select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("gid").alias("id"), F.col("gn").alias("n"))
    first = in_batches(confirmed(followers.unionByName(heads).withColumn("component", F.col("id")), docs, n, percent))

    known = connected_components(first)
    named = cut(reps.join(known, "id", "left").select("set_hash", "id", "n", "keys", F.coalesce("component", "id").alias("component")))
    bands = named.select("id", "n", "component", F.explode("keys").alias("key"))
    # 24 bits at a time, so no sum overflows; where an id repeats in a bucket, it cancels in the last one only.
    h = F.xxhash64("id")
    signs = [F.sum(F.shiftrightunsigned(h, 40)).alias("sign0"), F.sum(h.bitwiseAND(F.lit(0xFFFFFF))).alias("sign1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("sign2")]
    apart = bands.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("c"), *signs).where("x <> y")
    # Buckets of the same members are one.
    apart = apart.groupBy("c", "sign0", "sign1", "sign2").agg(F.min("key").alias("key")).select("key")
    rows = opposed(cut(bands.join(apart, "key")))
    rest = in_batches(confirmed(rows, docs, n, percent))
    merged = connected_components(rest.unionByName(first))
    final = named.select("set_hash", "id").join(merged, "id", "left").select(F.col("set_hash").alias("own"), F.coalesce("component", "id").alias("found"))
    out = sketch.drop("keys").join(final, (F.col("set_hash") == F.col("own")) & (F.col("n") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", ids))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (ids == component).alias("kept"))


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, less those with a near-duplicate of smaller id in their component.

    Where ids are null or repeat, rows are numbered and the first one of each component stays,
    so rows that share an id are judged by their own texts and equal rows are one.  Null and empty texts are
    near nothing and stay.  An empty table stays empty; columns of any name are kept.
    """
    rows, row = with_rows(docs)
    drop = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), n, percent).where("not kept").select("doc_id")
    return without(rows, row, drop, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), 3, 85)


SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.id WHERE r.seen < e.b) SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
