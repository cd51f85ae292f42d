"""Near-duplicate vectors by a navigable small-world graph per shard."""
from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verstore.llm.common import cut, read, tidy
from verstore.llm.components import connected_components

COSINE = 0.95
#: Shards at least; vectors of a shard and bytes of its graph at most; vectors of a block of queries and of the queries of one task, about.
SHARDS, SHARD, BYTES, QUERIES, SPLIT = 6, 200_000, 192 << 20, 4096, 250_000
#: Neighbours of a node, beam in building, first beam of a query, audited queries of a block and their least recall.
LINKS, BUILD, BEAM, AUDIT, RECALL = 16, 32, 16, 64, 0.99
WIDTH = 4
SLACK = 1e-4
#: Pairs of a query and a node that a worker holds at a time, about.
PAIRS = 1 << 20


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; searches run for many queries at once."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.x = vectors.astype(np.float32)
        self.levels = levels
        self.top = int(levels.max()) if len(levels) else 0
        self.near = [np.full((len(vectors), 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(self.top + 1)]
        self.entry = -1

    def build(self) -> "Graph":
        order = np.argsort(-self.levels, kind="stable")  # upper layers first
        i = 0
        while i < len(order):
            batch = order[i : i + min(512, max(1, i // 4))]
            self._insert(batch)
            i += len(batch)
        return self

    def _insert(self, batch: np.ndarray) -> None:
        q = self.x[batch]
        if self.entry < 0:
            self.entry = int(batch[0])
            return
        at = np.full((len(batch), 1), self.entry, np.int32)
        inner = q @ q.T
        np.fill_diagonal(inner, -2)
        for layer in range(self.top, -1, -1):
            own = self.levels[batch] >= layer
            ids, sims = self.search_layer(q, at, BUILD if own.any() else 1, layer)
            at = ids[:, :1]
            if not own.any():
                continue
            keep = np.flatnonzero(own)
            # Those of one batch also see each other.
            k = min(8, len(keep))
            mates = keep[np.argpartition(-inner[np.ix_(keep, keep)], k - 1, axis=1)[:, :k]]
            mate_sims = np.take_along_axis(inner[keep], mates, axis=1)
            cand = np.hstack([ids[keep], np.where(mate_sims > -2, batch[mates], -1)])
            value = np.hstack([sims[keep], mate_sims])
            self._connect(batch[keep], cand, value, layer)

    def _select(self, cand: np.ndarray, value: np.ndarray, limit: int) -> np.ndarray:
        """Up to `limit` of each row: the nearest, less those nearer to a chosen one; then the nearest of the rest."""
        value = np.where(cand >= 0, value, -3)
        order = np.argsort(-value, axis=1, kind="stable")
        cand, value = np.take_along_axis(cand, order, 1), np.take_along_axis(value, order, 1)
        twice = np.zeros(cand.shape, bool)
        by_id = np.argsort(cand, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(cand, by_id, 1)
        np.put_along_axis(twice, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
        value = np.where(twice, -3, value)
        v = self.x[cand]
        among = np.einsum("bid,bjd->bij", v, v)
        chosen = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            rival = (chosen & (among[:, j] > value[:, j : j + 1])).any(axis=1)
            chosen[:, j] = (value[:, j] > -3) & ~rival & (chosen.sum(axis=1) < limit)
        rank = np.where(chosen, value + 4, np.where(value > -3, value, -9))
        pick = np.argsort(-rank, axis=1, kind="stable")[:, :limit]
        return np.where(np.take_along_axis(rank, pick, 1) > -9, np.take_along_axis(cand, pick, 1), -1)

    def _connect(self, nodes: np.ndarray, cand: np.ndarray, value: np.ndarray, layer: int) -> None:
        near = self.near[layer]
        picked = self._select(cand, value, min(LINKS, near.shape[1]))
        near[nodes, : picked.shape[1]] = picked
        src, dst = np.repeat(nodes, picked.shape[1]), picked.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(dst) != 0])) if len(dst) else np.zeros(0, int)
        count = np.diff(np.append(first, len(dst)))
        for a in range(0, len(first), 1024):
            f, c = first[a : a + 1024], count[a : a + 1024]
            target = dst[f]
            more = np.full((len(f), int(c.max())), -1, np.int64)
            row = np.repeat(np.arange(len(f)), c)
            col = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            more[row, col] = src[f[0] : f[0] + int(c.sum())]
            more = more[:, : 3 * near.shape[1]] if more.shape[1] > 3 * near.shape[1] else more
            every = np.hstack([near[target], more])
            sims = np.einsum("bd,bkd->bk", self.x[target], self.x[every])
            near[target] = self._fill(self._select(every, np.where(every >= 0, sims, -3), near.shape[1]), near.shape[1])

    @staticmethod
    def _fill(rows: np.ndarray, width: int) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, width - rows.shape[1])), constant_values=-1)

    def search_layer(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and similarities of the best `beam` nodes found, best first; -1 where there are fewer."""
        out_ids, out_sims = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -2.0, np.float32)
        step = max(8, min(512, (64 << 20) // max(1, len(self.x)), 4 * PAIRS // beam))
        for a in range(0, len(q), step):
            out_ids[a : a + step], out_sims[a : a + step] = self._beam(q[a : a + step], entry[a : a + step], beam, layer)
        return out_ids, out_sims

    def _beam(self, q, entry, beam, layer):
        near, b = self.near[layer], len(q)
        seen = np.zeros((b, len(self.x) + 1), bool)
        ids, sims, done = np.full((b, beam), -1, np.int64), np.full((b, beam), -2.0, np.float32), np.ones((b, beam), bool)
        n = min(beam, entry.shape[1])
        ids[:, :n], done[:, :n] = entry[:, :n], entry[:, :n] < 0
        sims[:, :n] = np.where(entry[:, :n] >= 0, np.einsum("bd,bkd->bk", q, self.x[entry[:, :n]]), -2)
        np.put_along_axis(seen, ids[:, :n], True, 1)
        live = np.arange(b)
        width = min(WIDTH, beam)
        while len(live):
            open_sims = np.where(done[live], -3, sims[live])
            pick = np.argpartition(-open_sims, width - 1, axis=1)[:, :width]
            ok = np.take_along_axis(open_sims, pick, 1) > -3
            some = ok.any(axis=1)
            live, pick, ok = live[some], pick[some], ok[some]
            if not len(live):
                break
            nodes = np.where(ok, ids[live[:, None], pick], -1)
            mark = done[live]
            np.put_along_axis(mark, pick, True, 1)
            done[live] = mark
            cand = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(live), -1).astype(np.int64)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            known = seen[live[:, None], cand] | (cand < 0)
            cand = np.where(known, -1, cand)
            seen[live[:, None], cand] = True
            value = np.where(cand >= 0, np.einsum("bd,bkd->bk", q[live], self.x[cand]), -2).astype(np.float32)
            all_ids, all_sims = np.hstack([ids[live], cand]), np.hstack([sims[live], value])
            all_done = np.hstack([done[live], cand < 0])
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(self.top, 0, -1):
            at, _ = self.search_layer(q, at, 1, layer)
        return self.search_layer(q, at, beam, 0)

    def within(self, q: np.ndarray, least: float, beam: int):
        """(queries, nodes) of similarities of `least` or more, in pieces of about PAIRS.

        A query whose beam holds nothing below `least` gets one twice as wide; where the beam
        would hold a quarter of all nodes, products with all of them are cheaper and exact.
        """
        todo = np.arange(len(q))
        while len(todo):
            if 4 * beam >= len(self.x):
                step = max(1, PAIRS // len(self.x))
                for i in range(0, len(todo), step):
                    r, c = np.nonzero(q[todo[i : i + step]] @ self.x.T >= least)
                    yield todo[i : i + step][r], c
                return
            wider, step = [], max(1, PAIRS // beam)
            for i in range(0, len(todo), step):
                part = todo[i : i + step]
                ids, sims = self.search(q[part], beam)
                hit = (ids >= 0) & (sims >= least)
                full = hit.all(axis=1)
                r, c = np.nonzero(hit & ~full[:, None])
                yield part[r], ids[r, c]
                wider.append(part[full])
            todo, beam = np.concatenate(wider), beam * 2


def save(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles, filled up with 0 to width; their own lengths."""
    at = column.offsets.to_numpy()
    size = np.diff(at)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(int(size.sum())) - np.repeat(at[:-1] - at[0], size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out, size


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def level_of(ids: np.ndarray) -> np.ndarray:
    """Layers by a hash of the id, geometric with 1 / LINKS."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    u = ((x >> np.uint64(11)).astype(float) + 1) / 2**53
    return np.minimum((-np.log(u) / np.log(LINKS)).astype(int), 6)


class Joined:
    """Labels of numbers joined so far: pairs that add nothing are passed over all at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs (a, b) join what was apart."""
        apart = np.flatnonzero(self.label[a] != self.label[b])
        if not len(apart):
            return apart
        x, y = self.label[a[apart]], self.label[b[apart]]
        _, first = np.unique(np.minimum(x, y) * len(self.label) + np.maximum(x, y), return_index=True)
        up: dict[int, int] = {}

        def root(k):
            while up.setdefault(k, k) != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        picked = []
        for i, p, q in zip(first.tolist(), x[first].tolist(), y[first].tolist()):
            p, q = root(p), root(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                picked.append(i)
        to = np.arange(len(self.label))
        to[list(up)] = [root(k) for k in list(up)]
        self.label = to[self.label]
        return apart[picked]


def links_of(graph: Graph, own: dict, block: dict, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """By query the vectors linked in double precision, rows of (query, node) that join what these links join, and the beam at which the audit passed.

    A node counts as many vectors as it has copies (w).  Links are counted piece by piece and never held together.
    """
    q = block["x"].astype(np.float32)
    audit = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    truth = (q[audit] @ graph.x.T) >= cosine - SLACK
    while True:
        got, n, joined, edges = np.zeros(truth.shape, bool), np.zeros(len(q), np.int64), Joined(len(graph.x) + len(q)), []
        for rows, nodes in graph.within(q, cosine - SLACK, beam):
            at = np.searchsorted(audit, rows).clip(0, len(audit) - 1)
            mine = audit[at] == rows
            got[at[mine], nodes[mine]] = True
            for i in range(0, len(rows), 1 << 17):
                r, c = rows[i : i + (1 << 17)], nodes[i : i + (1 << 17)]
                sure = np.einsum("bd,bd->b", block["x"][r], own["x"][c]) >= cosine
                sure &= (block["id"][r] != own["id"][c]) & (block["size"][r] == own["size"][c])
                r, c = r[sure], c[sure]
                np.add.at(n, r, own["w"][c])
                new = joined.add(len(graph.x) + r, c)
                edges.append(np.stack([r[new], c[new]]))
        if (got & truth).sum() >= RECALL * truth.sum() or beam >= len(graph.x):
            break
        beam *= 2
    row, node = np.concatenate([np.zeros((2, 0), np.int64), *edges], axis=1)
    return n, row, node, beam


def good_vectors(vectors: DataFrame) -> DataFrame:
    """id, v, h for the vectors that can have links: one row per id, as doubles, with a hash."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.col("vec_id").isNotNull() & F.exists(x, lambda v: v != 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return cut(vectors.where(good).select(F.col("vec_id").cast("long").alias("id"), x.alias("v")).groupBy("id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v")))


def embedding_links(rows: DataFrame, cosine: float = COSINE, shards: int | None = None) -> DataFrame:
    """(a, b, n): n links of vector a found in a shard (b null), and edges a - b that join linked vectors (n null).

    rows: id, v, w: distinct vectors and how many copies each stands for.
    """
    count, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).collect()[0]
    # Doubles and floats of a vector, and its neighbours.
    shards = shards or max(SHARDS, -(-count // SHARD), -(-count * (12 * width + 12 * LINKS + 32) // BYTES))
    blocks, split = max(1, -(-count // QUERIES)), max(1, -(-count // SPLIT))

    def build(table: pa.Table) -> pa.Table:
        order = table.sort_by("id").combine_chunks()
        v, size = matrix(order.column("v").chunk(0), width)
        ids, v = order.column("id").to_numpy(), unit(v)
        graph = Graph(v, level_of(ids)).build()
        blob = save(id=ids, x=v, size=size, w=order.column("w").to_numpy(), levels=graph.levels, entry=np.array(graph.entry), **{f"near{k}": n for k, n in enumerate(graph.near)})
        return pa.table({"shard": table.column("shard").slice(0, 1), "blob": pa.array([blob], pa.binary())})

    def block(table: pa.Table) -> pa.Table:
        order = table.sort_by("id").combine_chunks()
        v, size = matrix(order.column("v").chunk(0), width)
        return pa.table({"block": table.column("block").slice(0, 1), "blob": pa.array([save(id=order.column("id").to_numpy(), x=unit(v), size=size)], pa.binary())})

    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    graphs = cut(rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard").applyInArrow(build, "shard long, blob binary"))
    packed = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))).groupBy("block").applyInArrow(block, "block long, blob binary")
    sides = graphs.select("shard", spread(split, "part"), F.lit(-1).cast("long").alias("block"), "blob")
    asked = packed.select(spread(shards, "shard"), F.pmod("block", F.lit(split)).cast("int").alias("part"), "block", "blob")
    meeting = sides.unionByName(asked.withColumn("shard", F.col("shard").cast("long"))).repartition(4 * shards * split, "shard", "part").sortWithinPartitions("shard", "part", "block")

    def ask(batches):
        graph, own, beam = None, None, BEAM
        for batch in batches:
            for number, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                got = dict(np.load(io.BytesIO(blob.as_py())))
                if number < 0:
                    own, beam = got, BEAM
                    graph = Graph(got["x"], got["levels"])
                    graph.entry, graph.near = int(got["entry"]), [got[f"near{k}"] for k in range(graph.top + 1)]
                    continue
                n, row, node, beam = links_of(graph, own, got, cosine, beam)
                has = np.flatnonzero(n)
                a = np.concatenate([got["id"][has], got["id"][row]]).astype(np.int64)
                blank = np.arange(len(a)) < len(has)
                b = np.concatenate([np.zeros(len(has), np.int64), own["id"][node]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=blank), pa.array(np.concatenate([n[has], np.zeros(len(row), np.int64)]), mask=~blank)], names=["a", "b", "n"])

    return meeting.mapInArrow(tidy(ask), "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, shards: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    Copies of a vector are one vector in the search, so a group of them costs
    no more than one; each has the others as links besides.  Every shard's graph is asked for every vector; beams widen while they hold
    links only, and for all queries until an audit against brute force finds
    99 % of a block's links.  Links are confirmed in double precision.  Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do
    those of different lengths with each other.  Rows of equal vec_id are one
    vector (the least of their embeddings); a null vec_id has no links, component null
    and kept null.  Other columns are not read.
    """
    rows = good_vectors(vectors)
    classes = cut(rows.groupBy("h", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")))
    found = cut(embedding_links(classes.drop("h"), cosine, shards))
    counts = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    joined = connected_components(found.where("n is null").select("a", "b"))
    classed = classes.select("id", "w").join(counts, "id", "left").join(joined, "id", "left")
    classed = cut(classed.select("id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")).where("n_links > 0"))
    copies = rows.join(classes.where("w > 1").withColumnRenamed("id", "of"), ["h", "v"]).where("id <> of").select("id", "of")
    every = classed.unionByName(copies.join(classed.withColumnRenamed("id", "of"), "of").select("id", "n_links", "component"))
    key = F.col("vec_id").cast("long")
    out = vectors.select("vec_id").join(every, key == every.id, "left")
    component = F.coalesce("component", key)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (key == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


#: All pairs, for small tables.
SQL = f"""
WITH x AS MATERIALIZED (SELECT vec_id, min(v) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
       WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0 GROUP BY vec_id),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.vec_id <> b.vec_id
       AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= {COSINE}::DOUBLE ELSE FALSE END),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r AS (WITH RECURSIVE r(id, seen) AS (SELECT vec_id, vec_id FROM x UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.id WHERE r.seen < e.b) SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(r.component_id, vec_id) AS component_id, vec_id = coalesce(r.component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN r ON r.id = vec_id
"""
