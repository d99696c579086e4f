r"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors are one node, which keeps the smallest ids that carry it. Nodes are dealt to shards of at most about
32,768 by a hash; each shard builds its graph alone: from random edges, greedy beam searches propose every node's
neighbours, pruning keeps those that no kept neighbour is much nearer to, and reverse edges are added, and pruned where
a node has too many. Queries come in blocks; each block's beam search runs on every shard, and the best of all shards
are the answer, with distances computed in double precision on the original vectors.

Vectors that are null, zero, of another length than most of the first, or with null or non-finite components take no
part, neither as queries nor as candidates. Null ids take no part. Rows that repeat an id and vector are one
candidate; an id with several vectors stands once per vector. Ties go to the smaller id. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, materialize, table

#: Nodes of a shard, out-degree, beam while building and while searching, slack of the pruning, queries in a block.
SHARD, DEGREE, BUILD_BEAM, SEARCH_BEAM, SLACK, QUERY_BLOCK = 1 << 15, 32, 64, 128, 1.2, 256
#: Times that every node of a graph is searched for and linked anew.
PASSES = 1


def squared(x: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances from each row of `to` to the nodes in its row of `ids`."""
    d = x[ids] - to[:, None, :]
    return np.einsum("nkd,nkd->nk", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries at once: their `beam` best nodes (-1: fewer found) and squared distances."""
    n, q = len(x), len(queries)
    seen = np.zeros((q, n), bool)
    row = np.arange(q)
    ids = np.full((q, beam), -1)
    dist = np.full((q, beam), np.inf)
    start = np.unique(entry)[:beam]
    ids[:, : len(start)] = start
    dist[:, : len(start)] = squared(x, np.broadcast_to(start, (q, len(start))), queries)
    seen[:, start] = True
    order = np.argsort(dist, 1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    done = ids < 0
    live = row
    while len(live):
        open_ = ~done[live]
        live = live[open_.any(1)]
        if not len(live):
            break
        at = (~done[live]).argmax(1)
        done[live, at] = True
        near = graph[ids[live, at]]
        r = live[:, None]
        fresh = (near >= 0) & ~seen[r, near]
        seen[np.broadcast_to(r, near.shape)[fresh], near[fresh]] = True
        d = np.where(fresh, squared(x, near, queries[live]), np.inf)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_d = np.concatenate([dist[live], d], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :beam]
        ids[live], dist[live], done[live] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_d, all_done))
    return ids, dist


def robust_prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """For each node its diverse nearest candidates: one falls out once a kept one is `slack` times nearer to it."""
    n = len(of)
    d = np.where((candidates >= 0) & (candidates != of[:, None]), squared(x, candidates, x[of]), np.inf)
    order = np.argsort(d, 1, kind="stable")
    c, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    same = np.zeros_like(c, bool)
    by_id = np.argsort(c, 1, kind="stable")
    again = np.take_along_axis(c, by_id, 1)
    twice = np.zeros_like(again, bool)
    twice[:, 1:] = again[:, 1:] == again[:, :-1]
    np.put_along_axis(same, by_id, twice, 1)
    alive = np.isfinite(d) & ~same
    out = np.full((n, degree), -1)
    vectors = x[c]
    rows = np.arange(n)
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        pick = alive.argmax(1)
        chosen = np.where(has, c[rows, pick], -1)
        out[:, k] = chosen
        gap = vectors - x[np.maximum(chosen, 0)][:, None, :]
        alive &= ~(has[:, None] & (slack * slack * np.einsum("nkd,nkd->nk", gap, gap) <= d))
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, slack: float = SLACK, passes: int = PASSES, seed: int = 3, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(out-edges, -1 padded; entry nodes) of one shard.

    Nodes may have half as many edges again while the graph grows; who has more is pruned.
    """
    rng = np.random.default_rng(seed)
    n, room = len(x), degree + degree // 2
    graph = np.full((n, room), -1)
    if n > 1:
        graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
        graph[graph == np.arange(n)[:, None]] = -1
    center = ((x - x.mean(0)) ** 2).sum(1).argmin() if n else 0
    entry = np.unique(np.concatenate([[center], rng.choice(n, min(n, 8), replace=False)])) if n else np.array([], int)

    def pruned(of: np.ndarray, candidates: np.ndarray) -> None:
        for k in range(0, len(of), 2 * batch):
            some = of[k : k + 2 * batch]
            graph[some, :degree] = robust_prune(x, some, candidates[k : k + 2 * batch], degree, slack)
            graph[some, degree:] = -1

    for some in (s for _ in range(passes) for s in np.array_split(rng.permutation(n), max(1, -(-n // batch)))):
        found, _ = beam_search(x, graph, entry, x[some], beam)
        pruned(some, np.concatenate([found, graph[some]], 1))
        # reverse edges go to free places; nodes without any are pruned anew
        heads, ends = np.repeat(some, degree), graph[some, :degree].ravel()
        heads, ends = heads[ends >= 0], ends[ends >= 0]
        known = (graph[ends] == heads[:, None]).any(1)
        heads, ends = heads[~known], ends[~known]
        order = np.argsort(ends, kind="stable")
        nodes, first, count = np.unique(ends[order], return_index=True, return_counts=True)
        slot = np.arange(len(ends)) - np.repeat(first, count)
        back = np.full((len(nodes), int(count.max()) if len(nodes) else 0), -1)
        back[np.repeat(np.arange(len(nodes)), count), slot] = heads[order]
        held = (graph[nodes] >= 0).sum(1)
        fits = held + count <= room
        packed = np.sort(np.concatenate([graph[nodes[fits]], back[fits]], 1), 1)[:, ::-1][:, :room]
        graph[nodes[fits]] = packed
        pruned(nodes[~fits], np.concatenate([graph[nodes[~fits]], back[~fits]], 1))
    over = np.flatnonzero((graph >= 0).sum(1) > degree)
    pruned(over, graph[over])
    return np.sort(graph, 1)[:, ::-1][:, :degree], entry


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(~bad & F.exists("vector", lambda x: x != 0))


def build_index(vectors: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """(shard, dim, ids, vectors, graph, entry) of every shard, as bytes; ids hold each node's k + 1 smallest, -1 padded."""
    # a vector's ids: only its k + 1 smallest can be among k nearest of a query, itself left out
    numbered = vectors.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    some = numbered.groupBy("vector", "salt").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    nodes = some.groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    nodes = materialize(nodes.select("vector", "ids", F.size("vector").alias("dim"), F.xxhash64("vector").alias("hash")), "search-nodes")
    shards = {r["dim"]: max(1, -(-r["count"] // shard)) for r in nodes.groupBy("dim").count().collect()}  # one row per dimension
    if not shards:
        return nodes.select(F.lit(0).alias("shard"), "dim", *[F.lit(b"").alias(c) for c in ("ids", "vectors", "graph", "entry")])
    pieces = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in shards.items()])
    dealt = nodes.withColumn("shard", F.pmod(F.col("hash"), pieces).cast("int")).select("shard", "dim", "vector", "ids")

    def build(group: pa.Table) -> pa.Table:
        x = np.array(group["vector"].to_pylist(), float).reshape(group.num_rows, -1)
        ids = np.full((len(x), k + 1), -1, np.int64)
        for row, own in zip(ids, group["ids"].to_pylist(), strict=True):
            row[: len(own)] = own
        graph, entry = build_graph(x.astype(np.float32))
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "ids": [ids.tobytes()], "vectors": [x.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entry": [entry.astype(np.int32).tobytes()]})

    return dealt.groupBy("dim", "shard").applyInArrow(build, "shard int, dim int, ids binary, vectors binary, graph binary, entry binary")


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest other vectors; queries: vec_id, vector."""
    n_blocks = max(1, -(-queries.count() // block))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).withColumn("dim", F.size("vector"))
    blocks = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    # the stated query set, in blocks, against every shard of its dimension: blocks are dealt to shards, which stay where they are
    shards = {r["dim"]: r["n"] for r in index.groupBy("dim").agg((F.max("shard") + 1).alias("n")).collect()}  # one row per dimension
    last = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n - 1)) for d, n in shards.items()], F.lit(-1))
    dealt = blocks.where(last >= 0).withColumn("shard", F.explode(F.sequence(F.lit(0), last)))
    work = index.join(dealt, ["dim", "shard"]).select("dim", "ids", "vectors", "graph", "entry", "queries")

    def run(batches):
        for batch in batches:
            for dim, ids, vectors, graph, entry, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(vectors, float).reshape(-1, dim)
                names = np.frombuffer(ids, np.int64).reshape(len(x), -1)
                edges = np.frombuffer(graph, np.int32).reshape(len(x), -1).astype(np.int64)
                q_ids = np.array([a["vec_id"] for a in asked], np.int64)
                q = np.array([a["vector"] for a in asked], float)
                found, _ = beam_search(x.astype(np.float32), edges, np.frombuffer(entry, np.int32).astype(np.int64), q.astype(np.float32), max(beam, k + 1))
                dist = np.where(found >= 0, squared(x, found, q), np.inf)  # graphs are walked in single precision, answers told in double
                who = np.where(found[:, :, None] >= 0, names[found], -1)
                score = np.broadcast_to(np.sqrt(dist)[:, :, None], who.shape)
                who, score = who.reshape(len(q), -1), score.reshape(len(q), -1)
                score = np.where((who < 0) | (who == q_ids[:, None]), np.inf, score)
                order = np.lexsort((who, score))[:, :k]
                who, score = np.take_along_axis(who, order, 1), np.take_along_axis(score, order, 1)
                ok = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids[:, None], who.shape)[ok]), pa.array(who[ok]), pa.array(score[ok])], names=["query_id", "vec_id", "score"])

    best = arrow_map(work, run, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = materialize(build_index(vectors, k=10), "search-index")
    return search(index, vectors.where("vec_id % 100 = 0").distinct(), k=10)


QUERIES = {"op9_nearest_neighbours": op9_nearest_neighbours}
SQL: dict[str, str] = {}
