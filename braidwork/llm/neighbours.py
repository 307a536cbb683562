"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Build: the vectors of a shard are inserted in growing batches. A greedy beam search over the graph so far proposes
neighbours; pruning keeps the nearest one and drops those that it is nearer to than the new vector by the factor
ALPHA, and so on, which leaves diverse edges; each new edge is also offered in the other direction.
Query: every query runs a beam search in each shard; the nearest of what all shards return, measured exactly in
double precision on the original vectors, are its result.

Shards hold about SHARD distinct vectors, so their number grows with the data and their size does not. Queries are
taken to the shards in blocks. Equal vectors are one node with their K + 1 smallest ids, which is all that any query
can ask of them, so a vector that a third of all rows hold stays one node.

Edge cases: vectors that are null, zero, empty or that hold null or non-finite components take no part; vectors are
compared with those of their own length only; rows with a null id take no part; repeated rows count once; a query has
fewer than K rows if there are fewer candidates; ties go to the smaller id; an empty table gives an empty result; other
columns may have any name and are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import stored

K = 10
#: Distinct vectors of a shard, edges of a node, beam of the build and of the queries, pruning factor.
SHARD, DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA = 12_000, 32, 64, 96, 1.2
#: Queries of a block.
BLOCK = 512
_BATCH = 256


def _distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from each q to its own row of ids (-1: infinity)."""
    d = norms[ids] + (q * q).sum(axis=1)[:, None] - 2 * np.einsum("bd,bkd->bk", q, x[ids])
    d[ids < 0] = np.inf
    return d


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the beam nodes nearest to each q that greedy search reaches, nearest first.

    All searches advance together: each step expands the nearest node of every beam that is not yet expanded."""
    n = len(q)
    ids = np.full((n, beam), -1, np.int32)
    ids[:, 0] = entry
    dist = np.full((n, beam), np.inf, np.float32)
    dist[:, 0] = _distances(x, norms, q, ids[:, :1])[:, 0]
    done = np.ones((n, beam), bool)
    done[:, 0] = False
    active = np.arange(n)
    while len(active):
        a_ids, a_dist, a_done = ids[active], dist[active], done[active]
        pick = np.argmax(~a_done, axis=1)
        rows = np.arange(len(active))
        a_done[rows, pick] = True
        near = graph[a_ids[rows, pick]]
        known = (near[:, :, None] == a_ids[:, None, :]).any(axis=2) | (near < 0)
        near = np.where(known, -1, near)
        d = _distances(x, norms, q[active], near)
        all_ids, all_dist, all_done = np.concatenate([a_ids, near], 1), np.concatenate([a_dist, d], 1), np.concatenate([a_done, near < 0], 1)
        order = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        part = np.take_along_axis(all_dist, order, 1)
        order = np.take_along_axis(order, np.argsort(part, axis=1, kind="stable"), 1)
        ids[active], dist[active], done[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_dist, order, 1), np.take_along_axis(all_done, order, 1) | ~np.isfinite(np.take_along_axis(all_dist, order, 1))
        active = active[~done[active].all(axis=1)]
    return ids, dist


def prune(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each row of candidates (-1: none) with squared distances dist to its node."""
    n, c = ids.shape
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    v, own = x[ids], norms[ids]
    between = own[:, :, None] + own[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = np.isfinite(dist) & (ids >= 0)
    alive[:, 1:] &= ~((ids[:, 1:] == ids[:, :-1]) & (dist[:, 1:] == dist[:, :-1]))
    kept = np.full((n, degree), -1, np.int32)
    rows = np.arange(n)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        best = np.argmax(alive, axis=1)
        kept[some, k] = ids[rows[some], best[some]]
        alive[rows, best] = False
        alive &= (alpha * alpha * between[rows, best] > dist) & (ids != ids[rows, best][:, None])
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Neighbour lists (-1: none) and the entry node, the one nearest to the mean. Rows of x are in random order."""
    n = len(x)
    norms = (x * x).sum(axis=1)
    graph = np.full((n, degree), -1, np.int32)
    entry = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.concatenate([[entry], np.delete(np.arange(n), entry)]).astype(np.int32)
    at = 1
    while at < n:
        batch = order[at : at + min(_BATCH, max(1, at))]
        at += len(batch)
        ids, dist = beam_search(x, norms, graph, entry, x[batch], beam)
        graph[batch] = prune(x, norms, ids, dist, degree, alpha)
        source = np.repeat(batch, degree)
        target = graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        new = np.full((len(nodes), int(counts.max(initial=0))), -1, np.int32)
        new[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        both = np.concatenate([graph[nodes], new], axis=1)
        full = (both >= 0).sum(axis=1) > degree
        if (~full).any():
            room = np.argsort(both[~full] < 0, axis=1, kind="stable")[:, :degree]
            graph[nodes[~full]] = np.take_along_axis(both[~full], room, 1)
        if full.any():
            graph[nodes[full]] = prune(x, norms, both[full], _distances(x, norms, x[nodes[full]], both[full]), degree, alpha)
    return graph, entry


def _matrix(lists: pd.Series) -> np.ndarray:
    return np.stack(lists.to_numpy())


def _index_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("node")
    exact = _matrix(rows["vector"])
    graph, entry = build_graph(exact.astype(np.float32))
    first = rows.iloc[:1]
    return pd.DataFrame({"dim": first["dim"], "shard": first["shard"], "entry": [entry], "nodes": [rows["node"].to_numpy(np.int64).tobytes()], "vectors": [exact.tobytes()], "graph": [graph.tobytes()]})


def _search_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's index and one block of queries: the nodes found for each query, with exact distances."""
    r = rows.iloc[0]
    exact = np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"])
    x, graph = exact.astype(np.float32), np.frombuffer(r["graph"], np.int32).reshape(len(exact), -1)
    q = np.asarray(r["q_vectors"], np.float64).reshape(-1, r["dim"])
    ids, _ = beam_search(x, (x * x).sum(axis=1), graph, int(r["entry"]), q.astype(np.float32), QUERY_BEAM)
    top = ids[:, : 2 * K + 2]
    query, _ = np.nonzero(top >= 0)
    found = top[top >= 0]
    d = np.sqrt(((q[query] - exact[found]) ** 2).sum(axis=1))
    return pd.DataFrame({"q_node": np.asarray(r["q_nodes"], np.int64)[query], "node": np.frombuffer(r["nodes"], np.int64)[found], "score": d})


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k rows nearest to each row that is_query marks."""
    if k > K:
        raise ValueError(f"the shards return candidates for at most {K} neighbours")
    v = F.transform(vector_column, lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.alias("vector"), is_query.alias("is_query")).where(usable(F.col("vector")))
    # -0.0 and 0.0 are equal components, so they must hash alike
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).withColumn("node", F.xxhash64("vector"))
    rows = stored(rows, "vectors")
    small = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    ids = rows.select("node", "id").distinct().withColumn("r", small).where(F.col("r") <= k + 1).select("node", "id")
    distinct = rows.groupBy("node").agg(F.first("vector").alias("vector"))
    distinct = stored(distinct.withColumn("dim", F.size("vector")), "distinct")
    shards = stored(distinct.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards")), "shards")
    sharded = distinct.join(shards, "dim").select("dim", F.pmod(F.xxhash64("node", F.lit(3)), "shards").alias("shard"), "node", "vector")
    schema = "dim int, shard long, entry int, nodes binary, vectors binary, graph binary"
    index = stored(sharded.groupBy("dim", "shard").applyInPandas(_index_shard, schema), "graphs")

    asked = stored(rows.where("is_query").select("node", F.col("id").alias("query_id")).distinct(), "queries")
    asking = distinct.join(asked.select("node").distinct(), "node")
    sizes = asking.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    blocked = asking.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").alias("block"), "node", "vector")
    blocks = blocked.groupBy("dim", "block").agg(F.collect_list(F.struct("node", "vector")).alias("q"))
    blocks = blocks.select("dim", "block", F.col("q.node").alias("q_nodes"), F.flatten("q.vector").alias("q_vectors"))
    # every block goes to every shard; a task is one block in one shard
    tasks = index.select("dim", "shard").join(sizes, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = tasks.join(blocks, ["dim", "block"]).join(index, ["dim", "shard"])
    found = tasks.groupBy("dim", "shard", "block").applyInPandas(_search_shard, "q_node long, node long, score double")
    # k + 1 nodes hold the query's own and k others, and ties of the last one count too
    kept = found.withColumn("r", F.rank().over(Window.partitionBy("q_node").orderBy("score"))).where(F.col("r") <= k + 1).drop("r")
    pairs = kept.join(asked.withColumnRenamed("node", "q_node"), "q_node").join(ids, "node").where("id <> query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return pairs.groupBy("query_id", "id").agg(F.min("score").alias("score")).withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
