"""Approximate nearest neighbours by robust-pruned directed graphs.

Different vectors are dealt to shards of like norm and bounded size. Each shard
has one graph: greedy beam searches over the graph so far propose a point's
neighbours, and relaxed distance pruning keeps the near ones that no nearer one
stands in for. Every shard is searched for each query and the best of all are
ranked by the exact inner product. A shard of few points is looked through.

Largest inner product is nearest distance once every vector has one more
coordinate that brings all to the shard's largest norm; the graph is built there.
Norms of a shard differ by BAND at most, so that coordinate outweighs no other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.common import load, stored

#: Most different vectors of a shard, about, and of one that is looked through in place of a graph.
SHARD_VECTORS, SCAN_VECTORS = 8192, 1024
#: Largest ratio of the norms of one graph.
BAND = 1.25
#: Edges that pruning leaves, edges that a point may gather before it is pruned again, beam widths, and the pruning's slack.
DEGREE, SLACK, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 48, 64, 160, 1.2
QUERY_BLOCK = 4096
BATCH = 512


def beam_search(graph: np.ndarray, vectors: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest points that a beam search from ``entry`` finds for each query, nearest first (-1 pads), and their keys.

    Nearness is |x|^2 - 2 x.q: the squared distance but for the query's own norm.
    All queries step together, each expanding its nearest point not yet expanded.
    """
    n = len(queries)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    ids = np.full((n, width), -1, np.int32)
    keys = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), bool)
    seen = np.zeros((n, len(vectors)), bool)
    seen[:, entry] = True
    ids[:, 0], keys[:, 0], done[:, 0] = entry, norms[entry] - 2 * queries @ vectors[entry], False
    live = np.arange(n)
    while len(live):
        at = (~done[live]).argmax(axis=1)
        nodes = ids[live, at]
        done[live, at] = True
        near = graph[nodes]
        safe = np.where(near >= 0, near, 0)
        fresh = (near >= 0) & ~seen[live[:, None], safe]
        safe = np.where(fresh, near, 0)
        rows, columns = np.nonzero(fresh)
        seen[live[rows], near[rows, columns]] = True
        key = norms[safe] - 2 * np.einsum("arc,ac->ar", vectors[safe], queries[live])
        key = np.where(fresh, key, np.inf).astype(np.float32)
        all_ids = np.concatenate((ids[live], np.where(fresh, near, -1)), axis=1)
        all_keys = np.concatenate((keys[live], key), axis=1)
        all_done = np.concatenate((done[live], ~fresh), axis=1)
        order = np.argsort(all_keys, axis=1, kind="stable")[:, :width]
        ids[live] = np.take_along_axis(all_ids, order, 1)
        keys[live] = np.take_along_axis(all_keys, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)
        live = live[~done[live].all(axis=1)]
    return ids, keys


def robust_prune(points: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point up to ``degree`` of its candidates (-1 pads): the nearest, then the nearest that none kept is alpha times nearer to, and so on."""
    own = candidates == points[:, None]
    safe = np.where((candidates < 0) | own, 0, candidates)
    x = vectors[safe]
    gap = ((x - vectors[points][:, None, :]) ** 2).sum(axis=2)
    gap[(candidates < 0) | own] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")
    gap, safe = np.take_along_axis(gap, order, 1), np.take_along_axis(safe, order, 1)
    x = np.take_along_axis(x, order[:, :, None], 1)
    square = np.einsum("pcd,pcd->pc", x, x)
    # a candidate named twice counts once
    alive = np.isfinite(gap)
    by = np.argsort(safe, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(safe, by, 1)
    again = np.zeros_like(alive)
    np.put_along_axis(again, by[:, 1:], (sorted_ids[:, 1:] == sorted_ids[:, :-1]) & np.isfinite(np.take_along_axis(gap, by, 1)[:, :-1]), 1)
    alive &= ~again
    out = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, k] = safe[rows, first][some]
        picked = x[rows, first]
        between = square + (picked**2).sum(axis=1)[:, None] - 2 * np.einsum("pcd,pd->pc", x, picked)
        alive &= ~((alpha * alpha * between <= gap) & some[:, None])
        alive[rows, first] = False
    return out


def build(vectors: np.ndarray, seed: int = 5) -> tuple[np.ndarray, int]:
    """The graph (points x SLACK neighbours, -1 pads) and its entry, the point nearest the mean.

    Points join in batches that double: each batch searches the graph of those
    before it, is pruned, and is linked back.
    """
    n = len(vectors)
    entry = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    graph = np.full((n, SLACK), -1, np.int32)
    counts = np.zeros(n, np.int64)
    start = 1
    while start < n:
        batch = order[start : start + min(start, BATCH)]
        found, _ = beam_search(graph, vectors, entry, vectors[batch], BUILD_BEAM)
        # points of one batch don't see each other in the graph; as candidates they do
        if len(batch) > 1:
            gaps = (vectors[batch] ** 2).sum(axis=1)[None, :] - 2 * vectors[batch] @ vectors[batch].T
            np.fill_diagonal(gaps, np.inf)
            m = min(16, len(batch) - 1)
            found = np.concatenate((found, batch[np.argpartition(gaps, m - 1, axis=1)[:, :m]].astype(np.int32)), axis=1)
        chosen = robust_prune(batch, found, vectors, DEGREE, ALPHA)
        graph[batch, :DEGREE] = chosen
        counts[batch] = (chosen >= 0).sum(axis=1)
        _link_back(graph, counts, batch, chosen, vectors)
        start += len(batch)
    return graph, entry


def _link_back(graph: np.ndarray, counts: np.ndarray, batch: np.ndarray, chosen: np.ndarray, vectors: np.ndarray) -> None:
    source = np.repeat(batch, (chosen >= 0).sum(axis=1))
    target = chosen[chosen >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    nodes, first, many = np.unique(target, return_index=True, return_counts=True)
    full = counts[nodes] + many > SLACK
    for i in np.flatnonzero(~full):
        v, new = nodes[i], source[first[i] : first[i] + many[i]]
        new = new[~np.isin(new, graph[v, : counts[v]])]
        graph[v, counts[v] : counts[v] + len(new)] = new
        counts[v] += len(new)
    over = np.flatnonzero(full)
    # a much-linked point's candidates come in rounds, so arrays stay small
    for i in over:
        v, new = nodes[i], source[first[i] : first[i] + many[i]]
        pool = np.concatenate((graph[v, : counts[v]], new))
        kept = robust_prune(np.array([v]), pool[None, :].astype(np.int32), vectors, DEGREE, ALPHA)[0]
        kept = kept[kept >= 0]
        graph[v] = -1
        graph[v, : len(kept)] = kept
        counts[v] = len(kept)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all norms are the largest one's."""
    square = (vectors.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate((vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]), axis=1).astype(np.float32)


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with an id whose vector and all its components are there and finite, and not all zero."""
    x = F.col(column)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())


def shards_of(bands: dict[int, int], shard_vectors: int, scan: int = SCAN_VECTORS) -> list[tuple[int, int, int]]:
    """(band, first shard, shards) for bands of norms and their numbers of points.

    Bands next to each other that have ``scan`` points together are one shard, which is looked through.
    """
    out, shard, open_points = [], 0, 0
    for band in sorted(bands, reverse=True):
        n = bands[band]
        if open_points and open_points + n > scan:
            shard, open_points = shard + 1, 0
        if n > scan:
            parts = -(-n // shard_vectors)
            out.append((band, shard, parts))
            shard += parts
        else:
            out.append((band, shard, 1))
            open_points += n
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k largest inner products found, ties to the smaller vec_id.

    ``vectors`` and ``queries`` have vec_id and embedding (array<float>); further
    columns are ignored. A row of the query's own vec_id is no candidate. Vectors
    that are null, zero, or have null or non-finite components take no part, and
    none, query or candidate, of another length than most vectors (the least of
    several lengths). Rows that repeat vec_id and vector count once. Any finite
    components will do. With k candidates or fewer all come back. Empty tables
    give no rows.

    Equal vectors are one point of the graph with their k + 1 smallest ids: no
    other of them can be among k results, the query's own excluded.
    """
    spark = vectors.sparkSession
    size = F.size("embedding")
    good = valid(vectors.select("vec_id", "embedding"))
    lengths = good.groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    length = lengths[0]["d"] if lengths else 0
    good = good.where(size == length)
    ranked = good.dropDuplicates(["vec_id", "embedding"]).withColumn("r", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(f"r <= {k + 1}")
    square = F.aggregate("embedding", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    band = F.floor(F.log(square) / (2 * np.log(BAND))).cast("int").alias("band")
    points = stored(ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("embedding", "ids", band), "points")
    # a float's norm is in one of about a thousand bands
    bands = {r["band"]: r["count"] for r in points.groupBy("band").count().collect()}
    plan = shards_of(bands, shard_vectors)
    shards = plan[-1][1] + plan[-1][2] if plan else 1

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        x = np.array(pdf["embedding"].tolist(), np.float32)
        graph, entry = build(lifted(unit(x))) if len(x) > SCAN_VECTORS else (np.zeros((0, SLACK), np.int32), 0)
        sizes = np.array([len(i) for i in pdf["ids"]], np.int64)
        ids = np.concatenate([np.asarray(i, np.int64) for i in pdf["ids"]])
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "entry": [entry], "d": [x.shape[1]], "vectors": [x.tobytes()], "graph": [graph.tobytes()], "sizes": [sizes.tobytes()], "ids": [ids.tobytes()]})

    of = F.broadcast(spark.createDataFrame(plan, "band int, base int, parts int"))  # a row a band
    dealt = points.withColumn("first", F.col("ids")[0]).join(of, "band").withColumn("shard", F.col("base") + F.pmod(F.xxhash64("first"), F.col("parts")).cast("int"))
    graphs = stored(dealt.select("embedding", "ids", "first", "shard").repartition(shards, "shard").groupBy("shard").applyInPandas(index, "shard int, entry int, d int, vectors binary, graph binary, sizes binary, ids binary"), "graphs")
    asked = valid(queries.select("vec_id", "embedding")).where(size == length).dropDuplicates(["vec_id", "embedding"])
    asked = stored(asked.select(F.col("vec_id").alias("query_id"), "embedding"), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    left = asked.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        if len(asked) and len(index):
            g = index.iloc[0]
            x = np.frombuffer(g["vectors"], np.float32).reshape(-1, g["d"])
            graph = np.frombuffer(g["graph"], np.int32).reshape(-1, SLACK)
            sizes, ids = np.frombuffer(g["sizes"], np.int64), np.frombuffer(g["ids"], np.int64)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            exact, up = x.astype(np.float64), lifted(unit(x)) if len(graph) else None
            q = np.array(asked["embedding"].tolist(), np.float32)
            number = asked["query_id"].to_numpy()
            for a in range(0, len(q), BATCH):
                part = q[a : a + BATCH]
                if up is not None:
                    way = unit(part, each=True)
                    found, _ = beam_search(graph, up, int(g["entry"]), np.concatenate((way, np.zeros((len(way), 1), np.float32)), axis=1), SEARCH_BEAM)
                else:
                    found = looked_through(exact, part.astype(np.float64), k + 1)
                for own, query, row in zip(number[a : a + BATCH], part.astype(np.float64), found, strict=True):
                    row = row[row >= 0]
                    score = np.repeat(exact[row] @ query, sizes[row])
                    names = np.concatenate([ids[begin[i] : begin[i + 1]] for i in row])
                    names, score = names[names != own], score[names != own]
                    best = np.lexsort((names, -score))[:k]
                    out[0].append(np.full(len(best), own))
                    out[1].append(names[best])
                    out[2].append(score[best])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pd.DataFrame({"query_id": join(out[0], np.int64), "vec_id": join(out[1], np.int64), "score": join(out[2], np.float64)})

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def unit(vectors: np.ndarray, each: bool = False) -> np.ndarray:
    """Vectors over the largest one's norm, or each over its own: no square of theirs is too large or too small for single precision."""
    x = vectors.astype(np.float64)
    norms = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return (x / (norms if each else norms.max())).astype(np.float32)


def looked_through(points: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the points of the k largest inner products and all that tie with the last."""
    scores = queries @ points.T
    if scores.shape[1] <= k:
        return [np.arange(scores.shape[1])] * len(queries)
    last = np.partition(scores, -k, axis=1)[:, -k]
    return [np.flatnonzero(row >= least) for row, least in zip(scores, last, strict=True)]


def op2_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found of every row of embeddings whose vec_id is divisible by 20, among all other rows."""
    vectors = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
