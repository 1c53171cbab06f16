"""Approximate nearest neighbours with robust-pruned directed graphs.

Vectors are dealt to shards of bounded size. In each shard a graph is built
in batches: a greedy beam search from the medoid proposes neighbours, and
robust pruning keeps those that are not much closer to a neighbour already
kept than to the point itself, so edges stay few and point in all
directions. A query runs a beam search in every shard of its dimension; the
exact distances of what all searches found are merged.

Equal vectors are one node, so groups of copies cost nothing in the graph;
their ids are joined on at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import importable, staged

#: Nodes that a shard has about; edges of a node; beam while building and while searching; slack of the pruning.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 10_000, 28, 56, 128, 1.2
#: Queries that move together.
TOGETHER = 512


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of a to its own rows of b (n x d to n x k x d)."""
    return np.maximum((a * a).sum(-1)[:, None] + (b * b).sum(-1) - 2 * np.einsum("nd,nkd->nk", a, b), 0)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers (-1: none) and squared distances of the nodes found for each query, nearest first; all queries move together."""
    n, width = len(queries), beam + edges.shape[1]
    nodes, far = np.full((n, width), -1), np.full((n, width), np.inf)
    nodes[:, 0] = entry
    far[:, 0] = ((queries - points[entry]) ** 2).sum(1)
    done = np.zeros((n, width), bool)
    visited = np.zeros((n, len(points)), bool)
    visited[:, entry] = True
    active = np.arange(n)
    while len(active):
        open_ = ~done[active, :beam] & (nodes[active, :beam] >= 0)
        has = open_.any(1)
        active, first = active[has], open_[has].argmax(1)
        if not len(active):
            break
        done[active, first] = True
        near = edges[nodes[active, first]]
        fresh = near >= 0
        fresh &= ~visited[active[:, None], near]
        rows, cols = np.nonzero(fresh)
        visited[active[rows], near[rows, cols]] = True
        gap = np.full(near.shape, np.inf, points.dtype)
        gap[rows, cols] = ((queries[active[rows]] - points[near[rows, cols]]) ** 2).sum(1)
        nodes[active, beam:] = np.where(fresh, near, -1)
        far[active, beam:] = gap
        done[active, beam:] = False
        order = np.argsort(far[active], axis=1, kind="stable")
        for table in (nodes, far, done):
            table[active] = np.take_along_axis(table[active], order, 1)
    return nodes[:, :beam], far[:, :beam]


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point in ``of``, up to ``degree`` of its candidates (-1: none): nearest first, dropping what a kept one covers."""
    valid = (candidates >= 0) & (candidates != of[:, None])
    vectors = points[np.where(valid, candidates, 0)]
    gap = np.where(valid, squared(points[of], vectors), np.inf)
    order = np.argsort(gap, axis=1, kind="stable")
    candidates, gap, vectors = np.take_along_axis(candidates, order, 1), np.take_along_axis(gap, order, 1), np.take_along_axis(vectors, order[:, :, None], 1)
    same = np.zeros(gap.shape, bool)
    by_name = np.argsort(candidates, axis=1, kind="stable")
    named = np.take_along_axis(candidates, by_name, 1)
    np.put_along_axis(same, by_name[:, 1:], named[:, 1:] == named[:, :-1], 1)  # a candidate named twice
    gap[same] = np.inf
    kept, rows = np.full((len(of), degree), -1), np.arange(len(of))
    for k in range(degree):
        best = gap.argmin(1)
        alive = np.isfinite(gap[rows, best])
        if not alive.any():
            break
        kept[alive, k] = candidates[rows, best][alive]
        covered = alpha**2 * squared(vectors[rows, best], vectors) <= gap
        covered[rows, best] = True
        gap[covered & alive[:, None]] = np.inf
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (-1: none) of each point and the entry point, the one nearest to the mean."""
    n = len(points)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin()) if n else 0
    edges = np.full((n, degree), -1)
    order = np.concatenate([[entry], np.delete(np.random.default_rng(7).permutation(n), np.flatnonzero(np.random.default_rng(7).permutation(n) == entry))])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + min(size, 512)]
        found, _ = beam_search(points, edges, entry, points[batch], beam)
        found = np.hstack([found, np.repeat(batch[None, :64], len(batch), 0)])  # some of the same batch, which the graph doesn't hold yet
        edges[batch] = robust_prune(points, batch, found, degree, alpha)
        sources = np.repeat(batch, degree)
        targets = edges[batch].reshape(-1)
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        by = np.argsort(targets, kind="stable")
        sources, targets = sources[by], targets[by]
        touched, begins = np.unique(targets, return_index=True)
        counts = np.diff(np.append(begins, len(targets)))
        new = np.full((len(touched), int(counts.max(initial=0))), -1)
        new[np.repeat(np.arange(len(touched)), counts), np.arange(len(targets)) - np.repeat(begins, counts)] = sources
        for some in range(0, len(touched), 512):
            part = touched[some : some + 512]
            edges[part] = robust_prune(points, part, np.hstack([edges[part], new[some : some + 512]]), degree, alpha)
        at += len(batch)
        size *= 2
    return with_every_node(points, edges, entry, beam), entry


def reachable(edges: np.ndarray, entry: int) -> np.ndarray:
    """Which nodes a walk from the entry can come to."""
    seen = np.zeros(len(edges), bool)
    seen[[entry] if len(edges) else []] = True
    front = np.flatnonzero(seen)
    while len(front):
        near = np.unique(edges[front])
        front = near[(near >= 0) & ~seen[near]]
        seen[front] = True
    return seen


def with_every_node(points: np.ndarray, edges: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """The edges, and an edge to each node that was out of reach, from the nearest node that a search finds."""
    lost = np.flatnonzero(~reachable(edges, entry))
    for begin in range(0, len(lost), 512):
        part = lost[begin : begin + 512]
        hosts = beam_search(points, edges, entry, points[part], beam)[0][:, 0]
        more = np.full((len(edges), np.unique(hosts, return_counts=True)[1].max()), -1)
        by = np.argsort(hosts, kind="stable")
        at = np.arange(len(part)) - np.searchsorted(hosts[by], hosts[by])
        more[hosts[by], at] = part[by]
        edges = np.hstack([edges, more])
    return edges


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``_id``, ``_v`` (array of float, or of double if it is anything else) and ``_dim`` of vectors with a key that are not null, empty or zero and hold only finite numbers."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast(kind).alias("_v")).withColumn("_dim", F.size("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.col("_dim") > 0) & finite & F.exists("_v", lambda x: x != 0))


def number_type(rows: DataFrame) -> str:
    return "<f4" if rows.schema["_v"].dataType.simpleString() == "array<float>" else "<f8"


def index_vectors(rows: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """The staged index: a row for each shard with ``_dim``, its vectors, node keys, edges and entry."""
    nodes = rows.groupBy("_dim", "_v").agg(F.min("_id").alias("_node"))
    sizes = {x["_dim"]: x["count"] for x in nodes.groupBy("_dim").count().collect()}  # a row for each dimension
    counts = {d: max(1, round(n / shard_size)) for d, n in sizes.items()}
    shards = F.coalesce(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))[F.col("_dim")], F.lit(1)) if counts else F.lit(1)
    kind = number_type(rows)

    def built(key, group):
        group = group.sort_values("_node")
        points = np.stack(group["_v"].to_numpy()).astype(kind)
        edges, entry = build_graph(points)
        return pd.DataFrame([[key[0], key[1], points.tobytes(), group["_node"].to_numpy("<i8").tobytes(), edges.astype("<i4").tobytes(), entry]], columns=["_dim", "_shard", "_points", "_nodes", "_edges", "_entry"])

    dealt = nodes.withColumn("_shard", F.pmod(F.xxhash64("_node"), shards).cast("int"))
    # Building takes far longer than moving: more tasks than shards, so that few shards share one.
    dealt = dealt.repartition(min(4 * sum(counts.values()) + 1, 20_000), "_dim", "_shard")
    return staged(dealt.groupBy("_dim", "_shard").applyInPandas(built, "_dim int, _shard int, _points binary, _nodes binary, _edges binary, _entry int"), "none")


def search(index: DataFrame, queries: DataFrame, found: int, beam: int = BEAM) -> DataFrame:
    """``_query``, ``_node`` and ``_far`` (distance in double precision): the best ``found`` nodes of each shard for each query (_id, _dim, _v).

    The stated queries go to every shard of their dimension. A task reads a
    shard, once, and then its queries, some at a time; so the index moves once
    however many queries there are, and a task holds one shard.
    """
    kind, item = number_type(queries), queries.schema["_v"].dataType.simpleString()

    def searched(batches):
        held = None
        for batch in filter(len, batches):
            keys = np.stack([batch[c].to_numpy() for c in ("_dim", "_shard", "_kind")], 1)
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(keys)).tolist(), strict=True):
                part, (dim, shard, is_query) = batch.slice(a, b - a), keys[a].tolist()
                if not is_query:
                    nodes = np.frombuffer(part["_nodes"][0].as_py(), "<i8")
                    points, edges_ = np.frombuffer(part["_points"][0].as_py(), kind).reshape(len(nodes), -1), np.frombuffer(part["_edges"][0].as_py(), "<i4").reshape(len(nodes), -1).astype(np.int64)
                    held = (dim, shard), nodes, points, edges_, part["_entry"][0].as_py()
                elif held and held[0] == (dim, shard):
                    wanted = part["q_v"].flatten().to_numpy().astype(kind).reshape(len(part), dim)
                    for k in range(0, len(part), TOGETHER):
                        yield answered(part["q_id"].to_numpy()[k : k + TOGETHER], wanted[k : k + TOGETHER], *held[1:])

    def answered(names, wanted, nodes, points, edges, entry):
        at = beam_search(points, edges, entry, wanted, beam)[0]
        real = at >= 0
        far = np.sqrt(((wanted[:, None, :].astype(np.float64) - points[np.where(real, at, 0)].astype(np.float64)) ** 2).sum(-1))
        far[~real] = np.inf
        order = np.lexsort((nodes[at], far), axis=1)[:, :found]
        at, far = np.take_along_axis(at, order, 1), np.take_along_axis(far, order, 1)
        rows, cols = np.nonzero(np.isfinite(far))
        return pa.record_batch([pa.array(names[rows]), pa.array(nodes[at[rows, cols]]), pa.array(far[rows, cols])], ["_query", "_node", "_far"])

    counts = {x["_dim"]: x["n"] for x in index.groupBy("_dim").agg((F.max("_shard") + 1).alias("n")).collect()}  # a row for each dimension
    shards = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))[F.col("_dim")] if counts else F.lit(None).cast("int")
    absent = lambda name, kind: F.lit(None).cast(kind).alias(name)
    stored = index.select("_dim", "_shard", F.lit(0).alias("_kind"), "_points", "_nodes", "_edges", "_entry", absent("q_id", "long"), absent("q_v", item))
    asked = queries.filter(shards.isNotNull()).withColumn("_shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    asked = asked.select("_dim", "_shard", F.lit(1).alias("_kind"), *(absent(c, "binary") for c in ("_points", "_nodes", "_edges")), absent("_entry", "int"), F.col("_id").alias("q_id"), F.col("_v").alias("q_v"))
    dealt = stored.unionByName(asked).repartition(min(4 * sum(counts.values()) + 1, 20_000), "_dim", "_shard")
    return dealt.sortWithinPartitions("_dim", "_shard", "_kind").mapInArrow(searched, "_query long, _node long, _far double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance): the k nearest found for each query, without the query's own row.

    Ties go to the smaller id, copies of one vector included. Null, empty and
    zero vectors and those with null or non-finite numbers take no part, nor
    do rows without a key; vectors of other lengths are another space. Rows
    of equal key and vector count once. Other columns are ignored; empty
    tables give an empty table.
    """
    importable(vectors.sparkSession)
    rows, asked = usable(vectors, key, vector).distinct(), usable(queries, key, vector).distinct()
    if number_type(rows) != number_type(asked):
        rows, asked = (x.withColumn("_v", F.col("_v").cast("array<double>")) for x in (rows, asked))
    best = search(index_vectors(rows), asked, k + 1)
    by_query = Window.partitionBy("_query").orderBy("_far", "_node")
    best = best.withColumn("_n", F.row_number().over(by_query)).filter(F.col("_n") <= k + 1).drop("_n")
    # No answer needs more than k + 1 copies of a vector, the smallest ids; Spark keeps so few before it shuffles them.
    in_copies = Window.partitionBy("_dim", "_v").orderBy("_id")
    copies = rows.withColumn("_n", F.row_number().over(in_copies)).filter(F.col("_n") <= k + 1).withColumn("_node", F.min("_id").over(Window.partitionBy("_dim", "_v"))).select("_node", F.col("_id").alias("vec_id"))
    found = best.join(copies, "_node").filter(F.col("vec_id") != F.col("_query"))
    order = Window.partitionBy("_query").orderBy("_far", "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select(F.col("_query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.col("_far").alias("score"))
