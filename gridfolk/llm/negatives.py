"""Hard negatives of anchors, exactly, by shared lists of anchor clusters.

For a cluster of anchors within an angle b of its centre, no anchor's inner
product with a candidate exceeds |anchor| |candidate| cos(max(0, a - b)),
where a is the candidate's angle to the centre. The candidates are sorted by
this bound once for the cluster, and every member walks the one list until
the bound falls below the worst score that it still could use.

Candidates are dealt to blocks by a hash of their id; anchors are copied to
every block, and a task reads a block's candidates first and then its anchors,
some at a time. So a task holds one block whatever the number of anchors.
Results of blocks are merged, first for the positives, then, whose scores
bound those of the negatives, for the negatives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import importable, staged

#: Candidates in a block about; anchors in a cluster about; anchors and candidates in the samples that centres and first limits come from.
BLOCK, CLUSTER, SAMPLE = 32_768, 256, 4096
#: Scores that are computed at a time.
TOGETHER = 4_000_000
FLOAT_EXACT, LONG = 2.0**53, (1 << 63) - 1


def labelled(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """``_id``, ``_label`` and ``_v`` of rows with id, label and a vector of finite numbers."""
    v = F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.select(F.col(key).cast("long").alias("_id"), label.cast("long").alias("_label"), v.alias("_v"))
    return out.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_v").isNotNull() & finite)


def matrices(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and quantised vectors of a batch, for each number of dimensions."""
    column = batch.column("_v")
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    begins = np.cumsum(sizes) - sizes
    found = []
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        found.append((at, flat[begins[at][:, None] + np.arange(d)]))
    return found


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact up to 64 bits."""
    most = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    return a @ b.T if most < FLOAT_EXACT else (a.astype(np.longdouble) @ b.T.astype(np.longdouble))


def as_long(scores: np.ndarray) -> np.ndarray:
    return np.where(scores >= LONG, LONG, np.where(scores <= -LONG, -LONG, scores).astype(np.int64)) if len(scores) else scores.astype(np.int64)


def shared_list(members: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the candidates by falling bound for members of length 1, and the bounds in that order."""
    own, norms = np.linalg.norm(members, axis=1), np.linalg.norm(candidates, axis=1)
    unit = members[own > 0] / own[own > 0, None]
    centre = unit.sum(0)
    length = np.linalg.norm(centre)
    if not length:
        wide = np.pi
        angles = np.zeros(len(candidates))
    else:
        centre /= length
        wide = np.arccos(np.clip(unit @ centre, -1, 1)).max()
        angles = np.arccos(np.clip(candidates @ centre / np.where(norms > 0, norms, 1), -1, 1))
    bounds = norms * (np.cos(np.maximum(0, angles - wide)) + 1e-6)  # the angles are not exact
    order = np.argsort(-bounds, kind="stable")
    return order, bounds[order]


def walk(candidates: tuple, members: tuple, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wanted rows of each walker: its number, candidate ids and scores, ``k`` of each at most, the best.

    ``candidates`` and ``members`` are (ids, labels, vectors). Walker w is
    member ``of[w]`` and wants scores from ``low[w]`` to ``high[w]`` of rows
    of the same label, or of other labels.
    """
    ids, labels, vectors = candidates
    own_ids, own_labels, own = members
    order, bounds = shared_list(own, vectors)
    lengths = np.linalg.norm(own, axis=1)
    worst, worst_id = low.astype(np.longdouble), np.full(len(of), LONG)
    active, at, step = np.arange(len(of)), 0, 64
    w, s, c = np.zeros(0, np.int64), np.zeros(0, np.longdouble), np.zeros(0, np.int64)
    while at < len(order):
        reach = lengths[of[active]] * bounds[at] * (1 + 1e-9) + 1
        active = active[reach >= worst[active]]  # the others are certified: nothing further on can be better
        if not len(active):
            break
        part = order[at : at + step]
        rows, back = np.unique(of[active], return_inverse=True)
        scores = products(own[rows], vectors[part])[back]
        fit = (own_labels[rows][back, None] == labels[part]) == same
        fit &= own_ids[rows][back, None] != ids[part]
        fit &= (scores >= worst[active, None]) & (scores <= high[active, None])
        n, m = np.nonzero(fit)
        better = (scores[n, m] > worst[active[n]]) | (ids[part[m]] <= worst_id[active[n]])
        n, m = n[better], m[better]
        w, s, c = np.append(w, active[n]), np.append(s, scores[n, m].astype(np.longdouble)), np.append(c, ids[part[m]])
        by = np.lexsort((c, -s, w))
        w, s, c = w[by], s[by], c[by]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        w, s, c, rank = (x[rank < k] for x in (w, s, c, rank))
        last = rank == k - 1
        worst[w[last]], worst_id[w[last]] = s[last], c[last]
        at += len(part)
        step = max(64, min(2 * step, TOGETHER // max(1, len(active))))
    return w, c, s


def centres(anchors: DataFrame) -> np.ndarray | None:
    """Directions of clusters, by a few rounds over a sample of :data:`SAMPLE` anchors at most, chosen by hash; none without anchors that have a direction."""
    n = anchors.count()
    sample = anchors.withColumn("_h", F.xxhash64("_id")).orderBy("_h").limit(SAMPLE).select("_v").collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["_v"]), []).append(r["_v"])
    points = np.array(max(by_size.values(), key=len, default=np.zeros((0, 1))), np.float64)
    norms = np.linalg.norm(points, axis=1)
    points = points[norms > 0] / norms[norms > 0, None]
    if not len(points):
        return None
    found = points[: max(1, min(n // CLUSTER, len(points) // 16))]
    for _ in range(8):
        near = (points @ found.T).argmax(1)
        sums = np.stack([points[near == k].sum(0) if (near == k).any() else found[k] for k in range(len(found))])
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), found)
    return found


def prepared(anchors: DataFrame, middles: np.ndarray | None, first: pd.DataFrame, k: int) -> DataFrame:
    """Anchors with their cluster and a first limit: the k-th best score among some rows of the same label is reached by k rows at least."""
    ids, labels = first["_id"].to_numpy(np.int64), first["_label"].to_numpy(np.int64)
    sizes = np.array([len(v) for v in first["_v"]], np.int64)

    def batches(parts):
        for batch in parts:
            cluster, limit = np.zeros(len(batch), np.int64), np.full(len(batch), -LONG)
            own_ids, own_labels = batch["_id"].to_numpy(), batch["_label"].to_numpy()
            for at, vectors in matrices(batch):
                if middles is not None and middles.shape[1] == vectors.shape[1]:
                    cluster[at] = (vectors @ middles.T).argmax(1)
                some = np.flatnonzero(sizes == vectors.shape[1])
                if len(some) >= k:
                    others = np.floor(256.0 * np.stack(first["_v"].to_numpy()[some]).astype(np.float64))
                    scores = products(vectors, others).astype(np.float64)
                    scores[(own_labels[at][:, None] != labels[some]) | (own_ids[at][:, None] == ids[some])] = -np.inf
                    kth = np.nextafter(np.sort(scores, axis=1)[:, -k], -np.inf)
                    limit[at] = np.where(kth > -LONG, np.floor(np.clip(kth, -LONG, LONG // 2)), -LONG).astype(np.int64)
            yield pa.record_batch([batch["_id"], batch["_label"], batch["_v"], pa.array(cluster), pa.array(limit)], ["_id", "_label", "_v", "_cluster", "_low"])

    kind = anchors.schema["_v"].dataType.simpleString()
    return anchors.mapInArrow(batches, f"_id long, _label long, _v {kind}, _cluster long, _low long")


def walks(rows: DataFrame, anchors: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """``_anchor``, ``_to`` (position in the anchor's ``_wants``), ``_found`` and ``_score``: the best ``k`` of each block.

    ``anchors`` has _id, _label, _v, _cluster and _wants (array of low, high).
    """
    wants = "array<struct<low:bigint,high:bigint>>"
    block = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    near = rows.select(block.alias("_block"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_cluster"), "_id", "_label", "_v", F.lit(None).cast(wants).alias("_wants"))
    far = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_kind"), "_cluster", "_id", "_label", "_v", F.col("_wants").cast(wants).alias("_wants"))

    def walked(batches):
        block, held, table, last = None, [], {}, None
        for batch in filter(len, batches):
            kinds, numbers = batch["_kind"].to_numpy(), batch["_block"].to_numpy()
            edges = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(numbers) != 0) | (np.diff(batch["_cluster"].to_numpy()) != 0)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(kinds)), strict=True):
                part = batch.slice(a, b - a)
                if numbers[a] != block:
                    block, held, table, last = numbers[a], [], {}, None
                if kinds[a] == 0:
                    part_ids = part["_id"].to_numpy()
                    new = np.append(True, part_ids[1:] != part_ids[:-1])  # of repeated ids the first row counts
                    new[0] = part_ids[0] != last
                    last = part_ids[-1]
                    held.append(part.filter(pa.array(new)))
                    continue
                if held:
                    for piece in held:
                        for at, vectors in matrices(piece):
                            table.setdefault(vectors.shape[1], []).append((piece["_id"].to_numpy()[at], piece["_label"].to_numpy()[at], vectors))
                    table = {d: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for d, parts in table.items()}
                    held = []
                yield from members_walk(part, table)

    def members_walk(part, table):
        column = part["_wants"]
        counts, flat = np.diff(column.offsets.to_numpy()), column.flatten()
        begins, low, high = np.cumsum(counts) - counts, flat.field("low").to_numpy(), flat.field("high").to_numpy()
        for at, vectors in matrices(part):
            candidates = table.get(vectors.shape[1])
            if candidates is None:
                continue
            of = np.repeat(np.arange(len(at)), counts[at])
            to = np.arange(len(of)) - np.repeat(np.cumsum(counts[at]) - counts[at], counts[at])
            want = begins[at][of] + to
            ids, labels = part["_id"].to_numpy()[at], part["_label"].to_numpy()[at]
            w, found, scores = walk(candidates, (ids, labels, vectors), of, low[want], high[want], same, k)
            yield pa.record_batch([pa.array(ids[of[w]]), pa.array(to[w].astype(np.int32)), pa.array(found), pa.array(as_long(scores))], ["_anchor", "_to", "_found", "_score"])

    order = ["_block", "_kind", "_cluster", "_id", "_label", "_v"]
    dealt = near.unionByName(far).repartition(2 * blocks, "_block").sortWithinPartitions(*order)
    best = dealt.mapInArrow(walked, "_anchor long, _to int, _found long, _score long")
    by = Window.partitionBy("_anchor", "_to").orderBy(F.desc("_score"), "_found")
    return best.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, key: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Scores are inner products of floor(256 * component). The positives of an
    anchor are its best rows of the same label; for each of them come the
    best rows of other labels that score from ``low`` to ``high`` per cent of
    it. Ties go to the smaller id. Rows with a null id, label or vector, or a
    null or non-finite component, take no part. Of rows with one id the least
    by label and vector counts; a row is never its own partner. Vectors of
    other lengths are another space. Scores beyond 64 bits count as the
    largest. Other columns are ignored; empty tables give an empty table.
    """
    importable(rows.sparkSession)
    label = F.col("label") if label is None else label
    table = staged(labelled(rows, key, vector, label))
    asked = labelled(anchors, key, vector, label).groupBy("_id").agg(F.min(F.struct("_label", "_v")).alias("r")).select("_id", "r._label", "r._v")
    n = table.count()
    blocks = max(-(-n // BLOCK), min(24, -(-n // 1024)), 1)
    # A bounded sample that only gives limits to begin with, of ids that have one row: of the last there may be more.
    some = table.withColumn("_h", F.xxhash64("_id")).orderBy("_h").limit(SAMPLE).toPandas()
    some = some[~some["_h"].duplicated(keep=False) & (some["_h"] != some["_h"].max())]
    clustered = staged(prepared(asked, centres(asked), some, positives))
    everything = F.array(F.struct(F.col("_low").alias("low"), F.lit(LONG).alias("high")))
    same = walks(table, clustered.withColumn("_wants", everything), blocks, True, positives)
    listed = same.groupBy("_anchor").agg(F.array_sort(F.collect_list(F.struct("_rank", F.col("_found").alias("id"), F.col("_score").alias("score")))).alias("_positives"))
    chosen = staged(clustered.join(listed, F.col("_id") == F.col("_anchor")).select("_id", "_label", "_v", "_cluster", "_positives"))
    # Whole numbers from low to high per cent of the score: computed in decimals, as some don't fit in doubles.
    score = lambda p: p["score"].cast("decimal(20,0)")
    limits = F.transform("_positives", lambda p: F.struct(F.ceil(score(p) * low / 100).cast("long").alias("low"), F.floor(score(p) * high / 100).cast("long").alias("high")))
    other = walks(table, chosen.withColumn("_wants", limits), blocks, False, negatives)
    named = chosen.select(F.col("_id").alias("_anchor"), F.posexplode("_positives").alias("_to", "_p"))
    return other.join(named, ["_anchor", "_to"]).select(
        F.col("_anchor").alias("anchor_id"), F.col("_p.id").alias("positive_id"), F.col("_rank").cast("int").alias("rank"),
        F.col("_found").alias("negative_id"), F.col("_p.score").alias("positive_score"), F.col("_score").alias("negative_score"),
    )
