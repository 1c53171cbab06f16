"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A sketch has ``bands * rows`` coordinates. In round i every shingle is thrown
into a random coordinate with a random value that is larger than all values
of earlier rounds; a coordinate keeps its smallest value, and rounds go on
until all coordinates are filled. After as many rounds as coordinates, round
t + j throws everything into coordinate j, so every coordinate of a non-empty
set fills. Coordinates of two sets agree with the probability of their
similarity, with the concentration of independent ones, at the cost of a few
rounds for long texts.

Sets that share a band become candidates; each candidate pair is confirmed on
the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import importable, staged
from .tokens import some_at_a_time

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 6) ** 48 < 5e-7.
BANDS, ROWS = 48, 6
#: Groups of at most so many members are compared pair by pair; larger ones block by block, in memory.
FEW = 24
#: Shingles in a block of the smaller side and in a chunk of the whole group, and members of each, whichever is reached first.
BLOCK, CHUNK, BLOCK_ROWS, CHUNK_ROWS = 500_000, 4_000_000, 256, 512
#: A node with more than this part of all edges is a hub; so there are fewer hubs than this.
HUBS = 1000
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW_48 = np.uint64((1 << 48) - 1)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], k: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles (A-Z lower-cased; fewer words: the whole sequence)."""
    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
        each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        width = min(k, len(each))
        if not width:
            out.append(each)
            continue
        n = len(each) - width + 1
        value = mixed(each[:n])
        for j in range(1, width):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n])
        out.append(np.unique(value))
    return out


def fast_sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of ``t`` filled coordinates for each set; rows of empty sets stay at the maximum."""
    out = np.full((len(sets), t), MAX)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    open_ = np.flatnonzero(sizes)
    cells = out.reshape(-1)
    for i in range(t):
        if not len(open_):
            break
        h = mixed(flat + mixed(np.uint64([i + 1])))
        cell = owner * t + ((h >> np.uint64(48)) * np.uint64(t) >> np.uint64(16)).astype(np.int64)
        np.minimum.at(cells, cell, (h & LOW_48) | np.uint64(i << 48))
        filled = (out[open_] != MAX).all(axis=1)
        if filled.any():
            open_ = open_[~filled]
            keep = np.zeros(len(sets), bool)
            keep[open_] = True
            keep = keep[owner]
            flat, owner = flat[keep], owner[keep]
    for d in open_:  # only sets of a few shingles get here
        missing = np.flatnonzero(out[d] == MAX)
        h = mixed(sets[d][None, :] + mixed((t + missing + 1).astype(np.uint64))[:, None])
        out[d, missing] = (h & LOW_48).min(axis=1) | (t + missing).astype(np.uint64) << np.uint64(48)
    return out


def band_hashes(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    value = mixed(np.arange(1, bands + 1, dtype=np.uint64))[None, :]
    for r in range(rows):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + sketches[:, r::rows])
    return value.view(np.int64)


def sketch_documents(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and its band hashes (none for empty sets)."""

    def sketched(batches):
        hashes = WordHashes()
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["doc_id"].astype("Int64")
            for a, b in some_at_a_time(["" if x is None else x for x in texts], 1000, 2_000_000):
                sets = shingle_sets(texts[a:b], k, hashes)
                found = band_hashes(fast_sketches(sets, bands * rows), bands, rows)
                digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]).reshape(-1, 2)
                yield pd.DataFrame({"doc_id": keys.iloc[a:b].array, "n_shingles": [len(s) for s in sets], "d1": digests[:, 0], "d2": digests[:, 1], "bands": [list(f) if len(s) else [] for f, s in zip(found, sets, strict=True)]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(sketched, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def full_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``id`` and ``shingles`` (sorted 64-bit hashes) of whole texts, staged."""

    def made(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in some_at_a_time(["" if x is None else x for x in texts], 1000, 2_000_000):
                yield pd.DataFrame({"id": batch["doc_id"].iloc[a:b], "shingles": [s.tobytes() for s in shingle_sets(texts[a:b], k, hashes)]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = ids.select(F.col("id").alias("doc_id")).distinct().hint("merge")  # the ids grow with the documents
    return staged(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInPandas(made, "id long, shingles binary"), "none")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def compared(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    of = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    return pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInPandas(compared, "a long, b long")


def links_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect components within large groups (pivot, id, part, main, members, main_c, whole, main_s).

    Members outside the main component, dealt to blocks, meet all members,
    dealt to chunks; a task holds one block and one chunk of bounded size. It
    counts common shingles through an inverted index of the chunk and returns
    only links that connect what its earlier links have not.
    """

    def linked(_, x, y):
        sets = [np.frombuffer(s, np.uint64) for s in y["y_shingles"]]
        if not len(x) or not sets:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        ids, parts, parent, out = y["y_id"].to_numpy(), y["y_part"].to_numpy(), {}, []

        def root(v):
            while parent.get(v, v) != v:
                parent[v] = v = parent.get(parent[v], parent[v])
            return v

        for name, part, octets in zip(x["id"], x["part"], x["shingles"], strict=True):
            own = np.frombuffer(octets, np.uint64)
            begin, end = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            n = end - begin
            hits = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[hits], minlength=len(sets))
            for j in np.flatnonzero((100 * both >= percent * (len(own) + sizes - both)) & (parts != part)):
                if (u := root(part)) != (v := root(parts[j])):
                    parent[max(u, v)] = min(u, v)
                    out.append((name, ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    at_most = lambda rows, most, shingles, room: F.ceil(F.greatest(F.col(rows) / most, F.col(shingles) / room)).cast("int")
    members = members.withColumns({"others": F.col("members") - F.col("main_c"), "others_s": F.col("whole") - F.col("main_s")})
    blocks, chunks = at_most("others", BLOCK_ROWS, "others_s", BLOCK), at_most("members", CHUNK_ROWS, "whole", CHUNK)
    dealt = members.join(sets, "id").withColumns({"blocks": blocks, "chunks": chunks})
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = dealt.filter("part != main").withColumn("block", deal("blocks", 1)).withColumn("chunk", each("chunks"))
    y = dealt.withColumn("chunk", deal("chunks", 2)).withColumn("block", each("blocks"))
    keys = ["pivot", "block", "chunk"]
    x = x.select(*keys, "id", "part", "shingles")
    y = y.select(*(F.col(c).alias(f"y_{c}") for c in [*keys, "id", "part", "shingles"]))
    return x.groupBy(*keys).cogroup(y.groupBy(*(f"y_{k}" for k in keys))).applyInPandas(linked, "a long, b long")


def beside_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least node that u sees, from ``least`` (u, m and n, how many edges u has).

    The edges of hubs stay where they are: what hubs see is broadcast, fewer
    than ``HUBS`` rows however large the graph is. Only the others are dealt
    by node, so no task gets more than that part of all edges for one node.
    """
    most = edges.count() // HUBS
    hubs = least.filter(F.col("n") > most).select("u", F.col("m").alias("_hub_m"))
    known = edges.join(F.broadcast(hubs), "u", "left")
    others = known.filter("_hub_m is null").select("u", "v").join(least.filter(F.col("n") <= most), "u")
    return known.filter("_hub_m is not null").select("u", "v", F.col("_hub_m").alias("m")).union(others.select("u", "v", "m"))


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the links (a, b).

    Alternates the large-star and small-star steps: each node hangs its
    larger neighbours, then its smaller ones, on the smallest it sees. The
    number of rounds grows with the logarithm of the longest path; each round
    is two joins on links, staged in the shared folder. Nodes with a large
    part of all links are spread over tasks (:func:`beside_least`).
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        edges = staged(beside_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hung = beside_least(edges, least)
        edges = staged(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        seen = now


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Documents are linked if 100 * intersection >= ``percent`` * union of
    their shingle sets; ``component_id`` is the smallest id reachable over
    links and ``kept`` says whether it is the document's own. Null and empty
    texts have no shingles and no links. Rows of one doc_id are taken as one
    document, so they share text and links and are all kept or not. Rows with
    a null id are kept, link nothing and have a null component. Other columns
    are ignored; an empty table gives an empty table.

    Equal sets are merged before anything is compared. All members of a
    bucket are compared with its pivot, the smallest id. The buckets of one
    pivot then form a group in which only members of different components
    are compared, and those of its largest component never with each other.
    So large groups of copies cost comparisons in proportion to their size,
    and every pair that shares a bucket is either compared or known to be
    connected.
    """
    importable(docs.sparkSession)
    sketched = staged(sketch_documents(docs, shingle_words, bands, rows))
    linkable = sketched.filter("n_shingles > 0 and doc_id is not null")
    classes = staged(linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    members = classes.select("id", "n", F.explode("bands").alias("bucket"))
    several = staged(members.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot != last").select("bucket", "pivot"))
    buckets = staged(members.join(several.hint("merge"), "bucket"))
    sets = full_sets(buckets, docs, shingle_words)

    like = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  sizes further apart can't reach the similarity
    pivots = classes.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"))
    stars = buckets.filter("id != pivot").select("pivot", "id", "n").distinct().join(pivots, "pivot").filter(like(F.col("n"), F.col("pivot_n")))
    tested = staged(stars.select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    links = staged(confirmed(tested, sets, percent))

    parts = connected_components(links)
    grouped = buckets.select("pivot", "id", "n").distinct().join(parts, F.col("id") == F.col("node"), "left").select("pivot", "id", "n", F.coalesce("component", "id").alias("part"))
    grouped = staged(grouped)
    counts = grouped.groupBy("pivot", "part").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    facts = counts.groupBy("pivot").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.max_by("s", F.struct("c", "part")).alias("main_s"), F.max("c").alias("main_c"), F.count("*").alias("parts"), F.sum("c").alias("members"), F.sum("s").alias("whole"))
    undecided = staged(grouped.join(staged(facts.filter("parts > 1")), "pivot"))

    few = undecided.filter(F.col("members") <= FEW)
    x = few.filter("part != main").select("pivot", F.col("id").alias("xi"), F.col("n").alias("xn"), F.col("part").alias("xp"))
    y = few.select("pivot", F.col("id").alias("yi"), F.col("n").alias("yn"), F.col("part").alias("yp"), (F.col("part") == F.col("main")).alias("y_main"))
    across = x.join(y, "pivot").filter((F.col("xp") != F.col("yp")) & (F.col("y_main") | (F.col("xi") < F.col("yi"))) & like(F.col("xn"), F.col("yn")))
    across = across.select(F.least("xi", "yi").alias("a"), F.greatest("xi", "yi").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    links = links.union(staged(confirmed(staged(across), sets, percent)))
    links = links.union(staged(links_in_blocks(undecided.filter(F.col("members") > FEW), sets, percent)))
    parts = connected_components(links)

    found = classes.select("d1", "d2", "id").join(parts, F.col("id") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "id").alias("class_part"))
    joined = sketched.select("doc_id", "n_shingles", "d1", "d2").join(found, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_part")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their component, one row for each id and text, and all rows without an id."""
    kept = near_duplicates(docs, shingle_words, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").withColumn("_kept_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_kept_text"]).select(*docs.columns).unionByName(docs.filter("doc_id is null"))
