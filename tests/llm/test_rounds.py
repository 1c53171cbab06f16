"""Window packing, hard negatives and prefix tries against brute force, with odd inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridfolk.llm import negatives, squares, tokens, trie

POWERS = {1 << k for k in range(13)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_pieces_go_where_the_sum_of_squares_stays_smallest(sizes):
    windows, levels = squares.Windows(20, most=1000), Counter()
    for n, size in enumerate(sizes):
        if size < 20:

            def squared(level, size=size):
                after = levels.copy()
                after[level] -= level > 0
                after[level + size] += 1
                return sum(c * c for x, c in after.items() if 0 < x < 20)

            places = [x for x in range(21 - size) if not x or levels[x]]
            best = min(places, key=lambda x: (squared(x), -x))
            levels[best] -= best > 0
            levels[best + size] += 1
        list(windows.add(n, np.arange(size)))
        assert {20 - r: len(w) for r, w in windows.open.items() if w} == {x: c for x, c in levels.items() if c and 0 < x < 20}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=50), st.integers(1, 6))
def test_windows_hold_every_id_once_without_padding(sizes, most):
    windows, done = squares.Windows(32, most), []
    for n, size in enumerate(sizes):
        done += list(windows.add(n, 100 * n + np.arange(size)))
        assert windows.n == sum(map(len, windows.open.values())) <= most
    done += list(windows.finish())
    lengths = [sum(len(p[3]) for p in w) for w in done]
    short = [x for x in lengths if x < 32]
    assert all(x == 32 or x in POWERS for x in lengths) and len(short) == len(set(short))
    assert sorted(i for w in done for p in w for i in p[3].tolist()) == [100 * n + k for n, size in enumerate(sizes) for k in range(size)]
    assert all(p[3].tolist() == list(range(100 * p[0] + p[2], 100 * p[0] + p[2] + len(p[3]))) and p[1] == sizes[p[0]] for w in done for p in w)


LONG = "One long sentence of many words. " * 3000
ODD = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, " \n\t "), (None, "alpha beta"), (5, "x"), (8, LONG)]


def test_window_packing(spark):
    odd = spark.createDataFrame([(*r, 7, 8) for r in ODD], "doc_id long, text string, length int, offset int")
    enc = tokens.encoder(tokens.public_tokenizer("word_bpe_49k.json"), "words").tokenizer
    for table, capacity in ((spark.read.parquet(f"{SF}/documents.parquet"), 4096), (odd, 64), (odd.repartition(3), 4096)):
        got = squares.pack_windows(table, capacity, with_ids=True).collect()
        assert [c.name for c in squares.pack_windows(table).schema] == squares.NAMES
        want = Counter((r["doc_id"], *enc.encode(r["text"] or "", add_special_tokens=False).ids, 2) for r in table.collect())
        assert sum(len(k) - 1 for k in want.elements()) == sum(r["length"] for r in got)
        by_doc, sequences = defaultdict(list), defaultdict(list)
        for r in got:
            by_doc[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append(r)
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] > 0
        names = Counter(k[0] for k in want.elements())
        for key in want:
            if names[key[0]] == 1:
                pieces = sorted(by_doc[key[0]], key=lambda r: r["start"])
                assert [i for r in pieces for i in r["ids"]] == list(key[1:]) and {r["doc_tokens"] for r in pieces} == {len(key) - 1}
                assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        for rs in sequences.values():
            rs.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in rs] == np.cumsum([0] + [r["length"] for r in rs])[:-1].tolist()
            assert sum(r["length"] for r in rs) == capacity or sum(r["length"] for r in rs) in POWERS
        tasks = {s >> 40 for s in sequences}
        assert len(sequences) <= sum(r["length"] for r in got) // capacity + 12 * len(tasks)
    assert squares.pack_windows(odd.limit(0)).count() == 0


def brute_negatives(rows, anchors, k=5, more=3, low=50, high=95):
    """Plain Python integers over every pair."""
    least = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            least[i] = min(least.get(i, (label, v)), (label, v))
    whole = {i: (label, [int(np.floor(256 * float(x))) for x in v]) for i, (label, v) in least.items()}
    out = []
    for a in anchors & whole.keys():
        label, v = whole[a]
        scored = sorted(((sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in whole.items() if i != a and len(w) == len(v)), key=lambda x: (-x[0], x[1]))
        for score, i, _ in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and low * score <= 100 * x[0] <= high * score][:more]
            out += [(a, i, n + 1, x[1], score, x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def negatives_of(table, anchors, **more):
    found = negatives.hard_negatives(table, table.filter(F.col("vec_id").isin(list(anchors))), **more)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("spread, block", [(0.1, 200), (1.0, 32_768), (8.0, 90)])
def test_hard_negatives_of_clusters(spark, monkeypatch, spread, block):
    monkeypatch.setattr(negatives, "CLUSTER", 8)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "SAMPLE", 64)
    rng = np.random.default_rng(int(10 * spread))
    middles = rng.normal(size=(6, 12))
    points = np.round(middles[rng.integers(0, 6, 900)] + spread * rng.normal(size=(900, 12)), 1)
    points[300:500] = points[300]  # one very common vector
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in p]) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    anchors = set(range(0, 900, 10))
    assert negatives_of(table, anchors) == brute_negatives(rows, anchors)


def test_walks_end_where_the_bound_certifies_it(monkeypatch):
    rng = np.random.default_rng(2)
    middles = 256 * 8 * rng.normal(size=(8, 16))
    points = np.floor(middles[np.arange(4000) % 8] + 100 * rng.normal(size=(4000, 16)))
    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    own = np.flatnonzero(ids % 8 == 0)[:40]
    scored, plain = [], negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b: scored.append(len(a) * len(b)) or plain(a, b))
    w, found, scores = negatives.walk((ids, labels, points), (ids[own], labels[own], points[own]), np.arange(40), np.full(40, -negatives.LONG), np.full(40, negatives.LONG), True, 5)
    want = plain(points[own], points)
    want[np.arange(40), own] = -np.inf
    best = np.lexsort((np.broadcast_to(ids, want.shape), -want), axis=1)[:, :5]
    assert found.reshape(40, 5).tolist() == best.tolist() and sum(scored) < 40 * 4000 / 4


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [0.5, 3.0]), (3, 2, [0.6, 1.0]), (4, 2, [0.9, 0.0]), (4, 2, [0.7, 0.0]), (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [nan, 1.0])]
    rows += [(8, 2, [inf, 0.0]), (9, 2, [None, 1.0]), (10, 1, []), (11, 2, []), (12, 2, [0.0, 0.0]), (13, 1, [1.0]), (14, 2, [0.9]), (15, 1, [1.0]), (None, 2, [0.9, 0.0]), (16, 2, [0.9, 0.0]), (17, 2, [-1.0, 0.0]), (18, 3, [1e9, 1e9]), (19, 3, [1e9, 9e8]), (20, 1, [7e8, 0.0]), (21, 1, [1e30, 0.0])]
    table = spark.createDataFrame([(*r, 5, 6) for r in rows if r[0] != 21], "vec_id long, label int, embedding array<double>, rank int, anchor_id int")
    everyone = {r[0] for r in rows if r[0] is not None}
    got = negatives_of(table, everyone)
    assert got == brute_negatives([r for r in rows if r[0] != 21], everyone) and len(got) > 20
    beyond = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert negatives_of(beyond, {21, 18}) == []  # scores beyond 64 bits don't stop it
    assert negatives_of(table.limit(0), everyone) == [] and negatives_of(table, set()) == []


def brute_trie(rows, every=20, most=4):
    own = defaultdict(list)
    tied = lambda role, text: hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", tied(role or "", text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = t if c % every == 0 else own.get(c - c % every, [])[:h] + t[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in kids[path])
    ends = {p: ",".join(str(c) for c in m if len(built[c]) == len(p)) for p, m in members.items()}
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


TURN = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(table, **more):
    return sorted(tuple(r) for r in trie.prefix_trie(*trie.rebuilt(table, **more)).select(*COLUMNS).collect())


def test_tries_of_odd_conversations(spark):
    rows = [(20, 0, "user", "hi there"), (20, 1, None, "a b c"), (20, None, "user", None), (21, 0, "user", "x"), (22, 5, "u", "y"), (22, 5, "u", "y"), (22, 3, "v", ""), (None, 0, "user", "lost"), (41, 0, "user", "gone"), (43, 0, "a", "b"), (44, 0, "a", "b"), (23, 0, "user", LONG), (23, 1, "usera", "b"), (24, 0, "user", "ab")]
    rows += [(c, t, "user", f"w{t % 3} w") for c in range(60, 75) for t in range(c - 58)]
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], TURN + ", depth int, _digest string")
    want = brute_trie(rows)
    assert want[0][1] == 0 or any(r[1] == 0 for r in want)
    assert trie_of(table) == want
    assert trie_of(table.limit(0)) == [] and trie_of(table, most=1) == brute_trie(rows, most=1)
    alone = spark.createDataFrame([(7, 0, "a", "b")], TURN)  # h is 2 or more, so nothing is left of it
    assert zlib.crc32(b"7") % 4 >= 1 and trie_of(alone) == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_long_chains_and_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "TURNS", 3)
    monkeypatch.setattr(trie, "MEMBERS", 2)
    rng = np.random.default_rng(4)
    rows = [(40 * c, t, "u", f"t{t} " * (t % 4) if c % 5 else f"{c}") for c in range(12) for t in range(int(rng.integers(1, 90)))]
    rows += [(1000 + i, t, "u", "same words") for i in range(60) for t in range(5)]  # a group of copies
    rows += [(2001, t, "u", str(t // 40)) for t in range(150)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(int(c), int(t), r, x) for c, t, r, x in rows], TURN)
    assert trie_of(table, every=40) == brute_trie([(int(c), int(t), r, x) for c, t, r, x in rows], every=40)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    written, plain = [], trie.staged
    monkeypatch.setattr(trie, "staged", lambda df: written.append(1) or plain(df))
    # A path of 300 nodes: each of them is conversation 0.
    path = spark.range(301).select(F.lit(0).cast("long").alias("conv"), F.col("id").alias("depth"), F.when(F.col("id") > 0, 0).cast("long").alias("p_conv"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p_depth"), (F.col("id") < 300).cast("long").alias("kids"), F.lit(0).cast("long").alias("x_conv"), F.when(F.col("id") < 300, F.col("id") + 1).otherwise(0).alias("x_depth"), F.lit(1).cast("long").alias("n"))
    got = {r["depth"]: r["n"] for r in trie.contract(path, ["n"]).collect()}
    assert got == {d: 301 - d for d in range(301)} and len(written) <= 1 + 4 * 11
