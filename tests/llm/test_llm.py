"""Operators for training corpora against SQL, brute force and round trips, with odd inputs."""

import math
import re
import textwrap
import zlib
from collections import Counter
from importlib.resources import files

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gridfolk.llm import ann, licenses, linededup, minhash, mixing, packing, quality, sharding, staging, tokenids, tokens, urlrules
from gridfolk.llm.oracles import ORACLES
from gridfolk.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empties, repeated rows, repeated ids, copies, blanks and a long text; one extra column named like results.
LONG = "One long sentence of many words. " * 3000
ODD = [
    (1, "alpha beta gamma delta", "en", "a", 1), (1, "alpha beta gamma delta", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
    (4, " \n\t ", "de", "b", 4), (None, "alpha beta gamma delta", "en", "b", 1), (5, "Alpha  BETA gamma\ndelta", "en", "b", 1), (6, "one", "en", "c", 1), (7, "one", "en", None, 1), (8, LONG, "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, 8, "x", 9) for r in ODD], DOCS + ", shard int, copy int, rule string, kept int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(ORACLES[name]).df())


def test_mixed_rows_lie_in_equal_ranges_of_the_key(spark, odd):
    rows = mixing.mix_sources(odd, draws=300, parts=5).withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) > 100 and {r.part for r in rows} == set(range(5))
    assert all(r.part == r.shuffle_key * 5 // 16**15 for r in rows)
    ends = spark.createDataFrame([(0,), (16**15 - 1,)], "k long").select(mixing.range_of(F.col("k"), 7).alias("p")).collect()
    assert [r.p for r in ends] == [0, 6]


def test_a_run_deletes_only_tables_of_its_own(spark, odd):
    other = staging.staged(odd)
    with staging.own_tables() as tables:
        first, last = staging.staged(odd.limit(1)), staging.staged(odd.limit(2))
        staging.clear_staged(spark, tables, but_last=True)
        assert len(tables) == 1 and last.count() == 2 and other.count() == odd.count()
        with pytest.raises(Exception):  # noqa: B017  its files are gone
            first.collect()
    assert last.count() == 2  # what is left joins the tables of all


def test_mixing(spark, odd, docs):
    got = mixing.mix_sources(odd, {"a": 1.0, None: 3.0}, draws=40, seed=3).collect()
    assert {r["source"] for r in got} <= {"a", None} and all(1 <= r["copy"] <= r["n_copies"] for r in got)
    assert mixing.mix_sources(odd.limit(0)).count() == 0 and mixing.mix_sources(odd, {"a": 0.0}).count() == 0
    rates = mixing.with_distribution(spark.createDataFrame([("s", 5, 3.0), ("t", 5, 2000.0)], "_source string, n_docs long, rate double"))
    for r in rates.collect():
        cdf = np.array(r["cdf"])
        assert cdf[-1] == pytest.approx(1, abs=1e-9) and (np.arange(len(cdf)) * np.diff(cdf, prepend=0)).sum() == pytest.approx(r["rate"], rel=1e-6)
    drawn = mixing.mix_sources(docs, draws=20 * docs.count()).groupBy("source").count().collect()
    sizes = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    whole = sum(math.sqrt(n) for n in sizes.values())
    for r in drawn:
        mean = 20 * docs.count() * math.sqrt(sizes[r["source"]]) / whole
        assert abs(r["count"] - mean) < 6 * math.sqrt(mean)


def brute_components(rows, k, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    part = {i: i for i in sets}
    for _ in sets:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(part[a], part[b])
                    old = {part[a], part[b]}
                    part = {i: low if p in old else p for i, p in part.items()}
                    changed = True
        if not changed:
            return sets, part


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, part = brute_components(rows, k, 80)
    got = minhash.near_duplicates(docs, k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), part[i], part[i] == i) for i in sets}


@pytest.mark.parametrize("hubs", [1000, 8, 1])
def test_components_with_hubs(spark, monkeypatch, hubs):
    """Two stars, a path, a ring, repeated links and loops, with every node a hub, a few of them, and none."""
    monkeypatch.setattr(minhash, "HUBS", hubs)
    links = [(0, k) for k in range(1, 60)] + [(199, k) for k in range(100, 160)] + [(k, k + 1) for k in range(300, 340)] + [(400 + k, 400 + (k + 1) % 9) for k in range(9)] + [(59, 100), (59, 100), (500, 500)]
    got = {(r["node"], r["component"]) for r in minhash.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(k, 0) for k in [*range(60), *range(100, 160), 199]} | {(k, 300) for k in range(300, 341)} | {(k, 400) for k in range(400, 409)}


def test_hubs_are_not_dealt_by_node(spark):
    """What a hub sees stands beside its edges, and hubs are fewer than their bound."""
    edges = [(0, k) for k in range(1, 5000)] + [(k, k + 1) for k in range(10_000, 13_000)]
    edges = spark.createDataFrame(edges, "u long, v long")
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    assert least.filter(F.col("n") > edges.count() // minhash.HUBS).count() == 1
    rows = minhash.beside_least(edges, least)
    assert rows.filter("m = 1 and u = 0").count() == 4999 and rows.filter("u > 0 and m = v").count() == 3000 and rows.count() == 7999


def test_near_duplicates_of_odd_rows(odd):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd, 2).collect()}
    assert {(1, 3, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 3, 1, False), (6, 1, 6, True), (7, 1, 6, False)} <= got
    assert (None, 3, None, True) in got and minhash.near_duplicates(odd.limit(0), 2).count() == 0
    kept = minhash.drop_near_duplicates(odd, 2)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8]


def test_large_groups_are_compared_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):  # edits of one text, many of them just below the limit with the first
        w = list(base)
        for j in rng.choice(80, rng.integers(1, 9), replace=False):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    sets, part = brute_components(rows, 2, 80)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == part


def test_large_groups_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 11)
    test_large_groups_are_compared_in_blocks(spark)


def test_repeated_ids_lose_no_text(spark):
    rows = [(1, "one two three four"), (1, "other words stand here"), (1, "one two three four"), (2, "one two three four")]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "one two three four"), (1, "other words stand here")]


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.unique(x[:900]), np.unique(x[100:])
    s = minhash.fast_sketches([a, b, x[:1], x[:0]], 512)
    assert (s[:3] != minhash.MAX).all() and (s[3] == minhash.MAX).all()
    assert (s[0] == s[1]).mean() == pytest.approx(0.8, abs=0.08)


def glob_fits(rule, host, path):
    to = lambda g: "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
    h, _, p = rule.partition("/")
    return bool(re.fullmatch(f"(.*\\.)?{to(h)}", host, re.S)) and bool(re.match(to("/" + p), path, re.S))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab.", max_size=8), st.text("ab/", max_size=6)), min_size=1, max_size=20), st.lists(st.tuples(st.text("ab.*?", min_size=1, max_size=30), st.text("ab*?", max_size=5)), min_size=1, max_size=12))
def test_automaton_is_like_regular_expressions(urls, globs):
    rules = [f"{h}/{p}" for h, p in globs]
    urls = [(h, "/" + p) for h, p in urls]
    got = urlrules.Automaton.build(rules).run([f".{h}#{p}".encode() for h, p in urls])
    # The canonical form has one dot more in front of the host.
    assert got.tolist() == [[glob_fits(r, h, p) for r in rules] for h, p in urls]


def test_urls(spark):
    cases = ["HTTP://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "http://x.net/es/", "no scheme", None, "http://com", "ftp://b.cheap-pills.org/x", "http://x.org/a.com/", "http://" + "a" * 50_000 + ".com/x"]
    got = urlrules.judge_urls(spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)], "page_id long, url string, host string")).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), ("com/", "allow")]
    assert (got[0]["host"], got[0]["path"], got[3]["host"], got[4]["path"]) == ("www.example.com", "/en/x", "", "")


def test_shards(docs, odd):
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        got = sharding.shard_documents(table, 4).collect()
        assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r)
        for rs in by.values():
            assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
        assert [r["doc_id"] or -1 for r in ordered] == sorted(r["doc_id"] or -1 for r in got)
    sizes = [sum(r["size"] for r in sharding.shard_documents(docs, 4).collect() if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(len((r["text"] or "").encode()) + 16 for r in docs.collect())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def plain_shards(rows, shards):
    """Every row's shard and slot by one running sum in the order of ids, with whole numbers only."""
    sized = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows)
    total, before, out, slots = sum(s for *_, s in sized), 0, [], Counter()
    for (known, i), crc, size in sized:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((i if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def test_shards_are_those_of_a_plain_running_sum(spark, docs, odd):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for table, shards in ((sf, 40), (docs, 40), (odd, 3), (odd, 40)):
        got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_documents(table, shards).collect()]
        want = plain_shards([(r["doc_id"], r["text"]) for r in table.collect()], shards)
        assert sorted(got, key=lambda r: r[3:]) == sorted(want, key=lambda r: r[3:])


def test_written_shards_are_whole_and_in_order(docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 5)
    back = docs.sparkSession.read.parquet(path)
    want = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 5).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == want and back.select(docs.columns).exceptAll(docs).count() == 0 == docs.count() - back.count()


def test_line_dedup_of_odd_rows(spark, odd):
    passage = "First of the passage here. Then a second sentence of it. A third one follows with more words in it. At last the fourth sentence ends it here now. "
    rows = [(1, "Own words stand here. " + passage + "More of it."), (2, "Another start of text\n" + passage.rstrip() + "\nAnother end."), (3, passage), (None, "x"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in linededup.delete_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "Another start of text\nAnother end." and got[3]["text"] == "" and got[3]["n_removed"] == 4
    assert got[4]["text"] is None and got[4]["n_units"] == 0 and got[5]["text"] == "" and got[None]["text"] == "x"
    cleaned = linededup.delete_repeated_lines(odd)
    assert cleaned.count() == len(ODD) and set(odd.columns) <= set(cleaned.columns)
    assert len(next(r["text"] for r in cleaned.collect() if r["doc_id"] == 8)) < 300  # it repeats itself


def deleted_units(rows):
    """Units that a run deletes: all windows of one to three units with LEAST words, and all of four."""
    cut = {i: [u.strip(linededup.WHITE) for u in re.split(linededup.UNIT_BREAK, t) if u] for i, t in rows}
    words = lambda us: sum(u.count(" ") + 1 for u in us if u)
    seen, gone = set(), {}
    for i in sorted(cut):
        hit = set()
        for a in range(len(cut[i])):
            for k in range(1, min(4, len(cut[i]) - a) + 1):
                w = tuple(cut[i][a : a + k])
                if k == 4 or words(w) >= linededup.LEAST:
                    hit |= set(range(a, a + k)) if w in seen else set()
                    seen.add(w)
        runs = []
        for j in sorted(hit):
            runs = [*runs[:-1], [*runs[-1], j]] if runs and runs[-1][-1] == j - 1 else [*runs, [j]]
        gone[i] = sum(len(r) for r in runs if words([cut[i][j] for j in r]) >= linededup.LEAST)
    return gone


def test_line_dedup_finds_repeats_of_few_units(spark, docs):
    line = lambda name, n: " ".join(f"{name}{j}" for j in range(n)) + "\n"
    parts = [line("a", 20) + line("b", 20) + line("c", 20), line("d", 40) + line("e", 28), line("f", 30), line("g", 13) + line("h", 3) + line("i", 13), line("k", 20) + line("l", 20) + line("m", 3), line("n", 3) + line("o", 30)]
    rows = [(9 * i + j, f"own {i} {j}\n" * (j > 0) + p + f"end {i} {j}\n" * (j > 1)) for i, p in enumerate(parts) for j in range(3)]
    rng = np.random.default_rng(7)
    rows += [(100 + i, "".join(line(f"r{k}_", int(3 + 5 * k)) for k in rng.integers(0, 6, 8))) for i in range(40)]
    got = {r["doc_id"]: r for r in linededup.delete_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["n_removed"] for i, r in got.items()} == deleted_units(rows)
    assert all(got[9 * i]["n_removed"] == 0 and got[9 * i + 1]["text"] == f"own {i} 1\n" and got[9 * i + 2]["text"] == f"own {i} 2\nend {i} 2\n" for i in range(len(parts)))
    given = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert {r["doc_id"]: r["n_removed"] for r in linededup.delete_repeated_lines(docs).collect()} == deleted_units(given)


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality(odd, docs):
    for table in (odd, docs):
        want = sorted((r["doc_id"] or -1, *base_counts(r["text"])) for r in table.collect())
        got = quality.judge_quality(table).collect()
        assert sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
        assert not [r for r in got if r["kept"] and r["base_failed"]]
    assert quality.judge_quality(odd.limit(0)).count() == 0 and quality.keep_good(docs).columns == docs.columns


def letter_words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def test_common_words_are_whole_words(spark, docs):
    want = {}
    for r in docs.collect():
        want.setdefault(r["lang"], Counter()).update(letter_words(r["text"]))
    got = {r["_lang"]: r["_common"] for r in quality.common_words(docs, "text", "lang").collect()}
    assert got == {k: sorted(sorted(c, key=lambda w: (-c[w], w))[: quality.COMMON]) for k, c in want.items()}
    assert "que" in got["es"] and "und" in got["de"] and "les" in got["fr"] and "the" in got["en"]
    rows = [(1, "La Nación, «también» la NACIÓN; été. - Ελλάδα", "es"), (2, "nación", "es"), (3, None, "es"), (4, "12 - 3", "es")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = ["ελλάδα", "la", "nación", "también", "été"]
    assert quality.common_words(table, "text", "lang").first()["_common"] == sorted(common)
    hits = {r["_key"]: r["_hits"] for r in quality.measured(table, "doc_id", "text", "lang").collect()}
    assert hits == {1: [2.0, 2.0, 1.0, 1.0, 1.0, 0.0], 2: [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 3: [0.0] * 6, 4: [0.0] * 6}  # the last is what is no common word


def test_counts_of_random_texts(spark):
    rng = np.random.default_rng(2)
    bits = ["a", "b", "cé", "É", "12", "#", "* ", " ", "\n", "\n\n", "\t", ".", "the end ", "\u00a0", "a b c a b c "]
    texts = ["".join(rng.choice(bits, rng.integers(0, 80))) for _ in range(300)] + ["x " * 300, "p q r " * 2, "a b a b a b a"]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))).collect()}
    assert all(base_counts(t) == tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i, t in enumerate(texts))


def test_licences(spark):
    cases = ["Copyright (c) 2020 Me\n\n" + licenses.MIT.replace("license", "licence").upper(), None, "...", "Some text.\nReleased under the MIT Licence\n", "SPDX-License-Identifier: MIT", licenses.ISC + " more"]
    got = licenses.scan_licences(spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id long, text string, licence_id string")).orderBy("doc_id").collect()
    assert [(r["licence_id"], r["line_licences"]) for r in got] == [("MIT", ""), (None, ""), (None, ""), (None, "MIT"), ("MIT", "MIT"), (None, "")]
    assert got[1]["text_digest"] is None and got[2]["text_digest"] is None


def test_licence_files_in_usual_forms(spark):
    wrap = lambda t: "\n".join(textwrap.fill(x, 72) for x in t.split("\n"))
    heads = {
        "MIT": ["MIT License", "The MIT License (MIT)", "# The MIT Licence"], "ISC": ["ISC License", "ISC License (ISC)"], "Zlib": ["zlib License", "The zlib/libpng License"],
        "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'],
        "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "BSD-3-Clause"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    }
    lines = ["Copyright (c) 2020 X", "Copyright Acme Inc., 2020", "Copyright: 2020-2024, Acme", "Copyright [year] [fullname]", "© 2020 X", "Portions Copyright (C) 1999 Y\nAll rights reserved.", " * Copyright 2020 X", "SPDX-FileCopyrightText: 2020 X"]
    texts = dict(licenses.LICENCES[5::-1])
    cases = [(name, f"{h}\n\n{c}\n\n{wrap(texts[name])}\n") for name in heads for h in heads[name] for c in lines]
    long = [(name, (files("gridfolk.llm") / "licence_texts" / f"{file}.txt").read_text()) for name, file in licenses.FILES]
    cases += long + [(n, t.partition(licenses.TERMS_END)[0]) for n, t in long if licenses.TERMS_END in t] + [(None, t + "\nOne more term.") for _, t in cases]
    cases += [("Apache-2.0", dict(long)["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Acme").replace("http://", "https://"))]
    got = licenses.scan_licences(spark.createDataFrame(list(enumerate(t for _, t in cases)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licence_id"] for r in got} == dict(enumerate(n for n, _ in cases))
    prose = ["The mit of it", "copyright holders be liable for any claim", "BSD is a system", "Copyright law is old.", "Released under the MIT License.", "The new one"]
    kept = spark.createDataFrame([(x,) for x in prose], "t string").select(licenses.canonical_line(F.col("t"))).collect()
    assert all(r[0] for r in kept)


ITEMS = [lambda n: f"{n + 1}. ", lambda n: f"({n + 1}) ", lambda n: f"{'abc'[n]}) ", lambda n: f"{'i' * (n + 1)}. ", lambda n: "* ", lambda n: "- ", lambda n: "", lambda n: f" *  {n + 1}.  ", lambda n: f"    {n + 1}) "]


@pytest.mark.parametrize("item", range(len(ITEMS)))
def test_licences_whatever_numbers_their_items(spark, item):
    texts = [("BSD-2-Clause", licenses.BSD_2), ("BSD-3-Clause", licenses.BSD_3), ("Zlib", licenses.ZLIB)]
    cases = []
    for name, text in texts:
        for gap, width in (("\n", 0), ("\n\n", 72), ("\n", 60)):
            lines, n = [], 0
            for line in text.split("\n"):
                marked = re.sub("^[123]\\. ", "", line)
                lines.append((ITEMS[item](n) if marked != line else "") + marked)
                n += marked != line
            cases.append((name, gap.join(textwrap.fill(x, width) if width else x for x in lines)))
    cases.append((None, licenses.BSD_3.replace("2. Redistributions", "2. No redistributions")))
    # A number that ends a wrapped sentence is part of it.
    cases += [("X", "See the terms of section\n2. They hold."), (None, "See the terms of section\nThey hold."), ("X", "See the terms of section 2. They hold.")]
    table = spark.createDataFrame(list(enumerate(t for _, t in cases)), "doc_id long, text string")
    got = licenses.scan_licences(table, extra=(("X", "See the terms\nof section 2. They hold."),)).collect()
    assert {r["doc_id"]: r["licence_id"] for r in got} == dict(enumerate(n for n, _ in cases))


def test_operators_of_odd_tables(spark, odd):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judge_urls(empty).count() == 0
    twice = urlrules.judge_urls(spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in twice) == [(0, "allow"), (1, "allow"), (1, "allow")]
    clash = odd.withColumns({"n_units": F.lit(5), "n_removed": F.lit("x"), "removed": F.lit(1)})
    cleaned = linededup.delete_repeated_lines(clash)
    assert cleaned.count() == len(ODD) and linededup.delete_repeated_lines(odd.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_removed"] for r in cleaned.select("doc_id", "n_removed").collect()}[6] == 0
    long = licenses.MIT + "\n" + "more words\n" * 60_000
    rows = spark.createDataFrame([(1, licenses.MIT, "a"), (1, licenses.MIT, "b"), (2, long, "c"), (None, licenses.MIT, "d")], "doc_id long, text string, text_digest string")
    assert sorted((r["doc_id"] or 0, r["licence_id"]) for r in licenses.scan_licences(rows).collect()) == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (2, None)]
    assert licenses.scan_licences(rows.limit(0)).count() == 0


def test_pipeline_stages_of_odd_tables(spark, odd):
    good = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    table = odd.select(*good.columns).unionByName(good).unionByName(good.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, table, SF)
        assert stage(spark, table.limit(0), SF).count() == 0 and (got.columns == table.columns or name == "packing")
        assert got.count() > 0


def exact_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        far = sorted((math.sqrt(((np.asarray(v, float) - np.asarray(w, float)) ** 2).sum()), i) for i, w in rows if i != q)
        out[q] = far[:k]
    return out


def test_nearest_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = exact_nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = {}
    for r in ann.nearest(vectors, vectors.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want) and all(len(v) == 10 for v in got.values())


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = 20 * rng.normal(size=(12, 16))
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16))).astype(np.float32)


@pytest.mark.parametrize("shard_size, points", [(125, None), (600, clustered(2500)), (ann.SHARD, np.random.default_rng(1).normal(size=(2500, 16)))])
def test_recall_of_many_shards_and_of_one(spark, monkeypatch, shard_size, points):
    index = ann.index_vectors
    monkeypatch.setattr(ann, "index_vectors", lambda rows: index(rows, shard_size=shard_size))
    if points is None:
        vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    else:
        kind = "float" if points.dtype == np.float32 else "double"
        vectors = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(points)], f"vec_id long, embedding array<{kind}>")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = exact_nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got, by_id = {}, dict(rows)
    for r in ann.nearest(vectors, vectors.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert r["score"] == pytest.approx(math.sqrt(((np.array(by_id[r["query_id"]]) - np.array(by_id[r["vec_id"]])) ** 2).sum()), rel=1e-14)
    assert sum(len({i for _, i in want[q]} & got[q]) for q in want) >= 0.9 * 10 * len(want)


def test_the_index_moves_once_however_many_queries(spark):
    points = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(clustered(900))], "vec_id long, embedding array<float>")
    rows = ann.usable(points, "vec_id", "embedding")
    index = ann.index_vectors(rows, 200)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for queries in (rows.filter("_id < 10"), rows):
            found = ann.search(index, queries, 3)
            assert found.select("_query").distinct().count() == queries.count()
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and plan.count("Generate") == 1 and "Join" not in plan  # only queries are copied
            assert plan[plan.index("Generate") :].count("_points") == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_graph_reaches_every_node():
    for points in (clustered(1500), clustered(1500, 5) * np.float32(100)):
        edges, entry = ann.build_graph(points, degree=6, beam=12)
        assert ann.reachable(edges, entry).all()
    edges = np.full((5, 2), -1)
    edges[0, 0] = 1
    assert ann.reachable(ann.with_every_node(np.arange(5.0)[:, None], edges, 0, 4), 0).all()


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [])] + [(200 + i, [5.0, 5.0]) for i in range(30)]
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(v, v.filter("vec_id in (0, 3, 8)")).orderBy("query_id", "rank").collect()]
    assert [x[2] for x in got] == [1, 100, 2, *range(200, 207)] and [x[1] for x in got] == list(range(1, 11)) and got[2][3] == math.sqrt(5.0)
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


ENCODERS = [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")]
BITS = ["a", "B", "the", "Über", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "'", "'s", "ß", "İ", "Σ", "ñ", "\u0301", "\u00a0", "\u3000", "\u2028", "\x85", "\x1c", "\0", "“", "日本", "12", "3.14", "<|endoftext|>", "<x", "(y)", "a-longer-word-than-sixteen-bytes"]


def encoded(enc, texts, end):
    return [x.tolist() for _, _, ids, counts in enc.encode(pa.array(texts, pa.string()), end) for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=14).map("".join), min_size=1, max_size=5), st.sampled_from(ENCODERS))
def test_pieces_have_the_ids_of_the_whole_text(texts, which):
    enc = tokens.encoder(tokens.public_tokenizer(which[0]), which[1])
    assert encoded(enc, texts, 7) == [[*enc.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]


@pytest.mark.parametrize("which", ENCODERS)
def test_ids_of_whole_documents(docs, monkeypatch, which):
    texts = [r["text"] or "" for r in docs.collect()] + [LONG + "end", "", " "]
    enc = tokens.PieceEncoder(tokens.public_tokenizer(which[0]), which[1])
    want = [[*x.ids, 1] for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoded(enc, texts, 1) == want
    monkeypatch.setattr(tokens, "SLICE", 5000)  # long texts in parts
    monkeypatch.setattr(tokens, "REMEMBERED", 3000)  # and a table that is begun anew
    assert encoded(enc, texts, 1) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_ranks_come_back(ranks):
    ranks = np.array(ranks, np.uint32)
    assert (tokenids.unpack_ranks(*tokenids.pack_ranks(ranks), len(ranks)) == ranks).all()


def ids_of(text, name, end):
    return [*tokens.encoder(tokens.public_tokenizer(name), "words").tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_token_files(spark, odd, docs):
    for table in (docs, odd):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        ids = [ids_of(t, "word_bpe_49k.json", 1) for _, t in rows]
        starts = np.cumsum([0] + [len(x) for x in ids])
        want = [(d, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), s, x in zip(rows, starts, ids, strict=False)]
        assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenids.token_files(table).collect()), key=lambda r: r[1]) == want
    path = tokenids.write_token_files(docs)
    got = {r["doc_id"]: r["ids"] for r in tokenids.read_token_files(spark.newSession(), path, with_ids=True).collect()}
    assert got == {r["doc_id"]: ids_of(r["text"], "word_bpe_49k.json", 1) for r in docs.collect()}
    assert tokenids.token_files(odd.limit(0)).count() == 0


def test_packing(odd, docs):
    enc = tokens.encoder(tokens.public_tokenizer("byte_bpe_50k.json"), "bytes").tokenizer
    for table, capacity in ((docs, 1024), (odd, 64)):
        got = packing.pack_documents(table, capacity, with_ids=True).collect()
        want = Counter((r["doc_id"], *enc.encode(r["text"] or "", add_special_tokens=False).ids, 2) for r in table.collect())
        by_doc = {}
        for r in got:
            by_doc.setdefault(r["doc_id"], []).append(r)
        counts = Counter(k[0] for k in want.elements())
        for key in want:
            rs = sorted(by_doc[key[0]], key=lambda r: r["piece"])
            if counts[key[0]] == 1:
                assert [i for r in rs for i in r["ids"]] == list(key[1:]) and all(r["length"] == capacity for r in rs[1:])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] for r in got)
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append(r)
        for rs in sequences.values():
            at = 0
            for r in sorted(rs, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= capacity
        bound = packing.lower_bound(Counter(r["length"] for r in got), capacity)
        assert len(sequences) <= bound + 1
    assert packing.pack_documents(odd.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8))
def test_plans_are_whole_and_no_worse_than_best_fit(counts):
    plan = packing.BinCompletion(counts, 40, nodes=300).solve()
    used = Counter()
    for times, filling in plan:
        assert sum(n * k for n, k in filling) <= 40
        for n, k in filling:
            used[n] += times * k
    bins = sum(m for m, _ in plan)
    assert used == counts and packing.lower_bound(counts, 40) <= bins <= sum(m for m, _ in packing.best_fit(counts, 40))


def fewest_bins(pieces, capacity):
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= pieces[i]}:
            at = rooms.index(room)
            place(i + 1, rooms[:at] + (room - pieces[i],) + rooms[at + 1 :])
        place(i + 1, (*rooms, capacity - pieces[i]))

    place(0, ())
    return best


def test_plans_are_best():
    counts = {522: 600, 276: 600, 266: 600, 236: 1200}
    assert sum(m for m, _ in packing.BinCompletion(counts, 1024).solve()) == 900 < sum(m for m, _ in packing.best_fit(counts, 1024))
    rng, better = np.random.default_rng(3), 0
    for _ in range(400):
        counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(3, 20), 5, replace=False), rng.integers(1, 4, 5), strict=True)}
        search = packing.BinCompletion(counts, 30)
        plan = search.solve()
        assert all(sum(n * k for n, k in f) <= 30 for _, f in plan) and Counter({n: sum(m * dict(f).get(n, 0) for m, f in plan) for n in counts}) == counts
        assert search.proved and sum(m for m, _ in plan) == fewest_bins(sorted(Counter(counts).elements(), reverse=True), 30)
        better += sum(m for m, _ in plan) < sum(m for m, _ in packing.best_fit(counts, 30))
    assert better


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "mixing", "packing"]
    now = docs
    good = {r["doc_id"] for r in quality.judge_quality(docs).filter("kept").collect()}
    after = []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        after.append(now)
    assert all(d.columns == docs.columns for d in after[:-1])
    assert {r["doc_id"] for r in after[0].collect()} == good
    cleaned = {r["doc_id"]: r["text"] for r in linededup.delete_repeated_lines(after[0]).collect()}
    assert {r["doc_id"]: r["text"] for r in after[1].collect()} == {k: v for k, v in cleaned.items() if v.strip()}
    _, part = brute_components([(r["doc_id"], r["text"]) for r in after[1].collect()], 5, 80)
    assert sorted(r["doc_id"] for r in after[2].collect()) == sorted(i for i, p in part.items() if i == p)
    assert {r["doc_id"] for r in after[3].collect()} <= {r["doc_id"] for r in after[2].collect()}
    assert after[4].select(F.sum("length")).first()[0] >= after[3].count()
    assert corpus_pipeline.run(spark, SF).count() == after[4].count()
