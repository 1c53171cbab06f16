"""URL filter: wildcard rules matched by a bit-parallel automaton.

Every rule becomes a run of bits in one multiword Shift-And mask. One pass
over the bytes of a URL advances all rules at once:

    D' = ((D << 1) & MATCH[byte]) | (D & LOOP[byte])

A rule is ``host-glob/path-glob``; ``*`` stands for any run and ``?`` for any
one byte. A host glob fits the host and its subdomains, a path glob fits
paths that start with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import importable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Neither a host nor a path holds this byte, so it parts them in the canonical form.
SEPARATOR = "#"

#: Rules that are reported by name.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs that decide where no named rule fits; without any fit the verdict is allow.
GLOBS = (("block", "*spam-farm*/"), ("block", "*casino*/"), ("block", "*cheap-pills*/"))


@dataclass(frozen=True)
class Automaton:
    """``word`` and ``bit`` give the accepting bit of each rule."""

    start: np.ndarray
    match: np.ndarray
    loop: np.ndarray
    settled: np.ndarray
    word: np.ndarray
    bit: np.ndarray

    @staticmethod
    def build(rules: list[str]) -> Automaton:
        texts = []
        for rule in rules:
            host, slash, path = rule.partition("/")
            texts.append(("*." + host, slash + path + "*"))
        size = sum(len((h + SEPARATOR + p).replace("*", "").encode()) + 1 for h, p in texts)
        words = max(1, -(-size // 64))
        start, settled = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        match, loop = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        word, bit, at = [], [], 0

        def put(table: np.ndarray, k: int) -> None:
            table[..., k // 64] |= np.uint64(1 << (k % 64))

        for host, path in texts:
            put(start, at)
            for part, in_host in ((host, True), (SEPARATOR, True), (path, False)):
                for c in part.encode():
                    if c == ord("*"):
                        put(loop, at)
                        if in_host:
                            loop[ord(SEPARATOR), at // 64] &= ~np.uint64(1 << (at % 64))
                    else:
                        at += 1
                        for byte in range(256) if c == ord("?") else (c,):
                            if not (c == ord("?") and byte == ord(SEPARATOR)):
                                put(match[byte], at)
            put(settled, at)
            word.append(at // 64)
            bit.append(at % 64)
            at += 1
        return Automaton(start, match, loop, settled, np.array(word, int), np.array(bit, np.uint64))

    def run(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each rule: does the rule fit?"""
        sizes = np.fromiter(map(len, urls), np.int64, len(urls))
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(urls) else sizes
        flat = np.frombuffer(b"".join(urls), np.uint8)
        state = np.tile(self.start, (len(urls), 1))
        live = np.argsort(-sizes, kind="stable")
        step = 0
        while True:
            live = live[: np.searchsorted(-sizes[live], -step, "left")]  # longest first: those with a byte left
            if step % 16 == 15:  # settled rules keep their bit; without other bits nothing changes any more
                live = live[(state[live] & ~self.settled).any(axis=1)]
            if not len(live):
                break
            byte, old = flat[begins[live] + step], state[live]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[live] = (moved & self.match[byte]) | (old & self.loop[byte])
            step += 1
        return (state[:, self.word] >> self.bit & np.uint64(1)).astype(bool)


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both are empty without ``://`` or for a null url."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def judge_urls(pages: DataFrame, rules=RULES, globs=GLOBS, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    The longest fitting rule wins; of equal length block goes before allow,
    then the smaller text. ``rule`` is null where only a glob or nothing
    fits; the longest fitting glob, else ``default``, then gives the verdict.
    Null, empty, host-less and very long urls are judged like any other,
    repeated rows alike; other columns stay. Columns already named like the
    four results are replaced. An empty table gives an empty table.
    """
    importable(pages.sparkSession)
    ranked = [(v, r, True) for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[0] != "block", x[1]))]
    ranked += [(v, r, False) for v, r in sorted(globs, key=lambda x: (-len(x[1]), x[0] != "block", x[1]))]
    automaton = Automaton.build([r for _, r, _ in ranked])
    names = np.array([r if named else None for _, r, named in ranked] + [None], object)
    verdicts = np.array([v for v, _, _ in ranked] + [default], object)

    @F.pandas_udf("rule string, verdict string")
    def judged(canonical: pd.Series) -> pd.DataFrame:
        fits = automaton.run([x.encode("utf-8", "surrogatepass") for x in canonical])
        first = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked)) if len(ranked) else np.zeros(len(canonical), int)
        return pd.DataFrame({"rule": names[first], "verdict": verdicts[first]})

    found = with_host_and_path(pages.drop("rule", "verdict"), url)
    found = found.withColumn("_judged", judged(F.concat(F.lit("."), "host", F.lit(SEPARATOR), "path")))
    return found.withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged")
