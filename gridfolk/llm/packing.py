"""Best-fit packing of token pieces into sequences by bin completion.

Only the lengths matter for packing, and there are at most ``capacity``
different ones. So the search works on how many pieces each length has, and
its plan is a list of patterns: a filling of one sequence and how many
sequences are filled that way. Each pattern uses up some length, so the plan
has a bounded number of lines, whatever the number of documents. Pieces are
numbered within their length and look up their place in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import importable, staged
from .tokens import encoder, public_tokenizer

PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"]
Pattern = tuple[int, tuple[tuple[int, int], ...]]  # sequences, ((length, pieces of it in each), ...)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: bounds by the sum and, for each threshold, by pieces too large to meet."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for k in [n for n in counts if n <= capacity // 2] + [0]:
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        half = {n: c for n, c in counts.items() if capacity // 2 < n <= capacity - k}
        free = capacity * sum(half.values()) - sum(n * c for n, c in half.items())
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity // 2 and n)
        best = max(best, alone + sum(half.values()) + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: pieces go to the fullest open sequences that have room."""
    open_: dict[int, dict[tuple, int]] = {}  # room left -> filling -> sequences
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(length, capacity):
            for filling in list(open_.get(room, ())):
                if not left:
                    break
                fit = room // length
                have = open_[room][filling]
                whole, rest = divmod(min(left, have * fit), fit)
                moves = [(whole, fit)] + ([(1, rest)] if rest else [])
                used = sum(m for m, _ in moves)
                open_[room][filling] -= used
                if not open_[room][filling]:
                    del open_[room][filling]
                for m, k in moves:
                    if m:
                        to = open_.setdefault(room - k * length, {})
                        to[(*filling, (length, k))] = to.get((*filling, (length, k)), 0) + m
                        left -= m * k
        if left:
            fit = capacity // length
            whole, rest = divmod(left, fit)
            for m, k in ((whole, fit), (1, rest)):
                if m and k:
                    to = open_.setdefault(capacity - k * length, {})
                    to[((length, k),)] = to.get(((length, k),), 0) + m
    return [(m, filling) for fillings in open_.values() for filling, m in fillings.items()]


def smeared(bits: int, by: int) -> int:
    """Each set bit, and the ``by`` bits above it."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


@dataclass
class BinCompletion:
    """Branch and bound over fillings of the sequence that holds the largest piece left.

    A filling is dominated if a piece left over could be added to it, or could
    take the place of some of its pieces that together are no larger: by a
    swap with the sequence that has that piece, any packing becomes one with
    the better filling, which has less waste or the same in fewer pieces. All
    undominated fillings are made, of any number of pieces, one at a time as
    the search asks: least waste first, then largest pieces first. Each is
    tried for every number of sequences, the most first; those that share the
    largest piece take later fillings only. A branch ends as soon as its waste
    exceeds what a packing better than the incumbent may waste.

    A quick search of the first ``tries`` fillings, each as often as it goes,
    comes before this for a better incumbent. ``nodes`` bounds either search,
    and ``steps`` the pieces that its fillings are made of; the incumbent is
    always whole, and ``proved`` says that none is better.
    """

    counts: dict[int, int]
    capacity: int
    nodes: int = 4_000
    steps: int = 200_000
    tries: int = 3
    proved: bool = False
    _steps: int = 0

    def fillings(self, left: list[int], room: int, after: tuple | None, slack) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
        """Waste and undominated filling of ``room`` by pieces of ``left``, in order, later than ``after``; ``slack()`` is the most waste of use."""
        lengths = [n for n in range(min(room, len(left) - 1), 0, -1) if left[n]]
        reach = [1]  # sums that the lengths from one on can make, as bits
        for n in reversed(lengths):
            sums, more, k = reach[-1], min(left[n], room // n), 1
            while more:  # as many pieces as there are, by doubling
                k = min(k, more)
                sums |= sums << k * n
                more, k = more - k, 2 * k
            reach.append(sums & ((2 << room) - 1))
        reach.reverse()
        present = sum(1 << n for n in lengths)

        def walk(i: int, goal: int, waste: int, filling: tuple, ones: int, many: int, free: int, bound: tuple | None) -> Iterator[tuple]:
            """Fillings that go on with lengths from ``i``. ``ones`` and ``many`` are sums of one and of more pieces, ``free`` the lengths with a piece left over."""
            self._steps -= 1
            if not goal:
                if bound is None and not free & ((2 << waste) - 1):  # else it was made before, or a piece could be added
                    yield waste, filling
                return
            for j in range(bisect_left(lengths, -goal, i, key=lambda n: -n), len(lengths)):
                n = lengths[j]
                if not reach[j] >> goal & 1 or self._steps < 0:
                    return
                one, some = ones, many
                ends = []
                for k in range(1, min(left[n], goal // n) + 1):
                    one, some = one | 1 << n, some | (one | some) << n
                    spare = free & ~(1 << n) if k == left[n] else free
                    if spare & (smeared(some, waste) | (smeared(one << 1, waste - 1) if waste else 0)):
                        break  # dominated, and with more pieces as well: what could take their place is larger than all to come
                    if reach[j + 1] >> (goal - k * n) & 1:
                        ends.append((k, one, some, spare))
                for k, one, some, spare in reversed(ends):
                    at = bound[0] if bound else None
                    if at is None or (n, k) <= at:
                        yield from walk(j + 1, goal - k * n, waste, (*filling, (n, k)), one, some, spare, bound[1:] if (n, k) == at else None)

        for waste in range(after[0] if after else 0, room + 1):
            if waste > slack() or self._steps < 0:
                return
            if reach[0] >> (room - waste) & 1:
                yield from walk(0, room - waste, waste, (), 0, 0, present, after[1] if after and waste == after[0] else None)

    def solve(self) -> list[Pattern]:
        incumbent = best_fit(self.counts, self.capacity)
        most, least = sum(m for m, _ in incumbent), lower_bound(self.counts, self.capacity)
        total = sum(n * c for n, c in self.counts.items())

        def branches(left: list[int], todo: int, used: int, after: tuple | None, quick: bool) -> Iterator[tuple]:
            """The pattern, and what is left after it."""
            largest = max(n for n, c in enumerate(left) if c)
            others = list(left)
            others[largest] -= 1
            slack = lambda: (most - 1 - used) * self.capacity - todo  # noqa: E731  waste of a packing better than the incumbent
            for waste, filling in islice(self.fillings(others, self.capacity - largest, after, slack), self.tries if quick else None):
                pieces = dict(filling)
                pieces[largest] = pieces.get(largest, 0) + 1
                top = min(left[n] // k for n, k in pieces.items())
                for times in range(top, top - 1 if quick else 0, -1):
                    if waste * times > slack():
                        continue
                    rest = list(left)
                    for n, k in pieces.items():
                        rest[n] -= times * k
                    pattern = (times, tuple(sorted(pieces.items(), reverse=True)))
                    yield pattern, rest, todo - times * (self.capacity - waste), used + times, (waste, filling) if rest[largest] and not quick else None

        start = [0] * (self.capacity + 1)
        for n, c in self.counts.items():
            start[n] = c
        for quick in (True, False):
            visited, self._steps, plan = 0, self.steps, []
            frames = [branches(start, total, 0, None, quick)] if most > least else []
            while frames and most > least and visited < self.nodes and self._steps >= 0:
                found = next(frames[-1], None)
                if found is None:
                    frames.pop()
                    continue
                visited += 1
                pattern, left, todo, used, after = found
                plan = [*plan[: len(frames) - 1], pattern]
                if not todo:
                    if used < most:
                        incumbent, most = plan, used
                elif used - (-todo // self.capacity) < most:
                    frames.append(branches(left, todo, used, after, quick))
            self.proved = most <= least or (not quick and not frames and self._steps >= 0)
        assert sum(m * n * k for m, f in incumbent for n, k in f) == total
        return incumbent


def placement_table(plan: list[Pattern]) -> pd.DataFrame:
    """For each length, runs of piece numbers: ``first`` number, pieces in each sequence, first sequence, place of the first piece."""
    rows, next_number, sequence = [], {}, 0
    for times, filling in plan:
        at = 0
        for length, each in filling:
            first = next_number.get(length, 0)
            rows.append((length, first, each, sequence, at))
            next_number[length] = first + times * each
            at += length * each
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "at"]).sort_values(["length", "first"], ignore_index=True)


def cut_pieces(docs: DataFrame, path: str, kind: str, end_id: int, capacity: int, with_ids: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces: all of ``capacity`` ids but the first, which takes what is over."""

    def pieces(batches):
        enc, part, number = encoder(path, kind), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, _, ids, n in enc.encode(batch.column(1), end_id):
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = (n - 1) % capacity + 1
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                octets, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.append(0, np.cumsum(length))
                crc = [zlib.crc32(octets[x:y]) for x, y in pairwise((4 * ends).tolist())]
                columns = [batch.column(0).take(pa.array(a + row)), *(pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (np.full(len(row), part), pa.int32()), (np.arange(number, number + len(row)), pa.int64())))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64())))
                number += len(row)
                yield pa.record_batch(columns, PIECE_NAMES + ["ids"] * with_ids)

    kind_ = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long" + ", ids array<long>" * with_ids
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)).mapInArrow(pieces, kind_)


def number_in_length(pieces: DataFrame) -> DataFrame:
    """Add ``nth``, 0 and up within each length: the number in the writer's partition, after all earlier partitions.

    No length's pieces meet in one task, however common the length is.
    """
    local = Window.partitionBy("part", "length").orderBy("number")
    counts = pieces.groupBy("part", "length").count()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    numbered = pieces.withColumn("_local", F.row_number().over(local) - 1)
    return numbered.join(offsets, ["part", "length"]).withColumn("nth", F.col("_local") + F.col("_before")).drop("_local", "_before")


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, kind: str = "bytes", end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` ids.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset and, if asked for, ids. Null and empty texts are one
    id; repeated rows and null ids are documents of their own; other columns
    are ignored; an empty table gives an empty table. The driver sees the
    number of pieces of each length and makes the plan, both of bounded size.
    """
    importable(docs.sparkSession)
    pieces = staged(cut_pieces(docs, tokenizer or public_tokenizer("byte_bpe_50k.json"), kind, end_id, capacity, with_ids))
    counts = {x["length"]: x["count"] for x in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = placement_table(BinCompletion(counts, capacity).solve())
    lengths, firsts = table["length"].to_numpy(np.int64), table["first"].to_numpy(np.int64)
    each, sequence, at = (table[c].to_numpy(np.int64) for c in ("each", "sequence", "at"))
    step = max(counts.values(), default=0) + 1
    keys = lengths * step + firsts

    def placed(batches):
        for batch in batches:
            n, nth = batch["length"].to_numpy(np.int64), batch["nth"].to_numpy(np.int64)
            run = np.searchsorted(keys, n * step + nth, "right") - 1
            ahead = nth - firsts[run]
            batch["sequence_id"] = sequence[run] + ahead // each[run]
            batch["offset"] = at[run] + ahead % each[run] * n
            yield batch.drop(columns=["part", "number", "nth"])

    kind_ = "length long, doc_id long, piece int, start long, ids_crc32 long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long"
    numbered = number_in_length(pieces).select("length", "doc_id", "piece", "start", "ids_crc32", *["ids"] * with_ids, "part", "number", "nth")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return numbered.mapInPandas(placed, kind_).select(*columns)
