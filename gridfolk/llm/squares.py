"""Sum-of-squares packing of documents into windows: one pass, no shuffle.

Each task packs the documents of its partition as they come. A document goes
to the open window, or a new one, for which the sum of the squared numbers of
windows at each fill level stays smallest; so no level collects many windows
that wait for the same missing length. Only the level array is searched.

Windows are padded unless they are full or their length is a power of two.
Those still open at the end are filled from each other by cutting, and what
is over is cut into powers of two; so a task leaves at most one short window
for each power, and no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import importable
from .tokens import encoder, public_tokenizer

#: Windows that a task holds open at most (each of up to ``capacity`` ids); more are closed by cutting.
OPEN = 2048
#: Pieces in a batch of results.
ROWS = 4096
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
KIND = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Piece = tuple[int | None, int, int, np.ndarray]  # document, its tokens, start, ids


class Levels:
    """How many windows are open at each level, kept by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        # How the sum of squares changes if a window leaves, or comes to have, some room. Full and empty ones don't count.
        self.leave = np.full(capacity + 1, 1 << 40)
        self.enter = np.ones(capacity + 1, np.int64)
        self.leave[capacity] = self.enter[0] = 0

    def best(self, size: int) -> int:
        """The room of the window to take, ``capacity`` for a new one; of equals the fullest."""
        return size + int((self.leave[size:] + self.enter[: self.capacity + 1 - size]).argmin())

    def change(self, room: int, by: int) -> None:
        if 0 < room < self.capacity:
            self.count[room] += by
            n = self.count[room]
            self.leave[room], self.enter[room] = (1 - 2 * n if n else 1 << 40), 1 + 2 * n


class Windows:
    """Open windows by the room they have left; :meth:`add` and :meth:`finish` give those that are done."""

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most, self.levels = capacity, most, Levels(capacity)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)
        self.n = 0

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        n = len(ids)
        rest = n % self.capacity
        for start in range(0, n - rest, self.capacity):
            yield [(doc, n, start, ids[start : start + self.capacity])]
        if not rest:
            return
        room = self.levels.best(rest)
        new = room == self.capacity
        window = [] if new else self.open[room].pop()
        window.append((doc, n, n - rest, ids[n - rest :].copy()))  # a copy, so that the batch of ids can go
        self.levels.change(room, -1)
        self.n += new
        if room == rest:
            self.n -= 1
            yield window
            return
        self.levels.change(room - rest, 1)
        self.open[room - rest].append(window)
        if self.n > self.most:
            yield from self.close()

    def close(self) -> Iterator[list[Piece]]:
        """Fill the fullest windows with ids of the emptiest, which are cut where need be; one stays open."""
        queue = [(room, window) for room in sorted(self.open) for window in self.open[room]]
        first, last = 0, len(queue) - 1
        room = queue[0][0] if queue else 0
        while first < last:
            taker, giver = queue[first][1], queue[last][1]
            doc, n, start, ids = giver.pop()
            taker.append((doc, n, start, ids[:room]))
            if len(ids) > room:
                giver.append((doc, n, start + room, ids[room:]))
            room -= min(room, len(ids))
            if not room:
                yield taker
                first += 1
                room = self.capacity - sum(len(p[3]) for p in queue[first][1])
            if not giver:
                last -= 1
        self.levels, self.open, self.n = Levels(self.capacity), defaultdict(list), 0
        if first == last and queue[first][1]:
            self.levels.change(room, 1)
            self.open[room], self.n = [queue[first][1]], 1

    def finish(self) -> Iterator[list[Piece]]:
        """All that is open: full windows, then windows of falling powers of two."""
        yield from self.close()
        rest = [p for windows in self.open.values() for window in windows for p in window]
        left = sum(len(p[3]) for p in rest)
        while left:
            room, window = 1 << left.bit_length() - 1, []
            left -= room
            while room:
                doc, n, start, ids = rest.pop(0)
                window.append((doc, n, start, ids[:room]))
                if len(ids) > room:
                    rest.insert(0, (doc, n, start + room, ids[room:]))
                room -= len(window[-1][3])
            yield window
        self.levels, self.open, self.n = Levels(self.capacity), defaultdict(list), 0


def pack_windows(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, kind: str = "words", end_id: int = 2, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into windows of at most ``capacity`` ids without padding.

    Returns a row for each piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, if asked for, ids. A document of
    more than ``capacity`` ids fills windows of its own first; only the rest
    is placed, whole but where open windows are closed. Null and empty texts
    are one id; repeated rows and null ids are documents of their own; other
    columns are ignored; an empty table gives an empty table. A task holds
    at most :data:`OPEN` windows; a task that is run again packs the same.
    """
    importable(docs.sparkSession)
    path = tokenizer or public_tokenizer("word_bpe_49k.json")

    def packed(batches):
        enc, windows, part = encoder(path, kind), Windows(capacity), TaskContext.get().partitionId()
        number, held = part << 40, []

        def out():
            columns = [pa.array([p[k] for p in held], t) for k, t in enumerate([pa.int64()] * 7)]
            if with_ids:
                columns.append(pa.array([p[7] for p in held], pa.list_(pa.int64())))
            return pa.record_batch(columns, NAMES + ["ids"] * with_ids)

        def hold(done):
            nonlocal number
            for window in done:
                at = 0
                for doc, n, start, ids in window:
                    octets = ids.astype("<u4", copy=False).tobytes()
                    held.append((doc, start, len(ids), zlib.crc32(octets), n, number, at, ids if with_ids else None))
                    at += len(ids)
                number += 1

        for batch in batches:
            for a, b, ids, counts in enc.encode(batch.column(1), end_id):
                ends = np.cumsum(counts).tolist()
                for doc, end, count in zip(batch.column(0)[a:b].to_pylist(), ends, counts.tolist(), strict=True):
                    hold(windows.add(doc, ids[end - count : end]))
                    if len(held) >= ROWS:
                        yield out()
                        held.clear()
        hold(windows.finish())
        if held:
            yield out()

    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    return rows.mapInArrow(packed, KIND + ", ids array<long>" * with_ids)
