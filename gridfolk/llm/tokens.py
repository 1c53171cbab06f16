"""Whole texts to token ids with the tokenizers library, remembering the ids of pieces.

Texts are cut at byte places at which the library's own pattern always cuts,
so joined pieces have exactly the ids of the whole text. Numpy finds the
pieces of a slice of texts all at once, looks them up in a table of known
pieces and gathers their ids; the library sees only pieces that the table
doesn't hold. A text with white space beyond ASCII goes to the library whole
where white space matters.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa

#: Bytes that are cut into pieces at a time, and known pieces (about 80 bytes each) beyond which the table is begun anew.
SLICE, REMEMBERED = 2_000_000, 2_000_000
_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}
OTHER, SPACE, WHITE, ALNUM, MARK, STOP, LESS = range(7)
#: Marks that never are one pattern match with ASCII letters and digits; none is part of a special token.
MARKS = b'.,;:!?()"-/'


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(b"\t\n\x0b\x0c\r")] = WHITE
    out[ord(" ")] = SPACE
    out[list(MARKS)] = MARK
    out[ord("<")] = LESS  # may begin a special token, before which white space is as at the end of a text
    for first, last in (b"az", b"AZ", b"09"):
        out[first : last + 1] = ALNUM
    return out


def _cuts(kind: str) -> np.ndarray:
    """At 8 * a + b: whether there is a cut between classes a and b. 2: only if what comes after b isn't white."""
    out, blank = np.zeros(64, np.uint8), (SPACE, WHITE)
    for a in range(7):
        for b in range(7):
            if a in blank and b in blank:
                out[8 * a + b] = 2 if kind == "bytes" else 0
            elif a in blank:  # a space belongs to what follows it where white space has ids
                out[8 * a + b] = kind == "words" or (a == WHITE and b != LESS) or b == STOP
            else:
                out[8 * a + b] = b in blank or STOP in (a, b) or {a, b} == {ALNUM, MARK}
    return out


_CLASS = _classes()
_SOLID = np.array([True, False, False, True, True, True, True])
_SPLITS = np.array([True, False, False, True, True, False, False])
#: First the bytes of a piece of up to 8, then those of one of up to 15.
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(16)], np.uint64)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(16)], np.uint64)
#: Letters of one case mapping each and without parts, so that normal form and pattern leave a word of them whole.
_PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿŒœ]+")
#: The letters by which byte-level vocabularies name bytes: printable ones by themselves, the others by letters from U+0100 on.
_UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(_UNPRINTED)}
_SPACE_LETTER = chr(_BYTE_LETTERS[32])
_LEADS_WHITE = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))


class PieceEncoder:
    """``kind``: ``bytes`` (byte-level BPE, a space belongs to what follows) or ``words`` (white space is dropped)."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.cuts = Tokenizer.from_file(path), kind, _cuts(kind)
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        """The table: bytes and length of each piece in two words, where its ids begin and how many they are."""
        self.n, self.n_ids, self.long, self.stops = 0, 0, {}, {}
        self.low, self.high = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.begin, self.count, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.slots = np.full(1 << 19, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each piece in the table, or -1; places that hold another piece are followed by the next."""
        slot = self._slot(low, high)
        at = self.slots[slot]
        away = np.flatnonzero((at >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        while len(away):
            slot[away] = (slot[away] + 1) & (len(self.slots) - 1)
            at[away] = now = self.slots[slot[away]]
            away = away[(now >= 0) & ((self.low[now] != low[away]) | (self.high[now] != high[away]))]
        return at

    def _ids_of(self, pieces: list[bytes]) -> int:
        """Number of the first of the pieces, whose ids are added to the table. Plain words need only the library's model."""
        texts, found, spaced = [p.decode() for p in pieces], [[]] * len(pieces), self.kind == "bytes"
        number, tokenize, plain = attrgetter("id"), self.model.tokenize, _PLAIN_WORD.fullmatch
        for k, text in enumerate(texts):
            if plain(text, spaced and text[0] == " "):
                letters = text if spaced else text.lower()
                if not text.isascii():
                    letters = letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
                elif letters[0] == " ":
                    letters = _SPACE_LETTER + letters[1:]
                found[k] = list(map(number, tokenize(letters)))
        others = [k for k, ids in enumerate(found) if not ids]
        for k, x in zip(others, self.tokenizer.encode_batch_fast([texts[k] for k in others], add_special_tokens=False), strict=True):
            found[k] = x.ids
        return self._add([len(x) for x in found], list(chain.from_iterable(found)))

    def _add(self, counts: list[int], ids: list[int]) -> int:
        first, until = self.n, self.n + len(counts)
        while until > len(self.low):
            self.low, self.high = np.append(self.low, np.zeros_like(self.low)), np.append(self.high, np.zeros_like(self.high))
            self.begin, self.count = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.count, np.zeros_like(self.count))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.count[first:until] = counts
        self.begin[first:until] = self.n_ids + np.cumsum([0, *counts])[:-1]
        self.n, self.n_ids = until, self.n_ids + len(ids)
        return first

    def _learn(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Add pieces of up to 15 bytes, all different and none in the table."""
        first = self._ids_of([data[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        self.low[first : self.n], self.high[first : self.n] = low, high
        if 4 * self.n > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int32)
            new = np.flatnonzero(self.high[: self.n])  # long pieces have no place
        else:
            new = np.arange(first, self.n)
        slot = self._slot(self.low[new], self.high[new])
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]  # of several the last stays
            left = self.slots[slot] != new
            new, slot = new[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _numbers(self, buffer: np.ndarray, data: bytes, starts: np.ndarray, sizes: np.ndarray, stops: np.ndarray, stop_entry: int) -> np.ndarray:
        """The number of each piece in the table, ``stop_entry`` for ``stops``; ``buffer`` has 16 bytes more than the data."""
        words = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))
        short = np.minimum(sizes, 15)
        low, high = words[starts] & _LOW[short], short.astype(np.uint64) << np.uint64(56)
        wide = np.flatnonzero(sizes > 8)
        high[wide] |= words[starts[wide] + 8] & _HIGH[short[wide]]
        is_long = np.flatnonzero(sizes > 15)
        high[is_long] = np.uint64(0xFF << 56)  # never in the table
        at = self._find(low, high)
        at[is_long], at[stops] = 0, stop_entry
        while len(miss := np.flatnonzero(at < 0)):
            mixed = low[miss] * np.uint64(0xD6E8FEB86659FD93) + high[miss]
            mixed ^= mixed >> np.uint64(29)
            one = miss[np.unique(mixed, return_index=True)[1]]  # different pieces of equal hash: the next time round
            self._learn(data, starts[one], sizes[one], low[one], high[one])
            at[miss] = self._find(low[miss], high[miss])
        if len(is_long):
            pieces = [data[s : s + n] for s, n in zip(starts[is_long].tolist(), sizes[is_long].tolist(), strict=True)]
            new = list(set(pieces) - self.long.keys())
            if new:
                first = self._ids_of(new)
                self.long.update(zip(new, range(first, first + len(new)), strict=True))
            at[is_long] = [self.long[p] for p in pieces]
        return at

    def _slice(self, texts: list, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (UTF-8), with ``end_id`` after each, and how many each has."""
        if self.n > REMEMBERED:
            self.forget()
        data = b"\0".join([*texts, b""])
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        buffer = np.zeros(len(data) + 16, np.uint8)
        buffer[: len(data)] = np.frombuffer(data, np.uint8)
        kinds = _CLASS[buffer[: len(data)]]
        kinds[stops] = STOP
        pairs = kinds.copy()
        pairs[1:] |= kinds[:-1] << 3
        pairs[0] |= STOP << 3
        cut = self.cuts[pairs]
        depends = np.flatnonzero(cut == 2)
        cut[depends] = _SPLITS[kinds[depends + 1]]  # the last byte is a stop, so there is a next
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(data)))
        if self.kind == "words":
            solid = _SOLID[kinds[starts]]
            starts, sizes = starts[solid], sizes[solid]
        is_stop = np.searchsorted(starts, stops)
        at = self._numbers(buffer, data, starts, sizes, is_stop, self._stop_entry(end_id))
        counts = self.count[at]
        total = np.append(0, np.cumsum(counts))
        ids = self.ids[np.repeat(self.begin[at] - total[:-1], counts) + np.arange(total[-1])]
        return ids, np.diff(np.append(0, total[is_stop + 1]))

    def _stop_entry(self, end_id: int | None) -> int:
        """The number in the table of the id that ends a text, or of nothing."""
        if end_id not in self.stops:
            self.stops[end_id] = self._add([0 if end_id is None else 1], [] if end_id is None else [end_id])
        return self.stops[end_id]

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Slices of an array of strings without nulls: first row, row after the last, ids of its texts with ``end_id`` after each, and how many each has."""
        offset_type = "<i8" if pa.types.is_large_string(texts.type) else "<i4"
        offsets = np.frombuffer(texts.buffers()[1] or bytes(8), offset_type)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        values, row = memoryview(texts.buffers()[2] or b""), 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
            some = [values[a:b] for a, b in zip(offsets[row:last].tolist(), offsets[row + 1 : last + 1].tolist(), strict=True)]
            whole = beyond_ascii(some) if self.kind == "bytes" else []
            if len(some) == 1 and not whole:
                parts = safe_parts(some[0])
                found = [self._slice([x], end_id if k == len(parts) else None)[0] for k, x in enumerate(parts, 1)]
                ids = np.concatenate(found)
                counts = np.array([len(ids)])
            else:
                ids, counts = self._slice(some, end_id)
            if whole:  # put in place of what the pieces gave
                split = np.split(ids, np.cumsum(counts)[:-1])
                for k in whole:
                    found = self.tokenizer.encode_batch_fast([str(some[k], "utf-8")], add_special_tokens=False)[0].ids
                    split[k] = np.array([*found, end_id], np.uint32)
                ids, counts = np.concatenate(split), np.array([len(x) for x in split])
            yield row, last, ids, counts
            row = last


def beyond_ascii(texts: list) -> list[int]:
    """Which texts hold white space beyond ASCII."""
    octets = np.frombuffer(b"\0".join([*texts, b"\0\0"]), np.uint8)
    at = np.flatnonzero(_LEADS_WHITE[octets])
    a, b, c = octets[at], octets[at + 1], octets[at + 2]
    white = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    white |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return np.unique(np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at[white], "right")).tolist()


def safe_parts(text) -> list:
    """A long text in parts of about ``SLICE`` bytes, cut before single spaces between letters or digits."""
    out, begin, at = [], 0, SLICE
    while at < len(text) - 1:
        if text[at] == 32 and _CLASS[text[at - 1]] == ALNUM and _CLASS[text[at + 1]] == ALNUM:
            out.append(text[begin:at])
            begin, at = at, at + SLICE
        else:
            at += 1
    return [*out, text[begin:]]


def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder for each worker process."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = PieceEncoder(path, kind)
    return _ENCODERS[path, kind]


def some_at_a_time(texts, rows: int = 2000, chars: int = 4_000_000):
    """Slices (from, to) of a batch, each of a bounded number of rows and characters but one row at least."""
    begin, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if at + 1 - begin >= rows or size >= chars:
            yield begin, at + 1
            begin, size = at + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
