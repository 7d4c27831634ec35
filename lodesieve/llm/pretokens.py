"""Encoding with a tokenizers file at the speed of a table look-up.

A byte-level tokenizer splits a text into pieces and merges within a piece, and a
space before a character that is no space always begins one.  So texts are cut at
such spaces, all texts of a chunk at once in numpy.  The library encodes the pieces
that aren't known yet; their ids stand in one array, found by 64-bit hashes in an
open-addressing table of bounded size.  Texts in which a space meets other white
space or the end, and texts that hold an added token, go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lodesieve.llm.words import chunks, powers, run_hashes

#: The character that stands for a space in a byte-level vocabulary.
SPACE = "Ġ"
#: Distinct pieces that a process remembers (about 40 bytes each); a full table is emptied.
KNOWN = 1_000_000
#: Pieces that the library encodes in one string.
TOGETHER = 200
U = np.uint64
#: White space of three UTF-8 bytes, fixed by Unicode: U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WIDE_SPACES = {b for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) for b in [int.from_bytes(chr(c).encode(), "big")]}


class HashTable:
    """Numbers 0, 1, 2, ... of distinct 64-bit hashes, in order of arrival."""

    def __init__(self) -> None:
        self.size, self.mask = 0, (1 << 16) - 1
        self.hashes, self.numbers = np.zeros(1 << 16, U), np.full(1 << 16, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers; -1 where unknown."""
        slot = (hashes & U(self.mask)).astype(np.int64)
        out = self.numbers[slot]
        open_ = np.flatnonzero((out >= 0) & (self.hashes[slot] != hashes))
        while len(open_):
            at = slot[open_] = (slot[open_] + 1) & self.mask
            found = out[open_] = self.numbers[at]
            open_ = open_[(found >= 0) & (self.hashes[at] != hashes[open_])]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Distinct unknown hashes get the next numbers."""
        if 2 * (self.size + len(hashes)) > self.mask:
            kept = self.numbers >= 0
            old = self.hashes[kept][np.argsort(self.numbers[kept])]
            while 2 * (self.size + len(hashes)) > self.mask:
                self.mask = 2 * self.mask + 1
            self.hashes, self.numbers, self.size = np.zeros(self.mask + 1, U), np.full(self.mask + 1, -1, np.int32), 0
            self.add(old)
        numbers = np.arange(self.size, self.size + len(hashes), dtype=np.int32)
        slot = (hashes & U(self.mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            at = slot[left]
            free = self.numbers[at] < 0
            self.numbers[at[free]] = numbers[left[free]]  # of several that want a slot, one gets it
            got = self.numbers[at] == numbers[left]
            self.hashes[at[got]] = hashes[left[got]]
            left = left[~got]
            slot[left] = (slot[left] + 1) & self.mask
        self.size += len(hashes)


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type | str) -> None:
        self.data, self.size = np.empty(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            grown = np.empty(max(need, 2 * len(self.data)), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = values
        self.size = need


class PieceEncoder:
    """Ids of whole texts, as little-endian integers of two or four bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        names = self.library.get_vocab(with_added_tokens=False)
        #: ids of the tokens that begin with a space
        self.opening = np.zeros(self.library.get_vocab_size(), bool)
        self.opening[[i for t, i in names.items() if t[0] == SPACE]] = True
        self._forget()

    def _forget(self) -> None:
        self.table, self.tokens, self.stops = HashTable(), Growing(self.kind), Growing(np.int64)
        self.stops.extend(np.zeros(1, np.int64))

    def packed(self, ids: list[int]) -> np.ndarray:
        return np.array(ids, self.kind)

    def whole(self, text: bytes) -> np.ndarray:
        return self.packed(self.library.encode(text.decode(), add_special_tokens=False).ids)

    def _put(self, tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.stops.extend(self.tokens.size + np.cumsum(sizes))
        self.tokens.extend(tokens)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """New pieces, first those with a space before them, then those without."""
        bare = next((k for k, p in enumerate(pieces) if p[:1] != b" "), len(pieces))
        parts = [pieces[k : min(k + TOGETHER, bare)] for k in range(0, bare, TOGETHER)]
        for part in parts:
            ids = self.packed(self.library.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids)
            begins = np.flatnonzero(self.opening[ids])
            if len(begins) == len(part):  # one space a piece
                self._put(ids, np.diff(np.append(begins, len(ids))))
            else:
                self._one_by_one(part)
        self._one_by_one(pieces[bare:])
        self.table.add(hashes)

    def _one_by_one(self, pieces: list[bytes]) -> None:
        for p in pieces:
            ids = self.whole(p)
            self._put(ids, np.array([len(ids)]))

    def _odd(self, data: np.ndarray, raw: bytes, begins: np.ndarray, ends: np.ndarray, spaces: np.ndarray) -> np.ndarray:
        """Which texts go to the library whole."""
        n = len(data)
        after = data[np.minimum(spaces + 1, n - 1)]
        suspect = (after <= 32) | (spaces + 1 == n)
        two = spaces[after == 0xC2]
        three = spaces[(after >= 0xE1) & (after <= 0xE3)]
        at = [spaces[suspect], two[np.isin(data[two + 2], (0x85, 0xA0))]]
        if len(three):
            code = data[three + 1].astype(np.int64) << 16 | data[three + 2].astype(np.int64) << 8 | data[three + 3]
            at.append(three[np.isin(code, list(WIDE_SPACES))])
        for t in self.added:
            k = raw.find(t)
            while k >= 0:
                at.append(np.array([k]))
                k = raw.find(t, k + 1)
        odd = np.zeros(len(begins), bool)
        odd[np.searchsorted(ends, np.concatenate(at), side="right")] = True
        full = ends > begins
        odd[full] |= data[ends[full] - 1] == 32
        return odd

    def encoded(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null text has none."""
        for _, _, data, begins, ends in chunks(column):
            n = len(data)
            if not n:
                yield from (np.empty(0, self.kind) for _ in begins)
                continue
            raw = data.tobytes()
            cut = data == 32
            spaces = np.flatnonzero(cut)
            odd = self._odd(data, raw, begins, ends, spaces)
            cut[begins[ends > begins]] = True
            starts = np.flatnonzero(cut)
            stops = np.append(starts[1:], n)
            hashes = run_hashes(data, starts, stops)
            found = self.table.find(hashes)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                missing = missing[~odd[np.searchsorted(ends, starts[missing], side="right")]]
                fresh, first = np.unique(hashes[missing], return_index=True)
                if self.table.size + len(fresh) > KNOWN:
                    self._forget()
                    missing = np.flatnonzero(~odd[np.searchsorted(ends, starts, side="right")])
                    fresh, first = np.unique(hashes[missing], return_index=True)
                first = missing[first]
                order = np.argsort(data[starts[first]] != 32, kind="stable")
                self._learn(fresh[order], [raw[a:b] for a, b in zip(starts[first[order]].tolist(), stops[first[order]].tolist(), strict=True)])
                found = self.table.find(hashes)
            found = np.maximum(found, 0)  # what is left belongs to texts that go whole
            begin = self.stops.data[found]
            sizes = self.stops.data[found + 1] - begin
            ranks = np.cumsum(sizes)
            tokens = self.tokens.data[np.arange(ranks[-1]) + np.repeat(begin - (ranks - sizes), sizes)] if ranks[-1] else np.empty(0, self.kind)
            bounds = np.concatenate(([0], ranks))[np.searchsorted(starts, np.append(begins, n))]
            for k in range(len(begins)):
                yield self.whole(raw[begins[k] : ends[k]]) if odd[k] else tokens[bounds[k] : bounds[k + 1]]


@lru_cache(2)
def loaded(path: str) -> PieceEncoder:
    """A worker process keeps its encoder, and the pieces it has met, from task to task."""
    powers()
    return PieceEncoder(path)
