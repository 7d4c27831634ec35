"""Words and word shingles of whole texts, hashed in bulk with numpy.

Words are runs of bytes other than space and tab..carriage return, after
lower-casing A-Z.  A text's shingles are its runs of five words; a text with one
to four words has its whole sequence as its only shingle; a null text or one
without words has none.  Shingles are 64-bit hashes, and sets of them are sorted
arrays without repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed at once; a longer text is hashed by itself.
CHUNK = 500_000

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, *range(9, 14)]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = [U(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(SHINGLE)]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters close values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK)
        have = np.full(size, U(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= CHUNK:
            _powers[base] = have
    return have[:n]


def powers() -> None:
    """Make the tables of powers, which a process keeps."""
    _powers_of(_BASE, CHUNK), _powers_of(_INVERSE, CHUNK)


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of data[starts[i]:stops[i]] for each i."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _powers_of(_BASE, n), out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * _powers_of(_INVERSE, n)[starts]
    hashes ^= (stops - starts).astype(U) << U(56)
    return mix(hashes)


def hashed_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the text that it is in.  Text i is data[begins[i]:ends[i]]; texts follow one another."""
    n = len(data)
    if n == 0:
        return np.empty(0, U), np.empty(0, np.int64)
    low = _LOWER[data]
    word = _IS_WORD[low]
    filled = ends > begins
    opening, closing = word.copy(), word.copy()
    opening[1:] &= ~word[:-1]
    closing[:-1] &= ~word[1:]
    first, last = begins[filled], ends[filled] - 1
    opening[first] = word[first]
    closing[last] = word[last]
    starts, stops = np.flatnonzero(opening), np.flatnonzero(closing) + 1
    return run_hashes(low, starts, stops), np.searchsorted(ends, starts, side="right")


def shingled(hashes: np.ndarray, text_of: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in order, and offsets: text i has shingles[offsets[i]:offsets[i + 1]], repeats included."""
    counts = np.bincount(text_of, minlength=n_texts)
    out_counts = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(out_counts)))
    if len(hashes) >= SHINGLE:
        n = len(hashes) - SHINGLE + 1
        rolled = hashes[:n] * _STEP[0]
        for k in range(1, SHINGLE):
            rolled += hashes[k : k + n] * _STEP[k]
        whole = text_of[:n] == text_of[SHINGLE - 1 :]
        rolled = mix(rolled[whole])
    else:
        rolled = np.empty(0, U)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if not len(short):
        return rolled, offsets
    out = np.empty(offsets[-1], U)
    taken = np.ones(len(out), bool)
    taken[offsets[short]] = False
    out[taken] = rolled
    begins = np.concatenate(([0], np.cumsum(counts)))
    for i in short:
        own = hashes[begins[i] : begins[i + 1]]
        out[offsets[i]] = mix(np.array([sum(int(h) * int(s) for h, s in zip(own, _STEP, strict=False)) + len(own) * 0x5851F42D4C957F2D & (1 << 64) - 1], U))[0]
    return out, offsets


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, begins, ends) for runs of rows with about CHUNK bytes; null texts are empty."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.cast(pa.large_binary()) if part.type != pa.large_binary() else part
        n = len(part)
        if not n:
            continue
        part = part.fill_null(b"") if part.null_count else part
        _, where, raw = part.buffers()
        where = np.frombuffer(where, np.int64)[part.offset : part.offset + n + 1]
        raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(where, where[at] + CHUNK, side="right")) - 1)
            to = min(to, n)
            yield at, to, raw[where[at] : where[to]], where[at:to] - where[at], where[at + 1 : to + 1] - where[at]
            at = to


def shingle_runs(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row: its shingle hashes in text order."""
    for at, to, data, begins, ends in chunks(column):
        hashes, text_of = hashed_words(data, begins, ends)
        shingles, offsets = shingled(hashes, text_of, to - at)
        for i in range(to - at):
            yield shingles[offsets[i] : offsets[i + 1]]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row: its shingle set, sorted."""
    for run in shingle_runs(column):
        if len(run) > 1:
            run = np.sort(run)
            run = run[np.concatenate(([True], run[1:] != run[:-1]))]
        yield run


class Minima:
    """Minima of ``count`` universal hash functions x -> (a x + b) >> 32 over sets of 64-bit values."""

    def __init__(self, count: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 63, count, dtype=U)[:, None] * U(2) + U(1)
        self.b = draw.integers(0, 1 << 63, count, dtype=U)[:, None]
        self.count = count

    def of(self, values: np.ndarray) -> np.ndarray:
        """The signature of a set that isn't empty, as unsigned 32-bit integers."""
        low = None
        for at in range(0, len(values), 512):
            x = self.a * values[None, at : at + 512]
            x += self.b
            least = x.min(axis=1)
            low = least if low is None else np.minimum(low, least)
        return (low >> U(32)).astype(np.uint32)

    def by_block(self, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """One column of minima for each run of values that begins at begins[j]."""
        out = np.empty((self.count, len(begins)), np.uint32)
        limits = np.append(begins, len(values))
        at = 0
        while at < len(begins):
            to = max(at + 1, int(np.searchsorted(limits, limits[at] + 1024, side="right")) - 1)
            to = min(to, len(begins))
            x = self.a * values[None, limits[at] : limits[to]]
            x += self.b
            out[:, at:to] = np.minimum.reduceat(x, begins[at:to] - limits[at], axis=1) >> U(32)
            at = to
        return out
