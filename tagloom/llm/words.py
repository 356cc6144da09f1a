"""Words, shingles and MinHash values of many texts at once, by array operations on their bytes.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z. A word's hash is the sum of a random number for each of its bytes
times one for the byte's place, mixed; words of more than ``LONGEST`` bytes are hashed by BLAKE2. No dictionary of
words is kept, so memory is bounded by the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
LONGEST = 64
SEED = 0x9E3779B97F4A7C15
_M1, _M2, _S33 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(SEED))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _random.integers(1, 1 << 63, LONGEST, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


_FACTORS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)


def slices(batch: pa.RecordBatch, column: str, rows: int = 2048, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and about ``limit`` bytes of ``column``, one row at least."""
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if i > at and (i - at == rows or size + n > limit):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if batch.num_rows > at:
        yield batch.slice(at)


class Words:
    """The words of a column of texts in UTF-8 (null: empty): ``hashes``, and row i has those from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, column: pa.Array) -> None:
        column = column.fill_null(b"").cast(pa.large_binary())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        low, high = (int(bounds[0]), int(bounds[-1])) if len(column) else (0, 0)
        self.bytes = np.frombuffer(column.buffers()[2], np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
        self.bounds = bounds - low
        letter = ~_SPACE[self.bytes]
        start, end = letter.copy(), letter.copy()
        start[1:] &= ~letter[:-1]
        end[:-1] &= ~letter[1:]
        inner = self.bounds[(self.bounds > 0) & (self.bounds < len(letter))]
        start[inner] |= letter[inner]
        end[inner - 1] |= letter[inner - 1]
        self.starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.hashes = np.empty(len(self.starts), np.uint64)
        for i in range(0, len(self.starts), 1 << 17):
            self.hashes[i : i + (1 << 17)] = self._hash(self.starts[i : i + (1 << 17)], ends[i : i + (1 << 17)])

    def _hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        long_ = np.flatnonzero(n > LONGEST)
        n[long_] = 1
        at = np.cumsum(n) - n
        place = np.arange(at[-1] + n[-1]) - np.repeat(at, n)
        out = np.add.reduceat(_BYTE[self.bytes[np.repeat(starts, n) + place]] * _PLACE[place], at)
        for i in long_:
            word = self.bytes[starts[i] : ends[i]].tobytes().lower()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return mix(out)

    def lines(self) -> list[np.ndarray]:
        """The number of words of each line of each text."""
        breaks, rows = np.flatnonzero(self.bytes == 10), np.arange(len(self.bounds) - 1)
        # every text begins a line of its own
        begins = np.searchsorted(breaks, self.bounds) + np.arange(len(self.bounds))
        line = np.searchsorted(breaks, self.starts) + np.repeat(rows, np.diff(self.first))
        return np.split(np.bincount(line, minlength=int(begins[-1])), begins[1:-1])


def shingled(h: np.ndarray) -> np.ndarray:
    """The hash of the ``WIDTH`` words from each place on; none for fewer words."""
    n = len(h) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.uint64)
    s = h[:n] * _FACTORS[0]
    for k in range(1, WIDTH):
        s += h[k : k + n] * _FACTORS[k]
    return mix(s)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a text's words; fewer words than ``WIDTH`` are one shingle, no words none."""
    if 0 < len(h) < WIDTH:
        return mix((h * _FACTORS[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    return np.unique(shingled(h))


def bands_for(threshold: float, miss: float = 1e-5, values: int = 160) -> tuple[int, int]:
    """(bands, rows) that miss a pair at ``threshold`` with probability at most ``miss``.

    The more rows a band has, the fewer false candidates; so the longest rows that about ``values`` values allow.
    """
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))
        if bands * rows <= values:
            return bands + bands * rows % 2, rows
    return values // 2, 1


def band_keys(items: np.ndarray, spans: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys of each span (start, end) of ``items``, one row a span: values 2i and 2i+1 are minimum and maximum under permutation i.

    A span must not be empty; spans may overlap, repeats in a span change nothing.
    """
    if not len(spans):
        return np.empty((0, bands), np.uint64)
    perms = -(-bands * rows // 2)
    salts = mix(np.arange(1, perms + 1, dtype=np.uint64) * _M2)
    items, pairs = np.append(items, np.uint64(0)), np.ascontiguousarray(spans).reshape(-1)
    values = np.empty((2 * perms, len(spans)), np.uint64)
    for i, salt in enumerate(salts):
        p = (items ^ salt) * (salt | np.uint64(1))
        p ^= p >> np.uint64(32)
        values[2 * i], values[2 * i + 1] = np.minimum.reduceat(p, pairs)[::2], np.maximum.reduceat(p, pairs)[::2]
    values = mix(values[: bands * rows]).reshape(bands, rows, -1)
    mult = mix(np.arange(1, rows + 1, dtype=np.uint64) * _M1) | np.uint64(1)
    return mix((values * mult[:, None]).sum(axis=1) + (np.arange(bands, dtype=np.uint64) * np.uint64(SEED))[:, None]).T


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """A column of lists of 64-bit numbers."""
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64))


def sliding(x: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """The least (or ``best``) of each ``n`` neighbours, by doubling."""
    done = 1
    while 2 * done <= n:
        x, done = best(x[:-done], x[done:]), 2 * done
    return best(x[: len(x) - (n - done)], x[n - done :]) if done < n else x


def anchors(s: np.ndarray, reach: int) -> np.ndarray:
    """Places whose value is the least of some ``reach`` neighbours (all places, if there are fewer, count as neighbours).

    So any ``reach`` neighbours hold one, and whether a place in them is one because of them depends on nothing else.
    """
    reach = min(reach, len(s))
    if not reach:
        return np.empty(0, np.int64)
    least = sliding(s, reach)
    low = np.zeros(reach - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([low, least, low]), reach, np.maximum) == s)


def anchors_of(s: np.ndarray, spans: np.ndarray, reach: int) -> np.ndarray:
    """The anchors of each span (start, end; in order, apart) of ``s``, as places in ``s``.

    Neighbours that a span's ends cut short count too, so there may be more anchors near the ends than :func:`anchors`
    finds; they depend on nothing outside of the span.
    """
    n = spans[:, 1] - spans[:, 0]
    places = np.repeat(spans[:, 0] - np.cumsum(n) + n, n) + np.arange(n.sum())
    apart = np.full(n.sum() + reach * (len(n) + 1), np.iinfo(np.uint64).max, np.uint64)
    at = np.arange(n.sum()) + reach * np.repeat(np.arange(1, len(n) + 1), n)
    apart[at] = s[places]
    found = np.zeros(len(apart), bool)
    found[anchors(apart, reach)] = True
    return places[found[at]]


def windows(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each place ``at`` on."""
    mult = mix(np.arange(1, n + 1, dtype=np.uint64) * _M2) | np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out += h[at + k] * mult[k]
    return mix(out)


_places = np.empty(0, np.uint64)


def sequences(h: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The hash of each span's words in their order."""
    global _places
    most = int((spans[:, 1] - spans[:, 0]).max(initial=0))
    mult = _places[:most]
    if len(mult) < most:
        mult = mix(np.arange(1, most + 1, dtype=np.uint64) * _M1) | np.uint64(1)
        _places = mult if most <= 1 << 20 else _places
    return mix(np.array([np.dot(h[a:b], mult[: b - a]) for a, b in spans.tolist()], np.uint64) + (spans[:, 1] - spans[:, 0]).astype(np.uint64))
