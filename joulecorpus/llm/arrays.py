"""Texts of an Arrow batch as numpy arrays: bytes, words, substring hashes, sliding minima.

Everything here works on whole texts, in pieces of bounded size.  A substring hash
is a polynomial over randomly mixed symbols modulo 2**64, finished by a mixer; two
independent ones (``Hasher(0)`` and ``Hasher(1)``) together have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text turned into arrays at a time.
PIECE = 1 << 20

# White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_ranges(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``limit`` bytes together; a longer row stands alone."""
    rows, low = len(offsets) - 1, 0
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, rows)
        low = min(high, rows)


def pieces(
    offsets: np.ndarray, overlap: int, limit: int = PIECE
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Cut a batch into slices ``[low, high)`` of bounded size.

    Yields ``low, high, edges, rows, bases``: the rows' edges within the slice, their
    numbers, and the place in its row at which each begins.  A row beyond ``limit`` is
    cut; each cut reaches ``overlap`` bytes into the next one.
    """
    for first, last in row_ranges(offsets, limit):
        low, high = int(offsets[first]), int(offsets[last])
        if high - low <= limit + overlap:
            yield low, high, offsets[first : last + 1] - low, np.arange(first, last), np.zeros(last - first, np.int64)
            continue
        for base in range(0, high - low, limit):
            end = min(high, low + base + limit + overlap)
            edges = np.array([0, end - low - base])
            yield low + base, end, edges, np.array([first]), np.array([base])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


class Hasher:
    """Hashes of any substring in constant time, from one running sum."""

    def __init__(self, seed: int):
        random = np.random.default_rng(0x5EED + seed)
        self.table = random.integers(1, 2**64, 256, dtype=U)
        self.base = int(random.integers(1, 2**62)) * 2 + 1
        self.step = U(int(random.integers(1, 2**62)) * 2 + 1)  # odd
        self.size = 0

    def reserve(self, n: int) -> None:
        if n >= self.size:
            self.size = max(n + 1, 2 * self.size, 1 << 16)
            with np.errstate(over="ignore"):
                ones = np.ones(self.size, U)
                up, down = ones.copy(), ones.copy()
                up[1:], down[1:] = U(self.base), U(pow(self.base, -1, 2**64))
                self.up, self.down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        """Running sums of bytes or of 64-bit symbols."""
        self.reserve(len(symbols))
        values = self.table[symbols] if symbols.dtype == np.uint8 else symbols * self.step
        out = np.zeros(len(symbols) + 1, U)
        np.cumsum(values * self.up[: len(symbols)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``[start, end)`` for each pair; equal content and length give equal hashes."""
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U) * self.step)

    def fixed(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Hash of every span of ``length`` symbols."""
        n = len(sums) - length
        if n <= 0:
            return np.empty(0, U)
        return mix((sums[length:] - sums[:n]) * self.down[:n] + U(length * int(self.step) % 2**64))


def minhash_bands(hashes: np.ndarray, size: np.ndarray, bands: int, minima: int, seed: int) -> np.ndarray:
    """Bands of sets of ``size`` hashes that follow each other, none empty: a row each, never 0.

    One permutation: every hash falls into one slot, ``minima`` slots make a band.
    """
    slots, none = bands * minima, 2**32 - 1
    least = np.full(len(size) * slots, none, np.uint32)
    upper = (hashes >> U(40)).astype(np.uint32)
    slot = np.repeat(np.arange(len(size)) * slots, size) + (upper - upper // np.uint32(slots) * np.uint32(slots))
    np.minimum.at(least, slot, hashes.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    own = least.reshape(len(size), slots)
    # An empty slot takes the minimum of another one, by one sequence for all rows that ends with every slot.
    full, order = own.copy(), np.random.default_rng(10)
    for t in range(4 * slots):
        rows = np.flatnonzero((full == none).any(axis=1))
        if not len(rows):
            break
        source = order.integers(0, slots, slots) if t < 3 * slots else (np.arange(slots) + t) % slots
        full[rows] = np.where(full[rows] == none, own[rows][:, source], full[rows])
    value = np.full((len(size), bands), seed, U)
    for k in range(minima):
        value = mix(value * U(31) + full[:, k::minima].astype(U))
    return (value >> U(32)).astype(np.uint32) | np.uint32(1)


def sliding_argmin(values: np.ndarray, width: int, bits: int = 24) -> np.ndarray:
    """Index of the smallest of each ``width`` consecutive values, the leftmost of equals.

    Only the upper ``64 - bits`` bits of a value are compared.
    """
    if len(values) < width:
        return np.empty(0, np.int64)
    if len(values) >> bits:
        raise ValueError("piece too long")
    low = (values & ~U((1 << bits) - 1)) | np.arange(len(values), dtype=U)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        rest = width - span
        low = np.minimum(low[: len(low) - rest], low[rest:])
    return (low & U((1 << bits) - 1)).astype(np.int64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never reaches into the next row."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Hash of every word, computed over slices of bounded size."""
    out = np.empty(len(starts), U)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + PIECE, "right")))
        sums = hasher.sums(data[starts[low] : ends[high - 1]])
        out[low:high] = hasher.spans(sums, starts[low:high] - starts[low], ends[low:high] - starts[low])
        low = high
    return out


def steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... counts[1]-1, and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def fresh(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary array of ``data[start : start + size]``."""
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    body = data[np.repeat(start, size) + steps(size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def row_lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number of every element of a list column, and the elements; a null list has none."""
    lists = column.fill_null([]) if column.null_count else column
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()
