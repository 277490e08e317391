"""Vectorised views of Arrow text columns as UTF-8 bytes: words, word hashes, n-gram hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

STRIP = ".,;:!?\"'()[]{}|<>-_*/\\«»…0123456789"

#: Keys of the two passes of hashes; what they give is independent.
KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words beyond this many bytes are hashed one by one.
SHORT_WORD = 64
_low = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about size bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not ASCII white space, none crossing a row."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    black = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], black[:-1]))
    after = np.concatenate((black[1:], [False]))
    starts = np.flatnonzero(black & (~before | edge[:n]))
    ends = np.flatnonzero(black & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def words_of(text: str) -> list[str]:
    """Lower-cased words of a text without the signs and digits around them."""
    return [w for x in text.lower().split() if (w := x.strip(STRIP))]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = KEYS[0]) -> np.ndarray:
    """A keyed 64-bit hash of each span of data, equal for equal bytes wherever they stand.

    Eight bytes at a time are mixed into the state, all spans side by side; long spans take xxh3.
    """
    size = ends - starts
    out = mixed(size.astype(np.uint64) ^ np.uint64(key))
    if not len(size):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    long = np.flatnonzero(size > SHORT_WORD)
    live, k = np.flatnonzero((size > 0) & (size <= SHORT_WORD)), 0
    while len(live):
        x = eight[starts[live] + k] & _low[np.minimum(size[live] - k, 8)]
        out[live] = mixed((out[live] ^ x) + np.uint64(key))
        k += 8
        live = live[size[live] > k]
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), key)
    return out


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's word n-grams (lower-cased A-Z), a second hash of each from an independent
    pass over the bytes, and the n + 1 offsets of the rows.

    A row with fewer words than width has its whole sequence as one shingle; without words, none.
    """
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:n]
    short = np.flatnonzero((count > 0) & (count < width))
    salt = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    inside = rows[: max(0, len(rows) - width + 1)] == rows[width - 1 :]
    own = np.concatenate((rows[: len(inside)][inside], short))
    found = []
    for key in KEYS:
        h = span_hashes(data, starts, ends, key)
        acc = np.zeros(len(inside), np.uint64)
        for i in range(width if len(acc) else 0):
            acc = mixed(acc + h[i : i + len(acc)] * salt[i % 3] + np.uint64(i))
        extra = np.zeros(len(short), np.uint64)
        for i in range(width - 1):  # rows with fewer words
            has = np.flatnonzero(count[short] > i)
            extra[has] = mixed(extra[has] + h[first[short[has]] + i] * salt[i % 3] + np.uint64(1000 + i))
        found.append(np.concatenate((acc[inside], extra)))
    order = np.lexsort((found[0], own))
    acc, second, own = found[0][order], found[1][order], own[order]
    if len(acc):
        fresh = np.concatenate(([True], (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])))
        acc, second, own = acc[fresh], second[fresh], own[fresh]
    return acc, second, np.searchsorted(own, np.arange(n + 1))
