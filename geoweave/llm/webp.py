"""Lossless WebP media columns: a VP8L codec in Python and numpy, and the column operator over it.

The decoder reads prefix codes, back-references and the colour cache, several code groups by a meta
image, and inverts the predictor, cross-colour, subtract-green and palette transforms. The encoder
writes the same format: the transforms that an image gains from (which text seldom does), runs of one
pixel as back-references, the colour cache where it saves bits, prefix codes of at most 12 bits. Images
of Latin text for which codes of their own would save less than a sixth share a fixed set of codes,
and a code header that a worker has read before isn't parsed again: with codes of its own, a cache
and general back-references for every image, Python took four times as long (one by one) for a fifth less bytes.

Calls of numpy on one image of a few hundred pixels cost more than the pixels, so a block's images are
stored and read side by side: a stream is still read symbol by symbol from its own bits, but a pixel of
every image at a time. What that doesn't know (transforms, meta images, alpha, references farther back,
images of a million pixels) goes through the encoder and decoder of single images, which give the same.

Payloads are stored as 24-bit samples (3 bytes a pixel, alpha 255) in rows of 192 pixels or a
multiple of that, so that both sides stay within 16384; pixels that fill up the last row have
alpha 0.

Defined cases: null and empty texts are one row of 576 bytes 255; a payload of more bytes than
16384 rows of 16320 pixels (802 MB) raises; ids are passed through, repeated or null.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .textbytes import blocks, utf8

UNIT = 576
MAX_SIDE = 1 << 14
# Fixed values of the format (RFC 9649): order of code-length codes, offsets of short distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
REVERSED = sum((np.arange(1 << 15) >> k & 1) << (14 - k) for k in range(15))
#: Size of the colour cache that is tried; bits a byte from which transforms are tried.
CACHE_BITS, TEXT_BITS = 6, 6.0
#: Images are read side by side so many pixels at a time, and one by one when fewer than this are left.
STEPS, FEWEST_LANES = 32, 32
#: Larger images are stored and read one by one. Bytes of text and images that are stored and read side by side.
MANY_PIXELS, BLOCK, MANY = 1 << 20, 1 << 22, 2048
#: Places in the tables of codes that are held at once.
TABLES = 1 << 21


# --- prefix codes ---


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in code order and their codes with the bits in reading order (first bit lowest)."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used].astype(np.int64)
    top = int(size[-1])
    space = np.left_shift(1, top - size)
    code = (np.cumsum(space) - space) >> (top - size)
    return used, REVERSED[(code << (15 - size)) & 0x7FFF]


class Code:
    """A prefix code as a table: bits ahead -> symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:  # a lone symbol takes no bits
            self.mask, self.table = 0, used[:1] << 4 if len(used) else np.zeros(1, np.int64)
            return
        symbols, codes = canonical(lengths)
        size = lengths[symbols].astype(np.int64)
        top = int(size[-1])
        if int(np.left_shift(1, top - size).sum()) != 1 << top:
            raise ValueError("a prefix code is not complete")
        # a code of s bits fills every place that ends in it, 2^(top - s) of them
        places = np.left_shift(1, top - size)
        which = np.repeat(np.arange(len(size)), places)
        nth = np.arange(1 << top) - np.repeat(np.cumsum(places) - places, places)
        self.mask, self.table = (1 << top) - 1, np.zeros(1 << top, np.int64)
        self.table[codes[which] + (nth << size[which])] = (symbols << 4 | size)[which]

    @functools.cached_property
    def symbols(self) -> list[int]:
        return (self.table >> 4).tolist()

    @functools.cached_property
    def sizes(self) -> list[int]:
        return (self.table & 15).tolist()


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.size = len(data) * 8

    @functools.cached_property
    def ahead(self) -> list[int]:
        return np.ndarray((len(self.data) + 8,), "<u8", self.data + bytes(16), strides=(1,)).tolist()

    def window(self, at: int) -> int:
        """At least 57 bits from bit at on."""
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.size:
            raise ValueError("the bit stream ends early")
        return self.window(at) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        at = self.at
        k = self.window(at) & code.mask
        self.at = at + code.sizes[k]
        if self.at > self.size:
            raise ValueError("the bit stream ends early")
        return code.symbols[k]


@functools.lru_cache(256)
def code_of(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


def read_lengths(bits: Bits, n: int) -> np.ndarray:
    lengths = np.zeros(n, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    first = np.zeros(19, np.uint8)
    for k in range(4 + bits.read(4)):
        first[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else n
    at, before = 0, 8
    while at < n and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
        else:
            value, times = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
            if at + times > n:
                raise ValueError("too many code lengths")
            lengths[at : at + times] = value
            at += times
    return lengths


# --- decoder ---


def prefix_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


_headers: dict[bytes, tuple[bytes, int, int, list[list[Code]]]] = {}


def read_groups(bits: Bits, alphabet: tuple[int, ...], n: int) -> list[list[Code]]:
    """The prefix codes of n groups; what was read before, bit for bit, isn't parsed again."""
    first, phase = bits.at >> 3, bits.at & 7
    key = repr((alphabet, n, phase)).encode() + bits.data[first : first + 16]
    known = _headers.get(key)
    if known and bits.data.startswith(known[0], first):
        tail = bits.at + known[1]
        if bits.window(tail & ~7) & ((1 << (tail & 7)) - 1) == known[2]:
            bits.at = tail
            return known[3]
    groups = [[code_of(read_lengths(bits, k).tobytes()) for k in alphabet] for _ in range(n)]
    if n == 1:
        if len(_headers) > 256:
            _headers.clear()
        _headers[key] = (bits.data[first : bits.at >> 3], bits.at - 8 * first - phase, bits.window(bits.at & ~7) & ((1 << (bits.at & 7)) - 1), groups)
    return groups


def read_codes(bits: Bits, width: int, height: int, main: bool) -> tuple[int, np.ndarray | None, int, list[list[Code]]]:
    """What stands before the pixels: bits of the colour cache, the meta image and its shift, the groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        meta = (read_pixels(bits, -(-width >> shift), -(-height >> shift)) >> 8) & 0xFFFF
    alphabet = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    return cache_bits, meta, shift, read_groups(bits, alphabet, int(meta.max()) + 1 if meta is not None else 1)


def read_pixels(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image as flat ARGB numbers."""
    cache_bits, meta, shift, groups = read_codes(bits, width, height, main)
    across, total = -(-width >> shift), width * height
    out: list[int] = []
    cache, hash_shift, hashed = [0] * (1 << cache_bits), 32 - cache_bits, 0
    ahead, append = bits.ahead, out.append
    green, red, blue, alpha, far = groups[0]
    at, end, n = bits.at, bits.size, 0
    # literals of one group whose alpha takes no bits: three look-ups in one window
    plain = meta is None and not alpha.mask
    g_mask, r_mask, b_mask = green.mask, red.mask, blue.mask
    g_symbols, g_sizes, r_symbols, r_sizes, b_symbols, b_sizes = green.symbols, green.sizes, red.symbols, red.sizes, blue.symbols, blue.sizes
    opaque = alpha.symbols[0] << 24
    while n < total:
        if plain:
            before = len(out)
            try:
                for _ in range(total - n):
                    w = ahead[at >> 3] >> (at & 7)
                    k = w & g_mask
                    s = g_symbols[k]
                    if s > 255:
                        break
                    size = g_sizes[k]
                    k = (w >> size) & r_mask
                    size += r_sizes[k]
                    b = (w >> size) & b_mask
                    append(opaque | r_symbols[k] << 16 | s << 8 | b_symbols[b])
                    at += size + b_sizes[b]
            except IndexError:
                raise ValueError("the bit stream ends early") from None
            n += len(out) - before
            if n == total:
                break
        if meta is not None:
            green, red, blue, alpha, far = groups[meta[(n // width >> shift) * across + (n % width >> shift)]]
        w = ahead[at >> 3] >> (at & 7)
        k = w & green.mask
        size, s = green.sizes[k], green.symbols[k]
        if s < 256:
            k = (w >> size) & red.mask
            size += red.sizes[k]
            r = red.symbols[k]
            at += size
            w = ahead[at >> 3] >> (at & 7)
            k = w & blue.mask
            size = blue.sizes[k]
            b = blue.symbols[k]
            k = (w >> size) & alpha.mask
            at += size + alpha.sizes[k]
            append(alpha.symbols[k] << 24 | r << 16 | s << 8 | b)
            n += 1
        elif s < 280:
            bits.at = at + size
            length = prefix_value(bits, s - 256)
            d = prefix_value(bits, bits.symbol(far))
            at = bits.at
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > n or n + length > total:
                raise ValueError("a back-reference leaves the image")
            for j in range(n - d, n - d + length) if length > d else ():
                append(out[j])
            if length <= d:
                out.extend(out[n - d : n - d + length])
            n += length
        else:
            while hashed < n:
                v = out[hashed]
                cache[((v * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> hash_shift] = v
                hashed += 1
            append(cache[s - 280])
            at += size
            n += 1
    if at > end:
        raise ValueError("the bit stream ends early")
    bits.at = at
    return np.array(out, np.uint32)


def channels(argb: np.ndarray) -> np.ndarray:
    """ARGB numbers as (..., 4) bytes in the order blue, green, red, alpha."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predicted(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """Predictor modes on int arrays (..., 4)."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255]), left.shape)
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(-1, keepdims=True), np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        a = _mean(left, top)
        d = a - top_left
        return np.clip(a + (np.abs(d) >> 1) * np.sign(d), 0, 255)
    return {5: lambda: _mean(_mean(left, top_right), top), 6: lambda: _mean(left, top_left), 7: lambda: _mean(left, top), 8: lambda: _mean(top_left, top), 9: lambda: _mean(top, top_right), 10: lambda: _mean(_mean(left, top_left), _mean(top, top_right))}[mode]()


def undo_predictor(argb: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    x = channels(argb).astype(np.int64)
    h, w = argb.shape
    x[0, 0] = (x[0, 0] + (0, 0, 0, 255)) & 255
    x[0] = np.cumsum(x[0], axis=0) & 255
    needs_left = {1, 5, 6, 7, 10, 11, 12, 13}
    for y in range(1, h):
        row, above = x[y], x[y - 1]
        row[0] = (row[0] + above[0]) & 255
        top_right = np.concatenate((above[1:], row[:1]))
        kinds = np.repeat(modes[y >> shift], 1 << shift)[:w]
        at = 1
        while at < w:
            mode, end = int(kinds[at]), at + 1
            while end < w and kinds[end] == mode:
                end += 1
            if mode not in needs_left:
                row[at:end] = (row[at:end] + predicted(mode, above[at:end], above[at:end], top_right[at:end], above[at - 1 : end - 1])) & 255
            elif mode == 1:
                row[at - 1 : end] = np.cumsum(row[at - 1 : end], axis=0) & 255
            else:
                for i in range(at, end):
                    row[i] = (row[i] + predicted(mode, row[i - 1], above[i], top_right[i], above[i - 1])) & 255
            at = end
    return np.ascontiguousarray(x.astype(np.uint8)).view("<u4").reshape(h, w)


def _cross(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (m.astype(np.int8).astype(np.int64) * c.astype(np.int8).astype(np.int64)) >> 5


def spread(blocks_: np.ndarray, shift: int, h: int, w: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks_, 1 << shift, axis=0), 1 << shift, axis=1)[:h, :w]


def cross_colour(argb: np.ndarray, elements: np.ndarray, shift: int, sign: int) -> np.ndarray:
    """Add (sign 1: inverse) or take away (-1: forward) what the other channels tell of red and blue."""
    x, e = channels(argb).copy(), channels(spread(elements, shift, *argb.shape))
    red = x[..., 2].astype(np.int64)
    new_red = (red + sign * _cross(e[..., 0], x[..., 1])) & 255
    from_red = new_red if sign == 1 else red
    x[..., 0] = (x[..., 0] + sign * (_cross(e[..., 1], x[..., 1]) + _cross(e[..., 2], from_red.astype(np.uint8)))) & 255
    x[..., 2] = new_red
    return np.ascontiguousarray(x).view("<u4").reshape(argb.shape)


def green_added(argb: np.ndarray, sign: int) -> np.ndarray:
    x = channels(argb).copy()
    x[..., 0] += x[..., 1] * np.uint8(sign & 255)
    x[..., 2] += x[..., 1] * np.uint8(sign & 255)
    return np.ascontiguousarray(x).view("<u4").reshape(argb.shape)


def bundle(colours: int) -> int:
    """log2 of the palette indices that share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def opened(data: bytes) -> tuple[Bits, int, int]:
    """The bits of a lossless WebP file after its header, its width and height."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return bits, width, height


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file, (height, width, 4) bytes in the order red, green, blue, alpha."""
    bits, width, height = opened(data)
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            across, down = -(-w >> shift), -(-height >> shift)
            undo.append((kind, shift, read_pixels(bits, across, down).reshape(down, across), w))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(channels(read_pixels(bits, n, 1)).astype(np.int64), axis=0).astype(np.uint8)
            undo.append((kind, bundle(n), np.ascontiguousarray(table).view("<u4").reshape(-1), w))
            w = -(-w >> bundle(n))
        else:
            undo.append((kind, 0, None, w))
    argb = read_pixels(bits, w, height, main=True).reshape(height, w)
    for kind, shift, extra, wide in reversed(undo):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, (extra >> 8) & 15, shift)
        elif kind == CROSS_COLOUR:
            argb = cross_colour(argb, extra, shift, 1)
        elif kind == SUBTRACT_GREEN:
            argb = green_added(argb, 1)
        else:
            depth = 8 >> shift
            index = ((argb >> 8) & 255)[:, :, None] >> (np.arange(1 << shift) * depth) & ((1 << depth) - 1)
            index = index.reshape(height, -1)[:, :wide]
            argb = np.where(index < len(extra), extra[np.minimum(index, len(extra) - 1)], 0).astype(np.uint32)
    return channels(argb)[..., [2, 1, 0, 3]]


# --- many images side by side ---


class Lane(NamedTuple):
    """An opaque image without transforms, of one group of codes, whose back-references are of one place."""

    image: int
    data: bytes
    at: int
    pixels: int
    cache_bits: int
    codes: list[Code]


def lane_of(image: int, data: bytes) -> Lane | None:
    bits, width, height = opened(data)
    if width * height > MANY_PIXELS or bits.read(1):
        return None
    cache_bits, meta, _, groups = read_codes(bits, width, height, main=True)
    green, _, _, alpha, far = groups[0]
    if meta is not None or bits.at >= bits.size or not green.mask or alpha.mask or alpha.table[0] >> 4 != 255 or far.mask or far.table[0] >> 4 != 1:
        return None
    return Lane(image, bits.data, bits.at, width * height, cache_bits, groups[0][:3])


class Lanes:
    """The pixels of many images, decoded a pixel of each at a time."""

    def __init__(self, lanes: list[Lane]):
        self.lanes = lanes
        codes = list({id(c): c for lane in lanes for c in lane.codes}.values())
        base = dict(zip(map(id, codes), np.cumsum([0, *(len(c.table) for c in codes)]).tolist(), strict=False))
        table = np.concatenate([c.table for c in codes])
        self.symbol = table >> 4
        self.run = (self.symbol > 255) & (self.symbol < 280)
        # with the bits that tell a run's length
        self.size = (table & 15) + np.where(self.run, np.maximum(self.symbol - 258, 0) >> 1, 0)
        self.literal = np.where(self.symbol < 256, -1, 0)
        # by lane: masks and places of the codes of green, red and blue
        self.codes = np.array([[x for c in lane.codes for x in (c.mask, base[id(c)])] for lane in lanes], np.int64).T.copy()
        sizes = np.array([len(lane.data) for lane in lanes])
        first = np.cumsum(sizes) - sizes
        buffer = b"".join(lane.data for lane in lanes) + bytes(16 * STEPS)
        self.window = np.ndarray((len(buffer) - 7,), "<i8", buffer, strides=(1,)).astype(np.int64)
        self.start, self.end = 8 * first + [lane.at for lane in lanes], 8 * (first + sizes)

    def advanced(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The bits where each lane is before each of STEPS pixels (or references), and after them."""
        out = np.empty((STEPS + 1, len(at)), np.int64)
        out[0] = at
        w, k, size, more = np.empty((4, len(at)), np.int64)
        g_mask, g_base, r_mask, r_base, b_mask, b_base = codes
        take, sizes, literal = self.window.take, self.size.take, self.literal.take
        add, both, shift = np.add, np.bitwise_and, np.right_shift
        for i in range(STEPS):
            at = out[i]
            take(shift(at, 3, out=k), out=w, mode="clip")
            shift(w, both(at, 7, out=k), out=w)
            sizes(add(both(w, g_mask, out=k), g_base, out=k), out=size, mode="clip")
            at = add(at, size, out=out[i + 1])
            shift(w, size, out=w)
            literal(k, out=size, mode="clip")
            sizes(add(both(w, r_mask, out=k), r_base, out=k), out=more, mode="clip")
            shift(w, more, out=w)
            sizes(add(both(w, b_mask, out=k), b_base, out=k), out=w, mode="clip")
            add(at, both(add(w, more, out=w), size, out=w), out=at)
        return out

    def walked(self, lane: int, at: int) -> np.ndarray:
        """The same for the rest of one lane."""
        first, end = at >> 3, int(self.end[lane])
        ahead = self.window[first : (end >> 3) + 1].tolist()
        (g_mask, g), (r_mask, r), (b_mask, b) = ((c.mask, self.size[k : k + len(c.table)].tolist()) for c, k in zip(self.lanes[lane].codes, self.codes[1::2, lane].tolist(), strict=True))
        literal = (self.literal[self.codes[1, lane] :][: len(g)] < 0).tolist()
        at, end, out = at - 8 * first, end - 8 * first, []
        while at < end:
            out.append(at)
            w = ahead[at >> 3] >> (at & 7)
            k = w & g_mask
            at += g[k]
            if literal[k]:
                w >>= g[k]
                size = r[w & r_mask]
                at += size + b[(w >> size) & b_mask]
        return np.array([*out, at]) + 8 * first

    def tokens(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What stands at these bits: an ARGB number, a place in the colour cache, or less the length of a run."""
        g_mask, g_base, r_mask, r_base, b_mask, b_base = codes
        w = self.window.take(at >> 3) >> (at & 7)
        g = (w & g_mask) + g_base
        w >>= self.size.take(g)
        r = (w & r_mask) + r_base
        w >>= self.size.take(r)
        s = self.symbol.take(g)
        out = 0xFF000000 | self.symbol.take(r) << 16 | s << 8 | self.symbol.take((w & b_mask) + b_base)
        other = np.flatnonzero(s > 255)
        if len(other):
            s, g, at = s.flat[other], g.flat[other], at.flat[other]
            extra = np.maximum(s - 258, 0) >> 1
            size = self.size[g] - extra  # of the symbol alone
            w = self.window[at + size >> 3] >> (at + size & 7)
            length = np.where(s < 260, s - 255, (2 + (s & 1) << extra) + (w & (1 << extra) - 1) + 1)
            out.flat[other] = np.where(s < 280, -length, s - 280)
        return out

    def read(self) -> list[np.ndarray | None]:
        """The samples of each lane; None: what only the decoder of single images reads, or rejects."""
        n = len(self.lanes)
        live, at, codes = np.arange(n), self.start, self.codes
        parts, count = [], np.zeros(n, np.int64)  # lanes, number of their first pixel, pixels, bits after them
        while len(live) >= FEWEST_LANES:
            bits = self.advanced(at, codes)
            parts.append((live, count[live], self.tokens(bits[:-1], codes), bits[1:]))
            count[live] += STEPS
            keep = bits[-1] < self.end[live]
            live, at, codes = live[keep], bits[-1][keep], codes[:, keep]
        for lane, k in zip(live.tolist(), at.tolist(), strict=True):
            bits = self.walked(lane, k)[:, None]
            parts.append((np.array([lane]), count[[lane]], self.tokens(bits[:-1], self.codes[:, [lane]]), bits[1:]))
            count[lane] += len(bits) - 1
        first = np.cumsum(count) - count
        token, after = np.empty((2, int(count.sum())), np.int64)
        for lanes, k, t, b in parts:
            place = first[lanes] + k + np.arange(len(t))[:, None]
            token[place], after[place] = t, b
        return self.samples(token, after, count)

    def samples(self, token: np.ndarray, after: np.ndarray, count: np.ndarray) -> list[np.ndarray | None]:
        n = len(self.lanes)
        total, cache = np.array([lane.pixels for lane in self.lanes]), np.array([lane.cache_bits for lane in self.lanes])
        length = np.where(token < 0, -token, 1)
        end = np.cumsum(length)
        first = np.cumsum(count) - count
        end -= np.repeat(end[first] - length[first], count)  # pixels of the lane up to here
        keep = np.flatnonzero(end - length < np.repeat(total, count))  # the rest are the bits that fill up the last byte
        lane = np.repeat(np.arange(n), count)[keep]
        token, after, length, end = token[keep], after[keep], length[keep], end[keep]
        last = np.flatnonzero(np.concatenate((lane[1:] != lane[:-1], [True])))
        fine = (end[last] == total) & (after[last] <= self.end)
        start = np.concatenate(([0], last[:-1] + 1))
        fine &= token[start] >= 0
        hits = np.flatnonzero(cache[lane] > 0)
        hits = hits[token[hits] >= 0]
        if len(hits):  # a place holds the last pixel that hashes to it; hits and runs of one place leave it as it is
            t, own = token[hits], lane[hits]
            known = t >= 1 << 24
            slot = np.where(known, (t * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache[own]), t) + (own << 12)
            order = np.argsort(slot, kind="stable")
            source = np.maximum.accumulate(np.where(known[order], np.arange(len(order)), 0))
            fine[own[order][(slot[order[source]] != slot[order]) | ~known[order[source]]]] = False
            token[hits[order]] = t[order[source]]
        token = token[np.maximum.accumulate(np.where(token < 0, 0, np.arange(len(token))))]
        x = channels(np.repeat(token, length).astype(np.uint32))
        samples = np.ascontiguousarray(x[:, 2::-1]).reshape(-1)
        ends = np.cumsum(np.add.reduceat(length, start)) * 3
        return [samples[a:b] if ok else None for a, b, ok in zip([0, *ends[:-1].tolist()], ends.tolist(), fine.tolist(), strict=True)]


def load_many(media: list[bytes]) -> list[np.ndarray]:
    """The samples of images as flat bytes."""
    out: list[np.ndarray | None] = [None] * len(media)
    lanes, codes, places = [], set(), 0
    for i, data in enumerate(media):
        if lane := lane_of(i, data):
            lanes.append(lane)
            places += sum(len(c.table) for c in {id(c): c for c in lane.codes if id(c) not in codes}.values())
            codes.update(map(id, lane.codes))
        if lanes and (i == len(media) - 1 or places > TABLES):
            for lane, samples in zip(lanes, Lanes(lanes).read(), strict=True):
                out[lane.image] = samples
            lanes, codes, places = [], set(), 0
    return [load(data) if samples is None else samples for data, samples in zip(media, out, strict=True)]


# --- encoder ---


def packed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n words of 64 bits with values below 2^57 from bits at on, in ascending order."""
    values, shift, word = values.astype(np.uint64), (at & 63).astype(np.uint64), at >> 6
    low = values << shift
    high = np.where(shift > 0, values >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out = np.zeros(n + 2, np.uint64)
    out[word[first]] += np.add.reduceat(low, first)
    out[word[first] + 1] += np.add.reduceat(high, first)
    return out[:n].astype("<u8")


class Writer:
    """Bits in reading order; numbers one by one or in arrays."""

    def __init__(self) -> None:
        self.value, self.bits, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.bits
        self.bits += n

    def put_many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """values below 2^57 with up to 57 bits each."""
        if not len(values):
            return
        ends = np.cumsum(sizes) + self.bits
        self.value |= int.from_bytes(packed(values, ends - sizes, int(ends[-1] + 63 >> 6)).tobytes(), "little")
        self.bits = int(ends[-1])

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.bits // 8), "little")


def code_lengths(freq: np.ndarray, longest: int = 12) -> np.ndarray:
    """Lengths of an optimal prefix code; where it is too deep, small counts are raised until it isn't."""
    used = np.flatnonzero(freq)
    lengths = np.zeros(len(freq), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    least = 1
    while True:
        heap = [(max(int(f), least), i) for i, f in enumerate(freq[used].tolist())]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for made in range(len(used), 2 * len(used) - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = made
            heapq.heapreplace(heap, (a + b, made))
        depth = [0] * len(parent)
        for i in range(len(parent) - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= longest:
            lengths[used] = depth[: len(used)]
            return lengths
        least *= 2


def put_code(out: Writer, lengths: np.ndarray) -> None:
    """Write code lengths: as a simple code, or run-length coded with a code of their own."""
    used = np.flatnonzero(lengths)
    if len(used) == 0 or (len(used) <= 2 and used[-1] < 256):
        out.put(1, 1)
        symbols = used.tolist() or [0]
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for s in symbols:
            out.put(s, 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    values = lengths[: used[-1] + 1]
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        v, n = int(values[a]), b - a
        if v:
            tokens.append((v, 0, 0))
            n -= 1
        while n >= 3:
            take = min(n, 6 if v else 138)
            tokens.append((16, take - 3, 2) if v else (17, take - 3, 3) if take <= 10 else (18, take - 11, 7))
            n -= take
        tokens += [(v, 0, 0)] * n
    inner = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    if (inner > 0).sum() == 1:
        inner[0 if inner[0] == 0 else 1] = 1  # keep the inner code complete
    codes, first = dict(zip(*(x.tolist() for x in canonical(inner)), strict=True)), inner.tolist()
    out.put(0, 1)
    n = max(4, max(k for k, s in enumerate(LENGTH_ORDER) if first[s]) + 1)
    out.put(n - 4, 4)
    for k in range(n):
        out.put(first[LENGTH_ORDER[k]], 3)
    if len(tokens) < len(lengths):
        size = max(2, (len(tokens) - 2).bit_length())
        size += size & 1
        out.put(1, 1)
        out.put((size - 2) // 2, 3)
        out.put(len(tokens) - 2, size)
    else:
        out.put(0, 1)
    value = size = 0
    for s, extra, k in tokens:
        value |= (codes[s] | extra << first[s]) << size
        size += first[s] + k
    out.put(value, size)


@functools.lru_cache(64)
def code_bits(lengths: bytes) -> tuple[int, int]:
    out = Writer()
    put_code(out, np.frombuffer(lengths, np.uint8))
    return out.value, out.bits


@functools.lru_cache(64)
def code_table(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their sizes by symbol; a lone symbol takes no bits."""
    k = np.frombuffer(lengths, np.uint8)
    size, code = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    if (k > 0).sum() > 1:
        symbols, codes = canonical(k)
        size[symbols], code[symbols] = k[symbols], codes
    return code, size


@functools.cache
def usual_lengths() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code lengths for text in Latin letters by a fixed rule, for green (with lengths of runs), red and blue."""
    weight = np.full(256, 2.0)
    weight[0x20] = 4000
    for rank, c in enumerate("etaoinrshdlucmpgbfvwyqkxjz"):
        weight[ord(c)] = 2800 / (1 + rank / 4)
        weight[ord(c) - 32] = weight[ord(c)] / 40
    for c in ".,\n-'\"0123456789":
        weight[ord(c)] = 60
    weight[[0x2E, 0x2C]] = 200
    weight[0xC3] = 300
    weight[0xA0:0xC0] = 15
    weight[0xFF] = 100
    green = np.concatenate((weight, np.full(24, 3.0)))
    return code_lengths(green.astype(int)), code_lengths(weight.astype(int)), code_lengths(weight.astype(int))


def all_usual_lengths() -> tuple[np.ndarray, ...]:
    # distance 1 is near offset 2, whose prefix symbol is 1
    return (*usual_lengths(), np.bincount([255], minlength=256).astype(np.uint8), np.bincount([1], minlength=40).astype(np.uint8))


def usual_is_near(counts: list[np.ndarray]) -> bool:
    """Whether codes of the image's own would save less than a sixth."""
    usual = own = 0.0
    for c, k in zip(counts[:3], usual_lengths(), strict=True):
        n = c[c > 0]
        usual += float((c * k).sum())
        own += float((n * np.log2(n.sum() / n)).sum()) + 6 * len(n) + 60
    return 5 * usual <= 6 * own


def prefix_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number for values from 1 on."""
    v = v.astype(np.int64) - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1)), np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


def entropy(counts: np.ndarray) -> float:
    """Bits that symbols with these counts take at least."""
    n = counts[counts > 0].astype(float)
    return float((n * np.log2(n.sum() / n)).sum()) if len(n) else 0.0


def entropies(counts: np.ndarray) -> np.ndarray:
    """The same for each row."""
    n = counts.astype(float)
    return (n * np.log2(n.sum(-1, keepdims=True).clip(1) / n.clip(1))).sum(-1)


def cache_hits(argb: np.ndarray, bits: int) -> np.ndarray:
    """Where in the colour cache each pixel stands, -1 where it isn't there."""
    slot = ((argb.astype(np.int64) * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - bits)
    order = np.argsort(slot, kind="stable")
    same = (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    out = np.full(len(argb), -1)
    out[order[1:][same]] = slot[order[1:][same]]
    return out


def prefix_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number for values from 1 on."""
    v = v.astype(np.int64) - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1)), np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


def runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of references to the pixel before, given which pixels are like it, and which pixels they copy."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    long = stops - starts >= 4
    starts, stops = starts[long], stops[long]
    whole = (stops - starts - 1) // 4096
    if whole.any():  # a reference copies 4096 pixels at most
        k = np.arange(int((whole + 1).sum())) - np.repeat(np.cumsum(whole + 1) - whole - 1, whole + 1)
        starts, ends = np.repeat(starts, whole + 1) + 4096 * k, np.repeat(stops, whole + 1)
        stops = np.minimum(starts + 4096, ends)
    copied = np.zeros(len(same) + 1, np.int8)
    copied[starts] += 1
    np.add.at(copied, stops, -1)
    return starts, stops, np.cumsum(copied[:-1], dtype=np.int8) > 0


def put_pixels(out: Writer, argb: np.ndarray, main: bool = False, cache_bits: int | None = 0, near: bool | None = None) -> None:
    """Entropy-code flat pixels: runs of one pixel as back-references of distance 1; cache_bits: of the colour cache,
    None: CACHE_BITS where codes of the image's own are needed and the cache saves bits; near: what usual_is_near says,
    where it's known."""
    starts, stops, copied = runs(np.concatenate(([False], argb[1:] == argb[:-1])))
    at = np.flatnonzero(~copied)
    x = channels(argb)[at]
    green = x[:, 1].astype(np.int64)
    literal = np.ones(len(at), bool)
    if cache_bits is None:
        cache_bits, plain = 0, [np.bincount(x[:, c], minlength=k) for c, k in ((1, 280), (2, 256), (0, 256))]
        near = usual_is_near(plain) if near is None else near
        if len(at) >= 64 and not near:
            found = cache_hits(argb, CACHE_BITS)[at]
            rest = x[found < 0]
            cost = entropy(np.bincount(np.where(found < 0, green, 256 + found))) + sum(entropy(np.bincount(rest[:, c])) for c in (2, 0)) + 3 * (1 << CACHE_BITS)
            cache_bits = CACHE_BITS if cost < sum(map(entropy, plain)) else 0
    if cache_bits:
        found = cache_hits(argb, cache_bits)[at]
        literal = found < 0
        green = np.where(literal, green, 280 + found)
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    run_symbol, run_extra, run_size = prefix_of(stops - starts) if len(starts) else (np.zeros(0, np.int64),) * 3
    counts = [np.bincount(np.concatenate((green, 256 + run_symbol)), minlength=280 + (1 << cache_bits if cache_bits else 0))]
    counts += [np.bincount(x[literal, c], minlength=256) for c in (2, 0, 3)]
    lengths = all_usual_lengths()
    if cache_bits or not main or counts[3].sum() != counts[3][255] or not (usual_is_near(counts) if near is None else near):
        lengths = (*map(code_lengths, counts), lengths[4])
    for k in lengths:
        header, size = code_bits(k.tobytes())
        out.put(header, size)
    coded = [code_table(k.tobytes()) for k in lengths]
    value, bits = coded[0][0][green], coded[0][1][green]
    for c, (code, size) in zip((2, 0, 3), coded[1:4], strict=True):
        value |= np.where(literal, code[x[:, c]] << bits, 0)
        bits = bits + np.where(literal, size[x[:, c]], 0)
    if len(starts):
        code, size = coded[0]
        run_value, run_bits = code[256 + run_symbol] | run_extra << size[256 + run_symbol], size[256 + run_symbol] + run_size
        order = np.argsort(np.concatenate((at, starts)), kind="stable")
        value, bits = np.concatenate((value, run_value))[order], np.concatenate((bits, run_bits))[order]
    out.put_many(value, bits)


def chosen(argb: np.ndarray) -> tuple[tuple, ...]:
    """Transforms that an image's pixels gain from, by the entropy of what is left: the palette for up to 16 colours;
    else, where its bytes are not as uneven as those of text, subtract-green, predictors by block, and cross-colour."""
    if len(np.unique(argb.reshape(-1)[:64])) <= 16 and len(np.unique(argb)) <= 16:
        return ((PALETTE,),)
    x = channels(argb)
    if entropy(np.bincount(x[..., :3].reshape(-1), minlength=256)) < TEXT_BITS * argb.size * 3:
        return ()
    cost = lambda y: sum(entropy(np.bincount(y[..., c].reshape(-1), minlength=256)) for c in range(3))
    best, picked = cost(x), ()
    tries = [((SUBTRACT_GREEN,),)]
    blocks_ = (-(-argb.shape[0] >> 4), -(-argb.shape[1] >> 4))
    tries += [((PREDICTOR, 4, np.full(blocks_, mode)),) for mode in (1, 2, 7, 12)]
    tries += [((CROSS_COLOUR, 4, np.full(blocks_, 0xFF000000 | e)),) for e in (0x20, 0x2020, 0x202020)]
    for t in tries:
        left = x
        for kind, *rest in t:
            left = channels(green_added(argb, -1) if kind == SUBTRACT_GREEN else residuals(argb, *rest) if kind == PREDICTOR else cross_colour(argb, rest[1].astype(np.uint32), rest[0], -1))
        if (own := cost(left) + 64) < best:
            best, picked = own, t
    return picked


def residuals(argb: np.ndarray, shift: int, modes: np.ndarray) -> np.ndarray:
    """What predictors leave of an image."""
    x = channels(argb).astype(np.int64)
    left, top = np.roll(x, 1, axis=1), np.roll(x, 1, axis=0)
    top_right, top_left = np.roll(x.reshape(-1, 4), x.shape[1] - 1, axis=0).reshape(x.shape), np.roll(left, 1, axis=0)
    guess, kinds = np.zeros_like(x), spread(modes, shift, *argb.shape)
    for mode in np.unique(kinds).tolist():
        guess = np.where((kinds == mode)[..., None], predicted(mode, left, top, top_right, top_left), guess)
    guess[0], guess[1:, 0] = left[0], top[1:, 0]
    guess[0, 0] = (0, 0, 0, 255)
    return np.ascontiguousarray(((x - guess) & 255).astype(np.uint8)).view("<u4").reshape(argb.shape)


def put_head(out: Writer, w: int, h: int, alpha: bool) -> None:
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(alpha, 1)
    out.put(0, 3)


def file_of(body: bytes) -> bytes:
    pad = len(body) & 1
    return b"RIFF" + (12 + len(body) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + bytes(pad)


def encode(pixels: np.ndarray, transforms: tuple[tuple, ...] | None = (), cache_bits: int | None = 0, near: bool | None = None) -> bytes:
    """A lossless WebP file of (height, width, 4) bytes red, green, blue, alpha.

    transforms, in order: (PREDICTOR, shift, modes), (CROSS_COLOUR, shift, elements), (SUBTRACT_GREEN,), (PALETTE,);
    modes and elements are arrays with a number per block. None: those that the image gains from; so for cache_bits.
    """
    h, w, _ = pixels.shape
    if not (0 < h <= MAX_SIDE and 0 < w <= MAX_SIDE):
        raise ValueError("a side is outside 1 to 16384")
    argb = np.ascontiguousarray(pixels[..., [2, 1, 0, 3]]).view("<u4").reshape(h, w)
    transforms = chosen(argb) if transforms is None else transforms
    out = Writer()
    put_head(out, w, h, bool((pixels[..., 3] != 255).any()))
    for kind, *rest in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == PREDICTOR:
            shift, modes = rest
            out.put(shift - 2, 3)
            put_pixels(out, (0xFF000000 | modes.astype(np.uint32) << 8).reshape(-1).astype(np.uint32))
            argb = residuals(argb, shift, modes)
        elif kind == CROSS_COLOUR:
            shift, elements = rest
            out.put(shift - 2, 3)
            put_pixels(out, elements.astype(np.uint32).reshape(-1))
            argb = cross_colour(argb, elements.astype(np.uint32), shift, -1)
        elif kind == SUBTRACT_GREEN:
            argb = green_added(argb, -1)
        else:
            table, index = np.unique(argb, return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            out.put(len(table) - 1, 8)
            step = np.diff(channels(table).astype(np.int64), axis=0, prepend=np.zeros((1, 4), np.int64)) & 255
            put_pixels(out, np.ascontiguousarray(step.astype(np.uint8)).view("<u4").reshape(-1))
            share = bundle(len(table))
            index = np.pad(index.reshape(argb.shape), ((0, 0), (0, -argb.shape[1] % (1 << share))))
            packed = (index.reshape(h, -1, 1 << share) << (np.arange(1 << share) * (8 >> share))).sum(-1)
            argb = (0xFF000000 | packed << 8).astype(np.uint32)
    out.put(0, 1)
    put_pixels(out, argb.reshape(-1).astype("<u4"), main=True, cache_bits=cache_bits, near=near)
    return file_of(out.bytes())


# --- the column operator ---


def pixels_of(payload: bytes) -> np.ndarray:
    """The pixels that hold the bytes, a positive multiple of 576 of them."""
    rows = len(payload) // UNIT
    across = -(-rows // MAX_SIDE)
    down = -(-rows // across)
    pixels = np.zeros((across * down * 192, 4), np.uint8)
    pixels[: rows * 192, :3] = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    pixels[: rows * 192, 3] = 255  # pixels that fill up the last row are transparent
    return pixels.reshape(down, across * 192, 4)


def store(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 576 of them, as a lossless WebP image."""
    return encode(pixels_of(payload), None, None)


def store_many(payloads: list[bytes]) -> list[bytes]:
    """What store gives for each; images of text with the usual codes are made side by side."""
    side = [i for i, p in enumerate(payloads) if len(p) <= 3 * MANY_PIXELS]  # these are 192 pixels wide
    out: list[bytes] = [b""] * len(payloads)
    if side:
        x = np.frombuffer(b"".join(payloads[i] for i in side), np.uint8).reshape(-1, 3)
        count = np.array([len(payloads[i]) // 3 for i in side])
        first, own = np.cumsum(count) - count, np.repeat(np.arange(len(side)), count)
        argb = (x[:, 0].astype(np.uint32) << 16) | (x[:, 1].astype(np.uint32) << 8) | x[:, 2]
        same = np.concatenate(([False], argb[1:] == argb[:-1]))
        same[first] = False
        starts, stops, copied = runs(same)
        tally = lambda at: [np.bincount((own[at] << 8) + x[at, c], minlength=len(side) << 8).reshape(-1, 256) for c in (1, 0, 2)]
        whole = tally(slice(None))
        # as in chosen: no palette (one of 16 colours has 16 values a channel at most), and bytes as uneven as those of text
        text = (np.max([(k > 0).sum(-1) for k in whole], axis=0) > 16) & (entropies(sum(whole)) < TEXT_BITS * 3 * count)
        # as in usual_is_near
        rest = [a - b for a, b in zip(whole, tally(copied), strict=True)]
        usual = sum((n * k[:256]).sum(-1) for n, k in zip(rest, usual_lengths(), strict=True))
        near = 5.0 * usual <= 6 * sum(entropies(n) + 6 * (n > 0).sum(-1) + 60 for n in rest)
        for i, body in zip(np.flatnonzero(text & near).tolist(), usual_bodies(x, count, text & near, starts, stops, copied), strict=True):
            out[side[i]] = file_of(body)
        for i in np.flatnonzero(text & ~near).tolist():
            out[side[i]] = encode(pixels_of(payloads[side[i]]), (), None, near=False)
    return [media or store(p) for p, media in zip(payloads, out, strict=True)]


def usual_bodies(x: np.ndarray, count: np.ndarray, picked: np.ndarray, starts: np.ndarray, stops: np.ndarray, copied: np.ndarray) -> list[bytes]:
    """The streams with the usual codes of the picked ones of the images that lie one after another in x."""
    if not picked.any():
        return []
    head, lengths = Writer(), all_usual_lengths()
    put_head(head, 1, 1, False)
    head.put(0, 3)  # no transform, colour cache or meta image
    for k in lengths:
        head.put(*code_bits(k.tobytes()))
    (g, g_size), (r, r_size), (b, b_size) = (code_table(k.tobytes()) for k in lengths[:3])
    size = g_size[x[:, 1]]
    value = g[x[:, 1]] | r[x[:, 0]] << size
    size += r_size[x[:, 0]]
    value |= b[x[:, 2]] << size
    size += b_size[x[:, 2]]
    symbol, extra, more = prefix_of(stops - starts)
    value[starts], size[starts] = g[256 + symbol] | extra << g_size[256 + symbol], g_size[256 + symbol] + more
    used = np.repeat(picked, count)
    there = ~copied
    there[starts] = True
    at = np.flatnonzero(there & used)
    value, size = value[at], size[at]
    last = np.cumsum(np.add.reduceat(np.concatenate((there, [0])), np.cumsum(count) - count)[picked])
    ends = np.cumsum(size)
    own = np.diff(ends[last - 1], prepend=0) + head.bits  # bits of each image
    words = -(-own // 64)
    word = np.cumsum(words) - words
    images = np.repeat(np.arange(len(last)), np.diff(last, prepend=0))
    before = np.concatenate(([0], ends[last[:-1] - 1]))
    out = packed(value, ends - size + (64 * word + head.bits - before)[images], int(words.sum()))
    fixed = np.frombuffer(head.value.to_bytes(-(-head.bits // 64) * 8, "little"), "<u8")
    out[word[:, None] + np.arange(len(fixed))] |= fixed
    out[word] |= (191 << 8 | (count[picked] // 192 - 1) << 22).astype(np.uint64)
    data = out.tobytes()
    return [data[8 * i : 8 * i + (n + 7) // 8] for i, n in zip(word.tolist(), own.tolist(), strict=True)]


def load(media: bytes) -> np.ndarray:
    """The samples of an image as flat bytes."""
    pixels = decode(media).reshape(-1, 4)
    return np.ascontiguousarray(pixels[pixels[:, 3] > 0, :3]).reshape(-1)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a 64-bit hash of which of 64 equal strips are lighter than the mean."""
    strips = samples.reshape(64, -1).mean(axis=1)
    bits = np.packbits(strips > strips.mean()).tobytes().hex()
    return f"{samples.mean():.4f}:{samples.std():.4f}:{bits}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as an image, read it back, and describe both; keep_media adds the image as column media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (c.slice(k, MANY) for c in blocks(batch, "text", BLOCK) for k in range(0, c.num_rows, MANY)):
                data, offsets = utf8(b.column("text"))
                raw, rows, sizes = data.tobytes(), [], np.diff(offsets).tolist()
                kept = store_many([raw[i : i + n].ljust(max(1, -(-n // UNIT)) * UNIT, b"\xff") for i, n in zip(offsets.tolist(), sizes, strict=False)])
                for n, media, samples in zip(sizes, kept, load_many(kept), strict=True):
                    back = samples.tobytes()
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = [b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_media, [x.split()[0] for x in SCHEMA.split(", ")] + ["media"] * keep_media)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    return rows.mapInArrow(run, SCHEMA + ", media binary" * keep_media)


def op8_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
