"""Media columns: documents as lossless WebP images, written and read with numpy.

:func:`decode` reads any lossless WebP (VP8L) stream: prefix codes, back-references, colour cache, several code
groups, and the predictor, cross-colour, subtract-green and palette transforms. :func:`decode_many` reads many
streams side by side, one pixel of each at a time, in the same general way.
:func:`encode` chooses for each image, by estimated bits, a predictor, cross-colour or subtract-green, or a palette,
and a colour cache; it refers back to repeated pixels and writes Huffman codes of mixed length. :func:`encode_with` writes
streams with given transforms, several code groups and random parameters, for tests.

A payload is a text's UTF-8 bytes and zero bytes up to a positive multiple of 64; four bytes are one RGBA pixel.

Defined results: a null or empty text has a payload of 64 zero bytes; equal texts give equal
rows; very long texts get wider images, whose words are made and packed in blocks; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, utf8_parts

# Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
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
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MOST = 16384
#: Bits of a code word that :func:`encode` writes and images read side by side may have at most; longer ones are read one by one.
MOST_BITS = 12
CACHE_BITS = 9
#: Images and pixels that are read side by side, and how many images still are.
GROUP = 2048
GROUP_PIXELS = 4 << 20
FEW = 48
#: Pixels whose words are made and packed at once; references don't reach over it.
BLOCK = 1 << 19
#: Pixels on which transforms are compared.
TRIED = 1 << 11


class Broken(ValueError):
    """The stream is not a lossless WebP."""


# ---------------------------------------------------------------------------------------------------- reading


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise Broken("the stream ends early")
        word = int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little")
        return word >> (at & 7) & ((1 << n) - 1)


class Code:
    """A canonical prefix code from its words' lengths."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        if not len(used):
            raise Broken("a code without words")
        self.symbols, self.sizes = used, lengths[used]
        if len(used) == 1:
            self.sizes = np.zeros(1, dtype=np.int64)
        elif (1 << (15 - self.sizes)).sum() != 1 << 15:
            raise Broken("a code that is not complete")
        self.width = int(self.sizes.max())

    @cached_property
    def table(self) -> np.ndarray:
        """16 * symbol + length of its word, by the next ``width`` bits of the stream."""
        order = self.sizes.argsort(kind="stable")
        sizes = self.sizes[order]
        return (self.symbols[order] << 4 | sizes).repeat(1 << (self.width - sizes))[_reversed(self.width)]

    @cached_property
    def entries(self) -> list:
        return self.table.tolist()

    def read(self, bits: Bits) -> int:
        at = bits.at
        entry = self.entries[int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & ((1 << self.width) - 1)]
        bits.at = at + (entry & 15)
        if bits.at > bits.end:
            raise Broken("the stream ends early")
        return entry >> 4


def _read_code(bits: Bits, symbols: int) -> Code:
    lengths = np.zeros(max(symbols, 256), dtype=np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths[:symbols])
    own = [0] * 19
    count = 4 + bits.read(4)
    raw = bits.read(3 * count)
    for i in range(count):
        own[CODE_ORDER[i]] = raw >> 3 * i & 7
    entries = _short_entries(tuple(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    found, previous, at = bytearray(), 8, 0
    data, pos, have, word = bits.data, bits.at, 0, 0
    while at < symbols and left:
        if have < 14:
            word = int.from_bytes(data[pos >> 3 : (pos >> 3) + 16], "little") >> (pos & 7)
            have = 121
        left -= 1
        entry = entries[word & 127]
        size, value = entry & 15, entry >> 4
        if value < 16:
            found.append(value)
            at += 1
            if value:
                previous = value
            word >>= size
        else:
            if value == 16:
                more, times = 2, 3 + (word >> size & 3)
            elif value == 17:
                more, times = 3, 3 + (word >> size & 7)
            else:
                more, times = 7, 11 + (word >> size & 127)
            found += bytes((previous if value == 16 else 0,)) * times
            at += times
            size += more
            word >>= size
        pos += size
        have -= size
    bits.at = pos
    if pos > bits.end:
        raise Broken("the stream ends early")
    if at > symbols:
        raise Broken("too many code lengths")
    return Code(np.frombuffer(found, dtype=np.uint8).astype(np.int64))


@lru_cache(maxsize=4096)
def _short_entries(own: tuple) -> list:
    """16 * symbol + length of its word, by the next 7 bits, for the code of code lengths."""
    used = sorted((n, symbol) for symbol, n in enumerate(own) if n)
    if not used:
        raise Broken("a code without words")
    if len(used) == 1:
        return [used[0][1] << 4] * 128
    if sum(128 >> n for n, _ in used) != 128:
        raise Broken("a code that is not complete")
    entries, word = [0] * 128, 0
    for n, symbol in used:
        first = int(f"{word >> 7 - n:0{n}b}"[::-1], 2)
        entries[first :: 1 << n] = [symbol << 4 | n] * (128 >> n)
        word += 128 >> n
    return entries


class Head:
    """What stands before an image's pixels: colour cache, code groups and where they hold."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.width, self.height = width, height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise Broken("a colour cache that is too large")
        self.groups_of, self.group_bits = None, 0
        if main and bits.read(1):
            self.group_bits = bits.read(3) + 2
            self.groups_of = (_read_image(bits, -(-width >> self.group_bits), -(-height >> self.group_bits), False) >> 8 & 0xFFFF).tolist()
        cached = 1 << self.cache_bits if self.cache_bits else 0
        number = 1 + max(map(max, self.groups_of)) if self.groups_of else 1
        self.groups = [[_read_code(bits, n) for n in (280 + cached, 256, 256, 256, 40)] for _ in range(number)]


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as ARGB words, (height, width)."""
    return _read_pixels(bits, Head(bits, width, height, main))


@lru_cache(maxsize=16)
def _reversed(width: int) -> np.ndarray:
    values = np.arange(1 << width)
    out = np.zeros_like(values)
    for k in range(width):
        out |= (values >> k & 1) << (width - 1 - k)
    return out


def _extended(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_pixels(bits: Bits, head: Head, out=(), cache=None, length: int = 0, distance: int = 0) -> np.ndarray:
    """Pixels one after the other, from the start or from where :func:`_side_by_side` left an image."""
    width, n = head.width, head.width * head.height
    at, cache_bits = len(out), head.cache_bits
    out = array("I", np.concatenate([np.asarray(out, dtype=np.uint32), np.zeros(n - at, dtype=np.uint32)]).tobytes())
    shift = 32 - cache_bits
    cache = cache or [0] * (1 << cache_bits)
    data, pos = bits.data, bits.at
    tables = [[x for c in codes[:4] for x in (c.entries, (1 << c.width) - 1)] for codes in head.groups]
    greens, green_mask, reds, red_mask, blues, blue_mask, alphas, alpha_mask = tables[0]
    while at < n:
        if not length:
            if head.groups_of:
                group = head.groups_of[at // width >> head.group_bits][at % width >> head.group_bits]
                greens, green_mask, reds, red_mask, blues, blue_mask, alphas, alpha_mask = tables[group]
            word = int.from_bytes(data[pos >> 3 : (pos >> 3) + 9], "little") >> (pos & 7)
            entry = greens[word & green_mask]
            symbol, size = entry >> 4, entry & 15
            if symbol < 256:
                word >>= size
                red = reds[word & red_mask]
                word >>= red & 15
                blue = blues[word & blue_mask]
                word >>= blue & 15
                alpha = alphas[word & alpha_mask]
                pos += size + (red & 15) + (blue & 15) + (alpha & 15)
                out[at] = value = alpha >> 4 << 24 | red >> 4 << 16 | symbol << 8 | blue >> 4
            elif symbol >= 280:
                pos += size
                out[at] = value = cache[symbol - 280]
            else:
                bits.at = pos + size
                length = _extended(bits, symbol - 256)
                distance = _distance(_extended(bits, head.groups[group if head.groups_of else 0][4].read(bits)), width)
                pos = bits.at
        if length:
            if distance > at or at + length > n:
                raise Broken("a reference out of the image")
            for k in range(at, at + length):
                out[k] = value = out[k - distance]
                if cache_bits:
                    cache[(CACHE_FACTOR * value & 0xFFFFFFFF) >> shift] = value
            at += length
            length = 0
            continue
        if cache_bits:
            cache[(CACHE_FACTOR * value & 0xFFFFFFFF) >> shift] = value
        at += 1
    bits.at = pos
    if pos > bits.end:
        raise Broken("the stream ends early")
    return np.frombuffer(out, dtype=np.uint32).reshape(head.height, width)


def _side_by_side(images: list[tuple[Bits, Head]]) -> list[np.ndarray]:
    """Pixels of images with one code group each, largest first: every step makes one pixel of all images that have one left.

    When fewer than FEW are left, they are read to their end one by one.
    """
    heads = [h for _, h in images]
    n, k = np.array([h.width * h.height for h in heads]), len(images)
    width = max(c.width for h in heads for c in h.groups[0][:4])
    tables = np.empty((4, k, 1 << width), dtype=np.uint16)
    for i, h in enumerate(heads):
        for channel, code in enumerate(h.groups[0][:4]):
            tables[channel, i].reshape(-1, 1 << code.width)[:] = code.table
    tables = tables.reshape(4, -1)
    rows = np.arange(k) << width
    mask = (1 << width) - 1
    data = np.frombuffer(b"".join([b.data for b, _ in images] + [bytes(16)]), dtype=np.uint8)
    eight = np.ndarray((len(data) - 7,), dtype="<i8", buffer=data, strides=(1,))  # the sign only fills bits that are never looked at
    lengths = np.array([len(b.data) for b, _ in images])
    first = 8 * (np.cumsum(lengths) - lengths)
    pos = first + np.array([b.at for b, _ in images])
    last = len(eight) - 1
    bases = np.cumsum(n) - n
    out = np.zeros(n.sum(), dtype=np.uint32)
    cache_bits = np.array([h.cache_bits for h in heads])
    slots = max(1, int((1 << cache_bits).max()))
    cached = bool(cache_bits.any())
    cache = np.zeros(k * slots, dtype=np.uint32)
    shift = 32 - cache_bits
    shift[cache_bits == 0] = 31  # such images have no cache symbols and never read what is kept for them
    slot_rows = np.arange(k) * slots
    left, distance = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
    copying = 0
    ends = np.unique(n)
    step, live = 0, k
    while live >= FEW:
        for step in range(step, int(ends[np.searchsorted(ends, step, side="right")])):
            if copying:
                at = (left[:live] == 0).nonzero()[0]
                where, row = pos[at], rows[at]
            else:
                at, where, row = None, pos[:live], rows[:live]
            word = eight[np.minimum(where >> 3, last)] >> (where & 7)
            green = tables[0][row + (word & mask)]
            size = green & 15
            total = size.astype(np.int64)
            pixel = (green >> 4).astype(np.int64)
            other = (pixel >= 256).nonzero()[0]
            symbol = pixel[other]
            pixel <<= 8
            for channel, bits in ((1, 16), (2, 0), (3, 24)):
                word >>= size
                entry = tables[channel][row + (word & mask)]
                size = entry & 15
                total += size
                pixel |= (entry >> 4).astype(np.int64) << bits
            if len(other):
                total[other] = green[other] & 15
            if at is None:
                pos[:live] = where + total
                values = pixel
            else:
                pos[at] = where + total
                values = np.empty(live, dtype=np.int64)
                values[at] = pixel
            if len(other):
                which = other if at is None else at[other]
                hit = symbol >= 280
                values[which[hit]] = cache[slot_rows[which[hit]] + symbol[hit] - 280]
                if not hit.all():
                    for i, code in zip(which[~hit].tolist(), symbol[~hit].tolist(), strict=True):
                        bits = images[i][0]
                        bits.at = int(pos[i] - first[i])
                        left[i] = _extended(bits, code - 256)
                        distance[i] = _distance(_extended(bits, heads[i].groups[0][4].read(bits)), heads[i].width)
                        pos[i] = first[i] + bits.at
                        if distance[i] > step or step + left[i] > n[i]:
                            raise Broken("a reference out of the image")
                        copying += 1
            if copying:
                at = np.flatnonzero(left[:live])
                values[at] = out[bases[at] + step - distance[at]]
                left[at] -= 1
                copying -= int((left[at] == 0).sum())
            out[bases[:live] + step] = values
            if cached:
                cache[slot_rows[:live] + ((values * CACHE_FACTOR & 0xFFFFFFFF) >> shift[:live] & slots - 1)] = values
        step += 1
        live = int(np.searchsorted(-n, -step, side="left"))
    done = []
    for i, (bits, head) in enumerate(images):
        bits.at = int(pos[i] - first[i])
        if bits.at > bits.end:
            raise Broken("the stream ends early")
        if i < live:
            own = cache[slot_rows[i] : slot_rows[i] + (1 << head.cache_bits)].tolist()
            done.append(_read_pixels(bits, head, out[bases[i] : bases[i] + step], own, int(left[i]), int(distance[i])))
        else:
            done.append(out[bases[i] : bases[i] + n[i]].reshape(head.height, head.width))
    return done


# ------------------------------------------------------------------------------------------------- transforms


def _planes(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) channel values: alpha, red, green, blue."""
    return np.stack([(pixels >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (24, 16, 8, 0)], axis=-1)


def _words(planes: np.ndarray) -> np.ndarray:
    a, r, g, b = (planes[..., k].astype(np.uint32) & np.uint32(255) for k in range(4))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def predicted(mode: int, left, top, top_right, top_left):
    """One prediction, channel by channel; arguments are arrays of four channels (or of many pixels)."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(top)).copy()
    if mode == 1:
        return left
    if mode in (2, 3, 4):
        return (top, top_right, top_left)[mode - 2]
    if mode == 5:
        return (((left + top_right) >> 1) + top) >> 1
    if mode in (6, 7, 8, 9):
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return (a + b) >> 1
    if mode == 10:
        return (((left + top_left) >> 1) + ((top + top_right) >> 1)) >> 1
    if mode == 11:
        nearer = np.abs(top - top_left).sum(axis=-1, keepdims=True) < np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = (left + top) >> 1
    return np.clip(mean + np.sign(mean - top_left) * (np.abs(mean - top_left) >> 1), 0, 255)


def _mode_rows(modes: np.ndarray, bits: int, y: int, width: int) -> np.ndarray:
    return np.repeat(modes[y >> bits] >> np.uint32(8) & np.uint32(15), 1 << bits)[:width]


def _runs(row: np.ndarray, start: int):
    cuts = np.flatnonzero(row[start + 1 :] != row[start:-1]) + start + 1
    return zip([start, *cuts], [*cuts, len(row)], strict=True)


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    residual = _planes(pixels)
    height, width = pixels.shape
    out = np.zeros_like(residual)
    for y in range(height):
        row = out[y]
        if y == 0:
            residual[0, 0] += (255, 0, 0, 0)
            row[:] = np.cumsum(residual[0], axis=0) & 255
            continue
        above = out[y - 1]
        row[0] = (residual[y, 0] + above[0]) & 255
        if width == 1:
            continue
        following = np.concatenate([above[1:], row[:1]])
        mode_row = _mode_rows(modes, bits, y, width)
        for i, j in _runs(mode_row, 1):
            mode = int(mode_row[i])
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                row[i:j] = (residual[y, i:j] + predicted(mode, None, above[i:j], following[i:j], above[i - 1 : j - 1])) & 255
            elif mode == 1:
                row[i:j] = (row[i - 1] + np.cumsum(residual[y, i:j], axis=0)) & 255
            else:
                for x in range(i, j):
                    row[x] = (residual[y, x] + predicted(mode, row[x - 1], above[x], following[x], above[x - 1])) & 255
    return _words(out)


def apply_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    planes = _planes(pixels)
    height, width = pixels.shape
    out = np.empty_like(planes)
    for y in range(height):
        if y == 0:
            out[0, 0] = planes[0, 0] - (255, 0, 0, 0)
            out[0, 1:] = planes[0, 1:] - planes[0, :-1]
            continue
        out[y, 0] = planes[y, 0] - planes[y - 1, 0]
        if width == 1:
            continue
        following = np.concatenate([planes[y - 1, 1:], planes[y, :1]])
        mode_row = _mode_rows(modes, bits, y, width)
        for i, j in _runs(mode_row, 1):
            out[y, i:j] = planes[y, i:j] - predicted(int(mode_row[i]), planes[y, i - 1 : j - 1], planes[y - 1, i:j], following[i:j], planes[y - 1, i - 1 : j - 1])
    return _words(out)


def _signed(x):
    return ((x + 128) & 255) - 128


def _cross(pixels: np.ndarray, factors: np.ndarray, bits: int, sign: int) -> np.ndarray:
    rows = max(1, (BLOCK // pixels.shape[1]) >> bits)  # of factors, so that memory follows a block
    return np.concatenate([_cross_rows(pixels[y << bits : y + rows << bits], factors[y : y + rows], bits, sign) for y in range(0, len(factors), rows)])


def _cross_rows(pixels: np.ndarray, factors: np.ndarray, bits: int, sign: int) -> np.ndarray:
    height, width = pixels.shape
    own = np.repeat(np.repeat(_planes(factors), 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]
    red_to_blue, green_to_blue, green_to_red = own[..., 1], own[..., 2], own[..., 3]
    delta = lambda t, c: (_signed(t) * _signed(c)) >> 5
    planes = _planes(pixels)
    a, r, g, b = (planes[..., k] for k in range(4))
    new_red = (r + sign * delta(green_to_red, g)) & 255
    true_red = new_red if sign > 0 else r
    new_blue = (b + sign * (delta(green_to_blue, g) + delta(red_to_blue, true_red))) & 255
    return _words(np.stack([a, new_red, g, new_blue], axis=-1))


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    out = np.array(pixels, dtype="<u4", order="C")
    samples = out.view(np.uint8).reshape(*out.shape, 4)  # blue, green, red, alpha
    for channel in (0, 2):
        if sign > 0:
            samples[..., channel] += samples[..., 1]
        else:
            samples[..., channel] -= samples[..., 1]
    return out


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _undo_palette(pixels: np.ndarray, palette: np.ndarray, bits: int, width: int) -> np.ndarray:
    index = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if bits:
        each = 8 >> bits
        index = (index[:, :, None] >> (np.arange(1 << bits) * each) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros(256, dtype=np.uint32)
    full[: len(palette)] = palette
    return full[index]


class Stream:
    """A lossless WebP read up to the pixels of its main image."""

    def __init__(self, data: bytes):
        if len(data) < 26 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
            raise Broken("no lossless WebP")
        (size,) = struct.unpack_from("<I", data, 16)
        if data[20] != SIGNATURE or 20 + size > len(data):
            raise Broken("no lossless WebP")
        self.bits = bits = Bits(data[21 : 20 + size])
        width, height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise Broken("an unknown version")
        self.transforms, seen = [], set()
        now = width
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise Broken("a transform twice")
            seen.add(kind)
            if kind in (PREDICTOR, CROSS_COLOUR):
                block = bits.read(3) + 2
                self.transforms.append((kind, _read_image(bits, -(-now >> block), -(-height >> block), False), block, now))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind, None, 0, now))
            else:
                count = bits.read(8) + 1
                steps = _planes(_read_image(bits, count, 1, False)[0])
                packed = palette_bits(count)
                self.transforms.append((kind, _words(np.cumsum(steps, axis=0)), packed, now))
                now = -(-now >> packed)
        self.head = Head(bits, now, height, True)
        self.size = now * height

    @property
    def alike(self) -> bool:
        """Whether :func:`_side_by_side` takes it: one code group, words that leave four in 57 bits."""
        return self.head.groups_of is None and max(c.width for c in self.head.groups[0]) <= MOST_BITS

    def samples(self, pixels: np.ndarray) -> np.ndarray:
        """(height, width, 4) samples, RGBA: all transforms undone."""
        for kind, extra, block, before in reversed(self.transforms):
            if kind == PREDICTOR:
                pixels = undo_predictor(pixels, extra, block)
            elif kind == CROSS_COLOUR:
                pixels = _cross(pixels, extra, block, 1)
            elif kind == SUBTRACT_GREEN:
                pixels = _green(pixels, 1)
            else:
                pixels = _undo_palette(pixels, extra, block, before)
        return _turned(np.ascontiguousarray(pixels, dtype="<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def _turned(pixels: np.ndarray) -> np.ndarray:
    """Red and blue in each other's place: ARGB words from RGBA samples and back."""
    return pixels & np.uint32(0xFF00FF00) | pixels >> np.uint32(16) & np.uint32(0xFF) | (pixels & np.uint32(0xFF)) << np.uint32(16)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) samples, RGBA."""
    stream = Stream(data)
    return stream.samples(_read_pixels(stream.bits, stream.head))


def decode_many(streams: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(number, samples) of all streams, in an order of its own; images of like size are read side by side."""
    order = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
    at = 0
    while at < len(order):
        group, size = [], 0
        while at < len(order) and len(group) < GROUP and (not group or size < GROUP_PIXELS):
            group.append((order[at], Stream(streams[order[at]])))
            size += group[-1][1].size
            at += 1
        for i, stream in group:
            if not stream.alike:
                yield i, stream.samples(_read_pixels(stream.bits, stream.head))
        alike = sorted((x for x in group if x[1].alike), key=lambda x: -x[1].size)
        if alike:
            for (i, stream), pixels in zip(alike, _side_by_side([(x.bits, x.head) for _, x in alike]), strict=True):
                yield i, stream.samples(pixels)


# ---------------------------------------------------------------------------------------------------- writing


class Writer:
    def __init__(self):
        self.word, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.word |= int(value) << self.size
        self.size += n


def _head(width: int, height: int) -> Writer:
    out = Writer()
    for value, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out


def _container(stream: bytes) -> bytes:
    body = bytes([SIGNATURE]) + stream
    padded = body + b"\x00" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded


def _put_simple(out: Writer, symbols: list[int]) -> None:
    out.put(1, 1)
    out.put(len(symbols) - 1, 1)
    wide = symbols[0] > 1
    out.put(wide, 1)
    out.put(symbols[0], 8 if wide else 1)
    if len(symbols) == 2:
        out.put(symbols[1], 8)


#: For runs of up to 138 zeros among code lengths: the symbol, the run it begins with and its extra bits. END ends a code in a list of several.
END = 19
KINDS, LEASTS, EXTRAS = np.array([(-1, 0, 0), (0, 1, 0), (0, 2, 0), *[(17, 3, 3)] * 8, *[(18, 11, 7)] * 128]).T


@lru_cache(maxsize=1)
def _x_log_x() -> np.ndarray:
    x = np.arange(1, (1 << 16) + 1, dtype=float)
    return np.concatenate([[0], x * np.log2(x)])


def _entropies(counts: np.ndarray) -> np.ndarray:
    """Bits of all values of each row of counts."""
    total = counts.sum(axis=-1)
    table = _x_log_x()
    if total.max(initial=0) < len(table):
        return table[total] - table[counts].sum(axis=-1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=-1)


def _channel_bits(planes: np.ndarray) -> np.ndarray:
    """Entropy in bits of every (..., 4, n) array of channel bytes."""
    flat = planes.reshape(-1, planes.shape[-1])
    offsets = (np.arange(len(flat), dtype=np.int32) << 8)[:, None]
    counts = sum(np.bincount((flat[:, lo : lo + BLOCK] + offsets).reshape(-1), minlength=len(flat) << 8) for lo in range(0, max(1, flat.shape[1]), BLOCK))
    return _entropies(counts.reshape(-1, 256)).reshape(planes.shape[:-1]).sum(axis=-1)


def _factor(green: np.ndarray, other: np.ndarray) -> int:
    """The multiple (in 32nds) of green that leaves least of another channel, both as signed bytes."""
    g, x = green.view(np.int8).astype(float), other.view(np.int8).astype(float)
    g -= g.mean()
    square = (g * g).sum()
    return int(np.clip(np.rint(32 * (g * x).sum() / square), -128, 127)) if square else 0


def _chosen(pixels: np.ndarray) -> tuple[list, int]:
    """Transforms in order as (kind, parameter), and the number of distinct pixels."""
    width = pixels.shape[1]
    flat = np.ascontiguousarray(pixels.reshape(-1)[:TRIED], dtype="<u4")
    n = len(flat)
    own = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4)[:, ::-1].T)  # alpha, red, green, blue
    left, top = own.copy(), own.copy()
    left[:, 1:] -= own[:, :-1]
    top[:, width:] -= own[:, :-width]
    spatial = np.stack([own, left, top])
    bits = _channel_bits(spatial)
    bits[1:] += 64  # the transform's own image
    best = int(bits.argmin())
    now, least = spatial[best], bits[best]
    green, red, blue = now[2], now[1], now[3]
    to_red, to_blue = _factor(green, red), _factor(green, blue)
    signed = green.view(np.int8).astype(np.int32)
    less, cross = now.copy(), now.copy()
    less[[1, 3]] -= green
    cross[1] -= (to_red * signed >> 5).astype(np.uint8)
    cross[3] -= (to_blue * signed >> 5).astype(np.uint8)
    colour = _channel_bits(np.stack([less, cross])) + (0, 96)
    transforms = [(PREDICTOR, best)] if best else []
    if colour.min() < least:
        transforms.append((SUBTRACT_GREEN, 0) if colour[0] <= colour[1] else (CROSS_COLOUR, (to_blue & 255) << 8 | to_red & 255))
        least = colour.min()
    ordered = np.sort(pixels, axis=None)
    cuts = (ordered[1:] != ordered[:-1]).nonzero()[0] + 1
    if len(cuts) < 256:
        colours = np.diff(np.concatenate([[0], cuts, [len(ordered)]]))
        # Bits of the palette as of so many pixels, and of the indexes.
        wanted = bits[0] / n * len(colours) + _entropies(colours)
        if wanted < least * pixels.size / n:
            return [(PALETTE, 0)], len(cuts) + 1
    return transforms, len(cuts) + 1


def _limited(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits, by two queues: leaves in ascending order, and sums as they arise."""
    used = counts.nonzero()[0]
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    plain = counts[order].tolist()
    floor, n = 1, len(order)
    while True:
        leaves = [*(plain if floor == 1 else [max(x, floor) for x in plain]), 1 << 62]
        sums, parents, i, j = [], [0] * (2 * n - 1), 0, 0
        for t in range(n, 2 * n - 1):
            if n + j == t or leaves[i] <= sums[j]:
                both = leaves[i]
                parents[i] = t
                i += 1
            else:
                both = sums[j]
                parents[n + j] = t
                j += 1
            if n + j == t or leaves[i] <= sums[j]:
                both += leaves[i]
                parents[i] = t
                i += 1
            else:
                both += sums[j]
                parents[n + j] = t
                j += 1
            sums.append(both)
        depths = [0] * (2 * n - 1)
        for t in range(2 * n - 3, -1, -1):
            depths[t] = depths[parents[t]] + 1
        if depths[0] <= most:  # the rarest leaf is deepest
            lengths[order] = depths[:n]
            return lengths
        floor = max(2 * floor, sums[-1] >> most + 1)


def _flush(parts: list, pairs: list) -> None:
    """Move (value, bits) pairs to the parts of a stream."""
    parts.append((np.array([v for v, _ in pairs], dtype=np.uint64), np.array([n for _, n in pairs], dtype=np.int64)))
    pairs.clear()


def _put_codes(parts: list, counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Describe a Huffman code for each of ``counts``; for each, words in the order of the stream and their lengths, by symbol.

    The codes' lengths are all written in one code of lengths, which is made for them together.
    """
    simple, lengths, written = [], [], []
    for count in counts:
        used = count.nonzero()[0]
        if len(used) <= 2 and (len(used) == 0 or used[-1] < 256):
            simple.append(used.tolist() or [0])
            own = np.zeros(len(count), dtype=np.int64)
            own[used] = 1
        else:
            simple.append(None)
            own = _limited(count, MOST_BITS)
            written += [own, [END]]
        lengths.append(own if len(used) > 1 else np.zeros(len(count), dtype=np.int64))
    ends = np.cumsum([len(x) for x in lengths]).tolist()
    words, sizes = _stream_words(lengths), np.concatenate(lengths)
    if written:
        # Runs of zeros before each used symbol and before the end; what is over 138 goes into runs of its own.
        flat = np.concatenate(written)
        used = flat.nonzero()[0]
        literal = flat[used]
        runs = used.copy()
        runs[1:] -= used[:-1] + 1
        more = np.maximum(runs - 1, 0) // 138
        if more.any():
            last = np.cumsum(more + 1) - 1
            spread, literals = np.full(last[-1] + 1, 138), np.full(last[-1] + 1, -1)
            spread[last], literals[last] = runs - 138 * more, literal
            runs, literal = spread, literals
        tokens = np.full((len(runs), 3), -1)
        extra = np.zeros((2, len(runs), 3), dtype=np.int64)
        tokens[:, 2] = literal
        tokens[:, 0] = KINDS[runs]
        tokens[runs == 2, 1] = 0
        extra[0, :, 0] = runs - LEASTS[runs]
        extra[1, :, 0] = EXTRAS[runs]
        there = tokens >= 0
        tokens, extra = tokens[there], extra[:, there]
        borders = [-1, *(tokens == END).nonzero()[0].tolist()]
        own = _limited(np.bincount(tokens, minlength=END + 1)[:19], 7)
        head = [(0, 1), (15, 4), *[(n, 3) for n in own[list(CODE_ORDER)].tolist()], (0, 1)]
        own_words = _stream_words([own])
        if np.count_nonzero(own) == 1:
            own = np.zeros_like(own)
        own, own_words = np.append(own, 0), np.append(own_words, np.uint64(0))
        token_sizes = own[tokens]
        values, token_sizes = own_words[tokens] | extra[0].astype(np.uint64) << token_sizes.astype(np.uint64), token_sizes + extra[1]
    out, number = [], 0
    for symbols in simple:
        if symbols:
            wide = int(symbols[0] > 1)
            out += [(1, 1), (len(symbols) - 1, 1), (wide, 1), (symbols[0], 8 if wide else 1), *[(x, 8) for x in symbols[1:]]]
        else:
            out += head
            _flush(parts, out)
            i, j = borders[number] + 1, borders[number + 1]
            parts.append((values[i:j], token_sizes[i:j]))
            number += 1
    if out:
        _flush(parts, out)
    return [(words[i:j], sizes[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def _stream_words(lengths: list[np.ndarray]) -> np.ndarray:
    """Canonical words, with their first bit lowest, of complete codes one after the other; a code without lengths has words of no bits."""
    flat = np.concatenate(lengths)
    words = np.zeros(len(flat), dtype=np.uint64)
    used = flat.nonzero()[0]
    if len(used) > 1:
        number = np.repeat(np.arange(len(lengths)), [len(x) for x in lengths])[used]
        order = (number << 4 | flat[used]).argsort(kind="stable")
        used = used[order]
        spans = 1 << MOST_BITS - flat[used]
        # Each code's words fill 2 ** MOST_BITS, so the next one begins at 0 again; a word's bits are followed by zeros, reversed.
        words[used] = _reversed(MOST_BITS)[np.cumsum(spans) - spans & (1 << MOST_BITS) - 1]
    return words


def _repeats(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeated runs of 3 pixels or more, greedily from the left."""
    n = len(flat)
    if n < 6:
        return []
    wide = flat.astype(np.uint64)
    keys = wide[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ wide[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    if not len(same):
        return []
    starts, before = order[same + 1], order[same]
    by_start = np.argsort(starts)
    found, at = [], 0
    for i, j in zip(starts[by_start].tolist(), before[by_start].tolist(), strict=True):
        if i < at:
            continue
        most, length, piece = min(n - i, 4096), 0, 32
        while length < most:
            now = min(piece, most - length)
            differ = np.flatnonzero(flat[i + length : i + length + now] != flat[j + length : j + length + now])
            if len(differ):
                length += int(differ[0])
                break
            length, piece = length + now, 4 * piece
        if length >= 3:
            found.append((i, length, i - j))
            at = i + length
    return found


def _slots(flat: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's slot in the colour cache, and whether the slot then holds the pixel."""
    slots = flat * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)
    order = np.argsort(slots, kind="stable")
    hit = np.zeros(len(flat), dtype=bool)
    hit[order[1:]] = flat[order[1:]] == flat[order[:-1]]  # equal pixels have equal slots
    return slots, hit


NEAR_ORDER = tuple(reversed(list(enumerate(NEAR))))


def _put_coded(parts: list, pixels: np.ndarray, main: bool, distinct: int = 0) -> None:
    """An image with Huffman codes; the main one with references, and a colour cache where it is estimated to save bits."""
    width = pixels.shape[1]
    flat = np.ascontiguousarray(pixels.reshape(-1), dtype="<u4")
    n = len(flat)
    out = []
    references = [(lo + at, length, distance) for lo in range(0, n, BLOCK) for at, length, distance in _repeats(flat[lo : lo + BLOCK])] if main else []
    starts = np.ones(n, dtype=bool)  # pixels at which a literal or a cached pixel stands
    for at, length, _ in references:
        starts[at : at + length] = False
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4)[:, ::-1].T)
    literal, hit, slots, cache_bits = starts, None, None, 0
    if main and n > distinct:
        tried = min(CACHE_BITS, max(1, int(distinct - 1).bit_length()))
        slots, hit = _slots(flat, tried)
        hit &= starts
        if hit.any():
            rest = starts & ~hit
            used = np.bincount(slots[hit], minlength=1 << tried)
            # Green and cache symbols share a code; a symbol's length and the zeros before it take some 7 bits.
            green = np.concatenate([np.bincount(planes[2, rest], minlength=256), used])
            with_cache = _entropies(green) + _channel_bits(planes[[0, 1, 3]][:, rest]) + 7 * np.count_nonzero(used) if rest.any() else 0
            if with_cache < _channel_bits(planes[:, starts] if references else planes):
                literal, cache_bits = rest, tried
    out.append((1, 1) if cache_bits else (0, 1))
    if cache_bits:
        out.append((cache_bits, 4))
    if main:
        out.append((0, 1))
    near = {max(1, x + y * width): k + 1 for k, (x, y) in NEAR_ORDER} if references else {}
    copies = [(at, _prefix(length), _prefix(near.get(distance, distance + len(NEAR)))) for at, length, distance in references]
    own = planes[:, literal]
    counts = [np.bincount(own[c], minlength=256) for c in (2, 1, 3, 0)]
    cached = slots[hit] if cache_bits else np.zeros(0, dtype=np.int64)
    tail = np.bincount(cached, minlength=(1 << cache_bits) if cache_bits else 0)
    counts[0] = np.concatenate([counts[0], np.bincount([c[1][0] for c in copies], minlength=24).astype(np.int64), tail])
    counts.append(np.bincount([c[2][0] for c in copies], minlength=40).astype(np.int64))
    _flush(parts, out)
    codes = _put_codes(parts, counts)
    parts.append(_pixels_coded(planes, literal, hit if cache_bits else None, slots, copies, codes))


def _pixels_coded(planes, literal, hit, slots, copies, codes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and their lengths, BLOCK pixels at a time; nothing stands at pixels that are copied."""
    number = 0
    for lo in range(0, len(literal), BLOCK):
        here = literal[lo : lo + BLOCK]
        values, sizes = np.zeros(len(here), dtype=np.uint64), np.zeros(len(here), dtype=np.int64)
        own = planes[:, lo : lo + BLOCK][:, here]
        word, size = np.zeros(own.shape[1], dtype=np.uint64), np.zeros(own.shape[1], dtype=np.int64)
        for channel, (words, lengths) in zip((2, 1, 3, 0), codes, strict=False):
            word |= words[own[channel]] << size.astype(np.uint64)
            size += lengths[own[channel]]
        values[here], sizes[here] = word, size
        if hit is not None:
            there = hit[lo : lo + BLOCK]
            cached = slots[lo : lo + BLOCK][there]
            values[there], sizes[there] = codes[0][0][280:][cached], codes[0][1][280:][cached]
        while number < len(copies) and copies[number][0] < lo + BLOCK:
            at, (symbol, extra, more), (far, far_extra, far_more) = copies[number]
            total = all_bits = 0
            for value, bits in ((codes[0][0][256 + symbol], codes[0][1][256 + symbol]), (extra, more), (codes[4][0][far], codes[4][1][far]), (far_extra, far_more)):
                total |= int(value) << all_bits
                all_bits += int(bits)
            values[at - lo], sizes[at - lo] = total, all_bits
            number += 1
        yield values, sizes


def _packed(parts: list) -> bytes:
    """Values of up to 64 bits each, one after the other, lowest bits first. A part is a pair of arrays or several of them in turn."""
    done, waiting = [], []
    for part in parts:
        for pair in (part,) if isinstance(part, tuple) else part:
            waiting.append(pair)
            if len(pair[0]) == BLOCK:
                data, total = _pack(waiting)
                whole = total >> 6
                done.append(data[:whole].tobytes())
                waiting = [(data[whole : whole + 1], np.array([total & 63]))]
    data, total = _pack(waiting)
    done.append(data.tobytes()[: (total + 7) // 8])
    return b"".join(done)


def _pack(pairs: list) -> tuple[np.ndarray, int]:
    values, sizes = (np.concatenate(x) for x in zip(*pairs, strict=True))
    some = sizes > 0
    values, sizes = values[some], sizes[some]
    if not len(sizes):
        return np.zeros(1, dtype="<u8"), 0
    ends = np.cumsum(sizes)
    at = ends - sizes
    index, shift = at >> 6, (at & 63).astype(np.uint64)
    total = int(ends[-1])
    out = np.zeros((total >> 6) + 2, dtype="<u8")
    changes = np.ones(len(index), dtype=bool)
    np.not_equal(index[1:], index[:-1], out=changes[1:])
    first = changes.nonzero()[0]
    out[index[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero(sizes + (at & 63) > 64)  # one at most goes over the end of a word
    out[index[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out, total


def encode(rgba: np.ndarray) -> bytes:
    """A (height, width, 4) array of samples as a lossless WebP; what takes fewer bits by estimate is chosen for this image."""
    height, width = rgba.shape[:2]
    pixels = _turned(np.ascontiguousarray(rgba).view("<u4").reshape(height, width))
    transforms, distinct = _chosen(pixels)
    parts = []
    put = lambda *pairs: _flush(parts, list(pairs))
    put((width - 1, 14), (height - 1, 14), (1, 1), (0, 3))
    for kind, parameter in transforms:
        put((1, 1), (kind, 2))
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = 9  # one parameter for 512 times 512 pixels
            shape = -(-height >> block), -(-width >> block)
            extra = np.full(shape, parameter << 8 if kind == PREDICTOR else parameter, dtype=np.uint32)
            put((block - 2, 3))
            _put_coded(parts, extra, False)
            pixels = apply_predictor(pixels, extra, block) if kind == PREDICTOR else _cross(pixels, extra, block, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, -1)
        else:
            palette, index = np.unique(pixels, return_inverse=True)
            steps = _planes(palette)
            steps[1:] -= steps[:-1].copy()
            put((len(palette) - 1, 8))
            _put_coded(parts, _words(steps)[None], False)
            bits = palette_bits(len(palette))
            each = 8 >> bits
            padded = np.pad(index.reshape(height, width), ((0, 0), (0, -width % (1 << bits))))
            pixels = (padded.reshape(height, -1, 1 << bits) << (np.arange(1 << bits) * each)).sum(axis=2).astype(np.uint32) << np.uint32(8)
            distinct = min(256, pixels.size)
    put((0, 1))
    _put_coded(parts, pixels, True, distinct)
    return _container(_packed(parts))


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most 15 bits."""
    import heapq

    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    counts = counts.astype(float)
    while True:
        heap = [(counts[s], int(s), [int(s)]) for s in used]
        heapq.heapify(heap)
        lengths[:] = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if lengths.max() <= 15:
            return lengths
        counts[used] = np.sqrt(counts[used]) + 1


def _canonical(lengths: np.ndarray) -> dict:
    words, word, size = {}, 0, 0
    for length, symbol in sorted((int(n), int(s)) for s, n in enumerate(lengths) if n):
        word <<= length - size
        size = length
        words[symbol] = (int(f"{word:0{length}b}"[::-1], 2), length)
        word += 1
    return words


def _put_code(out: Writer, counts: np.ndarray) -> dict:
    used = np.flatnonzero(counts)
    if len(used) == 0:
        used = np.array([0])
    if len(used) == 1 and used[0] < 256:
        _put_simple(out, [int(used[0])])
        return {int(used[0]): (0, 0)}
    if len(used) == 1:
        counts = counts.copy()
        counts[0] = 1
    lengths = _code_lengths(counts)
    tokens, i = [], 0
    while i < len(lengths):
        run = 1
        while i + run < len(lengths) and lengths[i + run] == lengths[i]:
            run += 1
        if lengths[i] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
        elif run >= 4:
            run = min(run, 7)
            tokens += [(int(lengths[i]), 0, 0), (16, run - 4, 2)] if lengths[i] else [(0, 0, 0)] * run
        else:
            run = 1
            tokens.append((int(lengths[i]), 0, 0))
        i += run
    own = _code_lengths(np.bincount([t[0] for t in tokens], minlength=19))
    if own.max() > 7:
        own = np.where(np.bincount([t[0] for t in tokens], minlength=19) > 0, 5, 0)
        spare = [s for s in range(19) if not own[s]]
        full = 32 - int((own > 0).sum())
        for s in spare[:full]:
            own[s] = 5
        if (own > 0).sum() < 32:  # 19 symbols: 13 of 5 bits would be missing, so shorten some
            own = np.array([4] * 13 + [5] * 6)
    out.put(0, 1)
    out.put(15, 4)
    for symbol in CODE_ORDER:
        out.put(own[symbol], 3)
    out.put(0, 1)
    words = _canonical(own)
    for symbol, value, extra in tokens:
        out.put(*(words[symbol] if (own > 0).sum() > 1 else (0, 0)))
        out.put(value, extra)
    return _canonical(lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    extra = high - 1
    return 2 * high + (value >> extra & 1), value & ((1 << extra) - 1), extra


def _put_image(out: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, group_bits: int = 0) -> None:
    height, width = pixels.shape
    flat = pixels.reshape(-1).tolist()
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    columns = -(-width >> group_bits) if group_bits else 1
    if main:
        out.put(1 if group_bits else 0, 1)
        if group_bits:
            out.put(group_bits - 2, 3)
            number = np.arange(columns * -(-height >> group_bits), dtype=np.uint32).reshape(-1, columns) % 3
            _put_image(out, number << np.uint32(8), False)
    tokens, cache, seen, at = [], {}, {}, 0
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    while at < len(flat):
        key, length = tuple(flat[at : at + 3]), 0
        if references and len(key) == 3 and key in seen:
            start = seen[key]
            while at + length < len(flat) and length < 4096 and flat[start + length] == flat[at + length]:
                length += 1
        group = (at // width >> group_bits) * columns + (at % width >> group_bits) if group_bits else 0
        if length >= 3:
            distance = at - seen[key]
            tokens.append((group % 3, "copy", length, near.get(distance, distance + len(NEAR))))
        else:
            length = 1
            slot = (CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            tokens.append((group % 3, "cached", slot, 0) if cache_bits and cache.get(slot) == flat[at] else (group % 3, "pixel", flat[at], 0))
        for k in range(at, at + length):
            seen[tuple(flat[k : k + 3])] = k
            if cache_bits:
                cache[(CACHE_FACTOR * flat[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[k]
        at += length
    groups = 1 + (max(int(g) for g in (np.arange(columns * -(-height >> group_bits)) % 3)) if group_bits else 0)
    counts = [[np.zeros(n, dtype=np.int64) for n in (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    written = []
    for group, kind, value, distance in tokens:
        if kind == "pixel":
            symbols = [(0, value >> 8 & 255, 0, 0), (1, value >> 16 & 255, 0, 0), (2, value & 255, 0, 0), (3, value >> 24, 0, 0)]
        elif kind == "cached":
            symbols = [(0, 280 + value, 0, 0)]
        else:
            (s, e, n), (ds, de, dn) = _prefix(value), _prefix(distance)
            symbols = [(0, 256 + s, e, n), (4, ds, de, dn)]
        for which, symbol, _, _ in symbols:
            counts[group][which][symbol] += 1
        written += [(group, *s) for s in symbols]
    words = [[_put_code(out, c) for c in own] for own in counts]
    for group, which, symbol, extra, n in written:
        out.put(*words[group][which][symbol])
        out.put(extra, n)


def encode_with(rgba: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = False, group_bits: int = 0, seed: int = 0) -> bytes:
    """A stream with the given transforms in order, cache, back-references and code groups; parameters of transforms are drawn at random."""
    r = np.random.default_rng(seed)
    height, width = rgba.shape[:2]
    pixels = _words(rgba[..., [3, 0, 1, 2]].astype(np.int64))
    out = _head(width, height)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = 2
            shape = -(-height >> bits), -(-pixels.shape[1] >> bits)
            extra = r.integers(0, 14, shape).astype(np.uint32) << np.uint32(8) if kind == PREDICTOR else r.integers(0, 1 << 24, shape).astype(np.uint32)
            out.put(bits - 2, 3)
            _put_image(out, extra, False)
            pixels = apply_predictor(pixels, extra, bits) if kind == PREDICTOR else _cross(pixels, extra, bits, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, -1)
        else:
            palette, index = np.unique(pixels, return_inverse=True)
            index = index.reshape(pixels.shape)
            steps = _planes(palette)
            steps[1:] -= steps[:-1].copy()
            out.put(len(palette) - 1, 8)
            _put_image(out, _words(steps)[None], False)
            bits = palette_bits(len(palette))
            each = 8 >> bits
            padded = np.pad(index, ((0, 0), (0, -pixels.shape[1] % (1 << bits))))
            packed = (padded.reshape(height, -1, 1 << bits) << (np.arange(1 << bits) * each)).sum(axis=2)
            pixels = packed.astype(np.uint32) << np.uint32(8)
    out.put(0, 1)
    _put_image(out, pixels, True, cache_bits, references, group_bits)
    return _container(out.word.to_bytes((out.size + 7) // 8, "little"))


# ---------------------------------------------------------------------------------------------------- columns


def payload_of(text: bytes) -> bytes:
    return text + b"\x00" * (-len(text) % 64 if text else 64)


def image_of(payload: bytes) -> np.ndarray:
    """RGBA samples: 16 pixels a row, or a multiple of 16 such that the height stays in the format's limit."""
    n = len(payload) // 4
    width = 16 * -(-n // (16 * MOST))
    height = -(-n // width)
    return np.frombuffer(payload + b"\x00" * (4 * (width * height - n)), dtype=np.uint8).reshape(height, width, 4)


def feature_of(samples: np.ndarray, n: int) -> str:
    """Size, channel means, mean step between rows and entropy of the first ``n`` samples read back."""
    flat = samples.reshape(-1)[:n]
    counts = np.bincount(flat, minlength=256)
    share = counts[counts > 0] / n
    means = flat.reshape(-1, 4).mean(axis=0)
    step = np.abs(np.diff(flat.reshape(-1, 64).astype(np.int16), axis=0)).mean() if n > 64 else 0.0
    return f"{samples.shape[1]}x{samples.shape[0]};mean={','.join(f'{m:.3f}' for m in means)};step={step:.3f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f}"


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the texts as a media column."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8_parts(batch.column(1))
            media = [encode(image_of(payload_of(bytes(data[a:b])))) for a, b in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

        return one

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(source, make, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame, column: str = "media") -> DataFrame:
    """Replace the media column by width, height and pixels (RGBA samples)."""
    rest = [c for c in media.columns if c != column]

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            media = batch.column(len(rest)).to_pylist()
            images, present = [None] * len(media), [i for i, m in enumerate(media) if m is not None]
            for i, samples in decode_many([media[i] for i in present]):
                images[present[i]] = samples
            size = lambda k: pa.array([None if i is None else i.shape[k] for i in images], pa.int32())
            return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], size(1), size(0), pa.array([None if i is None else i.tobytes() for i in images], pa.binary())], [*rest, "width", "height", "pixels"])

        return one

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*rest).schema)
    return arrow_map(media.select(*rest, column), make, f"{kept}{', ' if kept else ''}width int, height int, pixels binary")


def _digests():
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, sizes, media = (c.to_pylist() for c in batch.columns)
        rows = [None] * len(docs)
        for i, samples in decode_many(media):
            n = sizes[i]
            size = max(64, -(-n // 64) * 64)
            payload = samples.tobytes()[:size]
            rows[i] = (docs[i], n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), feature_of(samples, size))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return one


def op6(spark, sf_dir: str) -> DataFrame:
    media = stored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return arrow_map(media, _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
