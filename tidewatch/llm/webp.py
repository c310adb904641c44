"""Lossless WebP: a complete decoder of the public VP8L format, and an encoder that uses all its parts.

Decoding follows RFC 9649: RIFF container, transforms (predictor, cross-colour, subtract green, palette with
bundled pixels), colour cache, entropy image with several groups of prefix codes, back-references by plain
and by two-dimensional distance. Prefix codes are looked up in tables built with numpy; transforms are
inverted on whole rows where their predictors allow it.
"""

from __future__ import annotations

import struct
from array import array
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS, DISTANCES = 24, 40
#: Fixed values of the format: the order of code length codes, and the multiplier of the colour cache.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
MAX_SIDE = 1 << 14
MAX_MATCH = 4096


class WebpError(ValueError):
    """The bytes are not a lossless WebP image."""


class _NotCached(Exception):
    """A place of the colour cache was used before a colour was put there."""


@lru_cache(maxsize=1)
def near_offsets() -> tuple[tuple[int, int], ...]:
    """The 120 two-dimensional distances: the half plane above and left of a pixel by its distance from it."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return tuple(sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)))


@lru_cache(maxsize=256)
def _near_distances(width: int) -> tuple[int, ...]:
    return tuple(max(1, x + y * width) for x, y in near_offsets())


@lru_cache(maxsize=256)
def _near_codes(width: int) -> dict[int, int]:
    return {d: i + 1 for i, d in reversed(list(enumerate(_near_distances(width))))}


def _prefixed(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their value) of a length or distance code of at least 1."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    second = value >> (high - 1) & 1
    return 2 * high + second, high - 1, value & ((1 << (high - 1)) - 1)


# --- prefix codes ------------------------------------------------------------------------------------


@lru_cache(maxsize=16)
def _reversal(bits: int) -> np.ndarray:
    """Each number below 2**bits with its bits in reverse."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by code, their lengths); a code must be complete, or be one symbol."""
    used = lengths.nonzero()[0]
    used = used[lengths[used].argsort(kind="stable")]
    return used, lengths[used]


class Code:
    """A decoding table: index by the next ``bits`` bits; an entry is symbol << 4 | length. One symbol: no bits."""

    def __init__(self, lengths: np.ndarray):
        used, size = _canonical(lengths)
        if not len(used):
            raise WebpError("a prefix code without symbols")
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None:
            self.bits, self.entries = 0, np.array([self.only << 4])
            return
        self.bits = int(size[-1])
        span = np.left_shift(1, self.bits - size)
        if span.sum() != 1 << self.bits:
            raise WebpError("an incomplete prefix code")
        self.entries = (used << 4 | size).repeat(span)[_reversal(self.bits)]

    @cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    def pairs(self, cached: bool = False) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(bits, lengths, symbols, how many): a table over the next ``bits`` bits that takes two pixels (literals, or
        places of the cache) at once where both fit. Length 0 marks what is no pixel."""
        bits = min(13, max(self.bits, 11))
        bits = max(bits, self.bits)
        index = np.arange(1 << bits)
        short = (1 << self.bits) - 1
        one = self.entries[index & short]
        size = one & 15
        two = self.entries[(index >> size) & short]
        both = size + (two & 15)
        symbols = np.empty((1 << bits, 2), dtype=np.uint16 if cached else np.uint8)
        symbols[:, 0], symbols[:, 1] = one >> 4, two >> 4
        back = self.entries >> 4 >= 256
        if cached:
            back &= self.entries >> 4 < 256 + LENGTHS
        double = (both <= bits) & ~back[(index >> size) & short]
        length = np.where(double, both, size)
        length[back[index & short]] = 0
        return bits, length.astype(np.uint8), symbols, double


_AHEAD = 800


class _Bits:
    """Reads little-endian bits."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(64), 0, len(data) * 8

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise WebpError("the data end too early")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)  # n: up to 57, or unused

    def peek(self) -> int:
        """At least the next 25 bits, zeros beyond the end."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "little") >> (self.at & 7)

    def ahead(self) -> int:
        """At least the next ``_AHEAD`` bits, zeros beyond the end."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at + _AHEAD >> 3) + 1], "little") >> (self.at & 7)

    def symbol(self, code: Code) -> int:
        at = self.at
        e = code.table[int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << code.bits) - 1)]
        self.at = at + (e & 15)
        return e >> 4


@lru_cache(maxsize=512)
def _only(symbol: int) -> Code:
    return Code(np.bincount([symbol]))


def _read_code(bits: _Bits, alphabet: int) -> Code:
    head = bits.peek()
    if head & 1:
        two, used = head >> 1 & 1, 11 if head & 4 else 4
        symbols = [head >> 3 & (255 if head & 4 else 1)] + [head >> used & 255] * two
        bits.read(used + 8 * two)
        if max(symbols) >= alphabet:
            raise WebpError("a symbol outside its alphabet")
        if not two:
            return _only(symbols[0])
        lengths = np.zeros(alphabet, dtype=np.int64)
        lengths[symbols] = 1
        return Code(lengths)
    bits.read(1)
    own = np.zeros(19, dtype=np.int64)
    given = 4 + bits.read(4)
    packed = bits.read(3 * given)
    own[list(CODE_LENGTH_ORDER[:given])] = [packed >> 3 * i & 7 for i in range(given)]
    code = Code(own)
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > alphabet:
            raise WebpError("more code lengths than symbols")
    previous, found = 8, []
    table, mask = code.table, (1 << code.bits) - 1
    while len(found) < alphabet and left:
        ahead, used = bits.ahead(), 0
        while used < _AHEAD - 16 and len(found) < alphabet and left:  # so many bits are at hand
            left -= 1
            e = table[ahead & mask]
            n, s = e & 15, e >> 4
            ahead >>= n
            if s < 16:
                found.append(s)
                previous = s or previous
            elif s == 16:
                found += [previous] * (3 + (ahead & 3))
                ahead >>= 2
                n += 2
            elif s == 17:
                found += [0] * (3 + (ahead & 7))
                ahead >>= 3
                n += 3
            else:
                found += [0] * (11 + (ahead & 127))
                ahead >>= 7
                n += 7
            used += n
        bits.read(used)
    if len(found) > alphabet:
        raise WebpError("code lengths beyond the alphabet")
    return Code(np.array(found, dtype=np.int64))


# --- entropy-coded images ----------------------------------------------------------------------------


def _read_image(bits: _Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """Pixels as 0xAARRGGBB, row by row."""
    cache = 0
    if bits.read(1):
        cache = bits.read(4)
        if not 1 <= cache <= 11:
            raise WebpError("a colour cache of that size can't be")
    tile, tiles, groups = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        tiles = (_read_image(bits, -(-width >> tile), -(-height >> tile)) >> 8 & 0xFFFF).tolist()
        groups = max(tiles) + 1
    green = 256 + LENGTHS + (1 << cache if cache else 0)
    codes = [[_read_code(bits, n) for n in (green, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    if tiles is None and all(c.only is not None for c in codes[0][1:4]):
        start = bits.at
        try:
            return _read_single(bits, width, width * height, codes[0], cache)
        except _NotCached:  # rare but allowed: all channels are 0 then, so green does not tell the pixel
            bits.at = start
    return _read_pixels(bits, width, width * height, codes, tile, tiles, cache)


def _copy(out, distance: int, length: int) -> None:
    """Appends ``length`` items that start ``distance`` back, which may overlap what they append."""
    at = len(out) - distance
    if at < 0:
        raise WebpError("a back-reference before the first pixel")
    if distance >= length:
        out += out[at : at + length]
    else:
        out += (out[at:] * (length // distance + 1))[:length]


#: Bytes whose bit windows are held as a list at a time.
_CHUNK = 1 << 15


def _windows(bits: _Bits, at: int, wide: bool) -> tuple[list[int], int]:
    """(for each byte from bit ``at`` on, the 32 or 64 bits that start there; the first byte)"""
    first = at >> 3
    n = min(_CHUNK, len(bits.data) - 8 - first)
    if n <= 0:
        raise WebpError("the data end too early")
    return np.ndarray((n,), "<u8" if wide else "<u4", bits.data, first, (1,)).tolist(), first


def _read_single(bits: _Bits, width: int, total: int, codes: list[Code], cache_bits: int) -> np.ndarray:
    """Red, blue and alpha are constant: a symbol is a whole pixel, and the cache holds greens."""
    constant = codes[3].only << 24 | codes[1].only << 16 | codes[2].only
    if codes[0].only is not None and codes[0].only < 256:
        return np.full(total, constant | codes[0].only << 8, dtype=np.uint32)
    greens = (_read_greens if codes[0].only is not None or total < 512 else _read_pairs)(bits, width, total, codes, cache_bits, constant)
    return greens.astype(np.uint32) << np.uint32(8) | np.uint32(constant)


@lru_cache(maxsize=64)
def _slots(cache_bits: int, constant: int) -> np.ndarray:
    """The place in the colour cache of each green."""
    colours = np.arange(256, dtype=np.uint32) << np.uint32(8) | np.uint32(constant)
    return ((colours * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)).astype(np.uint16)


def _from_cache(symbols: np.ndarray, cache: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Greens of literals and places of the cache, which holds the last literal of each place; keeps the cache."""
    literal = symbols < 256
    place = np.where(literal, slots[symbols & 255], symbols - (256 + LENGTHS))
    if literal.all():
        cache[place] = symbols
        return symbols.astype(np.uint8)
    # what the cache held goes first; by place and time, each then stands for those behind it up to the next literal
    all_places = np.concatenate([np.arange(len(cache), dtype=np.uint16), place])
    greens = np.concatenate([cache, symbols.astype(np.int16)])
    order = all_places.argsort(kind="stable")
    known = np.concatenate([np.ones(len(cache), dtype=bool), literal])[order]
    greens[order] = greens[order[np.maximum.accumulate(np.where(known, np.arange(len(order)), 0))]]
    greens = greens[len(cache) :]
    if greens.min() < 0:
        raise _NotCached
    cache[place] = greens
    return greens.astype(np.uint8)


def _read_greens(bits: _Bits, width: int, total: int, codes: list[Code], cache_bits: int, constant: int) -> np.ndarray:
    table, mask, distances = codes[0].table, (1 << codes[0].bits) - 1, codes[4]
    near, out = _near_distances(width), bytearray()
    append = out.append
    cache, slots = [0 if constant == 0 else -1] * (1 << cache_bits), _slots(cache_bits, constant).tolist() if cache_bits else None
    while len(out) < total:
        window, first = _windows(bits, bits.at, False)
        base = first * 8
        p, last = bits.at - base, len(window) * 8 - 64
        while (steps := min(total - len(out), (last - p) // 15)) > 0:  # so many symbols stay inside the window
            for _ in range(steps):
                e = table[window[p >> 3] >> (p & 7) & mask]
                p += e & 15
                e >>= 4
                if e >= 280:
                    if cache[e - 280] < 0:
                        raise _NotCached
                    append(cache[e - 280])
                elif e < 256:
                    append(e)
                    if slots:
                        cache[slots[e]] = e
                else:
                    bits.at = base + p
                    length = _value(bits, e - 256)
                    code = _value(bits, bits.symbol(distances))
                    start = len(out)
                    _copy(out, code - 120 if code > 120 else near[code - 1], length)
                    if slots:
                        for e in out[start:]:
                            cache[slots[e]] = e
                    p = bits.at - base
                    break
        bits.at = base + p
        if bits.at > bits.end:
            raise WebpError("the data end too early")
    return np.frombuffer(bytes(out[:total]), np.uint8)


def _read_pairs(bits: _Bits, width: int, total: int, codes: list[Code], cache_bits: int, constant: int) -> np.ndarray:
    """Pixels go up to four at a time.

    Numpy looks up at every bit how far the next one or two literals reach, and adds these hops up twice; the loop only
    hops from bit to bit, and numpy lays out what stands where it has been, and on the way. Where that is more than
    the image holds, the last literal tells where the data go on.
    """
    wide, lengths, symbols, double = codes[0].pairs(cache_bits > 0)
    if cache_bits:
        slots, cache = _slots(cache_bits, constant), np.full(1 << cache_bits, 0 if constant == 0 else -1, dtype=np.int16)
    table, short, mask, distances = codes[0].entries, (1 << codes[0].bits) - 1, np.uint32((1 << wide) - 1), codes[4]
    near, out, each = _near_distances(width), bytearray(), np.arange(8, dtype=np.uint32)
    while len(out) < total:
        first = bits.at >> 3
        n = min(_CHUNK, len(bits.data) - 8 - first)
        if n <= 8 + wide // 2 or bits.at > bits.end:
            raise WebpError("the data end too early")
        raw = np.ndarray((n, 1), "<u4", bits.data, first, (1, 4))
        index = (raw >> each & mask).astype(np.uint16).ravel()  # the table's place at every bit
        one = lengths[index]
        last = n * 8 - 64
        bit = np.arange(last, dtype=np.int32)
        hop = (one[:last] + one[bit + one[:last]]).tobytes()
        base = first * 8
        p, last = bits.at - base, len(hop) - 1
        while len(out) < total and (steps := min((total - len(out)) // 3 + 4, (last - p) // (2 * wide))) > 0:
            found = array("I")
            append, back = found.append, False
            for _ in range(steps):
                k = hop[p]
                if k:
                    append(p)
                    p += k
                else:
                    back = True
                    break
            stops = np.empty((len(found), 2), dtype=np.int64)  # of each hop, the two that it is made of
            stops[:, 0] = np.frombuffer(found, np.uint32)
            stops[:, 1] = stops[:, 0] + one[stops[:, 0]]
            stops = stops[one[stops] > 0]
            at = index[stops]
            both = np.ones((len(at), 2), dtype=bool)
            both[:, 1] = double[at]
            left = total - len(out)
            if 2 * len(at) >= left:  # the image may end here
                upto = np.cumsum(both.sum(1))
                if len(at) and upto[-1] >= left:
                    k = int(np.searchsorted(upto, left))
                    whole = upto[k] == left
                    p = int(stops[k]) + (int(one[stops[k]]) if whole else int(table[int(at[k]) & short]) & 15)
                    greens = symbols[at[: k + 1]][both[: k + 1]][:left]
                    out += (_from_cache(greens, cache, slots) if cache_bits else greens).tobytes()
                    break
            greens = symbols[at][both]
            out += (_from_cache(greens, cache, slots) if cache_bits and len(greens) else greens).tobytes()
            if back:
                e = int(table[int(index[p]) & short])
                bits.at = base + p + (e & 15)
                length = _value(bits, (e >> 4) - 256)
                code = _value(bits, bits.symbol(distances))
                start = len(out)
                _copy(out, code - 120 if code > 120 else near[code - 1], length)
                if cache_bits:
                    greens = np.frombuffer(bytes(out[start:]), np.uint8)
                    cache[slots[greens]] = greens
                p = bits.at - base
        bits.at = base + p
    if bits.at > bits.end:
        raise WebpError("the data end too early")
    return np.frombuffer(bytes(out[:total]), np.uint8)


def _value(bits: _Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_pixels(bits: _Bits, width: int, total: int, codes: list[list[Code]], tile: int, tiles: list[int] | None, cache_bits: int) -> np.ndarray:
    near, out = _near_distances(width), []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    across, group = -(-width >> tile), codes[0]
    first_in_cache = 256 + LENGTHS
    while len(out) < total:
        window, first = _windows(bits, bits.at, True)
        base = first * 8
        p, last = bits.at - base, len(window) - 16
        while len(out) < total and p >> 3 < last:
            if tiles is not None:
                y, x = divmod(len(out), width)
                group = codes[tiles[(y >> tile) * across + (x >> tile)]]
            g, r, b, a, d = group
            w = window[p >> 3] >> (p & 7)
            e = g.table[w & ((1 << g.bits) - 1)]
            n = e & 15
            e >>= 4
            if e < 256:
                w >>= n
                red = r.table[w & ((1 << r.bits) - 1)]
                w >>= red & 15
                blue = b.table[w & ((1 << b.bits) - 1)]
                w >>= blue & 15
                alpha = a.table[w & ((1 << a.bits) - 1)]
                p += n + (red & 15) + (blue & 15) + (alpha & 15)
                pixel = alpha >> 4 << 24 | red >> 4 << 16 | e << 8 | blue >> 4
                out.append(pixel)
                if cache_bits:
                    cache[(pixel * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = pixel
            elif e < first_in_cache:
                bits.at = base + p + n
                length = _value(bits, e - 256)
                code = _value(bits, bits.symbol(d))
                start = len(out)
                _copy(out, code - 120 if code > 120 else near[code - 1], length)
                if cache_bits:
                    for pixel in out[start:total]:
                        cache[(pixel * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = pixel
                p = bits.at - base
            else:
                p += n
                out.append(cache[e - first_in_cache])  # it stays where it is in the cache
        bits.at = base + p
        if bits.at > bits.end:
            raise WebpError("the data end too early")
    return np.array(out[:total], dtype=np.uint32)


# --- transforms --------------------------------------------------------------------------------------


def _average(a, b):
    return (a & b) + ((a ^ b) >> 1)  # of bytes, without a carry


#: Predictors that need no pixel of their own row, as functions of the pixels above: T, TR, TL.
_ABOVE = {
    0: lambda t, tr, tl: np.array([0, 0, 0, 255], np.uint8),
    2: lambda t, tr, tl: t,
    3: lambda t, tr, tl: tr,
    4: lambda t, tr, tl: tl,
    8: lambda t, tr, tl: _average(tl, t),
    9: lambda t, tr, tl: _average(t, tr),
}
_ABOVE |= {14: _ABOVE[0], 15: _ABOVE[0]}  # not assigned: black


def _predicted(mode: int, left, t, tr, tl) -> tuple[int, ...]:
    """A predictor that needs the pixel to the left, on tuples of channels."""
    if mode == 1:
        return left
    half = lambda p, q: tuple((x + y) >> 1 for x, y in zip(p, q))
    if mode == 5:
        return half(half(left, tr), t)
    if mode == 6:
        return half(left, tl)
    if mode == 7:
        return half(left, t)
    if mode == 10:
        return half(half(left, tl), half(t, tr))
    if mode == 11:
        to_left = sum(abs(y - z) for y, z in zip(t, tl))
        to_top = sum(abs(x - z) for x, z in zip(left, tl))
        return left if to_left < to_top else t
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 12:
        return tuple(clamp(x + y - z) for x, y, z in zip(left, t, tl))
    return tuple(clamp(m + int((m - z) / 2)) for m, z in zip(half(left, t), tl))  # division towards zero


def _channels(pixels: np.ndarray, width: int) -> np.ndarray:
    """0xAARRGGBB as bytes (rows, width, [B, G, R, A])."""
    return pixels.astype("<u4").view(np.uint8).reshape(-1, width, 4)


def _unpredict(residual: np.ndarray, tile: int, modes: np.ndarray) -> np.ndarray:
    """Inverts the predictor transform in place, row by row. modes: by row and column of tiles."""
    out = residual
    height, width, _ = out.shape
    out[0, :1, 3] += 255
    np.cumsum(out[0], axis=0, dtype=np.uint8, out=out[0])
    starts, shared = np.arange(0, width, 1 << tile), -1
    for y in range(1, height):
        row, top = out[y], out[y - 1]
        row[0] += top[0]
        if width == 1:
            continue
        if y >> tile != shared:
            shared = y >> tile
            mode = modes[shared]
            used = sorted(set(mode.tolist()))
            by_pixel = mode.repeat(1 << tile)[1:width, None]
            places = [(m, by_pixel == m) for m in used]
            apart = all(m in _ABOVE for m in used)
        if apart:
            tr = np.concatenate([top[2:], row[:1]])
            add = _ABOVE[used[0]](top[1:], tr, top[:-1])
            for m, own in places[1:]:
                add = np.where(own, _ABOVE[m](top[1:], tr, top[:-1]), add)
            row[1:] += add
            continue
        for m, x0 in zip(mode.tolist(), starts.tolist()):
            x0, x1 = max(1, x0), min(width, x0 + (1 << tile))
            if x0 >= x1:
                continue
            if m in _ABOVE:
                tr = np.concatenate([top[x0 + 1 : x1 + 1], row[:1]])[: x1 - x0]
                row[x0:x1] += _ABOVE[m](top[x0:x1], tr, top[x0 - 1 : x1 - 1])
            elif m == 1:
                row[x0:x1] = np.cumsum(row[x0 - 1 : x1], axis=0, dtype=np.uint8)[1:]
            else:
                left = tuple(row[x0 - 1].tolist())
                above = [tuple(p) for p in top[x0 - 1 : min(width, x1 + 1)].tolist()] + [tuple(row[0].tolist())]
                for x in range(x0, x1):
                    guess = _predicted(m, left, above[x - x0 + 1], above[x - x0 + 2], above[x - x0])
                    left = tuple((p + q) & 255 for p, q in zip(row[x].tolist(), guess))
                    row[x] = left
    return out


def _spread(values: np.ndarray, tile: int, height: int, width: int) -> np.ndarray:
    """Per-tile values for every pixel."""
    return np.repeat(np.repeat(values, 1 << tile, axis=0)[:height], 1 << tile, axis=1)[:, :width]


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return ((factor.view(np.int8).astype(np.int16) * colour.view(np.int8)) >> 5).astype(np.uint8)


def _cross(image: np.ndarray, tile: int, elements: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) the cross-colour parts, in place. elements: tiles as [B, G, R, A]."""
    height, width, _ = image.shape
    if elements.shape[:2] != (1, 1):
        elements = _spread(elements, tile, height, width)
    to_red, to_blue, red_to_blue = (elements[..., k] for k in (0, 1, 2))
    blue, green, red = (image[..., k] for k in (0, 1, 2))  # parts of the image
    if sign > 0:
        red += _delta(to_red, green)
        blue += _delta(to_blue, green) + _delta(red_to_blue, red)
    else:
        blue -= _delta(to_blue, green) + _delta(red_to_blue, red)
        red -= _delta(to_red, green)
    return image


def decode(data: bytes, grey: bool = False) -> np.ndarray:
    """The pixels of a lossless WebP file: (height, width, [R, G, B, A]) bytes; with ``grey`` green alone, (height, width)."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("no WebP file")
    at, chunk = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            chunk = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if chunk is None or len(chunk) < 5:
        raise WebpError("no lossless image in the file")
    bits = _Bits(chunk)
    if bits.read(8) != SIGNATURE:
        raise WebpError("no lossless image in the file")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # a hint about alpha only
    if bits.read(3):
        raise WebpError("an unknown version")
    full, undo, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            across = -(-width >> tile)
            undo.append((kind, tile, _channels(_read_image(bits, across, -(-height >> tile)), across).copy(), width))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            table = np.cumsum(_channels(_read_image(bits, size, 1), size)[0], axis=0, dtype=np.uint8)
            bundle = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, bundle, table, width))
            width = -(-width >> bundle)
        else:
            undo.append((kind, 0, None, width))
    image = _channels(_read_image(bits, width, height, True), width).copy()
    for kind, k, extra, own in reversed(undo):
        if kind == PREDICTOR:
            image = _unpredict(image, k, extra[..., 1] & 15)
        elif kind == CROSS_COLOUR:
            image = _cross(image, k, extra, 1)
        elif kind == SUBTRACT_GREEN:
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
        else:
            index = image[..., 1]
            if k:
                each = 8 >> k
                index = (index[..., None] >> (np.arange(1 << k, dtype=np.uint8) * each)) & ((1 << each) - 1)
                index = index.reshape(height, -1)[:, :own]
            colours = np.concatenate([extra, np.zeros((256 - len(extra), 4), np.uint8)])
            image = colours[:, 1][index][..., None] if grey and len(undo) == 1 else colours[index]
    if image.shape[1] != full:
        raise WebpError("transforms that do not fit together")
    return np.ascontiguousarray(image[..., min(1, image.shape[2] - 1)]) if grey else image[..., [2, 1, 0, 3]]


# --- encoder -----------------------------------------------------------------------------------------


class _Out:
    """Bits to write: values of up to 60 bits with their lengths, packed at the end in numpy."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
        self.parts.append((values, sizes))
        self.values, self.sizes = [], []

    def packed(self) -> bytes:
        self.put_all(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        values, sizes = (np.concatenate(x) for x in zip(*self.parts))
        some = sizes > 0
        values, sizes = values[some], sizes[some]
        end = np.cumsum(sizes)
        at = end - sizes
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros((int(end[-1]) >> 6) + 2, dtype=np.uint64)
        new = np.empty(len(word), dtype=bool)
        new[0] = True
        np.not_equal(word[1:], word[:-1], out=new[1:])
        first = new.nonzero()[0]
        out[word[first]] = np.add.reduceat(values << shift, first)
        over = ((at & 63) + sizes > 64).nonzero()[0]
        out[word[over] + 1] += values[over] >> (np.uint64(64) - shift[over])
        return out.tobytes()[: (int(end[-1]) + 7) >> 3]


#: More than any frequency.
_HEAVY = 1 << 62


def _lengths(frequency: np.ndarray, limit: int) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits; rare symbols count more until the code is flat enough."""
    used = frequency.nonzero()[0]
    out = np.zeros(len(frequency), dtype=np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    n, weight = len(used), frequency[used]
    while True:
        # sorted leaves and the nodes made of them, which come in order too: the lightest two are at their heads
        order = weight.argsort(kind="stable")
        leaves, made, parent = [*weight[order].tolist(), _HEAVY, _HEAVY], [_HEAVY] * (n + 1), [0] * (2 * n - 1)
        i = j = 0
        for node in range(n - 1):
            total = 0
            for _ in (0, 1):
                if leaves[i] <= made[j]:
                    total += leaves[i]
                    parent[i] = node
                    i += 1
                else:
                    total += made[j]
                    parent[n + j] = node
                    j += 1
            made[node] = total
        depth = [0] * (n - 1)
        for node in range(n - 3, -1, -1):
            depth[node] = depth[parent[n + node]] + 1
        size = np.array(depth)[parent[:n]] + 1
        if size.max() <= limit:
            out[used[order]] = size
            return out
        weight = (weight + 1) // 2 + weight.sum() // (1 << (limit + 1))


def _words(lengths: np.ndarray) -> np.ndarray:
    """The code words, ready to be written from their lowest bit."""
    used, size = _canonical(lengths)
    out = np.zeros(len(lengths), dtype=np.uint64)
    if len(used) > 1:
        top = int(size[-1])
        span = np.left_shift(1, top - size)
        out[used] = _reversal(top)[np.cumsum(span) - span].astype(np.uint64)
    return out


def _write_only(out: _Out, symbol: int) -> None:
    """The prefix code of one symbol: it takes no bits later."""
    out.put(1, 2)
    out.put(0 if symbol < 2 else 1, 1)
    out.put(symbol, 1 if symbol < 2 else 8)


def _write_code(out: _Out, frequency: np.ndarray, limit: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Writes the prefix code of these frequencies; returns (code words, lengths), both 0 where it has one symbol."""
    used = frequency.nonzero()[0].tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        short = used[0] < 2
        out.put(0 if short else 1, 1)
        out.put(used[0], 1 if short else 8)
        lengths = np.zeros(len(frequency), dtype=np.int64)
        if len(used) == 2:
            out.put(used[1], 8)
            lengths[used] = 1
        return _words(lengths), lengths
    lengths = _lengths(frequency, limit)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    edge = [0, *((lengths[1:] != lengths[:-1]).nonzero()[0] + 1).tolist(), len(lengths)]
    for value, n in zip(lengths[edge[:-1]].tolist(), [b - a for a, b in zip(edge, edge[1:])]):
        if value:
            tokens.append((value, 0, 0))
            n -= 1
        while n >= 3:
            step = min(n, 138 if not value else 6)
            if value:
                tokens.append((16, step - 3, 2))
            else:
                tokens.append((18, step - 11, 7) if step >= 11 else (17, step - 3, 3))
            n -= step
        tokens += [(value, 0, 0)] * n
    own = _lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    last = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if own[s])
    out.put(0, 1)
    out.put(max(0, last + 1 - 4), 4)
    for s in CODE_LENGTH_ORDER[: max(4, last + 1)]:
        out.put(int(own[s]), 3)
    out.put(0, 1)
    words, sizes = _words(own).tolist(), (own * (np.count_nonzero(own) > 1)).tolist()
    out.values += [words[s] | extra << sizes[s] for s, extra, _ in tokens]
    out.sizes += [sizes[s] + n for s, _, n in tokens]
    return _words(lengths), lengths * (np.count_nonzero(lengths) > 1)


def _matches(items: np.ndarray, shortest: int = 16) -> list[tuple[int, int, int]]:
    """Greedy (start, length, distance) of repeated runs. Runs of 16 bytes that occurred before are found by a
    16-bit hash, and compared item by item."""
    n, size = len(items), items.dtype.itemsize
    count = n - 16 // size
    if count <= 1:
        return []
    raw = items.tobytes()
    window = np.ndarray((n - 8 // size + 1,), "<u8", raw, 0, (size,))
    half = 8 // size
    key = window[: count + 1] * np.uint64(0x9E3779B97F4A7C15) ^ window[half : half + count + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    short = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.uint16)
    order = short.argsort(kind="stable")
    same = (key[order[1:]] == key[order[:-1]]).nonzero()[0]
    if not len(same):
        return []
    found = np.sort(order[same + 1])
    before = np.zeros(count + 1, dtype=np.int64)
    before[order[same + 1]] = order[same]
    out, free = [], 0
    for i in found.tolist():
        if i < free:
            continue
        j = int(before[i])
        if i - j > (1 << 20) - 200:
            continue
        end = min(MAX_MATCH, n - i)
        apart = items[i : i + end] != items[j : j + end]
        length = int(apart.argmax()) if apart.any() else end
        if length * size >= shortest:
            out.append((i, length, i - j))
            free = i + length
    return out


def _write_image(out: _Out, pixels: np.ndarray, width: int, main: bool = False, cache_bits: int = 0, match: bool = False, group_tile: int = 0) -> None:
    """Pixels (0xAARRGGBB) as an entropy-coded image; group_tile: the code groups alternate over tiles of that size."""
    out.put(1, 1) if cache_bits else out.put(0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    n, group = len(pixels), np.zeros(1, dtype=np.int64)
    if main:
        out.put(1 if group_tile else 0, 1)
        if group_tile:
            out.put(group_tile - 2, 3)
            height = n // width
            across, down = -(-width >> group_tile), -(-height >> group_tile)
            tiles = (np.add.outer(np.arange(down), np.arange(across)) % 2).astype(np.uint32)
            _write_image(out, tiles.ravel() << np.uint32(8), across)
            group = _spread(tiles, group_tile, height, width).ravel().astype(np.int64)
    channels = np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, 4)  # B, G, R, A
    plain = all((channels[:, k] == channels[0, k]).all() for k in (0, 2, 3))
    symbol = channels[:, 1].astype(np.int64)
    literal = np.ones(n, dtype=bool)
    if cache_bits:
        slot = ((pixels * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
        order = slot.argsort(kind="stable")
        hit = order[1:][(slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])]
        symbol[hit] = 256 + LENGTHS + slot[hit].astype(np.int64)
        literal[hit] = False
    found = _matches(np.ascontiguousarray(channels[:, 1]) if plain else pixels) if match else []
    keep, tokens, near = np.ones(n, dtype=bool), [], _near_codes(width)
    for start, length, distance in found:
        keep[start : start + length] = False
        tokens.append((start, *_prefixed(length), *_prefixed(near.get(distance, distance + 120))))
    literal &= keep
    own = keep.nonzero()[0] if found or group_tile else slice(None)
    green = 256 + LENGTHS + (1 << cache_bits if cache_bits else 0)
    values, sizes = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    many = bool(group_tile)
    for g in range(int(group.max(initial=0)) + 1 if many else 1):
        mine = own[group[own] == g] if many else own
        backs = [t for t in tokens if group[t[0]] == g] if many else tokens
        frequency = np.bincount(symbol[mine], minlength=green)
        if backs:
            frequency = frequency + np.bincount([256 + t[1] for t in backs], minlength=green)
        words, lengths = _write_code(out, frequency)
        values[mine], sizes[mine] = words[symbol[mine]], lengths[symbol[mine]]
        for k in (2, 0, 3):  # red, blue, alpha
            if plain:
                _write_only(out, int(channels[0, k]))
                continue
            texts = (literal & (group == g) if many else literal).nonzero()[0] if k == 2 else texts
            colour = channels[texts, k]
            w, b = _write_code(out, np.bincount(colour, minlength=256))
            values[texts] |= w[colour] << sizes[texts].astype(np.uint64)
            sizes[texts] += b[colour]
        if not backs:
            _write_only(out, 0)
            continue
        w, b = _write_code(out, np.bincount([t[4] for t in backs], minlength=DISTANCES))
        for start, l_symbol, l_bits, l_extra, d_symbol, d_bits, d_extra in backs:
            value, at = int(words[256 + l_symbol]), int(lengths[256 + l_symbol])
            value, at = value | l_extra << at, at + l_bits
            value, at = value | int(w[d_symbol]) << at, at + int(b[d_symbol])
            values[start], sizes[start] = value | d_extra << at, at + d_bits
    if not found:
        out.put_all(values, sizes)
        return
    keep[[t[0] for t in tokens]] = True
    out.put_all(values[keep], sizes[keep])


def _predict(image: np.ndarray, tile: int, modes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(residual, modes by tile). Without given modes, each tile takes the one of 0, 2, 4, 9 with the least
    residual in green."""
    height, width, _ = image.shape
    down, across = -(-height >> tile), -(-width >> tile)
    residual = image.copy()
    residual[0, 1:] -= image[0, :-1]
    residual[0, :1, 3:] -= 255
    residual[1:, 0] -= image[:-1, 0]
    if height < 2 or width < 2:
        return residual, np.ones((down, across), dtype=np.uint8) if modes is None else modes
    top, inner, left = image[:-1, 1:], image[1:, 1:], image[1:, :-1]
    tl = image[:-1, :-1]
    tr = np.concatenate([image[:-1, 2:], image[1:, :1]], axis=1)
    if modes is None:
        k, tries = min(1, image.shape[2] - 1), []
        ys, xs = (np.maximum(np.arange(0, n, 1 << tile) - 1, 0) for n in (height, width))  # where tiles begin inside
        for mode in (0, 2, 4, 9):
            rest = inner[..., k] - _ABOVE[mode](top[..., k], tr[..., k], tl[..., k]) if mode else inner[..., k]
            cost = np.abs(rest.view(np.int8).astype(np.int16))
            tries.append(np.add.reduceat(np.add.reduceat(cost, ys, axis=0, dtype=np.int64), xs, axis=1))
        modes = np.array([0, 2, 4, 9], dtype=np.uint8)[np.argmin(tries, axis=0)]
    by_pixel = _spread(modes, tile, height, width)[1:, 1:]
    for mode in np.unique(modes).tolist():
        own = by_pixel == mode
        if mode in _ABOVE:
            guess = np.broadcast_to(_ABOVE[mode](top, tr, tl)[..., : image.shape[2]], inner.shape)[own]
        else:
            parts = (x[own].tolist() for x in (left, top, tr, tl))
            guess = np.array([_predicted(mode, *p) for p in zip(*parts)], dtype=np.uint8).reshape(-1, image.shape[2])
        residual[1:, 1:][own] -= guess
    return residual, modes


@dataclass(frozen=True)
class Profile:
    """How to encode. Transforms are written in the order palette, predictor, cross-colour, subtract green."""

    palette: bool = False
    predictor_tile: int = 0
    modes: tuple[int, ...] = ()  # () lets each tile choose; else these, in turn
    cross: tuple[int, int, int, int] = (0, 0, 0, 0)  # tile, green to red, green to blue, red to blue
    subtract_green: bool = False
    cache_bits: int = 0
    match: bool = True
    group_tile: int = 0


def encode(pixels: np.ndarray, profile: Profile = Profile()) -> bytes:
    """A lossless WebP file of (height, width, [R, G, B, A]) bytes, or of (height, width) grey ones."""
    height, width = pixels.shape[:2]
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise WebpError("an image of that size can't be")
    out = _Out()
    out.put(SIGNATURE, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    image, grey = np.empty((height, width, 4), dtype=np.uint8), pixels.ndim == 2
    if grey:
        image[..., :3], image[..., 3] = pixels[..., None], 255
    else:
        for k in range(4):
            image[..., k] = pixels[..., (2, 1, 0, 3)[k]]
        grey = bool((image[..., 3] == 255).all() and (image[..., 0] == image[..., 1]).all() and (image[..., 2] == image[..., 1]).all())
    out.put(int(not grey and (image[..., 3] != 255).any()), 1)
    out.put(0, 3)
    flat = lambda x: np.ascontiguousarray(x).reshape(-1, 4).view("<u4").ravel()
    if profile.palette:
        if grey:
            used = np.bincount(image[..., 1].ravel(), minlength=256) > 0
            if np.count_nonzero(used) > 16:  # no pixels to bundle: a whole range, each colour one above the last, is shorter
                used[used.argmax() : 256 - used[::-1].argmax()] = True
            table, index = used.nonzero()[0].astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000), (np.cumsum(used) - 1).astype(np.uint8)[image[..., 1]]
        else:
            table, index = np.unique(flat(image), return_inverse=True)
        if len(table) > 256:
            raise WebpError("more than 256 colours")
        out.put(1 | PALETTE << 1, 3)
        out.put(len(table) - 1, 8)
        colours = np.ascontiguousarray(table).view(np.uint8).reshape(-1, 4)
        _write_image(out, flat(np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), match=True)
        bundle = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        index = index.reshape(height, width).astype(np.uint8)
        if bundle:
            each, wide = 8 >> bundle, -(-width >> bundle)
            index = np.pad(index, ((0, 0), (0, (wide << bundle) - width))).reshape(height, wide, 1 << bundle)
            index = np.bitwise_or.reduce(index << (np.arange(1 << bundle, dtype=np.uint8) * each), axis=2)
            width = wide
        image = np.zeros((height, width, 4), dtype=np.uint8)
        image[..., 1], image[..., 3] = index, 255
    if profile.predictor_tile:
        tile = profile.predictor_tile
        down, across = -(-height >> tile), -(-width >> tile)
        given = np.resize(np.array(profile.modes, dtype=np.uint8), (down, across)) if profile.modes else None
        if grey and not profile.palette:  # the channels are alike: one stands for all
            rest, modes = _predict(np.ascontiguousarray(image[..., 1:2]), tile, given)
            image = np.zeros(image.shape, dtype=np.uint8)
            image[..., :3] = rest
        else:
            image, modes = _predict(image, tile, given)
        out.put(1 | PREDICTOR << 1, 3)
        out.put(tile - 2, 3)
        _write_image(out, modes.ravel().astype(np.uint32) << np.uint32(8), across)
    if profile.cross[0]:
        tile, *factors = profile.cross
        down, across = -(-height >> tile), -(-width >> tile)
        elements = np.empty((down, across, 4), dtype=np.uint8)
        elements[:] = [factors[0], factors[1], factors[2], 255]
        out.put(1 | CROSS_COLOUR << 1, 3)
        out.put(tile - 2, 3)
        _write_image(out, flat(elements), across)
        image = _cross(image, tile, elements, -1)
    if profile.subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        image[..., 0] -= image[..., 1]
        image[..., 2] -= image[..., 1]
    out.put(0, 1)
    _write_image(out, flat(image), width, True, profile.cache_bits, profile.match, profile.group_tile)
    chunk = out.packed()
    body = b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + bytes(len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body
