"""Lossless WebP: a decoder for the whole format. Helpers without Spark.

The decoder reads prefix codes, back-references, the colour cache and entropy images, then inverts the predictor,
cross-colour, subtract-green and palette transforms. Codes are tables, looked up as arrays at every bit of a stretch of
the stream; what is left to do one by one is to step from pixel to pixel and to copy. Images with several groups of
codes are read symbol by symbol.
"""

from __future__ import annotations

import struct
from functools import cache as memo

import numpy as np

SIDE = 1 << 14  # the largest width and height of the format
# Fixed values of the format: the order of code length codes, and the near pixels that short distances stand for.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
REPEATS = {16: (3, 2), 17: (3, 3), 18: (11, 7)}  # least repeats and extra bits
CACHE_FACTOR = 0x1E35A7BD
STRETCH = 1 << 18  # bits of a stream that are looked up at a time
LITERAL = 4 * 15  # bits of the longest literal


class WebPError(ValueError):
    pass


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, len(data) * 8

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise WebPError("the stream ends early")
        byte = self.at >> 3
        out = int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out


@memo
def turned(wide: int) -> np.ndarray:
    """All numbers of `wide` bits with their bits in the other order."""
    k = np.arange(1 << wide)
    return sum(((k >> i & 1) << (wide - 1 - i) for i in range(wide)), np.zeros(1 << wide, np.int64))


class Code:
    """A canonical prefix code: for each value of the next `wide` bits the symbol, and the length of its code."""

    def __init__(self, lengths: dict[int, int]) -> None:
        if not lengths:
            raise WebPError("a prefix code without symbols")
        if len(lengths) == 1:
            self.wide, self.symbols, self.lengths = 0, np.array([*lengths], np.int32), np.zeros(1, np.int32)
            return
        symbols, n = np.fromiter(lengths.keys(), np.int32, len(lengths)), np.fromiter(lengths.values(), np.int32, len(lengths))
        if int((1 << (15 - n)).sum()) != 1 << 15:
            raise WebPError("a prefix code that isn't complete")
        order = np.lexsort((symbols, n))
        symbols, n = symbols[order], n[order]
        self.wide = int(n[-1])
        times, places = 1 << (self.wide - n), turned(self.wide)
        self.symbols, self.lengths = np.repeat(symbols, times)[places], np.repeat(n, times)[places]

    def read(self, bits: Bits) -> int:
        byte = bits.at >> 3
        value = int.from_bytes(bits.data[byte : byte + 3], "little") >> (bits.at & 7) & ((1 << self.wide) - 1)
        bits.at += int(self.lengths[value])
        if bits.at > bits.end:
            raise WebPError("the stream ends early")
        return int(self.symbols[value])


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):  # simple
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise WebPError("a symbol outside its alphabet")
        return Code(dict.fromkeys(symbols, 1))
    lengths = {LENGTH_ORDER[i]: n for i in range(4 + bits.read(4)) if (n := bits.read(3))}
    of_lengths = Code(lengths)
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    symbols, sizes, mask = of_lengths.symbols.tolist(), of_lengths.lengths.tolist(), (1 << of_lengths.wide) - 1
    out: dict[int, int] = {}
    data, place, at, previous = bits.data, bits.at, 0, 8
    while at < alphabet and left:
        left -= 1
        byte = place >> 3
        word = int.from_bytes(data[byte : byte + 4], "little") >> (place & 7)
        n, size = symbols[word & mask], sizes[word & mask]
        place += size
        if n < 16:
            if n:
                out[at] = previous = n
            at += 1
            continue
        least, extra = REPEATS[n]
        count = least + (word >> size & ((1 << extra) - 1))
        place += extra
        if at + count > alphabet:
            raise WebPError("code lengths beyond the alphabet")
        if n == 16:
            out.update(dict.fromkeys(range(at, at + count), previous))
        at += count
    if place > bits.end:
        raise WebPError("the stream ends early")
    bits.at = place
    return Code(out)


def _prefixed(word: int, symbol: int) -> tuple[int, int]:
    """A length or distance code whose extra bits are the lowest of word, and how many these are."""
    if symbol < 4:
        return symbol + 1, 0
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + (word & ((1 << extra) - 1)) + 1, extra


def _read_prefixed(bits: Bits, symbol: int) -> int:
    value, extra = _prefixed(0, symbol)
    return value + bits.read(extra)


class Stretch:
    """Literals and places of the cache that start at any bit of a stretch of a stream: where each ends, and its colour."""

    def __init__(self, bits: Bits, codes: list[Code]) -> None:
        first = bits.at >> 3
        self.base, self.size = first << 3, min(STRETCH, bits.end - (first << 3))
        raw = np.frombuffer(bits.data[first : first + (self.size + LITERAL >> 3) + 4] + b"\0" * 16, np.uint8).astype(np.int32)
        window = ((raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16)[:, None] >> np.arange(8, dtype=np.int32)).ravel()[: self.size + LITERAL + 8]
        at = np.arange(self.size, dtype=np.int32)
        self.places = []
        for i, code in enumerate(codes):
            value = window & ((1 << code.wide) - 1)
            if i == 0:
                self.green = code.symbols[value[: self.size]]
            self.places.append((at, code.symbols, value))
            if code.wide:
                at = at + code.lengths[value[at]]
        self.next = np.full(self.size + LITERAL + 8, -1, np.int32)  # -1: a back-reference, or beyond the stretch
        own = self.places[1][0]  # where the green code ends
        self.next[: self.size] = np.where(self.green < 256, at, np.where(self.green < 280, -1, own))

    def colours(self, starts: list[int]) -> np.ndarray:
        """Alpha, red, green, blue of the literals at these places, as one number each."""
        places, out = np.array(starts, np.int64), np.zeros(len(starts), np.uint32)
        for (at, symbols, value), shift in zip(self.places, (8, 16, 0, 24), strict=True):
            found = symbols[value[at[places]]] if len(symbols) > 1 else symbols
            out |= found.astype(np.uint32) << np.uint32(shift)
        return out


def _grouped(bits: Bits, codes: list[Code], n: int, width: int, cache_bits: int) -> list[int]:
    """n pixels, as alpha, red, green, blue, of an image with one group of codes.

    First the places of all symbols are found, then the colours of literals are looked up at once, then copies are made
    in order.
    """
    parts, hits, events, at, literals = [], [], [], 0, 0  # an event: pixels before it other than copies, length, distance
    far, far_sizes, far_mask = codes[4].symbols.tolist(), codes[4].lengths.tolist(), (1 << codes[4].wide) - 1
    while at < n:
        stretch = Stretch(bits, codes[:4])
        here, starts, steps = bits.at - stretch.base, [], memoryview(stretch.next)
        left, size, add = n - at, stretch.size, starts.append
        if here >= size:
            raise WebPError("the stream ends early")
        while True:
            known = len(starts)
            for _ in range(left):
                if (after := steps[here]) < 0:
                    break
                add(here)
                here = after
            left -= len(starts) - known
            if not left or here >= size:
                break
            symbol = int(stretch.green[here]) - 256
            here = int(stretch.places[1][0][here])
            byte = stretch.base + here >> 3
            word = int.from_bytes(bits.data[byte : byte + 8], "little") >> (here & 7)  # at least 57 bits, more than all take
            length, used = _prefixed(word, symbol)
            value = word >> used & far_mask
            used += far_sizes[value]
            code, more = _prefixed(word >> used, far[value])
            here += used + more
            distance = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if distance > n - left or length > left:
                raise WebPError("a back-reference outside the image")
            events.append((literals + len(starts), length, distance))
            left -= length
        bits.at, at = stretch.base + here, n - left
        parts.append(stretch.colours(starts))
        if cache_bits:
            green = stretch.green[starts]
            of = np.nonzero(green >= 280)[0]
            hits += zip((literals + of).tolist(), (green[of] - 280).tolist(), strict=True)
        literals += len(starts)
    if bits.at > bits.end:
        raise WebPError("the stream ends early")
    found = np.concatenate(parts)
    if not events and not hits:
        return found
    slots = ((found * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).tolist() if hits else []
    found, out, done = found.tolist(), [], 0
    if not hits:
        for before, length, distance in events:
            out += found[done:before]
            out += _copied(out, length, distance)
            done = before
        return out + found[done:]
    cache, placed, cached = dict.fromkeys(range(1 << cache_bits), 0), [], 0  # placed: the slots of out
    for before, length, what in sorted([*events, *((i, 0, slot) for i, slot in hits)], key=lambda e: (e[0], e[1] == 0)):
        out += found[done:before]
        placed += slots[done:before]
        done = before
        if length:
            out += _copied(out, length, what)
            placed += _copied(placed, length, what)
        else:
            cache.update(zip(placed[cached:], out[cached:], strict=True))
            cached = len(out)
            out.append(cache[what])
            placed.append((CACHE_FACTOR * out[-1] & 0xFFFFFFFF) >> (32 - cache_bits))
            done += 1
    return out + found[done:]


def _copied(of: list[int], length: int, distance: int) -> list[int]:
    """What a back-reference repeats; it may reach into itself."""
    run = of[len(of) - distance : len(of) - distance + length]
    return (run * -(-length // distance))[:length] if len(run) < length else run


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels (n, 4) as red, green, blue, alpha bytes, before transforms are inverted."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("a colour cache of more than 11 bits")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    block, groups_of, groups = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        entropy = _image(bits, across, (height + (1 << block) - 1) >> block, False)
        groups_of = entropy[:, 0].astype(int) << 8 | entropy[:, 1]
        groups = int(groups_of.max()) + 1
    codes = [[_read_code(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if groups_of is None:
        return _bytes_of(_grouped(bits, codes[0], n, width, cache_bits))
    out, at = [0] * n, 0  # as alpha, red, green, blue
    while at < n:
        group = codes[groups_of[(at // width >> block) * across + (at % width >> block)]]
        symbol = group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = (group[i].read(bits) for i in (1, 2, 3))
            run = [alpha << 24 | red << 16 | symbol << 8 | blue]
        elif symbol < 280:
            length = _read_prefixed(bits, symbol - 256)
            code = _read_prefixed(bits, group[4].read(bits))
            distance = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if distance > at or at + length > n:
                raise WebPError("a back-reference outside the image")
            run = out[at - distance : at][:length]
            run = (run * -(-length // distance))[:length]
        else:
            run = [cache[symbol - 280]]
        out[at : at + len(run)] = run
        at += len(run)
        if cache:
            for colour in run:
                cache[(CACHE_FACTOR * colour & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
    return _bytes_of(out)


def _bytes_of(argb: list[int] | np.ndarray) -> np.ndarray:
    return np.asarray(argb, np.uint32).view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left, top, right, corner) -> np.ndarray:  # noqa: ANN001
    """left, top, top right and top left pixels as arrays of int of 4 channels."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode in (6, 7, 8, 9):
        return _mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _mean(left, top)
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(int), 0, 255)
    return np.array([0, 0, 0, 255])


def predictions(pixels: np.ndarray, width: int, x: int, y: int, mode: int) -> np.ndarray:
    """What the predictor transform predicts for pixel (x, y) from those before it; pixels: (n, 4) int."""
    at = y * width + x
    if at == 0:
        return np.array([0, 0, 0, 255])
    if y == 0:
        return pixels[at - 1]
    if x == 0:
        return pixels[at - width]
    return _predict(mode, pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])


def _unpredict(rest: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    used = {*(modes[:, 1] & 15).tolist()}
    if used in ({1}, {2}):  # sums along rows or columns
        out = rest.reshape(height, width, 4).copy()
        out[0, 0] += np.array([0, 0, 0, 255], np.uint8)
        out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
        if used == {2}:
            return np.cumsum(out, axis=0, dtype=np.uint8).reshape(-1, 4)
        out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
        out[1:] = np.cumsum(out[1:], axis=1, dtype=np.uint8)
        return out.reshape(-1, 4)
    out, across = rest.astype(int), (width + (1 << block) - 1) >> block
    for y in range(height):
        for x in range(width):
            at = y * width + x
            out[at] = (out[at] + predictions(out, width, x, y, int(modes[(y >> block) * across + (x >> block), 1]) & 15)) & 255
    return out.astype(np.uint8)


def colour_delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return factor.astype(np.uint8).view(np.int8).astype(int) * colour.astype(np.uint8).view(np.int8).astype(int) >> 5


def _uncross(rest: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    f = factors[(y >> block) * ((width + (1 << block) - 1) >> block) + (x >> block)]
    red, green, blue = (rest[:, i].astype(int) for i in range(3))
    red = (red + colour_delta(f[:, 2], green)) & 255
    blue = (blue + colour_delta(f[:, 1], green) + colour_delta(f[:, 0], red)) & 255
    return np.stack([red, green, blue, rest[:, 3]], 1).astype(np.uint8)


def decode(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Pixels (height, width, 4: red, green, blue, alpha) of the WebP file at `at`, and where it ends."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
        raise WebPError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, at + 4)[0]
    length = struct.unpack_from("<I", data, at + 16)[0]
    if at + 8 + size > len(data) or length + 12 > size or data[at + 20] != 0x2F:
        raise WebPError("a file that is cut off")
    bits = Bits(data[at + 21 : at + 20 + length])
    width, height, _alpha, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise WebPError("an unknown version")
    undo, seen, across = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform occurs twice")
        seen.add(kind)
        if kind in (0, 1):
            block = bits.read(3) + 2
            table = _image(bits, (across + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            undo.append((kind, across, block, table))
        elif kind == 2:
            undo.append((2, across, 0, None))
        else:
            colours = bits.read(8) + 1
            table = np.cumsum(_image(bits, colours, 1, False).astype(int), axis=0).astype(np.uint8)
            packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            undo.append((3, across, packed, table))
            across = (across + (1 << packed) - 1) >> packed
    pixels = _image(bits, across, height, True)
    for kind, across, block, table in reversed(undo):
        if kind == 0:
            pixels = _unpredict(pixels, across, height, block, table)
        elif kind == 1:
            pixels = _uncross(pixels, across, height, block, table)
        elif kind == 2:
            pixels = np.stack([pixels[:, 0] + pixels[:, 1], pixels[:, 1], pixels[:, 2] + pixels[:, 1], pixels[:, 3]], 1)
        else:
            y, x = np.divmod(np.arange(across * height), across)
            depth = 8 >> block
            index = pixels[y * ((across + (1 << block) - 1) >> block) + (x >> block), 1].astype(int) >> (x & ((1 << block) - 1)) * depth & ((1 << depth) - 1)
            whole = np.zeros((1 << depth if depth < 8 else 256, 4), np.uint8)
            whole[: len(table)] = table[: len(whole)]
            pixels = whole[index]
    return pixels.reshape(height, width, 4), at + 8 + size


def container(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def put(out: list[int], value: int, n: int) -> None:
    out.extend(value >> i & 1 for i in range(n))


def put_simple(out: list[int], *symbols: int) -> None:
    put(out, 1 | (len(symbols) - 1) << 1 | 1 << 2, 3)
    for s in symbols:
        put(out, s, 8)
