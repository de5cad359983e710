"""A lossless WebP encoder on arrays. Helpers without Spark.

It weighs subtracted green (as a cross-colour transform), the left and the top predictor and a palette by the entropy
that they leave, takes the one that saves bytes, replaces repeated runs of pixels by back-references and repeated
pixels by places of the colour cache where these pay, and writes canonical prefix codes made from the counts.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from ridgeline.llm.webp import CACHE_FACTOR, LENGTH_ORDER, NEAR, colour_delta, container, turned

BLACK = np.array([0, 0, 0, 255], np.uint8)
BLOCK = 9  # transforms are the same all over: blocks of 512 x 512 pixels, the largest
CACHE_BITS = 6
LITERAL_BITS, HIT_BITS = 14, 7  # about what a literal takes, and what a hit of the cache saves of it
CACHE_PAYS = 8  # the cache is for images of which it saves an eighth at least
LEAST_RUN = 3  # pixels of a back-reference
MOST_RUN = 4096
GREEN = 32  # factor 1 of the cross-colour transform
EXTRA = np.array([0] * 16 + [2, 3, 7])  # extra bits of the code length symbols
IN_ORDER = np.array(LENGTH_ORDER)
CHANNELS = np.arange(3, dtype=np.int64) * 256
TRANSFORM_BITS = 80  # about what a transform's own table takes


class Out:
    """Values and their sizes in bits, to be packed at once."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts += [(np.array(self.values, np.uint64), np.array(self.sizes, np.int64)), (values.astype(np.uint64), sizes)]
        self.values, self.sizes = [], []

    def packed(self) -> bytes:
        """All bits, the first the lowest; a value may lie across two words of 64."""
        values, sizes = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        first = np.nonzero(np.diff(word, prepend=-1))[0]
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(values >> np.uint64(1) >> (np.uint64(63) - shift), first)
        return out.tobytes()[: int(ends[-1]) + 7 >> 3]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code over two or more counts, at most `most`: counts are halved until it fits."""
    while True:
        order, n = np.argsort(counts, kind="stable"), len(counts)
        weights, parents = counts[order].tolist(), [0] * (2 * n - 1)
        leaf, inner = 0, n
        for end in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if inner == end or leaf < n and weights[leaf] <= weights[inner]:
                    taken = leaf
                    leaf += 1
                else:
                    taken = inner
                    inner += 1
                total += weights[taken]
                parents[taken] = end
            weights.append(total)
        depths = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depths[node] = depths[parents[node]] + 1
        if max(depths) <= most:
            lengths = np.empty(n, np.int64)
            lengths[order] = depths[:n]
            return lengths
        counts = counts + 1 >> 1


def _canonical(symbols: np.ndarray, n: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, their first bit lowest, and lengths by symbol; a single symbol takes no bits."""
    codes, sizes = np.zeros(alphabet, np.int64), np.zeros(alphabet, np.int64)
    if len(symbols) > 1:
        order = np.argsort(n, kind="stable")
        share = 1 << (15 - n[order])
        codes[symbols[order]], sizes[symbols] = turned(15)[np.cumsum(share) - share], n
    return codes, sizes


def _put_code(out: Out, symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code made for these symbols; codes and lengths by symbol."""
    counts = np.bincount(symbols, minlength=1)
    used = np.nonzero(counts)[0]
    if len(used) < 2 and alphabet - 1 >= (one := int(used[0]) if len(used) else 0) < 256:
        out.put(1 | 1 << 2 | one << 3, 11)
        return _canonical(used, used, alphabet)
    lengths = code_lengths(counts[used], 15) if len(used) > 1 else np.ones(1, np.int64)
    if len(used) == 2 and used[1] < 256:
        out.put(1 | 1 << 1 | 1 << 2 | int(used[0]) << 3 | int(used[1]) << 11, 19)
        return _canonical(used, lengths, alphabet)
    kinds, extras, before = [], [], -1
    for symbol, n in zip([*used.tolist(), alphabet], [*lengths.tolist(), None], strict=True):
        gap = symbol - before - 1
        while gap >= 3:
            run = min(gap, 138)
            kinds.append(18 if run > 10 else 17)
            extras.append(run - 11 if run > 10 else run - 3)
            gap -= run
        for _ in range(gap):
            kinds.append(0)
            extras.append(0)
        if n is not None:
            kinds.append(n)
            extras.append(0)
        before = symbol
    kinds, extras = np.array(kinds), np.array(extras)
    counts = np.bincount(kinds, minlength=19)
    kinds_used = np.nonzero(counts)[0]
    of_kinds = code_lengths(counts[kinds_used], 7) if len(kinds_used) > 1 else np.ones(1, np.int64)
    sizes = np.zeros(19, np.int64)
    sizes[kinds_used] = of_kinds
    in_order = sizes[IN_ORDER].tolist()
    last = max(3, max(i for i, n in enumerate(in_order) if n))
    out.put(last - 3 << 1, 5)
    for n in in_order[: last + 1]:
        out.put(n, 3)
    out.put(0, 1)  # all of the alphabet follows
    codes, sizes = _canonical(kinds_used, of_kinds, 19)
    out.extend(codes[kinds] | extras << sizes[kinds], sizes[kinds] + EXTRA[kinds])
    return _canonical(used, lengths, alphabet)


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number for lengths or distance codes, 1 or more."""
    less = values - 1
    high = np.frexp(np.maximum(less, 1))[1].astype(np.int64) - 1
    extra = np.maximum(high - 1, 0)
    return np.where(less < 4, less, 2 * high + (less >> extra & 1)), np.where(less < 4, 0, less & ((1 << extra) - 1)), np.where(less < 4, 0, extra)


def references(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs that repeat, greedily, each met at the last place with the same three pixels."""
    if len(argb) <= LEAST_RUN:
        return []
    wide = argb.astype(np.uint64)
    key = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (wide[2:] * np.uint64(0x165667B19E3779F9))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.nonzero(ordered[1:] == ordered[:-1])[0]
    if not len(same):
        return []
    places, before = order[same + 1], order[same]
    by_place = np.argsort(places)
    pixels, n, at, out = argb.tolist(), len(argb), 0, []
    for place, earlier in zip(places[by_place].tolist(), before[by_place].tolist(), strict=True):
        if place < at:
            continue
        length, most = 0, min(MOST_RUN, n - place)
        while length < most and pixels[place + length] == pixels[earlier + length]:
            length += 1
        if length >= LEAST_RUN:
            out.append((place, length, place - earlier))
            at = place + length
    return out


@cache
def _near(width: int) -> dict[int, int]:
    """The least code of each distance that has one of the short codes."""
    return {max(1, x + y * width): code for code, (x, y) in reversed([*enumerate(NEAR, 1)])}


def _put_image(out: Out, argb: np.ndarray, width: int, main: bool) -> None:
    """Writes an image of one group of codes, with back-references and a cache where they pay."""
    refs = references(argb) if main else []
    free = np.ones(len(argb), bool)
    for place, length, _ in refs:
        free[place : place + length] = False
    slots = ((argb * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - CACHE_BITS)).astype(np.uint16)
    hits = np.zeros(len(argb), bool)
    if main:
        order = np.argsort(slots, kind="stable")
        colours = argb[order]  # equal colours have equal slots
        hits[order[1:][colours[1:] == colours[:-1]]] = True
        hits &= free
        if int(hits.sum()) * HIT_BITS * CACHE_PAYS <= int(free.sum()) * LITERAL_BITS:
            hits[:] = False
    cached = bool(hits.any())
    literal = np.nonzero(free & ~hits)[0]
    hit = np.nonzero(hits)[0]
    place, length, distance = np.array(refs, np.int64).reshape(-1, 3).T
    near = _near(width)
    far = np.array([near.get(d, d + 120) for d in distance.tolist()], np.int64)
    (run, run_extra, run_bits), (back, back_extra, back_bits) = _prefixed(length), _prefixed(far)
    where = np.concatenate([literal, hit, place])
    order = np.argsort(where)
    green = np.concatenate([argb[literal] >> np.uint32(8) & np.uint32(255), 280 + slots[hit].astype(np.int64), 256 + run]).astype(np.int64)
    plain = argb[literal].view(np.uint8).reshape(-1, 4)
    channels = [plain[:, i] for i in (2, 0, 3)]
    out.put(1 | CACHE_BITS << 1, 5) if cached else out.put(0, 1)
    if main:
        out.put(0, 1)  # one group of codes
    codes = [_put_code(out, symbols, n) for symbols, n in ((green, 280 + (cached << CACHE_BITS)), *((c, 256) for c in channels), (back, 40))]
    # A literal, or a length with its extra bits and a distance with its own, is one value of at most 60 bits.
    values, sizes = codes[0][0][green], codes[0][1][green]
    some, rest = slice(0, len(literal)), slice(len(where) - len(place), None)
    following = [(some, c[symbols], n[symbols]) for (c, n), symbols in zip(codes[1:4], channels, strict=True) if n.any()]
    if refs:
        following += [(rest, run_extra, run_bits), (rest, codes[4][0][back], codes[4][1][back]), (rest, back_extra, back_bits)]
    for of, value, size in following:
        values[of] |= value << sizes[of]
        sizes[of] += size
    out.extend(values[order], sizes[order])


def _argb(pixels: np.ndarray) -> np.ndarray:
    p = pixels.reshape(-1, 4).astype(np.uint32)
    return p[:, 3] << np.uint32(24) | p[:, 0] << np.uint32(16) | p[:, 1] << np.uint32(8) | p[:, 2]


def _bits_left(pixels: np.ndarray) -> float:
    """Bits that the red, green and blue values take by their entropies."""
    flat = pixels.reshape(-1, 4)
    counts = np.bincount((flat[:, :3] + CHANNELS).ravel())
    counts = counts[counts > 0]
    return 3 * len(flat) * np.log2(len(flat)) - float((counts * np.log2(counts)).sum())


def less_green(pixels: np.ndarray) -> np.ndarray:
    out, taken = pixels.copy(), colour_delta(np.array(GREEN), pixels[:, :, 1]).astype(np.uint8)
    out[:, :, 0] -= taken
    out[:, :, 2] -= taken
    return out


def less_predicted(pixels: np.ndarray, mode: int) -> np.ndarray:
    """What the left (1) or the top (2) predictor leaves."""
    guess = np.empty_like(pixels)
    guess[0, 0], guess[0, 1:], guess[1:, 0] = BLACK, pixels[0, :-1], pixels[:-1, 0]
    guess[1:, 1:] = pixels[1:, :-1] if mode == 1 else pixels[:-1, 1:]
    return pixels - guess


def encode(rgb: np.ndarray) -> bytes:
    """A lossless WebP file of rgb (height, width, 3) uint8."""
    height, width, _ = rgb.shape
    pixels = np.full((height, width, 4), 255, np.uint8)
    pixels[:, :, :3] = rgb
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1 | (height - 1) << 14, 32)  # no alpha, version 0
    ways = {None: pixels, "green": less_green(pixels), 1: less_predicted(pixels, 1), 2: less_predicted(pixels, 2)}
    bits = {way: _bits_left(rest) + (TRANSFORM_BITS if way else 0) for way, rest in ways.items()}
    argb = _argb(pixels)
    ordered = np.sort(argb)
    colours = ordered[np.append(True, ordered[1:] != ordered[:-1])]
    if len(colours) <= 256:
        index = np.searchsorted(colours, argb)
        counts = np.bincount(index)
        bits["palette"] = TRANSFORM_BITS + 24 * len(colours) + float((counts * np.log2(len(index) / counts)).sum())
    way = min(bits, key=bits.get)
    out.put(way is not None, 1)
    if way == "palette":
        out.put(3 | len(colours) - 1 << 2, 10)
        table = colours.view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]
        _put_image(out, _argb(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(colours), False)
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        wide = (width + (1 << packed) - 1) >> packed
        places = np.zeros((height, wide << packed), np.uint32)
        places[:, :width] = index.reshape(height, width)
        shifts = np.arange(1 << packed, dtype=np.uint32) * np.uint32(8 >> packed)
        argb = (places.reshape(height, wide, -1) << shifts).sum(2, dtype=np.uint32).ravel() << np.uint32(8) | np.uint32(0xFF000000)
        width = wide
    elif way is not None:
        out.put((1 if way == "green" else 0) | BLOCK - 2 << 2, 5)
        across, down = (side + (1 << BLOCK) - 1 >> BLOCK for side in (width, height))
        value = 0xFF000000 | (GREEN << 8 | GREEN if way == "green" else way << 8)
        _put_image(out, np.full(across * down, value, np.uint32), across, False)
        argb = _argb(ways[way])
    if way is not None:
        out.put(0, 1)
    _put_image(out, argb, width, True)
    return container(out.packed())
