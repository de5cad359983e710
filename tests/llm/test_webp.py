"""The decoder against streams of every feature, written here bit by bit."""

import numpy as np
import pytest

from ridgeline.llm import webp
from ridgeline.llm.media import features, load, payload, store


class Writer:
    """Writes a literal or back-referenced image with variable-length codes."""

    def __init__(self):
        self.out = []

    def put(self, v, n):
        webp.put(self.out, v, n)

    def code(self, freq, alphabet):
        """A skewed complete code over the symbols of freq; returns symbol -> (bits reversed, length)."""
        symbols = sorted(freq) or [0]
        if len(symbols) == 1 and symbols[0] < 256:
            webp.put_simple(self.out, symbols[0])
            return {symbols[0]: (0, 0)}
        if len(symbols) == 1:
            symbols = sorted({0, symbols[0]})
        n, lengths = len(symbols), {}
        if n <= 8:  # 1, 2, ..., n-1, n-1
            lengths = {s: min(i + 1, n - 1) for i, s in enumerate(symbols)}
        else:
            k = (n - 1).bit_length()
            short = (1 << k) - n
            lengths = {s: k - 1 if i < short else k for i, s in enumerate(symbols)}
        self.put(0, 1)
        self.put(15, 4)
        used = {0, *lengths.values(), 16, 17, 18}
        cl = {s: 3 if len(used) <= 8 else 4 for s in used}
        spare = iter(x for x in range(19) if x not in used)
        while sum(2.0**-v for v in cl.values()) < 1:
            cl[next(spare)] = 3 if len(used) <= 8 else 4
        if max(cl.values()) > 3 or sum(2.0**-v for v in cl.values()) != 1:
            cl = dict.fromkeys(range(16), 4)
        for s in webp.LENGTH_ORDER:
            self.put(cl.get(s, 0), 3)
        table = self.canonical(cl)
        self.put(0, 1)
        at = 0
        while at < alphabet:
            zeros = next((i for i in range(alphabet - at) if lengths.get(at + i, 0)), alphabet - at)
            if 18 in cl and zeros >= 11:
                zeros = min(zeros, 138)
                self.put(*table[18])
                self.put(zeros - 11, 7)
                at += zeros
            else:
                self.put(*table[lengths.get(at, 0)])
                at += 1
        return self.canonical(lengths)

    @staticmethod
    def canonical(lengths):
        out, code, last = {}, 0, 0
        for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
            code <<= n - last
            out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
            code, last = code + 1, n
        return out

    def image(self, pixels, width, main=True, cache_bits=0, refs=False, blocks=None):
        """pixels: list of (r, g, b, a). blocks: (bits, group of each block) for an entropy image."""
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(1 if blocks else 0, 1)
            if blocks:
                self.put(blocks[0] - 2, 3)
                self.image([(g >> 8, g & 255, 0, 255) for g in blocks[1]], len(blocks[1]), main=False)
        tokens, at, cache = [], 0, {}
        argb = [a << 24 | r << 16 | g << 8 | b for r, g, b, a in pixels]
        slot = lambda c: (webp.CACHE_FACTOR * c & 0xFFFFFFFF) >> (32 - cache_bits)
        while at < len(pixels):
            best = (0, 0)
            for d in range(1, min(at, 3 * width) + 1) if refs else ():
                n = 0
                while at + n < len(pixels) and n < 40 and argb[at + n] == argb[at + n - d]:
                    n += 1
                best = max(best, (n, -d))
            if best[0] >= 3:
                tokens.append(("ref", best[0], -best[1], at))
                step = best[0]
            elif cache_bits and cache.get(slot(argb[at])) == argb[at]:
                tokens.append(("cache", slot(argb[at]), 0, at))
                step = 1
            else:
                tokens.append(("lit", pixels[at], 0, at))
                step = 1
            for c in argb[at : at + step] if cache_bits else ():
                cache[slot(c)] = c
            at += step
        group_of = lambda at: blocks[1][(at // width >> blocks[0]) * ((width + (1 << blocks[0]) - 1) >> blocks[0]) + (at % width >> blocks[0])] if blocks else 0
        groups = max(blocks[1]) + 1 if blocks else 1
        prefix = lambda v: (v - 1, 0, 0) if v <= 4 else self.prefixed(v)
        near = {x + y * width: i + 1 for i, (x, y) in reversed([*enumerate(webp.NEAR)]) if x + y * width >= 1}
        tables = []
        for g in range(groups):
            own = [t for t in tokens if group_of(t[3]) == g]
            used = [set() for _ in range(5)]
            for kind, v, d, _ in own:
                if kind == "lit":
                    for i, c in enumerate((1, 0, 2, 3)):
                        used[i].add(v[c])
                elif kind == "cache":
                    used[0].add(280 + v)
                else:
                    used[0].add(256 + prefix(v)[0])
                    used[4].add(prefix(near.get(d, d + 120))[0])
            tables.append([self.code(u, n) for u, n in zip(used, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), strict=True)])
        for kind, v, d, at in tokens:
            t = tables[group_of(at)]
            if kind == "lit":
                for i, c in enumerate((1, 0, 2, 3)):
                    self.put(*t[i][v[c]])
            elif kind == "cache":
                self.put(*t[0][280 + v])
            else:
                for table, base, value in ((t[0], 256, v), (t[4], 0, near.get(d, d + 120))):
                    code, extra, bits = prefix(value)
                    self.put(*table[base + code])
                    self.put(extra, bits)

    @staticmethod
    def prefixed(v):
        v -= 1
        high = v.bit_length() - 1
        second = v >> (high - 1) & 1
        return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1

    def file(self, width, height):
        head = []
        webp.put(head, 0x2F, 8)
        webp.put(head, width - 1 | (height - 1) << 14 | 1 << 28, 32)
        return webp.container(np.packbits(np.array(head + self.out, np.uint8), bitorder="little").tobytes())


def picture(width, height, colours=0, seed=1):
    rng = np.random.default_rng(seed)
    if colours:
        table = rng.integers(0, 256, (colours, 4))
        return [tuple(map(int, table[i])) for i in rng.integers(0, colours, width * height)]
    return [tuple(map(int, p)) for p in (np.cumsum(rng.integers(-3, 4, (width * height, 4)), axis=0) + 128) & 255]


def same(data, pixels, width, height):
    got, end = webp.decode(data)
    assert end == len(data)
    assert [tuple(map(int, p)) for p in got.reshape(-1, 4)] == pixels and got.shape == (height, width, 4)


@pytest.mark.parametrize(("cache", "refs"), [(0, False), (0, True), (3, False), (11, True)])
def test_codes_references_and_cache(cache, refs):
    pixels = picture(13, 9, colours=12)
    w = Writer()
    w.put(0, 1)
    w.image(pixels, 13, cache_bits=cache, refs=refs)
    same(w.file(13, 9), pixels, 13, 9)


def test_entropy_image():
    pixels = picture(10, 9, colours=20)
    w = Writer()
    w.put(0, 1)
    w.image(pixels, 10, blocks=(2, [0, 1, 2, 1, 0, 2, 2, 1, 0]))
    same(w.file(10, 9), pixels, 10, 9)


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height = 9, 7
    pixels = picture(width, height)
    whole = np.array(pixels)
    rest = [tuple(map(int, (whole[y * width + x] - webp.predictions(whole, width, x, y, mode)) & 255)) for y in range(height) for x in range(width)]
    w = Writer()
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    w.image([(0, mode, 0, 255)] * 6, 3, main=False)
    w.put(0, 1)
    w.image(rest, width)
    same(w.file(width, height), pixels, width, height)


def test_predictor_by_hand():
    """Rows 10 20 / 30 ?: gradient 12 predicts left + top - corner."""
    p = np.array([[10] * 4, [20] * 4, [30] * 4, [0] * 4])
    assert webp.predictions(p, 2, 1, 1, 12).tolist() == [40] * 4
    assert webp.predictions(p, 2, 0, 0, 5).tolist() == [0, 0, 0, 255]
    assert webp.predictions(p, 2, 1, 1, 7).tolist() == [25] * 4


def test_cross_colour_and_subtract_green():
    width, height = 8, 4
    pixels = picture(width, height)
    whole = np.array(pixels)
    f = np.array([[250, 20, 3, 255]])  # red to blue, green to blue, green to red
    red = (whole[:, 0] - webp.colour_delta(f[:, 2], whole[:, 1])) & 255
    blue = (whole[:, 2] - webp.colour_delta(f[:, 1], whole[:, 1]) - webp.colour_delta(f[:, 0], whole[:, 0])) & 255
    less = np.stack([(red - whole[:, 1]) & 255, whole[:, 1], (blue - whole[:, 1]) & 255, whole[:, 3]], 1)
    w = Writer()
    w.put(1, 1), w.put(1, 2), w.put(1, 3)
    w.image([tuple(map(int, f[0]))], 1, main=False)
    w.put(1, 1), w.put(2, 2)
    w.put(0, 1)
    w.image([tuple(map(int, p)) for p in less], width)
    same(w.file(width, height), pixels, width, height)


@pytest.mark.parametrize("colours", [1, 2, 4, 11, 40])
def test_palette(colours):
    width, height = 11, 5
    table = picture(colours, 1, seed=4)
    which = np.random.default_rng(2).integers(0, colours, (height, width))
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    depth = 8 >> pack
    rows = []
    for y in range(height):
        for x in range(0, width, 1 << pack):
            rows.append((0, sum(int(v) << i * depth for i, v in enumerate(which[y, x : x + (1 << pack)])), 0, 255))
    delta = (np.diff(np.array(table), axis=0, prepend=np.zeros((1, 4), int))) & 255
    w = Writer()
    w.put(1, 1), w.put(3, 2), w.put(colours - 1, 8)
    w.image([tuple(map(int, d)) for d in delta], colours, main=False)
    w.put(0, 1)
    w.image(rows, -(-width // (1 << pack)))
    same(w.file(width, height), [table[i] for i in which.ravel()], width, height)


@pytest.mark.parametrize("text", ["", "a", "x" * 192, "é" * 500, "ab\n" * 3000, "".join(map(chr, range(32, 900)))])
def test_store_round_trip(text):
    data, n = payload(text)
    assert len(data) % 192 == 0 and data and data[:n].decode() == text
    pixels = load(store(data))
    assert pixels.tobytes() == data
    assert features(pixels) == features(load(store(data)))


def test_every_count_of_values():
    for n in range(1, 257):
        data = bytes(range(n)) * 192
        assert load(store(data)).tobytes() == data


def test_long_payload_takes_several_images():
    data = bytes(np.random.default_rng(0).integers(0, 256, 192 * (webp.SIDE + 5), dtype=np.uint8))
    assert load(store(data)).tobytes() == data


@pytest.mark.parametrize("data", [b"", b"RIFF", b"GIF89a" * 9])
def test_broken_files_raise(data):
    with pytest.raises((webp.WebPError, Exception)):
        webp.decode(data)


def test_cut_stream_raises():
    data = store(payload("hello " * 300)[0])
    with pytest.raises(webp.WebPError):
        webp.decode(data[: len(data) // 2])
