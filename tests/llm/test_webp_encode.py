"""The encoder: which transforms it takes, prefix codes against Huffman's bound, and round trips."""

import heapq
from fractions import Fraction

import numpy as np
import pytest

from ridgeline.llm import webp
from ridgeline.llm.webp_encode import code_lengths, encode, references


def transforms(data):
    """The kinds of transform that a file begins with: 0 predictor, 1 cross-colour, 3 palette."""
    first = int.from_bytes(data[25:27], "little")  # after the signature's byte and 32 bits of sizes
    return [first >> 1 & 3] if first & 1 else []


def noise(height, width, top, seed=0):
    return np.random.default_rng(seed).integers(0, top, (height, width, 3), dtype=np.uint8)


def images():
    grey = np.repeat(noise(64, 64, 128)[:, :, :1], 3, 2)
    rows = np.cumsum(noise(60, 64, 4), axis=0, dtype=np.uint8) + noise(1, 64, 250)
    columns = np.cumsum(noise(60, 64, 4), axis=1, dtype=np.uint8) + noise(60, 1, 250)
    return {"plain": (noise(40, 64, 256), []), "green": (grey, [1]), "top": (rows, [0]), "left": (columns, [0]), "palette": (noise(50, 64, 255)[0][np.random.default_rng(1).integers(0, 13, (50, 64))], [3])}


@pytest.mark.parametrize("name", images())
def test_transform_that_saves_bytes(name):
    pixels, kinds = images()[name]
    data = encode(pixels)
    assert transforms(data) == kinds
    got, end = webp.decode(data)
    assert end == len(data) and (got[:, :, :3] == pixels).all() and (got[:, :, 3] == 255).all()
    assert encode(pixels) == data  # the same bytes for the same pixels


def test_cache_and_references_shrink_the_file():
    few, many = noise(1, 40, 256)[0], noise(1, 700, 256)[0]
    rng = np.random.default_rng(2)
    mixed = np.where(rng.random((64 * 64, 1)) < 0.6, few[rng.integers(0, 40, 64 * 64)], many[rng.integers(0, 700, 64 * 64)]).reshape(64, 64, 3)
    repeated = np.concatenate([noise(20, 64, 256)] * 3)
    for pixels, most in ((mixed, 64 * 64 * 3 * 0.8), (repeated, 20 * 64 * 3 * 1.3)):
        data = encode(pixels.astype(np.uint8))
        assert len(data) < most and (webp.decode(data)[0][:, :, :3] == pixels).all()


@pytest.mark.parametrize("seed", range(8))
def test_round_trip_of_texts(seed):
    rng = np.random.default_rng(seed)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9), dtype=np.uint8)) for _ in range(60)]
    raw = b" ".join(words[i] for i in rng.integers(0, 60, rng.integers(1, 4000)))
    pixels = np.frombuffer(raw + b" " * (-len(raw) % 192), np.uint8).reshape(-1, 64, 3)
    assert (webp.decode(encode(pixels))[0][:, :, :3] == pixels).all()


def test_references_repeat_what_they_name():
    argb = np.random.default_rng(3).integers(0, 4, 3000).astype(np.uint32)
    refs = references(argb)
    assert refs
    for place, length, distance in refs:
        assert length >= 3 and all(argb[place + i] == argb[place - distance + i] for i in range(length))
    assert all(a[0] + a[1] <= b[0] for a, b in zip(refs, refs[1:], strict=False))


@pytest.mark.parametrize("counts", [[1, 1], [5, 1, 1], [1] * 256, [2**i for i in range(12)], [3, 9, 27, 1, 1, 4]])
def test_codes_are_optimal(counts):
    lengths = code_lengths(np.array(counts), 15).tolist()
    assert sum(Fraction(1, 2**n) for n in lengths) == 1
    heap, cost = sorted(counts), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert sum(c * n for c, n in zip(counts, lengths, strict=True)) == cost


def test_codes_keep_their_bound():
    lengths = code_lengths(np.array([2**i for i in range(30)]), 15).tolist()
    assert max(lengths) <= 15 and sum(Fraction(1, 2**n) for n in lengths) == 1
