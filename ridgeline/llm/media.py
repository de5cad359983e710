"""Media columns: payload bytes stored as lossless WebP images, decoded to pixel arrays, and their features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import webp
from ridgeline.llm.common import narrow
from ridgeline.llm.webp_encode import encode

ROWS = 128  # images held at once when encoding
UNIT = 192  # bytes of payload, 64 pixels of 3 samples: a row of an image


def payload(text: str) -> tuple[bytes, int]:
    """UTF-8 with bytes 32 up to a positive multiple of UNIT, and its length before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)


def store(data: bytes) -> bytes:
    """Lossless WebP files one after another, each of at most 16384 rows of 64 pixels."""
    pixels = np.frombuffer(data, np.uint8).reshape(-1, 64, 3)
    return b"".join(encode(pixels[at : at + webp.SIDE]) for at in range(0, len(pixels), webp.SIDE))


def load(media: bytes) -> np.ndarray:
    """Pixels (rows, 64, 3) of what store() made, or of any lossless WebP files of one width."""
    at, parts = 0, []
    while at < len(media):
        pixels, at = webp.decode(media, at)
        parts.append(pixels[:, :, :3])
    return np.concatenate(parts)


def features(pixels: np.ndarray) -> str:
    """Rows, mean and deviation of each channel in thousandths, and a 4 x 4 mean hash of brightness, as text."""
    flat = pixels.reshape(-1, 3).astype(np.float64)
    mean, deviation = np.rint(flat.mean(0) * 1000).astype(int), np.rint(flat.std(0) * 1000).astype(int)
    light = flat.sum(1)
    if len(light) >= 16:
        sizes = np.full(16, len(light) // 16) + (np.arange(16) < len(light) % 16)
        cells = np.add.reduceat(light, np.cumsum(sizes) - sizes) / sizes
    else:
        cells = np.resize(light, 16)
    mask = int(sum(1 << i for i in np.nonzero(cells > cells.mean())[0]))
    return f"h{len(pixels)};m{','.join(map(str, mean))};s{','.join(map(str, deviation))};a{mask:04x}"


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (lossless WebP): one row per input row. Null and empty texts store one row of spaces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.iloc[at : at + ROWS]
                data = [payload(t) for t in b["text"]]
                yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": np.array([n for _, n in data], np.int64), "media": [store(d) for d, _ in data]})

    rows = narrow(df, id_col, text_col)
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of df, with pixels struct<height int, width int, samples binary (red, green, blue by row)>; null for null media.

    A media value that isn't lossless WebP raises.
    """

    @F.pandas_udf("height int, width int, samples binary")
    def pixels(media: pd.Series) -> pd.DataFrame:
        found = [load(m) if m is not None else None for m in media]
        return pd.DataFrame({"height": [p.shape[0] if p is not None else None for p in found], "width": [p.shape[1] if p is not None else None for p in found], "samples": [p.tobytes() if p is not None else None for p in found]})

    return df.withColumn("pixels", pixels(media_col))


def media_digest(df: DataFrame, padded_tail: bool = False) -> DataFrame:
    """What op2 reports of encode_media's rows: hashes of the payload decoded from the stored form and of that, and features.

    tail_crc32 is of the last 16 bytes of the text, or with padded_tail of the payload as it was read back. Each image is decoded, digested and let go before the next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, media in zip(b["n_bytes"], b["media"], strict=True):
                pixels = load(media)
                data = pixels.tobytes()
                tail = data[-16:] if padded_tail else data[max(0, n - 16) : n]
                out.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), features(pixels)))
            frame = pd.DataFrame(out, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            frame.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield frame

    rows = df.select("doc_id", "n_bytes", "media")
    return rows.mapInPandas(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
