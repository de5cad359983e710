"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are 3 to 5 bytes of lower-cased text inside a word or touching its ends. A document's vector is the mean of its
subwords' embeddings. As the softmax layer is linear, prediction uses the product of both, one row per hash bucket.
The model is trained on the driver on a bounded sample of labelled rows; a temperature fitted on part of that sample
calibrates the scores. Documents can be rejected by two bounds taken from that part: the best score, and the share of
subwords that no training text has, which tells an unlearned language or junk from a short text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import narrow

BUCKETS = 1 << 15
FINE = 22  # bits of a subword's hash
DIMENSIONS = 16
SIZES = (3, 4, 5)
PART = 1 << 18  # bytes whose subwords are hashed at once
SAMPLE = 3000  # labelled rows of the training sample, about, at most
SAMPLE_BYTES = 1 << 16  # longer texts stay out of the training sample
UNKNOWN = "und"

#: ASCII bytes that aren't letters become spaces.
_WORDS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}").search


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash of FINE bits) of all subwords of all texts, in parts; documents ascend within a part.

    The leading bits of a hash are its bucket of the embeddings (see bucket_of), all of it its place in the filter of
    subwords that training has seen, which is so much larger that few others fall on the same place.
    """
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(_WORDS) + b" " for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths)
    for at in range(0, len(data), PART):
        part = data[at : at + PART + SIZES[-1] - 1].astype(np.uint32)
        n = min(PART, len(data) - at)
        space = np.append(part == 32, np.ones(SIZES[-1], bool))
        part = np.append(part, np.full(SIZES[-1], 32, np.uint32))
        low = int(np.searchsorted(ends, at, side="right"))
        high = int(np.searchsorted(ends, at + n - 1, side="right")) + 1
        share = np.minimum(ends[low:high], at + n) - np.maximum(ends[low:high] - lengths[low:high], at)
        doc = np.repeat(np.arange(low, high), share)
        for size in SIZES:
            h = np.full(n, size, np.uint32)
            inner = np.zeros(n, bool)
            for k in range(size):
                h = h * np.uint32(0x01000193) ^ part[k : k + n]
                if 0 < k < size - 1:
                    inner |= space[k : k + n]
            ok = np.nonzero(~inner)[0]
            h = h[ok] * np.uint32(0x9E3779B1)
            yield doc[ok], (h >> np.uint32(32 - FINE)).astype(np.int64)


def bucket_of(fine: np.ndarray) -> np.ndarray:
    return fine >> (FINE - BUCKETS.bit_length() + 1)


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray  # (BUCKETS, languages): embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0  # by the best language's score
    unseen: np.ndarray | None = None  # (2 ** FINE,): whether no training text has a subword of this hash
    reject_unseen: float = 1.0  # by the share of such subwords

    def scores(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): calibrated probabilities."""
        return softmax(self.logits(texts) / self.temperature)

    def logits(self, texts: list[str]) -> np.ndarray:
        return self._means(texts)[0]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rejected): calibrated probabilities, and whether the best is too low or too many subwords are unknown."""
        logits, unseen = self._means(texts)
        scores = softmax(logits / self.temperature)
        return scores, (scores.max(axis=1) < self.reject_below) | (unseen > self.reject_unseen)

    def _means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, share of unseen subwords) of each text."""
        total, new, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts))
        for doc, fine in subwords(texts):
            if len(doc):
                heads = np.nonzero(np.append(True, doc[1:] != doc[:-1]))[0]
                total[doc[heads]] += np.add.reduceat(self.rows[bucket_of(fine)], heads, axis=0)
                if self.unseen is not None:
                    new[doc[heads]] += np.add.reduceat(self.unseen[fine].astype(np.float64), heads)
                count[doc[heads]] += np.diff(np.append(heads, len(doc)))
        return total / np.maximum(count, 1)[:, None] + self.bias, new / np.maximum(count, 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 1.0, seed: int = 7) -> Model:
    """Four fifths train the weights; the rest calibrate the temperature and the score for rejection."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(texts))
    cut = max(1, len(texts) * 4 // 5)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # each document's buckets and how often it has them
    trained, unseen = set(order[:cut].tolist()), np.ones(1 << FINE, bool)
    for at in range(0, len(texts), 16):
        part = texts[at : at + 16]
        bags: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in part]
        for doc, fine in subwords(part):
            heads = np.nonzero(np.append(True, doc[1:] != doc[:-1]))[0][: len(doc)]
            for d, mine in zip(doc[heads], np.split(fine, heads[1:]), strict=True) if len(doc) else ():
                bags[d].append(bucket_of(mine))
                if at + d in trained:
                    unseen[mine] = False
        for bag in bags:
            buckets, counts = np.unique(np.concatenate(bag), return_counts=True)
            found.append((buckets.astype(np.int32), counts.astype(np.float32)))
    embed = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, step = epochs * cut, 0
    for _ in range(epochs):
        for k in rng.permutation(order[:cut]):
            bucket, count = found[k]
            now = rate * (1 - step / steps)
            step += 1
            if not len(bucket):
                continue
            weight = count / count.sum()
            mean = weight @ embed[bucket]
            slope = softmax((mean @ layer + bias)[None])[0]
            slope[y[k]] -= 1
            back = layer @ slope
            layer -= now * np.outer(mean, slope)
            bias -= now * 0.1 * slope
            embed[bucket] -= now * 20 * np.outer(weight, back)
    model = Model(languages, (embed @ layer).astype(np.float32), bias)
    rest = order[cut:] if cut < len(texts) else order
    logits, truth = np.concatenate([model.logits([texts[k] for k in rest[at : at + 64]]) for at in range(0, len(rest), 64)]), y[rest]
    tries = np.geomspace(0.05, 20, 60)
    model.temperature = float(min(tries, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(rest)), truth] + 1e-12).mean()))
    # Both bounds leave room beyond 99.9 of 100 of the labelled documents that the weights weren't trained on.
    model.reject_below = float(np.quantile(softmax(logits / model.temperature).max(axis=1), 0.001, method="lower") * 0.7)
    model.unseen = unseen
    share = np.concatenate([model._means([texts[k] for k in rest[at : at + 64]])[1] for at in range(0, len(rest), 64)])
    model.reject_unseen = float(min(1.0, np.quantile(share, 0.999, method="higher") * 1.25 + 0.1))
    return model


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fits on at most about `sample` rows of df whose crc32(id as text) mod 5 isn't 0 and whose language is given.

    Each language has an equal share of the sample, drawn by a hash of the id; texts over SAMPLE_BYTES bytes stay out
    of the sample. None if no such row has a letter.
    """
    rows = narrow(df, id_col, text_col, F.col(lang_col).cast("string").alias("lang")).where("lang is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return None
    share = max(1, sample // len(sizes))
    limits = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, share / n)))))
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) / float(1 << 53)  # fine enough for any number of rows
    found = rows.where(dealt < limits[F.col("lang")]).where((F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang").collect()
    if not found:
        return None
    found.sort(key=lambda r: (str(r["doc_id"]), r["text"], r["lang"]))
    return train([r["text"] for r in found], [r["lang"] for r in found])


def language_of(text: Column, model: Model | None) -> Column:
    """struct<lang_pred, score, rejected> of a text column; see predict()."""
    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def language(text: pd.Series) -> pd.DataFrame:
        m = sent.value
        known = np.array([t is not None and _LETTER(t) is not None for t in text], bool) if m else np.zeros(len(text), bool)
        names, score, rejected = np.full(len(text), UNKNOWN, object), np.zeros(len(text)), np.ones(len(text), bool)
        if known.any():
            p, refused = m.judged(text[known].tolist())
            best = p.argmax(axis=1)
            names[known], score[known] = np.array(m.languages, object)[best], p[np.arange(len(p)), best]
            rejected[known] = refused
        return pd.DataFrame({"lang_pred": names, "score": score, "rejected": rejected})

    return language(text)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per input row.

    A null text or one without a letter is `und` with score 0 and rejected, as is every row if there is no model.
    Repeated rows stay and agree; of equal scores the first language in order counts; an empty table gives no rows.
    """
    return df.select(F.col(id_col).alias("doc_id"), language_of(F.col(text_col), model).alias("found")).select("doc_id", "found.*")


def keep_known(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of df whose language isn't rejected, all columns as they are."""
    return df.where(~language_of(F.col(text_col), model)["rejected"])
