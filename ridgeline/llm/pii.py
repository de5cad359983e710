"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give base spans, which always stay. The field labels white-space tokens that hold a digit, an @ or a
written-out at (all others are outside by definition and cut the chain). Neighbouring tokens share chain potentials; all
occurrences of a value in a document share skip potentials with one hub, which sees the cues of all of them, so the links
of n repeats are n. What the occurrences tell a hub counts 1 / n each: the same token seen often is no more evidence
than once. A value is the joined digits of one to four neighbouring tokens, or else a token. Base spans are
observed. Loopy sum-product message passing until each document settles then gives each token's marginals; confident
ones become added spans. Weights are trained here by gradient ascent on texts that a
seeded generator writes; nothing is learned from the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import narrow

KINDS = ("email", "ip", "card", "phone")
SETTLED = 1e-3  # change of a document's messages at which they stop, whatever its neighbours in a batch do
ROUNDS = 1000  # at most, for a document whose messages never settle
SURE = 0.95  # least marginal of a repeated value's hub or of one of its tokens: repeats alone are no evidence
ALONE = 0.7  # and of every token of an added span that isn't repeated
CHAIN, SKIP = 0, 1

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits would also start at its head, so the look-behind changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]|[\[(][Aa][Tt][\])]")


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by start and then kind as listed; leftmost, not overlapping within a kind."""
    found: list[tuple[int, int, int]] = []
    at = last = 0
    while (at := text.find("@", at)) >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while m and start > last and text[start - 1] in _LOCAL:
            start -= 1
        at += 1
        if m and start < at - 1:
            last = at = m.end()
            found.append((start, 0, last))
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# Tokens and features


_TOKEN_END = re.compile(r"[\x20\x09-\x0D]")


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the white-space tokens that hold a digit, an @, [at] or (at)."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        end = _TOKEN_END.search(text, m.end())
        end = end.start() if end else len(text)
        start = m.start()
        while start > at and text[start - 1] not in " \t\n\v\f\r":
            start -= 1
        out.append((start, end))
        at = end
    return out


#: Words before a token that say what it is (fixed values, four languages).
CUES = {
    "email": "email e-mail mail correo courriel".split(),
    "ip": "ip host server servidor serveur address adresse".split(),
    "card": "card visa mastercard karte carte tarjeta account konto compte".split(),
    "phone": "phone tel telephone call fax mobile telefon teléfono téléphone handy móvil".split(),
}
_CUE = {w: f"cue-{k}" for k, ws in CUES.items() for w in ws}
_SHAPES = {
    "mail": re.compile(r"[^@]+@[^@]+\.[A-Za-z]{2,}"),
    "quad": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?"),
    "plus": re.compile(r"\+[0-9].*"),
    "area": re.compile(r"\([0-9]{2,4}\)"),
    "local": re.compile(r"[0-9]{3}[-.][0-9]{4}"),
    "number": re.compile(r"(?:\([0-9]{3}\)|[0-9]{3})[-.][0-9]{3}[-.][0-9]{4}"),
    "quartet": re.compile(r"[0-9]{4}"),
    "card-like": re.compile(r"[0-9]{4}(?:-[0-9]{4}){3}"),
    "date": re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"),
    "money": re.compile(r"[$€£]?[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{1,2})?[$€£%]?"),
}
_TRIM = ".,;:!?\"'<>[]{}*#&%$"


def _digits_class(n: int) -> str:
    return f"digits-{next(b for b in (0, 2, 3, 4, 6, 7, 9, 11, 13, 19, 1 << 60) if n <= b)}"


#: Feature names, the index of each is its row in the weights. "" is the padding, of weight zero.
FEATURES = ["", "bias", "hidden-mail", *sorted(_SHAPES), *sorted(f"cue-{k}" for k in KINDS), *sorted(f"any-cue-{k}" for k in KINDS), *(_digits_class(n) for n in (0, 1, 3, 4, 5, 7, 8, 10, 12, 14, 99)), "letters", "first", "long"]
_PLACE = {f: i for i, f in enumerate(FEATURES)}
_ANY = {_PLACE[f"cue-{k}"]: _PLACE[f"any-cue-{k}"] for k in KINDS}
SLOTS = len(_SHAPES) + len(KINDS) + 5  # as many features as a token can have
_AT, _DOT = re.compile(r"\[at\]|\(at\)|@"), re.compile(r"\[dot\]|\(dot\)|\.")
VALUE_TOKENS = 4  # neighbouring tokens that one value may be written in


def features(token: str, before: str) -> list[int]:
    """Places of the features of a token; before: what stands ahead of it, its last words count as cues."""
    word = token.strip(_TRIM)
    found = ["bias", _digits_class(sum(c in "0123456789" for c in token))]
    found += [n for n, p in _SHAPES.items() if p.fullmatch(word)]
    if (at := _AT.search(word)) and _DOT.search(word, at.end()):
        found.append("hidden-mail")
    cues = {_CUE[w] for w in (x.strip(_TRIM + "()").lower() for x in before.rsplit(None, 2)[-2:]) if w in _CUE}
    found += sorted(cues)
    if any(c.isalpha() for c in word):
        found.append("letters")
    if len(token) > 40:
        found.append("long")
    return [_PLACE[f] for f in found]


def repeated_values(found: list[str], joined: list[bool]) -> list[list[int]]:
    """The tokens of each value that occurs more than once; joined: whether a token follows the one before it directly.

    A token belongs to the value with most digits that it is part of.
    """
    digits = [re.sub("[^0-9]", "", t) for t in found]
    windows, last, count = [], {}, {}
    for i in range(len(found)):
        value = ""
        for j in range(i, min(i + VALUE_TOKENS, len(found))):
            if not digits[j] or j > i and not joined[j]:
                break
            value += digits[j]
            if len(value) > 19:
                break
            if len(value) >= 7:
                key = "#" + value
                windows.append((key, i, j + 1))
                if i >= last.get(key, 0):
                    last[key], count[key] = j + 1, count.get(key, 0) + 1
        if len(key := found[i].strip(_TRIM).lower()) >= 5:
            windows.append((key, i, i + 1))
            last[key], count[key] = i + 1, count.get(key, 0) + 1
    value_of: list[str] = [""] * len(found)
    for key, i, j in sorted((w for w in windows if count[w[0]] > 1), key=lambda w: (w[0][0] == "#", len(w[0]))):
        value_of[i:j] = [key] * (j - i)
    members: dict[str, list[int]] = {}
    for i, key in enumerate(value_of):
        if key:
            members.setdefault(key, []).append(i)
    return [m for m in members.values() if len(m) > 1]


class Graph:
    """Tokens of many documents with their chain and skip links, as arrays."""

    def __init__(self) -> None:
        self.unary: list[list[int]] = []
        self.observed: list[int] = []  # label, or -1
        self.links: list[tuple[int, int, int]] = []
        self.starts: list[int] = []  # first place of each document
        self.hubs: list[tuple[int, list[int]]] = []  # and the tokens of each

    def add(self, text: str, spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> None:
        """One document: its tokens get the next places, then the hubs of its repeated values."""
        first = len(self.unary)
        self.starts.append(first)
        end, k = 0, 0
        joined: list[bool] = []  # to the token before
        for i, (s, e) in enumerate(spans):
            here = len(self.unary)
            self.unary.append(features(text[s:e], text[end:s]))
            while k < len(base) and base[k][2] <= s:
                k += 1
            label = -1
            for kind, bs, be in base[k:]:
                if bs >= e:
                    break
                if be > s:
                    label = KINDS.index(kind) + 1
                    break
            self.observed.append(label)
            joined.append(bool(i) and spans[i - 1][1] + 1 == s and text[s - 1] == " ")
            if joined[-1]:
                self.links.append((here - 1, here, CHAIN))
            end = e
        for members in repeated_values([text[s:e] for s, e in spans], joined):
            hub = len(self.unary)
            cues = {_ANY[f] for i in members for f in self.unary[first + i] if f in _ANY}
            self.unary.append(sorted(cues))
            self.observed.append(-1)
            self.hubs.append((hub, [first + i for i in members]))
            self.links += [(first + i, hub, SKIP) for i in members]

    def marginals(self, weights: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, labels) beliefs, (links, labels, labels) beliefs, and the links (from, to, type)."""
        n, labels = len(self.unary), weights.shape[1]
        slots = np.zeros((n, SLOTS), np.int64)
        for i, u in enumerate(self.unary):
            slots[i, : len(u)] = u
        own = weights[slots].sum(axis=1)
        observed = np.array(self.observed, np.int64)
        clamp = observed >= 0
        own[clamp] = -30
        own[np.nonzero(clamp)[0], observed[clamp]] = 0
        edge = np.array(self.links, np.int64).reshape(-1, 3)
        m = len(edge)
        src, dst = np.concatenate([edge[:, 0], edge[:, 1]]), np.concatenate([edge[:, 1], edge[:, 0]])
        pair = np.exp(np.concatenate([links[edge[:, 2]], links[edge[:, 2]].transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        message = np.zeros((2 * m, labels))  # logarithms
        belief = own.copy()
        # No link leaves its document.
        part = np.zeros(2 * m, np.int64)
        part[:m] = part[m:] = np.searchsorted(np.array(self.starts, np.int64), edge[:, 0], side="right")
        share = np.ones((2 * m, 1))
        into = np.nonzero(edge[:, 2] == SKIP)[0]
        share[into, 0] = 1 / np.bincount(edge[into, 1], minlength=1)[edge[into, 1]] if len(into) else 1
        live = np.arange(2 * m)
        for _ in range(ROUNDS):
            if not len(live):
                break
            cavity = belief[src[live]] - message[back[live]]
            cavity = np.exp(cavity - cavity.max(axis=1, keepdims=True))
            new = np.einsum("ey,eyz->ez", cavity, pair[live])
            new = 0.5 * message[live] + 0.5 * share[live] * np.log(new / new.sum(axis=1, keepdims=True))
            moved = np.zeros(len(self.starts) + 1)
            np.maximum.at(moved, part[live], np.abs(new - message[live]).max(axis=1))
            np.add.at(belief, dst[live], new - message[live])
            message[live] = new
            live = live[moved[part[live]] > SETTLED]
        if m:
            joint = pair[:m] * np.exp((belief[src[:m]] - message[back[:m]])[:, :, None] + (belief[dst[:m]] - message[:m])[:, None, :] - belief[src[:m]].max(axis=1)[:, None, None] - belief[dst[:m]].max(axis=1)[:, None, None])
            joint /= joint.sum(axis=(1, 2), keepdims=True)
        else:
            joint = np.zeros((0, labels, labels))
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True), joint, edge


def _sample(rng: np.random.Generator, words: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up text and the personal data in it."""
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: words[rng.integers(len(words))]
    pick = lambda *options: options[rng.integers(len(options))]
    card = [num(4) for _ in range(4)]
    mine = {
        "email": pick(f"{word()}.{word()}{num(2)}@{word()}{pick('.com', '.org', '.example.com')}", f"{word()}{pick('[at]', '(at)')}{word()}{pick('[dot]', '(dot)', '.')}{pick('com', 'org')}"),
        "ip": ".".join(str(x) for x in rng.integers(0, 256, 4)),
        "card": pick(" ".join(card), "-".join(card)),
        "phone": pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(1)} {num(3)} {num(3)} {num(4)}", f"({num(3)}) {num(3)}.{num(4)}", num(10)),
    }
    other = lambda: pick(num(1), num(2), num(3), num(4), num(6), f"{num(4)}-{num(2)}-{num(2)}", f"${num(3)}.{num(2)}", f"v{num(1)}.{num(2)}.{num(1)}", f"{num(2)}%", f"#{num(5)}", num(9), num(10), num(10), num(12), num(16), f"{word()}{num(3)}", f"{num(1)},{num(3)}", f"@{word()}", f"{num(3)}-{num(4)}", f"{num(20)}{word()}")
    text, spans = "", []
    repeated = pick(*mine)
    for _ in range(12):
        text += " ".join(word() for _ in range(int(rng.integers(1, 5)))) + " "
        if rng.random() < 0.4:
            kind = repeated if rng.random() < 0.6 else pick(*mine)
            if rng.random() < 0.6:
                text += pick(*CUES[kind]) + pick(" ", ": ")
            spans.append((kind, len(text), len(text) + len(mine[kind])))
            text += mine[kind] + pick(" ", ". ", ", ")
        elif rng.random() < 0.8:
            text += other() + " "
    return text, spans


@lru_cache(maxsize=1)
def train(texts: int = 150, steps: int = 100, rate: float = 2.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(unary weights, link weights by type): gradient ascent on the likelihood, with beliefs by message passing."""
    rng = np.random.default_rng(seed)
    words = ["".join("bcdfglmnprst"[a] + "aeiou"[b] for a, b in zip(rng.integers(0, 12, k), rng.integers(0, 5, k), strict=True)) for k in rng.integers(1, 5, 400)]
    graph, truth = Graph(), []
    for _ in range(texts):
        text, spans = _sample(rng, words)
        where = tokens(text)
        graph.add(text, where, [])
        for s, e in where:
            truth.append(next((KINDS.index(k) + 1 for k, a, b in spans if a < e and b > s), 0))
        truth += [truth[of[0]] for hub, of in graph.hubs if hub >= len(truth)]
    y = np.array(truth)
    labels = len(KINDS) + 1
    weights, links = np.zeros((len(FEATURES), labels)), np.zeros((2, labels, labels))
    slots = np.zeros((len(y), SLOTS), np.int64)
    for i, u in enumerate(graph.unary):
        slots[i, : len(u)] = u
    for _ in range(steps):
        belief, joint, edge = graph.marginals(weights, links)
        slope = -belief
        slope[np.arange(len(y)), y] += 1
        grad = np.zeros_like(weights)
        for k in range(SLOTS):
            np.add.at(grad, slots[:, k], slope)
        grad[0] = 0
        weights += rate * (grad / np.maximum(np.bincount(slots.ravel(), minlength=len(FEATURES)), 30)[:, None] - 0.002 * weights)
        for kind in (CHAIN, SKIP):
            of = edge[:, 2] == kind
            seen = np.zeros((labels, labels))
            np.add.at(seen, (y[edge[of, 0]], y[edge[of, 1]]), 1)
            step = (seen - joint[of].sum(axis=0)) / max(of.sum(), 1)
            if kind == SKIP:
                step = (step + step.T) / 2
            links[kind] += 2 * rate * (step - 0.0005 * links[kind])
    return weights, links


# The operator


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in _TRIM:
        end -= 1
    while start < end and text[start] in _TRIM:
        start += 1
    return start, end


def find(texts: list[str], weights: np.ndarray, links: np.ndarray) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Per text: base spans, and base and added spans together."""
    graph, where, bases, firsts = Graph(), [], [], []
    for t in texts:
        spans, base = [], []
        if _MARK.search(t):
            base, spans = base_spans(t), tokens(t)
        firsts.append(len(graph.unary))
        graph.add(t, spans, base)
        where.append(spans)
        bases.append(base)
    belief = graph.marginals(weights, links)[0] if graph.unary else np.zeros((0, len(KINDS) + 1))
    least = np.full(len(belief), ALONE)
    for hub, of in graph.hubs:
        least[[hub, *of]] = SURE
    label = np.where(belief.max(axis=1, initial=0) >= least, belief.argmax(axis=1) if len(belief) else 0, 0)
    for hub, of in graph.hubs:  # a value is one kind everywhere: its hub's if that is sure, else that of its surest token
        if kind := label[hub] or label[max(of, key=lambda i: belief[i, 1:].max())]:
            label[of] = kind
    out = []
    for t, spans, base, first in zip(texts, where, bases, firsts, strict=True):
        added: list[tuple[str, int, int]] = []
        mine = label[first : first + len(spans)]
        i = 0
        while i < len(spans):
            if not mine[i] or graph.observed[first + i] >= 0:
                i += 1
                continue
            j = i + 1
            while j < len(spans) and mine[j] == mine[i] and graph.observed[first + j] < 0 and spans[j - 1][1] + 1 == spans[j][0]:
                j += 1
            s, e = _trimmed(t, spans[i][0], spans[j - 1][1])
            if s < e:
                added.append((KINDS[mine[i] - 1], s, e))
            i = j
        order = {k: n for n, k in enumerate(KINDS)}
        out.append((base, sorted(base + added, key=lambda x: (x[1], order[x[0]], x[2])) if added else base))
    return out


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 64) -> DataFrame:
    """doc_id, text, base and spans, both array<struct<kind, start, end>> in code points: one row per input row.

    spans holds the base spans and those the field adds. Null and empty texts have none; repeated rows stay and agree.
    """
    weights, links = train()
    sent = df.sparkSession.sparkContext.broadcast((weights, links))
    rows = narrow(df, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for b in batches:
            for at in range(0, len(b), rows_at_once):
                part = b.iloc[at : at + rows_at_once]
                found = find(part["text"].tolist(), *sent.value)
                yield part.assign(base=[as_rows(x) for x, _ in found], spans=[as_rows(x) for _, x in found])

    span = "array<struct<kind string, start long, end long>>"
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, base {span}, spans {span}")


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each span of personal data in text_col replaced by its kind in angle brackets; null texts stay null.

    Of overlapping spans, the first one's kind is written for their union.
    """
    sent = df.sparkSession.sparkContext.broadcast(train())

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        out = text.copy()
        known = [i for i, t in enumerate(text) if t is not None and _MARK.search(t)]
        for at in range(0, len(known), 64):
            part = known[at : at + 64]
            for i, (_, spans) in zip(part, find([text.iloc[k] for k in part], *sent.value), strict=True):
                if not spans:
                    continue
                pieces, end = [], 0
                for kind, s, e in spans:
                    if s >= end:
                        pieces += [text.iloc[i][end:s], f"<{kind}>"]
                    end = max(end, e)
                out.iloc[i] = "".join([*pieces, text.iloc[i][end:]])
        return out

    return df.withColumn(text_col, masked(text_col))
