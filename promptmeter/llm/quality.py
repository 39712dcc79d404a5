"""Quality classifier: supervised subword embeddings.

A token (white-space separated, as written) is the mean of the hashed vectors of itself and of its character
3- to 5-grams over its whole length; two tokens in a row have a hashed vector of their own. A document is the mean of
its tokens and of its pairs of tokens, and a softmax over that vector gives the label. Vectors and output layer are
learned together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.

Edge cases: null and empty texts have the zero vector and so the score of the bias; without any label 1 and 0 both
present the score is the share of label 1 (0.5 without labels); labels other than 0 and 1 are no labels; rows whose
doc_id is null are scored and not held out, and never learned from; rows with one doc_id may all be learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column_udf

BITS, DIM = 16, 16
BUCKETS = 1 << BITS
#: Bytes of a token above which it isn't remembered and its n-grams are counted in blocks; bytes of text taken at a time.
LONG, BLOCK = 1 << 12, 1 << 20
_SHIFT = np.uint32(32 - BITS)
_STEP, _LAST, _PAIR = np.uint32(0x01000193), np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_CUT = re.compile(rb"[ \t-\r]")


def _gram_buckets(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """n and the buckets of all n-grams of the bytes, n from 3 to 5."""
    h = part.astype(np.uint32)
    for n in range(2, 6):
        h = h[:-1] * _STEP + part[n - 1 :]
        if n > 2:
            yield n, ((h ^ np.uint32(n)) * _LAST) >> _SHIFT


def word_hash(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word)


def token_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of tokens and of their character n-grams (over bytes, with marks at both ends), and whose they are (sorted by neither)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    part = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
    of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    owners, buckets = [np.arange(len(words), dtype=np.int32)], [(np.fromiter(map(word_hash, words), np.uint32, len(words)) * _LAST) >> _SHIFT]
    for n, b in _gram_buckets(part):
        inside = of[: len(b)] == of[n - 1 :]
        owners.append(of[: len(b)][inside])
        buckets.append(b[inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def long_token_counts(word: bytes) -> np.ndarray:
    """How often each bucket stands among the features of one token, in blocks, so memory is bounded."""
    marked = np.frombuffer(b"<" + word + b">", np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    counts[(np.array([word_hash(word)], np.uint32) * _LAST) >> _SHIFT] += 1
    for at in range(0, len(marked), BLOCK // 4):
        for n, b in _gram_buckets(marked[at : at + BLOCK // 4 + 4]):
            counts += np.bincount(b[: BLOCK // 4 if at + BLOCK // 4 + n - 1 <= len(marked) else None].astype(np.int64), minlength=BUCKETS)
    return counts


def pair_buckets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (((first * _PAIR) ^ second) * _LAST) >> _SHIFT


def blocks(text: str | None) -> Iterator[list[bytes]]:
    """The tokens of a text, of about BLOCK bytes at a time."""
    data, at = (text or "").encode("utf-8", "replace"), 0
    while len(data) - at > BLOCK:
        cut = _CUT.search(data, at + BLOCK)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end
    yield data[at:].split()


class TokenValues:
    """Of each token the mean of its features' values and its hash. Tokens are remembered; when there are too many, the older half goes."""

    def __init__(self, values: np.ndarray, most: int = 100_000):
        self.values, self.most = values, most
        self.young: dict[bytes, int] = {}
        self.known = self._none()
        self.old, self.old_known = self.young, self.known

    @staticmethod
    def _none() -> tuple[np.ndarray, np.ndarray]:
        return np.empty(0), np.empty(0, np.uint32)

    def _of_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        mean = np.empty(len(words))
        for at in range(0, len(words), 1 << 14):
            part = words[at : at + (1 << 14)]
            b, of = token_features(part)
            mean[at : at + len(part)] = np.bincount(of, self.values[b], len(part)) / np.bincount(of, minlength=len(part))
        return mean, np.fromiter(map(word_hash, words), np.uint32, len(words))

    def _learn(self, words: list[bytes]) -> None:
        """Words that aren't among the young ones join them; the old ones' values are kept."""
        kept = np.fromiter(map(self.old.get, words, repeat(-1)), np.int64, len(words))
        value, h = np.empty(len(words)), np.empty(len(words), np.uint32)
        for have, take in zip((value, h), self.old_known):
            have[kept >= 0] = take[kept[kept >= 0]]
        lacking = np.flatnonzero(kept < 0)
        value[lacking], h[lacking] = self._of_new([words[k] for k in lacking])
        self.young.update(zip(words, range(len(self.young), len(self.young) + len(words))))
        self.known = tuple(np.concatenate(x) for x in zip(self.known, (value, h)))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.young) > self.most:
            self.old, self.old_known, self.young, self.known = self.young, self.known, {}, self._none()
        where = np.fromiter(map(self.young.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(where < 0)
        new = [words[k] for k in lacking]
        self._learn([w for w in dict.fromkeys(new) if len(w) <= LONG])
        where[lacking] = np.fromiter(map(self.young.get, new, repeat(-1)), np.int64, len(new))
        value, h = (x[where] if len(x) else np.zeros(len(words), x.dtype) for x in self.known)
        for k in np.flatnonzero(where < 0):  # too long to be remembered
            counts = long_token_counts(words[k])
            value[k], h[k] = counts @ self.values / counts.sum(), word_hash(words[k])
        return value, h


@dataclass
class Model:
    vectors: np.ndarray
    out: np.ndarray
    bias: float

    def direction(self) -> np.ndarray:
        """All of a vector that the score needs."""
        return (self.vectors @ self.out).astype(np.float64)


class Scorer:
    def __init__(self, direction: np.ndarray, bias: float):
        self.direction, self.bias, self.tokens = direction, bias, TokenValues(direction)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """A score for each text; texts are taken together up to BLOCK bytes."""
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        words: list[bytes] = []
        of: list[tuple[int, int]] = []
        size, last = 0, (-1, np.uint32(0))

        def settle() -> None:
            nonlocal last
            if words:
                value, h = self.tokens(words)
                doc = np.repeat([k for k, _ in of], [n for _, n in of])
                # the last token of a text's block before forms a pair with the first of this one
                before, h_before = np.append(last[0], doc[:-1]), np.append(last[1], h[:-1])
                pair = np.where(before == doc, self.direction[pair_buckets(h_before, h)], 0.0)
                np.add(sums, np.bincount(doc, value + pair, len(texts)), out=sums)
                np.add(counts, np.bincount(doc, 1.0 + (before == doc), len(texts)), out=counts)
                last = (int(doc[-1]), h[-1])
            words.clear()
            of.clear()

        for k, text in enumerate(texts):
            for part in blocks(text):
                if part:
                    words.extend(part)
                    of.append((k, len(part)))
                size += len(text or "")
                if size > BLOCK:
                    settle()
                    size = 0
        settle()
        return 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + self.bias, -40, 40)))


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their weights in the document's mean."""
    words = [w for part in blocks(text) for w in part]
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    count = Counter(words)
    parts = [(pair_buckets(h[:-1], h[1:]).astype(np.int64), np.ones(len(h) - 1)) for h in (np.fromiter(map(word_hash, words), np.uint32, len(words)),)]
    if short := [w for w in count if len(w) <= LONG]:
        b, of = token_features(short)
        parts.append((b, (np.array([count[w] for w in short]) / np.bincount(of))[of]))
    for w in count:
        if len(w) > LONG:
            n = long_token_counts(w)
            parts.append((np.arange(BUCKETS), count[w] * n / n.sum()))
    ids, where = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
    weights = np.bincount(where, np.concatenate([x for _, x in parts]))
    return ids[weights > 0], (weights[weights > 0] / (2 * len(words) - 1)).astype(np.float32)


def train(texts: list[str | None], labels: list[int], epochs: int = 3, rate: float = 0.5, vector_rate: float = 20.0, seed: int = 3) -> Model:
    """Gradient descent, one document at a time, with falling rates; a document's step in its vectors is at most what moves their mean by one gradient."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, share = np.zeros((DIM, 2), np.float32), (sum(labels) / len(labels) if labels else 0.5)
    bias = np.zeros(2, np.float32)
    if not 0 < share < 1:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(vectors, out[:, 1], float(np.log(p / (1 - p))))
    rows, steps, step = [document_features(t) for t in texts], epochs * len(texts), 0
    most = [min(vector_rate, 1 / max(float(w @ w), 1e-9)) for _, w in rows]
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            fall = 1 - step / steps
            step += 1
            ids, w = rows[k]
            h = w @ vectors[ids]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= np.float32(rate * fall) * np.outer(h, p)
            bias -= np.float32(0.1 * rate * fall) * p
            if len(ids):
                vectors[ids] -= np.float32(most[k] * fall) * w[:, None] * back[None, :]
    return Model(vectors, out[:, 1] - out[:, 0], float(bias[1] - bias[0]))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train_docs: int = 4000, max_train_chars: int = 50_000) -> Model:
    """Learns from at most max_train_docs labelled rows outside the held-out fifth, of at most max_train_chars characters each.

    They are chosen by a hash of doc_id. These two bounds also bound what is broadcast to find the texts and what
    reaches the driver, however many rows have one doc_id. A document of two labels counts once with each.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out()).distinct()
    draw = F.xxhash64(F.lit(5), "doc_id", "y")
    chosen = rows.orderBy(draw, "doc_id", "y").limit(max_train_docs)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_train_chars)
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    sample = sample.orderBy(draw, "doc_id", "y", F.xxhash64("text"), "text").limit(max_train_docs).toPandas().sort_values(["doc_id", "y", "text"])
    return train(sample["text"].tolist(), sample["y"].tolist())


def score_udf(model: Model):
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast((model.direction(), model.bias))

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Scorer(*shared.value)
        for s in texts:
            yield pd.Series(one(s.tolist()), dtype="float64")

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return column_udf("double")(score)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score_udf(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
