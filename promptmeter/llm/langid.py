"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with elastic-net penalties and the probabilities are
calibrated by one temperature on documents that training left out. Document frequencies come from every
labelled row of the learning split; the weights from a bounded sample of them (`max_train_docs`, `max_train_chars`),
in one task of an executor, of which the driver gets the model alone.

Edge cases: a text that is null or has no letter is `und` with score 0; without any labelled row every text is.
A null doc_id belongs to neither split: it is not learned from and held_out is false. Rows with one doc_id and one
text count once in the sample, however often they stand in the table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slices import column, python_values
from .shared import unused

BITS = 16
DIMS = 1 << BITS
_BLOCK = 1 << 17
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and counts of the 1- to 3-grams over lower-cased letters; other runs are one space."""
    none = np.empty(0, np.int32), np.empty(0, np.float32)
    if not text:
        return none
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return none
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    cp = np.concatenate(([32], np.where(letter, cp, 32)[keep], [32])).astype(np.uint64)
    total = np.zeros(DIMS, np.int64)
    for at in range(0, len(cp), _BLOCK):
        x = part = cp[at : at + _BLOCK + 2]
        fresh = min(_BLOCK, len(part))
        for order, odd in enumerate(_ODD):
            if order:
                x = (x[:-1] << np.uint64(21)) | part[order:]
            ids = (x[:fresh] * odd) >> np.uint64(64 - BITS)
            total += np.bincount(ids.astype(np.int64), minlength=DIMS)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids].astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf[ids]
        return v / max(float(np.sqrt(v @ v)), 1e-9)

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(ids, counts) @ self.weights[ids] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        ids, counts = gram_counts(text)
        if not len(ids) or not self.langs:
            return "und", 0.0
        p = softmax(self.logits(ids, counts) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train_ftrl(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3) -> None:
    """Follow-the-regularised-leader, one row at a time, per-coordinate rates, L1 and L2 penalties."""
    classes = len(model.langs)
    z, n = np.zeros((DIMS, classes), np.float32), np.zeros((DIMS, classes), np.float32)
    zb, nb = np.zeros(classes), np.zeros(classes)
    order = np.random.default_rng(7)

    def lazy(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            ids, counts, y = rows[k]
            v = model.vector(ids, counts)[:, None]
            zs, ns = z[ids], n[ids]
            w, wb = lazy(zs, ns), -zb / ((beta + np.sqrt(nb)) / alpha + l2)
            g = softmax((v * w).sum(0) + wb)
            g[y] -= 1
            gw = v * g
            z[ids] = zs + gw - (np.sqrt(ns + gw * gw) - np.sqrt(ns)) / alpha * w
            n[ids] = ns + gw * gw
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    model.weights = lazy(z, n).astype(np.float32)
    model.bias = -zb / ((beta + np.sqrt(nb)) / alpha + l2)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature of least negative log-likelihood on rows that training has not seen (golden section over its logarithm)."""
    if not rows:
        return
    z, y = np.array([model.logits(i, c) for i, c, _ in rows]), np.array([k for *_, k in rows])

    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, r = np.log(0.05), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    model.temperature = float(np.exp((lo + hi) / 2))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for text in python_values(batch.column("text")):
            ids, _ = gram_counts(text)
            df[ids] += 1
            docs += bool(len(ids))
    ids = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1), pa.int32()), pa.array(np.append(df[ids], docs))], ["f", "n"])


def _trainer(model: Model, each: int):
    """A function over the batches of a sample (draw, lang, text): the trained model's parameters, pickled, of at most `each` rows a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: dict[str, list[tuple[int, str]]] = {}
        for pdf in batches:
            for draw, lang, text in pdf[["draw", "lang", "text"]].itertuples(index=False):
                rows.setdefault(lang, []).append((draw, text))
        learn, held = [], []
        for lang in sorted(rows):
            for k, (_, text) in enumerate(sorted(rows[lang])[:each]):
                ids, counts = gram_counts(text)
                if len(ids):
                    (held if k % 5 == 4 else learn).append((ids, counts, model.langs.index(lang)))
        train_ftrl(model, learn)
        calibrate(model, held)
        some = np.flatnonzero(model.weights.any(1))
        yield pd.DataFrame({"model": [pickle.dumps((some, model.weights[some], model.bias, model.temperature))]})

    return run


def fit(labelled: DataFrame, max_train_docs: int = 2000, max_langs: int = 500, max_train_chars: int = 20_000) -> Model:
    """Learns from rows (doc_id, text, lang); lang null or `und` is no label.

    The weights come from at most max_train_docs rows of at most max_train_chars characters, dealt evenly to the
    languages and chosen by a hash of doc_id and text; a fifth of them only sets the temperature. They meet in one
    task, so both bounds hold its memory. More than max_langs languages are refused.
    """
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and lang <> 'und' and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    model = Model(sorted(sizes), np.ones(DIMS, np.float32), np.zeros((DIMS, len(sizes)), np.float32), np.zeros(len(sizes)))
    if not sizes:
        return model
    n = rows.select("text").mapInArrow(_document_frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n, df = n["f"].to_numpy(), n["n"].to_numpy(), np.zeros(DIMS + 1, np.float64)
    df[f] = n  # -1, the last, is the number of documents
    model.idf = (np.log((1 + df[-1]) / (1 + df[:DIMS])) + 1).astype(np.float32)
    each = max(2, max_train_docs // len(sizes))
    share = F.create_map(*(F.lit(x) for k, c in sizes.items() for x in (k, min(1.0, 1.3 * each / c))))
    draw = F.xxhash64(F.lit(11), "doc_id", "text")
    sample = rows.where(F.length("text") <= max_train_chars).select(draw.alias("draw"), "lang", "text")
    sample = sample.where(F.pmod("draw", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).distinct().orderBy("draw", "lang", "text").limit(4 * max_train_docs)
    blank = Model(model.langs, model.idf, np.empty((0, len(sizes)), np.float32), model.bias)
    found = sample.coalesce(1).mapInPandas(_trainer(blank, each), "model binary").first()
    if found:
        some, weights, model.bias, model.temperature = pickle.loads(bytes(found["model"]))
        model.weights[some] = weights
    return model


def predictor(model: Model):
    """A column function text -> struct(lang_pred, score) that carries the broadcast model."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)
    names = "lang_pred", "score"

    def make():
        predict = shared.value.predict
        return lambda text: dict(zip(names, predict(text), strict=True))

    return lambda texts: column(texts, make, "lang_pred string, score double", pa.struct({"lang_pred": pa.string(), "score": pa.float64()}))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the columns lang_pred and score, replacing columns of these names."""
    rest, of = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")], unused(docs, "lang")
    return docs.select(*rest, predictor(model)("text").alias(of)).select(*rest, f"{of}.lang_pred", f"{of}.score")


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("doc_id").isNotNull())


def reject_unclear(docs: DataFrame, least: float = 0.4, max_train_docs: int = 2000) -> DataFrame:
    """docs without those whose language can't be told: no letter, or best calibrated probability under `least`."""
    model, of = fit(learnable(docs), max_train_docs), unused(docs, "lang")
    out = docs.withColumn(of, predictor(model)("text")).where((F.col(of)["lang_pred"] != "und") & (F.col(of)["score"] >= least))
    return out.select(*docs.columns)
