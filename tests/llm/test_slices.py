"""Python columns of the pipeline's stages take a batch a slice at a time, with the values of the whole batch."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptmeter.functions import slices
from promptmeter.llm import langid, minmax, packing, word_ids

TEXTS = [None, "", "one", *(" ".join(f"w{k % 7} word{j}" for j in range(5 * (k % 40))) for k in range(300))]


@pytest.fixture
def run_of(monkeypatch):
    """The function of the Arrow UDF that a call makes."""
    got = []

    class Udf:
        def asNondeterministic(self):
            return self

        def __call__(self, *cols):
            return None

    def arrow_udf(first, returns=None):
        if returns is None:
            return lambda run: got.append(run)
        got.append(first)
        return Udf()

    monkeypatch.setattr(F, "arrow_udf", arrow_udf)
    monkeypatch.setattr(slices, "MOST", 1 << 14)

    def of(make):
        make()
        return got.pop()

    return of


def few_rows_each(parts, n):
    parts = list(parts)
    assert len(parts) > 3 and all(len(p) < n / 3 for p in parts)
    return [x for p in parts for x in p.to_pylist()]


def test_pieces_of_a_batch(run_of, monkeypatch):
    run = run_of(packing.pieces_udf)
    monkeypatch.setattr(packing, "CHARS", 1 << 14)
    got = few_rows_each(run(iter([pa.array(TEXTS)])), len(TEXTS))
    for text, pieces in zip(TEXTS, got, strict=True):
        ids = np.append(*(word_ids.encoder(word_ids.vocabulary_path()).ids([text or ""])[0], np.uint32(packing.END_ID))).astype("<u4")
        parts = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert pieces == [{"piece": k, "start": 2048 * k, "length": len(p), "ids_crc32": zlib.crc32(p.tobytes())} for k, p in enumerate(parts)]


def test_signatures_and_sets_of_a_batch(run_of):
    sets = few_rows_each(run_of(lambda: minmax._sets("x", 5))(iter([pa.array(TEXTS)])), len(TEXTS))
    assert sets == [minmax.shingles(t, 5).tobytes() for t in TEXTS]
    rows = few_rows_each(run_of(lambda: minmax._signatures("x", 5))(iter([pa.array(TEXTS)])), len(TEXTS))
    for data, row in zip(sets, rows, strict=True):
        h = np.frombuffer(data, np.uint64)
        assert row["n"] == len(h)
        assert row["bands"] == (minmax.bands(minmax.signature(h)).tolist() if len(h) else None)
        assert row["sketch"] == (minmax.odd_sketch(h).tolist() if len(h) else None)


def test_common_hashes_of_a_batch(run_of):
    sets = [minmax.shingles(t, 5) for t in TEXTS]
    a, b = (pa.array([s.tobytes() for s in x], pa.binary()) for x in (sets, sets[7:] + sets[:7]))
    got = few_rows_each(run_of(lambda: minmax._common("a", "b"))(iter([(a, b)])), len(TEXTS))
    assert got == [len(set(x.tolist()) & set(y.tolist())) for x, y in zip(sets, sets[7:] + sets[:7], strict=True)]


def test_languages_of_a_batch(run_of, spark):
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b"], np.ones(langid.DIMS, np.float32), rng.normal(size=(langid.DIMS, 2)).astype(np.float32), np.zeros(2))
    run = run_of(lambda: langid.predictor(model)("x"))
    got = few_rows_each(run(iter([pa.array(TEXTS)])), len(TEXTS))
    assert [(r["lang_pred"], r["score"]) for r in got] == [model.predict(t) for t in TEXTS]
