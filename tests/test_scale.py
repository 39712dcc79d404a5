"""Operators that are built for large inputs, against plain forms."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptmeter.functions import bpe, pretok, slices, utf8
from promptmeter.operators import encoding, fairness, governance, tariffs, usage
from promptmeter.sources import pricing
from promptmeter.sources.cut import shared_dir
from promptmeter.streaming import windows
from promptmeter.streaming.pipe import Ledger, QuotaSink, by_epoch, quota_by_key

RANKS = {bytes([b]): b for b in range(256)}
for _k, _t in enumerate(["th", "the", " the", "in", "ing", "an", " a", "and", "  ", "é", "日"]):
    RANKS[_t.encode()] = 256 + _k
RANKS |= {"é".encode()[:1] + b"x": 400}
SMALL = {kind: bpe.Encoding(f"small_{kind}", kind, RANKS) for kind in ("cl100k", "o200k", "spaces")}


# slices


def outputs(monkeypatch, make, batch):
    """What the Arrow UDF that `make` builds hands out for one batch, part by part."""
    got = []
    monkeypatch.setattr(F, "arrow_udf", lambda run, returns: lambda *cols: got.append(run))
    make()
    return list(got[0](iter([batch])))


def in_slices(monkeypatch, make, batch, expected):
    parts = outputs(monkeypatch, make, batch)
    assert [x for p in parts for x in p.to_pylist()] == expected
    assert len(parts) > 3 and all(len(p) < len(batch) / 3 for p in parts)


TEXTS = [None, "", "a 12 b3456 ", *(f"{k} words of 1234567 texts " * (k % 90) for k in range(5000))]


def test_pieces_go_out_in_slices_of_a_batch(monkeypatch):
    batch = pa.array(TEXTS)
    in_slices(monkeypatch, lambda: pretok.pieces("x", "cl100k"), batch, [pretok.split(t, "cl100k") for t in TEXTS])
    digits = [sum(p.isdigit() for p in pretok.split(t, "o200k")) for t in TEXTS]
    in_slices(monkeypatch, lambda: pretok.piece_count("x", "o200k", "[0-9]+"), batch, digits)
    assert list(map(len, slices.slices(pa.array(["x" * 9, None, "", "yy", "z"]), 4))) == [1, 4] and list(slices.slices(pa.array([], pa.string()))) == [pa.array([], pa.string())]


def test_raw_bytes_become_text_in_slices_of_a_batch(monkeypatch):
    raw = [None if t is None else b"\xe2\x82" + t.encode() + b"\xf0" for t in TEXTS]
    batch = pa.array(raw, pa.binary())
    in_slices(monkeypatch, lambda: utf8.as_text("x"), batch, [utf8.decode_bytes(b) for b in raw])
    in_slices(monkeypatch, lambda: utf8.pieces("x", "spaces"), batch, [utf8.true_pieces(b, "spaces") for b in raw])


def test_ids_come_and_go_in_slices_of_a_batch(spark, monkeypatch):
    ids = [None, [], [1, 2], *([k % 256] * 1000 for k in range(2000))]
    vocabulary = spark.createDataFrame([(bytearray([b]), b) for b in range(1, 256)], "token binary, rank int")
    rows = spark.createDataFrame([(None,)], "ids array<int>").withColumn("bytes", F.lit(None).cast("binary"))
    monkeypatch.setattr(type(rows), "withColumn", lambda self, name, made: self)
    token = lambda i: bytes([i] if i else [])
    in_slices(monkeypatch, lambda: bpe.decode(rows, "ids", vocabulary), pa.array(ids, pa.list_(pa.int32())), [b"".join(map(token, x or [])) for x in ids])
    coded = bpe.Encoder(SMALL["o200k"])
    in_slices(monkeypatch, lambda: bpe.encode("x", SMALL["o200k"]), pa.array(TEXTS), [coded.ids(t) for t in TEXTS])


# pieces


def test_a_block_holds_each_distinct_piece_once(monkeypatch):
    monkeypatch.setattr(encoding, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Own", (), {"partitionId": lambda self: 3})())}))
    texts = [None, "", *("the same words again and again " * 330 + f"{k}" for k in range(300)), " ".join(f"w{k}" for k in range(25_000))]
    batch = pd.DataFrame({"key": list(map(str, range(len(texts)))), "text": texts})
    tracemalloc.start()
    out = list(encoding._blocks("cl100k", 1 << 30)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6 and all(len(x) <= 10_000 for x in out)
    rows = pd.concat([x for x in out if x["kind"].iloc[0] == encoding._PIECE])
    cuts = [pretok.split(t, "cl100k") for t in texts]
    assert dict(zip(rows["piece"], rows["occurrences"])) == Counter(p for c in cuts for p in c)
    assert dict(zip(rows["piece"], rows["documents"])) == Counter(p for c in cuts for p in set(c))
    names = list(rows.sort_values("k")["piece"])
    assert [[names[k] for k in np.frombuffer(x, "<i4")] for x in out[0]["places"]] == cuts and set(rows["block"]) == {3 << 32}


@pytest.mark.parametrize("kind", ["cl100k", "o200k", "spaces"])
def test_pieces_merged_once_are_encode(spark, kind):
    rng = random.Random(kind)
    pool = ["the", "thing", " and", "é日", "12345", "!?", "\n\n", "  ", "an", "x" * 50]
    texts = [None, "", " ", "the " * 2000, *("".join(rng.choice(pool) + " " * rng.randrange(2) for _ in range(rng.randrange(40))) for _ in range(200))]
    rows = [(k % 150, t) for k, t in enumerate(texts)] + [(None, "the and"), (2**60 + 1, "thing")]
    d = spark.createDataFrame(rows, "id long, t string").repartition(3)
    e = SMALL[kind]
    table = encoding.PieceTable(d, "id", "t", e, block=500)
    plain = bpe.Encoder(e, native=False)
    got = table.ids().collect()
    assert sorted(str((r["id"], r["ids"])) for r in got) == sorted(str((k, plain.ids(t))) for k, t in rows)
    assert sorted(str(tuple(r)) for r in table.counts().collect()) == sorted(str((k, plain.count(t))) for k, t in rows)
    pieces = Counter(p for _, t in rows for p in bpe.split(t, kind))
    held = Counter(p for _, t in rows for p in set(bpe.split(t, kind)))
    assert {r["piece"]: (r["occurrences"], r["documents"]) for r in table.pieces().collect()} == {p: (n, held[p]) for p, n in pieces.items()}
    used = Counter(i for _, t in rows for i in plain.ids(t))
    row = table.utilisation(rare=5).first()
    assert (row["vocabulary"], row["used"], row["tokens"], row["rare"]) == (len(RANKS), len(used), sum(used.values()), sum(n <= 5 for n in used.values()))
    vocabulary = spark.createDataFrame([(bytearray(t), r) for t, r in RANKS.items()], "token binary, rank int")
    assert {r["rank"] for r in table.unused(vocabulary).collect()} == set(RANKS.values()) - set(used) and row["unused"] == len(RANKS) - len(used)


def test_no_text_no_piece(spark):
    none = spark.createDataFrame([], "id long, t string")
    table = encoding.PieceTable(none, "id", "t", SMALL["cl100k"])
    assert table.ids().count() == table.counts().count() == 0 and table.utilisation().first()["used"] == 0
    with pytest.raises(ValueError, match="vocabulary"):
        encoding.PieceTable(none, "id", "t", bpe.CL100K).ids()


# raw bytes


def plain_decode(data):
    """One step a byte: a sound sequence by the strict decoder, or U+FFFD for one byte."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                c = data[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            if len(c) == 1 and len(data[at : at + size]) == size:
                out.append(c)
                at += size
                break
        else:
            out.append("�")
            at += 1
    return "".join(out)


def byte_buffers(seed, n):
    rng = random.Random(seed)
    sound = "aé日😀 \n�'s1".encode()
    for _ in range(n):
        size = rng.randrange(200)
        if rng.random() < 0.5:
            yield bytes(rng.randrange(256) for _ in range(size))
        else:
            data = bytearray(sound * 8)[: size + 1]
            for _ in range(rng.randrange(4)):
                data[rng.randrange(len(data))] = rng.choice([0xFF, 0xC0, 0xED, 0xA0, 0xF4, 0x90, 0x80, 0x41])
            yield bytes(data)


def test_bytes_against_the_plain_decoder(spark):
    given = [b"", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf5\x80\x80\x80", b"\xf4\x90\x80\x80", b"\xef\xbf\xbd\xff", *byte_buffers(0x12345678, 1500)]
    for data in given:
        assert utf8.decode_bytes(data) == plain_decode(data), data
        for kind in ("cl100k", "o200k", "spaces"):
            pieces = utf8.true_pieces(data, kind)
            if kind != "spaces":
                assert b"".join(pieces) == data
            assert "".join(map(utf8.decode_bytes, pieces)).count("�") >= 0
    assert utf8.decode_bytes(b"\xe2\x82") == "��" and b"\xe2\x82".decode(errors="replace") == "�"  # not the library's own rule
    d = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(given[:400])] + [(-1, None)], "k long, payload binary")
    got = d.select("k", utf8.as_text("payload").alias("t"), utf8.pieces("payload", "cl100k").alias("p"), utf8.encode("payload", SMALL["cl100k"]).alias("ids")).collect()
    token = {r: t for t, r in RANKS.items()}
    for r in got:
        data = given[r["k"]] if r["k"] >= 0 else b""
        assert r["t"] == plain_decode(data) and [bytes(p) for p in r["p"]] == utf8.true_pieces(data, "cl100k")
        assert b"".join(token[i] for i in r["ids"]) == data  # true bytes come back, also faulty ones


# quotas


def usage_rows(n, seed=1):
    rng = random.Random(seed)
    return [(k, f"k{rng.choice([0, 0, 0, 1, 2])}", rng.randrange(9), rng.randrange(3), 0.001 * rng.randrange(5), "e" if rng.random() < 0.1 else None) for k in range(n)]


USAGE = "n long, key string, input long, output long, cost double, error string"


def brute_quota(rows, limit):
    out, total, lines = [], 0, 0
    for r in rows:
        if lines and total >= limit:
            break
        out.append(r[0])
        if r[5] is None:
            lines, total = lines + 1, total + r[2] + r[3]
    return out


def files_of(spark, folder, rows, schema, per):
    for k in range(0, len(rows), per):
        spark.createDataFrame(rows[k : k + per], schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def folder(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def test_quota_goes_on_after_a_restart(spark, folder):
    rows = usage_rows(120)

    def run(limit):
        sink = QuotaSink(by_epoch(folder("out")), "n", max_tokens=limit, folder=folder("ledger"))
        stream = spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).parquet(folder("in"))
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", folder("cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        return sink

    files_of(spark, folder("in"), rows[:60], USAGE, 20)
    limit = sum(r[2] + r[3] for r in rows[:80] if r[5] is None)
    first = run(limit)
    files_of(spark, folder("in"), rows[60:], USAGE, 20)
    second = run(limit)  # another object, as after a restart of the driver
    got = sorted(r["n"] for r in spark.read.parquet(folder("out")).collect())
    assert first.tokens < limit <= second.tokens and got == brute_quota(rows, limit)
    # a batch that is run again after a failure counts once
    again = QuotaSink(by_epoch(folder("out")), "n", max_tokens=limit, folder=folder("ledger"))
    again(spark.createDataFrame(rows[20:40], USAGE), 1)
    assert sorted(r["n"] for r in spark.read.parquet(folder("out")).collect()) == got
    assert Ledger(spark, folder("ledger")).before(2)["tokens"] == sum(r[2] + r[3] for r in rows[:40] if r[5] is None)
    with pytest.raises(ValueError, match="another checkpoint"):
        QuotaSink(by_epoch(folder("o2")), "n", max_tokens=5, folder=folder("l2"))(spark.createDataFrame(rows, USAGE), 3)


def test_quota_by_key_keeps_its_state(spark, folder):
    rows = usage_rows(150, 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows[:75], rows[75:]):
            files_of(spark, folder("in"), part, USAGE, 25)
            stream = spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).parquet(folder("in"))
            out = quota_by_key(stream, "key", "n", max_tokens=100)
            q = out.writeStream.format("parquet").option("path", folder("out")).option("checkpointLocation", folder("cp")).trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(folder("out")).collect()
    for key in ("k0", "k1", "k2"):
        assert sorted(r["n"] for r in got if r["key"] == key) == brute_quota([r for r in rows if r[1] == key], 100)
    assert len(got) == len({r["n"] for r in got}) < len(rows)


def test_slices_hang_on_the_range(spark, monkeypatch):
    rows = [(k * 1000, "k", 1, 0, 0.0, None) for k in range(300)]
    monkeypatch.setattr(usage, "SLICES", 3)
    got = usage.until_quota(spark.createDataFrame(rows, USAGE), "n", max_tokens=200)
    assert got.count() == 200 and usage.until_quota(spark.createDataFrame([], USAGE), "n", max_tokens=2).count() == 0


# windows


TIMED = "ts timestamp, key string, input long, output long, cost double, error string"


def test_streamed_windows_are_the_batch_ones(spark, folder):
    rng = random.Random(5)
    rows = [(k * 600 + rng.randrange(-900, 900), rng.choice("ab"), rng.randrange(9), 1, 0.5, "e" if k % 11 == 0 else None) for k in range(300)]
    timed = spark.createDataFrame(rows, TIMED.replace("ts timestamp", "s long")).select(F.timestamp_seconds("s").alias("ts"), "key", "input", "output", "cost", "error")
    data = [tuple(r) for r in timed.collect()]
    files_of(spark, folder("in"), data, TIMED, 60)
    for name, make in (("tumbling", lambda d, delay: windows.tumbling(d, "ts", "1 hour", "key", delay=delay)), ("sessions", lambda d, delay: windows.sessions(d, "ts", "5 minutes", "key", delay=delay))):
        stream = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 2).parquet(folder("in"))
        batch = {str(tuple(r)) for r in make(timed, None).collect()}
        if name == "tumbling":
            sink = windows.Upserts(folder(name))
            q = make(stream, "2 hours").writeStream.outputMode("update").foreachBatch(sink)
            q.option("checkpointLocation", folder(f"cp-{name}")).trigger(availableNow=True).start().awaitTermination(300)
            assert {str(tuple(r)) for r in sink.last(spark, "start", "key").collect()} == batch
        else:  # sessions leave the state when they are closed
            q = make(stream, "2 hours").writeStream.format("parquet").option("path", folder(name)).outputMode("append")
            q.option("checkpointLocation", folder(f"cp-{name}")).trigger(availableNow=True).start().awaitTermination(300)
            got = {str(tuple(r)) for r in spark.read.parquet(folder(name)).collect()}
            assert got <= batch and len(got) > len(batch) * 0.7


def test_late_rows_are_kept_aside(spark, folder):
    at = lambda *hours: spark.createDataFrame([(int(h * 3600), "a", 1, 0, 0.0, None) for h in hours], TIMED.replace("ts timestamp", "s long")).select(F.timestamp_seconds("s").alias("ts"), "key", "input", "output", "cost", "error")
    batches = [(10.1, 10.9), (13.5, 10.2), (10.3, 11.4, 12.2), (9.5, 13.6, 20.0), (13.7,)]
    for hours in batches:
        at(*hours).coalesce(1).write.mode("append").parquet(folder("in"))
    sink = windows.CostWindows(folder("w"), "ts", "1 hour", 3600, "key")

    def run():
        stream = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(folder("in"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", folder("cp")).trigger(availableNow=True).start().awaitTermination(300)

    run()
    late = lambda: sorted(r["ts"].timestamp() / 3600 for r in sink.late(spark).collect())
    # a window of an hour is closed an hour after its end by the batches before
    assert late() == [9.5, 10.3, 11.4, 13.7]
    assert sum(r["lines"] for r in sink.windows(spark).collect()) == sum(map(len, batches)) - 4
    on_time = [h for k, hours in enumerate(batches) for h in hours if h not in late()]
    expected = {str(tuple(r)) for r in windows.tumbling(at(*on_time), "ts", "1 hour", "key").collect()}
    assert {str(tuple(r)) for r in sink.windows(spark).select("start", "end", "key", "lines", "tokens", "cost_pico").collect()} == expected
    sink(at(*batches[2]), 2)  # run again
    assert late() == [9.5, 10.3, 11.4, 13.7] and sum(r["lines"] for r in sink.windows(spark).collect()) == len(on_time)
    at(10.0, 30.0).coalesce(1).write.mode("append").parquet(folder("in"))
    run()  # started again
    assert late() == [9.5, 10.0, 10.3, 11.4, 13.7]


# prices


def test_bands_and_dated_prices(spark):
    rng = random.Random(7)
    bands = [("m", 0, 1.0), ("m", 200_000, 2.0), ("m", 500_000, 4.0), ("n", 10, 9.0)]
    rows = [(k, rng.choice(["m", "m", "n", "x", None]), rng.choice([0, 1, 10, 11, 200_000, 200_001, 700_000])) for k in range(200)]
    got = tariffs.with_bands(spark.createDataFrame(rows, "id long, model string, tokens long"), spark.createDataFrame(bands, "model string, above long, price double")).collect()
    fit = lambda m, n: max(((a, p) for b, a, p in bands if b == m and a < n), default=(0, None))[1]
    assert {r["id"]: r["price"] for r in got} == {k: fit(m, n) for k, m, n in rows} and len(got) == 200

    history = [(rng.choice(["m", "m", "m", "n"]), rng.randrange(400) * 1000, float(k)) for k in range(150)] + [(None, 5, 1.0), ("m", None, 2.0)]
    asked = [(k, rng.choice(["m", "m", "m", "n", "x", None]), rng.choice([rng.randrange(400) * 1000, rng.randrange(400_000), None])) for k in range(500)]
    usage_ = spark.createDataFrame(asked, "id long, model string, s long").select("id", "model", F.timestamp_seconds("s").alias("ts"))
    dated = spark.createDataFrame(history, "model string, s long, price double").select("model", F.timestamp_seconds("s").alias("since"), "price")
    last = lambda m, t: max(((s, p) for h, s, p in history if h == m and m is not None and s is not None and t is not None and s <= t), default=(0, None))[1]
    for seconds in (3600, 86_400, 10**7):
        got = tariffs.as_of(usage_, dated, "model", "ts", "since", seconds).collect()
        assert {r["id"]: r["price"] for r in got} == {k: last(m, t) for k, m, t in asked} and len(got) == 500
    assert tariffs.as_of(usage_.limit(0), dated, "model", "ts", "since").count() == 0
    assert tariffs.as_of(usage_, dated.limit(0), "model", "ts", "since").where("price is not null").count() == 0


def test_why_a_cache_is_not_used(spark, tmp_path):
    import hashlib

    p = tmp_path / "p.json"
    p.write_text('{"valid_until": 8640000, "models": {"m": {"input_price_per_mtok": 1}}}')
    digest = hashlib.sha256(p.read_bytes()).hexdigest()
    load = lambda **x: pricing.load_prices(spark, f"file://{p}", **x)
    assert load()[1:] == ("packaged", "not verified") and load(sha256=digest, now=1e12)[1:] == ("packaged", "stale")
    good = load(sha256=digest, now=8640000)
    assert good[1:] == ("cache", None) and good.prices.count() == 1
    assert "PATH_NOT_FOUND" in pricing.load_prices(spark, "/nowhere").reason


# spread


def test_gini_of_many_values(spark):
    rng = random.Random(9)
    for values in ([rng.choice([0, 1, 5, 100]) for _ in range(3000)], [rng.expovariate(1) for _ in range(3000)], [3] * 50, [0, 0], [], [5], [1, 1, 1, 100, None]):
        x = np.sort(np.array([v for v in values if v is not None], float))
        n = len(x)
        expected = float((2 * np.arange(1, n + 1) - n - 1) @ x / (n * x.sum())) if n > 1 and x.sum() else 0.0
        got = fairness.gini(spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double"), "x").first()["gini"]
        assert got == pytest.approx(expected, abs=1e-9)


def test_last_rows_keep_their_columns(spark):
    rows = [("a", 1, None, {"k": 1}), ("a", 3, "x", {"k": 2}), ("b", 2, "y", None), (None, 9, "z", None)]
    d = spark.createDataFrame(rows, "path string, place long, v string, m map<string,int>")
    assert sorted(map(str, governance.last_by_path(d).collect())) == sorted(map(str, d.where("place <> 1").collect()))
    assert governance.last_by_path(d, first=True).columns == d.columns


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, _jsc = "spark://host:7077", spark.sparkContext._jsc

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context, Conf()

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(Session)
    assert shared_dir(spark)
