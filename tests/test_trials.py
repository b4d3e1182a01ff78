import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwave.operators import decoding, hooks, trials
from loomwave.sources import recordings


def test_wavelet_levels_join_again():
    x = np.random.default_rng(0).standard_normal((3, 64))
    parts = trials._wavelet_levels(x, 10)
    assert np.allclose(trials._wavelet_join(parts), x)
    assert np.allclose(sum((p**2).sum() for p in parts), (x**2).sum())
    odd = np.random.default_rng(0).standard_normal((2, 36))
    assert np.allclose(trials._wavelet_join(trials._wavelet_levels(odd, 10)), odd)


def test_local_regression_removes_what_is_shared(spark):
    rng = np.random.default_rng(1)
    common = rng.standard_normal(128)
    rows = [(0, c, (common + 0.01 * rng.standard_normal(128)).tolist()) for c in range(4)] + [(1, 0, common.tolist())]
    df = spark.createDataFrame(rows, "e int, ch int, values array<double>")
    got = {(r["e"], r["ch"]): r["values"] for r in trials.local_regression_reference(df, ["e"], "ch", "values", 3).collect()}
    assert max(np.std(got[0, c]) for c in range(4)) < 0.1 and np.allclose(got[1, 0], common)


def test_matching(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [float(i) for i in range(8)])], "k int, x array<double>")
    assert [r[0] for r in df.orderBy("k").select(trials.match_length("x", 5, F.lit(2))).collect()] == [[1, 2, 3, 2, 1], [2, 3, 4, 5, 6]]
    assert trials.match_count(df, "k", [F.col("k")], 5).count() == 5 and trials.match_count(df, "k", [F.col("k")], 1).count() == 1


def test_ridge_and_grid(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 3))
    y = x @ [1.0, -2.0, 0.5] + 4
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double")
    w = trials.ridge_from_moments(df, ["a", "b", "c"], "y", 0.0)
    assert [round(w[k], 6) for k in ("a", "b", "c", "intercept")] == [1.0, -2.0, 0.5, 4.0]
    labels = np.arange(60) % 2
    data = [(i, int(c), [float(c) * 4 + float(rng.standard_normal()), float(rng.standard_normal())]) for i, c in enumerate(labels)]
    packed = spark.createDataFrame(data, "t int, l int, values array<double>")
    got = {r["name"]: r for r in trials.grid_search(packed, "t", "l", "values", {"good": decoding.Discriminant, "bad": lambda: Constant()}, 3, 1).collect()}
    assert got["good"]["best"] and not got["bad"]["best"] and got["good"]["loss"] < 0.15
    assert trials.silhouette(packed, "values", "l") > 0.4


class Constant:
    def fit(self, x, y):
        self.y = y[0]
        return self

    def predict(self, x):
        return np.full(len(x), self.y)


def test_nested_and_adjusted(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "y", None)], "r string, c string, v double")
    tree = trials.to_nested(df.withColumn("g", F.lit(1)), ["g"], ["r", "c"], "v", "tree").collect()[0]["tree"]
    assert tree == {"a": {"x": 1.0}}
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "k int, p double")
    got = {r["k"]: r["p_adjusted"] for r in trials.adjust_p(p, "p", "k").collect()}
    assert got == {1: pytest.approx(0.04), 2: pytest.approx(0.04 * 4 / 3), 3: pytest.approx(0.04 * 4 / 3), 4: pytest.approx(0.5)}


def rhd(blocks, adc=False):
    text = lambda s: struct.pack("<I", 2 * len(s)) + s.encode("utf-16-le") if s else struct.pack("<I", 0xFFFFFFFF)
    channel = lambda name, kind, on: text(name) + text(name) + struct.pack("<hhhhhh", 0, 0, kind, on, 0, 0) + struct.pack("<4h2f", 0, 0, 0, 0, 0.0, 0.0)
    head = struct.pack("<Ihh", 0xC6912702, 2, 0) + struct.pack("<f", 20000.0) + struct.pack("<h6f", 0, *[0.0] * 6) + struct.pack("<h2f", 0, 0.0, 0.0)
    head += text("note") + text("") + text("") + struct.pack("<h", 0) + struct.pack("<h", 0) + text("REF") + struct.pack("<h", 1)
    head += text("Port A") + text("A") + struct.pack("<hhh", 1, 4 + adc, 2) + channel("A-000", 0, 1) + channel("A-001", 0, 1) + channel("A-002", 0, 0) + channel("DIN", 4, 1) + (channel("ANALOG", 3, 1) if adc else b"")
    body = b""
    for i in range(blocks):
        body += np.arange(i * 128, i * 128 + 128, dtype="<i4").tobytes() + np.full((2, 128), [[32768 + 10], [32768 - 10]], "<u2").tobytes() + (np.arange(0, 12800, 100, dtype="<u2").tobytes() if adc else b"") + np.arange(128, dtype="<u2").tobytes()
    return head + body


def test_rhd(spark, tmp_path):
    (tmp_path / "x.rhd").write_bytes(rhd(3))
    spark.dataSource.register(recordings.RhdRecording)
    rows = spark.read.format("rhd_recording").option("path", str(tmp_path / "x.rhd")).option("blocks", 2).load().collect()
    assert len(rows) == 6 and {(r["channel"], r["block"], r["timestamp"]) for r in rows} == {(c, b, b * 128) for c in ("A-000", "A-001") for b in range(3)}
    assert all(r["values"][5] == pytest.approx(1.95 if r["channel"] == "A-000" else -1.95) and len(r["values"]) == 128 and r["sfreq"] == 20000.0 for r in rows)


def test_rhd_signals_of_a_folder(spark, tmp_path):
    for name in ("a.rhd", "b.rhd"):
        (tmp_path / name).write_bytes(rhd(2, adc=True))
    (tmp_path / "other.txt").write_text("x")
    spark.dataSource.register(recordings.RhdRecording)
    load = lambda path, kind: spark.read.format("rhd_recording").option("path", path).option("signals", kind).load().collect()
    rows = load(f"file://{tmp_path}/*.rhd", "digital")
    assert len(rows) == 4 and len({r["path"] for r in rows}) == 2 and rows[0]["channel"] == "DIN" and rows[0]["values"][:4] == [0.0, 1.0, 0.0, 1.0]
    rows = load(str(tmp_path / "a.rhd"), "adc")
    assert [r["channel"] for r in rows] == ["ANALOG"] * 2 and rows[0]["values"][3] == pytest.approx(300 * 0.000050354)
    assert len(load(str(tmp_path / "a.rhd"), "amplifier")) == 4 and load(str(tmp_path / "a.rhd"), "auxiliary") == []
    with pytest.raises(Exception, match="RHD"):
        load(str(tmp_path / "other.txt"), "adc")


def test_open_events(spark, tmp_path):
    record = struct.pack("<qhBBBBH", 77, 3, 5, 100, 1, 2, 4)
    (tmp_path / "all.events").write_bytes(b"header.format = 'x';".ljust(1024) + record * 2 + b"cut")
    got = [tuple(r)[1:] for r in recordings.read_open_events(spark, str(tmp_path / "*.events")).collect()]
    assert got == [(77, 3, 5, 100, 1, 2, 4)] * 2


def test_load_conditions(spark, tmp_path):
    data = [("s1", "go", "stim/a", "c1", t, k, float(t + k)) for t in range(2) for k in range(2)] + [("s2", "stop", "b", "c1", 0, 0, 9.0)]
    spark.createDataFrame(data, "subject string, condition string, event string, channel string, t int, trial int, v double").write.partitionBy("subject", "condition").parquet(str(tmp_path / "power"))
    got = recordings.load_conditions(spark, str(tmp_path), "power", ["go"], average=True).collect()
    assert {(r["event"], r["t"]) for r in got} == {("a", 0), ("a", 1)} and got[0]["v"] is not None


def test_intervals_of_any_length(spark):
    rng = np.random.default_rng(5)
    intervals = [(i, int(k), float(a), float(a + n)) for i, (k, a, n) in enumerate(zip(rng.integers(0, 3, 60), rng.uniform(-50, 50, 60), [*rng.uniform(0, 9, 55), 1e6, 1e9, 1e12, 0, 40]))]
    samples = [(i, int(k), float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 200), rng.uniform(-60, 200, 200)))]
    i = spark.createDataFrame(intervals, "i long, k int, a double, b double")
    s = spark.createDataFrame(samples, "s long, k int, t double")
    got = {(r["s"], r["i"]) for r in trials.within_intervals(s, i, ["k"], "t", "a", "b", 1.0).collect()}
    assert got == {(x[0], y[0]) for x in samples for y in intervals if x[1] == y[1] and y[2] <= x[2] < y[3]}


def test_hooks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 5.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None, 2.0])], "trial long, v array<double>")
    got = {r["trial"]: r["s"] for r in hooks.sliding_scores(df, "v", "s", 2, lambda w: w.sum(-1)).collect()}
    assert got == {1: [6.0, 7.0], 2: None, 3: None, 4: None}
    model = decoding.Template().fit(np.eye(3), np.array([0, 1, 2]))
    hooks.save_model(spark, model, str(tmp_path / "m"))
    assert hooks.load_model(spark, str(tmp_path / "m")).predict(np.eye(3)).tolist() == [0, 1, 2]
    long = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, v double")
    assert sorted(str(r["v"]) for r in hooks.impute(long, ["k"], "v", "mean").collect()) == ["1.0", "1.0", "None"]
    assert {r["v"] for r in hooks.impute(long, ["k"], "v", lambda d, k, v: d.fillna(9, [v])).collect()} == {1.0, 9.0}
