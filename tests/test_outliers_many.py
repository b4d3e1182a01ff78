import tracemalloc

import numpy as np

from loomwave.operators import alignment


def test_memory_grows_with_the_rows():
    x = np.random.default_rng(1).standard_normal((3000, 3))
    x[7] = 50
    tracemalloc.start()
    f = alignment.outlier_factor(x, 600)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and f.argmax() == 7  # all distances at once take 72 MB


def test_tasks_agree_with_one_process(spark, monkeypatch):
    x = np.random.default_rng(2).integers(0, 5, (300, 3)).astype(float)  # many ties
    assert np.array_equal(alignment.outlier_factor(x, 60, alignment.in_tasks(spark, 300)), alignment.outlier_factor(x, 60))
    df = spark.createDataFrame([(i, float(i % 17), float(i % 5)) for i in range(299)] + [(299, 90.0, 40.0)], "c long, a double, b double")
    alone = alignment.bad_channels(df, "c", ["a", "b"]).collect()
    monkeypatch.setattr(alignment, "_FEW", 10)
    assert alone == alignment.bad_channels(df, "c", ["a", "b"]).collect() and 299 in {r["c"] for r in alone}


def test_ties_take_the_first():
    x = np.array([[0.0], [1.0], [-1.0], [3.0]])  # the first is as far from the second as from the third
    nearest, density = [1, 0, 0, 1], np.array([1.0, 1.0, 1.0, 0.5])
    assert alignment.outlier_factor(x, 1).tolist() == (density[nearest] / density).tolist()


def test_channels_without_features_leave_the_others(spark):
    rows = [(i, float(i % 4)) for i in range(20)] + [(20, 99.0), (21, None), (None, 1.0)]
    got = {r["c"] for r in alignment.bad_channels(spark.createDataFrame(rows, "c long, a double"), "c", ["a"]).collect()}
    assert 20 in got and None not in got
    assert alignment.bad_channels(spark.createDataFrame([], "c long, a double"), "c", ["a"]).count() == 0


def test_threshold_rises_at_once_over_huge_factors(spark):
    ring = [(40 + i, (1 + i / 100) * np.cos(i * np.pi / 10).item(), (1 + i / 100) * np.sin(i * np.pi / 10).item()) for i in range(20)]
    rows = [(i, 0.0, 0.0) for i in range(40)] + ring  # equal channels are 1e10 times as dense
    got = alignment.bad_channels(spark.createDataFrame(rows, "c long, a double, b double"), "c", ["a", "b"]).collect()
    assert 0 < len(got) <= 12 and all(r["c"] >= 40 and r["factor"] > 1e6 for r in got)
