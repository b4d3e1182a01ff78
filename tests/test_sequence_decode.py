import numpy as np
import pytest

from loomwave.operators import decoding


def test_a_nearly_singular_recording_is_decoded(spark):
    """Three states with their squares next to ones: the system in raw units has no pivot."""
    v, n = [97.24, 27.95, 39.45, 40.0, 90.0, 30.0], [1.0, 2.0, 0.0, 1.0, 2.0, 1.0]
    df = spark.createDataFrame([(1, i, n[i], 0.0, v[i]) for i in range(6)], "k long, t long, a double, b double, v double")
    got = {r["t"]: r["v_hat"] for r in decoding.sequence_decode(df, ["k"], "t", ["a", "b"], ["v"], lambda: decoding.GridBayes(12), 0.5).collect()}
    assert sorted(got) == [3, 4, 5] and got[3] == 40.0 and all(27.9 < x < 97.3 for x in got.values())


def test_tuning_curves_are_no_worse_than_a_constant_rate():
    rng = np.random.default_rng(3)
    for _ in range(300):
        at = np.r_[0, 11, rng.integers(0, 12, 11)]
        y, x = (20 + 5.0 * at)[:, None], (rng.random((13, 1)) < 0.2).astype(float)
        x[rng.integers(13)] += 2
        rate = decoding.GridBayes(12).fit(x, y).rates[at, 0]
        fitted, constant = (x[:, 0] * np.log(rate) - rate).sum(), (x[:, 0] * np.log(x.mean()) - x.mean()).sum()
        assert fitted > constant - 1e-3


@pytest.mark.parametrize("model", [lambda: decoding.GridBayes(6), lambda: decoding.Kalman()])
@pytest.mark.parametrize("targets", [["u"], ["u", "v"]])
def test_recordings_together_as_alone(spark, model, targets):
    rng = np.random.default_rng(5)
    lengths = {None: 9, "a": 3, "b": 4, "c": 9, "d": 70, "e": 9, "f": 12, "g": 5}
    data = {k: (rng.poisson(3, (n, 2)).astype(float), rng.standard_normal((n, 2)).cumsum(0)) for k, n in lengths.items()}
    data["f"][1][:] = 2.0  # constant
    rows = [(k, int(i), *map(float, x[i]), *map(float, y[i])) for k, (x, y) in data.items() for i in rng.permutation(len(x))]
    df = spark.createDataFrame(rows, "k string, i int, p double, q double, u double, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # recordings go over several batches
    try:
        got = {(r["k"], r["i"]): [r[f"{t}_hat"] for t in targets] for r in decoding.sequence_decode(df, ["k"], "i", ["p", "q"], targets, model, 0.5, 15).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, (x, y) in data.items():
        n, y = max(2, len(x) // 2), y[:, : len(targets)]
        if len(x) >= 4 and k != "f":
            for i, h in enumerate(model().fit(x[:n], y[:n]).predict(x[n:], y[n])):
                want[k, n + i] = h.tolist()
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
