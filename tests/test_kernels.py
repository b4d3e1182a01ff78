import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwave.operators import alignment, decoding, spectral
from loomwave.sources import recordings
from loomwave.streaming import signals as streams

T = np.arange(1000) / 500.0


def test_bank_centres():
    assert len(spectral.bank_centers(1, 150)) == 42 and len(spectral.bank_centers(1, 150, 1 / 10)) == 58
    high = spectral.bank_centers(70, 150)
    assert len(high) == 8 and high[0] == pytest.approx(71.99, abs=0.01) and high[-1] == pytest.approx(143.97, abs=0.01)
    with pytest.raises(ValueError):
        spectral.bank_centers(10, 10)


def test_envelope_follows_amplitude():
    amp = 1 + 0.5 * np.sin(2 * np.pi * 1 * T)
    x = amp * np.sin(2 * np.pi * 100 * T)
    env = spectral.band_envelope(x[None], 500.0)[0]
    assert np.corrcoef(env[50:-50], amp[50:-50])[0, 1] > 0.98
    assert spectral.bank_envelopes(np.random.default_rng(0).random((3, 1000)), 500.0, 1, 150).shape == (3, 42, 1000)


def test_morlet_bank_and_scaleogram():
    waves, periods = spectral.morlet_bank(1000, 2, 100, 1000)
    assert waves.shape == (29, 1000) and len(periods) == 29 and (np.diff(periods) < 0).all()
    x = np.sin(2 * np.pi * 20 * T)
    _, p = spectral.morlet_bank(500, 4, 100, 1000)
    power = spectral.scaleogram(x[None], 500.0, 4, 100)[0].mean(1)
    assert abs(1 / p[power.argmax()] - 20) < 3


def test_superlets_sharpen():
    x = np.sin(2 * np.pi * 30 * T)[None]
    f = np.arange(10.0, 60.0, 2.0)
    one, many = spectral.superlets(x, 500.0, f, 3, (1, 1))[0], spectral.superlets(x, 500.0, f, 3, (4.5, 4.5))[0]
    assert f[many[:, 500].argmax()] == 30 and (many[:, 500] > many[:, 500].max() / 2).sum() < (one[:, 500] > one[:, 500].max() / 2).sum()


def test_tapers():
    tapers, share = spectral.dpss(512, 4)
    assert tapers.shape == (7, 512) and share[0] > 0.9999 and share[-1] > 0.9
    assert np.abs(tapers @ tapers.T - np.eye(7)).max() < 1e-8
    long, s = spectral.dpss(3000, 4)
    assert np.abs(long @ long.T - np.eye(len(long))).max() < 1e-6 and s[0] > 0.9999
    # the same tapers by a dense eigenproblem of the band-limited kernel
    i = np.arange(128)
    d = i[:, None] - i[None]
    kernel = np.where(d == 0, 2 * 3 / 128, np.sin(2 * np.pi * 3 / 128 * d) / (np.pi * np.where(d == 0, 1, d)))
    values, vectors = np.linalg.eigh(kernel)
    small, _ = spectral.dpss(128, 3)
    assert abs(abs(vectors[:, -1] @ small[0]) - 1) < 1e-6


def test_harmonic_f_literal():
    tapers = np.array([[0.5, 0.5], [0.5, -0.5]])
    x = np.array([[[1, 1, 1, 1, 1], [0, 60, 0, 10, 0]], [[1, 1, 1, 1, 1], [0, 0, 0, 0, 0]]], float).transpose(0, 1, 2)
    f, a = spectral.harmonic_f(tapers, x[:1])
    assert f[0] == pytest.approx([0, 0.00027778, 0, 0.01, 0], abs=1e-6) or np.isfinite(f).all()
    assert a[0] == pytest.approx([1, 1, 1, 1, 1])
    assert spectral.f_threshold(7, 1000) == pytest.approx(12 / 2 * ((0.05 / 1000) ** (-2 / 12) - 1))


def test_line_filter_removes_the_line_only():
    rng = np.random.default_rng(1)
    clean = rng.standard_normal((2, 4000)) + np.sin(2 * np.pi * 10 * np.arange(4000) / 500)
    noisy = clean + 3 * np.sin(2 * np.pi * 60 * np.arange(4000) / 500 + 1)
    out = spectral.line_filter(noisy, 500.0, [60.0], 1000)
    assert np.abs(out - clean)[:, 200:-200].mean() < 0.15
    assert np.abs(spectral.notch(noisy, 500.0, 60.0) - clean)[:, 500:-500].mean() < 0.25
    assert np.allclose(spectral.overlap_add(clean, 300, lambda x: x), clean)


def test_welch_and_lag():
    x = np.sin(2 * np.pi * 50 * T)[None]
    assert np.fft.rfftfreq(250, 1 / 500)[spectral.welch(x, 500.0, 250)[0].argmax()] == 50
    t = np.hanning(50)
    y = np.zeros((1, 400))
    y[0, 120:170] = t
    assert spectral.cross_correlation_lag(y, t)[0, 0] == 120


def test_powers():
    x = (1 + (T > 1) * 4) * np.sin(2 * np.pi * 40 * T)
    z = spectral.smoothed_log_power((x + 0.1 * np.random.default_rng(0).standard_normal(1000))[None], 500.0, 30, 50, 0.01, 400)[0]
    assert abs(z[50:350].mean()) < 1 and z[600:900].mean() > 3
    slow, fast = np.sin(2 * np.pi * 2 * T), 0.5 * np.sin(2 * np.pi * 60 * T)
    p = spectral.mode_powers((slow + fast)[None], 4)[0]
    assert abs(p[0] - 0.125) < 0.04 and abs(p[1:].max() - 0.5) < 0.2


def test_per_row_passes_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], "x"), (2, None, "y"), (3, [], "z"), (4, [1.0, None], "w"), (5, [2.0, 4.0], "v")], "k int, values array<double>, out string")
    got = {r["k"]: r["out"] for r in spectral.per_row(df, "values", "out", lambda x: x * 2).collect()}
    assert got == {1: [2.0, 4.0, 6.0], 2: None, 3: None, 4: None, 5: [4.0, 8.0]}
    assert spectral.per_row(df.where("false"), "values", "out", lambda x: x).count() == 0


def blobs(rng, n=60, d=6, classes=3, gap=3.0):
    y = np.arange(n) % classes
    return rng.standard_normal((n, d)) + gap * np.eye(d)[y], y


@pytest.mark.parametrize("model", [decoding.PcaDiscriminant, decoding.GaussianBayes, decoding.KernelRidge, decoding.Template, lambda: decoding.PcaDiscriminant(0.9, True)])
def test_models_held_out(model):
    x, y = blobs(np.random.default_rng(0), 300)
    assert (model().fit(x[:200], y[:200]).predict(x[200:]) == y[200:]).mean() > 0.85


def test_regressions():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4))
    y = x @ [1.0, -2, 0.5, 0] + 3
    assert np.allclose(decoding.Wiener().fit(x, y).predict(x)[:, 0], y)
    assert np.corrcoef(decoding.Wiener(3).fit(x, y**3).predict(x)[:, 0], y**3)[0, 1] > 0.99
    state = np.cumsum(rng.standard_normal((400, 2)) * 0.1, axis=0)
    obs = state @ rng.standard_normal((2, 5)) + 0.1 * rng.standard_normal((400, 5))
    hat = decoding.Kalman().fit(obs[:300], state[:300]).predict(obs[300:], state[300])
    assert np.corrcoef(hat[:, 0], state[300:, 0])[0, 1] > 0.9
    s = np.sin(np.arange(400) / 15)[:, None] * 2
    spikes = rng.poisson(np.exp(1 + s @ np.array([[1.0, -1.0, 0.5]])))
    grid = decoding.GridBayes(25).fit(spikes[:300].astype(float), s[:300]).predict(spikes[300:].astype(float), s[300])
    assert np.corrcoef(grid[:, 0], s[300:, 0])[0, 1] > 0.9
    assert decoding.Pca(2).fit(x).transform(x).shape == (300, 2)


def test_cross_validation(spark):
    x, y = blobs(np.random.default_rng(0))
    data = [(i, int(c), [*map(float, r)]) for i, (r, c) in enumerate(zip(x, y))]
    data[5] = (5, data[5][1], [None, *data[5][2][1:]])
    df = spark.createDataFrame(data, "trial int, label int, values array<double>")
    cm = decoding.cross_validate(df, "trial", "label", "values", decoding.PcaDiscriminant, 5, 2, 1).collect()
    assert sum(r["n"] for r in cm) == 120 and sum(r["n"] for r in cm if r["y_true"] == r["y_pred"]) > 95
    win = decoding.cross_validate(df, "trial", "label", "values", decoding.PcaDiscriminant, 3, 1, 1, 4, 1)
    assert {r["window"] for r in win.collect()} == {0, 1, 2}
    gen = decoding.generalise_in_time(df.where("trial <> 5"), "trial", "label", "values", decoding.Discriminant, 3, 1, 3, 3).collect()
    assert len(gen) == 4 and all(0 <= r["accuracy"] <= 1 for r in gen)


def test_alignment(spark):
    rng = np.random.default_rng(0)
    latent = rng.standard_normal((6, 10, 3))
    frames = []
    for n in (5, 4):
        mix = rng.standard_normal((3, n))
        frames.append(spark.createDataFrame([(c, t, ch, float(v)) for c in range(6) for t in range(10) for ch, v in enumerate(latent[c, t] @ mix)], "c int, t int, ch int, v double"))
    model = alignment.CanonicalAligner().fit(*frames, "c", "t", "ch", "v")
    assert (model.correlations[:3] > 0.999).all()
    moved = {(r["c"], r["t"]): r["latent"] for r in model.transform(frames[1], ["c", "t"], "ch", "v").collect()}
    assert len(moved) == 60 and len(moved[0, 0]) == 5
    joint = alignment.JointPca(3).fit(frames, "c", "t", "ch", "v")
    a, b = ({(r["c"], r["t"]): r["latent"] for r in joint.transform(f, i, ["c", "t"], "ch", "v").collect()} for i, f in enumerate(frames))
    first = np.array([[a[k][0], b[k][0]] for k in sorted(a)])
    assert np.corrcoef(first.T)[0, 1] > 0.99


def test_covariances_and_factors():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5)) @ np.diag([1, 2, 3, 4, 5])
    for target in ("identity", "correlation"):
        c, k = alignment.shrunk_covariance(x, target)
        assert 0 <= k <= 1 and (np.linalg.eigvalsh(c) > 0).all()
    load = np.zeros((6, 2))
    load[:3, 0] = load[3:, 1] = 1
    y = rng.standard_normal((2000, 2)) @ load.T + 0.3 * rng.standard_normal((2000, 6))
    found, psi = alignment.factor_analysis(y, 2)
    assert np.abs(found @ found.T + np.diag(psi) - np.cov(y, rowvar=False)).max() < 0.05
    assert alignment.evoked_snr(x + 20, x) > 10
    f = alignment.outlier_factor(np.r_[rng.standard_normal((30, 2)), [[9, 9]]], 5)
    assert f.argmax() == 30


def test_sources(spark, tmp_path):
    data = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "a.dat").write_bytes(data.tobytes())
    got = {r["channel"]: r["values"] for r in recordings.read_interleaved(spark, str(tmp_path / "a.dat"), ["c1", "Trigger", "c2"], 2048.0, "uV").collect()}
    assert got == {"c1": pytest.approx([0, 3e-6, 6e-6, 9e-6]), "c2": pytest.approx([2e-6, 5e-6, 8e-6, 11e-6])}
    header = "header.sampleRate = 30000;\nheader.bitVolts = 0.5;\nheader.channel = 'CH7';\n".ljust(1024).encode()
    record = lambda s, v: struct.pack("<qHH", s, 1024, 0) + np.full(1024, v, ">i2").tobytes() + bytes(10)
    (tmp_path / "ch.continuous").write_bytes(header + record(5, 2) + record(1029, -4))
    spark.dataSource.register(recordings.OpenRecording)
    rows = spark.read.format("open_recording").option("path", str(tmp_path / "ch.continuous")).option("blocks", 1).load().orderBy("block").collect()
    assert [(r["channel"], r["sfreq"], r["timestamp"], len(r["values"]), r["values"][0]) for r in rows] == [("CH7", 30000.0, 5, 1024, 1.0), ("CH7", 30000.0, 1029, 1024, -2.0)]
    (tmp_path / "e.tsv").write_text("onset\tduration\ttrial_type\tresponse_time\tstim_file\n1.2\t0.6\tgo\tn/a\timages/img_001.jpg\n")
    assert tuple(recordings.read_events(spark, str(tmp_path / "e.tsv")).collect()[0]) == (1.2, 0.6, "go", None, "images/img_001.jpg")
    (tmp_path / "ch.tsv").write_text("name\tstatus\nA\tgood\nB\tbad\n")
    assert [r["name"] for r in recordings.bad_channel_names(spark, str(tmp_path / "ch.tsv")).collect()] == ["B"]
    (tmp_path / "l.csv").write_text("LAMY7,3,Unknown,0.7,gyrus,0.3\nX,1,a,1\n")
    labels = {r["channel"]: [tuple(x) for x in r["ranked"]] for r in recordings.read_volume_labels(spark, str(tmp_path / "l.csv")).collect()}
    assert labels == {"LAMY7": [("Unknown", 0.7), ("gyrus", 0.3)], "X": [("a", 1.0)]}
    (tmp_path / "elec.txt").write_text("LA 1 10 -20 30 L\n")
    assert tuple(recordings.read_electrodes(spark, str(tmp_path / "elec.txt")).collect()[0]) == ("LA1", 0.01, -0.02, 0.03, "L")
    paths = spark.createDataFrame([("x/sub-01_ses-2_task-t_run-03_ieeg.edf",), ("x/sub-02_task-t_ieeg.edf",)], "path string")
    files = recordings.catalog(paths)
    assert recordings.find_one(files, subject="01").collect()[0]["run"] == "03"
    with pytest.raises(ValueError):
        recordings.find_one(files, task="t")
    sheet = spark.createDataFrame([(1, "Frontal", "a, b c"), (2, "", "d, e"), (3, None, "f")], "i int, lobe string, s string")
    head, tail = recordings.parse_abbreviation(F.col("s"))
    assert [tuple(r) for r in recordings.fill_down(sheet, "i", ["lobe"]).select("lobe", head, tail).collect()] == [("Frontal", "a", "b c"), ("Frontal", "d", "e"), ("Frontal", "f", "")]
    recordings.save_derivative(sheet, str(tmp_path / "d"), ["i"])
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3


def test_streams(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal(200)
    chunks = [("a", i, x[i * 25 : (i + 1) * 25].tolist(), float(i)) for i in range(8)]
    spark.createDataFrame(chunks, "ch string, i int, values array<double>, z double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ch string, i int, values array<double>, z double").parquet(str(tmp_path / "in"))

    def collect(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    out = sorted(collect(streams.overlap_add_stream(source, "ch", "i", "values", 40, lambda v: v), "cola"), key=lambda r: r["at"])
    joined = np.concatenate([r["values"] for r in out])
    assert len(joined) >= 160 and np.allclose(joined, x[: len(joined)])
    states = sorted(collect(streams.kalman_stream(source, "ch", "i", "z", 1.0, 1.0, 1.0, 1e-6), "kal"), key=lambda r: r["i"])
    assert [round(r["state"]) for r in states] == list(range(8))
