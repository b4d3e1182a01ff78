"""Decoders of trials: cross-validated classification and regression.

Folds, repeats and windows become keys, and one group holds the trials of one fold of one window, which the
caller bounds through the window; the models are small numpy classes. For feature tables that outgrow a
task, `spark_classifier` and `spark_regressor` give the distributed estimators of pyspark.ml.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwave.operators import sampling, windows


class Pca:
    """Principal components up to a share of the variance (or a number of them)."""

    def __init__(self, keep: float = 0.8, centre: bool = True):
        self.keep, self.centre = keep, centre

    def fit(self, x: np.ndarray) -> Pca:
        self.mean = x.mean(0) if self.centre else np.zeros(x.shape[1])
        _, s, v = np.linalg.svd(x - self.mean, full_matrices=False)
        share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
        n = int(self.keep) if self.keep >= 1 else int(np.searchsorted(share, self.keep - 1e-12) + 1)
        self.components = v[: min(n, len(s))]
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components.T


class Discriminant:
    """Linear (shared covariance) or quadratic discriminant with empirical or uniform priors."""

    def __init__(self, quadratic: bool = False, uniform: bool = False, shrink: float = 1e-6):
        self.quadratic, self.uniform, self.shrink = quadratic, uniform, shrink

    def fit(self, x: np.ndarray, y: np.ndarray) -> Discriminant:
        self.classes = np.unique(y)
        groups = [x[y == c] for c in self.classes]
        self.means = np.array([g.mean(0) for g in groups])
        scatter = [(g - m).T @ (g - m) for g, m in zip(groups, self.means)]
        pooled = sum(scatter) / max(len(x) - len(groups), 1)
        each = [s / max(len(g) - 1, 1) for s, g in zip(scatter, groups)] if self.quadratic else [pooled] * len(groups)
        ridge = self.shrink * max(np.trace(pooled) / len(pooled), 1e-12) * np.eye(len(pooled))
        self.inverse = [np.linalg.inv(c + ridge) for c in each]
        self.log_det = [np.linalg.slogdet(c + ridge)[1] for c in each]
        share = np.array([len(g) for g in groups]) / len(x)
        self.prior = np.log(np.full(len(groups), 1 / len(groups)) if self.uniform else share)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        d = [np.einsum("ij,jk,ik->i", x - m, i, x - m) for m, i in zip(self.means, self.inverse)]
        return np.array([-(a + b) / 2 + p for a, b, p in zip(d, self.log_det, self.prior)]).T

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[np.argmax(self.scores(x), 1)]


class PcaDiscriminant:
    """Principal components, then a discriminant."""

    def __init__(self, keep: float = 0.8, quadratic: bool = False):
        self.pca, self.model = Pca(keep), Discriminant(quadratic)

    def fit(self, x: np.ndarray, y: np.ndarray) -> PcaDiscriminant:
        self.model.fit(self.pca.fit(x).transform(x), y)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.model.predict(self.pca.transform(x))


class GaussianBayes:
    """Naive Bayes with a normal per feature and class, uniform prior."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianBayes:
        self.classes = np.unique(y)
        self.mean = np.array([x[y == c].mean(0) for c in self.classes])
        self.var = np.array([x[y == c].var(0) for c in self.classes]) + 1e-9 * max(x.var(), 1e-12)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None] - self.mean[None]
        return self.classes[np.argmax(-(d**2 / self.var + np.log(self.var)).sum(2), 1)]


class Template:
    """Class means, compared by cosine."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Template:
        self.classes = np.unique(y)
        self.means = np.array([x[y == c].mean(0) for c in self.classes])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        m = self.means / np.maximum(np.linalg.norm(self.means, axis=1, keepdims=True), 1e-300)
        return self.classes[np.argmax(x @ m.T, 1)]


class KernelRidge:
    """One-against-all ridge on a Gaussian kernel: a margin classifier (or regressor) without a solver."""

    def __init__(self, gamma: float | None = None, c: float = 3.0, classify: bool = True):
        self.gamma, self.c, self.classify = gamma, c, classify

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
        return np.exp(-self.g * np.maximum(d, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> KernelRidge:
        self.g = self.gamma or 1 / (x.shape[1] * max(x.var(), 1e-12))
        self.x = x
        if self.classify:
            self.classes = np.unique(y)
            target = np.where(y[:, None] == self.classes[None], 1.0, -1.0)
        else:
            self.middle = y.mean(0)
            target = y - self.middle
        self.weights = np.linalg.solve(self._kernel(x, x) + np.eye(len(x)) / (2 * self.c), target)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = self._kernel(x, self.x) @ self.weights
        return self.classes[np.argmax(s, 1)] if self.classify else s + self.middle


class Wiener:
    """Least squares; degree > 1 adds a polynomial of the linear prediction per output."""

    def __init__(self, degree: int = 1):
        self.degree = degree

    def fit(self, x: np.ndarray, y: np.ndarray) -> Wiener:
        y = y.reshape(len(x), -1)
        self.w = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
        if self.degree > 1:
            line = np.c_[x, np.ones(len(x))] @ self.w
            self.poly = [np.polyfit(a, b, self.degree) for a, b in zip(line.T, y.T)]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        line = np.c_[x, np.ones(len(x))] @ self.w
        return np.array([np.polyval(p, v) for p, v in zip(self.poly, line.T)]).T if self.degree > 1 else line


class Kalman:
    """State transition and observation by least squares, then the usual filter from the first state."""

    def __init__(self, c: float = 1.0):
        self.c = c

    def fit(self, x: np.ndarray, y: np.ndarray) -> Kalman:
        a, b = y[:-1].T, y[1:].T
        self.a = b @ np.linalg.pinv(a)
        self.w = (b - self.a @ a) @ (b - self.a @ a).T / max(len(y) - 1, 1) / self.c
        self.h = x.T @ np.linalg.pinv(y.T)
        self.q = (x.T - self.h @ y.T) @ (x.T - self.h @ y.T).T / len(y) + 1e-9 * np.eye(x.shape[1])
        return self

    def predict(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        state, p, out = start.astype(float), np.zeros_like(self.w), [start]
        for z in x[1:]:
            state, p = self.a @ state, self.a @ p @ self.a.T + self.w
            gain = p @ self.h.T @ np.linalg.inv(self.h @ p @ self.h.T + self.q)
            state, p = state + gain @ (z - self.h @ state), (np.eye(len(p)) - gain @ self.h) @ p
            out.append(state)
        return np.array(out)


class GridBayes:
    """Poisson tuning curves over a grid of states, and a normal step from one state to the next.

    Arrays may have further axes in front: so many recordings of one length, each with its own model.
    """

    def __init__(self, cells: int = 20):
        self.cells = cells

    def together(self, states: int) -> int:
        """Recordings whose steps between cells are few enough to be held at once."""
        return max(1, 2**20 // self.cells ** (2 * states))

    def fit(self, x: np.ndarray, y: np.ndarray) -> GridBayes:
        lines = np.linspace(y.min(-2), y.max(-2), self.cells, axis=-1)
        places = np.meshgrid(*[np.arange(self.cells)] * y.shape[-1])
        self.grid = np.stack([lines[..., i, g.ravel()] for i, g in enumerate(places)], -1)
        middle, sd = y.mean(-2, keepdims=True), y.std(-2, keepdims=True)
        sd = np.where(sd == 0, 1, sd)  # states in units of their spread: raw squares next to ones may be a singular system

        def features(s: np.ndarray) -> np.ndarray:
            z = (s - middle) / sd
            return np.concatenate([np.ones_like(z[..., :1]), z, z**2], -1)[..., None, :, :]

        d, spikes = features(y), x.swapaxes(-1, -2)
        t = d.swapaxes(-1, -2)
        w = np.zeros((*spikes.shape[:-1], d.shape[-1]))
        w[..., 0] = np.log(np.maximum(spikes.mean(-1), 1e-6))
        for _ in range(25):
            line = np.clip((d @ w[..., None])[..., 0], -20, 20)
            mu = np.exp(line)
            gram = t @ (d * mu[..., None])
            ridge = 1e-6 + 1e-12 * np.trace(gram, axis1=-2, axis2=-1)
            step = np.linalg.solve(gram + ridge[..., None, None] * np.eye(w.shape[-1]), t @ (spikes - mu)[..., None])[..., 0]
            step *= 5 / np.maximum(np.abs(step).max(-1, keepdims=True), 5)
            likelihood = (spikes * line - mu).sum(-1)
            for _ in range(10):  # steps that would lower the likelihood are halved
                line = np.clip((d @ (w + step)[..., None])[..., 0], -20, 20)
                low = (spikes * line - np.exp(line)).sum(-1) < likelihood - 1e-9 * np.abs(likelihood)
                if not low.any():
                    break
                step[low] /= 2
            w = w + step
        self.rates = np.exp(np.clip((features(self.grid) @ w[..., None])[..., 0], -20, 20)).swapaxes(-1, -2)
        self.step = np.maximum(np.sqrt((np.diff(y, axis=-2) ** 2).sum(-1).mean(-1)), 1e-9)
        return self

    def predict(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        d = ((self.grid[..., :, None, :] - self.grid[..., None, :, :]) ** 2).sum(-1)
        wide = 2 * np.asarray(self.step)[..., None] ** 2
        move, log_rates, total = np.exp(-d / wide[..., None]), np.log(self.rates), self.rates.sum(-1)
        belief, out = None, [start]
        for i in range(1, x.shape[-2]):
            here = np.exp(-((self.grid - start[..., None, :]) ** 2).sum(-1) / wide) if belief is None else (move @ belief[..., None])[..., 0]
            log = np.log(here + 1e-300) + (log_rates @ x[..., i, :, None])[..., 0] - total
            belief = np.exp(log - log.max(-1, keepdims=True))
            belief /= belief.sum(-1, keepdims=True)
            out.append(np.take_along_axis(self.grid, np.argmax(belief, -1)[..., None, None], -2)[..., 0, :])
        return np.stack(out, -2)


def cross_validate(packed: DataFrame, trial: str, label: str, values: str, model: Callable[[], object], folds: int, repeats: int, seed: int, window: int | None = None, step: int = 1) -> DataFrame:
    """repeat, fold, window, y_true, y_pred, n: counts of each fold's predictions.

    Each trial is one packed row of features; with a window, features are cut into frames and each frame is decoded by
    itself. Folds are stratified and seeded. Trials with a missing sample get their label's mean in training and
    zero in testing. Labels too rare for a training part are never predicted. One group holds one fold's trials.
    """
    cut = packed.select(trial, label, F.posexplode(windows.window_frames(values, window, step) if window else F.array(values)).alias("window", "x"))
    dealt = sampling.kfold(packed.select(trial, label).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_l", F.concat_ws("\u0001", "repeat", label)), "_l", [sampling.hash_order(trial, "repeat", seed=seed), F.col(trial)], folds).select(trial, "repeat", F.col("fold").alias("_own"))
    joined = cut.join(dealt, trial).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).select("repeat", "window", "fold", "_own", label, "x")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([[np.nan if v is None else v for v in r] for r in pdf["x"]], float)
        y, test = pdf[label].to_numpy(), (pdf["_own"] == pdf["fold"]).to_numpy()
        for c in np.unique(y):
            rows = (y == c) & ~test
            if rows.any():
                fill = np.nan_to_num(np.nanmean(np.where(np.isnan(x[rows]).all(0), 0, x[rows]), axis=0))
                x[rows] = np.where(np.isnan(x[rows]), fill, x[rows])
        x = np.nan_to_num(x)
        if not test.any() or len(np.unique(y[~test])) < 2:
            return pd.DataFrame(columns=["repeat", "fold", "window", "y_true", "y_pred"])
        predicted = model().fit(x[~test], y[~test]).predict(x[test])
        n = int(test.sum())
        return pd.DataFrame({"repeat": pdf["repeat"][:n].to_numpy(), "fold": pdf["fold"][:n].to_numpy(), "window": pdf["window"][:n].to_numpy(), "y_true": y[test], "y_pred": predicted})

    kind = dict(packed.dtypes)[label]
    rows = joined.groupBy("repeat", "fold", "window").applyInPandas(run, f"repeat int, fold int, window int, y_true {kind}, y_pred {kind}")
    return rows.groupBy("repeat", "fold", "window", "y_true", "y_pred").agg(F.count("*").alias("n"))


def decode_by_moments(packed: DataFrame, trial: str, label: str, values: str, kind: str, folds: int, repeats: int, order: list) -> DataFrame:
    """repeat, fold, y_true, y_pred, n of cross-validated templates (cosine with the class means) or normal Bayes (kind: template, bayes).

    order deals the folds within each label and may use `repeat`. A fold's model comes from the moments of its
    complement: those of all trials of a class without the fold's, so each trial is read once a repeat, what is
    shuffled is one row per fold, class and feature, and no task holds the trials of a fold. Missing samples are skipped.
    """
    x = packed.select(trial, F.col(label).alias("y_true"), F.col(values).alias("x"))
    spread = x.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_l", F.concat_ws("\u0001", "repeat", "y_true"))
    dealt = sampling.kfold(spread, "_l", order, folds).drop("_l")
    moments = lambda df, *keys: df.groupBy(*keys, "y_true", "t").agg(F.count("v").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("q"))
    whole = moments(x.select("y_true", F.posexplode("x").alias("t", "v")), *[]).where("n > 0")
    part = moments(dealt.select("repeat", "fold", "y_true", F.posexplode("x").alias("t", "v")), "repeat", "fold").toDF("repeat", "fold", "y_true", "t", "n_f", "m_f", "q_f")
    grid = whole.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    both = grid.join(part, ["repeat", "fold", "y_true", "t"], "left").fillna(0, ["n_f", "m_f", "q_f"])
    n, n_f = F.col("n"), F.col("n_f")
    left = both.withColumn("k", n - n_f).where("k > 0").withColumn("mean", (F.col("m") * n - F.col("m_f") * n_f) / F.col("k"))
    var = F.greatest(F.col("q") - F.col("q_f") - (F.col("m_f") - F.col("mean")) ** 2 * n_f * F.col("k") / n, F.lit(0.0)) / F.col("k")
    cells = F.array_sort(F.collect_list(F.struct("t", "mean", var.alias("var"))))
    model = left.groupBy("repeat", "fold", F.col("y_true").alias("y_pred")).agg(cells.alias("model"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    if kind == "template":
        norm = F.sqrt(total(F.transform("model", lambda c: c["mean"] ** 2)))
        score = total(F.transform("model", lambda c: c["mean"] * F.get("x", c["t"]))) / F.nullif(norm, F.lit(0.0))
    else:
        floor = x.select(F.explode("x").alias("v")).agg((F.var_pop("v") * 1e-9 + 1e-21).alias("floor"))
        model = model.join(F.broadcast(floor)).withColumn("model", F.transform("model", lambda c: F.struct(c["t"].alias("t"), c["mean"].alias("mean"), (c["var"] + F.col("floor")).alias("var")))).drop("floor")
        score = -total(F.transform("model", lambda c: (F.get("x", c["t"]) - c["mean"]) ** 2 / c["var"] + F.log(c["var"])))
    scored = dealt.join(model, ["repeat", "fold"]).select("repeat", "fold", trial, "y_true", "y_pred", F.coalesce(score, F.lit(float("-inf"))).alias("score"))
    best = scored.groupBy("repeat", "fold", trial, "y_true").agg(F.max_by("y_pred", "score").alias("y_pred"))
    return best.groupBy("repeat", "fold", "y_true", "y_pred").agg(F.count("*").alias("n"))


def template_decode(long: DataFrame, trial: str, label: str, time: str, value: str) -> DataFrame:
    """trial, y_true, y_pred by the class mean of greatest cosine (all trials make the means); equal cosines take the least label.

    The means, classes x samples, are joined to the samples; trials are summed before they are shuffled.
    """
    means = long.groupBy(F.col(label).alias("y_pred"), time).agg(F.avg(value).alias("_m"))
    v, m = F.col(value), F.col("_m")
    scores = long.join(means, time).groupBy(trial, F.col(label).alias("y_true"), "y_pred").agg((F.sum(v * m) / F.sqrt(F.sum(v**2) * F.sum(m**2))).alias("_cosine"))
    best = scores.groupBy(trial, "y_true").agg(F.max(F.struct(F.round("_cosine", 9).alias("c"), (-F.col("y_pred")).alias("k"))).alias("b"))
    return best.select(trial, "y_true", (-F.col("b.k")).alias("y_pred"))


def best_parameter(losses: DataFrame, keys: list[str], parameter: str, loss: str) -> DataFrame:
    """Of each key the parameter of least loss (ties: the least parameter): keys, best, loss."""
    return losses.groupBy(*keys).agg(F.min(F.struct(loss, parameter)).alias("_b")).select(*keys, F.col("_b")[parameter].alias("best"), F.col("_b")[loss].alias("loss"))


def generalise_in_time(packed: DataFrame, trial: str, label: str, values: str, model: Callable[[], object], folds: int, seed: int, window: int, step: int) -> DataFrame:
    """train_window, test_window, accuracy, balanced: a model of one window tried on every other."""
    dealt = sampling.kfold(packed, label, [sampling.hash_order(trial, seed=seed), F.col(trial)], folds, "_own")
    frames = dealt.select(label, "_own", windows.window_frames(values, window, step).alias("frames"))
    keyed = frames.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("train_window", F.explode(F.sequence(F.lit(0), F.size("frames") - 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([[list(f) for f in r] for r in pdf["frames"]], float)
        y, test, w = pdf[label].to_numpy(), (pdf["_own"] == pdf["fold"]).to_numpy(), int(pdf["train_window"].iloc[0])
        fitted = model().fit(x[~test, w], y[~test])
        out = [(w, v, int(t), int(p)) for v in range(x.shape[1]) for t, p in zip(y[test], fitted.predict(x[test, v]))]
        return pd.DataFrame(out, columns=["train_window", "test_window", "y_true", "y_pred"])

    rows = keyed.groupBy("fold", "train_window").applyInPandas(run, "train_window int, test_window int, y_true long, y_pred long")
    per = rows.groupBy("train_window", "test_window", "y_true").agg(F.sum((F.col("y_true") == F.col("y_pred")).cast("long")).alias("right"), F.count("*").alias("n"))
    return per.groupBy("train_window", "test_window").agg((F.sum("right") / F.sum("n")).alias("accuracy"), F.avg(F.col("right") / F.col("n")).alias("balanced"))


def leave_one_channel_out(packed: DataFrame, trial: str, label: str, values: str, model: Callable[[], object], folds: int, seed: int) -> DataFrame:
    """channel, accuracy without it: the importance of each place of the packed rows. Each place is left out in its own group."""
    dealt = sampling.kfold(packed.select(trial, label, F.col(values).alias("x")), label, [sampling.hash_order(trial, seed=seed), F.col(trial)], folds, "_own")
    spread = dealt.select(label, "x", "_own", F.explode(F.sequence(F.lit(0), F.size("x") - 1)).alias("channel"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = int(pdf["channel"].iloc[0])
        x, y, own = np.delete(np.array(pdf["x"].tolist(), float), out, 1), pdf[label].to_numpy(), pdf["_own"].to_numpy()
        right = sum(int((model().fit(x[own != f], y[own != f]).predict(x[own == f]) == y[own == f]).sum()) for f in np.unique(own))
        return pd.DataFrame({"channel": [out], "accuracy": [right / len(y)]})

    return spread.groupBy("channel").applyInPandas(run, "channel int, accuracy double")


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Places of rows at which a key differs from the row before."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = pa.chunked_array([rows[k].combine_chunks()]).dictionary_encode("encode").chunk(0).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_recordings(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of whole recordings, of `least` rows or more where there are so many, from batches in order of their keys."""
    held, n, enough = [], 0, least
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= enough:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(_starts(rows, keys)[-1])
            if last:
                yield rows.slice(0, last)
            held, n = rows.slice(last).to_batches(), n - last
            enough = max(least, 2 * n)  # a recording longer than that is joined a few times only
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def sequence_decode(df: DataFrame, keys: list[str], order: str, features: list[str], targets: list[str], model: Callable[[], object], train: float, least: int = 1 << 16) -> DataFrame:
    """Kalman or grid decoding per recording: fitted on the first share `train` of its rows, predicted for the others, in order.

    The first of the others is where the decoder starts. A recording of fewer than four rows, or of constant states, has too
    little to fit and gives no row. Recordings pass sorted, `least` rows or more at once; a model with `together` takes those of
    one length in one call.
    """

    def decoded(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        """x and y: recordings x rows x columns."""
        if not hasattr(model(), "together"):
            return np.array([model().fit(a[:n], b[:n]).predict(a[n:], b[n]) for a, b in zip(x, y)])
        step = model().together(len(targets))
        cut = [slice(i, i + step) for i in range(0, len(x), step)]
        return np.concatenate([model().fit(x[c, :n], y[c, :n]).predict(x[c, n:], y[c, n]) for c in cut])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_recordings(batches, keys, least):
            x, y = (np.stack([rows[c].cast(pa.float64()).to_numpy() for c in cs], -1) for cs in (features, targets))
            starts = _starts(rows, keys)
            lengths = np.diff(np.r_[starts, rows.num_rows])
            for length in np.unique(lengths[lengths >= 4]):
                at, n = starts[lengths == length, None] + np.arange(length), max(2, int(length * train))
                at = at[np.ptp(y[at[:, :n]], axis=1).max(-1) != 0]
                if not len(at):
                    continue
                hat = decoded(x[at], y[at], n).reshape(-1, len(targets))
                out = rows.select([*keys, order]).take(pa.array(at[:, n:].ravel()))
                for i, t in enumerate(targets):
                    out = out.append_column(f"{t}_hat", pa.array(hat[:, i], pa.float64(), from_pandas=True))
                yield from out.to_batches()

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} {kinds[order]}", *(f"{t}_hat double" for t in targets)])
    placed = df.select(*keys, order, *features, *targets).repartition(*keys).sortWithinPartitions(*keys, F.col(order).asc_nulls_last())
    return placed.mapInArrow(run, schema)


def spark_classifier(kind: str, **parameters):
    """Distributed estimators for feature tables of any size: logistic, svm, bayes, boosting or network."""
    from pyspark.ml import classification as c

    many = lambda e: c.OneVsRest(classifier=e)
    return {"logistic": lambda: c.LogisticRegression(**parameters), "svm": lambda: many(c.LinearSVC(**parameters)), "bayes": lambda: c.NaiveBayes(modelType="gaussian", **parameters), "boosting": lambda: many(c.GBTClassifier(**parameters)), "network": lambda: c.MultilayerPerceptronClassifier(**parameters)}[kind]()


def spark_regressor(kind: str, **parameters):
    """Distributed estimators: linear, poisson or boosting."""
    from pyspark.ml import regression as r

    return {"linear": lambda: r.LinearRegression(**parameters), "poisson": lambda: r.GeneralizedLinearRegression(family="poisson", **parameters), "boosting": lambda: r.GBTRegressor(**parameters)}[kind]()
