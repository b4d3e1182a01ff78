"""Alignment of sources with different channels in one latent space.

Trials are averaged per condition in Spark (one shuffle, partial combine); what reaches a model is one matrix of
conditions x time by channels per source, whose size does not grow with the trials.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def condition_means(long: DataFrame, condition: str, time: str, channel: str, value: str) -> tuple[list[tuple], np.ndarray, list]:
    """Keys (condition, time), the matrix of mean values by channel (sorted), and the channels; missing cells are zero."""
    rows = long.groupBy(condition, time, channel).agg(F.avg(value).alias("_m")).collect()  # conditions x time x channels numbers
    keys = sorted({(r[condition], r[time]) for r in rows})
    channels = sorted({r[channel] for r in rows})
    at, col = {k: i for i, k in enumerate(keys)}, {c: i for i, c in enumerate(channels)}
    out = np.zeros((len(keys), len(channels)))
    for r in rows:
        out[at[r[condition], r[time]], col[r[channel]]] = r["_m"] or 0.0
    return keys, out, channels


def _pca_scores(x: np.ndarray, n: int) -> np.ndarray:
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return u[:, :n] * s[:n]


class JointPca:
    """A latent space shared by sources, from the principal components of their joined condition averages."""

    def __init__(self, n_components: int = 40):
        self.n_components = n_components

    def fit(self, sources: list[DataFrame], condition: str, time: str, channel: str, value: str) -> JointPca:
        means = [condition_means(s, condition, time, channel, value) for s in sources]
        shared = sorted(reduce(set.intersection, (set(k) for k, _, _ in means)))
        if not shared:
            raise ValueError("the sources share no condition")
        parts = [m[[k.index(s) for s in shared]] for k, m, _ in means]
        latent = _pca_scores(np.hstack(parts), self.n_components)
        self.channels = [c for _, _, c in means]
        self.transforms = [np.linalg.pinv(p) @ latent for p in parts]
        return self

    def transform(self, source: DataFrame, which: int, trial: list[str], channel: str, value: str) -> DataFrame:
        """trial columns and `latent`: each sample of a source in the shared space, by sums over its channels."""
        return project(source, dict(zip(self.channels[which], self.transforms[which].tolist())), trial, channel, value)


def project(long: DataFrame, weights: dict, keys: list[str], channel: str, value: str) -> DataFrame:
    """`latent` per key: the weighted sum over channels; weights are one short row per channel."""
    spark = long.sparkSession
    width = len(next(iter(weights.values())))
    table = spark.createDataFrame([(c, [float(x) for x in w]) for c, w in weights.items()], f"{channel} {dict(long.dtypes)[channel]}, _w array<double>")
    joined = long.join(F.broadcast(table), channel)
    sums = [F.sum(F.col(value) * F.col("_w")[i]).alias(f"_{i}") for i in range(width)]
    return joined.groupBy(*keys).agg(*sums).select(*keys, F.array(*(f"_{i}" for i in range(width))).alias("latent"))


def canonical_directions(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (columns) of two matrices of the same rows that make them most alike, and their correlations."""
    qa, ra = np.linalg.qr(a - a.mean(0))
    qb, rb = np.linalg.qr(b - b.mean(0))
    u, s, vt = np.linalg.svd(qa.T @ qb, full_matrices=False)
    return np.linalg.pinv(ra) @ u, np.linalg.pinv(rb) @ vt.T, np.clip(s, 0, 1)


class CanonicalAligner:
    """Brings source b into the space of source a (or both into a shared one) over their shared conditions."""

    def fit(self, a: DataFrame, b: DataFrame, condition: str, time: str, channel: str, value: str) -> CanonicalAligner:
        (ka, ma, self.a_channels), (kb, mb, self.b_channels) = (condition_means(s, condition, time, channel, value) for s in (a, b))
        shared = sorted(set(ka) & set(kb))
        if len(shared) < 2:
            raise ValueError("the sources share too few conditions")
        self.to_shared_a, self.to_shared_b, self.correlations = canonical_directions(ma[[ka.index(k) for k in shared]], mb[[kb.index(k) for k in shared]])
        self.b_to_a = self.to_shared_b @ np.linalg.pinv(self.to_shared_a)
        return self

    def transform(self, b: DataFrame, keys: list[str], channel: str, value: str, shared: bool = False) -> DataFrame:
        matrix = self.to_shared_b if shared else self.b_to_a
        return project(b, dict(zip(self.b_channels, matrix.tolist())), keys, channel, value)


def shared_trials(df: DataFrame, label: str, source: str, order) -> DataFrame:
    """Trials paired across sources: of each shared label as many as the source with fewest has, with their pair number."""
    from loomwave.operators.joins import pool_repeats, shared_labels

    both = df.join(shared_labels(df, label, source), label, "left_semi")
    return pool_repeats(both, label, source, order).withColumnRenamed("rank", "pair")


def shrunk_covariance(x: np.ndarray, target: str = "identity") -> tuple[np.ndarray, float]:
    """Ledoit-Wolf covariance and its shrinkage towards a scaled identity or constant correlation."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    if target == "identity":
        aim = np.eye(p) * np.trace(s) / p
    else:
        sd = np.sqrt(np.diag(s))
        r = s / np.outer(sd, sd)
        mean_r = (r.sum() - p) / max(p * (p - 1), 1)
        aim = mean_r * np.outer(sd, sd)
        np.fill_diagonal(aim, np.diag(s))
    pi = ((x**2).T @ x**2 / n - s**2).sum()
    gamma = ((s - aim) ** 2).sum()
    rho = 0.0
    if target != "identity":
        theta = (x**3).T @ x / n - np.diag(s)[:, None] * s
        np.fill_diagonal(theta, 0)
        rho = np.diag((x**2).T @ x**2 / n - s**2).sum() + mean_r * (np.outer(1 / sd, sd) * theta).sum()
    shrinkage = float(np.clip((pi - rho) / max(gamma, 1e-300) / n, 0, 1))
    return shrinkage * aim + (1 - shrinkage) * s, shrinkage


def mahalanobis(x: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Squared distance of rows to the noise mean in units of the noise covariance."""
    d = x - noise.mean(0)
    return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(np.cov(noise, rowvar=False)), d)


def evoked_snr(signal: np.ndarray, noise: np.ndarray) -> float:
    """10 log10 of the mean signal distance over the geometric mean noise distance."""
    return float(10 * np.log10(mahalanobis(signal, noise).mean() / np.exp(np.log(mahalanobis(noise, noise)).mean())))


def factor_analysis(x: np.ndarray, factors: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood loadings (varimax-rotated) and specific variances, by expectation-maximisation."""
    n, p = x.shape
    s = np.cov(x, rowvar=False, bias=True)
    values, vectors = np.linalg.eigh(s)
    load = vectors[:, ::-1][:, :factors] * np.sqrt(np.maximum(values[::-1][:factors], 1e-6))
    psi = np.maximum(np.diag(s) - (load**2).sum(1), 0.005)
    for _ in range(rounds):
        beta = np.linalg.solve(load @ load.T + np.diag(psi), load).T
        second = np.eye(factors) - beta @ load + beta @ s @ beta.T
        load = s @ beta.T @ np.linalg.inv(second)
        psi = np.maximum(np.diag(s - load @ beta @ s), 0.005)
    rotation = np.eye(factors)
    for _ in range(100):
        b = load @ rotation
        u, _, vt = np.linalg.svd(load.T @ (b**3 - b * (b**2).mean(0)))
        rotation = u @ vt
    return load @ rotation, psi


def _distances(x: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of rows and their distances to all: infinite where a feature is missing, -1 from a row to itself.

    The distances of a piece stay in a processor's cache and are overwritten by the next.
    """
    step = max(1, 2**16 // len(x))
    room = np.empty((2, step, len(x)))
    for i in range(0, len(rows), step):
        at = rows[i : i + step]
        d, e = room[:, : len(at)]
        d[:] = 0
        for c in x.T:
            np.subtract(c[at, None], c, out=e)
            e *= e
            d += e
        np.fmin(np.sqrt(d, out=d), np.inf, out=d)
        d[np.arange(len(at)), at] = -1
        yield at, d


def _kth_distance(x: np.ndarray, k: int, rows: np.ndarray) -> np.ndarray:
    out = []
    for _, d in _distances(x, rows):
        d.partition(k, axis=1)
        out.append(d[:, k].copy())
    return np.concatenate(out)


def _farthest_known(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The largest distance that is known, -1 where none is."""
    return np.concatenate([np.where(np.isinf(d), -1, d).max(1) for _, d in _distances(x, rows)])


def _near_mean(x: np.ndarray, k: int, kth: np.ndarray, within: np.ndarray | None, value: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """Mean over the k nearest others (of equally distant ones the first) of `value`; without one, of the distance, at least the other's `within`."""
    out = []
    for at, d in _distances(x, rows):
        near = d <= kth[at, None]
        near[np.arange(len(at)), at] = False
        number = near.sum(1)
        for i in np.flatnonzero(number > k):
            last = np.flatnonzero(d[i] == kth[at[i]])
            near[i, last[k - number[i] + len(last) :]] = False
        if value is not None:
            out.append(np.multiply(near, value, out=d).sum(1) / k)
            continue
        if np.isinf(kth[at]).any():
            d[np.isinf(d)] = -1
            near &= np.maximum(d, within, out=d) >= 0
            number = np.maximum(near.sum(1), 1)
        else:
            np.maximum(d, within, out=d)
            number = k
        np.copyto(d, 0, where=~near)  # may be infinite
        out.append(d.sum(1) / number)
    return np.concatenate(out)


def outlier_factor(x: np.ndarray, k: int, run: Callable | None = None) -> np.ndarray:
    """Local outlier factor of each row by its k nearest rows; of equally distant rows the first are the nearer.

    A row with a missing feature (NaN) is farther from all than any other; distances that are not known are left out of means.
    Distances are taken anew in each of three passes, a few rows at a time, so memory grows with the rows and not with
    their square. run(f, *shared) gives f(*shared, rows) for all rows in order (here by default; in tasks: `in_tasks`).
    """
    x = np.asfortranarray(x, float)
    if len(x) < 2:
        return np.full(len(x), np.nan)
    k, run = min(k, len(x) - 1), run or (lambda f, *shared: f(*shared, np.arange(len(x))))
    kth = run(_kth_distance, x, k)
    within = np.where(np.isinf(kth), run(_farthest_known, x), kth) if np.isinf(kth).any() else kth
    density = 1 / np.maximum(run(_near_mean, x, k, kth, within, None), 1e-10)
    return run(_near_mean, x, k, kth, None, density) / density


def in_tasks(spark: SparkSession, n: int) -> Callable:
    """run(f, *shared): f(*shared, rows) of n rows, one number a row, in tasks that share the arrays as a broadcast."""

    def run(f: Callable, *shared) -> np.ndarray:
        sent = spark.sparkContext.broadcast(shared)

        def part(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f(*sent.value, b.column(0).to_numpy()), pa.float64())], ["id", "y"])

        tasks = spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism))
        got = tasks.mapInArrow(part, "id long, y double").toArrow()
        sent.unpersist()
        out = np.empty(n)
        out[got["id"].to_numpy()] = got["y"].to_numpy()
        return out

    return run


#: Channels up to which distances of all pairs take less time than starting tasks.
_FEW = 4000


def bad_channels(packed: DataFrame, channel: str, features: list[str], threshold: float = 1.5) -> DataFrame:
    """channel, factor of channels that stand out among the others; the threshold rises by one while over a fifth do.

    One row of features per channel. The driver holds these rows and two numbers a channel; of more than a few thousand channels
    the distances are taken in tasks. Neighbours are a fifth of the channels, so the time grows with the square of their number.
    A null channel counts among the channels but is never a neighbour or a result; a channel without features is far from all.
    """
    spark = packed.sparkSession
    rows = packed.select(channel, *features).orderBy(channel).collect()
    x = np.array([[r[f] for f in features] for r in rows], float).reshape(len(rows), len(features))
    names = [r[channel] for r in rows if r[channel] is not None]
    out = []
    if len(names) > 1:
        known = ~np.isnan(x)
        mean = np.where(known, x, 0).sum(0) / np.maximum(known.sum(0), 1)
        std = np.sqrt(np.where(known, (x - mean) ** 2, 0).sum(0) / np.maximum(known.sum(0), 1))
        x = ((x - mean) / np.where(std == 0, 1, std))[len(rows) - len(names) :]  # a null channel is the first
        factor = outlier_factor(x, max(1, len(rows) // 5), in_tasks(spark, len(names)) if len(names) > _FEW else None)
        allowed = np.sort(factor)[::-1][int(0.2 * len(factor))]  # the largest factor that a threshold may leave out
        threshold += max(0, math.ceil(allowed - threshold))
        out = [(c, float(f)) for c, f in zip(names, factor) if f > threshold]
    return spark.createDataFrame(out, f"{channel} {dict(packed.dtypes)[channel]}, factor double")
