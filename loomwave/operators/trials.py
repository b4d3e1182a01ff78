"""Trial-level operators: selection, matching, references, corrections and model search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwave.operators import decoding, reshape, statistics, windows
from loomwave.operators.sorted_scan import carried, global_rank


def keep_trials(long: DataFrame, channel: str, trial: str, time: str, value: str, threshold: float) -> DataFrame:
    """Rows of trials whose detrended peak is under `threshold` deviations of their channel (from 100 on: under ten times
    the threshold, in units of the signal)."""
    flat = statistics.detrend(long, [channel, trial], time, value, "_d")
    peak = flat.groupBy(channel, trial).agg(F.max(F.abs("_d")).alias("_peak"))
    if threshold >= 100:
        good = peak.where(F.col("_peak") < 10 * threshold)
    else:
        sd = flat.groupBy(channel).agg(F.stddev_samp("_d").alias("_sd"))
        good = peak.join(sd, channel).where(F.col("_peak") < threshold * F.col("_sd"))
    return long.join(good.select(channel, trial), [channel, trial], "left_semi")


def response_times(trials: DataFrame, go: str, response: str, rate: float, least: float) -> DataFrame:
    """trials with `rt` in seconds (zero without a response); those under `least` are dropped unless it is zero."""
    rt = F.coalesce((F.col(response) - F.col(go)) / rate, F.lit(0.0))
    return trials.withColumn("rt", rt).where(F.col("rt") >= least)


def split_by_sample(samples: DataFrame, onsets: DataFrame, index: str, onset: str, before: int, after: int) -> DataFrame:
    """Samples from onset - before up to, without, onset + after: an equi-join on blocks of the window's length."""
    width = max(before + after, 1)
    o = onsets.withColumn("_b", F.explode(F.sequence(F.floor((F.col(onset) - before) / width), F.floor((F.col(onset) + after - 1) / width))))
    joined = samples.withColumn("_b", F.floor(F.col(index) / width)).join(o, "_b")
    rel = F.col(index) - F.col(onset)
    return joined.where((rel >= -before) & (rel < after)).withColumn("rel", rel).drop("_b")


def within_intervals(samples: DataFrame, intervals: DataFrame, on: list[str], time: str, start: str, end: str, width: float) -> DataFrame:
    """Samples inside intervals of any length, start included and end not: an equi-join on buckets.

    `width` is the least bucket; longer intervals take buckets of twice the width until two hold them, so an
    interval is at most two rows however long, and a sample one row for each width in use (63 at most).
    """
    level = F.greatest(F.ceil(F.log2(F.greatest((F.col(end) - F.col(start)) / width, F.lit(1.0)))), F.lit(0)).cast("int")
    bucket = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(2.0), F.col("_level")))).cast("long")
    i = intervals.where(F.col(start) < F.col(end)).withColumn("_level", level).withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    used = intervals.where(F.col(start) < F.col(end)).agg(F.collect_set(level).alias("_levels"))
    joined = samples.join(F.broadcast(used)).withColumn("_level", F.explode("_levels")).withColumn("_b", bucket(time)).drop("_levels").join(i, [*on, "_level", "_b"])
    return joined.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_b", "_level")


def tile_average(df: DataFrame, row: str, column: str, value: str, height: int, width: int, keys: list[str]) -> DataFrame:
    """Mean over tiles of the grid that do not overlap."""
    return df.groupBy(*keys, F.floor(F.col(row) / height).alias("tile_row"), F.floor(F.col(column) / width).alias("tile_col")).agg(F.avg(value).alias("mean"))


def regress_reference(long: DataFrame, epoch: list[str], channel: str, time: str, value: str) -> DataFrame:
    """long with `referenced`: each channel without its least-squares share of the mean over channels."""
    mean = long.groupBy(*epoch, time).agg(F.avg(value).alias("_m"))
    both = long.join(mean, [*epoch, time])
    gain = both.groupBy(*epoch, channel).agg((F.sum(F.col(value) * F.col("_m")) / F.nullif(F.sum(F.col("_m") ** 2), F.lit(0.0))).alias("_g"))
    return both.join(gain, [*epoch, channel]).withColumn("referenced", F.col(value) - F.coalesce("_g", F.lit(0.0)) * F.col("_m")).drop("_m", "_g")


#: Low-pass taps of the Daubechies wavelet of two vanishing moments (fixed values, from its closed form).
_DB2 = np.array([1 + np.sqrt(3), 3 + np.sqrt(3), 3 - np.sqrt(3), 1 - np.sqrt(3)]) / (4 * np.sqrt(2))


def _wavelet_levels(x: np.ndarray, levels: int) -> list[np.ndarray]:
    high = _DB2[::-1] * np.array([1, -1, 1, -1])
    out = []
    for _ in range(levels):
        n = x.shape[-1]
        if n < 4 or n % 2:
            break
        at = (np.arange(0, n, 2)[:, None] + np.arange(4)) % n
        out.append(x[..., at] @ high)
        x = x[..., at] @ _DB2
    return [*out, x]


def _wavelet_join(parts: list[np.ndarray]) -> np.ndarray:
    high = _DB2[::-1] * np.array([1, -1, 1, -1])
    x = parts[-1]
    for d in reversed(parts[:-1]):
        n = 2 * x.shape[-1]
        y = np.zeros((*x.shape[:-1], n))
        at = np.arange(0, n, 2)
        for k in range(4):
            y[..., (at + k) % n] += x * _DB2[k] + d * high[k]
        x = y
    return x


def local_regression_reference(packed: DataFrame, epoch: list[str], channel: str, values: str, levels: int = 10) -> DataFrame:
    """Each channel without what the other channels of its epoch predict, wavelet level by wavelet level.

    One group holds the channels of one epoch; signals of an epoch have one length.
    """
    kinds = dict(packed.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf[values].tolist(), float)
        parts = _wavelet_levels(x, levels)
        clean = []
        for p in parts:
            q = np.empty_like(p)
            for i in range(len(p)):
                others = np.delete(p, i, 0).T
                q[i] = p[i] - others @ np.linalg.lstsq(others, p[i], rcond=None)[0] if others.shape[1] else p[i]
            clean.append(q)
        return pdf[[*epoch, channel]].assign(**{values: list(_wavelet_join(clean))})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*epoch, channel]), f"{values} array<double>"])
    return packed.select(*epoch, channel, values).groupBy(*epoch).applyInPandas(run, schema)


def match_length(values: str, size: int, offset: Column) -> Column:
    """Signals brought to one length: a shorter one is reflected at its end, a longer one is cut from an offset."""
    n = F.size(values)
    return F.when(n < size, reshape.reflect_pad(values, size)).otherwise(F.slice(values, (F.pmod(offset, n - size + 1) + 1).cast("int"), size))


def match_count(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """n rows: the first n in a random order or, where there are fewer, rows again and again (`copy` counts them).

    Meant for trials, which are few against samples.
    """
    total = df.count()
    copies = -(-n // max(total, 1))
    spread = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(copies - 1, 0))))).withColumns({f"_o{i}": o for i, o in enumerate(order)})
    names = [f"_o{i}" for i in range(len(order))]
    return global_rank(spread, ["copy", *names, key], "_r").where(F.col("_r") < n).drop("_r", *names)


def hamming_error(cm: DataFrame, codes: DataFrame) -> DataFrame:
    """Confusions weighted by how many features of their codes (label, code: array) differ; one row."""
    a, b = codes.toDF("y_true", "_a"), codes.toDF("y_pred", "_b")
    differ = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    return cm.join(a, "y_true").join(b, "y_pred").agg(F.sum(F.col("n") * differ).alias("error"), F.sum("n").alias("n"))


def adjust_p(df: DataFrame, p: str, tie: str, method: str = "fdr", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """df with `p_adjusted`: bonferroni, or fdr (the step-up procedure). Tests are aggregates, few against samples."""
    total = df.groupBy(*keys).agg(F.count(p).alias("_n"))
    counted = df.join(total, keys) if keys else df.join(F.broadcast(total))
    if method == "bonferroni":
        return counted.withColumn("p_adjusted", F.least(F.col(p) * F.col("_n"), F.lit(1.0))).drop("_n")
    ranked = carried(counted.withColumn("_one", F.lit(1).cast("long")), keys, [p, tie], sums={"_k": "_one"})
    scaled = ranked.withColumns({"_q": F.col(p) * F.col("_n") / F.col("_k"), "_down": -F.col("_k")})
    least = carried(scaled, keys, ["_down"], least={"_least": "_q"})  # from the largest p down
    return least.withColumn("p_adjusted", F.least(F.col("_least"), F.lit(1.0))).drop("_n", "_one", "_k", "_q", "_down", "_least")


def significant_runs(df: DataFrame, keys: list[str], order: str, p: str, threshold: float) -> DataFrame:
    """Runs of p under the threshold with their smallest p."""
    return windows.islands(df, keys, order, F.col(p) < threshold, F.min(p).alias("least_p"))


def pairwise_rank_sum(df: DataFrame, channel: str, label: str, value: str) -> DataFrame:
    """channel, first, second, z: the rank-sum statistic of each pair of classes, by midranks; no pairs of trials."""
    classes = df.select(label).distinct()
    pairs = classes.select(F.col(label).alias("first")).crossJoin(classes.select(F.col(label).alias("second"))).where("first < second")
    sides = pairs.select("first", "second", F.explode(F.array("first", "second")).alias(label))
    pool = df.where(F.col(value).isNotNull()).join(sides, label).select(channel, "first", "second", (F.col(label) == F.col("first")).alias("_one"), F.col(value).alias("_x"))
    ranked = statistics.midranks(pool, [channel, "first", "second"], "_x", "_rank")
    per = ranked.groupBy(channel, "first", "second").agg(F.sum(F.when(F.col("_one"), F.col("_rank"))).alias("r"), F.sum(F.col("_one").cast("double")).alias("n1"), F.sum((~F.col("_one")).cast("double")).alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    z = (F.col("r") - n1 * (n1 + n2 + 1) / 2) / F.nullif(F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12), F.lit(0.0))
    return per.select(channel, "first", "second", z.alias("z"))


def ridge_from_moments(df: DataFrame, features: list[str], target: str, penalty: float) -> dict[str, float]:
    """Ridge weights (and `intercept`) from one pass of sums; k*k numbers reach the driver for k features."""
    ok = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*features, target]))
    cols = [*features, target]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.where(ok).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).collect()[0]
    cov = np.zeros((len(cols), len(cols)))
    for i, (a, b) in enumerate(pairs):
        cov[cols.index(a), cols.index(b)] = cov[cols.index(b), cols.index(a)] = row[f"c{i}"] or 0.0
    k = len(features)
    w = np.linalg.solve(cov[:k, :k] + penalty / max(row["n"], 1) * np.eye(k), cov[:k, k])
    means = np.array([row[f"m{i}"] or 0.0 for i in range(len(cols))])
    return {**dict(zip(features, w.tolist())), "intercept": float(means[k] - w @ means[:k])}


def lag_model(df: DataFrame, keys: list[str], order: str, stimulus: str, response: str, lags: int, penalty: float) -> dict[str, float]:
    """A response as a weighted sum of a stimulus and its past: lag design, then ridge from moments."""
    design = windows.with_history(df, keys, order, stimulus, lags, 0)
    return ridge_from_moments(design, [*(f"lag_{i}" for i in range(lags, 0, -1)), "now"], response, penalty)


def grid_search(packed: DataFrame, trial: str, label: str, values: str, models: dict[str, Callable[[], object]], folds: int, seed: int) -> DataFrame:
    """name, loss of each model by cross-validation, and whether it is the best (ties: the first name)."""
    parts = [decoding.cross_validate(packed, trial, label, values, m, folds, 1, seed).agg((1 - F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("loss")).select(F.lit(n).alias("name"), "loss") for n, m in models.items()]
    losses = reduce(DataFrame.unionByName, parts)
    best = losses.agg(F.min(F.struct("loss", "name")).alias("b")).select(F.col("b.name").alias("_best"))
    return losses.join(F.broadcast(best)).select("name", "loss", (F.col("name") == F.col("_best")).alias("best"))


def decode_across_sources(sources: list[DataFrame], trial: str, label: str, values: str, target: int, model: Callable[[], object], folds: int, seed: int) -> DataFrame:
    """y_true, y_pred, n of the target source's trials, decoded by models of its other folds and of all other sources.

    Sources are packed rows in one aligned space. One group holds one fold with all training trials.
    """
    from loomwave.operators.sampling import hash_order, kfold

    own = kfold(sources[target].select(trial, label, values), label, [hash_order(trial, seed=seed), F.col(trial)], folds, "_own")
    other = [s.select(trial, label, values).withColumn("_own", F.lit(-1).cast("long")) for i, s in enumerate(sources) if i != target]
    rows = reduce(DataFrame.unionByName, [own, *other]).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    kind = dict(own.dtypes)[label]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(pdf[values].tolist(), float), pdf[label].to_numpy()
        test = (pdf["_own"] == pdf["fold"]).to_numpy()
        if not test.any():
            return pd.DataFrame(columns=["y_true", "y_pred"])
        return pd.DataFrame({"y_true": y[test], "y_pred": model().fit(x[~test], y[~test]).predict(x[test])})

    return statistics.confusion(rows.groupBy("fold").applyInPandas(run, f"y_true {kind}, y_pred {kind}"), "y_true", "y_pred")


def silhouette(df: DataFrame, features: str, label: str) -> float:
    """Mean silhouette (squared Euclidean) of classes, by per-class moments."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(array_to_vector(features).alias("features"), F.col(label).cast("int").alias("prediction"))
    return ClusteringEvaluator().evaluate(vectors)


def flatten_nested(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """A map of maps (as deep as there are names) as rows: one column per level and `value`."""
    out = df.withColumn("_v", F.col(column)).drop(column)
    for name in names:
        others = [c for c in out.columns if c != "_v"]
        out = out.select(*others, F.explode("_v").alias(name, "_v"))
    return out.withColumnRenamed("_v", "value")


def to_nested(df: DataFrame, group: list[str], keys: list[str], value: str, out: str) -> DataFrame:
    """Per group one map of maps over `keys`; null leaves, and levels with none left, are dropped."""
    now = df.where(F.col(value).isNotNull()).select(*group, *keys, F.col(value).alias("_v"))
    for i in range(len(keys), 0, -1):
        entry = F.map_from_entries(F.collect_list(F.struct(F.col(keys[i - 1]).alias("k"), F.col("_v").alias("v"))))
        now = now.groupBy(*group, *keys[: i - 1]).agg(entry.alias("_v"))
    return now.withColumnRenamed("_v", out)


def clip_scale(c: Column, low: float, high: float) -> Column:
    """Weights clipped to a range and brought to 0 .. 1."""
    return (F.least(F.greatest(c, F.lit(low)), F.lit(high)) - low) / (high - low)
