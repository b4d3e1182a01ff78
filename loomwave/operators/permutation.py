"""Permutation tests and cluster correction of two groups of trials.

Tasks hold their trials as matrices and multiply them with the matrix of permutations, so that samples never meet
permutations as rows: what moves is one matrix of moments per task, group and block of permutations. Statistics
are functions of the moments of both groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Permutations whose moments travel together.
_BLOCK = 256
Moments = tuple[np.ndarray, np.ndarray, np.ndarray]


def _mean_var(moments: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, s, q = moments
    with np.errstate(all="ignore"):
        mean = s / n
        return n, mean, np.where(n > 1, np.maximum(q - n * mean**2, 0) / (n - 1), 0.0)


def mean_diff(a: Moments, b: Moments) -> np.ndarray:
    return _mean_var(a)[1] - _mean_var(b)[1]


def welch_t(a: Moments, b: Moments) -> np.ndarray:
    (n1, m1, v1), (n2, m2, v2) = _mean_var(a), _mean_var(b)
    with np.errstate(all="ignore"):
        return (m1 - m2) / np.sqrt(v1 / n1 + v2 / n2)


def student_t(a: Moments, b: Moments) -> np.ndarray:
    (n1, m1, v1), (n2, m2, v2) = _mean_var(a), _mean_var(b)
    with np.errstate(all="ignore"):
        return (m1 - m2) / np.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))


def one_way_f(a: Moments, b: Moments) -> np.ndarray:
    return student_t(a, b) ** 2


#: Statistics by name; any function of the moments (count, sum, sum of squares) of two groups may be given instead.
STATISTICS: dict[str, Callable[[Moments, Moments], np.ndarray]] = {"mean_diff": mean_diff, "welch_t": welch_t, "student_t": student_t, "f": one_way_f}


def assignments(trials: DataFrame, trial: str, first: Column, n_perm: int, order: Column) -> DataFrame:
    """perm, trial, first: who is in the first group under each permutation (-1: as observed).

    order is an expression over trial and perm; the group sizes stay. Trials are few against samples.
    """
    t = trials.withColumn("_first", first)
    size = t.agg(F.sum(F.col("_first").cast("long")).alias("_n"))
    spread = t.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    w = Window.partitionBy("perm").orderBy(order, trial)
    shuffled = spread.withColumn("_r", F.row_number().over(w)).join(F.broadcast(size)).select("perm", trial, (F.col("_r") <= F.col("_n")).alias("first"))
    return shuffled.unionByName(t.select(F.lit(-1).alias("perm"), trial, F.col("_first").alias("first")))


def null_statistics(packed: DataFrame, assigned: DataFrame, trial: str, keys: list[str], values: str, n_perm: int, stat: str | Callable[[Moments, Moments], np.ndarray] = "mean_diff") -> DataFrame:
    """keys, perm, index, stat of every permutation (-1: as observed) and sample of packed signals.

    Each trial is one row per key with an array of samples of one length per key; null and NaN samples are skipped, and
    an undefined statistic is null. Trials meet the list of permutations that put them in the first group, once; a
    task adds the moments of its trials for each key. Trials without an assignment are left out.
    """
    chosen = STATISTICS[stat] if isinstance(stat, str) else stat
    of_trial = assigned.groupBy(trial).agg(F.collect_list(F.when(F.col("first"), F.col("perm") + 1)).alias("_in"))
    rows = packed.select(*keys, F.col(trial), F.col(values).alias("_x")).where("_x is not null").join(of_trial, trial).select(*keys, "_x", "_in")
    kinds = [f for f in rows.schema.fields if f.name in keys]
    middle = T.StructType([*kinds, T.StructField("_block", T.IntegerType()), T.StructField("_sums", T.BinaryType())])
    names = [f.name for f in kinds]
    width = n_perm + 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types = None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(n).type for n in names]
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch[n].to_pylist() for n in names)) if names else [()] * batch.num_rows):
                groups.setdefault(key, []).append(i)
            signals, members = batch["_x"].to_pylist(), batch["_in"].to_pylist()
            for key, at in groups.items():
                x = np.array([signals[i] for i in at], float)
                m = np.zeros((len(at), width))
                for row, i in zip(m, at):
                    row[members[i]] = 1
                ok = np.isfinite(x)
                x = np.where(ok, x, 0)
                parts = (ok.astype(float), x, x * x)
                new = np.stack([np.concatenate([m.T @ p, p.sum(0, keepdims=True)]) for p in parts])
                sums[key] = sums[key] + new if key in sums else new
        for key, total in sums.items():
            for block in range(0, width, _BLOCK):
                part = np.concatenate([total[:, block : min(block + _BLOCK, width)], total[:, -1:]], axis=1)
                yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types)), pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=[*names, "_block", "_sums"])

    out = T.StructType([*kinds, T.StructField("perm", T.IntegerType()), T.StructField("index", T.LongType()), T.StructField("stat", T.DoubleType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(n).type for n in names] if batch.num_rows else types
            for key, sums in zip(zip(*(batch[n].to_pylist() for n in [*names, "_block"])), batch["_sums"].to_pylist()):
                part = np.frombuffer(sums)
                total[key] = total[key] + part if key in total else part
        for (*key, block), flat in total.items():
            count = min(_BLOCK, width - block)
            moments = flat.reshape(3, count + 1, -1)
            first, whole = moments[:, :-1], moments[:, -1:]
            with np.errstate(all="ignore"):
                value = chosen(tuple(first), tuple(whole - first))
            n = value.shape[1]
            perm = np.repeat(np.arange(block, block + count) - 1, n)
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(perm), t) for k, t in zip(key, types)), pa.array(perm, pa.int32()), pa.array(np.tile(np.arange(n), count), pa.int64()), pa.array(value.ravel(), pa.float64(), mask=~np.isfinite(value.ravel()))], names=[*names, "perm", "index", "stat"])

    return rows.mapInArrow(gather, middle).repartition(*names, "_block").mapInArrow(finish, out)


def permutation_p(stats: DataFrame, keys: list[str], tails: int = 1, digits: int = 9, value: str = "stat") -> DataFrame:
    """observed and p = (1 + permutations at least as far) / (1 + permutations) per key; tails: 1 above, -1 below, 2 in absolute size."""
    d = F.round(value, digits)
    obs = stats.where("perm < 0").select(*keys, d.alias("observed"))
    far = {1: d >= F.col("observed"), -1: d <= F.col("observed"), 2: F.abs(d) >= F.abs(F.col("observed"))}[tails]
    return stats.where("perm >= 0").join(obs, keys).groupBy(*keys).agg(F.first("observed").alias("observed"), ((1 + F.sum(far.cast("long"))) / (1 + F.count("*"))).alias("p"))


def active_samples(stats: DataFrame, keys: list[str], axes: list[str], p_thresh: float, tails: int = 1, digits: int = 9, value: str = "stat") -> DataFrame:
    """keys, perm, axes of the samples whose statistic ranks in the top p_thresh among all permutations and the observation."""
    d = F.round(value, digits)
    far = {1: d, -1: -d, 2: F.abs(d)}[tails]
    w = Window.partitionBy(*keys, *axes)
    rank = (F.row_number().over(w.orderBy(far, "perm")) - 1) / (F.count("*").over(w) - 1)
    return stats.withColumn("_on", rank > 1 - p_thresh).where("_on").select(*keys, "perm", *axes)


def neighbours(axes: list[str], ignored: tuple[str, ...] = ()) -> np.ndarray:
    """Steps between adjacent samples: one along an axis that is not ignored, either way."""
    steps = [np.eye(len(axes), dtype=int)[i] for i, a in enumerate(axes) if a not in ignored]
    return np.array([*steps, *(-s for s in steps)]).reshape(-1, len(axes))


def label_clusters(points: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A number for each point; points reached by steps share it."""
    at = {tuple(p): i for i, p in enumerate(points.tolist())}
    label = np.full(len(points), -1)
    for i in range(len(points)):
        if label[i] >= 0:
            continue
        label[i], stack = i, [i]
        while stack:
            here = points[stack.pop()]
            for step in steps:
                j = at.get(tuple((here + step).tolist()))
                if j is not None and label[j] < 0:
                    label[j] = i
                    stack.append(j)
    return label


def cluster_p(stats: DataFrame, axes: list[str], p_thresh: float, tails: int = 1, keys: list[str] = [], ignored: tuple[str, ...] = (), digits: int = 9, value: str = "stat") -> DataFrame:  # noqa: B006
    """Clusters of adjacent samples (over any number of axes, none along ignored ones) that are active as observed, each with
    its p against the largest cluster of every permutation: keys, {axis}_from, {axis}_to, size, p.

    Samples are active as in active_samples; background is no cluster; a permutation without active samples counts with
    size 0. One group holds the active samples of 64 permutations of one key, at most 64 grids of its axes.
    """
    on = active_samples(stats, keys, axes, p_thresh, tails, digits, value)
    flat = neighbours(axes, ignored)
    steps = np.concatenate([np.zeros((len(flat), 1), int), flat], axis=1)  # none from one permutation to another
    kinds = {f.name: f for f in on.schema.fields}
    schema = T.StructType([*(kinds[k] for k in keys), T.StructField("perm", T.IntegerType()), *(T.StructField(f"{a}_{e}", T.LongType()) for a in axes for e in ("from", "to")), T.StructField("size", T.LongType())])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        found = label_clusters(pdf[["perm", *axes]].to_numpy(np.int64), steps)
        groups = pdf.assign(_c=found).groupby("_c")
        out = pd.DataFrame({f"{a}_{e}": getattr(groups[a], {"from": "min", "to": "max"}[e])() for a in axes for e in ("from", "to")})
        out["size"], out["perm"] = groups.size(), groups["perm"].first()
        for c in keys:
            out[c] = [pdf[c].iloc[0]] * len(out)
        return out[schema.names]

    clusters = on.groupBy(*keys, F.floor(F.col("perm") / 64).alias("_b")).applyInPandas(label, schema)
    perms = stats.where("perm >= 0").select(*keys, "perm").distinct()
    largest = clusters.where("perm >= 0").groupBy(*keys, "perm").agg(F.max("size").alias("largest"))
    counts = perms.join(largest, [*keys, "perm"], "left").fillna(0, ["largest"]).groupBy(*keys, "largest").agg(F.count("*").alias("n"))
    observed = clusters.where("perm < 0").drop("perm")
    joined = observed.join(counts, keys) if keys else observed.join(F.broadcast(counts))
    beyond = F.sum(F.when(F.col("largest") >= F.col("size"), F.col("n")).otherwise(0)) / F.sum("n")
    return joined.groupBy(*observed.columns).agg(beyond.alias("p"))
