"""Group statistics as column expressions and aggregations with partial combine; nulls are skipped throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwave.operators.sorted_scan import carried


def dist(df: DataFrame, keys: list[str], value: str, mode: str = "sem", ddof: int = 0) -> DataFrame:
    """Mean and spread (`sem` or `std`) per key; null where the spread is undefined."""
    std = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value)
    spread = std / F.sqrt(F.count(value)) if mode == "sem" else std
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.when(F.count(value) > ddof, spread).alias(mode))


def mean_diff(first: Column, second: Column, value: str) -> Column:
    """Difference of the means of two groups; null if one is empty."""
    return F.avg(F.when(first, F.col(value))) - F.avg(F.when(second, F.col(value)))


def welch_t(first: Column, second: Column, value: str) -> Column:
    """Welch's t; a group of one has no variance; null where both spreads vanish or a group is empty."""
    a, b = F.when(first, F.col(value)), F.when(second, F.col(value))
    spread = F.coalesce(F.var_samp(a), F.lit(0.0)) / F.nullif(F.count(a), F.lit(0)) + F.coalesce(F.var_samp(b), F.lit(0.0)) / F.nullif(F.count(b), F.lit(0))
    return (F.avg(a) - F.avg(b)) / F.nullif(F.sqrt(spread), F.lit(0.0))


def midranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average rank of each value within its key: counts of distinct values, summed in order over range-sorted partitions."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = carried(counts, keys, [value], sums={"_upto": "_n"})
    return df.join(ranked.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out)), [*keys, value])


def brunner_munzel(df: DataFrame, group: str, first: object, second: object, value: str) -> DataFrame:
    """The Brunner-Munzel statistic of two groups, by midranks; one row."""
    pool = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("x"))
    ranked = midranks(midranks(pool, [], "x", "r"), ["g"], "x", "w")
    per = ranked.groupBy("g").agg(F.count("*").alias("n"), F.avg("r").alias("mr"), F.avg("w").alias("mw"), F.sum((F.col("r") - F.col("w")) ** 2).alias("s2"), F.sum(F.col("r") - F.col("w")).alias("s1"))
    s = (F.col("s2") - F.col("s1") ** 2 / F.col("n")) / (F.col("n") - 1)
    wide = per.withColumn("s", s).agg(*(F.max(F.when(F.col("g") == g, F.col(c))).alias(f"{c}{i}") for i, g in enumerate((first, second)) for c in ("n", "mr", "s")))
    n0, n1 = F.col("n0"), F.col("n1")
    return wide.select((n0 * n1 * (F.col("mr1") - F.col("mr0")) / ((n0 + n1) * F.sqrt(n0 * F.col("s0") + n1 * F.col("s1")))).alias("statistic"))


def confusion(df: DataFrame, true: str, predicted: str, labels: DataFrame | None = None) -> DataFrame:
    """Counts of each pair of true and predicted label; labels (one column `label`, a short list) fill in zeros."""
    counts = df.groupBy(F.col(true).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count("*").alias("n"))
    if labels is None:
        return counts
    grid = labels.select(F.col("label").alias("y_true")).crossJoin(labels.select(F.col("label").alias("y_pred")))
    return grid.join(counts, ["y_true", "y_pred"], "left").fillna(0, ["n"])


def normalise_confusion(cm: DataFrame, how: str, keys: list[str] = [], repeats: int = 1) -> DataFrame:  # noqa: B006
    """`share` of each cell: of its true row, of its predicted column, or of the number of repeats (how: true, pred, all)."""
    by = {"true": "y_true", "pred": "y_pred"}
    total = F.sum("n").over(Window.partitionBy(*keys, by[how])) if how in by else F.lit(repeats)
    return cm.withColumn("share", F.col("n") * 1.0 / F.nullif(total, F.lit(0)))


def fit_quality(df: DataFrame, keys: list[str], y: str, predicted: str) -> DataFrame:
    """r2 (1 - SSE / SST) and rho (Pearson) per key, in one pass."""
    a, b = F.col(y), F.col(predicted)
    sse, sst = F.sum((a - b) ** 2), F.var_pop(a) * F.count(a)
    return df.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg((1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"), F.corr(a, b).alias("rho"))


def bin_counts(df: DataFrame, keys: list[str], time: str, start: float, stop: float, width: float) -> DataFrame:
    """Events per key and bin of [start, stop]; bins without events are filled with zero, the last bin is closed at its end."""
    n = int(round((stop - start) / width))
    at = F.when(F.col(time) == start + n * width, n - 1).otherwise(F.floor((F.col(time) - start) / width))
    counts = df.where(F.col(time).between(start, start + n * width)).groupBy(*keys, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return grid.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])


def bin_means(df: DataFrame, keys: list[str], time: str, value: str, start: float, width: float) -> DataFrame:
    """Mean value per key and bin [edge, next edge); empty bins give no row."""
    return df.where(F.col(time) >= start).groupBy(*keys, F.floor((F.col(time) - start) / width).cast("long").alias("bin")).agg(F.avg(value).alias("mean"))


def rescale_modes(x: Column, mean: Column, std: Column) -> dict[str, Column]:
    """A sample against its baseline in every mode; std has ddof 1; undefined results are null.

    zlogratio divides by the deviation of the raw baseline.
    """
    zero = F.lit(0.0)
    ratio = x / F.nullif(mean, zero)
    log = F.when(ratio > 0, F.log10(ratio))
    return {"mean": x - mean, "ratio": ratio, "logratio": log, "percent": (x - mean) / F.nullif(mean, zero), "zscore": (x - mean) / F.nullif(std, zero), "zlogratio": log / F.nullif(std, zero)}


def rescale(active: DataFrame, baseline: DataFrame, on: list[str], value: str, modes: list[str]) -> DataFrame:
    """active with a column per mode, against the baseline's mean and deviation per `on`; one row per key is joined."""
    stats = baseline.groupBy(*on).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    every = rescale_modes(F.col(value), F.col("_m"), F.col("_s"))
    return active.join(stats, on).select(*active.columns, *(every[m].alias(m) for m in modes))


def tail_compare(diff: Column, observed: Column, tails: int) -> Column:
    """Strictly beyond the observed difference: 1 above, -1 below, 2 in absolute size."""
    return {1: diff > observed, -1: diff < observed, 2: F.abs(diff) > F.abs(observed)}[tails]


def proportion(df: DataFrame, value: str, keys: list[str], tie: str, out: str, tail: int = 1) -> DataFrame:
    """df with the share of the other values of the key that are smaller (tail 2: in absolute size; -1: larger).

    Places are running counts over range-sorted partitions; the keys' totals are joined, one row per key.
    """
    x = {1: F.col(value), 2: F.abs(F.col(value)), -1: -F.col(value)}[tail]
    placed = carried(df.withColumns({"_x": x, "_one": F.lit(1).cast("long")}), keys, ["_x", tie], sums={"_at": "_one"})
    total = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    return placed.join(total, keys).withColumn(out, (F.col("_at") - 1) / F.nullif(F.col("_all") - 1, F.lit(0))).drop("_x", "_one", "_at", "_all")


def detrend(df: DataFrame, keys: list[str], time: str, value: str, out: str) -> DataFrame:
    """value minus its line over time within each key; the lines are joined back, one row per key."""
    line = df.groupBy(*keys).agg(F.regr_slope(value, time).alias("_b"), F.regr_intercept(value, time).alias("_a"))
    return df.join(line, keys).withColumn(out, F.col(value) - (F.col("_a") + F.col("_b") * F.col(time))).drop("_a", "_b")


def keep_inliers(df: DataFrame, keys: list[str], trial: str, value: str, k: float, robust: bool = False) -> DataFrame:
    """Per key and trial its peak |value| and whether it is under k deviations over the centre of the key's values.

    robust takes the median and the median absolute deviation instead of mean and population deviation.
    """
    if robust:
        centre = df.groupBy(*keys).agg(F.median(value).alias("_c"))
        stats = df.join(centre, keys).groupBy(*keys).agg(F.max("_c").alias("_c"), F.median(F.abs(F.col(value) - F.col("_c"))).alias("_d"))
    else:
        stats = df.groupBy(*keys).agg(F.avg(value).alias("_c"), F.stddev_pop(value).alias("_d"))
    peaks = df.groupBy(*keys, trial).agg(F.max(F.abs(value)).alias("peak"))
    return peaks.join(stats, keys).select(*keys, trial, "peak", (F.col("peak") < F.col("_d") * k + F.col("_c")).alias("keep"))


def outlier_rounds(df: DataFrame, channel: str, value: str, sd: float, rounds: int) -> DataFrame:
    """Channels whose deviation of squares is over mean + sd deviations of all channels', removed round after round.

    channel, round. The signal is aggregated to one row per channel once; rounds run over those rows.
    """
    per = df.groupBy(channel).agg(F.stddev_pop(F.col(value) ** 2).alias("s")).select(channel, F.when(F.col("s") == 0, 1e-9).otherwise(F.col("s")).alias("s"))
    gone = per.select(channel, F.lit(None).cast("int").alias("round"), "s")
    for i in range(1, rounds + 1):
        left = F.when(F.col("round").isNull(), F.col("s"))
        limit = gone.agg((F.avg(left) + sd * F.stddev_pop(left)).alias("_limit"))
        gone = gone.join(F.broadcast(limit)).withColumn("round", F.when(F.col("round").isNull() & (F.col("s") > F.col("_limit")), i).otherwise(F.col("round"))).drop("_limit")
    return gone.where("round is not null").select(channel, F.col("round").cast("long").alias("round"))


def sum_squared(value: Column) -> Column:
    """Sum of squares; exact where the values are whole numbers."""
    return F.sum(value * value)


def minmax_scale(df: DataFrame, value: str, out: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """value brought to 0 .. 1 within each key (or over all rows); null where all values are equal."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = df.join(ends, keys) if keys else df.join(F.broadcast(ends))
    return joined.withColumn(out, (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")


def average_reference(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """value without the mean of its key (the channels of one moment); the means are joined back, one row per key."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return df.join(mean, keys).withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def accuracy(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """accuracy and n over all rows; null labels count as wrong."""
    return df.agg(F.avg(F.coalesce(F.col(true) == F.col(predicted), F.lit(False)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def moments_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of each key: the condition average."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"))
