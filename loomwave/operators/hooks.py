"""Places where a caller's own function enters: window scorers, imputers, reducers before a classifier, whole pipelines."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwave.operators import reshape, sampling, spectral, statistics
from loomwave.operators.decoding import Pca


def sliding_scores(packed: DataFrame, values: str, out: str, size: int, scorer: Callable[[np.ndarray], np.ndarray], step: int = 1) -> DataFrame:
    """packed with `out`: the scorer's number for every full window of each signal, in a narrow pass.

    The scorer takes windows (signals x windows x size) and gives signals x windows. The last full window is kept;
    signals shorter than a window, and signals with a missing sample, give null.
    """

    def kernel(x: np.ndarray) -> np.ndarray:
        if x.shape[-1] < size:
            return np.full((len(x), 0), np.nan)
        return np.asarray(scorer(np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[:, ::step]), float)

    scored = spectral.per_row(packed, values, out, kernel)
    return scored.withColumn(out, F.when(F.size(out) > 0, F.col(out)))


def _by_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return df.join(mean, keys).withColumn(value, F.coalesce(F.col(value), F.col("_m"))).drop("_m")


#: Ways to fill missing samples of long rows, by name; each takes the rows, the keys within which to look, and the value.
IMPUTERS: dict[str, Callable[[DataFrame, list[str], str], DataFrame]] = {
    "mean": _by_mean,
    "zero": lambda df, keys, value: df.fillna(0, [value]),
    "normal": lambda df, keys, value: sampling.fill_normal(df, keys, value, 7),
}


def impute(df: DataFrame, keys: list[str], value: str, how: str | Callable[[DataFrame, list[str], str], DataFrame]) -> DataFrame:
    """Missing samples filled by a named way or a caller's; where a key has no value at all, `mean` leaves null."""
    return (IMPUTERS[how] if isinstance(how, str) else how)(df, keys, value)


class Reduced:
    """A reducer (principal components unless given) before any classifier with fit and predict."""

    def __init__(self, model: Callable[[], object], reducer: Callable[[], object] = Pca):
        self.model, self.reducer = model(), reducer()

    def fit(self, x: np.ndarray, y: np.ndarray) -> Reduced:
        self.model.fit(self.reducer.fit(x).transform(x), y)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.model.predict(self.reducer.transform(x))


def save_model(spark: SparkSession, model: object, path: str) -> None:
    """Write a fitted model as one row, to any file system that Spark reads."""
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> object:
    """The model that save_model wrote. It is unpickled, so the path must be trusted."""
    return pickle.loads(spark.read.parquet(path).first()["model"])


def save_array(df: DataFrame, path: str, axes: list[str], value: str) -> None:
    """Write a labelled array: its cells, with the order of the axes as column order."""
    df.select(*axes, value).write.mode("overwrite").parquet(path)


def load_array(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], str]:
    """The cells, the axes in order, and the name of the value that save_array wrote."""
    df = spark.read.parquet(path)
    return df, df.columns[:-1], df.columns[-1]


def outliers_to_null(df: DataFrame, keys: list[str], trial: str, time: str, value: str, k: float, tmin: Column | float, tmax: Column | float) -> DataFrame:
    """df with the whole trial of a key null where its peak within [tmin, tmax] reaches k deviations over the key's mean there."""
    window = df.where(F.col(time).between(tmin, tmax))
    keep = statistics.keep_inliers(window, keys, trial, value, k).where("keep").select(*keys, trial, F.lit(True).alias("_keep"))
    return df.join(keep, [*keys, trial], "left").withColumn(value, F.when(F.col("_keep"), F.col(value))).drop("_keep")


def evoked_band(packed: DataFrame, trial: str, group: str, values: str, sfreq: float, band: tuple[float, float], pad: int, baseline: int) -> DataFrame:
    """The pipeline from signals to evoked band power: common reference within each group, envelope of the band, edges off,
    z-scores of each group's first `baseline` samples, mean and standard error over trials: group, t, mean, sem.

    Signals stay packed but for the reference's mean per group and sample, and the statistics.
    """
    rows = packed.select(trial, group, F.posexplode(values).alias("t", "v"))
    mean = rows.groupBy(group, "t").agg(F.avg("v").alias("_m")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "_m"))), lambda x: x["_m"]).alias("_mean"))
    referenced = packed.select(trial, group, values).join(mean, group).withColumn(values, F.zip_with(values, "_mean", lambda a, b: a - b)).drop("_mean")
    envelope = spectral.per_row(referenced, values, "_env", lambda x: spectral.band_envelope(x, sfreq, *band))
    cut = envelope.select(trial, group, F.posexplode(reshape.crop_pad("_env", pad)).alias("t", "v"))
    z = statistics.rescale(cut.where(F.col("t") >= baseline), cut.where(F.col("t") < baseline), [group], "v", ["zscore"])
    return statistics.dist(z, [group, "t"], "zscore")


def clean_signals(packed: DataFrame, values: str, sfreq: float, lines: list[float], windows: list[int]) -> DataFrame:
    """Line noise removed in several passes of falling or rising windows, one narrow pass over the rows."""

    def kernel(x: np.ndarray) -> np.ndarray:
        for size in windows:
            x = spectral.line_filter(x, sfreq, lines, size, 4)
        return x

    return spectral.per_row(packed, values, values, kernel)


def as_struct_column(df: DataFrame, keys: list[str], name: str, value: str, names: list[str], out: str) -> DataFrame:
    """Named matrices of a key as one struct column with a field for each name; missing ones are null."""
    wide = df.groupBy(*keys).pivot(name, names).agg(F.first(value))
    return wide.select(*keys, F.struct(*names).alias(out))


def batches_of(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """A caller's function on Arrow batches, for what no operator covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield kernel(batch)

    return df.mapInArrow(run, schema)
