"""The canonical signal model: packed rows (one array of samples per trial and channel) and long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """Missing samples are null inside the engine."""
    return F.when(~F.isnan(c), c)


def unpack(df: DataFrame, values: str, index: str = "t", value: str = "v") -> DataFrame:
    """Packed to long: one row per sample, NaN as null; rows with a null array give none."""
    other = [c for c in df.columns if c != values]
    return df.select(*other, F.posexplode(values).alias(index, value)).withColumn(value, nan_to_null(F.col(value).cast("double")))


def pack(df: DataFrame, keys: list[str], index: str = "t", value: str = "v", out: str = "values") -> DataFrame:
    """Long to packed: samples in order of their index; one shuffle on the keys."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index), F.col(value))))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda x: x[value]).alias(out))


def drop_empty_labels(df: DataFrame, axes: list[str], value: str = "v") -> DataFrame:
    """Drop every label of an axis whose whole slice is null; all axes are judged on the original rows."""
    out = df
    for axis in axes:
        full = df.groupBy(axis).agg(F.count(value).alias("_n")).where("_n > 0").select(axis)
        out = out.join(full, axis, "left_semi")
    return out


def reduce_axes(df: DataFrame, keep: list[str], value: str = "v", mode: str = "group") -> DataFrame:
    """Mean, deviation, count and sum of squares over all axes but `keep`; mode: group, rollup or cube."""
    grouped = {"group": df.groupBy, "rollup": df.rollup, "cube": df.cube}[mode](*keep)
    v = F.col(value)
    return grouped.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"), F.sum(v * v).alias("sumsq"))


def select_label(df: DataFrame, axis: str, label: str, delimiter: str = "-") -> DataFrame:
    """Rows whose label is `label`; where none is, rows of which one part of the label is."""
    whole = F.col(axis) == label
    exists = F.max(whole.cast("int"))
    flag = df.agg(F.coalesce(exists, F.lit(0)).alias("_whole"))
    part = F.array_contains(F.split(F.col(axis), F.lit(f"\\Q{delimiter}\\E")), label)
    return df.join(F.broadcast(flag)).where(F.when(F.col("_whole") == 1, whole).otherwise(part)).drop("_whole")
