"""Reshaping packed signals without leaving the row, and axes of long ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_slice(values: str, sfreq: float, t0: float, tmin: float, tmax: float) -> Column:
    """Samples with tmin <= t <= tmax, both ends included."""
    start = max(0, -int(-(tmin - t0) * sfreq // 1))
    stop = int((tmax - t0) * sfreq + 1e-9)
    return F.slice(F.col(values), start + 1, max(0, stop - start + 1))


def crop_pad(values: str, pad: int) -> Column:
    """Samples without `pad` at both ends."""
    return F.slice(F.col(values), pad + 1, F.greatest(F.size(values) - 2 * pad, F.lit(0)))


def resample_linear(values: str, new_size: Column) -> Column:
    """Linear interpolation to new_size samples; the end points stay."""
    n = F.size(values)

    def at(i: Column) -> Column:
        x = i * (n - 1) / F.greatest(new_size - 1, F.lit(1))
        low = F.floor(x).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, n - 1))
        return a + (b - a) * (x - low)

    return F.transform(F.sequence(F.lit(0), (new_size - 1).cast("int")), at)


def reflect_index(i: Column, n: Column) -> Column:
    """Index into n samples that go back and forth without repeating their ends."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    return (n - 1 - F.abs(n - 1 - F.pmod(i, period))).cast("int")


def reflect_pad(values: str, size: int) -> Column:
    """The signal continued by reflection at its end up to `size` samples."""
    n = F.size(values)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(size), n) - 1), lambda i: F.get(values, reflect_index(i, n)))


def stitch(first: str, second: str, overlap: int) -> Column:
    """Two signals joined with a linear cross-fade over their overlap."""
    a, b, k = F.col(first), F.col(second), overlap
    ramp = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(a, F.size(a) - k + i) * (1 - i / F.lit(max(k - 1, 1))) + F.get(b, i) * (i / F.lit(max(k - 1, 1))))
    return F.concat(F.slice(a, 1, F.size(a) - k), ramp, F.slice(b, k + 1, F.greatest(F.size(b) - k, F.lit(0))))


def stitch_all(signals: list[str], overlaps: list[int]) -> Column:
    """Several signals joined one after another; every cross-fade is kept. Signals must be longer than their overlaps."""
    total = F.lit(0)
    offsets = [F.lit(0)]
    for s, k in zip(signals, overlaps):
        total = total + F.size(s) - k
        offsets.append(total)
    size = total + F.size(signals[-1])

    def sample(i: Column) -> Column:
        out = F.lit(0.0)
        for j, s in enumerate(signals):
            p = i - offsets[j]
            w = F.lit(1.0)
            if j:
                k = max(overlaps[j - 1] - 1, 1)
                w = w * F.when(p < overlaps[j - 1], p / F.lit(k)).otherwise(1.0)
            if j < len(overlaps):
                k, left = max(overlaps[j] - 1, 1), F.size(s) - overlaps[j]
                w = w * F.when(p >= left, 1 - (p - left) / F.lit(k)).otherwise(1.0)
            out = out + F.when(p.between(0, F.size(s) - 1), F.get(s, p.cast("int")) * w).otherwise(0.0)
        return out

    return F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), sample)


def chop(values: str, width: int, offset: Column) -> Column:
    """Consecutive windows of `width` from an offset; one fewer than fit where the length divides evenly."""
    n = F.size(values)
    count = F.when(n % width == 0, F.floor(n / width) - 1).otherwise(F.floor(n / width)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, (offset + i * width + 1).cast("int"), width)))


def combine_axes(df: DataFrame, first: str, second: str, out: str, delimiter: str = "-") -> DataFrame:
    """Two label axes folded into one."""
    return df.withColumn(out, F.concat_ws(delimiter, F.col(first).cast("string"), F.col(second).cast("string"))).drop(first, second)


def common_tokens(labels: Column, delimiter: str = "-") -> Column:
    """Of an array of labels the tokens that all have, joined again."""
    split = F.transform(labels, lambda x: F.split(x, F.lit(f"\\Q{delimiter}\\E")))
    return F.array_join(F.aggregate(F.slice(split, 2, F.size(split)), split[0], F.array_intersect), delimiter)


def reshape_axis(df: DataFrame, row: str, column: str, columns: int, new_columns: int) -> DataFrame:
    """Row-major reshape of a long matrix: positions recomputed from the flat index."""
    flat = F.col(row).cast("long") * columns + F.col(column)
    return df.withColumn("_flat", flat).withColumn(row, F.floor(F.col("_flat") / new_columns)).withColumn(column, F.col("_flat") % new_columns).drop("_flat")


def to_grid(df: DataFrame, chan_map: DataFrame, channel: str, value: str, columns: list[int]) -> DataFrame:
    """Channels laid out on their grid: one row per grid row, null holes."""
    placed = chan_map.join(df.select(channel, value), channel, "left")
    return placed.groupBy("row").pivot("col", columns).agg(F.avg(value))


def box_mean(df: DataFrame, row: str, column: str, value: str, height: int, width: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean over a box around each cell of each key's grid, zeros beyond the border: each cell is sent to the boxes that hold it."""
    dr, dc = height // 2, width // 2
    shifts = F.array(*(F.struct(F.lit(i).alias("r"), F.lit(j).alias("c")) for i in range(-dr, height - dr) for j in range(-dc, width - dc)))
    sent = df.select(*keys, row, column, value, F.explode(shifts).alias("_s")).select(*keys, (F.col(row) + F.col("_s.r")).alias(row), (F.col(column) + F.col("_s.c")).alias(column), value)
    means = sent.groupBy(*keys, row, column).agg((F.sum(value) / (height * width)).alias("box_mean"))
    return df.select(*keys, row, column).join(means, [*keys, row, column])


def tiles(rows: int, columns: int, height: int, width: int, overlapping: bool) -> list[tuple[int, int]]:
    """Top left corners of all tiles of a grid."""
    return [(r, c) for r in range(0, rows - height + 1, 1 if overlapping else height) for c in range(0, columns - width + 1, 1 if overlapping else width)]
