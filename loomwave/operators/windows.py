"""Frames over ordered samples: sliding windows, lags, runs, islands and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwave.operators.sorted_scan import carried, global_rank


def islands(df: DataFrame, keys: list[str], order: str, flag: Column, *aggregates: Column) -> DataFrame:
    """Runs of consecutive rows with the flag: keys, run_start, run_end, length, and further aggregates of their rows.

    A run is known by how many rows without the flag stand before it, a running sum over range-sorted partitions.
    """
    marked = df.withColumn("_off", (~F.coalesce(flag, F.lit(False))).cast("long"))
    runs = carried(marked, keys, [order], sums={"_g": "_off"}).where("_off = 0")
    return runs.groupBy(*keys, "_g").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count("*").alias("length"), *aggregates).drop("_g")


def sliding(df: DataFrame, keys: list[str], order: str, size: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over each full window of `size` rows, kept at its first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    frame = w.rowsBetween(0, size - 1)
    out = df.select("*", F.count("*").over(frame).alias("_n"), *(a.over(frame).alias(n) for n, a in aggregates.items()))
    return out.where(F.col("_n") == size).drop("_n")


def window_frames(values: str, size: int, step: int = 1) -> Column:
    """All full frames of a packed signal, as an array of arrays, without leaving the row."""
    count = F.floor((F.size(values) - size) / step).cast("int")
    return F.when(count >= 0, F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(F.col(values), i * step + 1, size)))


def with_history(df: DataFrame, keys: list[str], order: str, value: str, before: int, after: int, current: bool = True) -> DataFrame:
    """Design columns lag_b .. lag_1, now, lead_1 .. lead_a; null beyond the edges."""
    w = Window.partitionBy(*keys).orderBy(order)
    cols = [F.lag(value, b).over(w).alias(f"lag_{b}") for b in range(before, 0, -1)]
    cols += [F.col(value).alias("now")] if current else []
    cols += [F.lead(value, a).over(w).alias(f"lead_{a}") for a in range(1, after + 1)]
    return df.select("*", *cols)


def running_block(df: DataFrame, keys: list[str], order: list[str], boundary: Column) -> DataFrame:
    """block: how many boundaries stand at or before each row."""
    return carried(df.withColumn("_edge", boundary.cast("long")), keys, order, sums={"block": "_edge"}).drop("_edge")


def crop_blocks(df: DataFrame, keys: list[str], time: str, boundary: Column, start_pad: float, end_pad: float) -> DataFrame:
    """Per block between boundaries the padded range of its events; a recording without boundary is one block."""
    blocks = running_block(df, keys, [time], boundary).where(~boundary)
    return blocks.groupBy(*keys, "block").agg(F.greatest(F.min(time) - start_pad, F.lit(0.0)).alias("t_from"), (F.max(time) + end_pad).alias("t_to"), F.count("*").alias("n_events"))


def unique_labels(df: DataFrame, label: str, order: str, out: str, delimiter: str = "-") -> DataFrame:
    """Repeated labels get -0, -1, ... in order; single ones stay. The labels' counts are joined, one row per label."""
    counted = carried(df.withColumn("_one", F.lit(1).cast("long")), [label], [order], sums={"_n": "_one"})
    several = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_all"))
    joined = counted.join(several, F.col(label).eqNullSafe(F.col("_label")))
    name = F.when(F.col("_all") > 1, F.concat_ws(delimiter, F.col(label), (F.col("_n") - 1).cast("string"))).otherwise(F.col(label))
    return joined.withColumn(out, name).drop("_one", "_n", "_label", "_all")


def overlaps_previous(df: DataFrame, keys: list[str], onset: str, duration: str, tie: str) -> DataFrame:
    """Whether the previous event still runs at each onset."""
    seen = carried(df.withColumn("_end", F.col(onset) + F.col(duration)), keys, [onset, tie], previous={"_before": "_end"})
    return seen.withColumn("overlaps", F.coalesce(F.col("_before") > F.col(onset), F.lit(False))).drop("_end", "_before")


def fill_condition(df: DataFrame, keys: list[str], order: list[str], is_condition: Column, label: str, out: str) -> DataFrame:
    """The last condition seen at or before each row."""
    return carried(df.withColumn("_named", F.when(is_condition, F.col(label))), keys, order, lasts={out: "_named"}).drop("_named")


def peaks(df: DataFrame, keys: list[str], order: str, value: str, height: float) -> DataFrame:
    """Local maxima of at least `height` (a plateau counts once, at its start)."""
    w = Window.partitionBy(*keys).orderBy(order)
    p, n = F.lag(value).over(w), F.lead(value).over(w)
    marked = df.withColumn("_peak", (F.col(value) >= height) & (p < F.col(value)) & (n <= F.col(value)))
    return marked.where("_peak").drop("_peak")


def dense_classes(df: DataFrame, label: str, out: str, part: int | None = None, delimiter: str = "-") -> DataFrame:
    """Numbers 0.. of the labels (or of one part of them) in sorted order; the distinct labels are ranked over all partitions, then joined."""
    name = F.split(label, F.lit(f"\\Q{delimiter}\\E"))[part] if part is not None else F.col(label)
    named = df.withColumn("_name", name)
    numbers = global_rank(named.select("_name").distinct(), ["_name"], out)
    return named.join(numbers, "_name").drop("_name")


def common_trials(df: DataFrame, channel: str, trial: str, value: str, least: int) -> DataFrame:
    """Rows of the first trials with a value of each channel that has at least max(the fewest, `least`) of them."""
    n = F.count(F.when(F.col(value).isNotNull(), 1)).over(Window.partitionBy(channel))
    counted = df.withColumn("_n", n)
    fewest = df.groupBy(channel).agg(F.count(value).alias("_n")).agg(F.greatest(F.min("_n"), F.lit(least)).alias("_need"))
    w = Window.partitionBy(channel).orderBy(F.col(value).isNull(), trial)
    ranked = counted.withColumn("_rank", F.row_number().over(w)).join(F.broadcast(fewest))
    return ranked.where("_n >= _need and _rank <= _need").select(*df.columns, F.col("_rank").cast("long").alias("rank"))


def drop_rare(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows whose label occurs at least `least` times."""
    frequent = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(frequent, label, "left_semi")


def elbow(df: DataFrame, order: str, value: str) -> DataFrame:
    """The row farthest from the chord between the first and the last point of a curve; one row."""
    ends = df.agg(F.min(F.struct(order, value)).alias("a"), F.max(F.struct(order, value)).alias("b"))
    dx, dy = F.col(f"b.{order}") - F.col(f"a.{order}"), F.col(f"b.{value}") - F.col(f"a.{value}")
    off = F.abs(dy * (F.col(order) - F.col(f"a.{order}")) - dx * (F.col(value) - F.col(f"a.{value}"))) / F.sqrt(dx * dx + dy * dy)
    far = df.join(F.broadcast(ends)).select(order, F.round(off, 9).alias("distance"))
    return far.agg(F.max(F.struct("distance", (-F.col(order)).alias("o"))).alias("m")).select((-F.col("m.o")).alias(order), F.col("m.distance").alias("distance"))


def moving_mean(df: DataFrame, keys: list[str], order: str, value: str, before: int, out: str) -> DataFrame:
    """Mean of each row and up to `before` rows before it within its key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, 0)
    return df.withColumn(out, F.avg(value).over(w))


def first_of_key(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each key with their rank; Spark keeps n rows of a key per task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= n)
