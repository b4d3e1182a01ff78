"""Joins of signals with events, labels and other sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwave.operators.sorted_scan import carried


def epoch(samples: DataFrame, events: DataFrame, on: list[str], time: str, onset: str, tmin: float, tmax: float) -> DataFrame:
    """Samples with t in [onset + tmin, onset + tmax] of each event: a range join as an equi-join on time buckets.

    Both times are numbers. Buckets are as wide as the window, so each event meets the samples of two or three
    buckets only; the join key (on, bucket) spreads a busy channel over time. `rel` is the time from the onset.
    """
    width = max(tmax - tmin, 1e-9)
    bucket = lambda c: F.floor(c / width).cast("long")
    e = events.withColumn("_b", F.explode(F.sequence(bucket(F.col(onset) + tmin), bucket(F.col(onset) + tmax))))
    s = samples.withColumn("_b", bucket(F.col(time)))
    joined = s.join(e, [*on, "_b"]).withColumn("rel", F.col(time) - F.col(onset))
    return joined.where(F.col("rel").between(tmin, tmax)).drop("_b")


def match_event_names(events: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """Events one of whose "/" parts, or whose whole name, is wanted; each wanted name must match something."""
    parts = F.array_union(F.split(name, "/"), F.array(F.col(name)))
    return events.where(F.arrays_overlap(parts, F.array(*map(F.lit, wanted))))


def as_of(left: DataFrame, right: DataFrame, on: list[str], time: str, value: str, out: str) -> DataFrame:
    """left with the value of the last right row (with a value) at or before its time.

    Both sides are sorted together over all partitions and scanned once: no range join, and a hot key is cut.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(*on, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    return carried(both, on, [time, "_side"], lasts={out: "_v"}).where("_side = 1").drop("_side", "_v")


def concatenate(sources: list[DataFrame], axis: str, other: list[str], mismatch: str = "shrink") -> DataFrame:
    """Sources one after another along `axis`, the other axes aligned by label: shrink keeps labels that all have,
    expand keeps every row, raise fails unless all have the same labels. Repeated labels of `axis` are prefixed by source.
    """
    if mismatch != "expand":
        for o in other:
            shared = reduce(lambda a, b: a.join(b, o, "left_semi"), (s.select(o).distinct() for s in sources))
            if mismatch == "raise":
                n = shared.count()
                if any(s.select(o).distinct().count() != n for s in sources):
                    raise ValueError(f"labels of {o} differ")
            sources = [s.join(shared, o, "left_semi") for s in sources]
    tagged = reduce(DataFrame.unionByName, (s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)))
    clash = tagged.select(axis, "_source").distinct().groupBy(axis).agg((F.count("*") > 1).alias("_clash"))
    name = F.when(F.col("_clash"), F.concat_ws("-", F.col("_source").cast("string"), axis)).otherwise(F.col(axis))
    return tagged.join(clash, axis).withColumn(axis, name).drop("_clash", "_source")


def complete(df: DataFrame, axes: list[str]) -> DataFrame:
    """Every combination of the axes' labels, null where there was no row; axes other than the first must be short."""
    grid = reduce(lambda a, b: a.crossJoin(b), (df.select(a).distinct() for a in axes))
    return grid.join(df, axes, "left")


def pool_repeats(df: DataFrame, token: str, source: str, order: Column, how: str = "min") -> DataFrame:
    """Rows ranked within (token, source); min keeps ranks that every source of the token has, max keeps all."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(token, source).orderBy(order)).cast("long"))
    if how == "max":
        return ranked
    counts = df.groupBy(token, source).agg(F.count("*").alias("_n")).groupBy(token).agg(F.min("_n").alias("_least"))
    return ranked.join(counts, token).where(F.col("rank") <= F.col("_least")).drop("_least")


def shared_labels(df: DataFrame, label: str, source: str) -> DataFrame:
    """Labels that every source has."""
    total = df.select(source).distinct().agg(F.count("*").alias("_all"))
    per = df.groupBy(label).agg(F.count_distinct(source).alias("_n"))
    return per.join(F.broadcast(total)).where("_n = _all").select(label)


def upsert_status(current: DataFrame, changes: DataFrame, key: str, status: str) -> DataFrame:
    """current with the statuses that changes (one row per key) bring, and new keys added."""
    new = changes.select(key, F.col(status).alias("_new"))
    return current.join(new, key, "full").withColumn(status, F.coalesce("_new", status)).drop("_new")


def concatenate_runs(df: DataFrame, keys: list[str], run: str, time: str, length: DataFrame) -> DataFrame:
    """Runs one after another: time shifted by the lengths (keys, run, length) of the runs before."""
    w = Window.partitionBy(*keys).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    offsets = length.withColumn("_off", F.coalesce(F.sum("length").over(w), F.lit(0.0))).drop("length")
    return df.join(offsets, [*keys, run]).withColumn("t_joined", F.col(time) + F.col("_off")).drop("_off")


def without(df: DataFrame, bad: DataFrame, on: str) -> DataFrame:
    """Rows whose `on` is not among the bad ones."""
    return df.join(bad.select(on), on, "left_anti")


def look_up(df: DataFrame, table: DataFrame, key: str, table_key: str, columns: list[str]) -> DataFrame:
    """df with columns of a lookup table of one row per key; rows without an entry go."""
    return df.join(table.select(F.col(table_key).alias("_key"), *columns), F.col(key) == F.col("_key")).drop("_key")


def each_with_each(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every row of a short list with every row of another, such as subjects and conditions."""
    return first.crossJoin(second)
