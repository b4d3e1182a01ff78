"""Seeded sampling, imputation and cross-validation folds. Keys come from a hash, so runs repeat exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwave.operators.sorted_scan import carried, global_rank


def hash_order(*cols: str | Column, seed: int = 0) -> Column:
    """A repeatable random order."""
    return F.xxhash64(*cols, F.lit(seed))


def kfold(df: DataFrame, label: str, order: list[Column], folds: int, out: str = "fold") -> DataFrame:
    """Stratified folds 0 .. folds-1: rows dealt in order within each label, by running counts over range-sorted partitions."""
    by = {f"_o{i}": o for i, o in enumerate(order)}
    placed = carried(df.withColumns({**by, "_one": F.lit(1).cast("long"), "_label": F.col(label)}), ["_label"], list(by), sums={"_n": "_one"})
    return placed.withColumn(out, (F.col("_n") - 1) % folds).drop(*by, "_one", "_n", "_label")


def repeated_kfold(df: DataFrame, key: str, label: str, folds: int, repeats: int, seed: int, complete: Column, least: int, order: list[Column] | None = None) -> DataFrame:
    """repeat, fold per row, dealt by `order` (given key and `repeat`; else by a hash); a repeat counts only if each label has `least` complete rows in each fold's training part."""
    dealt = kfold(df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_l", F.concat_ws("\u0001", "repeat", label)), "_l", order or [hash_order(key, "repeat", seed=seed), F.col(key)], folds).drop("_l")
    full = dealt.groupBy("repeat", label, "fold").agg(F.sum(complete.cast("long")).alias("n"))
    w = Window.partitionBy("repeat", label)
    poor = full.withColumn("train", F.sum("n").over(w) - F.col("n")).where(F.col("train") < least).select("repeat").distinct()
    return dealt.join(poor, "repeat", "left_anti")


def pick_without_replacement(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """n rows of each key by a random order; -1 takes all."""
    if n < 0:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def mixup(df: DataFrame, key: str, label: str, index: str, value: str, order_first: list[Column], order_second: list[Column], weight: Column) -> DataFrame:
    """Trials with a missing sample become a mixture of two complete ones; the first donor has the same label.

    Donors are ranked by two orders and dealt round robin; the weight is folded to one half or more. Where a label
    has no complete trial the rows stay as they are; with one donor in all, it is used twice. Long rows in, long rows out.
    """
    whole = df.groupBy(key, label).agg((F.count(value) == F.count("*")).alias("_whole"))
    donors = whole.where("_whole")
    w_label = Window.partitionBy(label)
    first = donors.select(F.col(label), F.col(key).alias("_k1"), (F.row_number().over(w_label.orderBy(*order_first)) - 1).alias("_r1"), F.count("*").over(w_label).alias("_n1"))
    every = donors.select(F.col(key).alias("_k2"), *(o.alias(f"_o{i}") for i, o in enumerate(order_second)))
    all_ = global_rank(every, [f"_o{i}" for i in range(len(order_second))], "_r2").select("_k2", (F.col("_r2") + 1).alias("_r2"))
    n2 = donors.agg(F.count("*").alias("_n2"))
    needy = whole.where("not _whole").select(key, label, (F.row_number().over(w_label.orderBy(*order_first)) - 1).alias("_r"))
    plan = needy.join(first.select(label, "_n1").distinct(), label).withColumn("_r1", F.col("_r") % F.col("_n1"))
    plan = plan.join(first.drop("_n1"), [label, "_r1"]).join(F.broadcast(n2)).withColumn("_r2", (F.col("_r") + 1) % F.col("_n2") + 1).join(all_, "_r2")
    lam = F.greatest(weight, 1 - weight)
    a = df.select(F.col(key).alias("_k1"), F.col(index), F.col(value).alias("_v1"))
    b = df.select(F.col(key).alias("_k2"), F.col(index), F.col(value).alias("_v2"))
    mixed = plan.select(key, label, "_k1", "_k2", lam.alias("_lam")).join(a, "_k1").join(b, ["_k2", index])
    new = mixed.select(key, label, index, (F.col("_lam") * F.col("_v1") + (1 - F.col("_lam")) * F.col("_v2")).alias(value))
    return df.join(plan.select(key), key, "left_anti").select(key, label, index, value).unionByName(new)


def fill_normal(df: DataFrame, keys: list[str], value: str, seed: int) -> DataFrame:
    """Missing samples drawn from the normal distribution of their key's others."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(stats, keys).withColumn(value, F.coalesce(F.col(value), F.col("_m") + F.col("_s") * F.randn(seed))).drop("_m", "_s")


def shuffle_labels(df: DataFrame, key: str, label: str, first: list[Column], second: list[Column]) -> DataFrame:
    """Labels dealt out anew: rows ranked by one order take the labels ranked by another, a permutation of all of them.

    Ranks come from range-sorted partitions, so no task sorts all rows. The orders should end with the key.
    """
    ranked = lambda column, order: global_rank(df.select(column, *(o.alias(f"_o{i}") for i, o in enumerate(order))), [f"_o{i}" for i in range(len(order))], "_r").select(column, "_r")
    return ranked(key, first).join(ranked(label, second), "_r").select(key, label)
