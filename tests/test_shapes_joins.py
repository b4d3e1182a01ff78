import pytest
from pyspark.sql import functions as F

from loomwave.functions import labels
from loomwave.operators import joins, reshape, sampling


def one(spark, column, *arrays):
    df = spark.createDataFrame([arrays], ", ".join(f"a{i} array<double>" for i in range(len(arrays))))
    return df.select(column.alias("x")).collect()[0]["x"]


def test_resample_pad_stitch_chop(spark):
    ten = [float(i) for i in range(10)]
    assert one(spark, reshape.resample_linear("a0", F.lit(5)), ten) == [0, 2.25, 4.5, 6.75, 9]
    assert one(spark, reshape.resample_linear("a0", F.lit(7)), ten) == pytest.approx([0, 1.5, 3, 4.5, 6, 7.5, 9])
    assert one(spark, reshape.reflect_pad("a0", 8), [1.0, 2.0, 3.0, 4.0, 5.0]) == [1, 2, 3, 4, 5, 4, 3, 2]
    assert one(spark, reshape.reflect_pad("a0", 3), [1.0]) == [1, 1, 1]
    a, b = [1.0, 1.0, 1.0, 1.0], [3.0, 3.0, 3.0]
    assert one(spark, reshape.stitch("a0", "a1", 2), a, b) == [1, 1, 1, 3, 3]
    three = one(spark, reshape.stitch_all(["a0", "a1", "a2"], [2, 2]), a, [3.0] * 4, [5.0] * 3)
    assert three == [1, 1, 1, 3, 3, 5, 5]
    assert one(spark, reshape.chop("a0", 4, F.lit(1)), ten) == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert one(spark, reshape.crop_pad("a0", 4), ten) == [4, 5] and one(spark, reshape.crop_pad("a0", 6), ten) == []
    assert one(spark, reshape.time_slice("a0", 10.0, 0.0, 0.2, 0.4), ten) == [2, 3, 4]


def test_axes(spark):
    df = spark.createDataFrame([(["a-b-c", "a-c-d", "c-a"],)], "l array<string>")
    assert df.select(reshape.common_tokens(F.col("l"))).collect()[0][0] == "a-c"
    m = spark.createDataFrame([(i, j, i * 3 + j) for i in range(2) for j in range(3)], "r int, c int, v int")
    assert {(r["r"], r["c"], r["v"]) for r in reshape.reshape_axis(m, "r", "c", 3, 2).collect()} == {(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3), (2, 0, 4), (2, 1, 5)}
    grid = spark.createDataFrame([(i, j, 9.0) for i in range(3) for j in range(3)], "r int, c int, v double")
    got = {(r["r"], r["c"]): r["box_mean"] for r in reshape.box_mean(grid, "r", "c", "v", 3, 3).collect()}
    assert got[1, 1] == 9.0 and got[0, 0] == 4.0 and got[0, 1] == 6.0
    assert reshape.tiles(3, 3, 2, 2, True) == [(0, 0), (0, 1), (1, 0), (1, 1)] and reshape.tiles(4, 2, 2, 2, False) == [(0, 0), (2, 0)]


def test_epoch_range_join(spark):
    s = spark.createDataFrame([("a", float(t), t) for t in range(-5, 30)] + [("b", 3.0, 99)], "ch string, t double, v int")
    e = spark.createDataFrame([("a", 0.0, 1), ("a", 4.5, 2), ("b", 100.0, 3), ("a", 0.0, 4)], "ch string, onset double, ev int")
    got = {(r["ev"], r["t"]) for r in joins.epoch(s, e, ["ch"], "t", "onset", -2.0, 3.0).collect()}
    assert got == {(v, float(t)) for v, o in ((1, 0.0), (4, 0.0), (2, 4.5)) for t in range(-5, 30) if -2 <= t - o <= 3}


def test_concatenate_modes(spark):
    a = spark.createDataFrame([("x", "t1", 1), ("y", "t1", 2)], "ax string, o string, v int")
    b = spark.createDataFrame([("x", "t1", 3), ("x", "t2", 4)], "ax string, o string, v int")
    assert {tuple(r) for r in joins.concatenate([a, b], "ax", ["o"]).select("ax", "o", "v").collect()} == {("0-x", "t1", 1), ("y", "t1", 2), ("1-x", "t1", 3)}
    assert joins.concatenate([a, b], "ax", ["o"], "expand").count() == 4
    with pytest.raises(ValueError):
        joins.concatenate([a, b], "ax", ["o"], "raise")
    assert joins.complete(a, ["ax", "o"]).count() == 2


def test_as_of_and_upsert(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("a", 9, 90.0)], "k string, t int, v double")
    assert {(r["id"], r["last"]) for r in joins.as_of(left, right, ["k"], "t", "v", "last").collect()} == {(1, 50.0), (2, None), (3, None)}
    cur = spark.createDataFrame([("c1", "good"), ("c2", "good")], "name string, status string")
    new = spark.createDataFrame([("c2", "bad"), ("c3", "bad")], "name string, status string")
    assert {tuple(r) for r in joins.upsert_status(cur, new, "name", "status").select("name", "status").collect()} == {("c1", "good"), ("c2", "bad"), ("c3", "bad")}


def test_sampling(spark):
    e = spark.createDataFrame([(i, i % 3) for i in range(60)], "k int, l int")
    folds = sampling.kfold(e, "l", [sampling.hash_order("k"), F.col("k")], 5)
    assert all(r["count"] == 4 for r in folds.groupBy("l", "fold").count().collect())
    assert sampling.pick_without_replacement(e, ["l"], [F.col("k")], 2).count() == 6 and sampling.pick_without_replacement(e, ["l"], [F.col("k")], -1).count() == 60
    assert sorted(r["l"] for r in sampling.shuffle_labels(e, "k", "l", [sampling.hash_order("k", seed=1), F.col("k")], [sampling.hash_order("k", seed=2), F.col("k")]).collect()) == sorted(r["l"] for r in e.collect())
    long = spark.createDataFrame([(k, k % 2, t, None if k == 5 and t == 1 else float(k)) for k in range(8) for t in range(3)], "k int, l int, t int, v double")
    mixed = {(r["k"], r["t"]): r["v"] for r in sampling.mixup(long, "k", "l", "t", "v", [F.col("k")], [F.col("k")], F.lit(0.25)).collect()}
    assert len(mixed) == 24 and mixed[5, 1] is not None and mixed[4, 0] == 4.0 and 0 <= mixed[5, 0] <= 7
    lonely = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, None)], "k int, l int, t int, v double")
    assert {r["v"] for r in sampling.mixup(lonely, "k", "l", "t", "v", [F.col("k")], [F.col("k")], F.lit(0.5)).collect()} == {1.0}
    filled = sampling.fill_normal(long, ["l"], "v", 3)
    assert filled.where("v is null").count() == 0


RANKED = [
    (["a", "a", 0.06], "a"), (["a", "a", 0.01], "a"), (["a", "Unknown", 0.06], "a"), (["a", "Unknown", 0.01], "a"), (["Unknown", "a", 0.06], "a"), (["Unknown", "a", 0.01], "Unknown"),
    (["Unknown", "a", 0.06, "b", 0.06], "a"), (["Unknown", "a", 0.01, "b", 0.06], "b"), (["Unknown", "a", 0.04, "b", 0.01, "c", 0.01], "Unknown"), (["Unknown", "unknown", 0.7004, "a", 0.1593], "a"), (["Unknown", "unknown", 0.7004, "a", 0.1593, "b", 0.1593], "a"),
]


def test_labels(spark):
    data = [(i, [(x[0], 1.0), *zip(x[1::2], x[2::2])]) for i, (x, _) in enumerate(RANKED)]
    df = spark.createDataFrame(data, "i int, ranked array<struct<label:string,pct:double>>")
    got = {r["i"]: r["x"] for r in df.select("i", labels.pick_label(F.col("ranked"), 0.05).alias("x")).collect()}
    assert [got[i] for i in range(len(RANKED))] == [e for _, e in RANKED]
    texts = spark.createDataFrame([("10s",), ("700ms",), ("5us",), ("2m",), ("1min",), ("0.5 sec",), ("x",), (None,)], "t string")
    assert [r[0] for r in texts.select(labels.duration_samples(F.col("t"), 2048.0)).collect()][:4] == [20480, 1434, 1, 245760]
    assert [r[0] for r in texts.select(labels.duration_seconds(F.col("t"))).collect()][-3:] == [0.5, None, None]
    pairs = spark.createDataFrame([("ABAB", "BABA"), ("ABA", "ABBA"), ("x", "y"), (None, "a")], "a string, b string")
    assert [r[0] for r in pairs.select(labels.common_substring("a", "b")).collect()] == ["ABA", "AB", "", None]
    subs = spark.createDataFrame([("D0035", "LAMY 7"), ("d0107", "RAHP3")], "s string, c string")
    assert [tuple(r) for r in subs.select(labels.short_subject(F.col("s")), labels.shank(F.col("c"))).collect()] == [("D35", "LAMY"), ("d107", "RAHP")]
    p = spark.createDataFrame([(3.841459, 1.0, 0.025), (0.0, 2.0, 0.5), (50.0, 3.0, None)], "x double, k double, p double")
    got = p.select(labels.chi2_upper("x", "k").alias("q"), labels.normal_z("p").alias("z")).collect()
    assert got[0]["q"] == pytest.approx(0.05, abs=1e-6) and got[1]["q"] == 1.0 and got[0]["z"] == pytest.approx(1.959964, abs=1e-5) and got[2]["z"] is None
