import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwave.operators import frames, permutation, statistics, windows


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def matrix(spark, m):
    return rows(spark, [(i, j, None if v is None else float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "r int, c int, v double")


def test_dist_literals(spark):
    m = matrix(spark, [[1, 2, 3], [4, 5, 6]])
    got = {r["c"]: (r["mean"], r["sem"]) for r in statistics.dist(m, ["c"], "v", ddof=1).collect()}
    assert got == {0: (2.5, pytest.approx(1.5)), 1: (3.5, pytest.approx(1.5)), 2: (4.5, pytest.approx(1.5))}
    got = {r["r"]: r["sem"] for r in statistics.dist(m, ["r"], "v", ddof=1).collect()}
    assert got[0] == pytest.approx(0.57735027)
    wide = matrix(spark, np.arange(24).reshape(4, 6))
    assert all(r["sem"] == pytest.approx(3.35410197) for r in statistics.dist(wide, ["c"], "v").collect())
    assert all(r["std"] == pytest.approx(6.70820393) for r in statistics.dist(wide, ["c"], "v", "std").collect())
    assert statistics.dist(matrix(spark, [[None, 2], [None, None]]), ["c"], "v").where("c = 0").collect()[0]["mean"] is None


def two_groups(spark):
    g1, g2 = [[1, 1, 1, 1, 1], [0, 60, 0, 10, 0]], [[1, 1, 1, 1, 1], [0, 0, 0, 0, 0]]
    return rows(spark, [(g, i, j, float(v)) for g, m in ((1, g1), (2, g2)) for i, r in enumerate(m) for j, v in enumerate(r)], "g int, r int, c int, v double")


def test_welch_and_mean_diff(spark):
    df = two_groups(spark)
    a, b = F.col("g") == 1, F.col("g") == 2
    by_r = {r["r"]: (r["t"], r["d"]) for r in df.groupBy("r").agg(statistics.welch_t(a, b, "v").alias("t"), statistics.mean_diff(a, b, "v").alias("d")).collect()}
    assert by_r[0] == (None, 0.0) and by_r[1] == (pytest.approx(1.2004901), 14.0)
    by_c = {r["c"]: (r["t"], r["d"]) for r in df.groupBy("c").agg(statistics.welch_t(a, b, "v").alias("t"), statistics.mean_diff(a, b, "v").alias("d")).collect()}
    assert by_c[1] == (pytest.approx(1.01680311), 30.0) and by_c[3] == (pytest.approx(1.10431526), 5.0) and by_c[0][0] == 0.0
    assert df.where("g = 1").agg(statistics.welch_t(a, b, "v").alias("t")).collect()[0]["t"] is None


def test_proportion_and_tails(spark):
    df = rows(spark, [(i, v) for i, v in enumerate([0.774, 0.439, 0.859, 0.697, 0.094])], "i int, v double").withColumn("k", F.lit(1))
    got = [r["p"] for r in statistics.proportion(df, "v", ["k"], "i", "p").orderBy("i").collect()]
    assert got == [0.75, 0.25, 1.0, 0.5, 0.0]
    down = [r["p"] for r in statistics.proportion(df, "v", ["k"], "i", "p", -1).orderBy("i").collect()]
    assert down == [0.25, 0.75, 0.0, 0.5, 1.0]
    d = rows(spark, [(0.274,), (-0.061,), (0.359,), (0.197,), (-0.406,)], "v double")
    for tails, expect in ((1, [True, False, True, False, False]), (2, [True, False, True, False, True]), (-1, [False, True, False, True, True])):
        assert [r[0] for r in d.select(statistics.tail_compare(F.col("v"), F.lit(0.25), tails)).collect()] == expect


def test_outliers(spark):
    df = rows(spark, [(0, j, float(v)) for j, v in enumerate([0, 60, 0, 10, 0])] + [(0, j, 1.0) for j in range(5)], "k int, trial int, v double")
    got = {r["trial"]: r["keep"] for r in statistics.keep_inliers(df, ["k"], "trial", "v", 1.0).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True}
    gone = {(r["trial"], r["round"]) for r in statistics.outlier_rounds(df, "trial", "v", 1.0, 2).collect()}
    assert gone == {(1, 1), (3, 2)}


def test_confusion_literal(spark):
    df = rows(spark, list(zip([2, 0, 2, 2, 0, 1], [0, 0, 2, 2, 0, 2])), "t int, p int")
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in statistics.confusion(df, "t", "p", df.select(F.col("t").alias("label")).distinct()).collect()}
    assert [[got[i, j] for j in range(3)] for i in range(3)] == [[2, 0, 0], [0, 0, 1], [1, 0, 2]]
    share = statistics.normalise_confusion(statistics.confusion(df, "t", "p"), "true").where("y_true = 2 and y_pred = 2").collect()[0]["share"]
    assert float(share) == pytest.approx(2 / 3)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    d = np.cumsum(rng.standard_normal((21, 30)), axis=1)
    data = [(p - 1, t, float(d[p, t])) for p in range(21) for t in range(30)]
    rank = np.argsort(np.argsort(d, axis=0), axis=0) / 20
    on = rank > 1 - 0.3

    def runs(row):
        out, start = [], None
        for t, v in enumerate([*row, False]):
            if v and start is None:
                start = t
            elif not v and start is not None:
                out.append((start, t - start))
                start = None
        return out

    longest = [max([n for _, n in runs(r)], default=0) for r in on[1:]]
    expect = {(s, n): sum(x >= n for x in longest) / 20 for s, n in runs(on[0])}
    got = {(r["t_from"], r["size"]): float(r["p"]) for r in permutation.cluster_p(rows(spark, data, "perm int, t int, stat double"), ["t"], 0.3, digits=12).collect()}
    assert got == pytest.approx(expect)


def test_permutation_finds_a_difference(spark):
    rng = np.random.default_rng(12)
    data = [(i, i < 20, [float(rng.standard_normal() + (2 if i < 20 and 5 <= t < 12 else 0)) for t in range(20)]) for i in range(40)]
    df = rows(spark, [*data, (99, True, None), (98, False, [None] * 20)], "trial int, f boolean, v array<double>")
    order = F.xxhash64("trial", "perm")
    assigned = permutation.assignments(df.where("trial < 90").select("trial", "f"), "trial", F.col("f"), 100, order)
    diffs = permutation.null_statistics(df, assigned, "trial", [], "v", 100).withColumnRenamed("index", "t").cache()
    x = np.array([d[2] for d in data])
    got = {(r["perm"], r["t"]): r["stat"] for r in diffs.collect()}
    assert len(got) == 101 * 20 and np.allclose([got[-1, t] for t in range(20)], x[:20].mean(0) - x[20:].mean(0))
    welch = {r["index"]: r["stat"] for r in permutation.null_statistics(df, assigned, "trial", [], "v", 100, "welch_t").where("perm = -1").collect()}
    se = np.sqrt(x[:20].var(0, ddof=1) / 20 + x[20:].var(0, ddof=1) / 20)
    assert np.allclose([welch[t] for t in range(20)], (x[:20].mean(0) - x[20:].mean(0)) / se)
    own = permutation.null_statistics(df, assigned, "trial", [], "v", 100, lambda a, b: a[0] - b[0]).where("perm >= 0").select("stat").distinct().collect()
    assert [r[0] for r in own] == [0.0]
    p = {r["t"]: float(r["p"]) for r in permutation.permutation_p(diffs, ["t"]).collect()}
    assert all(p[t] < 0.05 for t in range(5, 12)) and sum(p[t] < 0.05 for t in (*range(5), *range(12, 20))) <= 3
    best = min(permutation.cluster_p(diffs, ["t"], 0.05).collect(), key=lambda r: r["p"])
    assert best["t_from"] <= 6 and best["t_to"] >= 10 and float(best["p"]) <= 0.05


def test_windows(spark):
    df = rows(spark, [(1, i, float(i)) for i in range(6)], "k int, i int, v double")
    assert [r["m"] for r in windows.sliding(df, ["k"], "i", 3, {"m": F.avg("v")}).orderBy("i").collect()] == [1.0, 2.0, 3.0, 4.0]
    labels = rows(spark, list(enumerate("abcab")), "i int, l string")
    assert [r["n"] for r in windows.unique_labels(labels, "l", "i", "n").orderBy("i").collect()] == ["a-0", "b-0", "c", "a-1", "b-1"]
    curve = rows(spark, list(enumerate([0.0, 1.0, 2.0, 3.0, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 8.5, 9.0, 9.5, 10.0])), "i int, v double")
    assert windows.elbow(curve, "i", "v").collect()[0]["i"] == 4
    names = rows(spark, [("cat-dog",), ("dog-cat",), ("cat-bird",)], "l string")
    assert sorted((r["l"], r["c"]) for r in windows.dense_classes(names, "l", "c", 0).collect()) == [("cat-bird", 0), ("cat-dog", 0), ("dog-cat", 1)]
    blocks = windows.crop_blocks(rows(spark, [(1, 1.0, "x"), (1, 2.0, "x")], "k int, t double, e string"), ["k"], "t", F.col("e") == "boundary", 2.0, 1.0).collect()
    assert [tuple(b) for b in blocks] == [(1, 0, 0.0, 3.0, 2)]


def test_frames(spark):
    df = rows(spark, [("a", "x", None), ("a", "y", 1.0), ("b", "x", None), ("b", "y", None)], "r string, c string, v double")
    assert {(r["r"], r["c"]) for r in frames.drop_empty_labels(df, ["r", "c"]).collect()} == {("a", "y")}
    packed = rows(spark, [(1, [1.0, float("nan"), 3.0]), (2, None)], "k int, values array<double>")
    long = frames.unpack(packed, "values")
    assert [(r["t"], r["v"]) for r in long.orderBy("t").collect()] == [(0, 1.0), (1, None), (2, 3.0)]
    assert frames.pack(long, ["k"]).collect()[0]["values"] == [1.0, None, 3.0]
    named = rows(spark, [("go-left",), ("stop-left",), ("go",)], "l string")
    assert {r["l"] for r in frames.select_label(named, "l", "go").collect()} == {"go"}
    assert {r["l"] for r in frames.select_label(named, "l", "left").collect()} == {"go-left", "stop-left"}


def test_rescale_modes_and_nulls(spark):
    base = rows(spark, [("c", 1.0), ("c", 3.0), ("z", 0.0), ("z", 0.0)], "ch string, v double")
    act = rows(spark, [("c", 4.0), ("z", 5.0), ("c", None)], "ch string, v double")
    got = {(r["ch"], r["v"]): r for r in statistics.rescale(act, base, ["ch"], "v", ["mean", "ratio", "percent", "zscore", "logratio", "zlogratio"]).collect()}
    c = got["c", 4.0]
    assert (c["mean"], c["ratio"], c["percent"]) == (2.0, 2.0, 1.0) and c["zscore"] == pytest.approx(2 / np.sqrt(2))
    assert got["z", 5.0]["ratio"] is None and got["z", 5.0]["zscore"] is None and got["c", None]["mean"] is None


def test_clusters_over_axes(spark):
    on = [(0, 0), (0, 1), (1, 1), (3, 3), (4, 3)]
    data = [(p, r, c, float((r, c) in on) if p < 0 else float(r == c == 0 and p % 5 == 0)) for p in range(-1, 20) for r in range(5) for c in range(5)]
    df = rows(spark, data, "perm int, r int, c int, stat double")
    got = lambda **k: sorted((x["r_from"], x["r_to"], x["c_from"], x["c_to"], x["size"]) for x in permutation.cluster_p(df, ["r", "c"], 0.04, **k).collect())
    assert (3, 4, 3, 3, 2) in got() and sum(x[-1] for x in got()) >= 4
    assert all(x[0] == x[1] for x in got(ignored=("r",)))
    assert permutation.neighbours(["a", "b"], ("a",)).tolist() == [[0, 1], [0, -1]]
    label = permutation.label_clusters(np.array(on), permutation.neighbours(["r", "c"]))
    assert label.tolist() == [0, 0, 0, 3, 3]
    assert permutation.label_clusters(np.array(on), permutation.neighbours(["r", "c"], ("r", "c"))).tolist() == [0, 1, 2, 3, 4]
