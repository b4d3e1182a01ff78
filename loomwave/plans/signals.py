"""Queries of the signal operators over the star-schema tables: embeddings are trials of 64 samples with a
class, events are a stream of marks per user, lineitem and orders are large two-group samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwave.operators import decoding, frames, joins, permutation, reshape, sampling, statistics, windows
from loomwave.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_EL = "el AS (SELECT vec_id AS trial, label, unnest(range(len(embedding))) AS t, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_EV = "ev AS (SELECT *, CAST(epoch_us(ts) AS DOUBLE) / 3600000000.0 AS hours FROM events)"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def packed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("trial"), "label", F.col("embedding").cast("array<double>").alias("values"))


def long(spark: SparkSession, d: str) -> DataFrame:
    return frames.unpack(packed(spark, d), "values").withColumn("t", F.col("t").cast("long"))


def events(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    micros = F.unix_date(F.col("ts").cast("date")).cast("long") * 86400000000 + (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long") * 1000000 + (F.extract(F.lit("SECOND"), "ts") * 1000000).cast("long")
    return ev.withColumn("hours", micros.cast("double") / 3600000000.0)


# ---- aggregation -------------------------------------------------------------------------------------


@query("SELECT user_id, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value) / sqrt(count(value)), 6) + 0.0 AS sem FROM events GROUP BY user_id")
def dist_sem(spark, d):
    out = statistics.dist(table(spark, d, "events"), ["user_id"], "value")
    return out.select("user_id", r6("mean").alias("mean"), r6("sem").alias("sem"))


@query(f"WITH {_EL} SELECT label, t, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) + 0.0 AS std FROM el GROUP BY label, t")
def dist_std_samples(spark, d):
    out = statistics.dist(long(spark, d), ["label", "t"], "v", "std", 1)
    return out.select("label", "t", r6("mean").alias("mean"), r6("std").alias("std"))


@query("SELECT l_linenumber, round(avg(l_extendedprice) FILTER (l_returnflag = 'A') - avg(l_extendedprice) FILTER (l_returnflag = 'R'), 4) + 0.0 AS diff FROM lineitem GROUP BY l_linenumber")
def mean_diff(spark, d):
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg((F.round(statistics.mean_diff(flag == "A", flag == "R", "l_extendedprice"), 4) + 0.0).alias("diff"))


@query("""WITH g AS (SELECT l_linenumber, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS ma, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS mr,
  var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS va, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS vr,
  count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nr FROM lineitem GROUP BY l_linenumber)
SELECT l_linenumber, round((ma - mr) / nullif(sqrt(coalesce(va, 0) / nullif(na, 0) + coalesce(vr, 0) / nullif(nr, 0)), 0), 6) + 0.0 AS t FROM g""")
def welch_t(spark, d):
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(r6(statistics.welch_t(flag == "A", flag == "R", "l_extendedprice")).alias("t"))


@query("""WITH p AS (SELECT l_returnflag AS g, l_quantity AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')),
r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS w FROM p),
s AS (SELECT g, count(*) AS n, avg(r) AS m, var_samp(r - w) AS s FROM r GROUP BY g)
SELECT round((CAST(a.n AS DOUBLE) * b.n * (b.m - a.m)) / ((a.n + b.n) * sqrt(a.n * a.s + b.n * b.s)), 6) + 0.0 AS statistic FROM s a, s b WHERE a.g = 'A' AND b.g = 'R'""")
def brunner_munzel(spark, d):
    return statistics.brunner_munzel(table(spark, d, "lineitem"), "l_returnflag", "A", "R", "l_quantity").select(r6("statistic").alias("statistic"))


@query(f"WITH {_EL} SELECT label, t, round(avg(v), 6) + 0.0 AS mean FROM el GROUP BY label, t")
def condition_average(spark, d):
    return statistics.moments_by(long(spark, d), ["label", "t"], "v").withColumn("mean", r6("mean"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, count(*) AS n, round(sum(l_quantity * l_quantity), 2) AS sumsq FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def reduce_rollup(spark, d):
    out = frames.reduce_axes(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "rollup")
    return out.select("l_returnflag", "l_linestatus", F.round("mean", 6).alias("mean"), "n", F.round("sumsq", 2).alias("sumsq"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def reduce_cube(spark, d):
    out = frames.reduce_axes(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "cube")
    return out.select("l_returnflag", "l_linestatus", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("SELECT event_type, sum(CAST(round(value * 100) AS BIGINT) * CAST(round(value * 100) AS BIGINT))::BIGINT AS sumsq FROM events GROUP BY event_type")
def sum_squared(spark, d):
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(statistics.sum_squared(cents).alias("sumsq"))


@query("""WITH k AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY user_id)
SELECT user_id, round(avg(value), 6) + 0.0 AS mean FROM events JOIN k USING (user_id) WHERE abs(value) < 1.5 * s + m GROUP BY user_id""")
def average_without_outliers(spark, d):
    ev = table(spark, d, "events")
    keep = statistics.keep_inliers(ev, ["user_id"], "event_id", "value", 1.5)
    return ev.join(keep.where("keep").select("user_id", "event_id"), ["user_id", "event_id"], "left_semi").groupBy("user_id").agg(r6(F.avg("value")).alias("mean"))


_CM = "cm AS (SELECT o_orderstatus AS y_true, CASE WHEN o_totalprice > 150000 THEN 'F' WHEN o_totalprice > 50000 THEN 'O' ELSE 'P' END AS y_pred FROM orders)"


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("y_true"), F.when(price > 150000, "F").when(price > 50000, "O").otherwise("P").alias("y_pred"))


@query(f"WITH {_CM}, l AS (SELECT DISTINCT y_true AS label FROM cm) SELECT a.label AS y_true, b.label AS y_pred, (SELECT count(*) FROM cm WHERE cm.y_true = a.label AND cm.y_pred = b.label) AS n FROM l a, l b")
def confusion_matrix(spark, d):
    p = _predictions(spark, d)
    return statistics.confusion(p, "y_true", "y_pred", p.select(F.col("y_true").alias("label")).distinct())


@query(f"WITH {_CM}, c AS (SELECT y_true, y_pred, count(*) AS n FROM cm GROUP BY ALL) SELECT y_true, y_pred, n, round(n * 1.0 / sum(n) OVER (PARTITION BY y_true), 6)::DOUBLE AS share FROM c")
def confusion_by_true(spark, d):
    out = statistics.normalise_confusion(statistics.confusion(_predictions(spark, d), "y_true", "y_pred"), "true")
    return out.withColumn("share", F.round(F.col("share").cast("double"), 6))


@query(f"WITH {_CM}, c AS (SELECT y_true, y_pred, count(*) AS n FROM cm GROUP BY ALL) SELECT y_true, y_pred, n, round(n * 1.0 / sum(n) OVER (PARTITION BY y_pred), 6)::DOUBLE AS share FROM c")
def confusion_by_predicted(spark, d):
    out = statistics.normalise_confusion(statistics.confusion(_predictions(spark, d), "y_true", "y_pred"), "pred")
    return out.withColumn("share", F.round(F.col("share").cast("double"), 6))


@query(f"WITH {_CM} SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy, count(*) AS n FROM cm")
def accuracy_score(spark, d):
    return statistics.accuracy(_predictions(spark, d), "y_true", "y_pred").withColumn("accuracy", F.round("accuracy", 6))


@query("""SELECT l_linenumber, round(1 - sum((l_extendedprice - 1500 * l_quantity) ** 2) / nullif(var_pop(l_extendedprice) * count(*), 0), 6) + 0.0 AS r2, round(corr(l_extendedprice, 1500 * l_quantity), 6) + 0.0 AS rho FROM lineitem GROUP BY l_linenumber""")
def fit_quality(spark, d):
    li = table(spark, d, "lineitem").withColumn("predicted", F.col("l_quantity") * 1500)
    return statistics.fit_quality(li, ["l_linenumber"], "l_extendedprice", "predicted").select("l_linenumber", r6("r2").alias("r2"), r6("rho").alias("rho"))


@query("""WITH b AS (SELECT user_id, unnest(range(10)) AS bin FROM (SELECT DISTINCT user_id FROM events)),
c AS (SELECT user_id, CASE WHEN value = 500 THEN 9 ELSE CAST(floor(value / 50.0) AS BIGINT) END AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY ALL)
SELECT user_id, bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (user_id, bin)""")
def bin_spikes(spark, d):
    return statistics.bin_counts(table(spark, d, "events"), ["user_id"], "value", 0.0, 500.0, 50.0)


@query(f"WITH {_EL} SELECT trial, CAST(floor(t / 8) AS BIGINT) AS bin, round(avg(v), 6) + 0.0 AS mean FROM el GROUP BY ALL")
def bin_output(spark, d):
    return statistics.bin_means(long(spark, d), ["trial"], "t", "v", 0, 8).withColumn("mean", r6("mean"))


@query("""WITH b AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT event_id, round(value - m, 6) + 0.0 AS mean, round(value / nullif(m, 0), 6) + 0.0 AS ratio, round(log10(value / m), 6) + 0.0 AS logratio, round((value - m) / nullif(m, 0), 6) + 0.0 AS percent,
  round((value - m) / nullif(s, 0), 6) + 0.0 AS zscore, round(log10(value / m) / nullif(s, 0), 6) + 0.0 AS zlogratio FROM events JOIN b USING (user_id) WHERE event_type = 'click'""")
def rescale_modes(spark, d):
    ev = table(spark, d, "events")
    modes = ["mean", "ratio", "logratio", "percent", "zscore", "zlogratio"]
    out = statistics.rescale(ev.where("event_type = 'click'"), ev.where("event_type = 'view'"), ["user_id"], "value", modes)
    return out.select("event_id", *(r6(m).alias(m) for m in modes))


@query(f"""WITH {_EL}, b AS (SELECT label, avg(v) AS m, stddev_samp(v) AS s FROM el WHERE t < 16 GROUP BY label),
z AS (SELECT el.label, t, (v - m) / nullif(s, 0) AS z FROM el JOIN b USING (label) WHERE t >= 16)
SELECT label, t, round(avg(z), 6) + 0.0 AS mean, round(stddev_pop(z) / sqrt(count(z)), 6) + 0.0 AS sem FROM z GROUP BY label, t""")
def evoked_zscore(spark, d):
    el = long(spark, d)
    z = statistics.rescale(el.where("t >= 16"), el.where("t < 16"), ["label"], "v", ["zscore"])
    out = statistics.dist(z, ["label", "t"], "zscore")
    return out.select("label", "t", r6("mean").alias("mean"), r6("sem").alias("sem"))


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) + 0.0 AS scaled FROM part")
def minmax_scale(spark, d):
    return statistics.minmax_scale(table(spark, d, "part"), "p_retailprice", "scaled").select("p_partkey", r6("scaled").alias("scaled"))


@query("""WITH k AS (SELECT user_id, event_type, max(abs(value)) AS peak FROM events GROUP BY ALL), s AS (SELECT user_id, avg(value) AS c, stddev_pop(value) AS d FROM events GROUP BY user_id)
SELECT user_id, event_type, round(peak, 6) AS peak, peak < d * 2 + c AS keep FROM k JOIN s USING (user_id)""")
def outlier_keep(spark, d):
    return statistics.keep_inliers(table(spark, d, "events"), ["user_id"], "event_type", "value", 2.0).withColumn("peak", F.round("peak", 6))


@query("""WITH c AS (SELECT event_type, median(value) AS c FROM events GROUP BY event_type), s AS (SELECT event_type, median(abs(value - c)) AS d, any_value(c) AS c FROM events JOIN c USING (event_type) GROUP BY event_type),
k AS (SELECT event_type, user_id, max(abs(value)) AS peak FROM events GROUP BY ALL) SELECT event_type, user_id, round(peak, 6) AS peak, peak < d * 4 + c AS keep FROM k JOIN s USING (event_type)""")
def outlier_keep_robust(spark, d):
    return statistics.keep_inliers(table(spark, d, "events"), ["event_type"], "user_id", "value", 4.0, robust=True).withColumn("peak", F.round("peak", 6))


@query("""WITH RECURSIVE p AS (SELECT user_id, CASE WHEN stddev_pop(value * value) = 0 THEN 1e-9 ELSE stddev_pop(value * value) END AS s FROM events GROUP BY user_id),
r1 AS (SELECT user_id, s FROM p WHERE s > (SELECT avg(s) + 2 * stddev_pop(s) FROM p)), q1 AS (SELECT * FROM p WHERE user_id NOT IN (SELECT user_id FROM r1)),
r2 AS (SELECT user_id, s FROM q1 WHERE s > (SELECT avg(s) + 2 * stddev_pop(s) FROM q1))
SELECT user_id, CAST(1 AS BIGINT) AS round FROM r1 UNION ALL SELECT user_id, CAST(2 AS BIGINT) FROM r2""")
def outlier_rounds(spark, d):
    return statistics.outlier_rounds(table(spark, d, "events"), "user_id", "value", 2.0, 2)


@query("SELECT event_id, round(value - (regr_intercept(value, event_id) OVER w + regr_slope(value, event_id) OVER w * event_id), 5) + 0.0 AS detrended FROM events WINDOW w AS (PARTITION BY user_id)")
def detrend(spark, d):
    out = statistics.detrend(table(spark, d, "events"), ["user_id"], "event_id", "value", "detrended")
    return out.select("event_id", (F.round("detrended", 5) + 0.0).alias("detrended"))


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY CAST(ts AS DATE)), 6) + 0.0 AS referenced FROM events")
def average_reference(spark, d):
    ev = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return statistics.average_reference(ev, ["day"], "value", "referenced").select("event_id", r6("referenced").alias("referenced"))


@query("SELECT event_id, round((row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY user_id) - 1, 0), 6) AS proportion FROM events")
def proportion(spark, d):
    return statistics.proportion(table(spark, d, "events"), "value", ["user_id"], "event_id", "proportion").select("event_id", F.round("proportion", 6).alias("proportion"))


@query("SELECT event_id, value > 250 AS above, value < 250 AS below, abs(value) > abs(-250) AS both FROM events")
def tail_compare(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", statistics.tail_compare(v, F.lit(250), 1).alias("above"), statistics.tail_compare(v, F.lit(250), -1).alias("below"), statistics.tail_compare(v, F.lit(-250), 2).alias("both"))


# ---- windows and frames ------------------------------------------------------------------------------


@query("""WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), f AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n WHERE value > 60)
SELECT user_id, min(event_id) AS run_start, max(event_id) AS run_end, count(*) AS length FROM f GROUP BY user_id, g""")
def islands(spark, d):
    return windows.islands(table(spark, d, "events"), ["user_id"], "event_id", F.col("value") > 60)


@query(f"WITH {_EL}, w AS (SELECT trial, t, avg(v) OVER s AS m, max(v) OVER s AS x, count(*) OVER s AS n FROM el WINDOW s AS (PARTITION BY trial ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT trial, t, round(m, 6) + 0.0 AS mean, round(x, 6) + 0.0 AS peak FROM w WHERE n = 8")
def sliding_window(spark, d):
    out = windows.sliding(long(spark, d), ["trial"], "t", 8, {"mean": F.avg("v"), "peak": F.max("v")})
    return out.select("trial", "t", r6("mean").alias("mean"), r6("peak").alias("peak"))


@query(f"WITH {_EL}, s AS (SELECT trial, unnest(range(0, 49, 4)) AS s FROM (SELECT DISTINCT trial FROM el)) SELECT s.trial, CAST(s.s / 4 AS BIGINT) AS frame, round(sum(v), 6) + 0.0 AS total FROM s JOIN el ON el.trial = s.trial AND t BETWEEN s AND s + 15 GROUP BY ALL")
def window_frames(spark, d):
    cut = packed(spark, d).select("trial", F.posexplode(windows.window_frames("values", 16, 4)).alias("frame", "w"))
    return cut.select("trial", F.col("frame").cast("long").alias("frame"), r6(F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {_EL} SELECT trial, t, round(lag(v, 2) OVER w, 6) + 0.0 AS lag_2, round(lag(v, 1) OVER w, 6) + 0.0 AS lag_1, round(v, 6) + 0.0 AS now, round(lead(v, 1) OVER w, 6) + 0.0 AS lead_1 FROM el WINDOW w AS (PARTITION BY trial ORDER BY t)")
def spikes_with_history(spark, d):
    out = windows.with_history(long(spark, d), ["trial"], "t", "v", 2, 1)
    return out.select("trial", "t", *(r6(c).alias(c) for c in ("lag_2", "lag_1", "now", "lead_1")))


@query(f"""WITH {_EV}, b AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY hours, event_id ROWS UNBOUNDED PRECEDING) AS block FROM ev)
SELECT user_id, CAST(block AS BIGINT) AS block, round(greatest(min(hours) - 1, 0), 6) AS t_from, round(max(hours) + 2, 6) AS t_to, count(*) AS n_events FROM b WHERE event_type <> 'signup' GROUP BY ALL""")
def crop_empty_data(spark, d):
    out = windows.crop_blocks(events(spark, d), ["user_id"], "hours", F.col("event_type") == "signup", 1.0, 2.0)
    return out.select("user_id", "block", F.round("t_from", 6).alias("t_from"), F.round("t_to", 6).alias("t_to"), "n_events")


@query("SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY event_type) > 1 THEN event_type || '-' || (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) ELSE event_type END AS name FROM events")
def make_array_unique(spark, d):
    return windows.unique_labels(table(spark, d, "events"), "event_type", "event_id", "name").select("event_id", "name")


@query(f"WITH {_EV} SELECT event_id, coalesce(lag(hours + value / 10) OVER (PARTITION BY user_id ORDER BY hours, event_id) > hours, false) AS overlaps FROM ev")
def overlap_with_previous(spark, d):
    out = windows.overlaps_previous(events(spark, d).withColumn("lasts", F.col("value") / 10), ["user_id"], "hours", "lasts", "event_id")
    return out.select("event_id", "overlaps")


@query(f"WITH {_EV} SELECT event_id, last_value(CASE WHEN event_type IN ('view', 'click') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hours, event_id ROWS UNBOUNDED PRECEDING) AS condition FROM ev")
def repair_conditions(spark, d):
    out = windows.fill_condition(events(spark, d), ["user_id"], ["hours", "event_id"], F.col("event_type").isin("view", "click"), "event_type", "condition")
    return out.select("event_id", "condition")


@query(f"WITH {_EL}, w AS (SELECT *, lag(v) OVER x AS p, lead(v) OVER x AS n FROM el WINDOW x AS (PARTITION BY trial ORDER BY t)) SELECT trial, t, round(v, 6) + 0.0 AS v FROM w WHERE v >= 0.1 AND p < v AND n <= v")
def find_peaks(spark, d):
    return windows.peaks(long(spark, d), ["trial"], "t", "v", 0.1).select("trial", "t", r6("v").alias("v"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY split_part(o_orderpriority, '-', 2)) - 1 AS BIGINT) AS class FROM orders")
def classes_from_labels(spark, d):
    return windows.dense_classes(table(spark, d, "orders"), "o_orderpriority", "class", 1).select("o_orderkey", "class")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events), n AS (SELECT user_id, count(v) AS n FROM e GROUP BY user_id), m AS (SELECT greatest(min(n), 3) AS need FROM n),
r AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY v IS NULL, event_id) AS rank FROM e)
SELECT r.user_id, event_id, rank FROM r JOIN n USING (user_id), m WHERE n >= need AND rank <= need""")
def common_denominator(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return windows.common_trials(ev, "user_id", "event_id", "v", 3).select("user_id", "event_id", "rank")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 70)")
def drop_rare_labels(spark, d):
    return windows.drop_rare(table(spark, d, "events"), "user_id", 70).select("event_id", "user_id")


@query("""WITH s AS (SELECT CAST(p_size AS BIGINT) AS x, avg(p_retailprice) + p_size * p_size AS y FROM part GROUP BY p_size), e AS (SELECT min_by(y, x) AS ya, min(x) AS xa, max_by(y, x) AS yb, max(x) AS xb FROM s),
k AS (SELECT x, round(abs((yb - ya) * (x - xa) - (xb - xa) * (y - ya)) / sqrt((xb - xa) ** 2 + (yb - ya) ** 2), 6) AS distance FROM s, e) SELECT x, distance FROM k ORDER BY distance DESC, x LIMIT 1""")
def elbow_point(spark, d):
    curve = table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("x")).agg((F.avg("p_retailprice") + F.first("p_size") * F.first("p_size")).alias("y"))
    return windows.elbow(curve, "x", "y").withColumn("distance", F.round("distance", 6))


@query("SELECT * FROM (SELECT label, vec_id AS trial, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 3")
def top_trials(spark, d):
    first = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("trial"), F.col("embedding")[0].alias("x"))
    return windows.first_of_key(first, ["label"], [F.desc("x"), F.col("trial")], 3).select("label", "trial", "rank")


# ---- joins -------------------------------------------------------------------------------------------


@query(f"""WITH {_EV} SELECT p.event_id AS epoch, s.event_id AS sample, round(s.hours - p.hours, 6) + 0.0 AS rel FROM ev p JOIN ev s ON s.user_id = p.user_id AND round(s.hours - p.hours, 9) BETWEEN -6 AND 6 WHERE p.event_type = 'purchase' AND s.event_type <> 'purchase'""")
def epoch_events(spark, d):
    ev = events(spark, d)
    marks = ev.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("epoch"), F.col("hours").alias("onset"))
    samples = ev.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("sample"), "hours")
    return joins.epoch(samples, marks, ["user_id"], "hours", "onset", -6.0, 6.0).select("epoch", "sample", r6("rel").alias("rel"))


@query(f"""WITH {_EV} SELECT event_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY hours, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) IS NOT NULL AS any_before,
  round(last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hours, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING), 6) AS last_value FROM ev QUALIFY event_type <> 'signup'""")
def as_of_previous(spark, d):
    ev = events(spark, d)
    out = joins.as_of(ev.where("event_type <> 'signup'").select("user_id", "hours", "event_id"), ev.where("event_type = 'signup'").select("user_id", "hours", "value"), ["user_id"], "hours", "value", "last")
    return out.select("event_id", F.col("last").isNotNull().alias("any_before"), F.round("last", 6).alias("last_value"))


@query("SELECT event_id, event_type FROM events WHERE list_has_any(string_split(event_type, '/'), ['view', 'click'])")
def match_event_names(spark, d):
    return joins.match_event_names(table(spark, d, "events"), "event_type", ["view", "click"]).select("event_id", "event_type")


def _halves(spark: SparkSession, d: str) -> list[DataFrame]:
    ev = table(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("ch"), "event_id", "value")
    return [ev.where("event_type <> 'error' and event_id % 2 = 0"), ev.where("event_type <> 'signup' and event_id % 2 = 1")]


@query("""WITH a AS (SELECT 0 AS s, event_type, CAST(user_id AS VARCHAR) AS ch, event_id, value FROM events WHERE event_type <> 'error' AND event_id % 2 = 0 UNION ALL SELECT 1, event_type, CAST(user_id AS VARCHAR), event_id, value FROM events WHERE event_type <> 'signup' AND event_id % 2 = 1),
k AS (SELECT event_type FROM a GROUP BY event_type HAVING count(DISTINCT s) = 2), b AS (SELECT a.* FROM a WHERE event_type IN (SELECT event_type FROM k)),
c AS (SELECT ch, count(DISTINCT s) AS n FROM b GROUP BY ch) SELECT CASE WHEN n > 1 THEN s || '-' || ch ELSE ch END AS ch, event_type, event_id FROM b JOIN c USING (ch)""")
def concatenate_shrink(spark, d):
    return joins.concatenate(_halves(spark, d), "ch", ["event_type"], "shrink").select("ch", "event_type", "event_id")


@query("""WITH a AS (SELECT 0 AS s, event_type, CAST(user_id AS VARCHAR) AS ch, event_id FROM events WHERE event_type <> 'error' AND event_id % 2 = 0 UNION ALL SELECT 1, event_type, CAST(user_id AS VARCHAR), event_id FROM events WHERE event_type <> 'signup' AND event_id % 2 = 1),
c AS (SELECT ch, count(DISTINCT s) AS n FROM a GROUP BY ch) SELECT CASE WHEN n > 1 THEN s || '-' || ch ELSE ch END AS ch, event_type, event_id FROM a JOIN c USING (ch)""")
def concatenate_expand(spark, d):
    return joins.concatenate(_halves(spark, d), "ch", ["event_type"], "expand").select("ch", "event_type", "event_id")


@query("""WITH r AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rank FROM events), c AS (SELECT event_type, min(n) AS least FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type)
SELECT event_id, rank FROM r JOIN c USING (event_type) WHERE rank <= least""")
def pool_min_trials(spark, d):
    return joins.pool_repeats(table(spark, d, "events"), "event_type", "user_id", F.col("event_id")).select("event_id", "rank")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rank FROM events")
def pool_max_trials(spark, d):
    return joins.pool_repeats(table(spark, d, "events"), "event_type", "user_id", F.col("event_id"), "max").select("event_id", "rank")


@query("SELECT l_linenumber FROM lineitem GROUP BY l_linenumber HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def shared_conditions(spark, d):
    return joins.shared_labels(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_labels(spark, d):
    n = joins.look_up(table(spark, d, "nation"), table(spark, d, "region"), "n_regionkey", "r_regionkey", ["r_name"])
    return joins.look_up(table(spark, d, "supplier"), n, "s_nationkey", "n_nationkey", ["n_name", "r_name"]).select("s_suppkey", "n_name", "r_name")


@query("SELECT r_name, s.o_orderstatus, (SELECT count(*) FROM orders o WHERE o.o_orderstatus = s.o_orderstatus) AS n FROM region, (SELECT DISTINCT o_orderstatus FROM orders) s")
def condition_product(spark, d):
    status = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return joins.each_with_each(table(spark, d, "region").select("r_name"), status)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def drop_bad_channels(spark, d):
    return joins.without(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("""WITH c AS (SELECT s_suppkey AS name, 'good' AS status FROM supplier), x AS (SELECT DISTINCT l_suppkey AS name, 'bad' AS status FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)
SELECT coalesce(c.name, x.name) AS name, coalesce(x.status, c.status) AS status FROM c FULL JOIN x ON c.name = x.name""")
def update_status(spark, d):
    current = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.lit("good").alias("status"))
    changes = table(spark, d, "lineitem").where("l_quantity = 50 and l_discount = 0.1").select(F.col("l_suppkey").alias("name"), F.lit("bad").alias("status")).distinct()
    return joins.upsert_status(current, changes, "name", "status")


@query("""WITH u AS (SELECT DISTINCT subject, run, event_id, onset, duration FROM task_events WHERE onset IS NOT NULL), l AS (SELECT subject, run, max(CAST(round(onset * 1000) AS BIGINT)) AS length FROM u GROUP BY ALL),
o AS (SELECT subject, run, coalesce(sum(length) OVER (PARTITION BY subject ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l)
SELECT event_id, CAST(CAST(round(onset * 1000) AS BIGINT) + off AS BIGINT) AS t_joined FROM u JOIN o USING (subject, run)""")
def concatenate_runs(spark, d):
    ev = table(spark, d, "task_events").where("onset is not null").select("subject", "run", "event_id", F.round(F.col("onset") * 1000).cast("long").alias("t")).distinct()
    length = ev.groupBy("subject", "run").agg(F.max("t").alias("length"))
    return joins.concatenate_runs(ev, ["subject"], "run", "t", length).select("event_id", F.col("t_joined").cast("long").alias("t_joined"))


# ---- labels, sets and reshaping ----------------------------------------------------------------------


@query("WITH w AS (SELECT count(*) AS n FROM orders WHERE o_orderpriority = 'URGENT') SELECT o_orderkey FROM orders, w WHERE CASE WHEN n > 0 THEN o_orderpriority = 'URGENT' ELSE list_contains(string_split(o_orderpriority, '-'), 'URGENT') END")
def select_label(spark, d):
    return frames.select_label(table(spark, d, "orders"), "o_orderpriority", "URGENT").select("o_orderkey")


@query("""WITH e AS (SELECT event_type, user_id, CASE WHEN event_type <> 'error' AND user_id % 7 <> 0 THEN value END AS v, event_id FROM events)
SELECT event_id FROM e WHERE event_type IN (SELECT event_type FROM e GROUP BY event_type HAVING count(v) > 0) AND user_id IN (SELECT user_id FROM e GROUP BY user_id HAVING count(v) > 0)""")
def drop_empty_labels(spark, d):
    v = F.when((F.col("event_type") != "error") & (F.col("user_id") % 7 != 0), F.col("value"))
    return frames.drop_empty_labels(table(spark, d, "events").withColumn("v", v), ["event_type", "user_id"]).select("event_id")


@query("SELECT l_shipmode_flag, count(*) AS n FROM (SELECT l_returnflag || '-' || l_linestatus AS l_shipmode_flag FROM lineitem) GROUP BY l_shipmode_flag")
def combine_axes(spark, d):
    out = reshape.combine_axes(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus", "l_shipmode_flag")
    return out.groupBy("l_shipmode_flag").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1 INTERSECT SELECT p_partkey FROM part WHERE p_size > 10")
def intersect_labels(spark, d):
    li = table(spark, d, "lineitem")
    a, b = li.where("l_quantity > 49").select(F.col("l_partkey").alias("k")), li.where("l_discount >= 0.1").select(F.col("l_partkey").alias("k"))
    return a.intersect(b).intersect(table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def difference_labels(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def union_labels(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).distinct()


@query("SELECT count(*) = count(DISTINCT event_id) AS is_unique, count(DISTINCT user_id) AS users FROM events")
def is_unique(spark, d):
    return table(spark, d, "events").agg((F.count("*") == F.count_distinct("event_id")).alias("is_unique"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, string_agg(event_type, '-' ORDER BY first) AS keys FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def keys_first_seen(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), "-").alias("keys"))


@query(f"WITH {_EL} SELECT CAST(floor((trial * 64 + t) / 32) AS BIGINT) AS r, CAST((trial * 64 + t) % 32 AS BIGINT) AS c, round(v, 6) + 0.0 AS v FROM el")
def reshape_rows(spark, d):
    out = reshape.reshape_axis(long(spark, d).withColumnsRenamed({"trial": "r", "t": "c"}), "r", "c", 64, 32)
    return out.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), r6("v").alias("v"))


@query(f"""WITH {_EL}, i AS (SELECT trial, unnest(range(32)) AS t FROM (SELECT DISTINCT trial FROM el)), x AS (SELECT trial, t, t * 63 / 31.0::DOUBLE AS x FROM i)
SELECT x.trial, x.t, round(a.v + (b.v - a.v) * (x - floor(x)), 6) + 0.0 AS v FROM x JOIN el a ON a.trial = x.trial AND a.t = CAST(floor(x) AS BIGINT) JOIN el b ON b.trial = x.trial AND b.t = least(CAST(floor(x) AS BIGINT) + 1, 63)""")
def resample(spark, d):
    out = packed(spark, d).select("trial", F.posexplode(reshape.resample_linear("values", F.lit(32))).alias("t", "v"))
    return out.select("trial", F.col("t").cast("long").alias("t"), r6("v").alias("v"))


@query(f"""WITH {_EL}, i AS (SELECT trial, unnest(range(80)) AS j FROM (SELECT DISTINCT trial FROM el)) SELECT i.trial, j AS t, round(v, 6) + 0.0 AS v FROM i JOIN el ON el.trial = i.trial AND el.t = CASE WHEN j < 64 THEN j ELSE 126 - j END""")
def reflect_pad(spark, d):
    out = packed(spark, d).select("trial", F.posexplode(reshape.reflect_pad("values", 80)).alias("t", "v"))
    return out.select("trial", F.col("t").cast("long").alias("t"), r6("v").alias("v"))


@query(f"WITH {_EL} SELECT trial, t - 4 AS t, round(v, 6) + 0.0 AS v FROM el WHERE t BETWEEN 4 AND 59")
def crop_pad(spark, d):
    out = packed(spark, d).select("trial", F.posexplode(reshape.crop_pad("values", 4)).alias("t", "v"))
    return out.select("trial", F.col("t").cast("long").alias("t"), r6("v").alias("v"))


@query(f"WITH {_EL} SELECT trial, round(sum(v), 6) + 0.0 AS total, count(*) AS n FROM el WHERE t BETWEEN 10 AND 20 GROUP BY trial")
def time_slice(spark, d):
    cut = packed(spark, d).select("trial", reshape.time_slice("values", 64.0, -0.25, 10 / 64 - 0.25, 20 / 64 - 0.25).alias("w"))
    return cut.select("trial", r6(F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("w").cast("long").alias("n"))


@query(f"""WITH {_EL}, p AS (SELECT trial, t, v * CASE WHEN t < 56 THEN 1 ELSE 1 - (t - 56) / 7.0::DOUBLE END AS v FROM el UNION ALL SELECT trial - 1, t + 56, v * CASE WHEN t < 8 THEN t / 7.0::DOUBLE ELSE 1 END FROM el)
SELECT trial, t, round(sum(v), 6) + 0.0 AS v FROM p WHERE trial % 2 = 0 AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = p.trial) AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = p.trial + 1) GROUP BY ALL""")
def stitch_pairs(spark, d):
    p = packed(spark, d).select("trial", "values")
    both = p.where("trial % 2 = 0").join(p.select((F.col("trial") - 1).alias("trial"), F.col("values").alias("second")), "trial")
    out = both.select("trial", F.posexplode(reshape.stitch("values", "second", 8)).alias("t", "v"))
    return out.select("trial", F.col("t").cast("long").alias("t"), r6("v").alias("v"))


@query(f"WITH {_EL} SELECT trial, CAST(floor((t - 3) / 16) AS BIGINT) AS w, round(sum(v), 6) + 0.0 AS total FROM el WHERE t >= 3 AND t < 51 GROUP BY ALL")
def chop_windows(spark, d):
    out = packed(spark, d).select("trial", F.posexplode(reshape.chop("values", 16, F.lit(3))).alias("w", "x"))
    return out.select("trial", F.col("w").cast("long").alias("w"), r6(F.aggregate("x", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {_EL}, g AS (SELECT trial, CAST(floor(t / 8) AS BIGINT) AS r, t % 8 AS c, v FROM el) SELECT a.trial, a.r, a.c, round(sum(b.v) / 9, 6) + 0.0 AS box_mean FROM g a JOIN g b ON a.trial = b.trial AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL")
def spatial_smooth(spark, d):
    grid = long(spark, d).select("trial", F.floor(F.col("t") / 8).cast("long").alias("r"), (F.col("t") % 8).alias("c"), "v")
    return reshape.box_mean(grid, "r", "c", "v", 3, 3, ["trial"]).select("trial", "r", "c", r6("box_mean").alias("box_mean"))


# ---- sampling and inference --------------------------------------------------------------------------


@query("SELECT vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 1000003, vec_id) - 1) % 5 AS BIGINT) AS fold FROM embeddings")
def stratified_kfold(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return sampling.kfold(e, "label", [(F.col("vec_id") * 7919) % 1000003, F.col("vec_id")], 5).select("vec_id", "fold")


@query("SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 104729) % 1000003, vec_id) AS r FROM embeddings) WHERE r <= 4")
def pick_without_replacement(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id")
    return sampling.pick_without_replacement(e, ["label"], [(F.col("vec_id") * 104729) % 1000003, F.col("vec_id")], 4)


@query(f"""WITH {_EL}, x AS (SELECT trial, label, t, CASE WHEN trial % 9 <> 0 OR t <> 5 THEN v END AS v FROM el), k AS (SELECT trial, label, count(v) = count(*) AS whole FROM x GROUP BY ALL),
o1 AS (SELECT label, trial AS k1, row_number() OVER (PARTITION BY label ORDER BY (trial * 7919) % 1000003, trial) - 1 AS r1, count(*) OVER (PARTITION BY label) AS n1 FROM k WHERE whole),
o2 AS (SELECT trial AS k2, row_number() OVER (ORDER BY (trial * 104729) % 1000003, trial) AS r2, count(*) OVER () AS n2 FROM k WHERE whole),
n AS (SELECT trial, label, row_number() OVER (PARTITION BY label ORDER BY (trial * 7919) % 1000003, trial) - 1 AS r FROM k WHERE NOT whole),
p AS (SELECT n.trial, n.label, k1, k2, greatest((n.trial % 10) / 10.0::DOUBLE, 1 - (n.trial % 10) / 10.0::DOUBLE) AS lam FROM n JOIN o1 ON o1.label = n.label AND o1.r1 = n.r % o1.n1 JOIN o2 ON o2.r2 = (n.r + 1) % o2.n2 + 1)
SELECT p.trial, a.t, round(lam * a.v + (1 - lam) * b.v, 6) + 0.0 AS v FROM p JOIN el a ON a.trial = k1 JOIN el b ON b.trial = k2 AND b.t = a.t
UNION ALL SELECT trial, t, round(v, 6) + 0.0 FROM x WHERE trial NOT IN (SELECT trial FROM p)""")
def mixup(spark, d):
    x = long(spark, d).withColumn("v", F.when((F.col("trial") % 9 != 0) | (F.col("t") != 5), F.col("v")))
    key = F.col("trial")
    out = sampling.mixup(x, "trial", "label", "t", "v", [(key * 7919) % 1000003, key], [(F.col("trial") * 104729) % 1000003, F.col("trial")], (key % 10) / 10.0)
    return out.select("trial", "t", r6("v").alias("v"))


N_PERM = 4000
_PERM = f"""{_EL}, tr AS (SELECT DISTINCT trial, label < 5 AS f FROM el), n AS (SELECT count(*) FILTER (f) AS n FROM tr),
sh AS (SELECT perm, trial, row_number() OVER (PARTITION BY perm ORDER BY ((trial + 1) * (7919 + 104729 * (perm + 1))) % 1000003, trial) <= (SELECT n FROM n) AS f FROM tr, (SELECT unnest(range({N_PERM})) AS perm) p),
a AS (SELECT perm, trial, f FROM sh UNION ALL SELECT -1, trial, f FROM tr)"""
_STATS = {
    "mean_diff": "avg(v) FILTER (f) - avg(v) FILTER (NOT f)",
    "welch_t": "(avg(v) FILTER (f) - avg(v) FILTER (NOT f)) / sqrt(var_samp(v) FILTER (f) / count(*) FILTER (f) + var_samp(v) FILTER (NOT f) / count(*) FILTER (NOT f))",
    "student_t": "(avg(v) FILTER (f) - avg(v) FILTER (NOT f)) / sqrt((var_samp(v) FILTER (f) * (count(*) FILTER (f) - 1) + var_samp(v) FILTER (NOT f) * (count(*) FILTER (NOT f) - 1)) / (count(*) - 2) * (1.0 / count(*) FILTER (f) + 1.0 / count(*) FILTER (NOT f)))",
}


def _perm_sql(stat: str, far: str) -> str:
    return f"""WITH {_PERM}, df AS (SELECT perm, t, round({_STATS[stat]}, 9) AS d FROM el JOIN a USING (trial) GROUP BY ALL)
SELECT d.t, round(o.d, 6) + 0.0 AS observed, round((1 + sum(CASE WHEN {far} THEN 1 ELSE 0 END)) / (1.0 + count(*)), 6)::DOUBLE AS p FROM df d JOIN df o ON o.perm = -1 AND o.t = d.t WHERE d.perm >= 0 GROUP BY d.t, o.d"""


def _cluster_sql(stat: str, far: str, key: str, axes: dict[str, str], near: str, names: str) -> str:
    """Active cells by rank, clusters by reaching from cell to cell, and each observed one against the largest of every permutation."""
    cells = ", ".join(f"{e} AS {a}" for a, e in axes.items())
    ends = ", ".join(f"min(y.{a}) AS {a}_from, max(y.{a}) AS {a}_to" for a in axes)
    return f"""WITH RECURSIVE {_PERM}, df AS (SELECT perm, t, round({_STATS[stat]}, 9) AS d FROM el JOIN a USING (trial) GROUP BY ALL),
r AS (SELECT perm, t, (row_number() OVER (PARTITION BY t ORDER BY {far}, perm) - 1)::DOUBLE / (count(*) OVER (PARTITION BY t) - 1) AS rk FROM df), o AS (SELECT perm, t, {key} AS ch, {cells} FROM r WHERE rk > 1 - 0.2),
near AS (SELECT x.perm, x.t AS s, y.t AS e FROM o x JOIN o y ON x.perm = y.perm AND x.ch = y.ch AND {near}),
reach AS (SELECT perm, t AS s, t AS e FROM o UNION SELECT reach.perm, reach.s, near.e FROM reach JOIN near ON near.perm = reach.perm AND near.s = reach.e),
c AS (SELECT y.perm, y.ch, lead, {ends}, count(*) AS size FROM (SELECT perm, e AS t, min(s) AS lead FROM reach GROUP BY ALL) g JOIN o y USING (perm, t) GROUP BY y.perm, y.ch, lead),
m AS (SELECT p.perm, k.ch, coalesce(max(size), 0) AS largest FROM (SELECT unnest(range({N_PERM})) AS perm) p CROSS JOIN (SELECT DISTINCT ch FROM o) k LEFT JOIN c ON c.perm = p.perm AND c.ch = k.ch GROUP BY ALL)
SELECT {names}, round((SELECT count(*) FROM m WHERE m.ch = c.ch AND largest >= c.size) / {N_PERM}.0, 6)::DOUBLE AS p FROM c WHERE perm = -1"""


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    trials = table(spark, d, "embeddings").select(F.col("vec_id").alias("trial"), "label")
    order = ((F.col("trial") + 1) * (7919 + 104729 * (F.col("perm") + 1))) % 1000003
    return permutation.assignments(trials, "trial", F.col("label") < 5, N_PERM, order)


def _null(spark: SparkSession, d: str, stat: str) -> DataFrame:
    return permutation.null_statistics(packed(spark, d), _assigned(spark, d), "trial", [], "values", N_PERM, stat).withColumnRenamed("index", "t")


def _p(stats: DataFrame, tails: int) -> DataFrame:
    return permutation.permutation_p(stats, ["t"], tails).select("t", r6("observed").alias("observed"), F.round(F.col("p").cast("double"), 6).alias("p"))


@query(_perm_sql("mean_diff", "d.d >= o.d"))
def permutation_test(spark, d):
    return _p(_null(spark, d, "mean_diff"), 1)


@query(_perm_sql("welch_t", "abs(d.d) >= abs(o.d)"))
def permutation_test_welch(spark, d):
    return _p(_null(spark, d, "welch_t"), 2)


@query(_perm_sql("student_t", "d.d <= o.d"))
def permutation_test_lower(spark, d):
    return _p(_null(spark, d, "student_t"), -1)


def _clusters(stats: DataFrame, axes: list[str], tails: int = 1, **options) -> DataFrame:
    return permutation.cluster_p(stats, axes, 0.2, tails, **options).withColumn("p", F.round(F.col("p").cast("double"), 6))


_LINE = {"t": "t"}
_GRID = {"freq": "t // 8", "time": "t % 8"}


@query(_cluster_sql("mean_diff", "d", "0", _LINE, "abs(x.t - y.t) = 1", "t_from AS run_start, t_to AS run_end, size AS length"))
def time_perm_cluster(spark, d):
    return _clusters(_null(spark, d, "mean_diff"), ["t"]).withColumnsRenamed({"t_from": "run_start", "t_to": "run_end", "size": "length"})


@query(_cluster_sql("welch_t", "abs(d)", "t // 32", _LINE, "abs(x.t - y.t) = 1", "ch, t_from % 32 AS t_from, t_to % 32 AS t_to, size"))
def time_perm_cluster_channels(spark, d):
    """Two channels of half a trial each, Welch's t, both tails."""
    halves = packed(spark, d).select("trial", F.posexplode(F.array(F.slice("values", 1, 32), F.slice("values", 33, 32))).alias("ch", "values")).withColumn("ch", F.col("ch").cast("long"))
    stats = permutation.null_statistics(halves, _assigned(spark, d), "trial", ["ch"], "values", N_PERM, "welch_t").withColumnRenamed("index", "t")
    return _clusters(stats, ["t"], 2, keys=["ch"])


def _grid(spark: SparkSession, d: str, stat: str) -> DataFrame:
    return _null(spark, d, stat).select("perm", F.floor(F.col("t") / 8).alias("freq"), (F.col("t") % 8).alias("time"), "stat")


@query(_cluster_sql("mean_diff", "d", "0", _GRID, "abs(x.freq - y.freq) + abs(x.time - y.time) = 1", "freq_from, freq_to, time_from, time_to, size"))
def time_frequency_cluster(spark, d):
    return _clusters(_grid(spark, d, "mean_diff"), ["freq", "time"])


@query(_cluster_sql("welch_t", "-d", "0", _GRID, "x.freq = y.freq AND abs(x.time - y.time) = 1", "freq_from, freq_to, time_from, time_to, size"))
def time_frequency_cluster_apart(spark, d):
    """No adjacency over frequencies, lower tail."""
    return _clusters(_grid(spark, d, "welch_t"), ["freq", "time"], -1, ignored=("freq",))


@query("SELECT * FROM (VALUES (0, 1), (0, -1)) AS s(freq, time)")
def cluster_structure(spark, d):
    return spark.createDataFrame([tuple(x) for x in permutation.neighbours(["freq", "time"], ("freq",)).tolist()], "freq int, time int")


@query(f"""WITH {_EL}, c AS (SELECT label, t, avg(v) AS m FROM el GROUP BY ALL), s AS (SELECT trial, el.label AS y_true, c.label AS y_pred, sum(el.v * c.m) / sqrt(sum(el.v * el.v) * sum(c.m * c.m)) AS cosine FROM el JOIN c USING (t) GROUP BY ALL),
b AS (SELECT trial, y_true, y_pred, row_number() OVER (PARTITION BY trial ORDER BY round(cosine, 9) DESC, y_pred) AS r FROM s) SELECT y_true, y_pred, count(*) AS n FROM b WHERE r = 1 GROUP BY ALL""")
def template_decode(spark, d):
    return statistics.confusion(decoding.template_decode(long(spark, d), "trial", "label", "t", "v"), "y_true", "y_pred")
