"""Queries of the trial-level operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwave.operators import decoding, permutation, statistics, trials, windows
from loomwave.plans.signals import _EL, _PERM, N_PERM, _assigned, events, long, packed, r6
from loomwave.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query("""WITH d AS (SELECT user_id, event_type, event_id, value - (regr_intercept(value, event_id) OVER w + regr_slope(value, event_id) OVER w * event_id) AS x FROM events WINDOW w AS (PARTITION BY user_id, event_type)),
p AS (SELECT user_id, event_type, max(abs(x)) AS peak FROM d GROUP BY ALL), s AS (SELECT user_id, stddev_samp(x) AS sd FROM d GROUP BY user_id) SELECT event_id FROM d JOIN p USING (user_id, event_type) JOIN s USING (user_id) WHERE peak < 2 * sd""")
def remove_bad_trials(spark, d):
    return trials.keep_trials(table(spark, d, "events"), "user_id", "event_type", "event_id", "value", 2.0).select("event_id")


@query("SELECT l_orderkey, l_linenumber, round(coalesce((CASE WHEN l_quantity > 2 THEN l_extendedprice END - l_discount) / 30000.0, 0), 6)::DOUBLE AS rt FROM lineitem WHERE coalesce((CASE WHEN l_quantity > 2 THEN l_extendedprice END - l_discount) / 30000.0, 0) >= 0.1")
def response_filter(spark, d):
    li = table(spark, d, "lineitem").withColumn("response", F.when(F.col("l_quantity") > 2, F.col("l_extendedprice")))
    return trials.response_times(li, "l_discount", "response", 30000.0, 0.1).select("l_orderkey", "l_linenumber", F.round("rt", 6).alias("rt"))


@query("SELECT o.event_id AS onset, s.event_id AS sample, s.event_id - o.event_id AS rel FROM events o JOIN events s ON s.event_id >= o.event_id - 5 AND s.event_id < o.event_id + 10 WHERE o.event_type = 'signup'")
def split_by_sample(spark, d):
    ev = table(spark, d, "events")
    onsets = ev.where("event_type = 'signup'").select(F.col("event_id").alias("onset"))
    return trials.split_by_sample(ev.select(F.col("event_id").alias("sample")), onsets, "sample", "onset", 5, 10).select("onset", "sample", "rel")


@query("""WITH i AS (SELECT file_id, event_id, CAST(round(onset * 1000) AS BIGINT) AS a, CAST(round(onset * 1000) AS BIGINT) + CAST(round(duration * 1000) AS BIGINT) AS b FROM (SELECT DISTINCT file_id, event_id, onset, duration, trial_type FROM task_events) WHERE trial_type = 'go' AND duration > 0 AND onset IS NOT NULL),
s AS (SELECT file_id, event_id, CAST(round(onset * 1000) AS BIGINT) AS t FROM (SELECT DISTINCT file_id, event_id, onset, trial_type FROM task_events) WHERE trial_type = 'stop' AND onset IS NOT NULL)
SELECT i.event_id AS go, s.event_id AS stop FROM i JOIN s ON i.file_id = s.file_id AND t >= a AND t < b""")
def segments_by_label(spark, d):
    ev = table(spark, d, "task_events").select("file_id", "event_id", "trial_type", F.round(F.col("onset") * 1000).cast("long").alias("t"), F.round(F.col("duration") * 1000).cast("long").alias("n")).distinct()
    go = ev.where("trial_type = 'go' and n > 0 and t is not null").select("file_id", F.col("event_id").alias("go"), F.col("t").alias("a"), (F.col("t") + F.col("n")).alias("b"))
    stop = ev.where("trial_type = 'stop' and t is not null").select("file_id", F.col("event_id").alias("stop"), "t")
    return trials.within_intervals(stop, go, ["file_id"], "t", "a", "b", 5000.0).select("go", "stop")


@query("SELECT CAST(floor(floor(user_id / 10) / 3) AS BIGINT) AS tile_row, CAST(floor((user_id % 10) / 2) AS BIGINT) AS tile_col, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def spatial_average(spark, d):
    ev = table(spark, d, "events").withColumn("r", F.floor(F.col("user_id") / 10)).withColumn("c", F.col("user_id") % 10)
    return trials.tile_average(ev, "r", "c", "value", 3, 2, []).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {_EL}, c AS (SELECT CAST(floor(trial / 8) AS BIGINT) AS e, trial % 8 AS ch, t, v FROM el), m AS (SELECT *, avg(v) OVER (PARTITION BY e, t) AS m FROM c), g AS (SELECT e, ch, sum(v * m) / nullif(sum(m * m), 0) AS g FROM m GROUP BY ALL)
SELECT e, ch, t, round(v - g * m, 6) + 0.0 AS referenced FROM m JOIN g USING (e, ch)""")
def reference_by_regression(spark, d):
    el = long(spark, d).select(F.floor(F.col("trial") / 8).alias("e"), (F.col("trial") % 8).alias("ch"), "t", "v")
    return trials.regress_reference(el, ["e"], "ch", "t", "v").select("e", "ch", "t", r6("referenced").alias("referenced"))


@query()
def reference_by_wavelet_regression(spark, d):
    p = packed(spark, d).select(F.floor(F.col("trial") / 8).alias("e"), (F.col("trial") % 8).alias("ch"), "values")
    return trials.local_regression_reference(p, ["e"], "ch", "values", 4)


@query(f"""WITH {_PERM}, w AS (SELECT a.perm, avg(m) FILTER (f) - avg(m) FILTER (NOT f) AS diff FROM a JOIN (SELECT trial, avg(v) AS m FROM el WHERE t BETWEEN 8 AND 24 GROUP BY trial) USING (trial) GROUP BY a.perm)
SELECT round(o.diff, 6) + 0.0 AS observed, round((1 + count(*) FILTER (round(w.diff, 9) >= round(o.diff, 9))) / (1.0 + count(*)), 6)::DOUBLE AS p FROM w JOIN w o ON o.perm = -1 WHERE w.perm >= 0 GROUP BY o.diff""")
def window_averaged_shuffle(spark, d):
    means = packed(spark, d).select("trial", F.array(F.aggregate(F.slice("values", 9, 17), F.lit(0.0), lambda a, x: a + x) / 17).alias("values"))
    stats = permutation.null_statistics(means, _assigned(spark, d), "trial", [], "values", N_PERM)
    return permutation.permutation_p(stats, ["index"]).select(r6("observed").alias("observed"), F.round(F.col("p").cast("double"), 6).alias("p"))


_P = "p AS (SELECT user_id, (user_id * 37 % 151) / 1000.0::DOUBLE AS p FROM (SELECT DISTINCT user_id FROM events))"


def _p_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct().withColumn("p", (F.col("user_id") * 37 % 151) / 1000.0)


@query(f"WITH {_P}, q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, user_id) AS q FROM p) SELECT user_id, round(least(min(q) OVER (ORDER BY p DESC, user_id DESC ROWS UNBOUNDED PRECEDING), 1.0), 6)::DOUBLE AS p_adjusted FROM q")
def correct_fdr(spark, d):
    return trials.adjust_p(_p_values(spark, d), "p", "user_id").select("user_id", F.round("p_adjusted", 6).alias("p_adjusted"))


@query(f"WITH {_P} SELECT user_id, round(least(p * count(*) OVER (), 1.0), 6)::DOUBLE AS p_adjusted FROM p")
def correct_bonferroni(spark, d):
    return trials.adjust_p(_p_values(spark, d), "p", "user_id", "bonferroni").select("user_id", F.round("p_adjusted", 6).alias("p_adjusted"))


@query(f"WITH {_P}, n AS (SELECT *, row_number() OVER (ORDER BY user_id) AS i FROM p), f AS (SELECT *, i - row_number() OVER (ORDER BY user_id) AS g FROM n WHERE p < 0.1) SELECT min(user_id) AS run_start, max(user_id) AS run_end, count(*) AS length, round(min(p), 6)::DOUBLE AS least_p FROM f GROUP BY g")
def significant_runs(spark, d):
    return trials.significant_runs(_p_values(spark, d).withColumn("k", F.lit(0)), ["k"], "user_id", "p", 0.1).select("run_start", "run_end", "length", F.round("least_p", 6).alias("least_p"))


@query("""WITH c AS (SELECT DISTINCT event_type AS a FROM events), pr AS (SELECT x.a AS first, y.a AS second FROM c x, c y WHERE x.a < y.a),
q AS (SELECT user_id % 5 AS ch, first, second, event_type = first AS one, value AS x FROM events JOIN pr ON event_type IN (first, second)),
r AS (SELECT *, rank() OVER (PARTITION BY ch, first, second ORDER BY x) + (count(*) OVER (PARTITION BY ch, first, second, x) - 1) / 2.0 AS rk FROM q),
s AS (SELECT ch, first, second, sum(rk) FILTER (one)::DOUBLE AS r, count(*) FILTER (one)::DOUBLE AS n1, count(*) FILTER (NOT one)::DOUBLE AS n2 FROM r GROUP BY ALL)
SELECT ch, first, second, round((r - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) + 0.0 AS z FROM s""")
def pairwise_rank_sum(spark, d):
    ev = table(spark, d, "events").select((F.col("user_id") % 5).alias("ch"), "event_type", "value")
    return trials.pairwise_rank_sum(ev, "ch", "event_type", "value").select("ch", "first", "second", r6("z").alias("z"))


@query("""WITH c AS (SELECT o_orderstatus AS a, CASE WHEN o_totalprice > 150000 THEN 'F' WHEN o_totalprice > 50000 THEN 'O' ELSE 'P' END AS b FROM orders), h AS (SELECT *, CASE WHEN a = b THEN 0 WHEN 'O' IN (a, b) THEN 1 ELSE 2 END AS w FROM c)
SELECT CAST(sum(w) AS BIGINT) AS error, count(*) AS n FROM h""")
def distance_error(spark, d):
    price = F.col("o_totalprice")
    p = table(spark, d, "orders").select(F.col("o_orderstatus").alias("t"), F.when(price > 150000, "F").when(price > 50000, "O").otherwise("P").alias("p"))
    codes = spark.createDataFrame([("F", [0, 0]), ("O", [0, 1]), ("P", [1, 1])], "label string, code array<int>")
    return trials.hamming_error(statistics.confusion(p, "t", "p"), codes).select(F.col("error").cast("long").alias("error"), "n")


@query("SELECT c_custkey, round((least(greatest(c_acctbal, 0), 5000) - 0) / 5000.0, 6)::DOUBLE AS weight FROM customer")
def clip_weights(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(trials.clip_scale(F.col("c_acctbal"), 0.0, 5000.0), 6).alias("weight"))


@query("SELECT l_returnflag, min(l_linenumber) FILTER (rnk = 1)::BIGINT AS best, round(min(m), 4) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY m, l_linenumber) AS rnk FROM (SELECT l_returnflag, l_linenumber, round(avg(l_extendedprice), 4) AS m FROM lineitem GROUP BY ALL)) GROUP BY l_returnflag")
def best_parameter(spark, d):
    losses = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("l_extendedprice"), 4).alias("m"))
    return decoding.best_parameter(losses, ["l_returnflag"], "l_linenumber", "m").withColumn("best", F.col("best").cast("long"))


@query(f"WITH {_EL} SELECT trial, label, t, round(v, 6) + 0.0 AS v FROM el")
def nested_round_trip(spark, d):
    el = long(spark, d).select("trial", F.col("label").cast("string").alias("label"), F.col("t").cast("string").alias("t"), "v")
    flat = trials.flatten_nested(trials.to_nested(el, ["trial"], ["label", "t"], "v", "tree"), "tree", ["label", "t"])
    return flat.select("trial", F.col("label").cast("int").alias("label"), F.col("t").cast("long").alias("t"), r6("value").alias("v"))


@query(f"""WITH {_EL}, x AS (SELECT lag(v, 2) OVER w AS a, lag(v, 1) OVER w AS b, v AS c, 2 * v + coalesce(lag(v, 1) OVER w, 0) AS y FROM el WINDOW w AS (PARTITION BY trial ORDER BY t)),
m AS (SELECT var_pop(a) + 0.1 / count(*) AS aa, var_pop(b) + 0.1 / count(*) AS bb, var_pop(c) + 0.1 / count(*) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my FROM x WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
w AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS wa, (aa * (by_ * cc - cy * bc) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS wb, (aa * (bb * cy - bc * by_) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS wc FROM s)
SELECT unnest(['lag_2', 'lag_1', 'now', 'intercept']) AS name, unnest([round(wa, 4) + 0.0, round(wb, 4) + 0.0, round(wc, 4) + 0.0, round(my - wa * ma - wb * mb - wc * mc, 4) + 0.0]) AS weight FROM w""")
def lag_model(spark, d):
    el = long(spark, d).withColumn("y", F.col("v") * 2 + F.coalesce(F.lag("v", 1).over(windows.Window.partitionBy("trial").orderBy("t")), F.lit(0.0)))
    w = trials.lag_model(el, ["trial"], "t", "v", "y", 2, 0.1)
    return spark.createDataFrame([(k, round(v, 4) + 0.0) for k, v in w.items()], "name string, weight double")


@query()
def grid_search(spark, d):
    models = {"keep50": lambda: decoding.PcaDiscriminant(0.5), "keep90": lambda: decoding.PcaDiscriminant(0.9), "bayes": decoding.GaussianBayes}
    return trials.grid_search(packed(spark, d), "trial", "label", "values", models, 4, 7)


@query()
def decode_across_sources(spark, d):
    p = packed(spark, d)
    return trials.decode_across_sources([p.where("trial % 2 = 0"), p.where("trial % 2 = 1")], "trial", "label", "values", 0, decoding.PcaDiscriminant, 4, 7)


@query("WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, value FROM events), m AS (SELECT day, median(value) AS m, quantile_cont(value, 0.9) AS q FROM e GROUP BY day) SELECT CAST(day AS VARCHAR) AS day, round(m, 6) AS median, round(q, 6) AS p90 FROM m")
def percentile_by_day(spark, d):
    ev = events(spark, d).withColumn("day", F.col("ts").cast("date").cast("string"))
    return ev.groupBy("day").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", 0.9), 6).alias("p90"))
