"""Queries of label functions, sources, streaming windows, spectral kernels, decoders and alignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwave.functions import labels
from loomwave.operators import alignment, decoding, frames, hooks, reshape, sampling, spectral, statistics, windows
from loomwave.plans.signals import _EL, events, long, packed, r6
from loomwave.sources import recordings
from loomwave.streaming import signals as streams
from loomwave.session import ensure_checkpoint_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- sources and labels ------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT filename, nullif(regexp_extract(regexp_extract(filename, '[^/]+$'), '(^|_)sub-([A-Za-z0-9]+)', 2), '') AS subject, nullif(regexp_extract(regexp_extract(filename, '[^/]+$'), '(^|_)ses-([A-Za-z0-9]+)', 2), '') AS session,
  nullif(regexp_extract(regexp_extract(filename, '[^/]+$'), '(^|_)task-([A-Za-z0-9]+)', 2), '') AS task, nullif(regexp_extract(regexp_extract(filename, '[^/]+$'), '(^|_)run-([A-Za-z0-9]+)', 2), '') AS run,
  nullif(regexp_extract(filename, '_([A-Za-z0-9]+)\.[A-Za-z0-9.]+$', 1), '') AS suffix FROM scans""")
def file_catalog(spark, d):
    return recordings.catalog(table(spark, d, "scans").select("filename").distinct(), "filename").select("filename", "subject", "session", "task", "run", "suffix")


@query("SELECT max(filename) AS filename FROM scans WHERE regexp_matches(filename, 'task-phon')")
def latest_recording(spark, d):
    return recordings.latest_match(table(spark, d, "scans"), "task-phon", "filename")


@query("""WITH p AS (SELECT p_partkey, p_size, p_partkey % 6 AS u FROM part) SELECT p_partkey, round(p_size * CASE u WHEN 0 THEN 1e-6 WHEN 1 THEN 1e-3 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 60 END, 9)::DOUBLE AS seconds,
  greatest(CAST(ceil(round(p_size * CASE u WHEN 0 THEN 1e-6 WHEN 1 THEN 1e-3 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 60 END * 2048, 9)) AS BIGINT), 1) AS samples FROM p""")
def durations(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("us", "ms", "s", "sec", "m", "min"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), unit)
    return table(spark, d, "part").select("p_partkey", F.round(labels.duration_seconds(text), 9).alias("seconds"), labels.duration_samples(text, 2048.0).alias("samples"))


@query("SELECT DISTINCT subject, regexp_replace(replace(subject, 'sub-', ''), '^([A-Za-z]+)0*([0-9]+).*$', '\\1\\2') AS short FROM task_events")
def short_subjects(spark, d):
    return table(spark, d, "task_events").select("subject", labels.short_subject(F.replace("subject", F.lit("sub-"), F.lit(""))).alias("short")).distinct()


@query("SELECT s_suppkey, CAST(dense_rank() OVER (ORDER BY regexp_replace(n_name || s_suppkey, '[0-9 ]', '', 'g')) - 1 AS BIGINT) AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def group_channels(spark, d):
    named = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return windows.dense_classes(named.select("s_suppkey", labels.shank(F.concat("n_name", "s_suppkey")).alias("shank")), "shank", "grp").select("s_suppkey", "grp")


@query("SELECT p_partkey, CAST(p_partkey % 9 + 1 AS BIGINT) AS phoneme, CAST(CASE p_partkey % 9 + 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 8 THEN 4 WHEN 9 THEN 4 ELSE 3 END AS BIGINT) AS articulator FROM part")
def phoneme_classes(spark, d):
    name = F.element_at(F.array(*map(F.lit, labels.PHONEMES)), (F.col("p_partkey") % 9 + 1).cast("int"))
    number = labels.lookup(name, labels.PHONEMES)
    return table(spark, d, "part").select("p_partkey", number.cast("long").alias("phoneme"), labels.lookup(number, labels.ARTICULATORS).cast("long").alias("articulator"))


_RANKED = "r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Unknown' ELSE n_name END AS a, CASE WHEN s_suppkey % 2 = 0 THEN 'White-Matter' ELSE 'gyrus' END AS b, (s_suppkey % 10) / 100.0 AS pb FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    entry = lambda label, pct: F.struct(label.alias("label"), pct.cast("double").alias("pct"))
    k = F.col("s_suppkey")
    ranked = F.array(entry(F.when(k % 3 == 0, "Unknown").otherwise(F.col("n_name")), F.lit(0.5)), entry(F.when(k % 2 == 0, "White-Matter").otherwise("gyrus"), (k % 10) / 100.0), entry(F.lit("sulcus"), F.lit(0.06)))
    return s.select("s_suppkey", ranked.alias("ranked"))


@query(f"WITH {_RANKED} SELECT s_suppkey, CASE WHEN a <> 'Unknown' THEN a WHEN b = 'gyrus' AND pb > 0.05 THEN b ELSE 'sulcus' END AS label FROM r")
def pick_labels(spark, d):
    return _ranked(spark, d).select("s_suppkey", labels.pick_label(F.col("ranked"), 0.05).alias("label"))


@query(f"WITH {_RANKED} SELECT s_suppkey, CASE WHEN a LIKE '%gyr%' THEN a WHEN b = 'gyrus' AND pb > 0.03 THEN b WHEN a <> 'Unknown' THEN a WHEN b = 'gyrus' AND pb > 0.05 THEN b ELSE 'sulcus' END AS label FROM r")
def find_labels(spark, d):
    return _ranked(spark, d).select("s_suppkey", labels.find_label(F.col("ranked"), ("gyr",), 0.03).alias("label"))


@query("SELECT c_custkey, CASE WHEN n_name LIKE 'L%' THEN 'left' WHEN n_name LIKE 'R%' THEN 'right' WHEN c_acctbal < 0 THEN 'left' ELSE 'right' END AS side FROM customer JOIN nation ON c_nationkey = n_nationkey")
def hemispheres(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", labels.hemisphere(F.col("n_name"), F.col("c_acctbal")).alias("side"))


@query("SELECT s_suppkey, round(0.5 * s_acctbal - 2 * s_nationkey + 3, 6) + 0.0 AS x, round(s_nationkey + 1.5 * s_suppkey, 6) + 0.0 AS y, round(-1.0 * s_suppkey + 10, 6) + 0.0 AS z FROM supplier")
def affine_frame(spark, d):
    s = table(spark, d, "supplier")
    x, y, z = labels.affine(F.col("s_acctbal"), F.col("s_nationkey"), F.col("s_suppkey"), [[0.5, -2.0, 0.0, 3.0], [0.0, 1.0, 1.5, 0.0], [0.0, 0.0, -1.0, 10.0]])
    return s.select("s_suppkey", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query("""WITH c AS (SELECT user_id AS ch, CAST(floor(user_id / 10) AS BIGINT) AS row, user_id % 10 AS col FROM (SELECT DISTINCT user_id FROM events)), m AS (SELECT user_id AS ch, avg(value) AS v FROM events GROUP BY user_id)
SELECT row, round(avg(v) FILTER (col = 0), 6) AS c0, round(avg(v) FILTER (col = 5), 6) AS c5 FROM c LEFT JOIN m USING (ch) GROUP BY row""")
def channel_grid(spark, d):
    ev = table(spark, d, "events")
    m = ev.groupBy(F.col("user_id").alias("ch")).agg(F.avg("value").alias("v"))
    grid = ev.select(F.col("user_id").alias("ch")).distinct().select("ch", F.floor(F.col("ch") / 10).alias("row"), (F.col("ch") % 10).alias("col"))
    return reshape.to_grid(m, grid, "ch", "v", [0, 5]).select("row", F.round("0", 6).alias("c0"), F.round("5", 6).alias("c5"))


@query("""WITH p AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), i AS (SELECT *, unnest(range(1, len(n_name) + 1)) AS a FROM p), c AS (SELECT *, unnest(range(1, len(n_name) - a + 2)) AS l FROM i),
m AS (SELECT n_name, r_name, n_name[a:a + l - 1] AS s, row_number() OVER (PARTITION BY n_name ORDER BY l DESC, a) AS r FROM c WHERE contains(r_name, n_name[a:a + l - 1])) SELECT n_name, r_name, coalesce(s, '') AS common FROM p LEFT JOIN m USING (n_name, r_name) WHERE coalesce(r, 1) = 1""")
def common_substrings(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", "r_name", labels.common_substring("n_name", "r_name").alias("common"))


@query()
def upper_tails(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", labels.chi2_upper(F.abs("s_acctbal") / 1000, F.lit(3.0)).alias("p"), labels.normal_z((F.col("s_suppkey") % 99 + 1) / 100.0).alias("z"))


# ---- event-time windows ------------------------------------------------------------------------------


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL")
def window_statistics(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = streams.windowed_statistics(ev, "ts", ["event_type"], "value", "6 hours")
    return out.select((F.unix_date(F.col("start").cast("date")).cast("long") * 86400000000 + F.hour("start").cast("long") * 3600000000).alias("start_us"), "event_type", F.round("mean", 6).alias("mean"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL""")
def session_windows(spark, d):
    return streams.sessions(table(spark, d, "events"), "ts", ["user_id"], "6 hours").groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


# ---- spectral kernels --------------------------------------------------------------------------------


def _kernel(spark: SparkSession, d: str, kernel: Callable[[np.ndarray], np.ndarray], nested: bool = False) -> DataFrame:
    """trial, (row,) t, v: a kernel's result for every packed row, as long rows."""
    out = spectral.per_row(packed(spark, d), "values", "out", kernel, nested).select("trial", F.posexplode("out").alias("row" if nested else "t", "v"))
    if nested:
        out = out.select("trial", F.col("row").cast("long").alias("row"), F.posexplode("v").alias("t", "v"))
    return out.withColumns({"t": F.col("t").cast("long"), "v": r6("v")})


def _spectral(kernel: Callable[[np.ndarray], np.ndarray], nested: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _kernel(spark, d, kernel, nested)


QUERIES |= {
    "line_filter": _spectral(lambda x: spectral.line_filter(x, 64.0, [16.0], 64, 4)),
    "band_envelope": _spectral(lambda x: spectral.band_envelope(x, 64.0, 4, 16)),
    "hilbert_spectrogram": _spectral(lambda x: spectral.bank_envelopes(x, 64.0, 4, 16), nested=True),
    "wavelet_scaleogram": _spectral(lambda x: spectral.scaleogram(x, 64.0, 4, 30, decim=2), nested=True),
    "superlets": _spectral(lambda x: spectral.superlets(x, 64.0, np.arange(6.0, 24.0, 3.0), 2, (1, 3.5)), nested=True),
    "multitaper_spectrogram": _spectral(lambda x: spectral.multitaper_power(x, 64.0, np.arange(6.0, 24.0, 3.0), np.arange(6.0, 24.0, 3.0) / 2), nested=True),
    "welch_density": _spectral(lambda x: spectral.welch(x, 64.0, 32)),
    "notch": _spectral(lambda x: spectral.notch(x, 64.0, 16.0)),
    "band_power": _spectral(lambda x: spectral.band_power(x, 64.0, 8.0, 16.0)),
    "travelling_power": _spectral(lambda x: spectral.smoothed_log_power(x, 64.0, 8.0, 16.0, 0.02, 16)),
    "mode_powers": _spectral(lambda x: spectral.mode_powers(x, 3)),
    "trigger_lag": _spectral(lambda x: spectral.cross_correlation_lag(x, np.hanning(16))),
}
#: The discrete Fourier transform of every trial (64 samples at 64 Hz, so that k counts Hz).
_DFT = f"{_EL}, ft AS (SELECT trial, k, sum(v * cos(2 * pi() * k * t / 64)) AS re, -sum(v * sin(2 * pi() * k * t / 64)) AS im FROM el, (SELECT unnest(range(64)) AS k) GROUP BY ALL)"
#: Back to samples with the gains `g` of each row and frequency.
_BACK = "y AS (SELECT trial, row, t, sqrt(sum(g * (re * cos(2 * pi() * k * t / 64) - im * sin(2 * pi() * k * t / 64))) ** 2 + sum(g * (re * sin(2 * pi() * k * t / 64) + im * cos(2 * pi() * k * t / 64))) ** 2) / 64 AS a FROM ft JOIN gain USING (k), (SELECT unnest(range(64)) AS t) GROUP BY ALL)"
_BANK = f"""WITH RECURSIVE c AS (SELECT 0.018::DOUBLE AS f UNION ALL SELECT CASE WHEN f < 4 THEN f + 0.39 * sqrt(f) ELSE f * 2 ** (1 / 7.0::DOUBLE) END FROM c WHERE f < 16), b AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS row FROM c WHERE f BETWEEN 4 AND 16),
gain AS (SELECT row, k, exp(-0.5 * ((k - f) / (0.39 * sqrt(f) * sqrt(2))) ** 2) * CASE WHEN k = 32 THEN 1 ELSE 2 END AS g FROM b, (SELECT unnest(range(1, 33)) AS k)), {_DFT}, {_BACK}"""
_SCALES = f"""WITH s AS (SELECT 2 ** (0.2 * j) / 33.0::DOUBLE AS s FROM (SELECT unnest(range(0, 26)) AS j)), w AS (SELECT s, row_number() OVER (ORDER BY s DESC) - 1 AS row FROM s WHERE 1 / (4 * pi() / (6 + sqrt(38)) * s) >= 4),
gain AS (SELECT row, k, sqrt(s * 2 * pi() * 64 / 64) * pi() ** -0.25 * 8 * sqrt(2) * exp(-((s * 2 * pi() * k - 6) ** 2) / 2) AS g FROM w, (SELECT unnest(range(1, 32)) AS k)), {_DFT}, {_BACK}"""
ORACLE |= {
    "hilbert_spectrogram": f"{_BANK} SELECT trial, row, t, round(a, 6) + 0.0 AS v FROM y",
    "band_envelope": f"{_BANK} SELECT trial, t, round(sum(a), 6) + 0.0 AS v FROM y GROUP BY ALL",
    "wavelet_scaleogram": f"{_SCALES} SELECT trial, row, t // 2 AS t, round(a, 6) + 0.0 AS v FROM y WHERE t % 2 = 0",
    "band_power": f"WITH {_DFT} SELECT trial, 0::BIGINT AS t, round(log10(avg((re * re + im * im) / 64)), 6) + 0.0 AS v FROM ft WHERE k BETWEEN 8 AND 16 GROUP BY trial",
    "welch_density": f"""WITH {_EL}, w AS (SELECT unnest([0, 16, 32]) AS s), p AS (SELECT trial, s, t - s AS i, (v - avg(v) OVER (PARTITION BY trial, s)) * (0.5 - 0.5 * cos(2 * pi() * (t - s) / 32)) AS x FROM el JOIN w ON t BETWEEN s AND s + 31),
f AS (SELECT trial, s, k, (sum(x * cos(2 * pi() * k * i / 32)) ** 2 + sum(x * sin(2 * pi() * k * i / 32)) ** 2) / (64 * 12) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS p FROM p, (SELECT unnest(range(17)) AS k) GROUP BY trial, s, k)
SELECT trial, k AS t, round(avg(p), 6) + 0.0 AS v FROM f GROUP BY ALL""",
    "travelling_power": f"""WITH {_DFT}, gain AS (SELECT 0 AS row, k, 2.0::DOUBLE AS g FROM (SELECT unnest(range(8, 17)) AS k)), {_BACK},
q AS (SELECT trial, k, sum(a * a * cos(2 * pi() * k * t / 64)) AS re, -sum(a * a * sin(2 * pi() * k * t / 64)) AS im FROM y, (SELECT unnest(range(64)) AS k) GROUP BY ALL),
z AS (SELECT trial, t, log10(greatest(sum(exp(-2 * (pi() * least(k, 64 - k) * 0.02) ** 2) * (re * cos(2 * pi() * k * t / 64) - im * sin(2 * pi() * k * t / 64))) / 64, 1e-300)) AS l FROM q, (SELECT unnest(range(64)) AS t) GROUP BY ALL)
SELECT trial, t, round((l - avg(l) FILTER (t < 16) OVER (PARTITION BY trial)) / greatest(stddev_samp(l) FILTER (t < 16) OVER (PARTITION BY trial), 1e-12), 6) + 0.0 AS v FROM z""",
    "trigger_lag": f"""WITH {_EL}, c AS (SELECT trial, lag, sum(v * (0.5 - 0.5 * cos(2 * pi() * (t - lag) / 15))) AS c FROM el, (SELECT unnest(range(-15, 64)) AS lag) WHERE t - lag BETWEEN 0 AND 15 GROUP BY ALL)
SELECT trial, 0::BIGINT AS t, max_by(lag, c)::DOUBLE AS v FROM c GROUP BY trial""",
    "superlets": f"""WITH {_EL}, f AS (SELECT i AS row, 6.0::DOUBLE + 3 * i AS f, 1 + 0.5::DOUBLE * i AS o FROM (SELECT unnest(range(6)) AS i)),
w AS (SELECT row, f, o, k, CAST(floor(round_even(2.0 * k / 2 / f / 2.5 * 64 * 6, 0) / 2) AS BIGINT) AS h, CASE WHEN k <= floor(o) THEN 1 ELSE o - floor(o) END AS share FROM f, (SELECT unnest(range(1, 5)) AS k) WHERE k <= ceil(o)),
m AS (SELECT row, o, k, share, j, exp(-((j * 3.0 / greatest(h, 1)) ** 2) / 2) / sum(exp(-((j * 3.0 / greatest(h, 1)) ** 2) / 2)) OVER (PARTITION BY row, k) AS g, 2 * pi() * f * j / 64 AS ph FROM (SELECT *, unnest(range(-h, h + 1)) AS j FROM w)),
p AS (SELECT trial, row, o, k, share, t + j AS t, 2 * (sum(v * g * cos(ph)) ** 2 + sum(v * g * sin(ph)) ** 2) AS p FROM el, m WHERE t + j BETWEEN 0 AND 63 GROUP BY ALL)
SELECT trial, row, t, round(exp(sum(share * ln(greatest(p, 1e-300))) / o), 6) + 0.0 AS v FROM p GROUP BY trial, row, o, t""",
    "notch": f"""WITH RECURSIVE {_EL}, n AS (SELECT sin(pi() / 2) / 60 AS al, cos(pi() / 2) AS co), k AS (SELECT 1 / (1 + al) AS b0, -2 * co / (1 + al) AS b1, 1 / (1 + al) AS b2, -2 * co / (1 + al) AS a1, (1 - al) / (1 + al) AS a2 FROM n),
x AS (SELECT trial, t + 30 AS i, v FROM el UNION ALL SELECT e.trial, 30 - e.t, 2 * z.v - e.v FROM el e JOIN el z ON z.trial = e.trial AND z.t = 0 WHERE e.t BETWEEN 1 AND 30 UNION ALL SELECT e.trial, 156 - e.t, 2 * z.v - e.v FROM el e JOIN el z ON z.trial = e.trial AND z.t = 63 WHERE e.t BETWEEN 33 AND 62),
g AS (SELECT *, (b0 + b1 + b2) / (1 + a1 + a2) AS gain FROM k),
f AS (SELECT trial, 0::BIGINT AS i, b0 * v + v * (gain - b0) AS y, b1 * v - a1 * (b0 * v + v * (gain - b0)) + v * (b2 - a2 * gain) AS z1, b2 * v - a2 * (b0 * v + v * (gain - b0)) AS z2 FROM x, g WHERE i = 0
  UNION ALL SELECT f.trial, f.i + 1, b0 * v + z1, b1 * v - a1 * (b0 * v + z1) + z2, b2 * v - a2 * (b0 * v + z1) FROM f JOIN x ON x.trial = f.trial AND x.i = f.i + 1, g),
r AS (SELECT trial, 123 - i AS i, y AS v FROM f),
s AS (SELECT trial, 0::BIGINT AS i, b0 * v + v * (gain - b0) AS y, b1 * v - a1 * (b0 * v + v * (gain - b0)) + v * (b2 - a2 * gain) AS z1, b2 * v - a2 * (b0 * v + v * (gain - b0)) AS z2 FROM r, g WHERE i = 0
  UNION ALL SELECT s.trial, s.i + 1, b0 * v + z1, b1 * v - a1 * (b0 * v + z1) + z2, b2 * v - a2 * (b0 * v + z1) FROM s JOIN r ON r.trial = s.trial AND r.i = s.i + 1, g)
SELECT trial, 93 - i AS t, round(y, 6) + 0.0 AS v FROM s WHERE i BETWEEN 30 AND 93""",
}


@query(f"""{_SCALES}, pk AS (SELECT trial, label, max(abs(v)) AS peak FROM el GROUP BY ALL), st AS (SELECT label, avg(v) AS c, stddev_pop(v) AS d FROM el GROUP BY label),
ok AS (SELECT trial, label FROM pk JOIN st USING (label) WHERE peak < d * 6 + c), r AS (SELECT label, row AS scale, t - 4 AS t, a FROM y JOIN ok USING (trial) WHERE t BETWEEN 4 AND 59),
b AS (SELECT label, scale, avg(a) AS m FROM r WHERE t < 12 GROUP BY ALL) SELECT label, scale, t, round(20 * log10(avg(a / m)), 6) + 0.0 AS db FROM r JOIN b USING (label, scale) WHERE t >= 12 GROUP BY ALL""")
def wavelet_baseline_ratio(spark, d):
    """The pipeline: outliers to null, wavelets, crop, ratio to the baseline, decibels per class."""
    keep = statistics.keep_inliers(long(spark, d), ["label"], "trial", "v", 6.0)
    clean = packed(spark, d).join(keep.where("keep").select("trial"), "trial", "left_semi")
    tf = spectral.per_row(clean, "values", "tf", lambda x: spectral.scaleogram(x, 64.0, 4, 30), nested=True).drop("values")
    rows = tf.select("trial", "label", F.posexplode("tf").alias("scale", "power")).select("trial", "label", "scale", F.posexplode(reshape.crop_pad("power", 4)).alias("t", "v"))
    ratio = statistics.rescale(rows.where("t >= 12"), rows.where("t < 12"), ["label", "scale"], "v", ["ratio"])
    db = ratio.groupBy("label", "scale", "t").agg(r6(20 * F.log10(F.avg("ratio"))).alias("db"))
    return db.withColumns({"scale": F.col("scale").cast("long"), "t": F.col("t").cast("long")})


# ---- decoders and alignment --------------------------------------------------------------------------


def _mean(values: str, start: int, n: int):
    return F.aggregate(F.slice(values, start, n), F.lit(0.0), lambda a, x: a + x) / n


@query(f"""WITH {_EL}, f AS (SELECT trial, label, avg(v) FILTER (t < 32) AS x, avg(v) FILTER (t >= 32) AS y FROM el GROUP BY ALL), n AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM f),
m AS (SELECT label, avg(x) AS mx, avg(y) AS my, count(*) AS c, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy, covar_pop(x, y) * count(*) AS sxy FROM f GROUP BY label),
s AS (SELECT sum(sxx) / (any_value(n) - any_value(k)) AS a, sum(sxy) / (any_value(n) - any_value(k)) AS b, sum(syy) / (any_value(n) - any_value(k)) AS e FROM m, n),
d AS (SELECT trial, f.label AS y_true, m.label AS y_pred, ((e * mx - b * my) * x + (a * my - b * mx) * y - 0.5 * ((e * mx - b * my) * mx + (a * my - b * mx) * my)) / (a * e - b * b) + ln(c::DOUBLE / n) AS g FROM f, m, s, n),
r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY round(g, 9) DESC, y_pred) AS r FROM d) SELECT y_true, y_pred, count(*) AS n FROM r WHERE r = 1 GROUP BY ALL""")
def linear_discriminant(spark, d):
    """Discriminant of two features (means of both halves of a trial) from per-class moments: one pass, whatever the number of trials."""
    f = packed(spark, d).select("label", "trial", _mean("values", 1, 32).alias("x"), _mean("values", 33, 32).alias("y"))
    n = F.count("*")
    m = f.groupBy(F.col("label").alias("y_pred")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), n.alias("c"), (F.var_pop("x") * n).alias("sxx"), (F.var_pop("y") * n).alias("syy"), (F.covar_pop("x", "y") * n).alias("sxy"))
    free = F.sum("c") - F.count("*")
    s = m.agg((F.sum("sxx") / free).alias("a"), (F.sum("sxy") / free).alias("b"), (F.sum("syy") / free).alias("e"), F.sum("c").alias("n"))
    wx, wy = F.col("e") * F.col("mx") - F.col("b") * F.col("my"), F.col("a") * F.col("my") - F.col("b") * F.col("mx")
    g = (wx * F.col("x") + wy * F.col("y") - 0.5 * (wx * F.col("mx") + wy * F.col("my"))) / (F.col("a") * F.col("e") - F.col("b") ** 2) + F.log(F.col("c") / F.col("n"))
    model = m.join(F.broadcast(s))
    best = f.join(F.broadcast(model)).groupBy("trial", F.col("label").alias("y_true")).agg(F.max(F.struct(F.round(g, 9).alias("g"), (-F.col("y_pred")).alias("k"))).alias("best"))
    return statistics.confusion(best.select("y_true", (-F.col("best.k")).alias("y_pred")), "y_true", "y_pred")


def _decode(model: Callable[[], object], **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: decoding.cross_validate(packed(spark, d), "trial", "label", "values", model, 5, 2, 7, **options)


QUERIES |= {
    "decode_pca_discriminant": _decode(decoding.PcaDiscriminant),
    "decode_quadratic": _decode(lambda: decoding.PcaDiscriminant(0.5, True)),
    "decode_kernel": _decode(decoding.KernelRidge),
    "decode_windows": _decode(decoding.PcaDiscriminant, window=16, step=8),
}


#: Folds, and the moments of each class without each fold, of every sample.
_FOLDS = f"""{_EL}, tr AS (SELECT DISTINCT trial, label FROM el), fo AS (SELECT *, (row_number() OVER (PARTITION BY repeat, label ORDER BY ((trial + 1) * (7919 + 104729 * (repeat + 1))) % 1000003, trial) - 1) % 5 AS fold FROM (SELECT *, unnest(range(2)) AS repeat FROM tr)),
mo AS (SELECT r.repeat, f.fold, r.label AS y_pred, t, avg(v) AS m, var_pop(v) AS s FROM el JOIN fo r USING (trial), (SELECT unnest(range(5)) AS fold) f WHERE r.fold <> f.fold GROUP BY ALL)"""
_BEST = "SELECT repeat::INT AS repeat, fold, y_true, y_pred, count(*) AS n FROM (SELECT repeat, fold, trial, y_true, max_by(y_pred, g) AS y_pred FROM sc GROUP BY ALL) GROUP BY ALL"


def _moments(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        order = [((F.col("trial") + 1) * (7919 + 104729 * (F.col("repeat") + 1))) % 1000003, F.col("trial")]
        return decoding.decode_by_moments(packed(spark, d), "trial", "label", "values", kind, 5, 2, order)

    return run


QUERIES |= {"decode_bayes": _moments("bayes"), "decode_template_folds": _moments("template")}
ORACLE |= {
    "decode_bayes": f"WITH {_FOLDS}, sc AS (SELECT fo.repeat, fo.fold, fo.trial, fo.label AS y_true, y_pred, -sum((v - m) ** 2 / s + ln(s)) AS g FROM fo JOIN el USING (trial) JOIN mo ON mo.repeat = fo.repeat AND mo.fold = fo.fold AND mo.t = el.t GROUP BY ALL) {_BEST}",
    "decode_template_folds": f"WITH {_FOLDS}, sc AS (SELECT fo.repeat, fo.fold, fo.trial, fo.label AS y_true, y_pred, sum(v * m) / sqrt(sum(m * m)) AS g FROM fo JOIN el USING (trial) JOIN mo ON mo.repeat = fo.repeat AND mo.fold = fo.fold AND mo.t = el.t GROUP BY fo.repeat, fo.fold, fo.trial, fo.label, y_pred) {_BEST}",
}


@query()
def generalise_in_time(spark, d):
    return decoding.generalise_in_time(packed(spark, d), "trial", "label", "values", decoding.PcaDiscriminant, 4, 7, 16, 16)


@query()
def channel_importance(spark, d):
    return decoding.leave_one_channel_out(packed(spark, d), "trial", "label", "values", decoding.Discriminant, 4, 7)


@query()
def wiener_cascade(spark, d):
    """The first eighth of each trial from the other seven (means), fitted on even trials and scored on odd ones."""
    parts = packed(spark, d).select("trial", "label", F.array(*(_mean("values", 8 * i + 1, 8) for i in range(8))).alias("x"))

    def run(pdf):
        x, odd = np.array(pdf["x"].tolist()), (pdf["trial"] % 2 == 1).to_numpy()
        if odd.all() or not odd.any():
            return pdf[["trial", "label"]].head(0).assign(y=0.0, y_hat=0.0)
        hat = decoding.Wiener(3).fit(x[~odd, 1:], x[~odd, :1]).predict(x[odd, 1:])
        return pdf.loc[odd, ["trial", "label"]].assign(y=x[odd, 0], y_hat=hat[:, 0])

    return statistics.fit_quality(parts.groupBy("label").applyInPandas(run, "trial long, label int, y double, y_hat double"), ["label"], "y", "y_hat")


@query()
def kalman_decode(spark, d):
    """The means of the first two quarters of each trial as observations, those of the others as states, in order within a class."""
    names = ["a", "b", "c", "e"]
    quarters = packed(spark, d).select("label", "trial", *(_mean("values", 16 * i + 1, 16).alias(n) for i, n in enumerate(names)))
    return decoding.sequence_decode(quarters, ["label"], "trial", ["a", "b"], ["c", "e"], decoding.Kalman, 0.5)


@query()
def grid_bayes_decode(spark, d):
    ev = events(spark, d).groupBy("user_id", F.floor(F.col("hours") / 24).alias("day")).agg(F.count("*").cast("double").alias("n"), F.sum(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).alias("clicks"), F.avg("value").alias("v"))
    return decoding.sequence_decode(ev, ["user_id"], "day", ["n", "clicks"], ["v"], lambda: decoding.GridBayes(12), 0.5)


@query()
def spark_logistic(spark, d):
    from pyspark.ml.functions import array_to_vector

    e = packed(spark, d).select("trial", F.col("label").cast("double").alias("label"), array_to_vector("values").alias("features"))
    held = F.pmod(F.xxhash64("trial"), F.lit(4)) == 0
    model = decoding.spark_classifier("logistic", maxIter=10).fit(e.where(~held))
    return statistics.confusion(model.transform(e.where(held)).select(F.col("label").cast("long").alias("t"), F.col("prediction").cast("long").alias("p")), "t", "p")


@query()
def joint_pca(spark, d):
    el = long(spark, d).withColumn("channel", F.col("t") % 8).withColumn("time", F.floor(F.col("t") / 8))
    sources = [el.where("trial % 2 = 0"), el.where("trial % 2 = 1")]
    model = alignment.JointPca(4).fit(sources, "label", "time", "channel", "v")
    first, second = (model.transform(s, i, ["trial", "time"], "channel", "v") for i, s in enumerate(sources))
    return first.unionByName(second)


@query()
def canonical_alignment(spark, d):
    el = long(spark, d).withColumn("channel", F.col("t") % 8).withColumn("time", F.floor(F.col("t") / 8))
    a, b = el.where("trial % 2 = 0"), el.where("trial % 2 = 1")
    model = alignment.CanonicalAligner().fit(a, b, "label", "time", "channel", "v")
    return model.transform(b, ["trial", "time"], "channel", "v")


@query("""WITH r AS (SELECT event_type, user_id % 2 AS s, event_id, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY event_id) AS pair FROM events), c AS (SELECT event_type, min(n) AS least FROM (SELECT event_type, s, count(*) AS n FROM r GROUP BY ALL) GROUP BY event_type)
SELECT event_id, pair FROM r JOIN c USING (event_type) WHERE pair <= least""")
def shared_trial_pairs(spark, d):
    ev = table(spark, d, "events").withColumn("s", F.col("user_id") % 2)
    return alignment.shared_trials(ev, "event_type", "s", F.col("event_id")).select("event_id", "pair")


@query("""WITH p AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s, max(value) AS x FROM events GROUP BY user_id),
z AS (SELECT user_id, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS m, (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS s, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x FROM p),
d AS (SELECT a.user_id AS u, b.user_id AS w, sqrt((a.m - b.m) ** 2 + (a.s - b.s) ** 2 + (a.x - b.x) ** 2) AS d FROM z a JOIN z b ON a.user_id <> b.user_id), r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d, w) AS r FROM d),
nb AS (SELECT u, w, d FROM r, (SELECT greatest(1, count(*) // 5) AS k FROM z) WHERE r <= k), kth AS (SELECT u, max(d) AS kd FROM nb GROUP BY u),
den AS (SELECT nb.u, 1 / greatest(avg(greatest(nb.d, kth.kd)), 1e-10) AS den FROM nb JOIN kth ON kth.u = nb.w GROUP BY nb.u), f AS (SELECT nb.u, avg(b.den) / any_value(a.den) AS f FROM nb JOIN den a ON a.u = nb.u JOIN den b ON b.u = nb.w GROUP BY nb.u),
th AS (SELECT min(t) AS t FROM (SELECT t, avg(CASE WHEN f > t THEN 1.0 ELSE 0 END) AS share FROM f, (SELECT 1.5 + unnest(range(20)) AS t) GROUP BY t) WHERE share <= 0.2)
SELECT u AS user_id, round(f, 6) + 0.0 AS factor FROM f, th WHERE f > t""")
def bad_channels(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max("value").alias("x"))
    return alignment.bad_channels(per, "user_id", ["m", "s", "x"]).withColumn("factor", r6("factor"))


@query()
def fill_normal(spark, d):
    el = long(spark, d).withColumn("v", F.when(F.col("t") != 3, F.col("v")))
    return sampling.fill_normal(el, ["label"], "v", 7).select("trial", "t", "v")


@query("""WITH k AS (SELECT vec_id, row_number() OVER (ORDER BY (vec_id * 7919) % 1000003, vec_id) AS r FROM embeddings), l AS (SELECT label, row_number() OVER (ORDER BY (vec_id * 104729) % 1000003, vec_id) AS r FROM embeddings)
SELECT vec_id, label FROM k JOIN l USING (r)""")
def shuffled_labels(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return sampling.shuffle_labels(e, "vec_id", "label", [(F.col("vec_id") * 7919) % 1000003, F.col("vec_id")], [(F.col("vec_id") * 104729) % 1000003, F.col("vec_id")])


@query("""WITH e AS (SELECT vec_id AS trial, label, embedding[1] > 0 AS whole, unnest(range(3)) AS repeat FROM embeddings), f AS (SELECT *, (row_number() OVER (PARTITION BY repeat, label ORDER BY ((trial + 1) * (7919 + 104729 * (repeat + 1))) % 1000003, trial) - 1) % 5 AS fold FROM e),
n AS (SELECT repeat, label, fold, count(*) FILTER (whole) AS n FROM f GROUP BY ALL), poor AS (SELECT repeat FROM (SELECT *, sum(n) OVER (PARTITION BY repeat, label) - n AS train FROM n) WHERE train < 1)
SELECT trial, repeat::INT AS repeat, fold FROM f WHERE repeat NOT IN (SELECT repeat FROM poor)""")
def repeated_folds(spark, d):
    e = packed(spark, d).select("trial", "label", F.col("values")[0].alias("v"))
    order = [((F.col("trial") + 1) * (7919 + 104729 * (F.col("repeat") + 1))) % 1000003, F.col("trial")]
    return sampling.repeated_kfold(e, "trial", "label", 5, 3, 7, F.col("v") > 0, 1, order).select("trial", "repeat", "fold")


@query("SELECT o_custkey, count(*) AS n, sum(CASE WHEN rnk = 1 THEN o_totalprice END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk FROM orders) GROUP BY o_custkey")
def best_by_key(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (complete) AS complete FROM (SELECT event_type, user_id, count(*) > 12 AS complete FROM events GROUP BY ALL) GROUP BY event_type")
def condition_coverage(spark, d):
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg((F.count("*") > 12).alias("complete"))
    return per.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("complete").cast("long")).alias("complete"))


@query(f"WITH {_EL}, w AS (SELECT label, t, avg(v) AS m FROM el GROUP BY ALL) SELECT label, t, round(avg(m) OVER (PARTITION BY label ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) + 0.0 AS smooth FROM w")
def moving_mean(spark, d):
    m = statistics.moments_by(long(spark, d), ["label", "t"], "v")
    return windows.moving_mean(m, ["label"], "t", "mean", 3, "smooth").select("label", "t", r6("smooth").alias("smooth"))


@query("SELECT e.event_id, n_name FROM events e JOIN nation ON n_nationkey = e.user_id % 25 WHERE e.event_type = 'signup'")
def event_sites(spark, d):
    ev = table(spark, d, "events").where("event_type = 'signup'").withColumn("n_nationkey", F.col("user_id") % 25)
    return ev.join(table(spark, d, "nation"), "n_nationkey").select("event_id", "n_name")


# ---- hooks and pipelines -----------------------------------------------------------------------------


@query(f"WITH {_EL} SELECT a.trial, a.t, round(max(b.v) - min(b.v), 6) + 0.0 AS v FROM el a JOIN el b ON b.trial = a.trial AND b.t BETWEEN a.t AND a.t + 7 WHERE a.t <= 56 GROUP BY ALL")
def sliding_scorer(spark, d):
    out = hooks.sliding_scores(packed(spark, d), "values", "score", 8, lambda w: w.max(-1) - w.min(-1)).select("trial", F.posexplode("score").alias("t", "v"))
    return out.select("trial", F.col("t").cast("long").alias("t"), r6("v").alias("v"))


@query(f"WITH {_EL}, x AS (SELECT trial, label, t, CASE WHEN (trial + t) % 7 <> 0 THEN v END AS v FROM el) SELECT trial, t, round(coalesce(v, avg(v) OVER (PARTITION BY label, t)), 6) + 0.0 AS v FROM x")
def impute_mean(spark, d):
    x = long(spark, d).withColumn("v", F.when((F.col("trial") + F.col("t")) % 7 != 0, F.col("v")))
    return hooks.impute(x, ["label", "t"], "v", "mean").select("trial", "t", r6("v").alias("v"))


@query(f"""WITH {_EL}, w AS (SELECT * FROM el WHERE t BETWEEN 8 AND 40), s AS (SELECT label, avg(v) AS c, stddev_pop(v) AS d FROM w GROUP BY label), k AS (SELECT label, trial FROM (SELECT label, trial, max(abs(v)) AS peak FROM w GROUP BY ALL) JOIN s USING (label) WHERE peak < d * 3 + c)
SELECT trial, t, round(CASE WHEN trial IN (SELECT trial FROM k) THEN v END, 6) + 0.0 AS v FROM el""")
def outlier_trials_to_null(spark, d):
    return hooks.outliers_to_null(long(spark, d), ["label"], "trial", "t", "v", 3.0, 8, 40).select("trial", "t", r6("v").alias("v"))


@query(_BANK.replace("ft AS (SELECT", "car AS (SELECT trial, label, t, v - avg(v) OVER (PARTITION BY label, t) AS v FROM el), ft AS (SELECT").replace("FROM el, (SELECT unnest(range(64)) AS k)", "FROM car, (SELECT unnest(range(64)) AS k)") + """,
e AS (SELECT label, y.trial, y.t - 4 AS t, sum(a) AS v FROM y JOIN (SELECT DISTINCT trial, label FROM el) USING (trial) WHERE y.t BETWEEN 4 AND 59 GROUP BY ALL), bl AS (SELECT label, avg(v) AS m, stddev_samp(v) AS s FROM e WHERE t < 12 GROUP BY label),
z AS (SELECT label, t, (v - m) / s AS z FROM e JOIN bl USING (label) WHERE t >= 12) SELECT label, t, round(avg(z), 6) + 0.0 AS mean, round(stddev_pop(z) / sqrt(count(z)), 6) + 0.0 AS sem FROM z GROUP BY ALL""")
def evoked_band(spark, d):
    out = hooks.evoked_band(packed(spark, d), "trial", "label", "values", 64.0, (4, 16), 4, 12)
    return out.select("label", F.col("t").cast("long").alias("t"), r6("mean").alias("mean"), r6("sem").alias("sem"))


@query()
def clean_in_passes(spark, d):
    out = hooks.clean_signals(packed(spark, d), "values", 64.0, [16.0], [64, 32])
    return out.select("trial", F.posexplode("values").alias("t", "v"))


@query(f"WITH {_EL} SELECT trial, t, round(v, 6) + 0.0 AS v FROM el")
def array_round_trip(spark, d):
    """A labelled array written and read again, with its axes in order."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/array"
    hooks.save_array(long(spark, d), path, ["trial", "t"], "v")
    df, axes, value = hooks.load_array(spark, path)
    return df.select(*axes, r6(value).alias("v"))


@query("SELECT o_custkey, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS o FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
def struct_columns(spark, d):
    sums = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    return hooks.as_struct_column(sums, ["o_custkey"], "o_orderstatus", "v", ["F", "O"], "s").select("o_custkey", F.col("s.F").alias("f"), F.col("s.O").alias("o"))


@query()
def decode_reduced(spark, d):
    """Principal components before naive Bayes, through the reducer hook."""
    return decoding.cross_validate(packed(spark, d), "trial", "label", "values", lambda: hooks.Reduced(decoding.GaussianBayes), 5, 1, 7)
