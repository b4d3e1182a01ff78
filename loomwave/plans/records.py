"""Queries of the record-level problems: references, rejects, drift, timestamps and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwave.operators import drift, intervals, references, rejects, timestamps
from loomwave.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references({t: table(spark, d, t) for t in ("participants", "scans", "task_events", "stimuli", "sidecars")}, references.RECORDING_REFERENCES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_field", "row_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def _events_base(spark: SparkSession, d: str) -> dict[str, str]:
    base = drift.base_schema(table(spark, d, "sidecar_schema"), "events")
    order = ["onset", "duration", "trial_type", "response_time", "stim_file"]
    return {k: base[k] for k in sorted(base, key=lambda k: (order.index(k) if k in order else len(order), k))}


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_lines(table(spark, d, "event_lines"), list(_events_base(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = rejects.line_reasons(table(spark, d, "event_lines"), list(_events_base(spark, d)))
    return parsed.where("reason is not null").select("line_id").distinct()


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("line_id", "file_id", "onset", "response_time", "reason")


def _sidecars(spark: SparkSession, d: str) -> DataFrame:
    base = drift.base_schema(table(spark, d, "sidecar_schema"), "ieeg")
    ingested = drift.ingest_json(table(spark, d, "sidecars"), base)
    return drift.replay_rescued(ingested, {"HeadCircumference": ("HeadCircumference", "number"), "EpochLength": ("EpochLength", "number")})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "sidecar_schema")
    of_json = drift.json_changes(_sidecars(spark, d))
    return of_json.unionByName(drift.header_changes(table(spark, d, "event_lines"), _events_base(spark, d)))


def p3_sidecars(spark: SparkSession, d: str) -> DataFrame:
    return _sidecars(spark, d).drop("_changes")


def p3_events(spark: SparkSession, d: str) -> DataFrame:
    return drift.events_table(table(spark, d, "event_lines"), _events_base(spark, d))


def _times(spark: SparkSession, d: str) -> DataFrame:
    known = F.struct(F.col("acq_time").isNull(), "acq_time", F.col("site").isNull(), "site")  # a repeat without time or site gives way
    scans = table(spark, d, "scans").groupBy("scan_id").agg(F.min(known).alias("s")).select("scan_id", "s.acq_time", "s.site")
    return timestamps.normalise_timestamps(scans, "acq_time", "site", table(spark, d, "sites"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).select("scan_id", "acq_utc")


def p4_formats(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("acq_utc").isin("none", "ambiguous", "nonexistent"), F.col("acq_utc")).otherwise("instant").alias("outcome")
    return _times(spark, d).groupBy("site", F.coalesce("acq_utc_format", F.lit("unread")).alias("format"), outcome).agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.gaps(intervals.event_intervals(table(spark, d, "task_events")), ["file_id", "trial_type"], "from_ms", "to_ms")
    return found.select("file_id", "trial_type", F.col("gap_from").alias("gap_from_ms"), F.col("gap_to").alias("gap_to_ms"))


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(intervals.event_intervals(table(spark, d, "task_events")), ["file_id", "trial_type"], "from_ms", "to_ms")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_rows, p3_found, p3_sidecars, p3_events, p4_found, p4_formats, p5_found, p5_periods)}

_KEY = r"regexp_replace(regexp_replace(replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), chr(92), '/'), '^(\./)+', ''), '(^|[^0-9])0+([0-9])', '\1\2', 'g')"


def _orphan_sql() -> str:
    parts = []
    for r in references.RECORDING_REFERENCES:
        parts.append(f"""
  SELECT DISTINCT '{r.table}' AS ref_table, '{r.field}' AS ref_field, r.{r.row_id} AS row_id, strftime(r.{r.loaded}, '%Y-%m') AS month,
    CASE WHEN (SELECT count(*) FROM par p WHERE p.kind = '{r.parent}' AND p.k = {_KEY.format(c="r." + r.field)}) = 0 THEN 'missing'
         WHEN (SELECT min(p.added) FROM par p WHERE p.kind = '{r.parent}' AND p.k = {_KEY.format(c="r." + r.field)}) > r.{r.loaded} THEN 'late' ELSE 'deleted' END AS status
  FROM {r.table} r WHERE {_KEY.format(c="r." + r.field)} NOT IN ('', 'n/a')
   AND NOT EXISTS (SELECT 1 FROM par p WHERE p.kind = '{r.parent}' AND p.k = {_KEY.format(c="r." + r.field)} AND p.added <= r.{r.loaded} AND (p.removed IS NULL OR p.removed > r.{r.loaded}))""")
    parents = " UNION ALL ".join(f"SELECT '{t}' AS kind, {_KEY.format(c=f)} AS k, {a} AS added, {x} AS removed FROM {t}" for t, f, a, x in dict.fromkeys((r.parent, r.parent_field, r.added, r.removed) for r in references.RECORDING_REFERENCES))
    return f"WITH par AS ({parents}), cases AS ({' UNION ALL '.join(parts)})"


_P5 = r"""
WITH e AS (
  SELECT DISTINCT file_id, lower(regexp_replace(trial_type, '^\s+|\s+$', '', 'g')) AS trial_type, CAST(round(onset * 1000) AS BIGINT) AS s,
         CAST(round(onset * 1000) AS BIGINT) + CAST(round(duration * 1000) AS BIGINT) AS f
  FROM task_events WHERE onset IS NOT NULL AND duration > 0 AND trial_type IS NOT NULL),
m AS (SELECT *, max(f) OVER (PARTITION BY file_id, trial_type ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e WHERE s < f)
"""

ORACLE = {
    "p1_found": _orphan_sql() + " SELECT ref_table, ref_field, row_id FROM cases",
    "p1_report": _orphan_sql() + " SELECT ref_table, ref_field, month, status, count(*) AS n_cases FROM cases GROUP BY ALL",
    "p5_found": _P5 + "SELECT file_id, trial_type, before AS gap_from_ms, s AS gap_to_ms FROM m WHERE before < s",
    "p5_periods": """
WITH e AS (
  SELECT file_id, lower(regexp_replace(trial_type, '^\\s+|\\s+$', '', 'g')) AS trial_type, CAST(round(onset * 1000) AS BIGINT) AS s,
         CAST(round(onset * 1000) AS BIGINT) + CAST(round(duration * 1000) AS BIGINT) AS f
  FROM task_events WHERE onset IS NOT NULL AND duration > 0 AND trial_type IS NOT NULL),
m AS (SELECT *, max(f) OVER (PARTITION BY file_id, trial_type ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e WHERE s < f),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR before < s THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, trial_type ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT file_id, trial_type, min(s) AS period_from, max(f) AS period_to, count(*) AS n_intervals FROM i GROUP BY file_id, trial_type, island
""",
}

_FIELD = r'(?:[^"\t]*|"(?:[^"]|"")*")'
_LINES = rf"""
WITH b AS (SELECT list(field_path) AS base FROM sidecar_schema WHERE file_kind = 'events'),
h AS (SELECT file_id, string_split(regexp_replace(min(raw_line), '\r$', ''), chr(9)) AS cols FROM event_lines WHERE line_no = 1 GROUP BY file_id),
u AS (SELECT file_id, cols, [c for c in cols if NOT list_contains(base, c)] AS unknown, [c for c in base if NOT list_contains(cols, c)] AS absent, base FROM h, b),
l AS (SELECT DISTINCT line_id, file_id, regexp_replace(raw_line, '\r$', '') AS s FROM event_lines WHERE line_no > 1),
f AS (SELECT line_id, u.*, regexp_full_match(s, '(?s){_FIELD}(?:\t{_FIELD})*') AS sound, [CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END for x in regexp_extract_all(s || chr(9), '(?s)({_FIELD})\t', 1)] AS v FROM l JOIN u USING (file_id)),
k AS (SELECT *, [CASE WHEN trim(x) IN ('', 'n/a') THEN 0 WHEN regexp_full_match(x, '\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*') THEN 1 ELSE 2 END for x in v] AS kinds,
  list_position(cols, 'onset') AS o, CASE WHEN list_contains(cols, 'response_time') THEN list_position(cols, 'response_time') WHEN len(unknown) = 1 THEN list_position(cols, unknown[1]) END AS r FROM f),
c AS (SELECT *, NOT sound OR len(v) <> len(cols) OR kinds[o] <> 1 OR coalesce(kinds[r] = 2, false) AS bad FROM k)
"""

ORACLE["p2_found"] = _LINES + "SELECT line_id FROM c WHERE bad"


def _level_sql(level: str) -> str:
    """Changes of one level of the sidecars: fields of the base there against the keys that stand there."""
    path = "$" + "".join(f'."{p}"' for p in level.split(".")) if level else "$"
    prefix = f"'{level}.' || " if level else ""
    depth = f"field_path LIKE '{level}.%' AND NOT contains(field_path[{len(level) + 2}:], '.')" if level else "NOT contains(field_path, '.')"
    name = f"field_path[{len(level) + 2}:]" if level else "field_path"
    return f"""
SELECT file_id, field_path, change_kind FROM (
  WITH o AS (SELECT DISTINCT file_id, json_extract(body, '{path}') AS j FROM sidecars WHERE json_type(body, '{path}') = 'OBJECT'),
  kt AS (SELECT file_id, k, CASE json_type(j, '$."' || k || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END AS t FROM (SELECT file_id, j, unnest(json_keys(j)) AS k FROM o)),
  b AS (SELECT field_path, {name} AS k, json_type AS t FROM sidecar_schema WHERE file_kind = 'ieeg' AND {depth}),
  x AS (SELECT o.file_id, b.field_path, b.t FROM o CROSS JOIN b WHERE NOT EXISTS (SELECT 1 FROM kt WHERE kt.file_id = o.file_id AND kt.k = b.k)),
  n AS (SELECT kt.*, row_number() OVER (PARTITION BY file_id, t ORDER BY k) AS i FROM kt WHERE k NOT IN (SELECT k FROM b) AND t IS NOT NULL),
  a AS (SELECT file_id, t, count(*) AS n FROM x GROUP BY ALL)
  SELECT x.file_id, x.field_path, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.file_id = x.file_id AND n.t = x.t) THEN 'renamed' ELSE 'removed' END AS change_kind FROM x
  UNION ALL SELECT n.file_id, {prefix}n.k, 'added' FROM n LEFT JOIN a USING (file_id, t) WHERE i > coalesce(a.n, 0)
  UNION ALL SELECT kt.file_id, b.field_path, 'retyped' FROM kt JOIN b USING (k) WHERE kt.t <> b.t)"""


ORACLE["p3_found"] = (
    _LINES
    + """,
m AS (SELECT file_id, any_value(cols) AS cols, any_value(unknown) AS unknown, any_value(absent) AS absent, any_value(base) AS base FROM u GROUP BY file_id),
d AS (SELECT file_id, pos, max(kind) AS kind FROM (SELECT file_id, unnest(range(1, len(kinds) + 1)) AS pos, unnest(kinds) AS kind FROM c WHERE NOT bad) GROUP BY ALL),
s AS (SELECT file_id, field_path, json_type, CASE WHEN list_contains(cols, field_path) THEN list_position(cols, field_path) WHEN len(unknown) = 1 AND list_contains(absent, field_path) THEN list_position(cols, unknown[1]) END AS pos FROM m, sidecar_schema WHERE file_kind = 'events')
SELECT file_id, unnest(absent) AS field_path, CASE WHEN len(unknown) > 0 THEN 'renamed' ELSE 'removed' END AS change_kind FROM m
UNION SELECT file_id, unnest(unknown), 'added' FROM m WHERE len(absent) = 0
UNION SELECT file_id, field_path, 'retyped' FROM s JOIN d USING (file_id, pos) WHERE (kind = 1 AND json_type <> 'number') OR (kind = 2 AND json_type <> 'string')
UNION """
    + " UNION ".join(_level_sql(level) for level in ("", "HardwareFilters", "HardwareFilters.Highpass RC filter"))
)

ORACLE["p2_rows"] = (
    _LINES
    + """
SELECT line_id, file_id, CASE WHEN sound AND len(v) = len(cols) AND kinds[o] = 1 THEN CAST(trim(v[o]) AS DOUBLE) END AS onset, CASE WHEN sound AND len(v) = len(cols) AND kinds[r] = 1 THEN CAST(trim(v[r]) AS DOUBLE) END AS response_time,
  CASE WHEN NOT sound THEN 'broken_quoting' WHEN len(v) <> len(cols) THEN 'wrong_field_count' WHEN kinds[o] <> 1 THEN 'bad_onset' WHEN kinds[r] = 2 THEN 'bad_response_time' END AS reason FROM c"""
)


def _events_sql() -> str:
    """Sound rows under the base columns; the only unknown column of a file stands for its absent one, further ones are rescued."""
    at = lambda b: f"CASE WHEN list_contains(cols, '{b}') THEN list_position(cols, '{b}') WHEN len(unknown) = 1 THEN list_position(cols, unknown[1]) END"
    number = lambda b: f"CASE WHEN kinds[{at(b)}] = 1 THEN CAST(trim(v[{at(b)}]) AS DOUBLE) END AS {b}"
    text = lambda b: f"CASE WHEN kinds[{at(b)}] > 0 THEN v[{at(b)}] END AS {b}"
    cell = lambda name, value: f"{name} || ': ' || CAST(to_json({value}) AS VARCHAR)"
    parts = ["CASE WHEN len(absent) = 0 THEN [" + cell("CAST(to_json(x) AS VARCHAR)", "v[list_position(cols, x)]") + " for x in unknown] ELSE [] END"]
    parts += [f"CASE WHEN kinds[{at(b)}] = 2 THEN [" + cell(f"'\"{b}\"'", f"v[{at(b)}]") + "] ELSE [] END" for b in ("onset", "duration", "response_time")]
    return f"""SELECT line_id, file_id, {number("onset")}, {number("duration")}, {text("trial_type")}, {number("response_time")}, {text("stim_file")}, '{{' || nullif(array_to_string({" || ".join(f"({p})" for p in parts)}, ', '), '') || '}}' AS _rescued FROM c JOIN (SELECT DISTINCT file_id FROM u) USING (file_id) WHERE NOT bad"""


ORACLE["p3_events"] = _LINES + _events_sql()

_P4 = r"""
WITH s AS (SELECT DISTINCT scan_id, trim(acq_time) AS t, site FROM scans),
x AS (SELECT *, CASE WHEN regexp_matches(t, '(AM|PM)$') THEN '' ELSE regexp_extract(t, '(Z|[+-][0-9]{2}:?[0-9]{2}|[A-Z]{2,5})$', 1) END AS z FROM s LEFT JOIN sites USING (site)),
y AS (SELECT *, regexp_replace(trim(t[1:len(t) - len(z)]), '^[A-Za-z]{3}, ', '') AS b FROM x),
w AS (SELECT *, CASE WHEN regexp_matches(b, '^[0-9]{4}-') THEN coalesce(try_cast(replace(b, 'T', ' ') AS TIMESTAMP), try_strptime(b, '%Y-%m-%d %H:%M'))
  WHEN regexp_matches(b, '^[0-9]{8}T?[0-9]{6}$') THEN try_strptime(b, ['%Y%m%dT%H%M%S', '%Y%m%d%H%M%S']) WHEN regexp_matches(b, '^[0-9]{4}/') THEN try_strptime(b, ['%Y/%m/%d %H:%M', '%Y/%m/%d %H:%M:%S'])
  WHEN regexp_matches(b, '^[0-9]{1,2}\.') THEN try_strptime(b, ['%d.%m.%Y %H:%M', '%d.%m.%Y %H:%M:%S']) WHEN regexp_matches(b, '^[A-Z][a-z]{2} [0-9]') THEN try_strptime(b, '%b %d, %Y %I:%M %p') WHEN regexp_matches(b, '^[0-9]{1,2} [A-Z]') THEN try_strptime(b, '%d %b %Y %H:%M:%S')
  WHEN date_order = 'mdy' THEN try_strptime(b, ['%m/%d/%Y %I:%M:%S.%f %p', '%m/%d/%Y %I:%M:%S %p', '%m/%d/%Y %H:%M']) WHEN date_order IS NOT NULL THEN try_strptime(b, ['%d/%m/%Y %H:%M', '%d/%m/%Y %H:%M:%S']) END AS local FROM y),
o AS (SELECT *, epoch_us(local) AS l, CASE WHEN z = 'Z' THEN 0 WHEN regexp_matches(z, '^[+-]') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (CAST(z[2:3] AS INT) * 3600 + CAST(z[-2:] AS INT) * 60)
  ELSE map {'GMT': 0, 'BST': 3600, 'CET': 3600, 'CEST': 7200, 'EST': -18000, 'EDT': -14400, 'CST': -21600, 'CDT': -18000, 'MST': -25200, 'IST': 19800, 'JST': 32400, 'AEST': 36000, 'AEDT': 39600}[z] END AS off FROM w),
c AS (SELECT *, l - (epoch_us(timezone(tz_name, make_timestamptz(l - 86400000000))) - (l - 86400000000)) AS u1, l - (epoch_us(timezone(tz_name, make_timestamptz(l + 86400000000))) - (l + 86400000000)) AS u2 FROM o),
f AS (SELECT *, epoch_us(timezone(tz_name, make_timestamptz(u1))) = l AS f1, epoch_us(timezone(tz_name, make_timestamptz(u2))) = l AS f2 FROM c)
SELECT scan_id, CASE WHEN regexp_matches(t, '^([0-9]{10}|[0-9]{13})$') THEN strftime(make_timestamp(CAST(t AS BIGINT) * CASE WHEN len(t) = 10 THEN 1000000 ELSE 1000 END), '%Y-%m-%dT%H:%M:%S.%fZ')
  WHEN local IS NULL OR year(local) < 1925 THEN 'none' WHEN z <> '' THEN coalesce(strftime(make_timestamp(l - CAST(off AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ'), 'none') WHEN tz_name IS NULL THEN 'none'
  WHEN f1 AND f2 AND u1 <> u2 THEN 'ambiguous' WHEN NOT f1 AND NOT f2 THEN 'nonexistent' ELSE strftime(make_timestamp(CASE WHEN f1 THEN u1 ELSE u2 END), '%Y-%m-%dT%H:%M:%S.%fZ') END AS acq_utc{more} FROM f
"""
ORACLE["p4_found"] = _P4.replace("{more}", "")
_SHAPE = """, site, CASE WHEN t IS NULL THEN 'unread' WHEN regexp_matches(t, '^([0-9]{10}|[0-9]{13})$') THEN 'epoch' WHEN regexp_matches(b, '^[0-9]{8}T?[0-9]{6}') THEN 'compact' WHEN regexp_matches(b, '^[0-9]{4}[-/.].*:') THEN 'year_first'
  WHEN regexp_matches(b, '^[0-9]{1,2}[-/.].*:') THEN 'digits' WHEN regexp_matches(b, '^[A-Z][a-z]{2,8}[.]? [0-9].*:') THEN 'month_first' WHEN regexp_matches(b, '^[0-9]{1,2} [A-Z].*:') THEN 'mail' ELSE 'unread' END AS format"""
ORACLE["p4_formats"] = "SELECT site, format, CASE WHEN acq_utc IN ('none', 'ambiguous', 'nonexistent') THEN acq_utc ELSE 'instant' END AS outcome, count(*) AS n FROM (" + _P4.replace("{more}", _SHAPE) + ") GROUP BY ALL"
