"""Acquisition times in many notations, formats and zones, brought to one instant in UTC.

An ordered cascade of anchored patterns reads each text; the first that fits decides. Everything stays in
built-in expressions, so the scan, the cascade and the zone arithmetic share one generated stage.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwave.functions.keys import strip_blanks

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap]\.?m\.?))?"
_ZONE = r"(?: ?(z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[a-z]{2,5}))?"
#: (name, anchored pattern of the lower-case text, its groups as year|month|day|hour|minute|second|fraction|half|zone).
_CASCADE = [
    ("compact", r"^(\d{4})(\d{2})(\d{2})[t ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("year_first", r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:t| +)" + _TIME + _ZONE + "$", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("digits", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?:,? +|t)" + _TIME + _ZONE + "$", "$4|$1|$3|$5|$6|$7|$8|$9|$10"),
    ("month_first", r"^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4}),? " + _TIME + _ZONE + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("mail", r"^(?:[a-z]{3,9}, )?(\d{1,2}) ([a-z]{3})[a-z]*\.? (\d{4}),? " + _TIME + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
]
_EPOCH = r"^(\d{10}|\d{13})$"
_FIRST_YEAR = 1925


def zone_table(sites: DataFrame) -> DataFrame:
    """site, tz_name, date_order and the offsets in seconds of the abbreviations that the site's zone uses.

    One row per site (the first by zone name if repeated). An unknown zone name counts as null.
    """

    def offsets(tz_name: str) -> dict[str, int] | None:
        try:
            zone = ZoneInfo(tz_name)
        except Exception:
            return None
        known = {}
        for month in range((2040 - _FIRST_YEAR) * 12):
            at = dt.datetime(_FIRST_YEAR + month // 12, month % 12 + 1, 15, tzinfo=zone)
            known[at.tzname().lower()] = int(at.utcoffset().total_seconds())
        return known

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["abbreviations"] = [offsets(z) if z else None for z in pdf["tz_name"]]
            pdf["tz_name"] = [z if a else None for z, a in zip(pdf["tz_name"], pdf["abbreviations"])]
            yield pdf

    one = sites.groupBy("site").agg(F.min(F.struct("tz_name", "date_order")).alias("s")).select("site", "s.*")
    return one.where("site is not null").mapInPandas(read, "site string, tz_name string, date_order string, abbreviations map<string,int>")


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _shown(utc: Column) -> Column:
    """UTC microseconds as YYYY-MM-DDTHH:MM:SS.ffffffZ, whatever the session's time zone."""
    day = F.floor((utc - F.pmod(utc, F.lit(86400 * 10**6))) / (86400 * 10**6))
    rest = F.pmod(utc, F.lit(86400 * 10**6))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    s = F.floor(rest / 1000000)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(h), F.lit(":"), two(m), F.lit(":"), two(s % 60), F.lit("."), F.lpad((rest % 1000000).cast("string"), 6, "0"), F.lit("Z"))


def normalise_timestamps(df: DataFrame, text: str, site: str, sites: DataFrame, out: str = "acq_utc") -> DataFrame:
    """df with `out`: YYYY-MM-DDTHH:MM:SS.ffffffZ, or nonexistent, ambiguous or none; and `{out}_format`, the pattern.

    Times without zone are clock times of the row's site; clock times that the site skipped are nonexistent, those
    it had twice ambiguous. Null, words, impossible dates or times, dates before 1925, clock times without a known
    site and unknown zone abbreviations give none. Fractions beyond microseconds are cut. The sites table is a
    short fixed list; Spark's size check decides whether it is broadcast.
    """
    zones = zone_table(sites).select(F.col("site").alias("_site"), *(F.col(c).alias(f"_{c}") for c in ("tz_name", "date_order", "abbreviations")))
    kept = [c for c in df.columns if c not in (out, f"{out}_format")]
    rows = df.select(F.struct(*kept).alias("_row"), F.col(text).alias("_text"), F.col(site).alias("_at"))
    joined = rows.join(zones, F.col("_at") == F.col("_site"), "left")
    raw = F.regexp_replace(F.lower(strip_blanks(F.col("_text"))), r"\s+", " ")
    joined = joined.withColumn("_t", raw)
    kind = F.lit(None).cast("string")
    for name, pattern, _ in reversed(_CASCADE):
        kind = F.when(F.col("_t").rlike(pattern), name).otherwise(kind)
    joined = joined.withColumn("_kind", F.when(F.col("_t").rlike(_EPOCH), "epoch").otherwise(kind))
    written = F.lit("||||||||")
    for name, pattern, groups in _CASCADE:
        written = F.when(F.col("_kind") == name, F.regexp_replace("_t", pattern, groups)).otherwise(written)
    joined = joined.withColumn("_parts", F.split(written, r"\|", -1))
    part = lambda i: F.get("_parts", F.lit(i))
    by_point = F.col("_t").rlike(r"^\d{1,2}\.")
    month_leads = ~by_point & (F.coalesce("_date_order", F.lit("")) == "mdy")
    digits = F.col("_kind") == "digits"
    first = F.when(digits & ~by_point & F.col("_date_order").isNull(), F.lit("")).otherwise(part(1))
    swapped = digits & ~month_leads
    month = F.when(swapped, part(2)).when(F.col("_kind").isin("month_first", "mail"), (F.array_position(F.array(*map(F.lit, _MONTHS)), part(1))).cast("string")).otherwise(first)
    joined = joined.withColumns({"_y": part(0), "_mo": month, "_d": F.when(swapped, first).otherwise(part(2)), "_h": part(3), "_mi": part(4), "_s": part(5), "_f": part(6), "_half": F.translate(part(7), ".", ""), "_zone": part(8)})
    hour, second = _number(F.col("_h")), F.when(F.coalesce("_s", F.lit("")) == "", 0).otherwise(_number(F.col("_s")))
    twelve = F.col("_half") != ""
    hour24 = F.when(twelve, hour % 12 + F.when(F.col("_half") == "pm", 12).otherwise(0)).otherwise(hour)
    date = F.try_to_date(F.concat_ws("-", F.lpad("_y", 4, "0"), F.lpad("_mo", 2, "0"), F.lpad("_d", 2, "0")), "yyyy-MM-dd")
    valid = date.isNotNull() & (F.year(date) >= _FIRST_YEAR) & F.when(twelve, hour.between(1, 12)).otherwise(hour.between(0, 23)) & _number(F.col("_mi")).between(0, 59) & second.between(0, 59)
    micros = _number(F.rpad(F.substring("_f", 1, 6), 6, "0"))
    local = (F.unix_date(date).cast("long") * 86400 + hour24 * 3600 + _number(F.col("_mi")) * 60 + second) * 1000000 + micros
    joined = joined.withColumn("_local", F.when(valid, local))
    sign = F.when(F.substring("_zone", 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace("_zone", "[^0-9]", "")
    far = _number(F.substring(digits, 1, 2)) * 3600 + F.coalesce(_number(F.substring(digits, 3, 2)), F.lit(0)) * 60
    numeric = F.when((far <= 18 * 3600) & (F.coalesce(_number(F.substring(digits, 3, 2)), F.lit(0)) < 60), sign * far)
    offset = F.when(F.col("_zone").isin("z", "utc"), 0).when(F.col("_zone").rlike("^[+-]"), numeric).otherwise(F.coalesce(F.try_element_at("_abbreviations", "_zone"), F.when(F.col("_zone") == "gmt", 0)))
    zone, day = F.coalesce("_tz_name", F.lit("UTC")), 86400 * 10**6
    clock = lambda utc: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))
    around = lambda shift: F.col("_local") - (clock(F.col("_local") + shift) - (F.col("_local") + shift))
    joined = joined.withColumns({"_before": around(-day), "_after": around(day)})
    joined = joined.withColumns({"_fits_before": clock(F.col("_before")) == F.col("_local"), "_fits_after": clock(F.col("_after")) == F.col("_local")})
    twice = F.col("_fits_before") & F.col("_fits_after") & (F.col("_before") != F.col("_after"))
    epoch = F.col("_t").try_cast("long") * F.when(F.length("_t") == 10, 1000000).otherwise(1000)
    zoned = F.coalesce("_zone", F.lit("")) != ""
    flag = F.when(F.col("_kind") == "epoch", None).when(F.col("_local").isNull(), "none").when(zoned, None).when(F.col("_tz_name").isNull(), "none").when(twice, "ambiguous").when(~F.col("_fits_before") & ~F.col("_fits_after"), "nonexistent")
    instant = F.when(F.col("_kind") == "epoch", epoch).when(zoned, F.col("_local") - offset.cast("long") * 1000000).when(F.col("_fits_before"), F.col("_before")).otherwise(F.col("_after"))
    joined = joined.withColumns({"_flag": flag, "_instant": instant})
    result = joined.withColumn(out, F.coalesce("_flag", _shown(F.col("_instant")), F.lit("none"))).withColumn(f"{out}_format", F.col("_kind"))
    return result.select("_row.*", out, f"{out}_format")
