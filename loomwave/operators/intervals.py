"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwave.functions.keys import strip_blanks
from loomwave.operators.sorted_scan import carried_running_max, range_sorted


def whole_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds; null for NaN, infinite and absurdly large values."""
    return F.when(F.abs(seconds) < 1e12, F.round(seconds * 1000)).cast("long")


def labelled_islands(df: DataFrame, entity: list[str], start: str, end: str, label: bool = True) -> DataFrame:
    """entity columns, start, end, prev_end and (with label) island_start of each row of df with start < end.

    Rows with a null in entity, start or end, or with end <= start, do not count. Repeated rows, nesting and
    ties change nothing: an interval that begins where another ends continues it. start and end are bigints.
    """
    used = df.select(*entity, F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end")).dropna().where("_start < _end")
    return carried_running_max(range_sorted(used, entity, ["_start", "_end"]), entity, ["_end"], ("_start", "_end") if label else None)


def periods(df: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """The maximal continuous periods: entity, period_from, period_to, n_intervals."""
    islands = labelled_islands(df, entity, start, end)
    return islands.groupBy(*entity, F.col("island_start").alias("period_from")).agg(F.max("_end").alias("period_to"), F.count("*").alias("n_intervals"))


def gaps(df: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """The uncovered stretches between the first start and the last end: entity, gap_from, gap_to."""
    islands = labelled_islands(df, entity, start, end, label=False)
    opens = (F.col("prev__end") > F.lit(-(2**63))) & (F.col("prev__end") < F.col("_start"))
    return islands.where(opens).select(*entity, F.col("prev__end").alias("gap_from"), F.col("_start").alias("gap_to"))


def event_intervals(events: DataFrame) -> DataFrame:
    """file_id, trial_type in one form, from_ms and to_ms of the usable rows of an events table."""
    label = F.lower(strip_blanks(F.col("trial_type")))
    onset, lasts = whole_ms(F.col("onset")), whole_ms(F.col("duration"))
    return events.where("duration > 0").select("file_id", label.alias("trial_type"), onset.alias("from_ms"), (onset + lasts).alias("to_ms"))
