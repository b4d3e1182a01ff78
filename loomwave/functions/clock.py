"""Wall-clock columns as whole microseconds, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_micros(c: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to a timestamp's clock reading."""
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), c) * 1000000).cast("long")


def wall_clock(micros: Column) -> Column:
    """The timestamp without zone that wall_micros came from."""
    whole = F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / 1000000).cast("decimal(18,6)"))
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + whole
