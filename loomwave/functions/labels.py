"""Column expressions over labels, names and durations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds a unit of a written duration (fixed values).
UNITS = {"us": 1e-6, "ms": 1e-3, "s": 1.0, "sec": 1.0, "m": 60.0, "min": 60.0}
#: Numbers of the phonemes, and the articulator class of each number (fixed values).
PHONEMES = {"a": 1, "ae": 2, "i": 3, "u": 4, "b": 5, "p": 6, "v": 7, "g": 8, "k": 9}
ARTICULATORS = {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 3, 8: 4, 9: 4}
#: Words that mark a volume label as no grey matter (fixed values).
NO_GREY = ("Unknown", "unknown", "hypointensities", "White-Matter")


def lookup(c: Column, table: dict) -> Column:
    """The table's value, null where there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def duration_seconds(c: Column) -> Column:
    """Seconds of a written duration such as 10s, 700ms, 5us, 2m or 1min; null if it is none."""
    pattern = r"^\s*([0-9]*\.?[0-9]+)\s*(us|ms|sec|s|min|m)\s*$"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1).try_cast("double") * lookup(F.regexp_extract(c, pattern, 2), UNITS))


def duration_samples(c: Column, sfreq: float) -> Column:
    """Samples of a written duration, at least one."""
    return F.greatest(F.ceil(F.round(duration_seconds(c) * sfreq, 9)), F.lit(1).cast("long"))


def short_subject(c: Column) -> Column:
    """A letter and a number without leading zeros: D0035 is D35."""
    return F.concat(F.regexp_extract(c, r"^([A-Za-z]+)0*([0-9]+)", 1), F.regexp_extract(c, r"^([A-Za-z]+)0*([0-9]+)", 2))


def shank(c: Column) -> Column:
    """A channel's name without digits and blanks."""
    return F.regexp_replace(c, r"[0-9\s]", "")


def label_part(c: Column, which: int, delimiter: str = "-") -> Column:
    """One part of a label; negative counts from the end; null beyond."""
    return F.try_element_at(F.split(c, F.lit(f"\\Q{delimiter}\\E")), F.lit(which + 1 if which >= 0 else which))


def pick_label(ranked: Column, threshold: float, bad: tuple[str, ...] = NO_GREY) -> Column:
    """The first label, unless it is bad and a later one is not and has a share over the threshold.

    ranked: array<struct<label, pct>>, most probable first; the list ends at a blank label.
    """
    until = F.filter(ranked, lambda x: F.trim(x["label"]) != "")
    later = F.filter(F.slice(until, 2, F.greatest(F.size(until), F.lit(1))), lambda x: ~_any(x["label"], bad) & (x["pct"] > threshold))
    first = F.get(until, F.lit(0))["label"]
    return F.when(first.isin(*bad), F.coalesce(F.get(later, F.lit(0))["label"], first)).otherwise(first)


def find_label(ranked: Column, hot: tuple[str, ...], threshold: float) -> Column:
    """The first label with a wanted word (a later one also over the threshold), else what pick_label gives."""
    first = F.get(ranked, F.lit(0))["label"]
    later = F.filter(F.slice(ranked, 2, F.greatest(F.size(ranked), F.lit(1))), lambda x: _any(x["label"], hot) & (x["pct"] > threshold))
    return F.when(_any(first, hot), first).otherwise(F.coalesce(F.get(later, F.lit(0))["label"], pick_label(ranked, 0.05)))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def hemisphere(name: Column, x: Column) -> Column:
    """Side of an electrode: by the first letter of its name, else by the sign of x."""
    return F.when(name.startswith("L"), "left").when(name.startswith("R"), "right").when(x < 0, "left").otherwise("right")


def affine(x: Column, y: Column, z: Column, matrix: list[list[float]]) -> list[Column]:
    """A point under a 3x4 affine map."""
    return [r[0] * x + r[1] * y + r[2] * z + r[3] for r in matrix[:3]]


@F.pandas_udf(T.StringType())
def common_substring(first: pd.Series, second: pd.Series) -> pd.Series:
    """The longest common substring of two texts (the earliest in the first); null if one is null."""

    def longest(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        best, end, row = 0, 0, [0] * (len(b) + 1)
        for i, x in enumerate(a):
            left = 0
            for j, y in enumerate(b):
                left, row[j + 1] = row[j + 1], left + 1 if x == y else 0
                if row[j + 1] > best:
                    best, end = row[j + 1], i + 1
        return a[end - best : end]

    return pd.Series([longest(a, b) for a, b in zip(first, second)])


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution (by the incomplete gamma function)."""
    import math

    def q(v: float, k: float) -> float | None:
        if v is None or k is None or math.isnan(v) or math.isnan(k) or k <= 0:
            return None
        a, x = k / 2, v / 2
        if x <= 0:
            return 1.0
        log = a * math.log(x) - x - math.lgamma(a)
        if x < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= x / n
                total += term
            return 1 - total * math.exp(log)
        b, c = x + 1 - a, 1e300
        d = 1 / b
        h = d
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h * math.exp(log)

    return pd.Series([q(a, b) for a, b in zip(x, dof)])


@F.pandas_udf(T.DoubleType())
def normal_z(p: pd.Series) -> pd.Series:
    """z = minus the normal quantile of p; null outside (0, 1)."""
    from statistics import NormalDist

    return pd.Series([-NormalDist().inv_cdf(v) if v is not None and 0 < v < 1 else None for v in p], dtype="float64")
