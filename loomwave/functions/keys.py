"""Column expressions that bring written keys and texts to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks around a text (fixed values).
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_blanks(c: Column) -> Column:
    """Without outer blanks; most texts begin and end with a plain character and pass as they are."""
    plain = lambda x: x.between("!", "~")
    return F.when(plain(F.substring(c, 1, 1)) & plain(F.substring(c, -1, 1)), c).otherwise(F.btrim(c, F.lit(BLANKS)))


def normal_key(c: Column) -> Column:
    """Equal for keys that differ in outer blanks, case, a leading ``./``, leading zeros of numbers or ``\\`` for ``/``."""
    path = F.replace(F.lower(strip_blanks(c)), F.lit("\\"), F.lit("/"))
    bare = F.when(path.startswith("./"), F.substring(path, 3, 2**31 - 1)).otherwise(path)
    return F.regexp_replace(bare, r"0(?<![0-9]0)0*(?=[0-9])", "")  # looks back only where a zero stands


def reference_key(c: Column) -> Column:
    """normal_key, null where the text refers to nothing (null, empty, blank or n/a)."""
    key = normal_key(c)
    return F.when(~key.isin("", "n/a"), key)
