"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Trim all Unicode white space, not only U+0020."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled_id(c: Column) -> Column:
    """The id, or null where the reference is blank: null, '', blanks or 'None'."""
    t = F.trim(c)
    return F.when((t != "") & (F.lower(t) != "none"), t)


def normalize_id(c: Column) -> Column:
    """Trimmed id; null and the literal none become ''."""
    t = F.coalesce(trimmed(c.cast("string")), F.lit(""))
    return F.when(F.lower(t) == "none", F.lit("")).otherwise(t)
