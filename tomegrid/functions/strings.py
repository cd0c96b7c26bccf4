"""String columns with Unicode-aware white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Remove any Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def base_name(c: Column) -> Column:
    """Last component of a path, whichever slash it uses."""
    return F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/"), -1)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)
