"""Column expressions shared by the operators: header, body, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a maximal run of letters or digits (Unicode categories L and N), case ignored.
NOT_WORD = r"[^\p{L}\p{N}]+"


def header(content: Column) -> Column:
    """First line of a chunk; the whole of it where there is no line break."""
    return F.substring_index(content, "\n", 1)


def body(content: Column) -> Column:
    """What follows the first line break; '' where there is none; null for null."""
    return F.when(content.isNull(), F.lit(None)).otherwise(
        F.coalesce(F.substr(content, F.length(header(content)) + F.lit(2)), F.lit(""))
    )


def word_string(text: Column) -> Column:
    """Lower-cased words joined by one space; '' where there are none."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def header_fields(content: Column) -> Column:
    """Word strings of the header's fields (each ends in a full stop before space or line end), sorted."""
    parts = F.split(header(content), r"(?U)\.(?:\s+|$)")
    return F.array_sort(F.filter(F.transform(parts, word_string), lambda x: x != ""))
