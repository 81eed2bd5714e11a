"""Text expressions for labels, file names and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Runs of ASCII white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


def clean_prediction(c: Column) -> Column:
    """What stands before the first parenthesis; blank is Unknown."""
    head = F.trim(F.substring_index(F.coalesce(c, F.lit("")), "(", 1))
    return F.when(head == "", F.lit("Unknown")).otherwise(head)


def first_token(c: Column) -> tuple[Column, Column]:
    """The first word and the rest."""
    parts = F.split(F.trim(c), " ")
    return F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " ")


def clock(seconds: Column) -> Column:
    """mm:ss.f with truncated tenths; minutes wrap at 60."""
    tenths = F.floor(seconds * 10)
    minute, second = F.pmod(F.floor(tenths / 600), F.lit(60)), F.pmod(F.floor(tenths / 10), F.lit(60))
    return F.format_string("%02d:%02d.%d", minute.cast("int"), second.cast("int"), F.pmod(tenths, F.lit(10)).cast("int"))


def extension(c: Column) -> Column:
    """The lower-cased file extension with its dot, or ''."""
    return F.lower(F.regexp_extract(c, r"(\.[A-Za-z0-9]+)$", 1))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())
