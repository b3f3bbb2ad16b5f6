"""Names, labels and excerpts as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the sexes 0, 1 and 2.
SEX = {0: "F", 1: "M", 2: "U"}


def display_name(first_name: Column, surnames: Column) -> Column:
    """First name and first surname, trimmed."""
    return F.trim(F.concat_ws(" ", F.coalesce(first_name, F.lit("")), F.coalesce(F.get(surnames, 0), F.lit(""))))


def full_name(first_name: Column, surnames: Column) -> Column:
    """First name and all surnames."""
    return F.trim(F.concat_ws(" ", F.coalesce(first_name, F.lit("")), F.array_join(F.coalesce(surnames, F.array().cast("array<string>")), " ")))


def record_label(*candidates: Column, length: int = 80) -> Column:
    """The first candidate that is not blank, cut to ``length``; else "(no label)"."""
    return F.coalesce(*(F.substring(F.nullif(F.trim(c), F.lit("")), 1, length) for c in candidates), F.lit("(no label)"))


def gender_letter(gender: Column) -> Column:
    out = F.lit("U")
    for k, v in SEX.items():
        out = F.when(gender == k, v).otherwise(out)
    return out


def excerpt(text: Column, length: int = 500) -> Column:
    """Stripped text, cut with three dots where it is longer than ``length``."""
    text = F.trim(text)
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def media_line(mime: Column, description: Column, date: Column) -> Column:
    blank = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    return F.concat_ws(" - ", blank(mime, "unknown type"), blank(description, "No description"), F.nullif(date, F.lit("date unknown")))
