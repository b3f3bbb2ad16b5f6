"""Predicates over nested records, built as Columns.

``path("primary_name.surname_list").any(lambda s: s["surname"].contains("Ham"))``
is a Column; nothing is parsed at run time and values only enter as literals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Path:
    """A nested property. Steps into lists by index give null when out of range."""

    def __init__(self, column: Column):
        self.column = column

    def __getitem__(self, step: str | int) -> Path:
        return Path(F.get(self.column, step) if isinstance(step, int) else self.column[step])

    def length(self) -> Path:
        return Path(F.coalesce(F.greatest(F.size(self.column), F.lit(0)), F.lit(0)))

    def any(self, test: Callable[[Path], Column]) -> Column:
        return F.coalesce(F.exists(self.column, lambda x: F.coalesce(test(Path(x)), F.lit(False))), F.lit(False))

    def all(self, test: Callable[[Path], Column]) -> Column:
        """True for an empty or absent list."""
        return F.coalesce(F.forall(self.column, lambda x: F.coalesce(test(Path(x)), F.lit(False))), F.lit(True))

    def eq(self, value) -> Column:
        return self.column.eqNullSafe(F.lit(value))

    def ne(self, value) -> Column:
        return ~self.eq(value)

    def compare(self, sign: str, value) -> Column:
        c = self.column
        out = {">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[sign]
        return F.coalesce(out, F.lit(False))

    def contains(self, value: str) -> Column:
        """Substring of a string, case as written."""
        return F.coalesce(self.column.contains(F.lit(value)), F.lit(False))

    def has(self, value) -> Column:
        """Member of a list."""
        return F.coalesce(F.array_contains(self.column, F.lit(value)), F.lit(False))

    def truthy(self, kind: T.DataType) -> Column:
        """Whether the value counts as true: not null, zero, "", false or an empty list."""
        c = self.column
        if isinstance(kind, (T.ArrayType, T.MapType)):
            test = F.size(c) > 0
        elif isinstance(kind, T.StringType):
            test = c != ""
        elif isinstance(kind, T.BooleanType):
            test = c
        elif isinstance(kind, T.NumericType):
            test = c != 0
        else:
            test = c.isNotNull()
        return F.coalesce(test, F.lit(False))


def path(dotted: str) -> Path:
    return Path(F.col(dotted))


def rules(tests: Sequence[Column], function: str = "and", invert: bool = False) -> Column:
    """Several tests as one: all of them (``and``), any (``or``), exactly one (``one``)."""
    if function not in ("and", "or", "one"):
        raise ValueError(f"unknown function {function}")
    hits = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    out = {"and": hits == len(tests), "or": hits > 0, "one": hits == 1}[function]
    return ~out if invert else out


def where_refs(df: DataFrame, handle: str, refs: Column, targets: DataFrame, quantifier: str = "any") -> DataFrame:
    """Rows whose references point to ``targets`` (a frame of handles that pass a test): any of them, or all.

    A lambda cannot look into another table, so the references are exploded and
    met by a semi or anti join; rows without references pass ``all``.
    """
    pairs = df.select(F.col(handle).alias("__h"), F.explode(refs).alias("__ref"))
    good = targets.select(F.col(targets.columns[0]).alias("__ref")).distinct()
    if quantifier == "any":
        keep = pairs.join(good, "__ref", "left_semi").select("__h").distinct()
        return df.join(keep, df[handle] == keep["__h"], "left_semi")
    bad = pairs.join(good, "__ref", "left_anti").select("__h").distinct()
    return df.join(bad, df[handle] == bad["__h"], "left_anti")
