"""Conditions that look through references: quantifiers and dereferences, nested and joined by and, or, not.

    emigrant = any_of("event_ref_list", follow("ref", "event", where(lambda e: e["type"].eq("Emigration"))))
    matching(tree, "family", any_of("child_ref_list", follow("ref", "person", emigrant | ~any_of("family_list"))))

A lambda of a Column cannot look into another table. A condition is a small tree
of Python objects; :func:`flagged` turns it into joins: what a dereference asks
of a record type is answered once for all its records, as a flag by handle, and
met by a left join; a list with a dereference in it is exploded, its elements
judged, and folded back by record with ``bool_or`` or ``bool_and``. Everything else
stays an expression. Two values only: null, absent and dangling count as false
wherever a test is made, so ``~`` is the exact complement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions.predicates import Path
from kinframe.tree import Tree


class Record:
    """The record in hand: ``record["type"]`` is the path of one of its fields."""

    def __getitem__(self, field: str) -> Path:
        return Path(F.col(field))


class Condition:
    def __and__(self, other: Condition) -> Condition:
        return _Fold((self, other), True)

    def __or__(self, other: Condition) -> Condition:
        return _Fold((self, other), False)

    def __invert__(self) -> Condition:
        return _Not(self)


@dataclass(frozen=True, eq=False)
class _Test(Condition):
    test: Callable[[Path | Record], Column]


@dataclass(frozen=True, eq=False)
class _Fold(Condition):
    parts: tuple[Condition, ...]
    every: bool


@dataclass(frozen=True, eq=False)
class _Not(Condition):
    of: Condition


@dataclass(frozen=True, eq=False)
class _Quantified(Condition):
    field: str
    body: Condition
    every: bool


@dataclass(frozen=True, eq=False)
class _Follow(Condition):
    field: str | None
    kind: str
    body: Condition


def where(test: Callable[[Path | Record], Column]) -> Condition:
    """A test of the record or list element in hand alone."""
    return _Test(test)


def any_of(field: str, body: Condition | None = None) -> Condition:
    """Some element of a list fulfils ``body``; without one, that the list has an element."""
    return _Quantified(field, body or where(lambda x: F.lit(True)), False)


def all_of(field: str, body: Condition) -> Condition:
    """Every element of a list fulfils ``body``; so do the elements of an empty or absent list."""
    return _Quantified(field, body, True)


def follow(field: str | None, kind: str, body: Condition | None = None) -> Condition:
    """The record of type ``kind`` whose handle is in ``field`` (None: the element in hand is the handle) is there and fulfils ``body``."""
    return _Follow(field, kind, body or where(lambda x: F.lit(True)))


def _hops(c: Condition) -> bool:
    if isinstance(c, _Follow):
        return True
    inner = c.parts if isinstance(c, _Fold) else (c.of,) if isinstance(c, _Not) else (c.body,) if isinstance(c, _Quantified) else ()
    return any(map(_hops, inner))


class _Compiler:
    def __init__(self, tree: Tree):
        self.tables, self.n, self.made = tree.tables(), 0, {}

    def name(self, what: str) -> str:
        self.n += 1
        return f"__{what}{self.n}"

    def flags(self, kind: str, c: Condition) -> DataFrame:
        """(handle, flag) of all records of a type; the same condition of the same type is compiled once."""
        if (kind, id(c)) not in self.made:
            if kind not in self.tables:
                raise ValueError(f"the tree has no records of type {kind}")
            df, flag = self.judge(self.tables[kind], ["handle"], Record(), c)
            self.made[kind, id(c)] = df.select("handle", flag.alias("flag"))
        return self.made[kind, id(c)]

    def judge(self, df: DataFrame, keys: list[str], x: Path | Record, c: Condition) -> tuple[DataFrame, Column]:
        """``df`` with what ``c`` needs joined to it, and the Column that says whether a row fulfils it; ``keys`` tell rows apart."""
        if isinstance(c, _Test):
            return df, F.coalesce(c.test(x), F.lit(False))
        if isinstance(c, _Not):
            df, flag = self.judge(df, keys, x, c.of)
            return df, ~flag
        if isinstance(c, _Fold):
            out = None
            for part in c.parts:
                df, flag = self.judge(df, keys, x, part)
                out = flag if out is None else (out & flag) if c.every else (out | flag)
            return df, out
        if isinstance(c, _Follow):
            ref, flag = self.name("ref"), self.name("flag")
            found = self.flags(c.kind, c.body).select(F.col("handle").alias(ref), F.col("flag").alias(flag))
            at = (x[c.field] if c.field else x).column
            return df.join(found, at == F.col(ref), "left").drop(ref), F.coalesce(F.col(flag), F.lit(False))
        items = x[c.field]
        if not _hops(c.body):
            return df, (items.all if c.every else items.any)(lambda e: self.judge(df, keys, e, c.body)[1])
        element, pos, flag = self.name("element"), self.name("pos"), self.name("flag")
        rows = df.select(*keys, F.posexplode(items.column).alias(pos, element))
        rows, held = self.judge(rows, [*keys, pos], Path(F.col(element)), c.body)
        fold = F.bool_and if c.every else F.bool_or
        own = [self.name("key") for _ in keys]
        folded = rows.groupBy(*keys).agg(fold(held).alias(flag)).select(*(F.col(k).alias(o) for k, o in zip(keys, own)), flag)
        same = [F.col(k) == F.col(o) for k, o in zip(keys, own)]
        return df.join(folded, same, "left").drop(*own), F.coalesce(F.col(flag), F.lit(c.every))


def flagged(tree: Tree, kind: str, **conditions: Condition) -> DataFrame:
    """(handle, one flag for each condition) of all records of a type. What conditions share is asked once."""
    compiler = _Compiler(tree)
    df, out = tree.tables()[kind], []
    for name, c in conditions.items():
        df, flag = compiler.judge(df, ["handle"], Record(), c)
        out.append(flag.alias(name))
    return df.select("handle", *out)


def matching(tree: Tree, kind: str, condition: Condition) -> DataFrame:
    """The records of a type that fulfil the condition."""
    table = tree.tables()[kind]
    df, flag = _Compiler(tree).judge(table, ["handle"], Record(), condition)
    return df.where(flag).select(*table.columns)
