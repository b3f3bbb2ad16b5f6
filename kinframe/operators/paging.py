"""Sorting and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinframe.plans.checkpoints import cut, shared_folder

PAGE_SIZE = 20
_ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def sort_columns(keys: str, known: dict[str, Column | list[Column]]) -> list[Column]:
    """Columns of a comma list of keys, ``-`` for descending, the handle last; an unknown key is an error.

    A key may stand for several columns, which turn around together.
    """
    out = []
    for key in filter(None, (k.strip() for k in keys.split(","))):
        name = key.removeprefix("-")
        if name not in known:
            raise ValueError(f"unknown sort key {name}; known are {', '.join(sorted(known))}")
        columns = known[name] if isinstance(known[name], list) else [known[name]]
        out += [c.desc() if key.startswith("-") else c.asc() for c in columns]
    return [*out, F.col("handle").asc()]


def person_keys(people: DataFrame) -> dict[str, Column | list[Column]]:
    """Sort keys of people: ``surname`` with given name and suffix as tie-break, ``soundex`` (surnames that sound alike together), ``gender`` and ``change``.

    A person without a surname has an empty one; fields that the table lacks are left out.
    """
    name = F.col("primary_name")
    surname = F.coalesce(F.get(name["surname_list"], 0)["surname"], F.lit(""))
    ties = [F.coalesce(name[f], F.lit("")) for f in ("first_name", "suffix") if f in people.schema["primary_name"].dataType.names]
    return {"surname": [surname, *ties], "soundex": [F.soundex(surname), surname, *ties]} | {k: F.col(k) for k in ("gender", "change") if k in people.columns}


def page(df: DataFrame, keys: str, known: dict[str, Column], number: int = 1, size: int = PAGE_SIZE) -> tuple[DataFrame, DataFrame]:
    """One page (the first is 1) in the order of ``keys``, and the true total as a one-row frame.

    A page is the end of a top-k: rows beyond it are never sorted or moved. For
    pages far from the first, :func:`store_ordered` the table once.
    """
    if number < 1 or size < 1:
        raise ValueError("page and size begin at 1")
    return df.orderBy(*sort_columns(keys, known)).offset((number - 1) * size).limit(size), df.agg(F.count("*").alias("total"))


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and sorted in each, with ``__part`` and ``__row`` (from 0): their order is the total order."""
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
    part, row = F.shiftright("__at", _ROW_BITS).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return rows.withColumns({"__part": part, "__row": row}).drop("__at")


def positions(df: DataFrame, *order: Column, out: str = "position") -> DataFrame:
    """``df`` with each row's place (from 1) in the total order, without one task that sees all rows.

    Rows are dealt by ranges of the whole order, so that ties on its first keys
    still spread, and numbered in their partition; the rows of the partitions before
    are added. That table has one row a partition, which bounds its broadcast. The
    dealt rows are cut to the checkpoint folder: ranges drawn anew would not fit
    the counts. Rows equal in all of ``order`` get consecutive places.
    """
    dealt = cut(_dealt(df, list(order)))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    offsets = counts.select("__part", before.alias("__before"))
    return dealt.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__before") + F.col("__row") + 1).alias(out))


@dataclass(frozen=True)
class Ordered:
    """A table stored in one total order, a folder for each range of it; ``starts`` has the rows before each range."""

    spark: SparkSession
    path: str
    schema: StructType
    parts: tuple[int, ...]
    starts: tuple[int, ...]
    total: int

    def page(self, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
        """The rows of a page with their ``position`` in the whole table; no rows beyond the last.

        Only the folders of the ranges that the page touches are read, and in them
        only the rows asked for.
        """
        if number < 1 or size < 1:
            raise ValueError("page and size begin at 1")
        low, high = (number - 1) * size, number * size
        ends = (*self.starts[1:], self.total)
        touched = [k for k, (a, b) in enumerate(zip(self.starts, ends)) if a < high and b > low]
        rows = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("__part").isin([self.parts[k] for k in touched]))
        wanted, start = F.lit(False), F.lit(0)
        for k in touched:
            here = F.col("__part") == self.parts[k]
            wanted = wanted | (here & F.col("__row").between(low - self.starts[k], high - 1 - self.starts[k]))
            start = F.when(here, F.lit(self.starts[k])).otherwise(start)
        columns = [c for c in rows.columns if c not in ("__part", "__row")]
        return rows.where(wanted).select(*columns, (F.col("__row") + start + 1).alias("position"))


def store_ordered(df: DataFrame, keys: str, known: dict[str, Column], path: str | None = None) -> Ordered:
    """Sort a table once, by ranges, into ``path`` (a new folder of the shared one by default), for pages at any depth.

    The driver learns how many rows each range has, nothing else.
    """
    spark = df.sparkSession
    path = path or shared_folder(spark, "ordered")
    dealt = _dealt(df, sort_columns(keys, known))
    dealt.write.partitionBy("__part").parquet(path)
    counts = sorted((r["__part"], r["n"]) for r in spark.read.schema(dealt.schema).parquet(path).groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for _, n in counts:
        starts.append(total)
        total += n
    return Ordered(spark, path, dealt.schema, tuple(p for p, _ in counts), tuple(starts), total)
