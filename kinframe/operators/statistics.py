"""Counts over whole trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.tree import Tree


def object_counts(tree: Tree) -> DataFrame:
    """(object_type, n) of every table."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("object_type"), "n") for t, df in tree.tables().items()])


def megabytes(size: Column) -> Column:
    """Bytes as text with two decimals."""
    return F.format_number(size / 1048576, 2)


def surname_groups(person: DataFrame, mapping: DataFrame) -> DataFrame:
    """(surname_group, people): surnames counted under the group that ``mapping`` (surname, grp) gives them, else under themselves.

    Surnames are counted before they meet the mapping.
    """
    counts = person.select(F.explode("primary_name.surname_list.surname").alias("surname")).groupBy("surname").agg(F.count("*").alias("n"))
    return counts.join(mapping, "surname", "left").groupBy(F.coalesce("grp", "surname").alias("surname_group")).agg(F.sum("n").alias("people"))


def custom_types(df: DataFrame, field: str, defaults: DataFrame) -> DataFrame:
    """Distinct values of a type field that are not among the defaults (first column of ``defaults``)."""
    return df.select(F.col(field).alias("value")).distinct().join(defaults.select(F.col(defaults.columns[0]).alias("value")), "value", "left_anti")


def citation_coverage(tree: Tree) -> DataFrame:
    """(handle, cited, uncited): how many of a person's own events have a citation."""
    has = tree.event.select(F.col("handle").alias("ref"), (F.size("citation_list") > 0).alias("has"))
    refs = tree.person.select("handle", F.explode("event_ref_list.ref").alias("ref"))
    return refs.join(has, "ref").groupBy("handle").agg(F.count_if("has").alias("cited"), F.count_if(~F.col("has")).alias("uncited"))
