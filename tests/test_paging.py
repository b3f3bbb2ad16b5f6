"""Places in a total order, and pages far from the first."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinframe.operators import paging


def people(spark, n=500):
    draw = random.Random(3)
    rows = [(f"h{i:04d}", draw.choice(["a", "b", None]), draw.randrange(3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "handle string, surname string, gender int").repartition(7)


def ordered(rows):
    """By surname descending (nulls last), then handle."""
    return [r[0] for name in ("b", "a", None) for r in sorted(x for x in rows if x[1] == name)]


def test_positions(spark):
    rows, df = people(spark)
    got = paging.positions(df, F.col("surname").desc(), F.col("handle")).collect()
    assert {r.handle: r.position for r in got} == {h: k for k, h in enumerate(ordered(rows), 1)}
    assert set(got[0].asDict()) == {"handle", "surname", "gender", "position"}
    assert paging.positions(df.limit(0), F.col("handle")).count() == 0
    same = spark.createDataFrame([("x",)] * 9, "handle string")
    assert sorted(r.position for r in paging.positions(same, F.col("handle")).collect()) == list(range(1, 10))


def test_pages_read_what_they_need(spark):
    rows, df = people(spark)
    known = {"surname": F.col("surname")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = paging.store_ordered(df, "-surname", known)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = ordered(rows)
    assert stored.total == 500 and len(stored.parts) > 1
    for number in (1, 7, 25, 26):
        got = sorted((r.position, r.handle) for r in stored.page(number, 20).collect())
        assert got == [(k + 1, want[k]) for k in range((number - 1) * 20, min(number * 20, 500))]
    plan = stored.page(1, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__part", plan), plan
    with pytest.raises(ValueError):
        stored.page(0)
    assert paging.store_ordered(df.limit(0), "surname", known).page(1).count() == 0
