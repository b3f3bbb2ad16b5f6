"""The queries that look into records and relations in depth, against SQL."""

import inspect

import duckdb
import pytest

from kinframe.plans import deep_queries
from kinframe.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n, f in QUERIES.items() if inspect.getmodule(f) is deep_queries)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    columns, con = sorted(frame.columns), duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    relation = con.sql(SQL[name])
    assert columns == sorted(relation.columns)
    text = lambda v: "NULL" if v is None else v if isinstance(v, str) else f"{float(v):.9g}"
    want = sorted(tuple(text(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall())
    assert want and sorted(tuple(text(r[c]) for c in columns) for r in frame.collect()) == want
