"""Orders of people, of search hits and of siblings."""

from types import SimpleNamespace

import pytest

from kinframe.operators import graph, paging, search

PERSON = "handle string, gender int, primary_name struct<first_name:string,suffix:string,surname_list:array<struct<surname:string>>>"


def test_person_keys(spark):
    named = lambda h, given, suffix, *surnames: (h, 1, (given, suffix, [(s,) for s in surnames]))
    rows = [named("a", "Ann", "", "Smith"), named("b", "Ann", "Jr", "Smith"), named("c", "Al", None, "Smith"), named("d", "Zoe", "", "Smyth"), named("e", "Bo", "", "Adams"), named("f", "Cy", ""), named("g", None, "", "Smith")]
    people = spark.createDataFrame(rows, PERSON)
    keys = paging.person_keys(people)
    placed = lambda by: "".join(r.handle for r in people.orderBy(*paging.sort_columns(by, keys)).collect())
    assert placed("surname") == "fegcabd" and placed("-surname") == "dbacgef"
    assert placed("soundex") == "fegcabd"  # the two spellings of one sound stand together
    assert set(keys) == {"surname", "soundex", "gender"}
    with pytest.raises(ValueError, match="unknown sort key"):
        placed("change")


def test_hits_in_order(spark):
    found = spark.createDataFrame([(1, "person", "a", 2.0), (1, "event", "b", 3.0), (1, "event", "c", 2.0), (2, "note", "d", 1.0)], "query_id int, type string, handle string, score double")
    changes = spark.createDataFrame([("person", "a", 5), ("event", "b", 7), ("event", "c", 9)], "type string, handle string, change long")
    order = lambda by: [(r.query_id, r.handle, r.place) for r in search.placed(found, changes, by).orderBy("query_id", "place").collect()]
    assert order("-score") == [(1, "b", 1), (1, "c", 2), (1, "a", 3), (2, "d", 1)]
    assert order("-change") == [(1, "c", 1), (1, "b", 2), (1, "a", 3), (2, "d", 1)]
    assert order("-type,score") == [(1, "a", 1), (1, "c", 2), (1, "b", 3), (2, "d", 1)]
    assert search.placed(found.limit(0), changes).count() == 0
    assert {r.handle: r.change for r in search.placed(found, changes).collect()}["d"] is None


def test_siblings_in_their_order(spark):
    edges = spark.createDataFrame([("r", "r", x) for x in "abcd"] + [("r", "c", "e")], "root string, src string, dst string")
    nodes = spark.createDataFrame([("r", x) for x in "rabcde"], "root string, handle string")
    walked = SimpleNamespace(nodes=nodes, edges=edges)
    order = spark.createDataFrame([("c", 1), ("c", 4), ("b", 2)], "handle string, place int")
    lines = lambda *given: "".join(r.handle for r in graph.tree_lines(walked, *given).orderBy("line").collect())
    assert lines() == "rabced" and lines(order) == "rcebad"
