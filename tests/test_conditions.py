"""Conditions across references against plain Python, and records without their empty fields."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinframe.functions import shapes
from kinframe.functions.conditions import all_of, any_of, flagged, follow, matching, where
from kinframe.tree import Tree


@pytest.fixture(scope="module")
def small(spark):
    draw = random.Random(5)
    pick = lambda n, most: [f"{n}{draw.randrange(8)}" for _ in range(draw.randrange(most))]  # noqa: E731  some are not there
    person = [(f"p{k}", draw.choice([0, 1, None]), [(e, draw.choice(["Primary", "Witness"])) for e in pick("e", 4)] if k % 5 else None, pick("f", 3)) for k in range(7)]
    event = [(f"e{k}", draw.choice(["Birth", "Death", None]), draw.choice(["s1", "s2", "s9", None])) for k in range(6)]
    family = [(f"f{k}", [(c,) for c in pick("p", 4)], [[x for x in pick("p", 3)] for _ in range(draw.randrange(3))]) for k in range(6)]
    place = [("s1", "here"), ("s2", "there")]
    t = Tree(
        person=spark.createDataFrame(person, "handle string, gender int, event_ref_list array<struct<ref:string,role:string>>, family_list array<string>"),
        event=spark.createDataFrame(event, "handle string, type string, place string"),
        family=spark.createDataFrame(family, "handle string, child_ref_list array<struct<ref:string>>, groups array<array<string>>"),
        place=spark.createDataFrame(place, "handle string, name string"),
    )
    return t, {r[0]: r for r in person}, {r[0]: r for r in event}, {r[0]: r for r in family}, dict(place)


def test_conditions_equal_plain(spark, small):
    t, person, event, family, place = small
    here = follow("place", "place", where(lambda p: p["name"].eq("here")))
    took = any_of("event_ref_list", where(lambda r: r["role"].eq("Primary")) & follow("ref", "event", here | ~where(lambda e: e["type"].eq("Birth"))))
    every = all_of("event_ref_list", follow("ref", "event", ~here))
    women = where(lambda p: p["gender"].eq(0))

    def is_here(e):
        return place.get(e[2]) == "here"

    def p_took(p):
        return any(role == "Primary" and e in event and (is_here(event[e]) or event[e][1] != "Birth") for e, role in p[2] or [])

    def p_every(p):
        return all(e in event and not is_here(event[e]) for e, _ in p[2] or [])

    got = {r.handle: tuple(r)[1:] for r in flagged(t, "person", a=took, b=every & ~women, c=women | every, d=any_of("family_list", follow(None, "family"))).collect()}
    assert got == {k: (p_took(p), p_every(p) and p[1] != 0, p[1] == 0 or p_every(p), any(f in family for f in p[3])) for k, p in person.items()}
    some = any_of("child_ref_list", follow("ref", "person", took & ~women))
    assert {r.handle for r in matching(t, "family", some).collect()} == {k for k, f in family.items() if any(c in person and p_took(person[c]) and person[c][1] != 0 for (c,) in f[1])}
    nested = all_of("child_ref_list", follow("ref", "person", every))
    assert {r.handle for r in matching(t, "family", ~nested).collect()} == {k for k, f in family.items() if not all(c in person and p_every(person[c]) for (c,) in f[1])}
    assert {r.handle for r in matching(t, "family", any_of("child_ref_list")).collect()} == {k for k, f in family.items() if f[1]}
    assert matching(t, "family", some).columns == t.family.columns
    with pytest.raises(ValueError):
        matching(t, "person", follow("handle", "note"))


def test_strip_empty(spark):
    kind = "handle string, a struct<x:string,y:struct<z:array<string>,n:int>>, l array<struct<ref:string,more:array<int>>>, m map<string,string>, flag boolean, n int, s array<string>, keep string"
    rows = [
        ("h1", ("", ([], None)), [("r", []), ("", [])], {"k": "", "j": "v"}, False, 0, [], ""),
        ("h2", ("t", (["", "u"], 0)), [], {}, None, None, ["", "b"], "x"),
        ("h3", None, None, {"k": ""}, True, 3, None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r.handle: json.loads(r.json) for r in shapes.as_json(df).collect()}
    assert got["h1"] == {"handle": "h1", "l": [{"ref": "r"}, {}], "m": {"j": "v"}, "flag": False, "n": 0}
    assert got["h2"] == {"handle": "h2", "a": {"x": "t", "y": {"z": ["", "u"], "n": 0}}, "s": ["", "b"], "keep": "x"}
    assert got["h3"] == {"handle": "h3", "flag": True, "n": 3}
    assert shapes.keep_keys(df, ["n", "handle", "none"]).columns == ["handle", "n"] and "n" not in shapes.skip_keys(df, ["n"]).columns
    assert [f.dataType for f in shapes.strip_empty(df).schema] == [f.dataType for f in df.schema]
    assert shapes.as_json(df.where(F.lit(False))).count() == 0
