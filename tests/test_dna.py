"""Segments of notes and DNA matches."""

import random

import pytest

from kinframe.operators import dna, graph
from kinframe.tree import Tree

NOTE = """Chromosome,Start,Stop,cM,SNPs
11,56950055,64247327,10.9,1404,p,from a site
1,1,1,1

chr X;1.000;2.000.000;12,5
7\t1,234\t5,678\t9.5\t\tM
0,1,2,3
3,x,2,3
3,1,y,3
3,9,2,3
3,1,2,far
3,1,2,3,lots
3,1
"""


def test_segments(spark):
    notes = spark.createDataFrame([("n1", (NOTE,)), ("n2", ("",)), ("n3", (None,)), ("n4", ("2,5,6,7",)), ("n5", ("Start,of,notes\r\n22,1,2,3.5",))], "handle string, text struct<string:string>")
    got = {(r.note, r.line): r for r in dna.segments(notes).collect()}
    values = lambda *k: tuple(got[k])[2:]
    assert values("n1", 2) == ("11", 56950055, 64247327, "P", 10.9, 1404, "from a site", None)
    assert values("n1", 3) == ("1", 1, 1, "U", 1.0, None, None, None) and values("n1", 5) == ("X", 1000, 2000000, "U", 12.5, None, None, None)
    assert values("n1", 6) == ("7", 1234, 5678, "M", 9.5, None, None, None)
    assert {k[1]: r.fault for k, r in got.items() if r.fault} == {7: "chromosome", 8: "start", 9: "stop", 10: "stop before start", 11: "cM", 12: "SNPs", 13: "fields"}
    assert values("n4", 1)[:3] == ("2", 5, 6) and ("n5", 1) not in got and values("n5", 2)[0] == "22" and len(got) == 13


def test_matches(spark):
    refs = "array<struct<ref:string,rel:string,note_list:array<string>>>"
    people = [("me", 1, [("x", "Godfather", ["n4"]), ("cousin", "DNA", ["n2", "gone", "n1"]), ("far", "dna", [])]), ("cousin", 0, None), ("far", 1, []), ("pa", 1, None), ("aunt", 0, None), ("gp", 1, None), ("gm", 0, None)]
    t = Tree(
        person=spark.createDataFrame(people, f"handle string, gender int, person_ref_list {refs}"),
        family=spark.createDataFrame([("gp", "gm", [("pa",), ("aunt",)]), ("pa", None, [("me",)]), (None, "aunt", [("cousin",)])], "father_handle string, mother_handle string, child_ref_list array<struct<ref:string>>"),
        note=spark.createDataFrame([("n1", ("1,1,2,3\nbad",)), ("n2", ("2,1,2,4.5",))], "handle string, text struct<string:string>"),
    )
    got = {r.match: r for r in dna.dna_matches(t).collect()}
    c = got["cousin"]
    assert (c.person, c.person_ref_idx, c.relation, c.ancestors, c.note_handles, c.centimorgans, c.faults) == ("me", 1, "1st cousin", ["gm", "gp"], ["n2", "n1"], 7.5, ["n1:2 fields"])
    assert [(s.chromosome, s.cm) for s in c.segments] == [("2", 4.5), ("1", 3.0)]
    assert (got["far"].relation, got["far"].ancestors, got["far"].segments, got["far"].person_ref_idx) == (None, [], [], 2) and set(got) == {"cousin", "far"}


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_ways_equal_plain_without_a_row_for_each_ancestor(spark, monkeypatch, seed):
    draw = random.Random(seed)
    edges = {(f"p{c:02d}", f"p{p:02d}") for c in range(40) for p in draw.sample(range(c + 1, 50), 2) if draw.random() < 0.6}
    pairs = {(f"p{draw.randrange(50):02d}", f"p{draw.randrange(50):02d}") for _ in range(60)} | {("p01", "p01"), ("p01", "gone")}
    depth, reach = 4, {}
    for h in {x for p in pairs for x in p}:
        reach[h], level = {h: 0}, {h}
        for n in range(1, depth + 1):
            level = {p for c, p in edges if c in level}
            for p in level:
                reach[h].setdefault(p, n)
    ways, best = {}, {}
    for a, b in pairs:
        met = {x: (reach[a][x], reach[b][x]) for x in reach[a].keys() & reach[b].keys()}
        above = {(p, met[c][0] + 1, met[c][1] + 1) for c, p in edges if c in met}
        for x, (up, down) in met.items():
            if (x, up, down) not in above:
                ways.setdefault((a, b, up, down), set()).add(x)
        if met:
            up, down = min(met.values(), key=lambda w: (sum(w), w[0]))
            best[a, b] = (up, down, sorted(x for x, w in met.items() if w == (up, down)))
    monkeypatch.setattr(graph, "closure", lambda *a, **k: pytest.fail("a row for each ancestor of each person"))
    par, asked = spark.createDataFrame(sorted(edges), "child string, parent string"), spark.createDataFrame([*sorted(pairs), (None, "p01"), ("p02", None)], "a string, b string")
    assert {(r.a, r.b, r.up, r.down): r.ancestors for r in graph.relationships(par, asked, depth).collect()} == {k: sorted(v) for k, v in ways.items()}
    assert {(r.a, r.b): (r.up, r.down, r.ancestors) for r in graph.nearest(par, asked, depth).collect()} == best
