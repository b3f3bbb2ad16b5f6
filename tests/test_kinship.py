"""Relations and bounds of lives against plain Python."""

import random

import pytest

from kinframe.operators import graph, kinship, lives, timelines
from kinframe.tree import Tree

DATE = "struct<modifier:int,quality:int,d1:int,m1:int,y1:int,s1:boolean,d2:int,m2:int,y2:int,s2:boolean,text:string,sortval:bigint>"


def dated(year):
    return (0, 0, 1, 1, year, False, 0, 0, 0, False, "", 0) if year else (6, 0, 0, 0, 0, False, 0, 0, 0, False, "some day", 0)


def make(spark, people, families, events=()):
    """people: (handle, gender, birth year or None, death year or None); families: (father, mother, children); events: (person, type, year)."""
    rows, ev = [], []
    for h, g, born, died in people:
        refs = [(f"b{h}", "Primary")]
        ev.append((f"b{h}", "Birth", dated(born)))
        if died is not None:
            refs.append((f"d{h}", "Primary"))
            ev.append((f"d{h}", "Death", dated(died)))
        death = 1 if died is not None else -1
        for k, (who, kind, year) in enumerate(events):
            if who == h:
                refs.append((f"x{k}", "Primary"))
                ev.append((f"x{k}", kind, dated(year)))
        rows.append((h, g, 0, death, refs))
    return Tree(
        person=spark.createDataFrame(rows, "handle string, gender int, birth_ref_index int, death_ref_index int, event_ref_list array<struct<ref:string,role:string>>"),
        family=spark.createDataFrame([(f"F{k}", f, m, [(c,) for c in kids], []) for k, (f, m, kids) in enumerate(families)], "handle string, father_handle string, mother_handle string, child_ref_list array<struct<ref:string>>, event_ref_list array<struct<ref:string,role:string>>"),
        event=spark.createDataFrame([(*e, None) for e in ev], f"handle string, type string, date {DATE}, place string"),
    )


FAMILIES = [("pa", "ma", ["me", "bro"]), ("pa", "stepma", ["half"]), ("grandpa", "grandma", ["pa", "aunt"]), (None, "ma", ["maybe"]), ("me", "wife", ["kid"]), ("inpa", "inma", ["wife", "inbro"]), ("stepx", "stepma", ["stepsis"]), ("aunt", "uncle", ["cousin"])]


def test_words(spark):
    women = {"ma", "grandma", "aunt", "stepma", "half", "wife", "inma", "stepsis"}
    names = sorted({x for f, m, kids in FAMILIES for x in (f, m, *kids) if x})
    t = make(spark, [(n, 0 if n in women else 1, None, None) for n in names], FAMILIES)
    got = {(r.a, r.b): (r.relation, r.kind, r.steps, r.up, r.down) for r in kinship.kinship(t).collect()}
    mine = {b: w[0] for (a, b), w in got.items() if a == "me"}
    assert mine == {
        "pa": "father", "ma": "mother", "bro": "brother", "half": "half-sister", "maybe": "brother", "grandpa": "grandfather", "grandma": "grandmother", "aunt": "aunt", "uncle": "uncle-in-law",
        "cousin": "1st cousin", "wife": "wife", "kid": "son", "inpa": "father-in-law", "inma": "mother-in-law", "inbro": "brother-in-law", "stepma": "stepmother", "stepsis": "stepsister",
    }
    assert got["kid", "stepma"][0] == "stepgrandmother" and got["stepma", "me"] == ("stepson", "step", 2, 0, 1) and got["inpa", "me"][0] == "son-in-law" and got["kid", "half"][0] == "half-aunt"
    some = kinship.kinship(t, spark.createDataFrame([("me",), ("wife",)], "h string"))
    assert {(r.a, r.b): r.relation for r in some.collect()} == {k: w[0] for k, w in got.items() if k[0] in ("me", "wife")}
    pairs = spark.createDataFrame([("me", "half"), ("me", "bro"), ("me", "wife"), ("me", "maybe"), ("wife", "inbro"), ("me", "inpa")], "a string, b string")
    plain = {(r.a, r.b): r.relation for r in graph.relationship(graph.parent_edges(t), pairs, t.person, partners=kinship.couples(t)).collect()}
    assert plain == {("me", "half"): "half-sister", ("me", "bro"): "brother", ("me", "wife"): "wife", ("me", "maybe"): "brother", ("wife", "inbro"): "brother", ("me", "inpa"): None}


def random_tree(spark, seed, n=40):
    draw = random.Random(seed)
    born = {f"p{k:02d}": draw.choice([None, None, 1800 + 5 * k + draw.randrange(30)]) for k in range(n)}
    died = {h: draw.choice([None, None, (y or 1900) + draw.randrange(90), 0]) for h, y in born.items()}
    names, families = sorted(born), []
    for _ in range(16):
        father, mother, *kids = draw.sample(names, 2 + draw.randrange(1, 4))
        families.append((draw.choice([father, father, None]), mother, [k for k in kids if k > max(father, mother)]))
    return born, died, families, make(spark, [(h, k % 3, born[h], died[h]) for k, h in enumerate(names)], families)


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_equal_plain(spark, seed):
    born, died, families, t = random_tree(spark, seed)
    parents = {(c, p) for f, m, kids in families for c in kids for p in (f, m) if p}
    siblings = {(a, b) for _, _, kids in families for a in kids for b in kids if a != b}
    dead = lambda h: died[h] or None
    own = {h: ((born[h], 0, f"b{h}"),) * 2 if born[h] else ((dead(h) - 110, 1, f"d{h}"), (dead(h), 1, f"d{h}")) if dead(h) else (None, None) for h in born}
    low, high = ({h: x[k] for h, x in own.items()} for k in (0, 1))
    for _ in range(60):
        new_low, new_high = {}, {}
        for h in born:
            a = [low[p] and (low[p][0] + 20, 2, low[p][2]) for c, p in parents if c == h] + [low[s] and (low[s][0] - 20, 4, low[s][2]) for x, s in siblings if x == h]
            b = [high[c] and (high[c][0] - 20, 3, high[c][2]) for c, p in parents if p == h] + [high[s] and (high[s][0] + 20, 4, high[s][2]) for x, s in siblings if x == h]
            fixed = born[h] is not None
            new_low[h] = min((x for x in [own[h][0], *([] if fixed else a)] if x), key=lambda x: (-x[0], *x[1:]), default=None)
            new_high[h] = min((x for x in [own[h][1], *([] if fixed else b)] if x), default=None)
        low, high = new_low, new_high
    got = {r.handle: ((r.low, r.low_rule, r.low_witness), (r.high, r.high_rule, r.high_witness)) for r in lives.birth_bounds(t).collect()}
    word = lambda x: (x[0], lives.RULES[x[1]], x[2]) if x else (None, None, None)
    assert got == {h: (word(low[h]), word(high[h])) for h in born}
    told = {r.handle: r for r in lives.estimates(t).collect()}
    for h in born:
        r = told[h]
        assert (r.low, r.high) == (got[h][0][0], got[h][1][0]) and r.ended == (died[h] is not None)
        if born[h]:
            assert (r.birth_year, r.birth_rule, r.birth_witness) == (born[h], "birth", f"b{h}")
        elif r.birth_year is not None and r.low is not None and r.high is not None and r.low <= r.high:
            assert r.low <= r.birth_year <= r.high
        assert (r.death_rule == "death") == bool(died[h]) and (r.birth_year is None) == (r.birth_rule is None)


def test_burials_and_circles(spark, monkeypatch):
    monkeypatch.setattr(lives, "MOST_HOPS", 4)
    t = make(spark, [("a", 1, None, None), ("b", 0, 1990, None), ("c", 1, None, 1850), ("d", 1, None, None), ("e", 1, None, None)], [("d", None, ["e"]), ("e", None, ["d"])], [("a", "Burial", 1980), ("b", "Cremation", None)])
    got = {r.handle: r for r in lives.estimates(t).collect()}
    assert (got["a"].birth_year, got["a"].birth_rule, got["a"].death_year, got["a"].death_witness, got["a"].ended) == (1870, "death", 1980, "x0", True)
    assert got["b"].ended and got["b"].death_rule == "age" and got["c"].birth_year == 1740 and got["d"].birth_year is None
    alive = {r.handle: (r.living, r.rule) for r in timelines.living(t, 2024).collect()}
    assert alive == {"a": (False, "death"), "b": (False, "birth"), "c": (False, "death"), "d": (True, "none"), "e": (True, "none")}
    circle = make(spark, [("d", 1, None, None), ("e", 1, None, None), ("f", 1, 1900, None)], [("d", None, ["e"]), ("e", None, ["d"]), ("f", None, ["d"])])
    assert {r.handle: r.low_witness for r in lives.birth_bounds(circle).collect()} == {"d": "bf", "e": "bf", "f": "bf"}


def test_timeline_over_generations(spark):
    people = [("me", 1, 1950, None), ("ma", 0, 1920, 1990), ("gran", 0, 1890, None), ("kid", 0, 1980, None), ("kidskid", 1, 2005, None), ("wife", 0, 1952, None), ("sis", 0, 1940, None)]
    t = make(spark, people, [("gran", None, ["ma"]), (None, "ma", ["me", "sis"]), ("me", "wife", ["kid"]), (None, "kid", ["kidskid"])], [("me", "Census", 1960), ("ma", "Census", 1930)])
    me = spark.createDataFrame([("me",)], "h string")
    rows = lambda **kw: {(r.label, r.person): (r.age_years, r.person_years) for r in timelines.kin_timeline(t, me, **kw).collect()}
    near = rows()
    assert near == {
        ("Birth", "me"): (0, 0), ("Census", "me"): (10, 10), ("Birth of mother", "ma"): (None, 0), ("Death of mother", "ma"): (40, 70), ("Birth of daughter", "kid"): (30, 0),
        ("Birth of wife", "wife"): (2, 0), ("Birth of sister", "sis"): (None, 0),
    }
    assert set(rows(ancestors=2, offspring=2)) - set(near) == {("Birth of grandmother", "gran"), ("Birth of grandson", "kidskid")}
    assert set(rows(ancestors=2, offspring=2, relatives=("grandson",), classes=("legal",))) == {("Birth", "me"), ("Birth of grandson", "kidskid")}
    assert {x for x, _ in rows(ancestors=0, offspring=0)} == {"Birth", "Census", "Birth of wife", "Birth of sister"}
    some = spark.createDataFrame([("ma",), ("kid",)], "h string")
    of = lambda **kw: {(r.person, r.type) for r in timelines.people_timeline(t, some, **kw).collect()}
    assert of() == {("ma", "Birth"), ("ma", "Death"), ("ma", "Census"), ("kid", "Birth")}
    assert of(anchor="sis", first=True) == {("ma", "Death"), ("kid", "Birth"), ("sis", "Birth")} and ("kid", "Birth") not in of(anchor="sis", last=True)
    family = timelines.families_timeline(t, spark.createDataFrame([("F1",)], "h string"))
    assert {(r.family, r.person) for r in family.collect()} == {("F1", "ma"), ("F1", "me"), ("F1", "sis")} and family.count() == 6


@pytest.mark.parametrize("seed", [3, 4])
def test_kin_are_told_both_ways_without_sorting_pairs(spark, seed):
    born, _, _, t = random_tree(spark, seed)
    every = kinship.kinship(t)
    text = every._jdf.queryExecution().optimizedPlan().toString()
    plan = every._jdf.queryExecution().executedPlan().toString()
    # a pair's best way is the least of numbers, kept in a hash table, and a line meets only lines of the length it can go on with
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert any("Join" in line and line.count("top#") > 1 and line.count("down#") > 1 for line in text.splitlines())
    rows = {(r.a, r.b): (r.kind, r.steps, r.up, r.down) for r in every.collect()}
    assert len(rows) == every.count() and any(k[0] != "blood" for k in rows.values())
    for (a, b), (kind, steps, up, down) in rows.items():
        assert rows[b, a][:2] == (kind, steps) and sum(rows[b, a][2:]) == up + down == steps - (kind != "blood")
    some = sorted(born)[::7]
    few = kinship.kinship(t, spark.createDataFrame([(h,) for h in some], "h string"))
    assert {(r.a, r.b): (r.kind, r.steps, r.up, r.down) for r in few.collect()} == {k: v for k, v in rows.items() if k[0] in some}
