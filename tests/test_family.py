"""Small cases for the family-tree operators, and their queries against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.functions import dates, labels
from kinframe.functions.predicates import path, rules
from kinframe.operators import changes, graph, paging, references, search, timelines
from kinframe.plans import record_queries  # noqa: F401  registers its queries
from kinframe.plans.queries import QUERIES, SQL
from kinframe.sources.records import ingest
from kinframe.tree import Tree

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def parents(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


FIVE = [("h1", "h2"), ("h1", "h3"), ("h2", "h4"), ("h2", "h5")]


def walked(spark, pairs, root="h1", **kw):
    w = graph.walk(parents(spark, pairs), spark.createDataFrame([(root,)], "root string"), **kw)
    return {r.handle: r.generation for r in w.nodes.collect()}, {(r.src, r.dst) for r in w.edges.collect()}, w.summary.first()


def test_walk(spark):
    nodes, edges, s = walked(spark, FIVE)
    assert nodes == {"h1": 1, "h2": 2, "h3": 2, "h4": 3, "h5": 3} and edges == set(FIVE) and not s.truncated and s.unexplored == 0
    nodes, edges, s = walked(spark, FIVE, max_generations=2)
    assert set(nodes) == {"h1", "h2", "h3"} and edges == {("h1", "h2"), ("h1", "h3")} and s.unexplored == 2
    nodes, edges, _ = walked(spark, [*FIVE, ("h3", "h4"), ("h3", "h5")])
    assert len(nodes) == 5 and {("h2", "h4"), ("h3", "h4")} <= edges
    assert set(walked(spark, [("a", "b"), ("b", "a")], "a")[0]) == {"a", "b"}
    with pytest.raises(ValueError):
        walked(spark, FIVE, max_generations=21)


def test_walk_cap_and_failures(spark):
    binary = [(f"n{i}", f"n{2 * i + k}") for i in range(1, 8) for k in (0, 1)]
    nodes, edges, s = walked(spark, binary, "n1", max_generations=10, cap=5)
    assert set(nodes) == {"n1", "n2", "n3"} and s.truncated and s.unexplored == 4 and edges == {("n1", "n2"), ("n1", "n3")}
    readable = spark.createDataFrame([("h1",), ("h2",), ("h4",), ("h5",)], "h string")
    nodes, _, s = walked(spark, FIVE, readable=readable)
    assert set(nodes) == {"h1", "h2", "h4", "h5"} and s.failed == 1 and not s.truncated
    nodes, _, s = walked(spark, FIVE, readable=readable.limit(0))
    assert nodes == {} and s.failed == 1


def test_tree_lines_equal_recursion(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("d", "f")]
    w = graph.walk(parents(spark, pairs), spark.createDataFrame([("a",)], "r string"), max_generations=10)
    got = [(r.handle, r.generation, r.repeat) for r in graph.tree_lines(w).orderBy("line").collect()]
    kids, seen, want = {}, set(), []
    for a, b in sorted(pairs):
        kids.setdefault(a, []).append(b)

    def listing(x, depth):
        want.append((x, depth, x in seen))
        if x not in seen:
            seen.add(x)
            for y in kids.get(x, []):
                listing(y, depth + 1)

    listing("a", 1)
    assert got == want


def test_relations(spark):
    p = parents(spark, [("me", "dad"), ("sis", "dad"), ("dad", "gran"), ("aunt", "gran"), ("cousin", "aunt"), ("gran", "great")])
    people = spark.createDataFrame([("me", 1), ("dad", 1), ("sis", 0), ("gran", 0), ("aunt", 0), ("cousin", 1), ("great", 1), ("x", 2)], "handle string, gender int")
    pairs = spark.createDataFrame([("me", k) for k in ("me", "dad", "sis", "gran", "aunt", "cousin", "great", "x")] + [("aunt", "me"), ("gran", "me")], "a string, b string")
    got = {(r.a, r.b): (r.relation, r.up, r.down) for r in graph.relationship(p, pairs, people).collect()}
    want = {"me": "self", "dad": "father", "sis": "sister", "gran": "grandmother", "aunt": "aunt", "cousin": "1st cousin", "great": "great-grandfather"}
    assert {k: got["me", k][0] for k in want} == want
    assert got["me", "x"] == (None, -1, -1) and got["aunt", "me"][0] == "nephew" and got["gran", "me"][0] == "grandson"


def date(modifier=0, d=0, m=0, y=0, d2=0, m2=0, y2=0, quality=0, text=""):
    return (modifier, quality, d, m, y, False, d2, m2, y2, False, text, 0)


def test_dates(spark):
    rows = [(1, date(d=12, m=3, y=1885)), (2, date(4, 12, 3, 1885, 26, 3, 1885)), (3, date(5, 1, 1, 1900, 31, 12, 1910)), (4, date(7, 12, 3, 1885)), (5, date(6, text="at Easter")),
            (6, date()), (7, date(m=5, y=1900, quality=1)), (8, date(3, 31, 2, 1900)), (9, None), (10, date(8, y=1700))]
    df = spark.createDataFrame(rows, f"k int, date {dates.DATE_DDL}")
    got = {r.k: r.t for r in df.select("k", dates.date_text(F.col("date")).alias("t")).collect()}
    assert got == {1: "12 March 1885", 2: "between 12 March 1885 and 26 March 1885", 3: "from 01 January 1900 to 31 December 1910", 4: "from 12 March 1885", 5: "at Easter", 6: "date unknown",
                   7: "May 1900 (estimated)", 8: "about 1900", 9: "date unknown", 10: "to 1700"}
    shape = spark.createDataFrame([(0, 0, [1] * 4), (4, 0, [1] * 4), (5, 0, [1] * 8), (6, 0, None), (7, 0, [1] * 3), (9, 0, [1] * 4), (0, 3, [1] * 4)], "m int, q int, d array<int>")
    assert [r.e is None for r in shape.select(dates.shape_error(F.col("m"), F.col("q"), F.col("d")).alias("e")).collect()] == [True, False, True, True, False, False, False]
    one = spark.createDataFrame([(date(d=1, m=1, y=2000), date(d=31, m=12, y=2004)), (date(d=31, m=1, y=2001), date(d=1, m=3, y=2001))], f"a {dates.DATE_DDL}, b {dates.DATE_DDL}")
    assert [r[0] for r in one.select(dates.span_text(F.col("a"), F.col("b"), 3)).collect()] == ["4 years, 11 months, 30 days", "1 month, 1 day"]


def test_list_merging(spark):
    ref = T.StructType([T.StructField("ref", T.StringType()), T.StructField("role", T.StringType())])
    plain = T.StructType([T.StructField("type", T.StringType())])
    merged = lambda old, new, e: spark.createDataFrame([(old, new)], T.StructType([T.StructField("a", T.ArrayType(e)), T.StructField("b", T.ArrayType(e))])).select(changes.merge_lists(F.col("a"), F.col("b"), e)).first()[0]
    assert merged(["a"], ["a", "b", "b"], T.StringType()) == ["a", "b", "b"]
    assert merged([], ["b", "b"], T.StringType()) == ["b", "b"]
    assert [x.ref for x in merged([("a", "x")], [("a", "y"), ("b", "y"), ("b", "z")], ref)] == ["a", "b", "b"]
    assert [x.type for x in merged([], [("t",), ("t",)], plain)] == ["t"]


def test_changes(spark):
    people = spark.createDataFrame([("a", 1, ["t1"]), ("b", 0, None)], "handle string, gender int, tag_list array<string>")
    change = spark.createDataFrame([("a", None, ["t2"], ["tag_list"]), ("c", 2, ["t3"], ["gender", "tag_list"])], "handle string, gender int, tag_list array<string>, present array<string>")
    assert {r.handle: (r.gender, r.tag_list) for r in changes.upsert(people, change).collect()} == {"a": (1, ["t1", "t2"]), "b": (0, None), "c": (2, ["t3"])}
    assert {r.handle: r.tag_list for r in changes.upsert(people, change, ["tag_list"]).collect()}["a"] == ["t2"]
    with pytest.raises(ValueError):
        changes.upsert(people, change, ["nope_list"])
    tree = Tree(person=people, tag=spark.createDataFrame([("t1",), ("t9",)], "handle string"))
    new, refused = changes.guarded_delete(tree, "tag", spark.createDataFrame([("t1",), ("t9",)], "h string"))
    assert [r.handle for r in new.collect()] == ["t1"] and [(r.handle, r.referrers, r.first) for r in refused.collect()] == [("t1", 1, ["person:a"])]
    left, errors = changes.detach(people, "tag_list", spark.createDataFrame([("a", "t1"), ("a", "zz"), ("b", "t1"), ("q", "t1")], "handle string, ref string"))
    assert {r.handle: r.tag_list for r in left.collect()}["a"] == [] and {(r.handle, r.ref): r.reason for r in errors.collect()} == {("a", "zz"): "no such element", ("b", "t1"): "list is empty", ("q", "t1"): "no such record"}


def test_undo(spark):
    now = spark.createDataFrame([("a", '{"x": 2}'), ("b", '{"x": 9}')], "handle string, json string")
    log = spark.createDataFrame([("a", "update", '{"x":1}', '{"x":2}'), ("b", "add", None, '{"x":1}'), ("c", "delete", '{"x":3}', None)], "handle string, action string, old string, new string")
    inverse, conflicts = changes.undo(now, log)
    assert {(r.handle, r.action, r.new) for r in inverse.collect()} == {("a", "update", '{"x":1}'), ("c", "add", '{"x":3}')}
    assert [r.handle for r in conflicts.collect()] == ["b"]


def test_predicates_and_ingest(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ""), (2, [], "x"), (3, None, None)], "k int, l array<string>, s string")
    pick = lambda c: [r.k for r in df.where(c).collect()]
    assert pick(path("l").any(lambda x: x.eq("a"))) == [1] and pick(path("l").all(lambda x: x.eq("a"))) == [2, 3]
    assert pick(path("l")[1].eq("b")) == [1] and pick(path("s").truthy(T.StringType())) == [2] and pick(path("l").length().eq(0)) == [2, 3]
    assert pick(rules([F.col("k") > 1, F.col("k") > 2], "one")) == [2] and pick(path("s").contains("' or 1=1")) == []
    schema = T.StructType([T.StructField("handle", T.StringType()), T.StructField("gender", T.IntegerType())])
    lines = spark.createDataFrame([('{"handle": "a", "gender": 1}',), ('{"handle": "a", "typo": 1}',), ("[]",), ('{"gender": 1}',), ('{"handle": "a", "gender": "x"}',)], "value string")
    good, bad = ingest(lines, schema, ("handle",))
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"unknown: typo", "not an object", "missing: handle", "wrong type"}
    with pytest.raises(ValueError):
        paging.sort_columns("nope", {})
    assert spark.range(1).select(labels.record_label(F.lit(" "), F.lit("x"))).first()[0] == "x"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    relation = con.sql(SQL[name])
    assert columns == sorted(relation.columns)
    text = lambda v: "NULL" if v is None else v if isinstance(v, str) else f"{float(v):.6g}"
    want = sorted(tuple(text(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in frame.collect()) == want


@pytest.mark.parametrize(("name", "key"), [("walk_cap_all", "root"), ("relationship_pairs_all", "a")])
def test_every_person_has_a_row(spark, name, key):
    people = spark.read.parquet(f"{SF}/customer.parquet").count()
    got = [r[0] for r in QUERIES[name](spark, SF).select(key).collect()]
    assert len(got) == len(set(got)) == people > 100


def test_facts(spark):
    person = "handle string, birth_ref_index int, death_ref_index int, event_ref_list array<struct<ref:string>>, private boolean"
    life = {"dad": (1900, 1980), "mum": (1910, 1990), "late": (1950, None), "kid": (1930, None), "shy": (1955, None)}
    people = [(k, 0, 1 if d else -1, [(f"b-{k}",)] + ([(f"d-{k}",)] if d else []), k == "shy") for k, (b, d) in life.items()]
    events = [(f"b-{k}", "Birth", date(d=1, m=1, y=b)) for k, (b, _) in life.items()] + [(f"d-{k}", "Death", date(d=1, m=1, y=d)) for k, (_, d) in life.items() if d]
    events += [("w1", "Marriage", date(d=1, m=1, y=1929)), ("x1", "Divorce", date(d=1, m=1, y=1940)), ("w2", "Marriage", date(d=1, m=1, y=1970))]
    families = [("f1", "dad", "mum", [("kid",), ("shy",)], [("w1",), ("x1",)]), ("f2", "dad", "late", [], [("w2",)])]
    tree = Tree(
        person=spark.createDataFrame(people, person), event=spark.createDataFrame(events, f"handle string, type string, date {dates.DATE_DDL}"),
        family=spark.createDataFrame(families, "handle string, father_handle string, mother_handle string, child_ref_list array<struct<ref:string>>, event_ref_list array<struct<ref:string>>"),
    )
    status = spark.createDataFrame([(k, not d) for k, (_, d) in life.items()], "handle string, living boolean")
    first = lambda t, **kw: {r.fact: (r.handle, round(r.value / 365.25)) for r in timelines.ranked_facts(timelines.metric_facts(t, status, **kw), 1).collect()}
    got = first(tree)
    assert len(got) == 13 and got["youngest at marriage"] == ("mum", 19) and got["oldest at marriage"] == ("dad", 70)
    assert got["youngest father at a birth"] == ("dad", 30) and got["oldest mother at a birth"] == ("mum", 45) and got["youngest living"][0] == "shy"
    assert got["shortest marriage"] == ("f2", 10) and got["longest marriage"] == ("f1", 11)
    shown = first(timelines.visible(tree, status, private=True))
    assert shown["oldest mother at a birth"] == ("mum", 20) and shown["youngest living"][0] == "late"
    shown = first(timelines.visible(tree, status, "ExcludeAll"))
    assert set(shown) == {f"{a} {b}" for a in ("youngest", "oldest") for b in ("at death", "at marriage")} | {"longest marriage", "shortest marriage"} and shown["shortest marriage"][0] == "f1"
    assert first(tree, branch=spark.createDataFrame([("late",)], "h string"))["longest marriage"] == ("f2", 10)


def test_lost_records(spark):
    people = [("p1", 1, 0, [("d",), ("b",), ("gone",)], ["f1", "f9"], False), ("p2", 0, -1, [("b2",)], ["f1"], True), ("p3", 2, -1, [("gone",)], [], False), ("p4", -1, -1, None, None, None)]
    person = spark.createDataFrame(people, "handle string, birth_ref_index int, death_ref_index int, event_ref_list array<struct<ref:string>>, family_list array<string>, private boolean")
    event = spark.createDataFrame([("d", False), ("b", False), ("b2", False)], "handle string, private boolean")
    family = spark.createDataFrame([("f1", "p1", "p2", [("p3",), ("p2",)])], "handle string, father_handle string, mother_handle string, child_ref_list array<struct<ref:string>>")
    tree = references.without_private(Tree(person=person, event=event, family=family))
    got = {r.handle: (r.birth_ref_index, r.death_ref_index, [e.ref for e in r.event_ref_list or []], r.family_list) for r in tree.person.collect()}
    assert got == {"p1": (1, 0, ["d", "b"], ["f1"]), "p3": (-1, -1, [], []), "p4": (-1, -1, [], None)}
    f = tree.family.first()
    assert (f.father_handle, f.mother_handle, [c.ref for c in f.child_ref_list]) == ("p1", None, ["p3"])
    hidden = references.without_private(Tree(person=person, event=event.withColumn("private", F.col("handle") == "d"), family=family))
    assert hidden.person.where("handle = 'p1'").select("birth_ref_index", "death_ref_index").first() == (0, -1)


def test_search_records(spark):
    texts = spark.createDataFrame([("place", "s1", "old Mill"), ("tag", "t1", "mill, mill"), ("note", "n1", None), ("note", "n2", "a very old house")], "type string, handle string, text string")
    queries = spark.createDataFrame([(1, "MILL", None), (2, "mill", "tag"), (3, "old mill", None), (4, "mill nowhere", None), (5, "", None)], "query_id int, text string, type string")
    got = {(r.query_id, r.handle) for r in search.search_records(texts, queries).collect()}
    assert got == {(1, "s1"), (1, "t1"), (2, "t1"), (3, "s1")}
    assert search.search_records(texts.limit(0), queries).count() == 0
