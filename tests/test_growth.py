"""How plans grow: which tables are derived, what is broadcast, what is shuffled."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kinframe.functions.dates import DATE_DDL
from kinframe.operators import details, graph, references, search, timelines
from kinframe.plans import checkpoints, deep_queries, demo
from kinframe.tree import Tree

SF = "/root/testdata/sf0.001"
DATE_FIELDS = "modifier quality d1 m1 y1 s1 d2 m2 y2 s2 text sortval".split()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def fixed_plan(spark, make) -> str:
    """The plan of ``make()`` as it is without adaptive changes, where a shuffle that is used again is told."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return plan(make())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def tree(spark, monkeypatch):
    monkeypatch.setattr(demo, "_stored", {})
    return demo.demo_tree(spark, SF)


def written(tree) -> set[str]:
    folder = tree._base._folder.removeprefix("file:")
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


def test_only_the_tables_asked_for_are_derived(spark, tree):
    assert written(tree) == set()
    graph.parent_edges(tree).count()
    assert written(tree) == {"family"}
    other = tree.with_tables(person=tree.family.select("handle"))
    assert other.event is tree.event and written(tree) == {"family", "event"}
    assert set(tree.tables()) == {"person", "family", "event", "place", "source", "citation", "repository", "media", "note", "tag"}


def test_citation_lists_are_gathered_where_they_are_looked_at(spark, tree):
    assert "Join" not in plan(tree.event.select("handle", "date"))
    got = {r.handle: r.citation_list for r in tree.event.collect()}
    want = {}
    for r in demo.flat(spark, SF, "citation").collect():
        want.setdefault(r.event_handle, []).append(r.handle)
    assert any(got.values()) and got == {h: sorted(want.get(h, [])) for h in got}


def test_people_are_never_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(demo.flat(spark, SF, "family"))


def test_citations_meet_sources_last(spark, tree):
    text = references.evidence_chain(tree)._jdf.queryExecution().optimizedPlan().toString()
    assert "source_handle" in next(line for line in text.splitlines() if "Join" in line)


def test_backlinks_take_one_aggregation(spark, tree):
    strings = "array<string>"
    person = spark.createDataFrame([("P1", ["F1", "F1"], ["F1", "F2"]), ("P2", ["F1"], None)], f"handle string, family_list {strings}, parent_family_list {strings}")
    got = {(r.dst, r.src_type): r.referrers for r in references.backlinks(Tree(person=person)).collect()}
    assert got == {("F1", "person"): 2, ("F2", "person"): 1}
    assert references.backlinks(tree)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 2


def test_a_large_level_is_shuffled(spark, monkeypatch):
    edges = spark.createDataFrame([(f"c{i}", f"c{i // 2}") for i in range(1, 60)], "child string, parent string")
    small = sorted(map(tuple, graph.closure(edges, 4).collect()))
    monkeypatch.setattr(checkpoints, "FEW", 0)
    assert "SortMergeJoin" in plan(edges.join(checkpoints.beside(edges.withColumnRenamed("parent", "p"), 60), "child"))
    assert sorted(map(tuple, graph.closure(edges, 4).collect())) == small


def test_duplicates_compare_distinct_names_once(spark):
    rows = [(f"h{i}", "Anna" if i < 40 else f"Ann{i}", "Smith", 1850, "x") for i in range(60)] + [("q", None, "Smith", 1851, "x"), ("r", "Anna", "Smith", 1901, "x")]
    people = spark.createDataFrame(rows, "handle string, first_name string, surname string, birth_year int, place string")
    out = search.duplicate_candidates(people)
    got = {(r.a, r.b): r.edits for r in out.collect()}
    assert len(got) == out.count() and all(a < b for a, b in got)
    assert sum(e == 0 for e in got.values()) == 40 * 39 // 2 and got["h0", "h41"] == 2 and got["h41", "h51"] == 1
    assert "levenshtein(na" in plan(out)


def test_backlinks_of_families_look_at_people_alone(spark, tree):
    got = references.extended_backlinks(tree, "family")
    assert written(tree) == {"person"} and got.where("label is null").isEmpty()
    assert got.count() == references.edges(tree, "family").select("dst", "src").distinct().count()


def test_timelines_tell_events_before_kin(spark, tree):
    text = timelines.person_timeline(tree)._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in text.splitlines() if "Join" in line and "relation" in line]
    assert len(met) == 1 and "type" in met[0] and "person" in met[0]


def test_citations_are_gathered_once(spark, tree):
    base, tree = tree, demo.cited_tree(spark, SF)
    text = fixed_plan(spark, lambda: references.evidence_chain(tree))
    assert "ReusedExchange" in text and written(base) == {"event", "source", "repository"}
    got, want = tree.citation, demo.flat(spark, SF, "citation").select("handle", F.col("handle").alias("record_id"), "source_handle", "page", "confidence")
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_items_without_keys_stay(spark, tmp_path):
    item = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int"
    spark.createDataFrame([(1, 2, 3, 4), (1, 2, 3, 4), (1, 2, None, 4), (None, 2, 3, 4), (None, 2, 3, 4), (1, None, 3, 5)], item).write.parquet(f"{tmp_path}/lineitem.parquet")
    sf = str(tmp_path)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(demo.citations(spark, sf).drop("record_id")) == rows(demo.flat(spark, sf, "citation").drop("event_handle"))
    assert [r.citation_list for r in demo.cited_events(spark, sf).collect()] == [["C1-2-3-4"]]
    assert {r.source_handle: [x.ref for x in r.reporef_list] for r in demo.repository_lists(spark, sf).collect()} == {"Q000000002": [None, "L000000003"], None: ["L000000003"]}


def told_once(text: str) -> bool:
    """Events are neither written with all that is told of them nor shuffled by their place, and go to their person in one shuffle."""
    by_person = [line for line in text.splitlines() if "- Exchange hashpartitioning(person" in line and "REPARTITION" in line]
    return len(by_person) <= 2 and "hashpartitioning(place" not in text and not any("told" in line for line in text.splitlines() if "ExistingRDD" in line)


def test_persons_have_their_events_from_one_shuffle(spark, tree):
    text = fixed_plan(spark, lambda: details.person_sections(demo.cited_tree(spark, SF)))
    assert told_once(text) and text.count("ReusedExchange") >= 2 and "citation" not in written(tree)
    assert "hashpartitioning(place" not in fixed_plan(spark, lambda: timelines.kin_timeline(tree))


def test_citations_are_told_by_id(spark):
    event = spark.createDataFrame([("e1", ["c2", "c1", "lost", "c2", "c3"]), ("e2", None), ("e3", ["c1"])], "handle string, citation_list array<string>")
    citation = spark.createDataFrame([("c1", "c1"), ("c2", "C0002"), ("c3", "")], "handle string, record_id string")
    got = {r.handle: r.citations for r in details._citations(Tree(event=event, citation=citation)).collect()}
    assert got == {"e1": ["C0002", "c1", "C0002", "c3"], "e2": [], "e3": ["c1"]}


def test_families_have_their_events_from_one_shuffle(spark, tree, monkeypatch):
    made, details_of = [], details.family_sections
    monkeypatch.setattr(details, "family_sections", lambda t: made.append(t) or details_of(t))
    text = fixed_plan(spark, lambda: deep_queries.family_sections(spark, SF))
    assert made and told_once(text) and "ReusedExchange" in text and written(tree) == {"event", "family", "person", "place"}


def test_who_stands_twice_in_a_family(spark):
    refs = "array<struct<ref:string,role:string>>"
    person = spark.createDataFrame([("a", -1, -1, [("e", "Primary")], None)], f"handle string, birth_ref_index int, death_ref_index int, event_ref_list {refs}, gender int")
    person = person.withColumn("primary_name", F.struct(F.lit("A").alias("first_name"), F.array(F.struct(F.lit("B").alias("surname"))).alias("surname_list")))
    family = spark.createDataFrame([("a", "a", "a", [("a",), (None,)], [("w", "Family")]), ("b", None, None, None, [("w", "Family")])], f"handle string, father_handle string, mother_handle string, child_ref_list array<struct<ref:string>>, event_ref_list {refs}")
    event = spark.createDataFrame([("e", "Census"), ("w", "Marriage")], "handle string, type string").select("*", F.struct(*(F.lit(v).alias(c) for c, v in zip(DATE_FIELDS, (0, 0, 1, 1, 1900, False, 0, 0, 0, False, "", 0)))).cast(DATE_DDL).alias("date"), F.lit(None).cast("string").alias("place"), F.array().cast("array<string>").alias("citation_list"))
    citation = spark.createDataFrame([], "handle string, record_id string")
    got = {r.handle: r for r in details.family_sections(Tree(person=person, family=family, event=event, citation=citation)).collect()}
    a, b = got["a"], got["b"]
    assert [x and x.handle for x in (a.father, a.mother, *a.children)] == ["a", "a", "a", None] and sorted((x.told.event, x.role) for x in a.timeline) == [("e", "Primary"), ("w", "Husband")]
    assert a.married.event == b.married.event == "w" and (b.father, b.mother, b.children, b.timeline) == (None, None, [], [])


def test_large_blocks_meet_by_what_is_left(spark, monkeypatch):
    rnd = random.Random(3)
    names = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(6))) for _ in range(150)} | {"", "a", "aa", "aaa", "aaaa", "aaaaa", "baaa"}
    blocks = [(1850, ""), (1900, "Customer#00")]
    rows = [(f"{year}-{i}-{k}", start + name, "Smith", year, 1) for year, start in blocks for i, name in enumerate(sorted(names)) for k in range(1 + i % 2)]
    people = spark.createDataFrame(rows, "handle string, first_name string, surname string, birth_year int, place int")
    pairs = lambda most: sorted((r.a, r.b, r.edits) for r in search.duplicate_candidates(people, most).collect())
    for most in (0, 1, 2, 3):
        both = people.alias("x").join(people.alias("y"), (F.col("x.birth_year") == F.col("y.birth_year")) & (F.col("x.handle") < F.col("y.handle")))
        want = sorted(map(tuple, both.select("x.handle", "y.handle", F.levenshtein("x.first_name", "y.first_name").alias("e")).where(F.col("e") <= most).collect()))
        monkeypatch.setattr(search, "FEW_NAMES", 0)
        assert pairs(most) == want
        monkeypatch.setattr(search, "FEW_NAMES", len(names) if most % 2 else 1000)
        assert pairs(most) == want
    many = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("handle"), F.sha2(F.col("id").cast("string"), 256).substr(1, 12).alias("first_name"), F.lit("Smith").alias("surname"), F.lit(1850).alias("birth_year"), F.lit(1).alias("place"))
    monkeypatch.setattr(search, "FEW_NAMES", 128)
    assert "key" in next(line for line in plan(search.duplicate_candidates(many)).splitlines() if "Join" in line and "levenshtein" in line)
    assert search.duplicate_candidates(many).isEmpty()
