"""Sections of people and families: nothing is lost through a bad reference."""

from kinframe.operators import details
from kinframe.tree import Tree

from tests.test_kinship import DATE, dated


def small(spark):
    refs = "array<struct<ref:string,role:string>>"
    person = [
        ("p1", "I1", 1, 0, 1, [("e1", "Primary"), ("gone", "Primary")], [("m1",), ("m9",)], ["n1", "n9"], ("Ann", [("Bee",)])),
        ("p2", None, 0, -1, -1, [], None, None, ("Cy", [])),
    ]
    return Tree(
        person=spark.createDataFrame(person, f"handle string, record_id string, gender int, birth_ref_index int, death_ref_index int, event_ref_list {refs}, media_list array<struct<ref:string>>, note_list array<string>, primary_name struct<first_name:string,surname_list:array<struct<surname:string>>>"),
        family=spark.createDataFrame([("f1", "F1", "p1", "lost", [("p2",), ("kid",)], [("e0", "Family"), ("e2", "Family")])], f"handle string, record_id string, father_handle string, mother_handle string, child_ref_list array<struct<ref:string>>, event_ref_list {refs}"),
        event=spark.createDataFrame([("e1", "E1", "Birth", dated(1900), "s1", ["c1", "c9"]), ("e0", "E0", "Divorce", dated(1940), None, []), ("e2", "E2", "MARRIED", dated(1930), "s2", [])], f"handle string, record_id string, type string, date {DATE}, place string, citation_list array<string>"),
        place=spark.createDataFrame([("s1", "Town", "", [])], "handle string, name string, title string, placeref_list array<struct<ref:string>>"),
        citation=spark.createDataFrame([("c1", "C1")], "handle string, record_id string"),
        note=spark.createDataFrame([("n1", "N1", ("x" * 60,))], "handle string, record_id string, text struct<string:string>"),
        media=spark.createDataFrame([("m1", "O1", None)], "handle string, record_id string, desc string"),
    )


def test_sections(spark):
    t = small(spark)
    p = {r.handle: r for r in details.person_sections(t).collect()}
    one, two = p["p1"], p["p2"]
    assert (one.who.name, one.who.sex, one.who.birth, one.who.death) == ("Ann Bee", "M", "01 January 1900", "date unknown") and one.born.place == "Town" and one.born.citations == ["C1"] and one.died is None
    assert [(x.id, x.label) for x in one.media] == [("O1", ""), ("m9", None)] and [(x.id, x.label) for x in one.notes] == [("N1", "x" * 50 + "..."), ("n9", None)]
    assert {x.handle for x in one.children} == {"p2", "kid"} and [(x.handle, x.name) for x in one.spouses] == [("lost", None)]
    assert [(x.told.event, x.relation, x.role) for x in one.timeline] == [("e1", "self", "Primary"), ("e2", "self", "Husband"), ("e0", "self", "Husband")]
    assert two.who.id == "p2" and two.media == [] and two.timeline[0].relation == "father" and [x.handle for x in two.siblings] == ["kid"]
    (f,) = details.family_sections(t).collect()
    assert f.father.name == "Ann Bee" and f.mother.handle == "lost" and f.mother.name is None and [x.handle for x in f.children] == ["p2", "kid"]
    assert (f.married.event, f.married.place) == ("e2", "") and [x.told.event for x in f.timeline] == ["e1", "e2", "e2", "e0", "e0"] and f.notes == []
