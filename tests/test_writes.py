"""Every rule for records to be written, with its message."""

import json

import pytest

from kinframe.sources.writes import check_records

H = "0123456789abcdef"
CASES = {
    "person": [
        ({"primary_name": {"first_name": "A"}, "gender": 1, "event_ref_list": [{"ref": "e", "role": "Primary"}], "private": False, "change": 5}, []),
        ({"gender": 3}, ["primary_name: is required", "gender: must be 0, 1 or 2"]),
        ({"primary_name": "A", "gender": "1"}, ["primary_name: must be an object", "gender: must be a whole number"]),
        ({"primary_name": {}, "gender": 0, "event_ref_list": [{"ref": "e"}]}, ["event_ref_list: each needs ref and role"]),
        ({"primary_name": {}, "gender": 0, "event_ref_list": [{"ref": "e", "role": "r", "x": 1}], "sex": 1}, ["event_ref_list: unknown keys", "sex: is unknown"]),
        ({"primary_name": {}, "gender": 0, "family_list": [], "event_ref_list": [], "media_list": ["m"]}, ["media_list: must be a list of objects"]),
        ({"primary_name": {}, "gender": None}, ["gender: is required"]),
    ],
    "event": [
        ({"type": "Birth", "citation_list": ["c"], "place": H, "date": {"dateval": [1, 2, 1900, False]}}, []),
        ({"type": "Birth"}, ["citation_list: is required"]),
        ({"type": "Birth", "citation_list": [], "place": "Lyon"}, ["place: must be a handle, not a name"]),
        ({"type": "Birth", "citation_list": [], "place": H + "\n"}, ["place: must be a handle, not a name"]),
        ({"type": "Birth", "citation_list": [], "date": {"dateval": [1, 2, 1900]}}, ["date: needs 4 entries"]),
        ({"type": "Birth", "citation_list": [], "date": {"modifier": 4, "dateval": [1, 2, 1900, False]}}, ["date: needs 8 entries"]),
        ({"type": "Birth", "citation_list": [], "date": {"modifier": 6, "text": "once"}}, []),
        ({"type": "Birth", "citation_list": [], "date": {"modifier": 9, "dateval": [1, 2, 1900, False]}}, ["date: modifier outside 0..8"]),
        ({"type": "Birth", "citation_list": [], "date": "1900"}, ["date: must be an object"]),
    ],
    "source": [({"title": "T"}, []), ({"title": ""}, ["title: must not be empty"]), ({"author": "x"}, ["title: is required"])],
    "citation": [({"source_handle": "s"}, []), ({"page": 4}, ["page: must be text", "source_handle: is required"])],
    "place": [({"alt_names": [{"value": "L"}]}, []), ({"alt_names": ["L"]}, ["alt_names: must be a list of objects"]), ({"media_list": ["m"], "lat": 4.5}, ["lat: must be text", "media_list: must be a list of objects"])],
    "repository": [({"name": "n", "type": "Archive"}, []), ({"name": "n"}, ["type: is required"])],
    "tag": [({"name": "t", "priority": 1}, []), ({"priority": "1"}, ["name: is required", "priority: must be a whole number"])],
    "media": [({"desc": "d"}, []), ({"desc": "d", "private": True}, ["private: is unknown"])],
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_rules(spark, kind):
    lines = [json.dumps(r) for r, _ in CASES[kind]] + ["[1]", "no json", "{"]
    good, bad = check_records(spark.createDataFrame([(x,) for x in lines], "value string"), kind)
    got = {r.value: list(r.reasons) for r in bad.collect()}
    assert got == {json.dumps(r): why for r, why in CASES[kind] if why} | {x: ["not an object"] for x in lines[-3:]}
    assert {r.value for r in good.collect()} == {json.dumps(r) for r, why in CASES[kind] if not why}


def test_shapes_to_write(spark):
    frame = lambda *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    good, bad = check_records(frame({"father_handle": "f", "child_handles": ["a", 'b"'], "child_ref_list": [{"ref": "z"}]}, {"child_ref_list": [{"ref": "c", "frel": "Birth"}]}, {"child_handles": "a"}), "family")
    assert [json.loads(r.value) for r in good.collect()] == [{"father_handle": "f", "child_ref_list": [{"ref": "a"}, {"ref": 'b"'}]}, {"child_ref_list": [{"ref": "c", "frel": "Birth"}]}]
    assert [list(r.reasons) for r in bad.collect()] == [["child_handles: must be a list of handles"]]
    good, bad = check_records(frame({"text": 'say "so"', "type": "x"}, {"text": {"string": "y", "tags": []}, "type": "x"}, {"text": 5, "type": "x"}), "note")
    assert [json.loads(r.value) for r in good.collect()] == [{"text": {"string": 'say "so"'}, "type": "x"}, {"text": {"string": "y", "tags": []}, "type": "x"}]
    assert [list(r.reasons) for r in bad.collect()] == [["text: must be text or an object"]]
    with pytest.raises(ValueError):
        check_records(frame({}), "user")
