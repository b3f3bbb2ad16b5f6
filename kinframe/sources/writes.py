"""Rules that records must fulfil before they are written, told for all rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions.dates import shape_error

#: Fields of every record, and of each type, with the kind of value; "!" marks those that must be there.
_COMMON = {"handle": "string", "record_id": "string", "note_list": "strings", "media_list": "objects", "attribute_list": "objects", "tag_list": "strings", "private": "flag", "change": "whole"}
_PICTURED = {"media_path": "string"}
FIELDS: dict[str, dict[str, str]] = {
    "person": _COMMON | {"primary_name": "object!", "gender": "whole!", "event_ref_list": "objects", "family_list": "strings", "parent_family_list": "strings", "urls": "objects"},
    "family": {"handle": "string", "father_handle": "string", "mother_handle": "string", "child_handles": "strings", "child_ref_list": "objects", "event_ref_list": "objects", "note_list": "strings", "urls": "objects", "media_list": "objects"},
    "event": {"handle": "string", "type": "string!", "date": "object", "description": "string", "place": "string", "citation_list": "strings!", "note_list": "strings"},
    "place": {
        "handle": "string", "record_id": "string", "name": "object", "code": "string", "alt_loc": "objects", "place_type": "string", "placeref_list": "objects", "alt_names": "objects", "lat": "string", "long": "string",
        "urls": "objects", "media_list": "objects", "citation_list": "strings", "note_list": "strings", "tag_list": "strings", "private": "flag",
    },
    "source": _COMMON | _PICTURED | {"title": "string!", "reporef_list": "objects", "author": "string", "pubinfo": "string", "abbrev": "string"},
    "citation": _COMMON | _PICTURED | {"date": "object", "page": "string", "source_handle": "string!"},
    "note": {"handle": "string", "text": "string or object!", "type": "string!"},
    "media": _PICTURED | {"handle": "string", "desc": "string!", "path": "string", "description": "string", "mime": "string", "citation_list": "strings", "note_list": "strings", "date": "object"},
    "repository": _COMMON | {"name": "string!", "type": "string!", "urls": "objects"},
    "tag": {"handle": "string", "name": "string!", "color": "string", "priority": "whole", "change": "string"},
}
#: Fixed value: what a handle looks like.
HANDLE = r"^[0-9a-f]{16,}\z"
_KINDS = {"string": "STRING", "whole": "BIGINT", "flag": "BOOLEAN", "object": "OBJECT", "objects": "ARRAY<(OBJECT.*|VOID)>", "strings": "ARRAY<(STRING|VOID)>", "string or object": "(STRING|OBJECT.*)"}
_SHOWN = {"whole": "a whole number", "flag": "true or false", "object": "an object", "objects": "a list of objects", "strings": "a list of handles", "string": "text", "string or object": "text or an object"}


def _fields(kind: str) -> list[tuple[str, str, bool]]:
    if kind not in FIELDS:
        raise ValueError(f"unknown record type {kind}; known are {', '.join(sorted(FIELDS))}")
    return [(f, k.removesuffix("!"), k.endswith("!")) for f, k in FIELDS[kind].items()]


def _date_reason(record: Column, field: str) -> Column:
    number = lambda name, none: F.coalesce(F.try_variant_get(record, f"$.{field}.{name}", "int"), F.lit(none))
    values = F.try_variant_get(record, f"$.{field}.dateval", "array<string>")
    return shape_error(number("modifier", 0), number("quality", 0), values)


def reasons(record: Column, line: Column, kind: str) -> Column:
    """Every rule that a record (as a variant, and its JSON text) of a type breaks, as "field: what is wrong", in the order of its fields."""
    fields, out = _fields(kind), []
    shape = {}
    for name, of, needed in fields:
        value = F.try_variant_get(record, f"$.{name}", "variant")
        there = value.isNotNull() & (F.schema_of_variant(value) != "VOID")
        shape[name] = (there, value)
        fits = F.schema_of_variant(value).rlike(f"^{_KINDS[of]}" + ("$" if not of.startswith("object") else ""))
        wrong = F.when(there & ~fits, f"{name}: must be {_SHOWN[of]}")
        out.append(F.when(~there, f"{name}: is required").otherwise(wrong) if needed else wrong)
    text = lambda name: F.try_variant_get(record, f"$.{name}", "string")
    if kind == "person":
        gender = F.try_variant_get(record, "$.gender", "int")
        out.append(F.when(~gender.between(0, 2), "gender: must be 0, 1 or 2"))
        refs = F.try_variant_get(record, "$.event_ref_list", "array<map<string,string>>")
        out.append(F.when(~F.forall(refs, lambda x: F.map_contains_key(x, "ref") & F.map_contains_key(x, "role")), "event_ref_list: each needs ref and role"))
        out.append(F.when(F.exists(refs, lambda x: F.size(F.array_except(F.map_keys(x), F.array(F.lit("ref"), F.lit("role")))) > 0), "event_ref_list: unknown keys"))
    if kind == "event":
        out.append(F.when(~text("place").rlike(HANDLE), "place: must be a handle, not a name"))
    if kind in ("source",):
        out.append(F.when(text("title") == "", "title: must not be empty"))
    if "date" in FIELDS[kind]:
        why = F.when(F.schema_of_variant(shape["date"][1]).startswith("OBJECT"), _date_reason(record, "date"))
        out.append(F.concat(F.lit("date: "), why))
    unknown = F.array_sort(F.array_except(F.json_object_keys(line), F.array(*(F.lit(f) for f, _, _ in fields))))
    return F.concat(F.array_compact(F.array(*out)), F.transform(unknown, lambda k: F.concat(k, F.lit(": is unknown"))))


def check_records(lines: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of JSON lines in column ``value``: accepted as they are to be written, rejected with all reasons.

    Nothing is dropped or guessed: a key that the type does not know, a value of another kind, a
    field that must be there, a date whose length does not suit its modifier, a place by
    name, a sex beyond 0 to 2 all refuse the row. A line that is no JSON object has the one reason "not an
    object". Accepted families have their ``child_handles`` as references in ``child_ref_list``, notes
    their text as an object with ``string``; all else is unchanged. Works on a stream too.
    """
    record = F.try_parse_json("value")
    is_object = F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False)) & F.json_object_keys("value").isNotNull()
    why = F.when(~is_object, F.array(F.lit("not an object"))).otherwise(reasons(record, F.col("value"), kind))
    judged = lines.withColumn("reasons", why)
    accepted = judged.where(F.size("reasons") == 0).drop("reasons")
    if kind == "family":
        accepted = _rewritten(accepted, "child_handles", "child_ref_list", F.to_json(F.transform(F.from_json(F.get_json_object("value", "$.child_handles"), "array<string>"), lambda c: F.struct(c.alias("ref")))))
    if kind == "note":
        plain = F.schema_of_variant(F.try_variant_get(record, "$.text", "variant")) == "STRING"
        accepted = _rewritten(accepted, "text", "text", F.when(plain, F.to_json(F.struct(F.get_json_object("value", "$.text").alias("string")))))
    return accepted, judged.where(F.size("reasons") > 0)


def _rewritten(rows: DataFrame, old: str, new: str, json: Column) -> DataFrame:
    """Lines whose field ``old`` becomes ``new`` with the value ``json``, where that is not null; the other fields keep their values."""
    fields = F.from_json("value", "map<string,variant>")
    rest = F.map_filter(fields, lambda k, v: ~k.isin(old, new))
    parts = F.transform(F.map_entries(rest), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.to_json(e["value"])))
    whole = F.concat(F.lit("{"), F.array_join(F.concat(parts, F.array(F.concat(F.lit(f'"{new}":'), json))), ","), F.lit("}"))
    return rows.withColumn("value", F.when(json.isNotNull(), whole).otherwise(F.col("value")))
