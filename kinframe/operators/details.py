"""Everything there is to say about each person and each family, as nested sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions.dates import date_text, sort_key
from kinframe.functions.labels import display_name, gender_letter
from kinframe.operators.references import close_kin, event_places
from kinframe.operators.timelines import CLOSE, kin_word
from kinframe.tree import Tree

#: Characters of a note shown.
EXCERPT = 50


def _id(df: DataFrame) -> Column:
    return F.coalesce(F.nullif("record_id", F.lit("")), F.col("handle")) if "record_id" in df.columns else F.col("handle")


def _empty(handle: Column) -> Column:
    """What stands for a person who is not there."""
    return F.struct(handle.alias("handle"), handle.alias("id"), *(F.lit(None).cast("string").alias(c) for c in ("name", "sex", "birth", "death")))


def _citations(tree: Tree) -> DataFrame:
    """The events with ``citations``, the ids of their citations in their order; a citation that is not there is left out.

    Citations whose id is their handle need no look-up, so only those that are not there or have an id of their own
    go back to the events that list them.
    """
    own = _id(tree.citation)
    known = tree.citation.select(F.col("handle").alias("citation"), F.when(own != F.col("handle"), own).alias("cited"), F.lit(True).alias("there"))
    met = tree.event.select(F.col("handle").alias("__event"), F.explode("citation_list").alias("citation")).join(known.hint("merge"), "citation", "left")
    of = met.where("citation is not null and (there is null or cited is not null)").groupBy("__event").agg(F.map_from_entries(F.collect_set(F.struct("citation", "cited"))).alias("__ids"))
    e = tree.event.join(of.hint("merge"), F.col("handle") == F.col("__event"), "left")
    shown = F.transform(F.coalesce("citation_list", F.array().cast("array<string>")), lambda x: F.when(F.coalesce(F.map_contains_key("__ids", x), F.lit(False)), F.col("__ids")[x]).otherwise(x))
    return e.withColumn("citations", F.filter(shown, lambda x: x.isNotNull())).drop("__event", "__ids")


def _events(tree: Tree) -> DataFrame:
    """(event, told): id, type, date, place and the ids of its citations."""
    e = _citations(tree).select(F.col("handle").alias("event"), _id(tree.event).alias("id"), "type", date_text(F.col("date")).alias("date"), sort_key(F.col("date")).alias("sortval"), "place", "citations")
    e = e.join(event_places(tree), "place", "left") if tree.place is not None else e.withColumn("path", F.lit(None).cast("string"))
    return e.select("event", F.struct("sortval", "event", "id", "type", "date", F.coalesce("path", F.lit("")).alias("place"), "citations").alias("told"))


def _lives(tree: Tree, weddings: bool = False) -> DataFrame:
    """(handle, who, gender, own, born, died, wed) of everyone who is in the person table or takes part in an event.

    ``who``: name, sex, id, birth and death dates as text, null where there is no such event; null for one who is not in the
    person table. ``own``: dated events with the role in them. ``wed``: with ``weddings``, rows for the families are among
    them, by the families' handles, with the first event whose type is marriage or married, whatever the case.
    References meet their events once and go to their person once, whatever is told of them.
    """
    none = F.lit(None).cast("int").alias("wed")
    own = tree.person.select(F.col("handle").alias("person"), F.posexplode("event_ref_list").alias("pos", "r"), "birth_ref_index", "death_ref_index").select(
        F.col("r.ref").alias("event"), "person", none, F.coalesce(F.nullif(F.col("r.role"), F.lit("")), F.lit("Unknown")).alias("role"),
        F.coalesce(F.col("pos") == F.col("birth_ref_index"), F.lit(False)).alias("birth"), F.coalesce(F.col("pos") == F.col("death_ref_index"), F.lit(False)).alias("death"))
    fam = tree.family.select("handle", "father_handle", "mother_handle", F.posexplode("event_ref_list.ref").alias("pos", "event"))
    sides = [("father_handle", none, F.lit("Husband")), ("mother_handle", none, F.lit("Wife"))] + [("handle", F.col("pos").alias("wed"), F.lit(None).cast("string"))] * weddings
    for side, wed, role in sides:
        own = own.union(fam.select("event", side, wed, role, F.lit(False), F.lit(False)))
    took = own.where("event is not null and person is not null").repartition("event").groupBy("event", "person", "wed").agg(F.min("role").alias("role"), F.max("birth").alias("birth"), F.max("death").alias("death"))
    rows = took.join(_events(tree).hint("merge"), "event", "left").drop("event")
    rows = rows.where(F.when(F.col("wed").isNotNull(), F.lower("told.type").isin("marriage", "married")).otherwise(F.col("told").isNotNull() | F.col("birth") | F.col("death")))
    at = lambda c, value: F.first(F.when(F.col(c), value), True)
    date = F.coalesce("told.date", F.lit("date unknown"))
    record = F.struct(_id(tree.person).alias("id"), gender_letter(F.col("gender")).alias("sex"), display_name(F.col("primary_name.first_name"), F.col("primary_name.surname_list.surname")).alias("name"), "gender")
    rows = rows.unionByName(tree.person.select(F.col("handle").alias("person"), record.alias("record")), allowMissingColumns=True).where("person is not null")
    lives = rows.repartition("person").groupBy("person").agg(
        F.collect_list(F.when(F.col("wed").isNull() & (F.col("told.sortval") > 0), F.struct("told", "role"))).alias("own"), F.min_by("told", "wed").alias("wed"), F.first("record", True).alias("r"),
        at("birth", F.col("told")).alias("born"), at("death", F.col("told")).alias("died"), at("birth", date).alias("birth"), at("death", date).alias("death"))
    who = F.when(F.col("r").isNotNull(), F.struct(F.col("person").alias("handle"), "r.id", "r.name", "r.sex", "birth", "death"))
    return lives.select(F.col("person").alias("handle"), who.alias("who"), "r.gender", "own", "born", "died", "wed")


def _listed(tree: Tree, kind: str, field: str, dst: str, label: Column, out: str) -> DataFrame:
    """(handle, out): (id, label) of the records of a list, in its order; one that is not there by its handle, without a label."""
    df, target = getattr(tree, kind), getattr(tree, dst)
    shape = "array<struct<id:string,label:string>>"
    if field not in df.columns or target is None:
        return df.select("handle", F.array().cast(shape).alias(out))
    ref = F.col(f"{field}.ref") if dst == "media" else F.col(field)
    rows = df.select("handle", F.posexplode(ref).alias("pos", "ref"))
    found = rows.join(target.select(F.col("handle").alias("ref"), _id(target).alias("id"), label.alias("label")), "ref", "left")
    return found.groupBy("handle").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", "ref").alias("id"), "label"))).alias("l")).select("handle", F.transform("l", lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"))).cast(shape).alias(out))


def _attachments(tree: Tree, kind: str) -> list[DataFrame]:
    text = F.coalesce(F.col("text.string"), F.lit(""))
    excerpt = F.when(F.length(text) > EXCERPT, F.concat(F.substring(text, 1, EXCERPT), F.lit("..."))).otherwise(text)
    return [_listed(tree, kind, "media_list", "media", F.coalesce(F.col("desc"), F.lit("")), "media"), _listed(tree, kind, "note_list", "note", excerpt, "notes")]


def _with(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """``df`` with one column of each part by handle; lists that are not there are empty."""
    for part in parts:
        name, kind = part.columns[1], part.schema[part.columns[1]].dataType
        df = df.join(part, "handle", "left")
        if kind.typeName() == "array":
            df = df.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return df


def person_sections(tree: Tree) -> DataFrame:
    """(handle, who, born, died, parents, siblings, spouses, children, timeline, media, notes) of every person.

    ``who`` and each relative: handle, id, name, sex, birth and death. ``born`` and ``died``: the event with date,
    place and citations. ``timeline``: dated own events and the births and deaths of parents, siblings, spouses and
    children, by day, each with whose it is, their relation, their role (that of their own reference) and citations. ``media`` and
    ``notes``: in the order of their lists, a record that is not there by its handle. One bad
    reference never loses a person: relatives without a record stand by their handle.
    """
    lives = _lives(tree)
    vital = F.filter("own", lambda x: x["told"]["type"].isin("Birth", "Death"))
    near = lives.select(F.col("handle").alias("kin"), "who", "gender", vital.alias("vital"))
    kind = F.array_position(F.array(*map(F.lit, CLOSE)), F.col("relation")).cast("int") - 1
    kin = close_kin(tree).hint("merge").join(near, "kin", "left").select("person", "kin", kind.alias("kind"), "who", kin_word(kind, F.lit(1), F.col("gender")).alias("word"), "vital")
    listed = kin.repartition("person").groupBy(F.col("person").alias("handle")).agg(F.array_sort(F.collect_list(F.struct("kin", "kind", "who", "word", "vital"))).alias("kin"))
    rows = lives.where("who is not null").join(listed, "handle", "left").withColumn("kin", F.coalesce("kin", F.array().cast(listed.schema["kin"].dataType)))
    of = lambda relation: F.array_sort(F.transform(F.filter("kin", lambda k: k["kind"] == CLOSE.index(relation)), lambda k: F.coalesce(k["who"], _empty(k["kin"]))))
    line = lambda events, who, relation: F.transform(events, lambda x: F.struct(x["told"].alias("told"), who["id"].alias("person_id"), who["name"].alias("name"), relation.alias("relation"), x["role"].alias("role")))
    # who is kin in several ways stands once in the timeline, with the first of them
    once = F.filter("kin", lambda k, i: (k["kin"] != F.col("handle")) & ((i == 0) | ~F.get("kin", i - 1)["kin"].eqNullSafe(k["kin"])))
    theirs = F.flatten(F.transform(once, lambda k: line(F.coalesce(k["vital"], F.array().cast(lives.schema["own"].dataType)), k["who"], k["word"])))
    sections = rows.select(
        "handle", "who", "born", "died", *(of(r).alias(c) for r, c in (("parent", "parents"), ("sibling", "siblings"), ("spouse", "spouses"), ("child", "children"))),
        F.array_sort(F.concat(line(F.col("own"), F.col("who"), F.lit("self")), theirs)).alias("timeline"))
    return _with(sections, _attachments(tree, "person"))


def family_sections(tree: Tree) -> DataFrame:
    """(handle, id, father, mother, children, married, timeline, media, notes) of every family.

    Parents and children as in :func:`person_sections`, children in their order. ``married`` is the first event of
    the family whose type is marriage or married, whatever the case. ``timeline``: dated events of all members and of the family, by day,
    with whose it is and the role. Records that are not there stand by their handle.
    """
    f, lives = tree.family, _lives(tree, weddings=True)
    member = lambda side, person: f.select(F.col("handle").alias("family"), F.col(person).alias("person"), F.lit(side).alias("side"), F.lit(0).alias("pos"))
    members = member("father", "father_handle").union(member("mother", "mother_handle")).where("person is not null").union(member("family", "handle"))
    members = members.union(f.select("handle", F.posexplode("child_ref_list.ref").alias("pos", "child")).select("handle", "child", F.lit("child"), "pos"))
    met = members.hint("merge").join(lives.withColumnRenamed("handle", "person").drop("born", "died", "gender"), "person", "left")
    met = met.select("family", F.struct(
        "person", (F.col("side") == "family").alias("itself"), "pos", "side", F.when(F.col("side") == "family", F.col("wed")).alias("wed"), "who",
        F.when(F.col("side") != "family", F.col("own")).alias("own")).alias("m"))
    listed = met.repartition("family").groupBy(F.col("family").alias("handle")).agg(F.array_sort(F.collect_list("m")).alias("m"))
    named = lambda x: F.when(x["person"].isNotNull(), F.coalesce(x["who"], _empty(x["person"])))
    at = lambda side: F.filter("m", lambda x: x["side"] == side)
    kids = F.transform(F.array_sort(F.transform(at("child"), lambda x: F.struct(x["pos"].alias("pos"), named(x).alias("who")))), lambda x: x["who"])
    # who stands in several places of a family has their events once in its timeline
    once = F.filter("m", lambda x, i: ~x["itself"] & x["person"].isNotNull() & ((i == 0) | ~(F.get("m", i - 1)["person"].eqNullSafe(x["person"]))))
    line = F.flatten(F.transform(once, lambda x: F.transform(F.coalesce(x["own"], F.array().cast(lives.schema["own"].dataType)), lambda e: F.struct(
        e["told"].alias("told"), x["who"]["id"].alias("person_id"), x["who"]["name"].alias("name"), e["role"].alias("role")))))
    rows = f.select("handle", _id(f).alias("id")).join(listed, "handle").select(
        "handle", "id", named(F.get(at("father"), 0)).alias("father"), named(F.get(at("mother"), 0)).alias("mother"), kids.alias("children"),
        F.get(at("family"), 0)["wed"].alias("married"), F.array_sort(line).alias("timeline"))
    return _with(rows, _attachments(tree, "family"))
