"""Timelines, ages, and living status for whole trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions.dates import last_day, julian_day, sort_key, span_parts
from kinframe.operators.graph import parent_edges, relation_label
from kinframe.operators.kinship import lines
from kinframe.operators.lives import vital_years
from kinframe.operators.references import close_kin, event_participants, event_places, vital_events
from kinframe.plans.checkpoints import cut
from kinframe.tree import Tree

#: Classes of event types; any other type is custom.
EVENT_CLASSES = {
    "vital": ("Birth", "Adoption", "Baptism", "Death", "Burial", "Cremation"),
    "family": (
        "Engagement", "Marriage", "Marriage Settlement", "Marriage License", "Marriage Contract", "Marriage Banns",
        "Divorce Filing", "Divorce", "Annulment", "Alternate Marriage",
    ),
    "religious": ("Christening", "Adult Christening", "Confirmation", "First Communion", "Blessing", "Bar Mitzvah", "Bas Mitzvah", "Religion"),
    "vocational": ("Occupation", "Retirement", "Elected", "Military Service", "Ordination"),
    "academic": ("Education", "Degree", "Graduation"),
    "travel": ("Emigration", "Immigration", "Naturalization"),
    "legal": ("Probate", "Will"),
    "residence": ("Residence", "Census", "Property"),
    "other": ("Cause of Death", "Medical Information", "Title of Nobility", "Number of Marriages"),
}


def event_class(type_col: str = "type"):
    out = F.lit("custom")
    for name, types in EVENT_CLASSES.items():
        out = F.when(F.col(type_col).isin(*types), name).otherwise(out)
    return out


def person_timeline(tree: Tree, persons: DataFrame | None = None, relatives: bool = True, classes: tuple[str, ...] | None = None, discard_undated: bool = True) -> DataFrame:
    """(anchor, event, person, relation, label, sortval, age_years): own events and kin's births and deaths.

    ``persons`` (first column handles) limits the anchors; all by default. Birth
    and death stay whatever ``classes`` asks for. Undated events go unless told
    otherwise. Age is the anchor's, in years, where both dates are known and the
    event is not before birth.
    """
    anchors = tree.person.select(F.col("handle").alias("anchor"))
    if persons is not None:
        anchors = anchors.join(persons.select(F.col(persons.columns[0]).alias("anchor")), "anchor", "left_semi")
    people = anchors.select("anchor", F.col("anchor").alias("person"), F.lit("self").alias("relation"))
    if relatives:
        kin = close_kin(tree).select(F.col("person").alias("anchor"), F.col("kin").alias("person"), "relation")
        people = people.union(kin.join(anchors, "anchor", "left_semi").select("anchor", "person", "relation"))
    event = tree.event.select(F.col("handle").alias("event"), "type", "date")
    took = event_participants(tree).select("event", "person")
    # events are told by person first: of kin only births and deaths go on, so rows grow with the events and not with kin times events
    told = took.join(event.hint("merge"), "event").withColumn("sortval", sort_key(F.col("date")))
    vital = F.col("type").isin("Birth", "Death")
    if classes is not None:
        told = told.where(vital | event_class().isin(*classes))
    if discard_undated:
        told = told.where("sortval > 0")
    told = told.withColumnRenamed("person", "__who")
    rows = people.join(told.hint("merge"), (F.col("person") == F.col("__who")) & ((F.col("relation") == "self") | vital)).drop("__who")
    birth = vital_events(tree).select(F.col("handle").alias("anchor"), "birth_date")
    rows = rows.join(birth.hint("merge"), "anchor", "left")
    born = sort_key(F.col("birth_date"))
    years = span_parts(F.col("birth_date"), F.col("date"))[0]
    return rows.select(
        "anchor", "event", "person", "relation", F.when(F.col("relation") == "self", F.col("type")).otherwise(F.concat("type", F.lit(" of "), "relation")).alias("label"),
        "sortval", F.when((born > 0) & (F.col("sortval") >= born), years).alias("age_years"),
    )


#: Kinds of close kin, the one that stands first where a person is kin in several ways.
CLOSE = ("parent", "child", "sibling", "spouse")


def kin_word(kind: Column, n: Column, gender: Column) -> Column:
    """The word for kin of a kind (its place in ``CLOSE``), ``n`` generations away."""
    up, down = (F.when(kind.isin(*kinds), n).otherwise(0) for kinds in ((0, 2), (1, 2)))
    spouse = F.when(gender == 0, "wife").when(gender == 1, "husband").otherwise("spouse")
    return F.when(kind == 3, spouse).otherwise(relation_label(up, down, gender))


def kin_of(tree: Tree, anchors: DataFrame, ancestors: int = 1, offspring: int = 1) -> DataFrame:
    """(anchor, person, relation): oneself, ancestors and offspring within so many generations, siblings and spouses.

    The relation is the word for the person by sex and distance ("grandmother",
    "great-grandson"). Both ways are walked for all anchors at once, a join for each
    generation; who is met several times stands with the shortest way, a line up or down before
    siblings and spouses.
    """
    par = cut(parent_edges(tree))
    start = anchors.select(F.col("anchor").alias("handle"))
    down = par.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    way = lambda edges, n: lines(edges, start, n).where("n > 0").groupBy(F.col("person").alias("anchor"), F.col("top").alias("person")).agg(F.min("n").alias("n"))
    side = close_kin(tree).where("relation in ('sibling', 'spouse')").join(anchors.withColumnRenamed("anchor", "person"), "person", "left_semi")
    rows = way(par, ancestors).select("anchor", "person", "n", F.lit(0).alias("kind")).union(way(down, offspring).select("anchor", "person", "n", F.lit(1)))
    rows = rows.union(side.select("person", "kin", F.lit(1), F.when(F.col("relation") == "sibling", 2).otherwise(3)))
    best = rows.where("anchor <> person").groupBy("anchor", "person").agg(F.min(F.struct("n", "kind")).alias("r"))
    named = best.join(tree.person.select(F.col("handle").alias("person"), "gender"), "person", "left")
    kin = named.select("anchor", "person", kin_word(F.col("r.kind"), F.col("r.n"), F.col("gender")).alias("relation"))
    return anchors.select("anchor", F.col("anchor").alias("person"), F.lit("self").alias("relation")).union(kin)


def kin_timeline(
    tree: Tree,
    persons: DataFrame | None = None,
    ancestors: int = 1,
    offspring: int = 1,
    relatives: tuple[str, ...] | None = None,
    classes: tuple[str, ...] | None = None,
    discard_undated: bool = True,
) -> DataFrame:
    """(anchor, event, person, relation, label, place, sortval, age_years, person_years): own events and the vital events of kin over generations.

    ``persons`` (first column handles) limits the anchors. ``relatives`` keeps the kin of these
    words ("sister", "grandfather", "great-grandson") beside oneself. Kin give their
    births and deaths; of own events ``classes`` keeps these and births and deaths. Ages
    are whole years of the anchor and of the person at the event, null before their
    birth and without a dated one. The place is its path of names. Kin are told
    first and events joined once, however many generations there are.
    """
    anchors = tree.person.select(F.col("handle").alias("anchor"))
    if persons is not None:
        anchors = anchors.join(persons.select(F.col(persons.columns[0]).alias("anchor")).distinct(), "anchor", "left_semi")
    people = kin_of(tree, cut(anchors), ancestors, offspring)
    if relatives is not None:
        people = people.where(F.col("relation").isin("self", *relatives))
    event = tree.event.select(F.col("handle").alias("event"), "type", "date", F.col("place").alias("place_handle"), sort_key(F.col("date")).alias("sortval"))
    if discard_undated:
        event = event.where("sortval > 0")
    vital = F.col("type").isin("Birth", "Death")
    told = event_participants(tree).select("event", F.col("person").alias("__who")).distinct().join(event.hint("merge"), "event")
    if classes is not None:
        told = told.where(vital | event_class().isin(*classes))
    rows = people.join(told.hint("merge"), (F.col("person") == F.col("__who")) & ((F.col("relation") == "self") | vital)).drop("__who")
    born = vital_events(tree).select("handle", "birth_date", sort_key(F.col("birth_date")).alias("born"))
    for who in ("anchor", "person"):
        rows = rows.join(born.select(F.col("handle").alias(who), F.col("birth_date").alias(f"{who}_date"), F.col("born").alias(f"{who}_born")), who, "left")
    age = lambda who: F.when((F.col(f"{who}_born") > 0) & (F.col("sortval") >= F.col(f"{who}_born")), span_parts(F.col(f"{who}_date"), F.col("date"))[0])
    if tree.place is not None:
        rows = rows.join(event_places(tree).select(F.col("place").alias("place_handle"), F.col("path").alias("place")), "place_handle", "left")
    else:
        rows = rows.withColumn("place", F.lit(None).cast("string"))
    label = F.when(F.col("relation") == "self", F.col("type")).otherwise(F.concat("type", F.lit(" of "), "relation"))
    return rows.select("anchor", "event", "person", "relation", label.alias("label"), "place", "sortval", age("anchor").alias("age_years"), age("person").alias("person_years"))


def people_timeline(tree: Tree, persons: DataFrame, anchor: str | None = None, first: bool = False, last: bool = False, low: int | None = None, high: int | None = None) -> DataFrame:
    """(event, person, type, sortval): dated own events of the listed people and of ``anchor``.

    ``first`` and ``last`` leave out what lies before the anchor's first and after its last
    own event; day numbers ``low`` and ``high`` override both.
    """
    listed = persons.select(F.col(persons.columns[0]).alias("person"))
    if anchor is not None:
        listed = listed.union(listed.sparkSession.range(1).select(F.lit(anchor)))
    dated = tree.event.select(F.col("handle").alias("event"), "type", sort_key(F.col("date")).alias("sortval")).where("sortval > 0")
    rows = event_participants(tree).select("event", "person").distinct().join(listed.distinct(), "person", "left_semi").join(dated, "event").select("event", "person", "type", "sortval")
    if low is not None or high is not None:
        return bounded(rows, low=low, high=high)
    if anchor is not None and (first or last):
        own = rows.where(F.col("person") == anchor).agg(F.min("sortval").alias("lo"), F.max("sortval").alias("hi"))
        fits = (F.lit(not first) | (F.col("sortval") >= F.col("lo"))) & (F.lit(not last) | (F.col("sortval") <= F.col("hi")))
        rows = rows.join(F.broadcast(own), fits).drop("lo", "hi")  # one row of bounds
    return rows


def families_timeline(tree: Tree, families: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """The family timeline of the listed families alone; an event that several of them share stands once in each."""
    chosen = tree.family.join(families.select(F.col(families.columns[0]).alias("handle")).distinct(), "handle", "left_semi")
    rows = family_timeline(tree.with_tables(family=chosen), all_events=tree)
    return bounded(rows, low=low, high=high) if low is not None or high is not None else rows


def bounded(timeline: DataFrame, first: bool = False, last: bool = False, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows within the anchor's own first and last event, or within day numbers, which override both."""
    if low is not None or high is not None:
        return timeline.where((F.col("sortval") >= (low if low is not None else -(2**31))) & (F.col("sortval") <= (high if high is not None else 2**31)))
    own = timeline.where("relation = 'self'").groupBy("anchor").agg(F.min("sortval").alias("lo"), F.max("sortval").alias("hi"))
    rows = timeline.join(own, "anchor", "left")
    if first:
        rows = rows.where("sortval >= lo")
    if last:
        rows = rows.where("sortval <= hi")
    return rows.drop("lo", "hi")


def family_timeline(tree: Tree, discard_undated: bool = True, all_events: Tree | None = None) -> DataFrame:
    """(family, event, person, sortval): events of all members of each family and of the family itself; a shared event once per person.

    ``all_events`` is the tree that tells who took part in what, where ``tree`` has chosen families alone.
    """
    f = tree.family
    members = f.select(F.col("handle").alias("family"), F.explode(F.array_distinct(F.array_compact(F.concat(F.array("father_handle", "mother_handle"), F.coalesce(F.col("child_ref_list.ref"), F.array().cast("array<string>")))))).alias("person"))
    took = event_participants(all_events or tree).select("event", "person").distinct()
    rows = members.join(took, "person").join(tree.event.select(F.col("handle").alias("event"), sort_key(F.col("date")).alias("sortval")), "event")
    return (rows.where("sortval > 0") if discard_undated else rows).select("family", "event", "person", "sortval")


def since_union(tree: Tree) -> DataFrame:
    """(family, event, person, years): the family timeline with whole years since the family's first dated marriage; null before it or without one."""
    dated = tree.event.select(F.col("handle").alias("event"), "type", "date", sort_key(F.col("date")).alias("day"))
    own = tree.family.select(F.col("handle").alias("family"), F.explode("event_ref_list.ref").alias("event")).join(dated.where("type = 'Marriage' and day > 0"), "event")
    wed = own.groupBy("family").agg(F.min("day").alias("wed_day"), F.min_by("date", "day").alias("wed"))
    rows = family_timeline(tree).join(dated.select("event", "date"), "event").join(wed, "family", "left")
    years = F.when(F.col("sortval") >= F.col("wed_day"), span_parts(F.col("wed"), F.col("date"))[0])
    return rows.select("family", "event", "person", years.alias("years"))


def living(tree: Tree, as_of: int, max_age: int = 110, sibling_diff: int = 20, gap: int = 20) -> DataFrame:
    """(handle, living, birth_year, rule): status at the end of year ``as_of`` and the estimate it rests on.

    A death, burial or cremation means not living. Else the first rule that gives a birth
    year decides, not living beyond ``max_age``: own birth; own death less ``max_age``; earliest sibling's birth
    less ``sibling_diff`` years; earliest child's birth less ``gap``; latest
    parent's birth plus ``gap``; a spouse's birth. With no evidence at all a
    person counts as living. A fixed number of joins, each on handles.
    """
    v = vital_years(tree).select("handle", F.col("born").alias("own"), F.col("died").alias("death_year"), F.col("ended").alias("died"))
    kin = close_kin(tree).join(v.select(F.col("handle").alias("kin"), F.col("own").alias("year")), "kin").where("year is not null")
    of = lambda r, f: f(F.when(F.col("relation") == r, F.col("year")))
    near = kin.groupBy("person").agg(of("sibling", F.min).alias("sib"), of("child", F.min).alias("kid"), of("parent", F.max).alias("par"), of("spouse", F.min).alias("mate"))
    rows = v.join(near, v["handle"] == near["person"], "left")
    rules = (("birth", F.col("own")), ("death", F.col("death_year") - max_age), ("sibling", F.col("sib") - sibling_diff), ("child", F.col("kid") - gap), ("parent", F.col("par") + gap), ("spouse", F.col("mate")))
    year = F.coalesce(*(c for _, c in rules))
    rule = F.coalesce(*(F.when(c.isNotNull(), name) for name, c in rules), F.lit("none"))
    alive = ~F.col("died") & F.coalesce(as_of - year <= max_age, F.lit(True))
    return rows.select("handle", alive.alias("living"), year.cast("int").alias("birth_year"), rule.alias("rule"))


def hide_living(tree: Tree, status: DataFrame, mode: str = "IncludeAll") -> DataFrame:
    """The person table as others may see it: modes IncludeAll, FullNameOnly, LastNameOnly, ReplaceCompleteName, ExcludeAll."""
    alive = status.where("living").select("handle")
    if mode == "IncludeAll":
        return tree.person
    if mode == "ExcludeAll":
        return tree.person.join(alive, "handle", "left_anti")
    rows = tree.person.join(alive.withColumn("__alive", F.lit(True)), "handle", "left")
    name = F.col("primary_name")
    hidden = {
        "FullNameOnly": name,
        "LastNameOnly": name.withField("first_name", F.lit("[Living]")),
        "ReplaceCompleteName": name.withField("first_name", F.lit("[Living]")).withField("surname_list", F.transform(name["surname_list"], lambda s: s.withField("surname", F.lit("[Living]")))),
    }
    if mode not in hidden:
        raise ValueError(f"unknown mode {mode}")
    keep = {"handle", "record_id", "gender", "primary_name", "family_list", "parent_family_list", "private"}
    columns = []
    for c in tree.person.columns:
        shown = hidden[mode] if c == "primary_name" else F.col(c) if c in keep else F.lit(None).cast(tree.person.schema[c].dataType)
        columns.append(F.when(F.col("__alive"), shown).otherwise(F.col(c)).alias(c))
    return rows.select(*columns)


def day_bounds(spec: str) -> tuple:
    """Columns of the first and last day number of ``y/m/d-y/m/d`` (either side may be empty)."""
    low, _, high = spec.partition("-")
    at = lambda t, f: f(*(F.lit(int(x)) for x in (t.split("/") + ["0", "0"])[:3])) if t else F.lit(None)
    return at(low, julian_day), at(high, last_day)


def visible(tree: Tree, status: DataFrame, living: str = "IncludeAll", private: bool = False) -> Tree:
    """The tree that facts may rest on: ``private`` drops records marked so, ``ExcludeAll`` the living; other modes hide names only."""
    if private:
        tree = tree.with_tables(**{t: df.where(~F.coalesce("private", F.lit(False))) for t, df in tree.tables().items() if "private" in df.columns})
    if living == "ExcludeAll":
        tree = tree.with_tables(person=hide_living(tree, status, living))
    return tree


def metric_facts(tree: Tree, status: DataFrame, branch: DataFrame | None = None) -> DataFrame:
    """(fact, handle, value, descending): the long table of what records are ranked by.

    Handles are of people; of families for the length of a marriage, which runs
    from its first dated marriage event to its first dated divorce or spouse's
    death. Values are days, day numbers (the living) or children. A person of
    several marriages or children stands with the least age for "youngest" and the
    greatest for "oldest". Only people and children in the person table count, and
    no marriage of a spouse who is not. ``branch`` (first column handles) limits the
    people, and families to those with a spouse among them.
    """
    day = lambda c: F.when(sort_key(F.col(c)) > 0, sort_key(F.col(c)))
    v = vital_events(tree).select("handle", day("birth_date").alias("born"), day("death_date").alias("died"))
    f = tree.family
    spouses = f.select(F.col("handle").alias("family"), F.explode(F.array(*(F.struct(F.col(f"{x}_handle").alias("handle"), F.lit(x).alias("side")) for x in ("father", "mother")))).alias("s")).select("family", "s.*").where("handle is not null")
    parent = spouses.join(v, "handle", "left").join(tree.person.select("handle", F.lit(True).alias("known")), "handle", "left")
    child = f.select(F.col("handle").alias("family"), F.explode("child_ref_list.ref").alias("child")).join(v.select(F.col("handle").alias("child"), F.col("born").alias("child_born")), "child")
    births = parent.where("known").join(child, "family")
    age = F.when(F.col("child_born") >= F.col("born"), F.col("child_born") - F.col("born"))
    of = lambda f, side: f(F.when(F.col("side") == side, age))
    kids = births.groupBy("handle").agg(F.count("*").alias("kids"), *(of(f, side).alias(f"{side}_{name}") for side in ("father", "mother") for name, f in (("least", F.min), ("most", F.max))))
    dated = f.select(F.col("handle").alias("family"), F.explode("event_ref_list.ref").alias("event")).join(tree.event.select(F.col("handle").alias("event"), "type", day("date").alias("day")), "event")
    wed = dated.where("type = 'Marriage' and day is not null")
    at_wedding = parent.where("known").join(wed, "family").where("day >= born").select("handle", (F.col("day") - F.col("born")).alias("age"))
    weddings = at_wedding.groupBy("handle").agg(F.min("age").alias("wed_least"), F.max("age").alias("wed_most"))
    ends = dated.where("type = 'Divorce'").select("family", "day").union(parent.select("family", "died")).groupBy("family").agg(F.min("day").alias("end"))
    lengths = wed.groupBy("family").agg(F.min("day").alias("day")).join(ends, "family").join(parent.where("known is null").select("family"), "family", "left_anti").where("end >= day").select(F.col("family").alias("handle"), (F.col("end") - F.col("day")).alias("value"))

    people = v.join(status.select("handle", "living"), "handle", "left").join(kids, "handle", "left").join(weddings, "handle", "left")
    if branch is not None:
        among = branch.select(F.col(branch.columns[0]).alias("handle")).distinct()
        people = people.join(among, "handle", "left_semi")
        lengths = lengths.join(spouses.join(among, "handle", "left_semi").select(F.col("family").alias("handle")), "handle", "left_semi")

    def long(df, facts):
        each = F.array(*(F.struct(F.lit(name).alias("fact"), value.cast("bigint").alias("value"), F.lit(down).alias("descending")) for name, value, down in facts))
        return df.select("handle", F.explode(each).alias("f")).where("f.value is not null").select("f.fact", "handle", "f.value", "f.descending")

    alive, lived = F.when(F.col("living"), F.col("born")), F.col("died") - F.col("born")
    personal = [("youngest living", alive, True), ("oldest living", alive, False), ("oldest at death", lived, True), ("youngest at death", lived, False), ("most children", F.col("kids"), True)]
    for name, c in (("at marriage", "wed"), ("father at a birth", "father"), ("mother at a birth", "mother")):
        personal += [(f"youngest {name}", F.col(f"{c}_least"), False), (f"oldest {name}", F.col(f"{c}_most"), True)]
    return long(people, personal).union(long(lengths, [("longest marriage", F.col("value"), True), ("shortest marriage", F.col("value"), False)]))


def ranked_facts(metrics: DataFrame, rank: int = 3) -> DataFrame:
    """The first ``rank`` places of each fact, ties sharing a place. Users add facts by union with ``metrics``.

    A first pass keeps, per fact, the records at the ``rank`` best distinct values
    by partial aggregation, so that the ranking window only sees those.
    """
    from pyspark.sql import Window

    signed = metrics.withColumn("s", F.when(F.col("descending"), -F.col("value")).otherwise(F.col("value")))
    values = signed.select("fact", "s").distinct()
    best = values.groupBy("fact", F.pmod(F.xxhash64("s"), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_set("s")), 1, rank).alias("low"))
    best = best.groupBy("fact").agg(F.element_at(F.slice(F.array_sort(F.flatten(F.collect_list("low"))), 1, rank), -1).alias("limit"))
    kept = signed.join(F.broadcast(best), "fact").where("s <= limit")
    place = F.rank().over(Window.partitionBy("fact").orderBy("s"))
    return kept.withColumn("place", place).where(F.col("place") <= rank).select("fact", "place", "handle", "value")
