"""Queries that look through references, relations and records in depth, each with its DuckDB twin; importing the module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions import shapes
from kinframe.functions.conditions import all_of, any_of, flagged, follow, matching, where
from kinframe.operators import changes, details, dna, kinship, lives, paging, search, timelines
from kinframe.plans.checkpoints import shared_folder
from kinframe.plans.demo import cited_tree, demo_tree, flat
from kinframe.plans.record_queries import _twin, record_search
from kinframe.plans.queries import _KIN, _TOOK, KEY, QUERIES, SQL, h, jdn, query
from kinframe.sources import writes
from kinframe.streaming import transactions
from kinframe.tree import Tree

_EVENTS_OF = f""", pe as (select {h('P', 'owner')} as person, e.* from d_event e where owner_class = 'person')"""


@query(f"""{_EVENTS_OF},
emigrant as (select distinct person from pe join d_place s on s.handle = {h('S', 'place_no')} join d_place n on n.handle = s.parent join d_place r on r.handle = n.parent
  where pe.type = 'Emigration' and r.name in ('ASIA', 'EUROPE')),
child as (select {h('F', 'fk')} as family, handle, gender from d_person where fk is not null)
select distinct family as handle from child c
where exists (select 1 from emigrant e where e.person = c.handle) or (gender = 0 and not exists (select 1 from pe where pe.person = c.handle and type in ('Death', 'Census')))""")
def family_any_emigrant_or_living_daughter(spark, sf_dir):
    """Families with a child who emigrated to a place in two regions (person, event, place and two places above it), or a daughter without death and census."""
    in_region = any_of("placeref_list", follow("ref", "place", any_of("placeref_list", follow("ref", "place", where(lambda r: r["name"].column.isin("ASIA", "EUROPE"))))))
    emigrated = any_of("event_ref_list", follow("ref", "event", where(lambda e: e["type"].eq("Emigration")) & follow("place", "place", in_region)))
    counted = any_of("event_ref_list", follow("ref", "event", where(lambda e: e["type"].eq("Death") | e["type"].eq("Census"))))
    child = emigrated | (where(lambda p: p["gender"].eq(0)) & ~counted)
    return matching(demo_tree(spark, sf_dir), "family", any_of("child_ref_list", follow("ref", "person", child))).select("handle")


@query(f"""{_EVENTS_OF},
cited as (select e.handle, count(c.handle) as n, coalesce(bool_and(c.confidence >= 1 and c.page <> '7'), true) as sound from d_event e left join d_citation c on c.event_handle = e.handle group by e.handle),
told as (select p.handle, coalesce(bool_and(sound), true) as all_sound, coalesce(bool_or(n > 2 and type <> 'Census'), false) as some_cited from d_person p left join pe on pe.person = p.handle left join cited on cited.handle = pe.handle group by p.handle)
select t.handle, all_sound, some_cited, not some_cited and f.handle is not null as uncited_with_family
from told t left join (select father_handle as handle from d_family union select mother_handle from d_family) f on f.handle = t.handle""")
def person_evidence_flags(spark, sf_dir):
    """Three conditions of every person at once: all citations of all events are sound, some event has more than two, none has and there is a family."""
    sound = all_of("citation_list", follow(None, "citation", where(lambda c: c["confidence"].compare(">=", 1) & c["page"].ne("7"))))
    some = any_of("event_ref_list", follow("ref", "event", where(lambda e: e["citation_list"].length().compare(">", 2) & e["type"].ne("Census"))))
    wed = any_of("family_list", follow(None, "family"))
    return flagged(demo_tree(spark, sf_dir), "person", all_sound=all_of("event_ref_list", follow("ref", "event", sound)), some_cited=some, uncited_with_family=~some & wed)


def _obj(pairs) -> str:
    """A JSON object of (name, SQL text or null) pairs, null ones left out, as one SQL string."""
    return "'{' || concat_ws(',', " + ", ".join(f"""'"{n}":' || {v}""" for n, v in pairs) + ") || '}'"


_TEXT = "nullif('\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"', '\"\"')"


def _t(c: str) -> str:
    return _TEXT.format(c)


@query(f""" , prefs as (select handle, case when parent is null then null else '[' || {_obj([('ref', _t('parent'))])} || ']' end as refs from d_place),
repos as (select source_handle, '[' || string_agg({_obj([('ref', _t('ref'))])}, ',' order by ref) || ']' as refs from d_reporef group by source_handle),
cites as (select event_handle, '[' || string_agg({_t('handle')}, ',' order by handle) || ']' as list from d_citation group by event_handle),
dates as (select handle, {_obj([(c, f"{c}::varchar") for c in ("modifier", "quality", "d1", "m1", "y1")] + [("s1", "'false'")] + [(c, f"{c}::varchar") for c in ("d2", "m2", "y2")] + [("s2", "'false'"), ("text", _t("text")), ("sortval", f"({KEY})::varchar")])} as date from d_event)
select 'place' as type, p.handle, {_obj([(c, _t(f'p.{x}')) for c, x in (('handle', 'handle'), ('record_id', 'handle'), ('title', 'title'), ('name', 'name'), ('place_type', 'place_type'))] + [('placeref_list', 'refs')])} as json from d_place p join prefs using (handle)
union all select 'source', s.handle, {_obj([(c, _t(f's.{x}')) for c, x in (('handle', 'handle'), ('record_id', 'handle'), ('title', 'title'), ('author', 'author'))] + [('reporef_list', 'refs')])} from d_source s left join repos on source_handle = s.handle
union all select 'citation', handle, {_obj([(c, _t(x)) for c, x in (('handle', 'handle'), ('record_id', 'handle'), ('source_handle', 'source_handle'), ('page', 'page'))] + [('confidence', 'confidence::varchar')])} from d_citation
union all select 'event', e.handle, {_obj([('handle', _t('e.handle')), ('record_id', _t("'E' || substr(e.handle, 2)")), ('type', _t('type')), ('date', 'date'), ('place', _t(h('S', 'place_no'))), ('citation_list', 'list'), ('change', '(k + 1700000000)::varchar')])}
  from d_event e join dates using (handle) left join cites on event_handle = e.handle
union all select 'tag', {h('T', 'n_nationkey')}, {_obj([('handle', _t(h('T', 'n_nationkey'))), ('name', _t('n_name')), ('priority', 'n_regionkey::varchar')])} from nation""")
def stripped_records(spark, sf_dir):
    """Records as JSON without their empty fields at any depth: dates in events, references in places and sources."""
    tables, out = demo_tree(spark, sf_dir).tables(), None
    for kind in ("place", "source", "citation", "event", "tag"):
        one = shapes.as_json(tables[kind]).select(F.lit(kind).alias("type"), "handle", "json")
        out = one if out is None else out.union(one)
    return out


def remarried_tree(spark, sf_dir) -> Tree:
    """The derived people in families of several marriages: some parents have children with two partners."""
    rows = flat(spark, sf_dir, "remarried").groupBy("father", "mother").agg(F.array_sort(F.collect_list(F.struct(F.col("child").alias("ref")))).alias("child_ref_list"))
    family = rows.select(F.concat(F.lit("F"), "father", "mother").alias("handle"), F.col("father").alias("father_handle"), F.col("mother").alias("mother_handle"), "child_ref_list")
    return demo_tree(spark, sf_dir).with_tables(family=family)


def _words() -> str:
    """Every label within four steps, written out: (kind, up, down, half, of a woman, of a man)."""
    blood = {
        (1, 0): ("mother", "father"), (2, 0): ("grandmother", "grandfather"), (3, 0): ("great-grandmother", "great-grandfather"), (4, 0): ("great-great-grandmother", "great-great-grandfather"),
        (0, 1): ("daughter", "son"), (0, 2): ("granddaughter", "grandson"), (0, 3): ("great-granddaughter", "great-grandson"), (0, 4): ("great-great-granddaughter", "great-great-grandson"),
        (1, 1): ("sister", "brother"), (2, 1): ("aunt", "uncle"), (1, 2): ("niece", "nephew"), (3, 1): ("grandaunt", "granduncle"), (1, 3): ("grandniece", "grandnephew"), (2, 2): ("1st cousin", "1st cousin"),
    }
    rows = [(1, 0, 0, 0, "wife", "husband")]
    for (u, d), (f, m) in blood.items():
        rows += [(0, u, d, 0, f, m), (0, u, d, 1, f"half-{f}", f"half-{m}"), (2, u, d, 0, f"step{f}", f"step{m}"), (3, u, d, 0, f"{f}-in-law", f"{m}-in-law")]
    return ", ".join(f"({k}, {u}, {d}, {x}, '{f}', '{m}')" for k, u, d, x, f, m in rows)


@query(f""" , par as (select child, father as parent from d_remarried union select child, mother from d_remarried),
couple as (select father as a, mother as b from d_remarried union select mother, father from d_remarried),
line as (select handle as x, handle as top, 0 as n, '' as via from d_person union select x, parent, n + 1, top from line join par on child = top where n < 4),
sharing as (select p.child as x, q.child as y, count(*) as shared from par p join par q on p.parent = q.parent group by all),
blood as (
  select p.x as a, q.x as b, p.n as u, q.n as d, 0 as half from line p join line q on p.top = q.top where p.n + q.n between 1 and 4 and (p.n = 0 or q.n = 0)
  union all
  select p.x, q.x, p.n, q.n, case when shared = 1 then 1 else 0 end from line p join line q on p.top = q.top join sharing s on s.x = p.via and s.y = q.via
  where p.n > 0 and q.n > 0 and p.n + q.n <= 4 and p.via <> q.via),
ways as (
  select a, b, u + d as steps, 0 as kind, u, d, half from blood
  union all select a, b, 1, 1, 0, 0, 0 from couple
  union all select p.x, q.x, p.n + q.n + 1, 2, p.n, q.n, 0 from line p join couple c on c.a = p.top join line q on q.top = c.b where p.n + q.n between 1 and 3
  union all select c.a, k.b, u + d + 1, 3, u, d, 0 from couple c join blood k on k.a = c.b where u > 0 and u + d <= 3
  union all select k.a, c.b, u + d + 1, 3, u, d, 0 from blood k join couple c on c.a = k.b where d > 0 and u + d <= 3),
best as (select a, b, min([steps, kind, u, d, half]) as r from ways where a <> b group by a, b),
words(kind, u, d, half, f, m) as (values {_words()})
select a, b, case gender when 0 then f else m end as relation, ['blood', 'partner', 'step', 'in-law'][kind + 1] as kind, r[1]::int as steps, r[3]::int as up, r[4]::int as down
from best left join words w on w.kind = r[2] and w.u = r[3] and w.d = r[4] and w.half = r[5] join d_person x on x.handle = b""")
def kinship_within_four(spark, sf_dir):
    """Every pair of people within four steps: blood, half-blood, partner, step and in-law relations."""
    # people as derived, since neither their events nor their lists tell of kin
    return kinship.kinship(remarried_tree(spark, sf_dir).with_tables(person=flat(spark, sf_dir, "person")))


def _round(k: int) -> str:
    """Bounds after one more hop, in SQL: what is known by oneself and from dated kin, and what others without a date tell."""
    return f"""s{k} as (
  select handle, min(case when side = 'low' then x end) as low, min(case when side = 'high' then x end) as high from (
    select handle, 'low' as side, low as x from s0 union all select handle, 'high', high from s0
    union all select person, 'low', {{'key': low.key + case relation when 'parent' then -20 else 20 end, 'rule': case relation when 'parent' then 2 else 4 end, 'wit': low.wit}}
      from kin join s{k - 1} on kin.kin = handle where relation in ('parent', 'sibling') and low is not null and person in (select handle from s0)
    union all select person, 'high', {{'key': high.key + case relation when 'child' then -20 else 20 end, 'rule': case relation when 'child' then 3 else 4 end, 'wit': high.wit}}
      from kin join s{k - 1} on kin.kin = handle where relation in ('child', 'sibling') and high is not null and person in (select handle from s0)) t
  group by handle)"""


_ROUNDS = 10
_ESTIMATES = f""", {_KIN}, v as (
  select p.handle, case when b.modifier <> 6 then b.y1 end as born, b.handle as be, case when d.modifier <> 6 then d.y1 end as died, d.handle as de, p.death_year is not null as ended
  from d_person p join d_event b on b.handle = 'EB' || substr(p.handle, 2) left join d_event d on d.handle = 'ED' || substr(p.handle, 2)),
dated as (select handle, born, be from v where born is not null),
s0 as (
  select handle, min(case when side = 'low' then x end) as low, min(case when side = 'high' then x end) as high from (
    select handle, 'low' as side, {{'key': 110 - died, 'rule': 1, 'wit': de}} as x from v where born is null and died is not null
    union all select handle, 'high', {{'key': died, 'rule': 1, 'wit': de}} from v where born is null and died is not null
    union all select handle, '-', null from v where born is null
    union all select person, 'low', {{'key': -dated.born + case relation when 'parent' then -20 else 20 end, 'rule': case relation when 'parent' then 2 else 4 end, 'wit': dated.be}}
      from kin join dated on kin.kin = handle join v u on u.handle = person where relation in ('parent', 'sibling') and u.born is null
    union all select person, 'high', {{'key': dated.born + case relation when 'child' then -20 else 20 end, 'rule': case relation when 'child' then 3 else 4 end, 'wit': dated.be}}
      from kin join dated on kin.kin = handle join v u on u.handle = person where relation in ('child', 'sibling') and u.born is null) t
  group by handle),
{", ".join(_round(k) for k in range(1, _ROUNDS + 1))},
near as (
  select person, min(case when relation = 'sibling' then {{'y': k.born, 'e': k.be}} end) as sib, min(case when relation = 'child' then {{'y': k.born, 'e': k.be}} end) as kid,
    min(case when relation = 'parent' then {{'y': -k.born, 'e': k.be}} end) as par, min(case when relation = 'spouse' then {{'y': k.born, 'e': k.be}} end) as mate
  from kin join dated k on k.handle = kin.kin group by person),
given as (
  select v.*, coalesce(-s.low.key, born) as low, coalesce(s.high.key, born) as high, s.low as sl, s.high as sh,
    case when born is not null then {{'key': born, 'rule': 0, 'wit': be}} when died is not null then {{'key': died - 110, 'rule': 1, 'wit': de}}
      when sib is not null then {{'key': sib.y - 20, 'rule': 4, 'wit': sib.e}} when kid is not null then {{'key': kid.y - 20, 'rule': 3, 'wit': kid.e}}
      when par is not null then {{'key': 20 - par.y, 'rule': 2, 'wit': par.e}} when mate is not null then {{'key': mate.y, 'rule': 5, 'wit': mate.e}} end as raw
  from v left join s{_ROUNDS} s using (handle) left join near on person = v.handle),
told as (
  select *, case when raw is null then coalesce(sh, {{'key': -sl.key, 'rule': sl.rule, 'wit': sl.wit}}) when raw.rule = 0 then raw when raw.key > high then sh when raw.key < low then {{'key': -sl.key, 'rule': sl.rule, 'wit': sl.wit}} else raw end as b from given)
select handle, b.key::int as birth_year, ['birth', 'death', 'parent', 'child', 'sibling', 'spouse'][b.rule + 1] as birth_rule, b.wit as birth_witness,
  coalesce(died, b.key + 110)::int as death_year, case when died is not null then 'death' when b is not null then 'age' end as death_rule, case when died is not null then de else b.wit end as death_witness,
  low::int as low, high::int as high, ended from told"""


@query(_ESTIMATES)
def life_estimates(spark, sf_dir):
    """Birth and death of every person, known or estimated, with the rule, the event behind it, and the bounds."""
    return lives.estimates(demo_tree(spark, sf_dir))


def _years(born: str, at: str) -> str:
    part = lambda t: f"greatest({t}.m1, 1) * 100 + greatest({t}.d1, 1)"
    return f"case when {born}.sk > 0 and {at}.sk >= {born}.sk then ({at}.y1 - {born}.y1 - case when {part(at)} < {part(born)} then 1 else 0 end) end"


_GENERATIONS = f""", {_KIN}, {_TOOK}, ev as (select *, {KEY} as sk from d_event),
up as (select handle as a, handle as p, 0 as n from d_person union select a, parent, n + 1 from up join par on child = p where n < 2),
down as (select handle as a, handle as p, 0 as n from d_person union select a, child, n + 1 from down join par on parent = p where n < 2),
found as (select a, p, n, 0 as kind from up where n > 0 union all select a, p, n, 1 from down where n > 0
  union all select person, kin, 1, case relation when 'sibling' then 2 else 3 end from kin where relation in ('sibling', 'spouse')),
nearest as (select a, p, min([n, kind]) as r from found where a <> p group by a, p),
who as (
  select handle as anchor, handle as person, 'self' as relation from d_person
  union all select a, p, case r[2] when 0 then case r[1] when 1 then '' else 'grand' end || case gender when 0 then 'mother' else 'father' end
    when 1 then case r[1] when 1 then '' else 'grand' end || case gender when 0 then 'daughter' else 'son' end
    when 2 then case gender when 0 then 'sister' else 'brother' end else case gender when 0 then 'wife' else 'husband' end end
  from nearest join d_person x on x.handle = p),
birth as (select owner, y1, m1, d1, sk from ev where type = 'Birth'),
path as (select s.handle, s.name || ', ' || case when n.title <> '' then n.title else n.name || ', ' || r.name end as path from d_place s join d_place n on n.handle = s.parent join d_place r on r.handle = n.parent),
line as (
  select anchor, event, t.person, relation, type, case when relation = 'self' then type else type || ' of ' || relation end as label, path as place, e.sk::bigint as sortval,
    ({_years('ab', 'e')})::bigint as age_years, ({_years('pb', 'e')})::bigint as person_years
  from who join took t on t.person = who.person join ev e on e.handle = t.event
    join birth ab on ab.owner = substr(anchor, 2)::bigint join birth pb on pb.owner = substr(t.person, 2)::bigint left join path on path.handle = {h('S', 'place_no')}
  where e.sk > 0 and (relation = 'self' or type in ('Birth', 'Death')))"""


@query(f"""{_GENERATIONS} select anchor, event, person, relation, label, place, sortval, age_years, person_years from line""")
def kin_timeline_two_generations(spark, sf_dir):
    """Everyone's own events and the vital events of kin within two generations both ways, with places and ages."""
    return timelines.kin_timeline(demo_tree(spark, sf_dir), ancestors=2, offspring=2)


@query(f"""{_GENERATIONS} select anchor, event, person, label, sortval from line where relation in ('self', 'sister', 'grandmother', 'grandson') and (type in ('Birth', 'Death') or type in ('Census', 'Residence'))""")
def kin_timeline_chosen(spark, sf_dir):
    """The same for chosen relatives, grandparents among them, with own events of one class."""
    rows = timelines.kin_timeline(demo_tree(spark, sf_dir), ancestors=2, offspring=2, relatives=("sister", "grandmother", "grandson"), classes=("residence",))
    return rows.select("anchor", "event", "person", "label", "sortval")


@query(f""" , {_TOOK}, ev as (select handle, type, {KEY} as sk from d_event), a as (select max(handle) as h from d_person),
own as (select min(sk) as lo, max(sk) as hi from took join ev on ev.handle = event join a on person = h where sk > 0)
select distinct event, person, type, sk::bigint as sortval from took join ev on ev.handle = event, own where sk between lo and hi and sk > 0
  and (person in (select father_handle from d_family) or person = (select h from a))""")
def people_timeline_anchored(spark, sf_dir):
    """Events of fathers within the life of the last person."""
    t = demo_tree(spark, sf_dir)
    anchor = t.person.agg(F.max("handle")).first()[0]
    return timelines.people_timeline(t, t.family.select("father_handle"), anchor, first=True, last=True)


@query(f""" , {_TOOK}, ev as (select *, {KEY} as sk from d_event), chosen as (select handle, father_handle, mother_handle, fk from d_family where fk % 7 <> 0),
mem as (select handle as family, father_handle as person from chosen union select handle, mother_handle from chosen union select {h('F', 'fk')}, handle from d_person where fk in (select fk from chosen))
select distinct family, event, m.person, sk::bigint as sortval from mem m join took t on t.person = m.person join ev on ev.handle = t.event where sk between {jdn('1800', '1', '1')} and {jdn('1899', '12', '31')}""")
def families_timeline_century(spark, sf_dir):
    """Timelines of the families with a wedding, within a century."""
    t = demo_tree(spark, sf_dir)
    wed = matching(t, "family", any_of("event_ref_list", follow("ref", "event", where(lambda e: e["type"].eq("Marriage"))))).select("handle")
    low, high = (spark.range(1).select(c).first()[0] for c in timelines.day_bounds("1800/1/1-1899/12/31"))
    return timelines.families_timeline(t, wed, low, high)


def revised(spark, sf_dir) -> tuple[Tree, DataFrame]:
    """(tree as it is now, log): people revised by the transactions of the event table; some begin with their first revision, some end with their last."""
    t = demo_tree(spark, sf_dir)
    rows = flat(spark, sf_dir, "revisions").join(t.person, "handle")
    version = lambda stamp: F.to_json(F.struct(*(F.col(c) if c != "change" else stamp.alias("change") for c in t.person.columns)))
    before = F.lag("stamp").over(Window.partitionBy("handle").orderBy("n"))
    rows = rows.withColumn("was", F.coalesce(before.cast("bigint"), F.col("change").cast("bigint")))
    old = F.when((F.col("n") > 1) | ~F.col("added"), version(F.col("was")))
    new = F.when((F.col("n") < F.col("total")) | ~F.col("deleted"), version(F.col("stamp").cast("bigint")))
    log = rows.select("tx_id", "pos", F.lit("Person").alias("class"), "handle", old.alias("old"), new.alias("new"))
    last = rows.where("n = total").select("handle", "stamp", "deleted")
    person = t.person.join(last, "handle", "left").where(~F.coalesce("deleted", F.lit(False)))
    return t.with_tables(person=person.select(*(F.col(c) if c != "change" else F.coalesce(F.col("stamp").cast(t.person.schema["change"].dataType), "change").alias(c) for c in t.person.columns))), log


@query(""" , odd as (select handle, bool_or(added) as added from d_revisions where tx_id % 2 = 1 group by handle),
even as (select handle, bool_or(deleted) as deleted, max(stamp) as stamp from d_revisions where tx_id % 2 = 0 group by handle)
select p.handle, coalesce(e.stamp, p.change)::bigint as change, gender, surname from d_person p left join odd o using (handle) left join even e using (handle)
where not coalesce(added, false) and not coalesce(deleted, false)""")
def undo_odd_transactions(spark, sf_dir):
    """The person table after undoing every odd transaction: what they revised is as it was, what others revised stays."""
    tree, log = revised(spark, sf_dir)
    new, _, _ = changes.undo_transactions(tree, log, log.where("tx_id % 2 = 1").select("tx_id"))
    return new.person.select("handle", F.col("change").cast("bigint").alias("change"), "gender", F.get("primary_name.surname_list", 0)["surname"].alias("surname"))


@query(""" , mine as (select handle, min(n) as a, max(n) as b, count(*) as c, any_value(total) as total from d_revisions where tx_id % 3 = 0 group by handle)
select 'Person' as class, handle, case when b < total then 'changed since' else 'changed between' end as reason from mine where b < total or b - a + 1 > c""")
def undo_conflicts_told(spark, sf_dir):
    """Why every third transaction can't be undone: records changed since, or in between by others."""
    tree, log = revised(spark, sf_dir)
    return changes.undo_transactions(tree, log, log.where("tx_id % 3 = 0").select("tx_id"))[1]


def nested_log(spark, sf_dir) -> DataFrame:
    """The event table as transactions of three changes each, nested."""
    rows = flat(spark, sf_dir, "changes").withColumn("tx", F.floor(F.col("tx_id") / 3).cast("bigint"))
    new = F.when(F.col("action") != "delete", F.to_json(F.struct("handle", "value")))
    change = F.struct(F.col("tx_id").alias("at"), F.col("action").alias("type"), F.col("class").alias("_class"), "handle", F.lit(None).cast("string").alias("old"), new.alias("new"))
    grouped = rows.groupBy("tx").agg(F.array_sort(F.collect_list(change)).alias("c"), F.max(F.struct("tx_id", "ts", "user", "undo")).alias("m"))
    return grouped.select(
        F.col("tx").alias("id"), F.struct(F.struct(F.col("m.user").cast("string").alias("name")).alias("user")).alias("connection"), F.lit("edit").alias("description"),
        F.get("c", 0)["at"].alias("first"), F.col("m.tx_id").alias("last"), F.col("m.undo").alias("undo"), (F.unix_micros(F.from_utc_timestamp(F.col("m.ts").cast("timestamp"), F.current_timezone())) / 1_000_000).alias("timestamp"),
        F.transform("c", lambda x: F.struct(x["type"].alias("type"), x["_class"].alias("_class"), x["handle"].alias("handle"), x["old"].alias("old"), x["new"].alias("new"))).alias("changes"),
    )


_FLAT = """ , f as (select tx_id // 3 as tx, tx_id % 3 as pos, action, class, handle, value, tx_id, last_value(ts) over w as ts, last_value("user") over w as u, last_value(undo) over w as undo
  from d_changes window w as (partition by tx_id // 3 order by tx_id rows between unbounded preceding and unbounded following))"""


@query(f"""{_FLAT} select tx as tx_id, pos::int as pos, epoch_us(ts) as us, u::varchar as "user", undo, action, class, handle, case when action <> 'delete' then '{{"handle":"' || handle || '","value":' || value::varchar || '}}' end as new from f""")
def flat_change_log(spark, sf_dir):
    """The nested log written as JSON lines, read by its schema and made flat."""
    folder = f"{shared_folder(spark, 'log')}"
    nested_log(spark, sf_dir).write.json(folder)
    rows = transactions.flatten_changes(transactions.read_transactions(spark, folder))
    return rows.select("tx_id", "pos", F.unix_micros("ts").alias("us"), "user", "undo", "action", "class", "handle", "new")


@query(f"""{_FLAT} select class, handle, tx as tx_id, '{{"handle":"' || handle || '","value":' || value::varchar || '}}' as new from f
qualify row_number() over (partition by class, handle order by tx_id desc) = 1 and action <> 'delete'""")
def bucketed_snapshot(spark, sf_dir):
    """The newest object of every handle, from the log applied in four batches to buckets, the second one twice and out of order."""
    snapshot = transactions.BucketedSnapshot(spark, shared_folder(spark, "snapshot"), buckets=16)
    rows = transactions.flatten_changes(nested_log(spark, sf_dir)).withColumn("part", F.pmod(F.xxhash64("tx_id"), F.lit(4)))
    for number, part in enumerate((2, 0, 0, 3, 1)):
        snapshot.apply(rows.where(F.col("part") == part), number)
    return snapshot.read()


def matched_tree(spark, sf_dir) -> Tree:
    """The derived people, each with a DNA match whose notes are the person's orders: a line for each of their items, some with faults."""
    t = demo_tree(spark, sf_dir)
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    number = lambda c: F.col(c).cast("bigint").cast("string")
    start = (F.col("l_partkey").cast("bigint") + 1) * 1000
    stop = F.when(F.col("l_partkey") % 11 == 0, start - 1).otherwise(start + F.col("l_suppkey").cast("bigint") * 10)
    line = F.when(F.col("l_linenumber") == 7, F.lit("see letter")).otherwise(F.concat_ws(
        ",", (1 + F.col("l_partkey") % 25).cast("string"), start.cast("string"), stop.cast("string"), number("l_quantity"),
        F.when(F.col("l_suppkey") % 9 == 0, F.lit("many")).otherwise(number("l_suppkey")), F.when(F.col("l_suppkey") % 2 == 0, F.lit("p")).otherwise(F.lit(""))))
    # alike items are one; a note's items come together by its handle, in the one shuffle that the note needs later too
    key = F.concat(F.lit("X"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("handle")
    body = item.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line"), "l_quantity")))["line"].alias("lines"))
    note = body.select("handle", F.struct(F.concat(F.lit("Chromosome,Start,Stop,cM,SNPs,Side\n"), F.array_join("lines", "\n")).alias("string")).alias("text"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("P"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("handle"), F.concat(F.lit("X"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("note"))
    lists = orders.groupBy("handle").agg(F.array_sort(F.collect_list("note")).alias("notes"))
    people = flat(spark, sf_dir, "person")
    pair = people.crossJoin(F.broadcast(people.agg(F.count("*").alias("n")))).select("handle", F.concat(F.lit("P"), F.lpad(((F.col("k") * 7 + 3) % F.col("n")).cast("string"), 9, "0")).alias("match"))
    ref = F.array(F.struct(F.lit("other").alias("ref"), F.lit("Godfather").alias("rel"), F.array().cast("array<string>").alias("note_list")), F.struct(F.col("match").alias("ref"), F.lit("dna").alias("rel"), F.coalesce("notes", F.array().cast("array<string>")).alias("note_list")))
    person = t.person.join(pair, "handle").join(lists, "handle", "left").withColumn("person_ref_list", ref)
    return t.with_tables(person=person.select(*t.person.columns, "person_ref_list"), note=note)


_LINES = f""" , item as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem),
placed as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) + 1 as line from item),
said as (
  select {h('X', 'l_orderkey')} as note, l_orderkey, line::int as line, l_linenumber = 7 as odd, 1 + l_partkey % 25 as c, (l_partkey::bigint + 1) * 1000 as a, l_suppkey % 9 = 0 as many, l_partkey % 11 = 0 as back,
    l_suppkey, l_quantity::bigint::double as cm from placed),
seg as (
  select note, l_orderkey, line, case when not odd then case when c <= 22 then c::varchar end end as chromosome, case when not odd then a end as start, case when not odd then case when back then a - 1 else a + l_suppkey::bigint * 10 end end as stop,
    case when not odd and l_suppkey % 2 = 0 then 'P' else 'U' end as side, case when not odd then cm end as cm, case when not odd and not many then l_suppkey::bigint end as snps,
    case when odd then 'fields' when c > 22 then 'chromosome' when back then 'stop before start' when many then 'SNPs' end as fault
  from said)"""


@query(f"{_LINES} select note, line, chromosome, start, stop, side, cm, snps, fault from seg")
def dna_segments(spark, sf_dir):
    """Every line of every note as a typed segment with its fault."""
    return dna.segments(matched_tree(spark, sf_dir).note).drop("comment")


_WAY_TABLES, _WAYS_OF = _twin("relationship_ways")


@query(f"""{_WAY_TABLES}{_LINES}, ways as ({_WAYS_OF}),
best as (select * from ways qualify row_number() over (partition by a, b order by up + down, up, down) = 1),
owned as (select {h('P', 'o_custkey')} as person, seg.* from seg join orders on o_orderkey = l_orderkey),
summed as (select person, count(*) filter (fault is null) as n, coalesce(sum(cm) filter (fault is null), 0) as cm, string_agg(note || ':' || line || ' ' || fault, '; ' order by note, line) filter (fault is not null) as faults from owned group by person)
select p.a as person, 1 as person_ref_idx, p.b as match, coalesce(ancestors, '') as ancestors, coalesce(n, 0)::int as n_segments, coalesce(cm, 0)::double as centimorgans, coalesce(faults, '') as faults
from (select handle as a, {h('P', '(k * 7 + 3) % (select count(*) from d_person)')} as b from d_person) p left join best on best.a = p.a and best.b = p.b left join summed s on s.person = p.a""")
def dna_match_list(spark, sf_dir):
    """Every person's match: latest common ancestors, segments, their sum and the faults of the notes."""
    rows = dna.dna_matches(matched_tree(spark, sf_dir))
    return rows.select("person", "person_ref_idx", "match", F.array_join("ancestors", "; ").alias("ancestors"), F.size("segments").alias("n_segments"), "centimorgans", F.array_join("faults", "; ").alias("faults"))


def attached_tree(spark, sf_dir) -> Tree:
    """The derived people with the documents as their notes and the pages as their media; every tenth also refers to a note that is not there."""
    t = cited_tree(spark, sf_dir)
    person = flat(spark, sf_dir, "person")
    n = person.count()
    pick = lambda c: F.concat(F.lit("P"), F.lpad((F.col(c) % n + 1).cast("string"), 9, "0"))
    notes = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(pick("doc_id").alias("handle")).agg(F.array_sort(F.collect_list(F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))).alias("note_list"))
    media = spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(pick("page_id").alias("handle")).agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("O"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("ref")))).alias("media_list"))
    rows = t.person.join(notes, "handle", "left").join(media, "handle", "left")
    lost = F.when(F.substring("handle", -1, 1) == "0", F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("note_list", F.concat(F.coalesce("note_list", F.array().cast("array<string>")), lost))
    return t.with_tables(person=rows)


_SECTIONS = f""", {_KIN}, {_TOOK}, ev as (select *, {KEY} as sk from d_event), named as (select handle, record_id, trim(first_name || ' ' || surname) as name from d_person),
kin_of as (select person, relation, string_agg(distinct n.record_id || ' ' || n.name, '; ' order by n.record_id || ' ' || n.name) as listed from kin join named n on n.handle = kin.kin group by person, relation),
cites as (select event_handle, string_agg(handle, ',' order by handle) as ids from d_citation group by event_handle),
notes as (select {h('P', 'doc_id % (select count(*) from d_person) + 1')} as person, string_agg(substr(coalesce(text, ''), 1, 50) || case when length(coalesce(text, '')) > 50 then '...' else '' end || ' (' || {h('D', 'doc_id')} || ')', '; ' order by doc_id) as listed from documents group by all),
media as (select {h('P', 'page_id % (select count(*) from d_person) + 1')} as person, string_agg(url || ' (' || {h('O', 'page_id')} || ')', '; ' order by page_id) as listed from pages group by all)"""


@query(f"""{_SECTIONS},
line as (select who.anchor, string_agg(sk::varchar || ' ' || t.event || ' ' || n.record_id || ' ' || coalesce(c.ids, ''), '; ' order by sk, t.event, n.record_id) as listed
  from (select handle as anchor, handle as person, true as own from d_person union select person, kin, false from kin) who join took t on t.person = who.person join ev e on e.handle = t.event
    join named n on n.handle = t.person left join cites c on c.event_handle = t.event where sk > 0 and (own or type in ('Birth', 'Death')) group by who.anchor)
select n.handle, n.record_id as id, n.name, coalesce(a.listed, '') as parents, coalesce(b.listed, '') as siblings, coalesce(c.listed, '') as spouses, coalesce(d.listed, '') as children, coalesce(line.listed, '') as timeline,
  concat_ws('; ', notes.listed, case when n.handle like '%0' then '- (gone)' end) as notes, coalesce(media.listed, '') as media
from named n left join kin_of a on a.person = n.handle and a.relation = 'parent' left join kin_of b on b.person = n.handle and b.relation = 'sibling' left join kin_of c on c.person = n.handle and c.relation = 'spouse'
  left join kin_of d on d.person = n.handle and d.relation = 'child' left join line on line.anchor = n.handle left join notes on notes.person = n.handle left join media on media.person = n.handle""")
def person_sections(spark, sf_dir):
    """Every section of every person: kin, timeline with citations, notes and media."""
    d = details.person_sections(attached_tree(spark, sf_dir))
    people = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.concat_ws(" ", x["id"], x["name"]))), "; ").alias(c)
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.coalesce(x["label"], F.lit("-")), F.lit(" ("), x["id"], F.lit(")"))), "; ").alias(c)
    line = F.array_join(F.transform("timeline", lambda x: F.concat_ws(" ", x["told"]["sortval"].cast("string"), x["told"]["event"], x["person_id"], F.array_join(x["told"]["citations"], ","))), "; ").alias("timeline")
    return d.select("handle", F.col("who.id").alias("id"), F.col("who.name").alias("name"), *map(people, ("parents", "siblings", "spouses", "children")), line, listed("notes"), listed("media"))


@query(f"""{_SECTIONS},
mem as (select handle as family, father_handle as person from d_family union select handle, mother_handle from d_family union select {h('F', 'fk')}, handle from d_person where fk is not null),
line as (select family, count(*) as n, sum(sk)::bigint as days from (select distinct family, event, t.person, sk from mem join took t using (person) join ev on ev.handle = event where sk > 0) x group by family),
kids as (select {h('F', 'fk')} as family, string_agg(n.record_id || ' ' || n.name, '; ' order by handle) as listed from d_person p join named n using (handle) where fk is not null group by all),
wed as (select owner, sk, {h('S', 'place_no')} as place from ev where type = 'Marriage')
select f.handle, a.name as father, b.name as mother, coalesce(kids.listed, '') as children, w.sk::bigint as married, coalesce(n, 0)::int as n_events, coalesce(days, 0)::bigint as days
from d_family f left join named a on a.handle = father_handle left join named b on b.handle = mother_handle left join kids on kids.family = f.handle left join wed w on w.owner = f.fk left join line on line.family = f.handle""")
def family_sections(spark, sf_dir):
    """Every section of every family, its timeline as its length and the sum of its days."""
    d = details.family_sections(cited_tree(spark, sf_dir))
    kids = F.array_join(F.transform("children", lambda x: F.concat_ws(" ", x["id"], x["name"])), "; ").alias("children")
    days = F.aggregate("timeline", F.lit(0).cast("long"), lambda t, x: t + x["told"]["sortval"]).alias("days")
    return d.select("handle", F.col("father.name").alias("father"), F.col("mother.name").alias("mother"), kids, F.col("married.sortval").alias("married"), F.size("timeline").alias("n_events"), days)


@query(""" , e as (select o_orderkey as k from orders), p as (select c_custkey as k from customer), s as (select p_partkey as k, p_name from part)
select 'event' as kind, k, concat_ws('; ', case when k % 7 = 0 then 'type: is required' end, case when k % 5 = 0 then 'citation_list: is required' end, case when k % 3 = 0 then 'place: must be a handle, not a name' end,
  case when k % 11 = 4 then 'date: needs 8 entries' end, case when k % 13 = 0 then 'weather: is unknown' end) as reasons from e where k % 7 = 0 or k % 5 = 0 or k % 3 = 0 or k % 11 = 4 or k % 13 = 0
union all select 'person', k, concat_ws('; ', case when k % 4 = 3 then 'gender: must be 0, 1 or 2' end, case when k % 6 = 1 then 'event_ref_list: each needs ref and role' end) from p where k % 4 = 3 or k % 6 = 1
union all select 'source', k, 'title: must not be empty' from s where k % 9 = 0""")
def write_rules(spark, sf_dir):
    """Events, people and sources told as JSON lines from the orders, customers and parts, each with what is wrong with it."""
    read = lambda t, *cols: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*cols)
    k, text = F.col("k"), lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    line = lambda *fields: F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    modifier = (k % 9).cast("string")
    length = F.when((k % 9).isin(4, 5), F.lit("[1,2,1900,false,3,4,1901,false]")).otherwise(F.lit("[1,2,1900,false]"))
    date = F.when(k % 11 == 4, F.lit('{"modifier":5,"dateval":[1,2,1900,false]}')).otherwise(F.concat(F.lit('{"modifier":'), modifier, F.lit(',"dateval":'), length, F.lit("}")))
    place = F.when(k % 3 == 0, text(F.concat(F.lit("Town "), k.cast("string")))).otherwise(text(F.lpad(F.lower(F.hex(k)), 16, "0")))
    event = line(F.when(k % 7 != 0, field("type", F.lit('"Census"'))), F.when(k % 5 != 0, field("citation_list", F.lit('["c"]'))), field("place", place), field("date", date), F.when(k % 13 == 0, field("weather", F.lit('"rain"'))))
    role = F.when(k % 6 == 1, F.lit('[{"ref":"e"}]')).otherwise(F.lit('[{"ref":"e","role":"Primary"}]'))
    person = line(field("primary_name", F.lit('{"first_name":"A"}')), field("gender", (k % 4).cast("string")), field("event_ref_list", role))
    source = line(field("title", F.when(k % 9 == 0, F.lit('""')).otherwise(text(F.col("p_name")))))
    out = None
    for kind, rows, value in (("event", read("orders", F.col("o_orderkey").alias("k")), event), ("person", read("customer", F.col("c_custkey").alias("k")), person), ("source", read("part", F.col("p_partkey").alias("k"), "p_name"), source)):
        bad = writes.check_records(rows.withColumn("value", value), kind)[1].select(F.lit(kind).alias("kind"), "k", F.array_join("reasons", "; ").alias("reasons"))
        out = bad if out is None else out.union(bad)
    return out


@query(""" select handle, row_number() over (order by surname desc, first_name desc, handle)::bigint as position from d_person""")
def people_by_name(spark, sf_dir):
    """Every person's place by surname, given name as the tie-break, both descending."""
    people = demo_tree(spark, sf_dir).person
    return paging.positions(people, *paging.sort_columns("-surname", paging.person_keys(people))).select("handle", "position")


def record_search_places(spark, sf_dir):
    """The hits of ``record_search`` in the order of their types, last types first, each with its place in its query."""
    tree = demo_tree(spark, sf_dir)
    changes_of = tree.person.select(F.lit("person").alias("type"), "handle", "change").union(tree.event.select(F.lit("event"), "handle", "change"))
    return search.placed(record_search(spark, sf_dir), changes_of, "-type").select("query_id", "type", "handle", "score", "place")


QUERIES["record_search_places"] = record_search_places
SQL["record_search_places"] = f"select *, row_number() over (partition by query_id order by type desc, handle)::bigint as place from ({SQL['record_search']})"
