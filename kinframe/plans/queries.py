"""One query per operator over the derived tree, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.functions import dates, labels
from kinframe.functions.predicates import path, rules, where_refs
from kinframe.operators import graph, paging, references
from kinframe.plans.demo import cited_tree, demo_tree, flat, sql_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql_tables() + sql
        return f

    return add


def h(letter: str, key: str) -> str:
    return f"('{letter}' || lpad(({key})::varchar, 9, '0'))"


PARENTS = f"""par as (select handle as child, {h('P', 'fk')} as parent from d_person where fk is not null union all select handle, {h('P', 'mk')} from d_person where mk is not null)"""
JDN = "(1461 * (yy + 4800 + (mm - 14) / 12)) / 4"


def jdn(y: str, m: str, d: str) -> str:
    """Day number by DuckDB's own calendar."""
    return f"(2440588 + datediff('day', date '1970-01-01', make_date(({y})::int, greatest({m}, 1)::int, greatest({d}, 1)::int)))"


KEY = f"case when modifier = 6 or y1 = 0 then 0 else {jdn('y1', 'm1', 'd1')} end"


def _last_person(spark, sf_dir):
    return flat(spark, sf_dir, "person").agg(F.max("handle").alias("root"))


@query(f""", {PARENTS},
w as (select max(handle) as h, 1 as g from d_person union select parent, g + 1 from w join par on child = h where g < 5)
select h as handle, min(g)::int as generation from w group by h""")
def ancestors_root(spark, sf_dir):
    w = graph.walk(graph.parent_edges(demo_tree(spark, sf_dir)), _last_person(spark, sf_dir), max_generations=5)
    return w.nodes.select("handle", "generation")


@query(f""", {PARENTS},
w as (select min(handle) as h, 1 as g from d_person union select child, g + 1 from w join par on parent = h where g < 6)
select h as handle, min(g)::int as generation from w group by h""")
def descendants_root(spark, sf_dir):
    roots = flat(spark, sf_dir, "person").agg(F.min("handle").alias("root"))
    return graph.walk(graph.parent_edges(demo_tree(spark, sf_dir)), roots, "descendants", max_generations=6, cap=None).nodes.select("handle", "generation")


@query(f""", {PARENTS},
roots as (select handle as r from d_person),
w as (select r, r as h, 1 as g from roots union select r, parent, g + 1 from w join par on child = h where g < 5),
first as (select r, h, min(g) as g from w group by r, h),
lv as (select r, g, count(*) as n from first group by r, g),
cum as (select r, g, n, sum(n) over (partition by r order by g) as c from lv),
stop as (select r, min(g) as g from cum where c > 10 group by r),
ok as (select f.* from first f left join stop s on f.r = s.r where s.g is null or f.g < s.g)
select ok.r as root, count(*)::bigint as people, (max(s.g) is not null) as truncated,
  (case when max(s.g) is not null then max(cut.n) else 0 end
   + case when max(s.g) is null then (select count(distinct parent) from ok o2 join par on child = o2.h where o2.r = ok.r and o2.g = 5 and parent not in (select h from first f2 where f2.r = ok.r)) else 0 end)::bigint as unexplored
from ok left join stop s on s.r = ok.r left join cum cut on cut.r = s.r and cut.g = s.g group by ok.r""")
def walk_cap(spark, sf_dir):
    people = flat(spark, sf_dir, "person")
    w = graph.walk(graph.parent_edges(demo_tree(spark, sf_dir)), people.select("handle"), max_generations=5, cap=10)
    return w.summary.select("root", "people", "truncated", "unexplored")


@query(SQL["walk_cap"].removeprefix(sql_tables()))
def walk_cap_all(spark, sf_dir):
    """The earlier name of ``walk_cap`` over every person."""
    return walk_cap(spark, sf_dir)


@query(f""", {PARENTS},
w as (select handle as d, handle as a, 0 as n from d_person union select d, parent, n + 1 from w join par on child = a where n < 7),
c as (select d, a, min(n) as n from w group by d, a)
select d as descendant, count(*)::bigint as ancestors, max(n)::int as furthest, sum(n)::bigint as total from c group by d""")
def closure_counts(spark, sf_dir):
    people = flat(spark, sf_dir, "person").select("handle")
    c = graph.closure(graph.parent_edges(demo_tree(spark, sf_dir)), 7, people)
    return c.groupBy("descendant").agg(F.count("*").alias("ancestors"), F.max("distance").alias("furthest"), F.sum("distance").alias("total"))


@query(f""", {PARENTS},
pairs as (select handle as a, {h('P', '(k * 7 + 3) % (select count(*) from d_person)')} as b from d_person),
w as (select handle as d, handle as a, 0 as n from d_person union select d, parent, n + 1 from w join par on child = a where n < 15),
c as (select d, a, min(n) as n from w group by d, a),
best as (select p.a, p.b, min([x.n + y.n, x.n, y.n]) as r from pairs p join c x on x.d = p.a join c y on y.d = p.b and y.a = x.a group by p.a, p.b)
select p.a, p.b, coalesce(r[2], -1)::int as up, coalesce(r[3], -1)::int as down from (select distinct a, b from pairs) p left join best on best.a = p.a and best.b = p.b""")
def relationship_pairs(spark, sf_dir):
    people = flat(spark, sf_dir, "person")
    n = people.agg(F.count("*").alias("n"))
    pairs = people.crossJoin(F.broadcast(n)).select(F.col("handle").alias("a"), F.concat(F.lit("P"), F.lpad(((F.col("k") * 7 + 3) % F.col("n")).cast("string"), 9, "0")).alias("b"))
    return graph.relationship(graph.parent_edges(demo_tree(spark, sf_dir)), pairs, people.select("handle", "gender")).select("a", "b", "up", "down")


@query(SQL["relationship_pairs"].removeprefix(sql_tables()))
def relationship_pairs_all(spark, sf_dir):
    """The earlier name of ``relationship_pairs`` with a partner for every person."""
    return relationship_pairs(spark, sf_dir)


@query(f""", {PARENTS},
u as (select max(handle) as h from d_person union select parent from u join par on child = h),
d as (select h from u union select child from d join par on parent = h)
select distinct h as handle from d""")
def branch_common_ancestor(spark, sf_dir):
    root = _last_person(spark, sf_dir).first()["root"]
    return graph.branch(demo_tree(spark, sf_dir), root, "CommonAncestor").select("handle")


@query(""" select handle, record_id from d_person where surname like '%BUILD%' and gender = 1 and not private""")
def person_filter_surname(spark, sf_dir):
    p = demo_tree(spark, sf_dir).person
    test = path("primary_name.surname_list").any(lambda s: s["surname"].contains("BUILD"))
    return p.where(test & path("gender").eq(1) & ~path("private").truthy(p.schema["private"].dataType)).select("handle", "record_id")


@query(""" select f.handle from d_family f where exists (select 1 from d_person c where c.fk = f.fk and c.gender = 0 and c.birth_year % 2 = 1)""")
def family_any_child(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    odd = flat(spark, sf_dir, "person").where("gender = 0 and birth_year % 2 = 1").select("handle")
    return where_refs(t.family, "handle", F.col("child_ref_list.ref"), odd, "any").select("handle")


@query(""" select f.handle from d_family f where not exists (select 1 from d_person c where c.fk = f.fk and c.k % 3 = 0)""")
def family_all_children(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    good = flat(spark, sf_dir, "person").where("k % 3 <> 0").select("handle")
    return where_refs(t.family, "handle", F.col("child_ref_list.ref"), good, "all").select("handle")


@query(""" select e.handle from d_event e join d_place p on p.handle = 'S' || lpad(e.place_no::varchar, 9, '0') where p.name like '%2' and e.type = 'Baptism'""")
def event_deref_place(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    there = t.place.where(path("name").column.endswith("2")).select("handle")
    return where_refs(t.event.where(path("type").eq("Baptism")), "handle", F.array("place"), there).select("handle")


@query(""" select handle from d_person where (case when gender = 1 then 1 else 0 end + case when private then 1 else 0 end + case when regexp_matches(first_name, '7$') then 1 else 0 end) = 1""")
def rule_filter_one(spark, sf_dir):
    p = demo_tree(spark, sf_dir).person
    return p.where(rules([path("gender").eq(1), F.col("private"), F.col("primary_name.first_name").rlike("7$")], "one")).select("handle")


@query(f""" select handle from d_event where {KEY} between {jdn('1850', '3', '1')} and {jdn('1861', '1', '1')} - 1 and {KEY} > 0""")
def date_filter_range(spark, sf_dir):
    return demo_tree(spark, sf_dir).event.where(dates.date_filter(F.col("date"), "1850/3/0-1860")).select("handle")


@query(f""" select handle from d_event where {KEY} > 0 and m1 = 7 and d1 = 11""")
def date_filter_wildcard(spark, sf_dir):
    return demo_tree(spark, sf_dir).event.where(dates.date_filter(F.col("date"), "*/7/11")).select("handle")


@query(""" select handle from d_family where fk % 7 = 0""")
def gap_family_no_marriage(spark, sf_dir):
    v = references.family_view(demo_tree(spark, sf_dir))
    return v.where("marriage is null").select("handle")


@query(f""" , e as (
  select 'person' as st, {h('P', 'owner')} as src, 'event' as dt, handle as dst from d_event where owner_class = 'person'
  union all select 'family', {h('F', 'owner')}, 'event', handle from d_event where owner_class = 'family'
  union all select 'person', father_handle, 'family', handle from d_family union all select 'person', mother_handle, 'family', handle from d_family
  union all select 'person', handle, 'family', {h('F', 'fk')} from d_person where fk is not null
  union all select 'family', {h('F', 'fk')}, 'person', handle from d_person where fk is not null
  union all select 'family', handle, 'person', father_handle from d_family union all select 'family', handle, 'person', mother_handle from d_family
  union all select 'person', handle, 'tag', {h('T', 'nation')} from d_person
  union all select 'event', handle, 'place', {h('S', 'place_no')} from d_event
  union all select 'event', event_handle, 'citation', handle from d_citation where event_handle in (select handle from d_event)
  union all select 'place', handle, 'place', parent from d_place where parent is not null
  union all select 'source', source_handle, 'repository', ref from d_reporef where source_handle in (select handle from d_source)
  union all select 'citation', handle, 'source', source_handle from d_citation)
select dt as dst_type, dst, st as src_type, count(distinct src)::bigint as referrers from e group by all""")
def backlink_counts(spark, sf_dir):
    return references.backlinks(demo_tree(spark, sf_dir))


@query(f""" select 'event' as src_type, e.handle as src, {h('S', 'place_no')} as dst from d_event e where {h('S', 'place_no')} not in (select handle from d_place)
union all select 'citation', handle, source_handle from d_citation where source_handle not in (select handle from d_source)""")
def dangling_refs(spark, sf_dir):
    d = references.dangling(demo_tree(spark, sf_dir))
    return d.select("src_type", "src", "dst")


@query(""" select handle, trim(first_name || ' ' || surname) as name, case gender when 0 then 'F' when 1 then 'M' else 'U' end as sex,
  'EB' || lpad(k::varchar, 9, '0') as birth, case when death_year is not null then 'ED' || lpad(k::varchar, 9, '0') end as death from d_person""")
def person_profile(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    names = references.person_names(t)
    return references.vital_events(t).join(names, "handle").join(t.person.select("handle", "gender"), "handle").select("handle", "name", labels.gender_letter(F.col("gender")).alias("sex"), "birth", "death")


@query(f""" select f.handle, trim(a.first_name || ' ' || a.surname) as father, trim(b.first_name || ' ' || b.surname) as mother,
  (select string_agg(c.first_name || ' ' || c.surname, '; ' order by c.k) from d_person c where c.fk = f.fk) as children,
  case when f.fk % 7 <> 0 then {h('EM', 'f.fk')} end as marriage from d_family f join d_person a on a.k = f.fk join d_person b on b.k = f.mk""")
def family_view(spark, sf_dir):
    v = references.family_view(demo_tree(spark, sf_dir))
    return v.select("handle", "father", "mother", F.array_join(F.col("children.name"), "; ").alias("children"), "marriage")


@query(f""" select handle as event, {h('P', 'owner')} as person, 'Primary' as role from d_event where owner_class = 'person'
union all select e.handle, f.father_handle, 'Husband' from d_event e join d_family f on e.owner = f.fk where owner_class = 'family'
union all select e.handle, f.mother_handle, 'Wife' from d_event e join d_family f on e.owner = f.fk where owner_class = 'family'""")
def event_participants(spark, sf_dir):
    return references.event_participants(demo_tree(spark, sf_dir))


@query(f""", {PARENTS} , kin as (
  select child as person, 'parent' as relation, parent as kin from par union all select parent, 'child', child from par
  union all select father_handle, 'spouse', mother_handle from d_family union all select mother_handle, 'spouse', father_handle from d_family
  union all select a.handle, 'sibling', b.handle from d_person a join d_person b on a.fk = b.fk and a.k <> b.k)
select distinct * from kin""")
def close_kin(spark, sf_dir):
    return references.close_kin(demo_tree(spark, sf_dir))


@query(""" , up as (
  select handle, case when title <> '' then title else name end as p, case when title <> '' then null else parent end as nxt from d_place
  union all select u.handle, u.p || ', ' || case when q.title <> '' then q.title else q.name end, case when q.title <> '' then null else q.parent end from up u join d_place q on q.handle = u.nxt)
select handle, p as path from up where nxt is null""")
def place_path(spark, sf_dir):
    return references.place_path(demo_tree(spark, sf_dir).place)


@query(""" select c.event_handle as event, c.handle as citation, confidence, page, s.title, r.name as repository
from d_citation c join d_event e on e.handle = c.event_handle left join d_source s on s.handle = c.source_handle
left join d_reporef rr on rr.source_handle = s.handle left join d_repository r on r.handle = rr.ref""")
def evidence_chain(spark, sf_dir):
    return references.evidence_chain(cited_tree(spark, sf_dir))


@query(""" select e.handle as event, count(c.handle)::bigint as citations, max(confidence) as confidence from d_event e left join d_citation c on c.event_handle = e.handle group by e.handle""")
def event_ratings(spark, sf_dir):
    return references.event_ratings(cited_tree(spark, sf_dir))


_MONTH = "['January','February','March','April','May','June','July','August','September','October','November','December']"


def _part(d: str, m: str, y: str) -> str:
    return f"case when {m} > 0 and {d} > 0 then lpad({d}::varchar, 2, '0') || ' ' || {_MONTH}[{m}] || ' ' || {y} when {m} > 0 then {_MONTH}[{m}] || ' ' || {y} else {y}::varchar end"


@query(f""" select handle, case when modifier = 6 then text else
  case modifier when 1 then 'before ' when 3 then 'about ' when 4 then 'between ' else '' end || {_part('d1', 'm1', 'y1')}
  || case when modifier = 4 then ' and ' || {_part('d2', 'm2', 'y2')} else '' end
  || case quality when 1 then ' (estimated)' when 2 then ' (calculated)' else '' end end as date_text from d_event""")
def date_text(spark, sf_dir):
    return demo_tree(spark, sf_dir).event.select("handle", dates.date_text(F.col("date")).alias("date_text"))


@query(f""" select handle, {KEY}::bigint as sortval from d_event""")
def date_sort_key(spark, sf_dir):
    return demo_tree(spark, sf_dir).event.select("handle", dates.sort_key(F.col("date")).alias("sortval"))


@query(f""" , x as (select b.k, make_date(b.y1, greatest(b.m1, 1), greatest(b.d1, 1)) as b, make_date(d.y1, greatest(d.m1, 1), greatest(d.d1, 1)) as d
  from d_event b join d_event d on d.type = 'Death' and b.type = 'Birth' and b.k = d.k and b.modifier <> 6 and d.modifier <> 6 where true)
select {h('P', 'k')} as handle, datesub('year', b, d)::bigint as years, (datesub('month', b, d) % 12)::bigint as months from x""")
def event_span(spark, sf_dir):
    v = references.vital_events(demo_tree(spark, sf_dir))
    y, m, _ = dates.span_parts(F.col("birth_date"), F.col("death_date"))
    known = (dates.sort_key(F.col("birth_date")) > 0) & (dates.sort_key(F.col("death_date")) > 0)
    return v.where(known).select("handle", y.alias("years"), m.cast("long").alias("months"))


@query(""" , want as (select 'I' || lpad((c_custkey * 2)::varchar, 9, '0') as record_id from customer)
select w.record_id, min(p.handle) as handle from want w left join d_person p on p.record_id = w.record_id group by w.record_id""")
def resolve_ids(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("I"), F.lpad((F.col("c_custkey") * 2).cast("string"), 9, "0")).alias("record_id"))
    return references.resolve_ids(demo_tree(spark, sf_dir).person, ids)


@query(""" select handle, (row_number() over (order by surname desc, gender, handle) - 1)::bigint // 20 + 1 as page, (select count(*) from d_person)::bigint as total from d_person
qualify page = 2""")
def paged_people(spark, sf_dir):
    p = demo_tree(spark, sf_dir).person.withColumn("surname", F.get("primary_name.surname_list", 0)["surname"])
    page, total = paging.page(p, "-surname,gender", {"surname": F.col("surname"), "gender": F.col("gender")}, number=2)
    return page.crossJoin(F.broadcast(total)).select("handle", F.lit(2).cast("long").alias("page"), "total")


@query(""" select handle, row_number() over (order by surname desc, gender, handle)::bigint as position from d_person""")
def people_positions(spark, sf_dir):
    p = demo_tree(spark, sf_dir).person.withColumn("surname", F.get("primary_name.surname_list", 0)["surname"])
    order = paging.sort_columns("-surname,gender", {"surname": F.col("surname"), "gender": F.col("gender")})
    return paging.positions(p, *order).select("handle", "position")


@query(f""" , e as (select *, {KEY} as day from d_event), placed as (select handle, type, row_number() over (order by type desc, day, handle) as position from e)
select handle, type, position::bigint as position from placed where position > (select (count(*) // 50) // 2 * 50 from placed) and position <= (select (count(*) // 50) // 2 * 50 + 50 from placed)""")
def deep_event_page(spark, sf_dir):
    events = demo_tree(spark, sf_dir).event.withColumn("day", dates.sort_key(F.col("date")))
    stored = paging.store_ordered(events, "-type,day", {"type": F.col("type"), "day": F.col("day")})
    return stored.page(stored.total // 50 // 2 + 1, 50).select("handle", "type", "position")


from kinframe.operators import changes, search, statistics, timelines  # noqa: E402
from kinframe.streaming import history  # noqa: E402

_KIN = f"""{PARENTS}, kin as (
  select child as person, 'parent' as relation, parent as kin from par union all select parent, 'child', child from par
  union all select father_handle, 'spouse', mother_handle from d_family union all select mother_handle, 'spouse', father_handle from d_family
  union all select a.handle, 'sibling', b.handle from d_person a join d_person b on a.fk = b.fk and a.k <> b.k)"""
_TOOK = f"""took as (select handle as event, {h('P', 'owner')} as person from d_event where owner_class = 'person'
  union all select e.handle, unnest([f.father_handle, f.mother_handle]) from d_event e join d_family f on e.owner = f.fk and owner_class = 'family')"""


@query(f""", {_KIN}, {_TOOK}, ev as (select *, {KEY} as sk from d_event),
who as (select handle as anchor, handle as person, 'self' as relation from d_person union select person, kin, relation from kin)
select anchor, event, t.person, relation, case when relation = 'self' then type else type || ' of ' || relation end as label, sk::bigint as sortval
from who join took t on t.person = who.person join ev on ev.handle = t.event where sk > 0 and (relation = 'self' or type in ('Birth', 'Death'))""")
def person_timeline(spark, sf_dir):
    return timelines.person_timeline(demo_tree(spark, sf_dir)).drop("age_years")


@query(f""", {PARENTS}, {_TOOK}, ev as (select *, {KEY} as sk from d_event),
mem as (select handle as family, father_handle as person from d_family union select handle, mother_handle from d_family union select {h('F', 'fk')}, handle from d_person where fk is not null)
select distinct family, event, m.person, sk::bigint as sortval from mem m join took t on t.person = m.person join ev on ev.handle = t.event where sk > 0""")
def family_timeline(spark, sf_dir):
    return timelines.family_timeline(demo_tree(spark, sf_dir))


@query(f""", {_KIN}, v as (select p.handle, case when b.modifier <> 6 then b.y1 end as own, case when d.modifier <> 6 then d.y1 end as dy, p.death_year is not null as died
  from d_person p join d_event b on b.handle = 'EB' || lpad(p.k::varchar, 9, '0') left join d_event d on d.handle = 'ED' || lpad(p.k::varchar, 9, '0')),
near as (select person, min(own) filter (relation = 'sibling') as sib, min(own) filter (relation = 'child') as kid, max(own) filter (relation = 'parent') as par, min(own) filter (relation = 'spouse') as mate
  from kin join v on v.handle = kin.kin group by person),
r as (select v.handle, died, coalesce(own, dy - 110, sib - 20, kid - 20, par + 20, mate) as y,
  case when own is not null then 'birth' when dy is not null then 'death' when sib is not null then 'sibling' when kid is not null then 'child' when par is not null then 'parent' when mate is not null then 'spouse' else 'none' end as rule
  from v left join near on near.person = v.handle)
select handle, (not died and coalesce(2024 - y <= 110, true)) as living, y::int as birth_year, rule from r""")
def living_status(spark, sf_dir):
    return timelines.living(demo_tree(spark, sf_dir), 2024)


@query(f""", b as (select k, {KEY} as s from d_event where type = 'Birth'), d as (select k, {KEY} as s from d_event where type = 'Death'),
age as (select b.k, d.s - b.s as value from b join d on b.k = d.k where b.s > 0 and d.s > 0),
kids as (select fk as k, count(*) as value from d_person where fk is not null group by fk union all select mk, count(*) from d_person where mk is not null group by mk),
m as (select 'oldest at death' as fact, k, value, -value as s from age union all select 'youngest at death', k, value, value from age union all select 'most children', k, value, -value from kids)
select fact, place::int as place, {h('P', 'k')} as handle, value::bigint as value from (select *, rank() over (partition by fact order by s) as place from m) where place <= 3""")
def facts_ranked(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    m = timelines.metric_facts(t, timelines.living(t, 2024))
    return timelines.ranked_facts(m.where(F.col("fact").isin("oldest at death", "youngest at death", "most children")))


_STATUS, _LIVING = SQL["living_status"].removeprefix(sql_tables()).rsplit("\nselect ", 1)


@query(f"""{_STATUS}, status as (select {_LIVING}), e as (select *, {KEY} as s from d_event),
fb as (select k, s from e where type = 'Birth' and s > 0), fd as (select k, s from e where type = 'Death' and s > 0), fw as (select k, s from e where type = 'Marriage' and s > 0),
alive as (select k, s as value from fb join status on handle = {h('P', 'k')} where living),
age as (select k, fd.s - fb.s as value from fb join fd using (k)),
kids as (select fk as k, count(*) as value from d_person where fk is not null group by fk union all select mk, count(*) from d_person where mk is not null group by mk),
sp as (select fk as family, fk as k from d_family union all select fk, mk from d_family),
wed as (select sp.k, min(fw.s - fb.s) as low, max(fw.s - fb.s) as high from sp join fw on fw.k = family join fb on fb.k = sp.k where fw.s >= fb.s group by sp.k),
dad as (select p.k, min(c.s - p.s) as low, max(c.s - p.s) as high from d_person x join fb c on c.k = x.k join fb p on p.k = x.fk where c.s >= p.s group by p.k),
mum as (select p.k, min(c.s - p.s) as low, max(c.s - p.s) as high from d_person x join fb c on c.k = x.k join fb p on p.k = x.mk where c.s >= p.s group by p.k),
fin as (select family, min(s) as s from sp join fd on fd.k = sp.k group by family),
len as (select family as k, fin.s - fw.s as value from fin join fw on fw.k = family where fin.s >= fw.s),
m as (select 'youngest living' as fact, {h('P', 'k')} as handle, value, -value as s from alive union all select 'oldest living', {h('P', 'k')}, value, value from alive
  union all select 'oldest at death', {h('P', 'k')}, value, -value from age union all select 'youngest at death', {h('P', 'k')}, value, value from age
  union all select 'most children', {h('P', 'k')}, value, -value from kids
  union all select 'youngest at marriage', {h('P', 'k')}, low, low from wed union all select 'oldest at marriage', {h('P', 'k')}, high, -high from wed
  union all select 'youngest father at a birth', {h('P', 'k')}, low, low from dad union all select 'oldest father at a birth', {h('P', 'k')}, high, -high from dad
  union all select 'youngest mother at a birth', {h('P', 'k')}, low, low from mum union all select 'oldest mother at a birth', {h('P', 'k')}, high, -high from mum
  union all select 'longest marriage', {h('F', 'k')}, value, -value from len union all select 'shortest marriage', {h('F', 'k')}, value, value from len)
select fact, place::int as place, handle, value::bigint as value from (select *, rank() over (partition by fact order by s) as place from m) where place <= 3""")
def facts_all(spark, sf_dir):
    """All thirteen facts; ``facts_ranked`` has three of them."""
    t = demo_tree(spark, sf_dir)
    return timelines.ranked_facts(timelines.metric_facts(t, timelines.living(t, 2024)))


@query(""" select 'person' as object_type, count(*)::bigint as n from d_person union all select 'family', count(*) from d_family union all select 'event', count(*) from d_event
union all select 'place', count(*) from d_place union all select 'source', count(*) from d_source union all select 'citation', count(*) from d_citation
union all select 'repository', count(*) from d_repository union all select 'media', count(*) from pages union all select 'note', count(*) from documents union all select 'tag', count(*) from nation""")
def object_counts(spark, sf_dir):
    return statistics.object_counts(demo_tree(spark, sf_dir))


@query(""" select case when surname in ('BUILDING', 'MACHINERY') then 'Makers' else surname end as surname_group, count(*)::bigint as people from d_person group by 1""")
def surname_groups(spark, sf_dir):
    people = demo_tree(spark, sf_dir).person
    mapping = people.select(F.explode("primary_name.surname_list.surname").alias("surname")).distinct().where(F.col("surname").isin("BUILDING", "MACHINERY")).withColumn("grp", F.lit("Makers"))
    return statistics.surname_groups(people, mapping)


@query(f""" , cited as (select distinct event_handle from d_citation)
select {h('P', 'owner')} as handle, count(c.event_handle)::bigint as cited, (count(*) - count(c.event_handle))::bigint as uncited
from d_event e left join cited c on c.event_handle = e.handle where owner_class = 'person' group by 1""")
def citation_coverage(spark, sf_dir):
    return statistics.citation_coverage(demo_tree(spark, sf_dir))


@query(""" , tok as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as term from documents),
idx as (select term, doc_id, count(*) as tf from tok group by all),
q as (select item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) as term from benchmark),
df as (select term, count(*) as df from idx where term in (select term from q) group by term),
s as (select item_id, doc_id, count(*) as met, sum(tf * ln((select count(*) from documents)::double / df)) as score from q join idx using (term) join df using (term) group by all),
need as (select item_id, count(*) as need from q group by all)
select item_id as query_id, doc_id as id, round(score, 4) as score from s join need using (item_id) where met = need""")
def text_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return search.search(search.inverted_index(docs, "doc_id", "text"), docs.count(), queries).withColumn("score", F.round("score", 4))


@query(""" , q as (select vec_id, embedding::double[] as q from embeddings where vec_id % 20 = 0),
c as (select q.vec_id as query_id, e.vec_id as id, list_cosine_similarity(q.q, e.embedding::double[]) as cosine from q, embeddings e)
select query_id, id, round(cosine, 6) as cosine from (select *, row_number() over (partition by query_id order by cosine desc, id) as place from c) where place <= 5""")
def semantic_topk(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.semantic_topk(e, queries, 5).select("query_id", "id", F.round("cosine", 6).alias("cosine"))


@query(""" select a.handle as a, b.handle as b, levenshtein(a.first_name, b.first_name)::int as edits from d_person a join d_person b
on a.surname = b.surname and a.birth_year // 10 = b.birth_year // 10 and a.nation = b.nation and a.handle < b.handle where levenshtein(a.first_name, b.first_name) <= 2""")
def duplicate_candidates(spark, sf_dir):
    people = flat(spark, sf_dir, "person").select("handle", "first_name", "surname", "birth_year", F.col("nation").alias("place"))
    return search.duplicate_candidates(people)


@query(f""" , ch as (select handle from d_person where k % 10 = 0)
select p.handle, case when ch.handle is not null and k % 20 = 0 then 2 else gender end::int as gender,
  (1 + case when ch.handle is not null then 1 else 0 end)::int as tags from d_person p left join ch on ch.handle = p.handle
union all select 'PNEW', 2, 1""")
def upsert_merge(spark, sf_dir):
    p = demo_tree(spark, sf_dir).person
    rows = flat(spark, sf_dir, "person").where("k % 10 = 0").select(
        "handle", F.lit(2).alias("gender"), F.array(F.lit("Tnew"), F.concat(F.lit("T"), F.lpad(F.col("nation").cast("string"), 9, "0"))).alias("tag_list"),
        F.when(F.col("k") % 20 == 0, F.array(F.lit("gender"), F.lit("tag_list"))).otherwise(F.array(F.lit("tag_list"))).alias("present"))
    new = rows.limit(1).select(F.lit("PNEW").alias("handle"), "gender", F.array(F.lit("Tnew")).alias("tag_list"), F.array(F.lit("gender"), F.lit("tag_list")).alias("present"))
    return changes.upsert(p, rows.union(new)).select("handle", "gender", F.size("tag_list").alias("tags"))


@query(""" select handle from d_source where k % 2 = 1 or handle in (select source_handle from d_citation)""")
def guarded_delete(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    return changes.guarded_delete(t, "source", flat(spark, sf_dir, "source").where("k % 2 = 0").select("handle"))[0].select("handle")


@query(""" select handle, case when k % 3 = 0 then 0 else 1 end::int as left_over from d_person""")
def detach(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    gone = flat(spark, sf_dir, "person").where("k % 3 = 0").select("handle", F.concat(F.lit("T"), F.lpad(F.col("nation").cast("string"), 9, "0")).alias("ref"))
    return changes.detach(t.person, "tag_list", gone)[0].select("handle", F.size("tag_list").alias("left_over"))


@query(""" select handle, case when substr(source_handle, 2)::bigint % 5 = 1 then 'Q' || lpad((substr(source_handle, 2)::bigint - 1)::varchar, 9, '0') else source_handle end as source_handle from d_citation""")
def merge_records(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    pairs = flat(spark, sf_dir, "source").where("k % 5 = 1").select(F.concat(F.lit("Q"), F.lpad((F.col("k") - 1).cast("string"), 9, "0")).alias("survivor"), F.col("handle").alias("absorbed"))
    return changes.merge_records(t, "source", pairs)[0].citation.select("handle", "source_handle")


@query(""" , r as (select o_orderkey as row_id, case when o_orderkey % 4 <> 1 then 'Q' || lpad((o_orderkey % 300)::varchar, 9, '0') end as sh,
  case when o_orderkey % 4 = 1 then 'Title ' || (o_orderkey % 50)::varchar when o_orderkey % 4 = 2 then 'both' end as st from orders)
select row_id, case when o.row_id % 4 = 2 then 'needs a source handle or a title, not both' else 'no such source' end as reason
from r o where row_id % 4 = 2 or (row_id % 4 <> 1 and sh not in (select handle from d_source))""")
def sourced_events_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("row_id"), F.when(k % 4 != 1, F.concat(F.lit("Q"), F.lpad((k % 300).cast("string"), 9, "0"))).alias("source_handle"),
        F.when(k % 4 == 1, F.concat(F.lit("Title "), (k % 50).cast("string"))).when(k % 4 == 2, "both").alias("source_title"), F.lit("1").alias("page"), F.lit("Census").alias("type"), F.lit("").alias("place"))
    return changes.sourced_events(demo_tree(spark, sf_dir), rows)[1]


@query(""" select handle, (case when gender = 0 then 'gender must be 1; ' else '' end || case when private then 'must be public; ' else '' end) as reasons from d_person where gender = 0 or private""")
def validation_rejects(spark, sf_dir):
    p = demo_tree(spark, sf_dir).person
    _, bad = changes.validate(p, [("gender must be 1; ", F.col("gender") == 1), ("must be public; ", ~F.col("private"))])
    return bad.select("handle", F.array_join("reasons", "").alias("reasons"))


@query(""" select tx_id, class, handle, action from d_changes order by tx_id desc limit 20""")
def recent_changes(spark, sf_dir):
    return history.history(flat(spark, sf_dir, "changes"), payloads=True).limit(20).select("tx_id", "class", "handle", "action")


@query(""" select strftime(time_bucket(interval '10 minutes', ts), '%Y-%m-%d %H:%M') as start, "user", class, count(*)::bigint as changes, (count(*) filter (action = 'delete'))::bigint as deletes from d_changes group by all""")
def change_windows(spark, sf_dir):
    return history.change_windows(flat(spark, sf_dir, "changes")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "user", "class", "changes", "deletes")


@query(""" select handle, class, tx_id from (select *, row_number() over (partition by handle, class order by tx_id desc) as n from d_changes) where n = 1 and action <> 'delete'""")
def latest_records(spark, sf_dir):
    return history.latest(flat(spark, sf_dir, "changes").withColumn("new", F.lit(""))).select("handle", "class", "tx_id")


@query()
def tree_lines(spark, sf_dir):
    w = graph.walk(graph.parent_edges(demo_tree(spark, sf_dir)), _last_person(spark, sf_dir), max_generations=6)
    return graph.tree_lines(w)
