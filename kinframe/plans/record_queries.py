"""Queries on records, labels, predicates, kin and changes, each with its DuckDB twin; importing the module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions import dates, labels
from kinframe.functions.predicates import path, rules
from kinframe.operators import changes, graph, kinship, references, search, statistics, timelines
from kinframe.plans.demo import demo_tree, flat, sql_tables
from kinframe.plans.queries import KEY, PARENTS, SQL, h, jdn, query
from kinframe.sources.records import missing_media
from kinframe.streaming import history

DAY = "make_date(greatest(y1, 1), greatest(m1, 1), greatest(d1, 1))"
NAME = "trim({0}.first_name || ' ' || {0}.surname)"


def _padded(letter: str, key):
    return F.concat(F.lit(letter), F.lpad(key.cast("string"), 9, "0"))


def _twin(name: str) -> tuple[str, str]:
    """The tables and the main select of a query's twin."""
    tables, main = SQL[name].removeprefix(sql_tables()).rsplit("\nselect ", 1)
    return tables, f"select {main}"


@query(f""" , want as (select distinct {h('P', 'o_custkey')} as handle from orders) select handle, record_id from d_person where handle in (select handle from want)""")
def get_records(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(_padded("P", F.col("o_custkey")))
    return references.get(demo_tree(spark, sf_dir).person, asked).select("handle", "record_id")


@query(f""" , want as (select distinct case when c_custkey % 2 = 0 then {h('I', 'c_custkey * 3')} else {h('P', 'c_custkey')} || 'x' end as value from customer)
select value, case when value like 'I%' then p.handle else value end as handle from want left join d_person p on p.record_id = value""")
def resolve_ids_or_handles(spark, sf_dir):
    k = F.col("c_custkey")
    values = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(k % 2 == 0, _padded("I", k * 3)).otherwise(F.concat(_padded("P", k), F.lit("x"))))
    return references.resolve_any(demo_tree(spark, sf_dir).person, values)


@query(""" select c.handle, coalesce(p.record_id, c.handle) as shown from (select distinct handle from d_changes) c left join d_person p on p.handle = c.handle""")
def changed_by_id(spark, sf_dir):
    return references.id_or_handle(demo_tree(spark, sf_dir).person, flat(spark, sf_dir, "changes").select("handle"))


@query(""" select title, handle from d_source qualify row_number() over (partition by title order by handle) <= 10""")
def sources_by_title(spark, sf_dir):
    source = demo_tree(spark, sf_dir).source
    return references.sources_by_title(source, source.select("title"))


@query(f""" select handle, {NAME.format('p')} as full_name from d_person p""")
def full_names(spark, sf_dir):
    p = demo_tree(spark, sf_dir).person
    return p.select("handle", labels.full_name(F.col("primary_name.first_name"), F.col("primary_name.surname_list.surname")).alias("full_name"))


_LABELS = f"""named as (
  select 'person' as type, handle, {NAME.format('p')} as t from d_person p
  union all select 'family', f.handle, {NAME.format('a')} || ' & ' || {NAME.format('b')} from d_family f join d_person a on a.k = f.fk join d_person b on b.k = f.mk
  union all select 'event', handle, null from d_event union all select 'place', handle, case when trim(title) <> '' then trim(title) else trim(name) end from d_place
  union all select 'source', handle, trim(title) from d_source union all select 'citation', handle, trim(page) from d_citation union all select 'repository', handle, trim(name) from d_repository
  union all select 'media', {h('O', 'page_id')}, trim(url) from pages union all select 'note', {h('D', 'doc_id')}, trim(text) from documents union all select 'tag', {h('T', 'n_nationkey')}, trim(n_name) from nation)"""


@query(f""", {_LABELS} select type, handle, coalesce(substr(nullif(t, ''), 1, 80), '(no label)') as label from named""")
def record_labels(spark, sf_dir):
    return references.record_labels(demo_tree(spark, sf_dir))


@query(f""" select {h('D', 'doc_id')} as handle, case when length(trim(text)) > 500 then substr(trim(text), 1, 500) || '...' else trim(text) end as excerpt from documents""")
def note_excerpts(spark, sf_dir):
    return demo_tree(spark, sf_dir).note.select("handle", labels.excerpt(F.col("text.string")).alias("excerpt"))


@query(f""" select {h('O', 'page_id')} as handle, 'text/html - ' || coalesce(nullif(trim(url), ''), 'No description') as line from pages""")
def media_lines(spark, sf_dir):
    return demo_tree(spark, sf_dir).media.select("handle", labels.media_line(F.col("mime"), F.col("desc"), F.lit("date unknown")).alias("line"))


@query(""" select handle from d_event where y1 >= 1850 and y1 < 1870""")
def event_year_compare(spark, sf_dir):
    year = path("date.y1")
    return demo_tree(spark, sf_dir).event.where(year.compare(">=", 1850) & year.compare("<", 1870)).select("handle")


@query(f""" select p.handle, p.nation = 3 as has_tag, count(e.handle)::int as events, 'EB' || lpad(p.k::varchar, 9, '0') as first from d_person p left join d_event e on e.owner = p.k and owner_class = 'person' group by all""")
def list_membership(spark, sf_dir):
    refs = path("event_ref_list")
    return demo_tree(spark, sf_dir).person.select("handle", path("tag_list").has("T000000003").alias("has_tag"), refs.length().column.alias("events"), refs[0]["ref"].column.alias("first"))


@query(""" select handle from d_person where not (gender = 1 or private)""")
def rule_filter_inverted(spark, sf_dir):
    return demo_tree(spark, sf_dir).person.where(rules([path("gender").eq(1), F.col("private")], "or", invert=True)).select("handle")


@query(f""" select 'until' as form, handle from d_event where {KEY} > 0 and {KEY} <= {jdn('1850', '7', '1')} - 1 union all select 'from', handle from d_event where {KEY} >= {jdn('1950', '2', '1')}""")
def date_filter_open(spark, sf_dir):
    event = demo_tree(spark, sf_dir).event
    part = lambda form, spec: event.where(dates.date_filter(F.col("date"), spec)).select(F.lit(form).alias("form"), "handle")
    return part("until", "-1850/6/0").union(part("from", "1950/2/1-"))


_STATUS, _LIVING = _twin("living_status")


@query(f"""{_STATUS}, status as ({_LIVING}), s as (select p.*, living from d_person p join status using (handle))
select 'LastNameOnly' as mode, handle, case when living then '[Living]' else first_name end as first_name, surname from s
union all select 'ReplaceCompleteName', handle, case when living then '[Living]' else first_name end, case when living then '[Living]' else surname end from s
union all select 'ExcludeAll', handle, first_name, surname from s where not living""")
def living_hidden(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    status = timelines.living(t, 2024)
    part = lambda mode: timelines.hide_living(t, status, mode).select(
        F.lit(mode).alias("mode"), "handle", F.col("primary_name.first_name").alias("first_name"), F.get("primary_name.surname_list", 0)["surname"].alias("surname"))
    return part("LastNameOnly").union(part("ReplaceCompleteName")).union(part("ExcludeAll"))


@query(f""" select {h('O', 'page_id')} as handle from pages where url not in (select url from pages where page_id % 3 = 0 and url is not null)""")
def media_without_file(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id % 3 = 0").select(F.col("url").alias("path"))
    return missing_media(demo_tree(spark, sf_dir).media, files).select("handle")


@query(f""", {PARENTS}, up as (select max(handle) as h from d_person union select parent from up join par on child = h),
down as (select min(handle) as h from d_person union select child from down join par on parent = h)
select 'Ancestors' as kind, h as handle from up union all select 'Descendants', h from down
union all select 'DescendantFamilies', handle from d_family where father_handle in (select h from down) or mother_handle in (select h from down)""")
def branches(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    ends = flat(spark, sf_dir, "person").agg(F.min("handle").alias("first"), F.max("handle").alias("last")).first()
    part = lambda kind, who: graph.branch(t, who, kind).select(F.lit(kind).alias("kind"), "handle")
    return part("Ancestors", ends["last"]).union(part("Descendants", ends["first"])).union(part("DescendantFamilies", ends["first"]))


@query(""" select s.handle, coalesce(string_agg(r.name, '; ' order by rr.ref), '') as repositories from d_source s left join d_reporef rr on rr.source_handle = s.handle left join d_repository r on r.handle = rr.ref group by s.handle""")
def extended_sources(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    return references.extend(t.source, "reporef_list", t.repository, "found").select("handle", F.array_join(F.col("found.name"), "; ").alias("repositories"))


@query(f""" select f.handle as dst, 'person' as src_type, father_handle as src, {NAME.format('p')} as label from d_family f join d_person p on p.k = f.fk
union select f.handle, 'person', f.mother_handle, {NAME.format('p')} from d_family f join d_person p on p.k = f.mk
union select {h('F', 'fk')}, 'person', handle, {NAME.format('p')} from d_person p where fk is not null""")
def family_backlinks(spark, sf_dir):
    return references.extended_backlinks(demo_tree(spark, sf_dir), "family")


@query(""" select e.handle, coalesce(string_agg(c.handle, '; ' order by c.handle), '') as citations from d_event e left join d_citation c on c.event_handle = e.handle group by e.handle""")
def attached_citations(spark, sf_dir):
    return references.attached(demo_tree(spark, sf_dir), "event", "citation_list").select("handle", F.array_join("ids", "; ").alias("citations"))


_MEMBER = f"""mem as (select handle, case when fk is not null then {h('F', 'fk')} else '' end as child_in,
  coalesce((select string_agg(f.handle, '; ' order by f.handle) from d_family f where f.fk = p.k or f.mk = p.k), '') as parent_in from d_person p)"""


@query(f""", {_MEMBER} select * from mem""")
def family_memberships(spark, sf_dir):
    m = references.memberships(demo_tree(spark, sf_dir))
    return m.select("handle", F.array_join("child_in", "; ").alias("child_in"), F.array_join("parent_in", "; ").alias("parent_in"))


@query(f""" select e.handle as event, {NAME.format('p')} as name from d_event e join d_person p on owner_class = 'person' and p.k = e.owner
union all select e.handle, {NAME.format('a')} || ' & ' || {NAME.format('b')} from d_event e join d_family f on owner_class = 'family' and f.fk = e.owner join d_person a on a.k = f.fk join d_person b on b.k = f.mk""")
def event_primary_names(spark, sf_dir):
    return references.primary_names(demo_tree(spark, sf_dir))


_KIN, _ = _twin("close_kin")


@query(f"""{_KIN} select distinct person, case relation when 'parent' then ['mother', 'father'] when 'child' then ['daughter', 'son'] when 'spouse' then ['wife', 'husband'] else ['sister', 'brother'] end[gender + 1] as term, kin
from kin join d_person p on p.handle = kin.kin where relation <> 'spouse'""")
def kin_terms(spark, sf_dir):
    return references.kin_by_term(demo_tree(spark, sf_dir), ("mother", "father", "daughter", "son", "sister", "brother"))


@query(f""", {_MEMBER}, ev as (select owner, handle, type, {KEY} as sk from d_event where owner_class = 'person')
select p.handle, {NAME.format('p')} as name, case gender when 0 then 'F' when 1 then 'M' else 'U' end as sex, 'EB' || lpad(k::varchar, 9, '0') as birth,
  case when death_year is not null then 'ED' || lpad(k::varchar, 9, '0') end as death, child_in, parent_in,
  coalesce((select string_agg(type || '@' || sk::varchar, '; ' order by sk, ev.handle) from ev where owner = p.k), '') as events from d_person p join mem using (handle)""")
def person_details(spark, sf_dir):
    d = references.person_detail(demo_tree(spark, sf_dir))
    shown = F.transform("events", lambda e: F.concat_ws("@", e["type"], e["sortval"].cast("string")))
    return d.select("handle", "name", "sex", "birth", "death", F.array_join("child_in", "; ").alias("child_in"), F.array_join("parent_in", "; ").alias("parent_in"), F.array_join(shown, "; ").alias("events"))


_WAYS, _ = _twin("relationship_pairs_all")
_WAYS = _WAYS.split(",\nbest as")[0]


@query(f"""{_WAYS},
met as (select p.a, p.b, x.a as anc, x.n as up, y.n as down from pairs p join c x on x.d = p.a join c y on y.d = p.b and y.a = x.a),
above as (select distinct met.a, met.b, parent as anc, up + 1 as up, down + 1 as down from met join par on child = anc)
select a, b, up::int as up, down::int as down, string_agg(distinct anc, '; ' order by anc) as ancestors from met where not exists (select 1 from above v where v.a = met.a and v.b = met.b and v.anc = met.anc and v.up = met.up and v.down = met.down) group by all""")
def relationship_ways(spark, sf_dir):
    people = flat(spark, sf_dir, "person")
    pairs = people.crossJoin(F.broadcast(people.agg(F.count("*").alias("n")))).select(F.col("handle").alias("a"), _padded("P", (F.col("k") * 7 + 3) % F.col("n")).alias("b"))
    ways = graph.relationships(graph.parent_edges(demo_tree(spark, sf_dir)), pairs)
    return ways.withColumn("ancestors", F.array_join("ancestors", "; "))


_LINES, _LINE = _twin("person_timeline")


@query(f"""{_LINES}, t as ({_LINE}), own as (select anchor, min(sortval) as lo, max(sortval) as hi from t where relation = 'self' group by anchor)
select t.anchor, event, person, relation from t join own on own.anchor = t.anchor and sortval between lo and hi""")
def timeline_own_span(spark, sf_dir):
    return timelines.bounded(timelines.person_timeline(demo_tree(spark, sf_dir)), first=True, last=True).select("anchor", "event", "person", "relation")


@query(f"""{_LINES}, t as ({_LINE}) select anchor, event, person, relation from t where sortval between {jdn('1850', '1', '1')} and {jdn('1901', '1', '1')} - 1""")
def timeline_dates(spark, sf_dir):
    low, high = timelines.day_bounds("1850/1/1-1900")
    return timelines.bounded(timelines.person_timeline(demo_tree(spark, sf_dir)), low=low, high=high).select("anchor", "event", "person", "relation")


@query(f"""{_LINES}, t as ({_LINE}), day as (select handle, {KEY} as sk, {DAY} as dt from d_event)
select anchor, event, person, relation, case when b.sk > 0 and e.sk >= b.sk then datesub('year', b.dt, e.dt) end::bigint as age_years
from t join day e on e.handle = t.event left join day b on b.handle = 'EB' || substr(anchor, 2)""")
def timeline_ages(spark, sf_dir):
    return timelines.person_timeline(demo_tree(spark, sf_dir)).select("anchor", "event", "person", "relation", F.col("age_years").cast("long").alias("age_years"))


_FAMILY, _FAMILY_LINE = _twin("family_timeline")


@query(f"""{_FAMILY}, t as ({_FAMILY_LINE}), day as (select handle, {KEY} as sk, {DAY} as dt from d_event)
select family, event, person, case when w.sk > 0 and e.sk >= w.sk then datesub('year', w.dt, e.dt) end::bigint as years
from t join day e on e.handle = t.event left join day w on w.handle = 'EM' || substr(family, 2)""")
def years_since_union(spark, sf_dir):
    return timelines.since_union(demo_tree(spark, sf_dir)).select("family", "event", "person", F.col("years").cast("long").alias("years"))


@query(""" select case when type in ('Birth', 'Death', 'Baptism') then 'vital' when type = 'Marriage' then 'family' when type = 'Occupation' then 'vocational' when type = 'Education' then 'academic'
  when type = 'Emigration' then 'travel' when type in ('Residence', 'Census') then 'residence' else 'custom' end as class, count(*)::bigint as n from d_event group by 1""")
def event_class_counts(spark, sf_dir):
    return demo_tree(spark, sf_dir).event.groupBy(timelines.event_class().alias("class")).agg(F.count("*").alias("n"))


@query(""" select distinct type as value from d_event where type not in (select case gender when 0 then 'Birth' else 'Marriage' end from d_person)""")
def event_custom_types(spark, sf_dir):
    t = demo_tree(spark, sf_dir)
    return statistics.custom_types(t.event, "type", t.person.select(F.when(F.col("gender") == 0, "Birth").otherwise("Marriage")).distinct())


@query(""" select "user" as tx_id, count(*)::bigint as changes, array_to_string(list_slice(list_sort(list(class || ':' || handle)), 1, 3), '; ') as first, greatest(count(*) - 3, 0)::bigint as more from d_changes group by 1""")
def change_summaries(spark, sf_dir):
    by_user = flat(spark, sf_dir, "changes").withColumn("tx_id", F.col("user"))
    return history.summaries(by_user).withColumn("first", F.array_join("first", "; "))


@query(""" select handle, case when k % 10 = 0 then 0 else 1 end::int as tags from d_person""")
def upsert_replace_list(spark, sf_dir):
    rows = flat(spark, sf_dir, "person").where("k % 10 = 0").select("handle", F.array().cast("array<string>").alias("tag_list"), F.array(F.lit("tag_list")).alias("present"))
    return changes.upsert(demo_tree(spark, sf_dir).person, rows, ["tag_list"]).select("handle", F.size("tag_list").alias("tags"))


@query(""" , r as (select o_orderkey as row_id, case when o_orderkey % 3 = 1 then 'New title ' || (o_orderkey % 50)::varchar end as st, 'Q' || lpad((o_orderkey % 300)::varchar, 9, '0') as sh from orders),
ok as (select row_id, coalesce(left(sha256('source|' || st), 32), sh) as source from r where st is not null or sh in (select handle from d_source))
select left(sha256('event|' || row_id::varchar), 32) as event, left(sha256('citation|' || row_id::varchar), 32) as citation, source from ok""")
def sourced_events_made(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("row_id"), F.when(k % 3 != 1, _padded("Q", k % 300)).alias("source_handle"), F.when(k % 3 == 1, F.concat(F.lit("New title "), (k % 50).cast("string"))).alias("source_title"),
        F.lit("1").alias("page"), F.lit("Census").alias("type"), F.lit("").alias("place"))
    made = changes.sourced_events(demo_tree(spark, sf_dir), rows)[0]
    cited = made["event"].select(F.col("handle").alias("event"), F.explode("citation_list").alias("citation"))
    return cited.join(made["citation"].select(F.col("handle").alias("citation"), F.col("source_handle").alias("source")), "citation").select("event", "citation", "source")


@query(""" select 'citation' as src_type, handle as src, source_handle as dst from d_citation where substr(source_handle, 2)::bigint % 2 = 0 or source_handle not in (select handle from d_source)""")
def dangling_after_loss(spark, sf_dir):
    """Dangling references of the tree once every second source is lost."""
    t = demo_tree(spark, sf_dir)
    left = t.source.where(F.substring("handle", 2, 20).cast("long") % 2 == 1)
    return references.dangling(t.with_tables(source=left)).where("dst_type = 'source'").select("src_type", "src", "dst")


@query(f""" , pub as (select * from d_person where not private)
select f.handle, a.handle as father, b.handle as mother, coalesce((select string_agg(c.handle, '; ' order by c.handle) from pub c where c.fk = f.fk), '') as children
from d_family f left join pub a on a.k = f.fk left join pub b on b.k = f.mk""")
def private_hidden(spark, sf_dir):
    """Families as they are without the private persons and the references to them."""
    t = references.without_private(demo_tree(spark, sf_dir))
    return t.family.select("handle", F.col("father_handle").alias("father"), F.col("mother_handle").alias("mother"), F.array_join(F.col("child_ref_list.ref"), "; ").alias("children"))


_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f""", {_LABELS}, q as (select n_nationkey as query_id, case when n_nationkey % 2 = 0 then 'place' end as asked, unnest(list_distinct({_TOKENS.format('n_name')})) as term from nation),
idx as (select type, handle, term, count(*) as tf from (select type, handle, unnest({_TOKENS.format("coalesce(t, '')")}) as term from named) group by all),
df as (select term, count(*) as df from idx group by term), need as (select query_id, count(*) as need from q group by query_id),
s as (select query_id, type, handle, count(*) as met, sum(tf * ln((select count(*) from named)::double / df)) as score from q join idx using (term) join df using (term) where asked is null or asked = type group by all)
select query_id, type, handle, round(score, 4) as score from s join need using (query_id) where met = need""")
def record_search(spark, sf_dir):
    """The names of nations over all ten record types, every second one over places alone."""
    queries = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("text"), F.when(F.col("n_nationkey") % 2 == 0, "place").alias("type"))
    found = search.search_records(references.record_texts(demo_tree(spark, sf_dir)), queries)
    return found.withColumn("score", F.round("score", 4))


@query(""" select handle, class, tx_id, class || '#' || tx_id::varchar || action as new from (select *, row_number() over (partition by handle, class order by tx_id desc) as n from d_changes) where n = 1 and action <> 'delete'""")
def latest_objects(spark, sf_dir):
    log = flat(spark, sf_dir, "changes").withColumn("new", F.concat("class", F.lit("#"), F.col("tx_id").cast("string"), "action"))
    return history.latest(log).select("handle", "class", "tx_id", "new")


_PAIRED, _ = _twin("relationship_pairs_all")


def _sexed(f: str, m: str, u: str) -> str:
    return f"(case gender when 0 then '{f}' when 1 then '{m}' else '{u}' end)"


@query(f"""{_PAIRED}, r as (select p.a, p.b, r[2] as up, r[3] as down, gender from (select distinct a, b from pairs) p left join best on best.a = p.a and best.b = p.b left join d_person x on x.handle = p.b)
select r.a, r.b, case when c.father_handle is not null and coalesce(up + down, 2) > 1 then {_sexed('wife', 'husband', 'partner')} when up is null then null when up = 0 and down = 0 then 'self'
  when down = 0 then (case when up > 1 then repeat('great-', up - 2) || 'grand' else '' end) || {_sexed('mother', 'father', 'parent')}
  when up = 0 then (case when down > 1 then repeat('great-', down - 2) || 'grand' else '' end) || {_sexed('daughter', 'son', 'child')}
  when up = 1 and down = 1 then {_sexed('sister', 'brother', 'sibling')}
  when down = 1 then (case when up > 2 then repeat('great-', up - 3) || 'grand' else '' end) || {_sexed('aunt', 'uncle', 'aunt or uncle')}
  when up = 1 then (case when down > 2 then repeat('great-', down - 3) || 'grand' else '' end) || {_sexed('niece', 'nephew', 'niece or nephew')}
  else (least(up, down) - 1)::varchar || (case least(up, down) - 1 when 1 then 'st' when 2 then 'nd' when 3 then 'rd' else 'th' end) || ' cousin' || (case when up <> down then ' ' || abs(up - down)::varchar || ' times removed' else '' end) end as relation
from r left join d_family c on (c.father_handle = r.a and c.mother_handle = r.b) or (c.father_handle = r.b and c.mother_handle = r.a)""")
def relationship_labels(spark, sf_dir):
    people = flat(spark, sf_dir, "person")
    pairs = people.crossJoin(F.broadcast(people.agg(F.count("*").alias("n")))).select(F.col("handle").alias("a"), _padded("P", (F.col("k") * 7 + 3) % F.col("n")).alias("b"))
    return graph.relationship(graph.parent_edges(demo_tree(spark, sf_dir)), pairs, people.select("handle", "gender"), partners=kinship.couples(demo_tree(spark, sf_dir))).select("a", "b", "relation")
