"""A deterministic family tree derived from the star-schema tables of a data folder.

``FLAT`` holds the derivation as SQL that Spark and DuckDB both run (``//`` is
integer division), so that an operator's result can be held against plain SQL
over the same rows; :func:`demo_tree` nests the rows as the operators want them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.functions.dates import DATE_DDL, sort_key
from kinframe.plans.checkpoints import shared_folder
from kinframe.tree import Tree

_LIFE = "case {k} % 6 when 0 then 'Occupation' when 1 then 'Residence' when 2 then 'Baptism' when 3 then 'Education' when 4 then 'Emigration' else 'Census' end"


def _date(k: str, y: str) -> str:
    """Columns of a date by key: about, range, text only and before by key % 11, no day by key % 5."""
    text_only = f"{k} % 11 = 6"
    return (
        f"cast(case {k} % 11 when 3 then 3 when 4 then 4 when 6 then 6 when 7 then 1 else 0 end as int) as modifier, cast({k} % 3 as int) as quality, "
        f"cast(case when {text_only} or {k} % 5 = 0 then 0 else 1 + {k} % 28 end as int) as d1, cast(case when {text_only} then 0 else 1 + {k} % 12 end as int) as m1, "
        f"cast(case when {text_only} then 0 else {y} end as int) as y1, cast(case when {k} % 11 = 4 then 1 + {k} % 28 else 0 end as int) as d2, "
        f"cast(case when {k} % 11 = 4 then 1 + {k} % 12 else 0 end as int) as m2, cast(case when {k} % 11 = 4 then {y} + 2 else 0 end as int) as y2, "
        f"case when {text_only} then concat('in the year ', cast({y} as string)) else '' end as text"
    )


def _h(letter: str, key: str) -> str:
    return f"concat('{letter}', lpad(cast({key} as string), 9, '0'))"


FLAT: dict[str, str] = {
    "n": "select 2 * ((count(*) + 15) // 16) as g from {customer}",
    "person": f"""
      select k, {_h('P', 'k')} as handle, {_h('I', 'k')} as record_id, gen, j, cast(case when k % 2 = 0 then 1 else 0 end as int) as gender, c_name as first_name, c_mktsegment as surname,
        case when gen > 0 then (gen - 1) * g + 2 * (j // 2) end as fk,
        case when gen > 0 then (gen - 1) * g + 2 * (((j // 2) + 5 * gen + 1) % (g // 2)) + 1 end as mk,
        1780 + 30 * gen + j % 10 as birth_year,
        case when k % 3 <> 0 and 1780 + 30 * gen + j % 10 + 40 + k % 50 <= 2024 then 1780 + 30 * gen + j % 10 + 40 + k % 50 end as death_year,
        k % 17 = 0 as private, c_nationkey as nation, 1700000000 + k as change
      from (select c_custkey as k, c_custkey // g as gen, c_custkey % g as j, g, c_name, c_mktsegment, c_nationkey from {{customer}}, {{n}}) t""",
    "family": f"""
      select {_h('F', 'f.k')} as handle, f.k as fk, m.k as mk, f.handle as father_handle, m.handle as mother_handle,
        case when f.birth_year > m.birth_year then f.birth_year else m.birth_year end + 20 as marriage_year, 1700000000 + f.k as change
      from (select distinct fk, mk from {{person}} where fk is not null) c join {{person}} f on f.k = c.fk join {{person}} m on m.k = c.mk""",
    "remarried": f"""
      select child, {_h('P', 'fk')} as father, {_h('P', 'mk')} as mother from (
        select handle as child, case when k % 2 = 1 and fk % 6 = 2 then base + (fk - base + 2) % g else fk end as fk, case when k % 2 = 1 and fk % 3 = 0 then base + (mk - base + 2) % g else mk end as mk
        from (select p.*, (gen - 1) * g as base, g from {{person}} p, {{n}} where fk is not null) t) u""",
    "event": f"""
      select {_h('EB', 'k')} as handle, 'Birth' as type, k as owner, 'person' as owner_class, k, {_date('k', 'birth_year')}, k % 20 as place_no, 0 as pos from {{person}}
      union all select {_h('ED', 'k')}, 'Death', k, 'person', k, {_date('(k + 1)', 'death_year')}, k % 20, 1 from {{person}} where death_year is not null
      union all select {_h('EM', 'fk')}, 'Marriage', fk, 'family', fk, {_date('(fk + 2)', 'marriage_year')}, fk % 20, 0 from {{family}} where fk % 7 <> 0
      union all select {_h('EO', 'o_orderkey')}, {_LIFE.format(k='o_orderkey')}, p.k, 'person', o_orderkey, {_date('(o_orderkey + 3)', '(p.birth_year + 5 + o_orderkey % 35)')}, o_orderkey % 20, 2
        from {{orders}} join {{person}} p on p.k = o_custkey""",
    "place": f"""
      select {_h('R', 'r_regionkey')} as handle, 'region' as place_type, r_name as name, '' as title, cast(null as string) as parent from {{region}}
      union all select {_h('N', 'n_nationkey')}, 'country', n_name, case when n_nationkey % 9 = 0 then concat('Land of ', n_name) else '' end, {_h('R', 'n_regionkey')} from {{nation}}
      union all select {_h('S', 's_suppkey')}, 'parish', s_name, '', {_h('N', 's_nationkey')} from {{supplier}}""",
    "source": f"select {_h('Q', 'p_partkey')} as handle, p_partkey as k, p_name as title, p_brand as author from {{part}}",
    "repository": f"select {_h('L', 's_suppkey')} as handle, s_name as name from {{supplier}}",
    "citation": f"""
      select concat('C', cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(l_linenumber as string)) as handle,
        {_h('EO', 'l_orderkey')} as event_handle, {_h('Q', 'l_partkey')} as source_handle, cast(l_linenumber as string) as page, cast(l_linenumber % 5 as int) as confidence
      from (select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber from {{lineitem}}) t""",
    "reporef": f"select distinct {_h('Q', 'l_partkey')} as source_handle, {_h('L', 'l_suppkey')} as ref from {{lineitem}}",
    "revisions": f"""
      select tx_id, pos, handle, row_number() over (partition by handle order by tx_id, pos) as n, count(*) over (partition by handle) as total, user_id % 5 = 0 as added, user_id % 7 = 0 as deleted, 1800000000 + event_id as stamp
      from (select event_id // 3 as tx_id, event_id % 3 as pos, user_id, event_id, {_h('P', '(2 * user_id + (event_id // 3) % 2)')} as handle from {{events}}) t
      where handle in (select handle from {{person}})""",
    "changes": """
      select event_id as tx_id, cast(user_id as bigint) as user, event_id % 40 = 39 as undo, case event_id % 5 when 0 then 'add' when 4 then 'delete' else 'update' end as action,
        case event_id % 3 when 0 then 'Person' when 1 then 'Family' else 'Event' end as class, concat('P', lpad(cast(user_id as string), 9, '0')) as handle, ts, cast(value as double) as value
      from {events}""",
}
#: The key of a citation: the columns of an item that tell it from others.
_ITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_RAW = "region nation customer supplier part orders lineitem events documents pages embeddings".split()


def sql_tables() -> str:
    """The derivation as DuckDB common table expressions, to go before an oracle query."""
    names = {**{t: t for t in _RAW}, **{t: f"d_{t}" for t in FLAT}}
    return "with recursive " + ",\n".join(f"d_{t} as ({q.format(**names)})" for t, q in FLAT.items())


def flat(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table, not nested."""
    made: dict[str, DataFrame] = {}

    def get(t: str) -> DataFrame:
        if t not in made:
            if t in FLAT:
                q = FLAT[t].replace("//", " div ")
                needs = [x for x in [*_RAW, *FLAT] if f"{{{x}}}" in q]
                made[t] = spark.sql(q, **{x: get(x) for x in needs})
                # by the size of its file alone Spark would send every person to the driver and on to all tasks
                made[t] = made[t].hint("merge") if t == "person" else made[t]
            else:
                made[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        return made[t]

    return get(name)


_stored: dict[tuple[str, str], Tree] = {}


class StoredTree(Tree):
    """A derived tree whose tables are written to a folder, and read from there, each when it is first asked for."""

    def __init__(self, made: dict[str, DataFrame], folder: str, **after: Callable[[DataFrame], DataFrame]):
        """``after`` is what becomes of a table that was read, by its name."""
        for name, value in {"_made": made, "_folder": folder, "_after": after, "_read": {}}.items():
            object.__setattr__(self, name, value)

    def __getattribute__(self, name: str):
        if name not in Tree.__dataclass_fields__:
            return object.__getattribute__(self, name)
        if name not in self._read and name in self._made:
            self._made[name].write.parquet(f"{self._folder}/{name}")
            rows = self._made[name].sparkSession.read.parquet(f"{self._folder}/{name}")
            self._read[name] = self._after.get(name, lambda df: df)(rows)
        return self._read.get(name)

    def with_tables(self, **tables: DataFrame) -> Tree:
        return _Changed(self, tables)


class _Changed(Tree):
    """A stored tree with some tables in place of its own; the others are still written when asked for."""

    def __init__(self, base: Tree, own: dict[str, DataFrame]):
        for name, value in {"_base": base, "_own": own}.items():
            object.__setattr__(self, name, value)

    def __getattribute__(self, name: str):
        if name not in Tree.__dataclass_fields__:
            return object.__getattribute__(self, name)
        return self._own[name] if name in self._own else getattr(self._base, name)

    def with_tables(self, **tables: DataFrame) -> Tree:
        return _Changed(self._base, {**self._own, **tables})


def demo_tree(spark: SparkSession, sf_dir: str) -> Tree:
    """The derived rows, nested.

    Each table is written once a session to the shared folder, when it is first asked for, and read from there,
    as a user's tree would be. Notes and media are taken as they are. The citation lists of events are gathered
    where a query looks at them, since they are the costliest part and few queries do.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        made, folder = derive_tree(spark, sf_dir, event_citations=False).tables(), shared_folder(spark, "tree")
        plain = {t: made.pop(t) for t in ("note", "media")}
        _stored[key] = StoredTree(made, folder, event=lambda e: with_citations(e, cited_events(spark, sf_dir))).with_tables(**plain)
    return _stored[key]


def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_handle, s): the keys of the items of each event, each once.

    The keys alone are shuffled, as numbers, and handles are told after. :func:`citations` and the lists of events are both
    taken from here, so a query that looks at both has one shuffle for them.
    """
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey is not null").select(*_ITEM)
    key = F.expr(_h("EO", "l_orderkey"))
    return item.repartition(key).groupBy(key.alias("event_handle")).agg(F.collect_set(F.struct(*_ITEM)).alias("s"))


def _cited(x: Column) -> Column:
    """The handle of a citation from the keys of its item."""
    return F.concat(F.lit("C"), x["l_orderkey"].cast("string"), *(y for c in _ITEM[1:] for y in (F.lit("-"), x[c].cast("string"))))


def cited_tree(spark: SparkSession, sf_dir: str) -> Tree:
    """:func:`demo_tree` for queries that look at the citations of events once: these are not written, and share the shuffle of the events' lists."""
    return demo_tree(spark, sf_dir).with_tables(citation=citations(spark, sf_dir))


def cited_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_handle, citation_list): the handles of ``citation`` by event."""
    return gathered(spark, sf_dir).select("event_handle", F.array_sort(F.filter(F.transform("s", _cited), lambda h: h.isNotNull())).alias("citation_list"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``citation`` as records, from the items that are gathered by event; items without an order have no event."""
    lost = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey is null").select(*_ITEM).distinct()
    rows = gathered(spark, sf_dir).where("event_handle is not null").select(F.inline("s")).union(lost)
    handle = _cited({c: F.col(c) for c in _ITEM})
    return rows.select(
        handle.alias("handle"), handle.alias("record_id"), F.expr(_h("Q", "l_partkey")).alias("source_handle"),
        F.col("l_linenumber").cast("string").alias("page"), (F.col("l_linenumber") % 5).cast("int").alias("confidence"))


def repository_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_handle, reporef_list): the rows of ``reporef`` by source, gathered in one shuffle of the keys."""
    key, ref = F.expr(_h("Q", "l_partkey")), lambda x: F.concat(F.lit("L"), F.lpad(x["l_suppkey"].cast("string"), 9, "0"))
    found = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").repartition(key).groupBy(key.alias("source_handle")).agg(F.collect_set(F.struct("l_suppkey")).alias("s"))
    return found.select("source_handle", F.array_sort(F.array_distinct(F.transform("s", lambda x: F.struct(ref(x).alias("ref"))))).alias("reporef_list"))


def with_citations(event: DataFrame, cited: DataFrame) -> DataFrame:
    """Events with their citation lists; where these are not looked at Spark leaves the join out."""
    rows = event.join(cited.hint("merge"), event["handle"] == cited["event_handle"], "left")
    return rows.select("handle", "record_id", "type", "date", "place", "description", F.coalesce("citation_list", F.array().cast("array<string>")).alias("citation_list"), "change")


def derive_tree(spark: SparkSession, sf_dir: str, event_citations: bool = True) -> Tree:
    """The derived rows, nested; events without their citation lists if wished so."""
    t = lambda name: flat(spark, sf_dir, name)
    date = F.struct("modifier", "quality", "d1", "m1", "y1", F.lit(False).alias("s1"), "d2", "m2", "y2", F.lit(False).alias("s2"), "text", F.lit(0).cast("bigint").alias("sortval")).cast(DATE_DDL)
    events = t("event").withColumn("date", date).withColumn("date", F.col("date").withField("sortval", sort_key(F.col("date"))))
    event = events.select(
        "handle", F.concat(F.lit("E"), F.substring("handle", 2, 30)).alias("record_id"), "type", "date",
        F.concat(F.lit("S"), F.lpad(F.col("place_no").cast("string"), 9, "0")).alias("place"), F.lit("").alias("description"), (F.col("k") + 1700000000).alias("change"))
    if event_citations:
        event = with_citations(event, cited_events(spark, sf_dir))
    refs = events.groupBy("owner_class", "owner").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "handle", "type"))).alias("refs"))
    ref_list = F.transform("refs", lambda r: F.struct(r["handle"].alias("ref"), F.when(r["type"] == "Marriage", "Family").otherwise("Primary").alias("role")))
    person, family = t("person"), t("family")
    fam_of = family.select(F.col("fk").alias("pk"), F.col("handle").alias("fh")).union(family.select("mk", "handle")).groupBy("pk").agg(F.array_sort(F.collect_list("fh")).alias("family_list"))
    own = refs.where("owner_class = 'person'").select(F.col("owner").alias("ok"), ref_list.alias("event_ref_list"))
    people = (
        person.join(own.hint("merge"), person["k"] == own["ok"], "left").join(fam_of.hint("merge"), person["k"] == fam_of["pk"], "left")
        .select(
            "handle", "record_id", "gender", F.struct("first_name", F.array(F.struct("surname")).alias("surname_list")).alias("primary_name"),
            F.lit(0).alias("birth_ref_index"), F.when(F.col("death_year").isNotNull(), 1).otherwise(-1).alias("death_ref_index"),
            F.coalesce("event_ref_list", F.array().cast("array<struct<ref:string,role:string>>")).alias("event_ref_list"),
            F.coalesce("family_list", F.array().cast("array<string>")).alias("family_list"),
            F.when(F.col("fk").isNotNull(), F.array(F.concat(F.lit("F"), F.lpad(F.col("fk").cast("string"), 9, "0")))).otherwise(F.array().cast("array<string>")).alias("parent_family_list"),
            F.array(F.concat(F.lit("T"), F.lpad(F.col("nation").cast("string"), 9, "0"))).alias("tag_list"), "private", "change",
        )
    )
    kids = person.where("fk is not null").groupBy("fk").agg(F.array_sort(F.collect_list("handle")).alias("kids")).withColumnRenamed("fk", "kk")
    wed = refs.where("owner_class = 'family'").select(F.col("owner").alias("ok"), ref_list.alias("event_ref_list"))
    families = (
        family.join(kids.hint("merge"), family["fk"] == kids["kk"], "left").join(wed.hint("merge"), family["fk"] == wed["ok"], "left")
        .select("handle", F.concat(F.lit("F"), F.substring("handle", 2, 20)).alias("record_id"), "father_handle", "mother_handle",
                F.transform("kids", lambda k: F.struct(k.alias("ref"), F.lit("Birth").alias("frel"), F.lit("Birth").alias("mrel"))).alias("child_ref_list"),
                F.coalesce("event_ref_list", F.array().cast("array<struct<ref:string,role:string>>")).alias("event_ref_list"), F.lit("Married").alias("type"), "change")
    )
    reporefs = repository_lists(spark, sf_dir)
    source = t("source")
    return Tree(
        person=people, family=families, event=event,
        place=t("place").select("handle", "handle", "title", "name", "place_type", F.when(F.col("parent").isNotNull(), F.array(F.struct(F.col("parent").alias("ref")))).otherwise(F.array().cast("array<struct<ref:string>>")).alias("placeref_list")).toDF("handle", "record_id", "title", "name", "place_type", "placeref_list"),
        source=source.join(reporefs, source["handle"] == reporefs["source_handle"], "left").select("handle", F.col("handle").alias("record_id"), "title", "author", F.coalesce("reporef_list", F.array().cast("array<struct<ref:string>>")).alias("reporef_list")),
        repository=t("repository").select("handle", F.col("handle").alias("record_id"), "name"),
        citation=t("citation").select("handle", F.col("handle").alias("record_id"), "source_handle", "page", "confidence"),
        note=spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("handle"), F.struct(F.col("text").alias("string")).alias("text")),
        media=spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("O"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("handle"), F.col("url").alias("path"), F.col("url").alias("desc"), F.lit("text/html").alias("mime")),
        tag=spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("T"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("handle"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("priority")),
    )
