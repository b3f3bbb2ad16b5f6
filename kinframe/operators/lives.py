"""When people were born and died, as far as records bound it, with the record each bound came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions.dates import sort_key
from kinframe.operators.references import close_kin, vital_events
from kinframe.plans.checkpoints import cut
from kinframe.tree import Tree

#: What a bound or an estimate rests on; where two bounds are equal, the earlier one stands.
RULES = ("birth", "death", "parent", "child", "sibling", "spouse", "age")
#: Hops over which bounds travel at most; data without cycles come to rest sooner.
MOST_HOPS = 40


def _year(date: str) -> Column:
    return F.when(sort_key(F.col(date)) > 0, F.col(f"{date}.y1"))


def vital_years(tree: Tree) -> DataFrame:
    """(handle, born, born_event, died, died_event, ended): years of the dated vital events and their events.

    Without a dated death event the first dated burial or cremation stands for it.
    ``ended`` says that there is a death, burial or cremation, dated or not.
    """
    v = vital_events(tree).select("handle", _year("birth_date").alias("born"), "birth", _year("death_date").alias("died"), "death")
    laid = tree.event.where(F.lower("type").isin("burial", "cremation")).select(F.col("handle").alias("event"), _year("date").alias("year"))
    own = tree.person.select("handle", F.explode("event_ref_list.ref").alias("event")).join(laid, "event")
    own = own.groupBy("handle").agg(F.min(F.when(F.col("year").isNotNull(), F.struct("year", "event"))).alias("laid"), F.lit(True).alias("buried"))
    return v.join(own, "handle", "left").select(
        "handle", "born", F.when(F.col("born").isNotNull(), F.col("birth")).alias("born_event"), F.coalesce("died", "laid.year").alias("died"),
        F.when(F.col("died").isNotNull(), F.col("death")).otherwise(F.col("laid.event")).alias("died_event"), (F.col("death").isNotNull() | F.coalesce("buried", F.lit(False))).alias("ended"),
    )


def _bound(key: Column, rule: str, witness: str | Column) -> Column:
    """A bound as a struct whose least value is the tightest: its key, its rule's place, its witness."""
    witness = F.col(witness) if isinstance(witness, str) else witness
    return F.when(key.isNotNull(), F.struct(key.cast("int").alias("key"), F.lit(RULES.index(rule)).alias("rule"), witness.alias("witness")))


def _tightest(bounds: list[Column]) -> Column:
    return reduce(lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.least(a, b)), bounds)


def birth_bounds(tree: Tree, max_age: int = 110, sibling_diff: int = 20, gap: int = 20, years: DataFrame | None = None) -> DataFrame:
    """(handle, low, low_rule, low_witness, high, high_rule, high_witness): the years between which each person was born.

    A dated birth is both bounds. Else a dated death or burial gives its year as the
    latest and ``max_age`` years before as the earliest; children come ``gap`` years after a
    parent at least; siblings lie within ``sibling_diff`` years. Every bound carries the event
    it came from through all hops. What dated people tell is joined once; among people
    without a date bounds are narrowed until nothing changes, one join a round. Equal
    bounds go by rule, then by witness. Where records contradict each other low is above
    high; in a circle of parents narrowing ends after ``MOST_HOPS`` rounds.
    """
    v = years if years is not None else cut(vital_years(tree))
    own = v.select(
        "handle", F.col("born").isNotNull().alias("fixed"),
        F.when(F.col("born").isNotNull(), _bound(-F.col("born"), "birth", "born_event")).otherwise(_bound(max_age - F.col("died"), "death", "died_event")).alias("low"),
        F.when(F.col("born").isNotNull(), _bound(F.col("born"), "birth", "born_event")).otherwise(_bound(F.col("died"), "death", "died_event")).alias("high"),
    )
    own = cut(own)
    open_ = own.where("not fixed").select(F.col("handle").alias("person"), F.col("low").alias("own_low"), F.col("high").alias("own_high"))
    kin = cut(close_kin(tree).where("relation <> 'spouse'").join(open_.select("person"), "person", "left_semi"))

    def told(state: DataFrame) -> DataFrame:
        """(person, low, high): the tightest bounds that kin with these bounds give."""
        met = kin.join(state.select(F.col("handle").alias("kin"), "low", "high"), "kin")
        is_, moved = (lambda r: F.col("relation") == r), (lambda side, rule, by: _bound(F.col(f"{side}.key") + by, rule, F.col(f"{side}.witness")))
        low = F.when(is_("parent"), moved("low", "parent", -gap)).when(is_("sibling"), moved("low", "sibling", sibling_diff))
        high = F.when(is_("child"), moved("high", "child", -gap)).when(is_("sibling"), moved("high", "sibling", sibling_diff))
        return met.groupBy("person").agg(F.min(low).alias("low"), F.min(high).alias("high"))

    fixed = told(own.where("fixed")).toDF("person", "fix_low", "fix_high")
    base = open_.join(fixed, "person", "left").select(
        "person", _tightest([F.col("own_low"), F.col("fix_low")]).alias("base_low"), _tightest([F.col("own_high"), F.col("fix_high")]).alias("base_high"))
    base = cut(base)
    state = base.select(F.col("person").alias("handle"), F.col("base_low").alias("low"), F.col("base_high").alias("high"))
    for _ in range(MOST_HOPS):
        new = base.join(told(state), "person", "left").select(
            F.col("person").alias("handle"), _tightest([F.col("base_low"), F.col("low")]).alias("low"), _tightest([F.col("base_high"), F.col("high")]).alias("high"))
        new = cut(new)
        was = state.select(F.col("handle").alias("was"), F.col("low").alias("was_low"), F.col("high").alias("was_high"))
        changed = new.join(was, new["handle"] == was["was"]).where(~(F.col("low").eqNullSafe(F.col("was_low")) & F.col("high").eqNullSafe(F.col("was_high"))))
        state = new
        if changed.isEmpty():
            break
    rule = lambda side: F.get(F.array(*map(F.lit, RULES)), F.col(f"{side}.rule"))
    rows = own.where("fixed").select("handle", "low", "high").union(state.select("handle", "low", "high"))
    return rows.select(
        "handle", (-F.col("low.key")).alias("low"), rule("low").alias("low_rule"), F.col("low.witness").alias("low_witness"),
        F.col("high.key").alias("high"), rule("high").alias("high_rule"), F.col("high.witness").alias("high_witness"),
    )


def estimates(tree: Tree, max_age: int = 110, sibling_diff: int = 20, gap: int = 20) -> DataFrame:
    """(handle, birth_year, birth_rule, birth_witness, death_year, death_rule, death_witness, low, high, ended) of every person.

    Birth, the first that gives a year: the own dated birth; the own death less
    ``max_age``; the earliest dated birth of a sibling less ``sibling_diff``; of a child less
    ``gap``; the latest of a parent plus ``gap``; the earliest of a spouse. Then the year is brought
    within :func:`birth_bounds`, taking over the bound's rule and witness where it moves;
    where no rule gives one, a bound of farther kin does, the upper one first. Death: the
    own dated death or burial; else, of a person without, the birth year plus ``max_age`` by rule
    "age" with the birth's witness. A witness is the handle of the event behind the year.
    """
    v = cut(vital_years(tree))
    bounds = birth_bounds(tree, max_age, sibling_diff, gap, v)
    of_kin = close_kin(tree).join(v.where("born is not null").select(F.col("handle").alias("kin"), "born", "born_event"), "kin")
    first = lambda r: F.min(F.when(F.col("relation") == r, F.struct(F.col("born").alias("year"), F.col("born_event").alias("event"))))
    last = F.min(F.when(F.col("relation") == "parent", F.struct((-F.col("born")).alias("year"), F.col("born_event").alias("event"))))
    near = of_kin.groupBy(F.col("person").alias("handle")).agg(first("sibling").alias("sib"), first("child").alias("kid"), last.alias("par"), first("spouse").alias("mate"))
    rows = v.join(near, "handle", "left").join(bounds, "handle", "left")
    given = [
        _bound(F.col("born"), "birth", "born_event"), _bound(F.col("died") - max_age, "death", "died_event"), _bound(F.col("sib.year") - sibling_diff, "sibling", F.col("sib.event")),
        _bound(F.col("kid.year") - gap, "child", F.col("kid.event")), _bound(gap - F.col("par.year"), "parent", F.col("par.event")), _bound(F.col("mate.year"), "spouse", F.col("mate.event")),
    ]
    at = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.col(side).alias("key"), F.array_position(F.array(*map(F.lit, RULES)), F.col(f"{side}_rule")).cast("int") - 1, F.col(f"{side}_witness")))
    kind = "struct<key:int,rule:int,witness:string>"
    raw, low, high = F.coalesce(*given).cast(kind), at("low").cast(kind), at("high").cast(kind)
    rows = rows.select("handle", "died", "died_event", "ended", "low", "high", raw.alias("raw"), low.alias("at_low"), high.alias("at_high"))
    narrowed = (
        F.when(F.col("raw").isNull(), F.coalesce("at_high", "at_low")).when(F.col("raw.rule") == 0, F.col("raw"))
        .when(F.col("raw.key") > F.col("high"), F.col("at_high")).when(F.col("raw.key") < F.col("low"), F.col("at_low")).otherwise(F.col("raw"))
    )
    rows = rows.withColumn("birth", narrowed)
    name = lambda c: F.get(F.array(*map(F.lit, RULES)), F.col(f"{c}.rule"))
    by_age = F.col("died").isNull() & F.col("birth").isNotNull()
    return rows.select(
        "handle", F.col("birth.key").alias("birth_year"), name("birth").alias("birth_rule"), F.col("birth.witness").alias("birth_witness"),
        F.coalesce("died", F.col("birth.key") + max_age).alias("death_year"), F.when(F.col("died").isNotNull(), "death").when(by_age, "age").alias("death_rule"),
        F.coalesce("died_event", F.when(by_age, F.col("birth.witness"))).alias("death_witness"), "low", "high", "ended",
    )
