"""How people are related by blood, partnership, step families and marriage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.operators.graph import parent_edges, relation_label
from kinframe.plans.checkpoints import cut, fitted
from kinframe.tree import Tree

#: Kinds of relation, the nearer first where as many steps lead to a person.
KINDS = ("blood", "partner", "step", "in-law")


def couples(tree: Tree) -> DataFrame:
    """(a, b), both ways: who stand together as the parents of a family."""
    both = tree.family.where("father_handle is not null and mother_handle is not null")
    return both.select(F.col("father_handle").alias("a"), F.col("mother_handle").alias("b")).union(both.select("mother_handle", "father_handle")).where("a <> b").distinct()


def lines(parents: DataFrame, people: DataFrame, most: int) -> DataFrame:
    """(person, top, n, via): each ancestor within ``most`` generations, oneself at 0, and the child of the ancestor on the line up.

    Further columns of ``parents`` go with the step that leads to the ancestor.
    """
    more = [c for c in parents.columns if c not in ("child", "parent")]
    step = parents.select(F.col("child").alias("at"), "parent", *more)
    own = [F.lit(None).cast(step.schema[c].dataType).alias(c) for c in more]
    front = cut(people.select(F.col("handle").alias("person"), F.col("handle").alias("top"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("via"), *own))
    out = front
    for n in range(1, most + 1):
        front = cut(front.drop(*more).join(step, front["top"] == step["at"]).select("person", F.col("parent").alias("top"), F.lit(n).alias("n"), F.col("top").alias("via"), *more).distinct())
        if front.isEmpty():
            break
        out = out.union(front)
    return fitted(cut(out))


#: A way in one whole number, so that the least number is the best way: eight bits for each of these.
_FIELDS = ("steps", "kind", "up", "down", "half")


def _packed(kind: str, up: Column, down: Column, half: Column | None = None) -> Column:
    """The way up and down of a kind; all kinds but blood have one step more, across."""
    k = KINDS.index(kind)
    out = (up + down + (1 if k else 0)).cast("bigint")
    for field in (F.lit(k), up, down, half.cast("int") if half is not None else F.lit(0)):
        out = out * 256 + field.cast("bigint")
    return out


def _words(spark: SparkSession, steps: int) -> DataFrame:
    """(way, sex, relation): the word for each way of so many steps at most."""
    upto = lambda n, c: spark.range(n).select(F.col("id").cast("int").alias(c))
    rows = upto(steps + 1, "up").join(upto(steps + 1, "down").hint("broadcast"), F.col("up") + F.col("down") <= steps)
    for n, c in ((len(KINDS), "k"), (2, "half"), (3, "sex")):
        rows = rows.crossJoin(upto(n, c).hint("broadcast"))
    way = F.lit(None)
    for k, kind in enumerate(KINDS):
        way = F.when(F.col("k") == k, _packed(kind, F.col("up"), F.col("down"), F.col("half"))).otherwise(way)
    word = relation_label(F.col("up"), F.col("down"), F.col("sex"))
    partner = F.when(F.col("sex") == 0, "wife").when(F.col("sex") == 1, "husband").otherwise("partner")
    relation = (
        F.when(F.col("k") == 1, partner).when(F.col("k") == 2, F.concat(F.lit("step"), word)).when(F.col("k") == 3, F.concat(word, F.lit("-in-law")))
        .when(F.col("half") == 1, F.concat(F.lit("half-"), word)).otherwise(word)
    )
    return rows.select(way.alias("way"), F.col("sex").cast("string").alias("sex"), relation.alias("relation"))


def _within(links: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """(handle): who is within so many steps of anyone at the start."""
    near = start
    for _ in range(steps):
        near = cut(near.union(links.join(near, links["src"] == near["handle"]).select("dst")).distinct())
    return near


def kinship(tree: Tree, persons: DataFrame | None = None, steps: int = 4) -> DataFrame:
    """(a, b, relation, kind, steps, up, down): what ``b`` is to ``a``, for every pair within ``steps`` steps.

    A step goes to a parent, a child or a partner. Blood relations go ``up``
    generations to a common ancestor and ``down`` from there. Step relations have one
    step from someone on the way up, or from oneself, to a partner before the way
    down (a parent's partner, a partner's child, the child of a parent's partner). In-law
    relations are a partner's blood relatives who are not descendants, and the partners of
    blood relatives who are not ancestors. The fewest steps win, then the kind in
    the order of ``KINDS``, then the shorter way up.

    Blood relations beside the direct line are half when the two lines part at two
    children of whom each has two known parents, but only one in common, and no
    other way of as many steps has them part at full siblings.

    Lines up are made once, a join for each generation, and serve both sides. Ways straight up
    are these lines themselves. The others meet on the ancestor, each line up with those lines down alone that are short enough
    for it and not shorter than it, and where two children of the same two parents part, on the lesser of these alone.
    So a way is found in one direction and told in both; the best one of a pair is the least of whole numbers.
    ``persons`` (first column handles) limits ``a``, and the people looked at to those within reach of them.
    A person is nothing to oneself, and people without a relation within reach have no row.
    """
    if steps > 255:
        raise ValueError("at most 255 steps")
    spark, par, mates = tree.person.sparkSession, cut(parent_edges(tree)), cut(couples(tree))
    handles = tree.person.select("handle").union(par.select("child")).union(par.select("parent")).union(mates.select("a")).distinct()
    # handles go with the sex as their last letter, so that the pairs need not meet the people again
    sex = F.when(F.col("gender") == 0, "0").when(F.col("gender") == 1, "1").otherwise("2")
    marks = cut(handles.join(tree.person.select("handle", "gender"), "handle", "left").select("handle", F.concat("handle", sex).alias("marked")))
    marked = lambda df, c: df.join(marks.select(F.col("handle").alias(c), "marked"), c).withColumn(c, F.col("marked")).drop("marked")
    # beside the parent the other one, where just two are known
    other = F.when(F.size("p") == 2, F.when(F.col("p")[0] == F.col("parent"), F.col("p")[1]).otherwise(F.col("p")[0]))
    known = marked(marked(par, "child"), "parent").groupBy("child").agg(F.collect_set("parent").alias("p"))
    par = cut(known.select("child", F.explode("p").alias("parent"), "p").select("child", "parent", other.alias("other")))
    mates, people = cut(marked(marked(mates, "a"), "b").select("a", "b")), marks.select(F.col("marked").alias("handle"))
    if persons is not None:
        asked = cut(marked(persons.select(F.col(persons.columns[0]).alias("handle")).distinct(), "handle"))
        links = cut(par.select(F.col("child").alias("src"), F.col("parent").alias("dst")).union(par.select("parent", "child")).union(mates.select("a", "b")))
        people = _within(links, asked, steps)
        both = lambda df, a, b: df.join(people.select(F.col("handle").alias(a)), a, "left_semi").join(people.select(F.col("handle").alias(b)), b, "left_semi").select(df.columns)
        par, mates = cut(both(par, "child", "parent")), cut(both(mates, "a", "b"))

    n, up, down = F.col("n"), F.col("up"), F.col("down")
    way = lines(par, people, steps).where("n > 0")
    short = way.where(n < steps)
    across = short.join(mates.select(F.col("a").alias("top"), F.col("b").alias("mate")), "top").select("person", "mate", "n")
    of_mates = short.join(mates.select(F.col("a").alias("person"), F.col("b").alias("mate")), "person").select("mate", "person", "top", "n", "via", "other")

    # lines up: from oneself, from a partner, and to a partner of the ancestor
    nobody = F.lit(None).cast("string")
    line = lambda df, a, past, top, via, other, kind: df.select(F.col(a).alias("a"), past.alias("past_a"), F.col(top).alias("top"), n.alias("up"), via.alias("via_a"), other.alias("other_a"), F.lit(kind).alias("kind"))
    rise = line(way, "person", F.col("person"), "top", F.col("via"), F.col("other"), "blood").union(line(across, "person", nobody, "mate", nobody, nobody, "step"))
    rise = rise.union(line(of_mates, "mate", F.col("person"), "top", F.col("via"), F.col("other"), "in-law"))
    most = F.lit(steps) - up - F.when(F.col("kind") == "blood", 0).otherwise(1)
    least = F.when(F.col("kind") == "in-law", 1).otherwise(up)
    rise = rise.where(least <= most).withColumn("down", F.explode(F.sequence(least, most)))
    fall = short.select(F.col("person").alias("b"), "top", n.alias("down"), F.col("via").alias("via_b"), F.col("other").alias("other_b"))
    in_law, step, same = F.col("kind") == "in-law", F.col("kind") == "step", F.col("other_a") == F.col("other_b")
    parted = step | ((F.col("via_a") != F.col("via_b")) & (F.col("past_a") != F.col("b")))
    met = rise.join(fall, ["top", "down"]).where(parted & (in_law | (up < down) | (F.col("a") < F.col("b"))) & F.coalesce(~same | (F.col("top") < F.col("other_a")), F.lit(True)))
    half = F.coalesce(~same, F.lit(False))

    def told(df: DataFrame, a: str, b: str, up: Column, down: Column, kind: Column, half: Column = F.lit(False)) -> DataFrame:
        """Ways as (low, high, there, back), the lesser handle first."""
        there, back = (F.when(kind == "blood", _packed("blood", u, d, half)).when(kind == "step", _packed("step", u, d)).when(kind == "in-law", _packed("in-law", u, d)).otherwise(_packed("partner", u, d)) for u, d in ((up, down), (down, up)))
        first = F.col(a) < F.col(b)
        return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.when(first, there).otherwise(back).alias("there"), F.when(first, back).otherwise(there).alias("back"))

    zero = F.lit(0)
    ways = told(met, "a", "b", up, down, F.col("kind"), half).union(told(way, "person", "top", n, zero, F.lit("blood"))).union(told(across, "person", "mate", n, zero, F.lit("step")))
    ways = ways.union(told(of_mates.where("person <> top"), "mate", "top", n, zero, F.lit("in-law"))).union(told(mates.where("a < b"), "a", "b", zero, zero, F.lit("partner")))
    best = ways.groupBy("low", "high").agg(F.min("there").alias("there"), F.min("back").alias("back"))
    turned = F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("b"), F.col("there").alias("way")), F.struct(F.col("high").alias("a"), F.col("low").alias("b"), F.col("back").alias("way")))
    best = best.select(F.explode(turned).alias("r")).select("r.*")
    if persons is not None:
        best = best.join(asked.select(F.col("handle").alias("a")), "a", "left_semi")
    plain = lambda c: F.left(c, F.length(c) - 1).alias(c)
    best = best.withColumn("sex", F.right("b", F.lit(1))).join(F.broadcast(_words(spark, steps)), ["way", "sex"])
    field = lambda f: F.shiftright("way", 8 * (len(_FIELDS) - 1 - _FIELDS.index(f))).bitwiseAND(255).cast("int")
    return best.select(plain("a"), plain("b"), "relation", F.get(F.array(*map(F.lit, KINDS)), field("kind")).alias("kind"), *(field(f).alias(f) for f in ("steps", "up", "down")))
