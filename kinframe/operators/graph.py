"""Walks, closures and relationships in the family graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.plans.checkpoints import beside, cut
from kinframe.tree import Tree

MOST_GENERATIONS = 20


def parent_edges(tree: Tree) -> DataFrame:
    """(child, parent), each pair once."""
    child = tree.family.select("father_handle", "mother_handle", F.explode("child_ref_list.ref").alias("child"))
    return child.select("child", F.explode(F.array_compact(F.array("father_handle", "mother_handle"))).alias("parent")).distinct()


@dataclass(frozen=True)
class Walk:
    """nodes (root, handle, generation), edges (root, src, dst), summary (root, people, truncated, unexplored, failed)."""

    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame


def walk(parents: DataFrame, roots: DataFrame, direction: str = "ancestors", max_generations: int = 5, cap: int | None = 500, readable: DataFrame | None = None) -> Walk:
    """Breadth-first from every root at once; the root is generation 1.

    A node counts once per root, at its first level, but stands in the edges of
    all that lead to it. Before a level is taken, the nodes attempted so far
    and the level's size are held against ``cap``: if they exceed it, the whole
    level is refused for that root, edges to it go, and it counts as unexplored.
    Nodes outside ``readable`` (if given) fail: they are counted as attempted,
    and lead nowhere. The last level records no edges onwards. One join per
    level, cut to the checkpoint folder; state is spread by (root, handle).
    """
    if not 1 <= max_generations <= MOST_GENERATIONS:
        raise ValueError(f"generations must be 1 to {MOST_GENERATIONS}")
    a, b = ("child", "parent") if direction == "ancestors" else ("parent", "child")
    steps = cut(parents.select(F.col(a).alias("handle"), F.col(b).alias("dst")).distinct())
    root = roots.select(F.col(roots.columns[0]).alias("root")).distinct()
    level = cut(root.select("root", F.col("root").alias("handle")))
    state = cut(root.select("root", F.lit(0).cast("long").alias("attempted"), F.lit(False).alias("truncated"), F.lit(0).cast("long").alias("unexplored")))
    seen = nodes = edges = None
    rows = level.count()
    for generation in range(1, max_generations + 1):
        sizes = level.groupBy("root").agg(F.count("*").alias("n"))
        judged = state.join(sizes, "root", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        refuse = (F.col("attempted") + F.col("n") > cap) if cap is not None else F.lit(False)
        state = cut(judged.select(
            "root", F.when(refuse, F.col("attempted")).otherwise(F.col("attempted") + F.col("n")).alias("attempted"),
            (F.col("truncated") | refuse).alias("truncated"), (F.col("unexplored") + F.when(refuse, F.col("n")).otherwise(0)).alias("unexplored"), (refuse & (F.col("n") > 0)).alias("refused"),
        ))
        stopped = state.where("refused").select("root")
        if edges is not None and cap is not None:
            gone = level.join(stopped, "root", "left_semi").select("root", F.col("handle").alias("dst"))
            edges = edges.join(gone, ["root", "dst"], "left_anti").select("root", "src", "dst")
        level = level.join(stopped, "root", "left_anti")
        state = state.drop("refused")
        ok = level.join(readable.select(F.col(readable.columns[0]).alias("handle")).distinct(), "handle", "left_semi").select("root", "handle") if readable is not None else level
        here = level.select("root", "handle", F.lit(generation).alias("generation"))
        here = here.join(ok.withColumn("ok", F.lit(True)), ["root", "handle"], "left").select("root", "handle", "generation", F.coalesce("ok", F.lit(False)).alias("ok"))
        nodes = cut(here if nodes is None else nodes.union(here))
        seen = nodes.select("root", "handle")
        out = steps.join(beside(ok, rows), "handle").select("root", F.col("handle").alias("src"), "dst").distinct()
        following = cut(out.select("root", F.col("dst").alias("handle")).distinct().join(seen, ["root", "handle"], "left_anti"))
        if generation == max_generations:
            left = following.groupBy("root").agg(F.count("*").alias("n"))
            state = state.join(left, "root", "left").select("root", "attempted", "truncated", (F.col("unexplored") + F.coalesce("n", F.lit(0))).alias("unexplored"))
            break
        edges = cut(out if edges is None else edges.union(out))
        rows = following.count()
        if not rows:
            break
        level = following
    counts = nodes.groupBy("root").agg(F.count_if("ok").alias("people"), F.count_if(~F.col("ok")).alias("failed"))
    edges = edges if edges is not None else out.limit(0)
    return Walk(nodes.where("ok").select("root", "handle", "generation"), edges.select("root", "src", "dst"), state.join(counts, "root", "left").select("root", "people", "truncated", "unexplored", "failed"))


def closure(parents: DataFrame, depth: int = 15, start: DataFrame | None = None) -> DataFrame:
    """(descendant, ancestor, distance): the least distance of each pair, 0 for oneself; one join per level.

    A level of few rows goes to the edges, one of many is shuffled with them.
    """
    people = start.select(F.col(start.columns[0]).alias("h")).distinct() if start is not None else parents.select(F.col("child").alias("h")).union(parents.select("parent")).distinct()
    step = cut(parents.select("child", "parent").distinct())
    known = front = cut(people.select(F.col("h").alias("descendant"), F.col("h").alias("ancestor"), F.lit(0).alias("distance")))
    rows = total = front.count()
    for d in range(1, depth + 1):
        reach = step.join(beside(front, rows), front["ancestor"] == step["child"]).select("descendant", F.col("parent").alias("ancestor")).distinct()
        front = cut(reach.join(beside(known.select("descendant", "ancestor"), total), ["descendant", "ancestor"], "left_anti").withColumn("distance", F.lit(d)))
        rows = front.count()
        if not rows:
            break
        known, total = known.union(front), total + rows
    return known


def _ordinal(n: Column) -> Column:
    suffix = F.when(n % 100 == 1, "st").when(n % 10 == 1, F.when(n % 100 == 11, "th").otherwise("st")).when((n % 10 == 2) & (n % 100 != 12), "nd").when((n % 10 == 3) & (n % 100 != 13), "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def relation_label(up: Column, down: Column, gender: Column) -> Column:
    """What person 2 is to person 1, ``up`` generations from 1 to the common ancestor and ``down`` from there to 2."""
    sexed = lambda f, m, u: F.when(gender == 0, f).when(gender == 1, m).otherwise(u)
    greats = lambda n: F.repeat(F.lit("great-"), F.greatest(n, F.lit(0)))
    direct = lambda n, base: F.when(n == 1, base).otherwise(F.concat(greats(n - 2), F.lit("grand"), base))
    collateral = lambda n, base: F.when(n == 2, base).otherwise(F.concat(greats(n - 3), F.lit("grand"), base))
    near, removed = F.least(up, down) - 1, F.abs(up - down)
    cousin = F.concat(_ordinal(near), F.lit(" cousin"), F.when(removed > 0, F.concat(F.lit(" "), removed.cast("string"), F.lit(" times removed"))).otherwise(""))
    return (
        F.when((up == 0) & (down == 0), "self")
        .when(down == 0, direct(up, sexed("mother", "father", "parent")))
        .when(up == 0, direct(down, sexed("daughter", "son", "child")))
        .when((up == 1) & (down == 1), sexed("sister", "brother", "sibling"))
        .when(down == 1, collateral(up, sexed("aunt", "uncle", "aunt or uncle")))
        .when(up == 1, collateral(down, sexed("niece", "nephew", "niece or nephew")))
        .otherwise(cousin)
    )


def _common(parents: DataFrame, pairs: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, up, down, tops) for each two levels on which the pair has common ancestors, and (id, handle) of all people.

    Handles become numbers. Each person's ancestors are gathered level by level as
    one list, made of the lists of the parents' level before, so that a level moves
    once; a pair then meets the lists of both. A list has the ancestors of one person
    within ``depth`` generations, each once a level.
    """
    pairs = cut(pairs.select("a", "b").where("a is not null and b is not null").distinct())
    asked = pairs.select(F.col("a").alias("handle")).union(pairs.select("b")).distinct()
    edges = cut(parents.select("child", "parent").where("child is not null and parent is not null").distinct())
    ids = cut(cut(edges.select(F.col("child").alias("handle")).union(edges.select("parent")).union(asked).distinct()).select("handle", F.monotonically_increasing_id().alias("id")))
    number = lambda df, c: df.join(ids.select(F.col("handle").alias(c), "id").hint("merge"), c).withColumn(c, F.col("id")).drop("id")
    steps = cut(number(number(edges, "child"), "parent").select("child", "parent"))
    pairs = cut(number(number(pairs, "a"), "b").select("a", "b"))
    # who is met on the way up from the asked: the others' lists are of no use
    met = new = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    rows = total = new.count()
    for _ in range(depth):
        above = steps.join(beside(new, rows), new["id"] == steps["child"]).select(F.col("parent").alias("id")).distinct()
        new = cut(above.join(beside(met, total), "id", "left_anti"))
        rows = new.count()
        if not rows:
            break
        met, total = met.union(new), total + rows
    met = cut(met)
    steps = cut(steps.join(met.select(F.col("id").alias("child")).hint("merge"), "child", "left_semi").select("child", "parent"))
    level = cut(met.select("id", F.array("id").alias("tops")))
    levels = level.select("id", F.lit(0).alias("n"), "tops")
    for n in range(1, depth + 1):
        lists = steps.join(level.hint("merge"), steps["parent"] == level["id"]).groupBy("child").agg(F.collect_list("tops").alias("tops"))
        level = cut(lists.select(F.col("child").alias("id"), F.array_distinct(F.flatten("tops")).alias("tops")))
        if level.isEmpty():
            break
        levels = levels.union(level.select("id", F.lit(n).alias("n"), "tops"))
    lists = cut(levels.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "tops")))["tops"].alias("tops")))
    side = lambda c: lists.select(F.col("id").alias(c), F.col("tops").alias(f"tops_{c}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap(F.flatten("tops_a"), F.flatten("tops_b")))
    found = both.select("a", "b", "tops_b", F.posexplode("tops_a").alias("up", "of_a")).select("a", "b", "up", "of_a", F.posexplode("tops_b").alias("down", "of_b"))
    return found.select("a", "b", "up", "down", F.array_intersect("of_a", "of_b").alias("tops")).where(F.size("tops") > 0), ids


def _handles(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(ids.select(F.col("id").alias(c), F.col("handle").alias(f"{c}_handle")).hint("merge"), c).withColumn(c, F.col(f"{c}_handle")).drop(f"{c}_handle")
    return df


def nearest(parents: DataFrame, pairs: DataFrame, depth: int = 15) -> DataFrame:
    """(a, b, up, down, ancestors): the most direct way alone by which two persons are related, the shorter way up first."""
    found, ids = _common(parents, pairs, depth)
    best = found.groupBy("a", "b").agg(F.min_by(F.struct("up", "down", "tops"), F.struct(F.col("up") + F.col("down"), F.col("up"))).alias("r"))
    rows = _handles(best.select("a", "b", "r.up", "r.down", F.explode("r.tops").alias("top")), ids, "top", "a", "b")
    return rows.groupBy("a", "b", "up", "down").agg(F.array_sort(F.collect_set("top")).alias("ancestors"))


def relationships(parents: DataFrame, pairs: DataFrame, depth: int = 15) -> DataFrame:
    """(a, b, up, down, ancestors): each way two persons are related through nearest common ancestors, by distances.

    Common ancestors beyond a nearer common one on the same line (an ancestor's
    own ancestors at one more generation on both sides) are left out.
    """
    found, ids = _common(parents, pairs, depth)
    both = found.select("a", "b", F.explode("tops").alias("ancestor"), "up", "down").groupBy("a", "b", "ancestor").agg(F.min("up").alias("up"), F.min("down").alias("down"))
    both = cut(_handles(both, ids, "ancestor", "a", "b").select("a", "b", "ancestor", "up", "down"))
    step = parents.select(F.col("child").alias("ancestor"), F.col("parent")).distinct()
    above = both.join(step.hint("merge"), "ancestor").select("a", "b", F.col("parent").alias("ancestor"), (F.col("up") + 1).alias("up"), (F.col("down") + 1).alias("down")).distinct()
    ways = both.join(above.hint("merge"), ["a", "b", "ancestor", "up", "down"], "left_anti")
    return ways.groupBy("a", "b", "up", "down").agg(F.array_sort(F.collect_set("ancestor")).alias("ancestors"))


def relationship(parents: DataFrame, pairs: DataFrame, people: DataFrame, depth: int = 15, partners: DataFrame | None = None) -> DataFrame:
    """(a, b, relation, up, down): the most direct relation of each pair; -1 and null where there is none within ``depth``.

    Siblings of whom each has two known parents, but only one in common, are half.
    ``partners`` (a, b; both ways) makes couples wife and husband, unless one is the
    other's parent. Step and in-law relations are told by ``kinship.kinship``.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    best = nearest(parents, pairs, depth).select("a", "b", F.struct((F.col("up") + F.col("down")).alias("sum"), "up", "down", F.size("ancestors").alias("common")).alias("r"))
    known = cut(parents.select("child", "parent").distinct().groupBy("child").agg(F.count("*").alias("n")))
    out = pairs.join(best.hint("merge"), ["a", "b"], "left").join(people.select(F.col("handle").alias("b"), "gender").hint("merge"), "b", "left")
    for side in ("a", "b"):
        out = out.join(known.select(F.col("child").alias(side), F.col("n").alias(f"n_{side}")).hint("merge"), side, "left")
    couple = F.lit(False)
    if partners is not None:
        out = out.join(partners.select("a", "b", F.lit(True).alias("couple")).distinct().hint("merge"), ["a", "b"], "left")
        couple = F.coalesce("couple", F.lit(False)) & F.coalesce(F.col("r.sum") > 1, F.lit(True))
    blood = relation_label(F.col("r.up"), F.col("r.down"), F.col("gender"))
    half = (F.col("r.up") == 1) & (F.col("r.down") == 1) & (F.col("r.common") == 1) & (F.col("n_a") == 2) & (F.col("n_b") == 2)
    word = F.when(F.col("gender") == 0, "wife").when(F.col("gender") == 1, "husband").otherwise("partner")
    relation = F.when(couple, word).when(half, F.concat(F.lit("half-"), blood)).otherwise(blood)
    return out.select("a", "b", relation.alias("relation"), F.coalesce("r.up", F.lit(-1)).alias("up"), F.coalesce("r.down", F.lit(-1)).alias("down"))


def branch(tree: Tree, person: str, kind: str, depth: int = MOST_GENERATIONS) -> DataFrame:
    """Handles of a branch: Ancestors, Descendants (both with the person), DescendantFamilies, or CommonAncestor (people sharing any ancestor)."""
    parents, spark = cut(parent_edges(tree)), tree.person.sparkSession
    start = spark.range(1).select(F.lit(person).alias("h"))
    if kind == "Ancestors":
        return closure(parents, depth, start).select(F.col("ancestor").alias("handle"))
    down = parents.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    if kind == "Descendants":
        return closure(down, depth, start).select(F.col("ancestor").alias("handle"))
    if kind == "DescendantFamilies":
        people = closure(down, depth, start).select(F.col("ancestor").alias("p"))
        pairs = tree.family.select("handle", F.explode(F.array_compact(F.array("father_handle", "mother_handle"))).alias("p"))
        return pairs.join(people, "p", "left_semi").select("handle").distinct()
    if kind == "CommonAncestor":
        top = closure(parents, depth, start).select("ancestor")
        return closure(down, depth, top).select(F.col("ancestor").alias("handle")).distinct()
    raise ValueError(f"unknown branch {kind}")


def tree_lines(walked: Walk, sibling_order: DataFrame | None = None) -> DataFrame:
    """(root, line, handle, generation, repeat): the walk as an indented listing, depth first.

    A node's full listing stands at its first place in depth-first order, which
    in an acyclic graph is its least position path; other edges to it give a
    repeat line whose subtree is left out. Least paths are relaxed level by
    level; positions are zero-padded ranks among siblings. Siblings stand in the
    order of ``sibling_order`` (handle, place), those without a place last, then by
    handle; of several places of a handle the least counts.
    """
    from pyspark.sql import Window

    edges = walked.edges.withColumn("place", F.lit(0))
    if sibling_order is not None:
        edges = walked.edges.join(sibling_order.groupBy(F.col("handle").alias("dst")).agg(F.min("place").alias("place")), "dst", "left")
    order = F.row_number().over(Window.partitionBy("root", "src").orderBy(F.col("place").asc_nulls_last(), "dst"))
    step = cut(edges.select("root", "src", "dst", F.lpad(order.cast("string"), 6, "0").alias("pos")))
    best = cut(walked.nodes.where("handle = root").select("root", "handle", F.array(F.lit("000001")).alias("path"), F.array("handle").alias("line")))
    while True:
        grown = best.join(step, (best["root"] == step["root"]) & (best["handle"] == step["src"])).where(~F.array_contains("line", F.col("dst"))).select(
            best["root"], F.col("dst").alias("handle"), F.concat("path", F.array("pos")).alias("path"), F.concat("line", F.array("dst")).alias("line"))
        joined = best.union(grown).groupBy("root", "handle").agg(F.min(F.struct("path", "line")).alias("m")).select("root", "handle", "m.path", "m.line")
        joined = cut(joined)
        changed = joined.join(best, ["root", "handle", "path"], "left_anti")
        best = joined
        if changed.isEmpty():
            break
    top = best.where("handle = root").select("root", "handle", "path", F.lit(False).alias("repeat"))
    lines = step.join(best.select("root", F.col("handle").alias("src"), F.col("path").alias("up")), ["root", "src"]).withColumn("path", F.concat("up", F.array("pos")))
    lines = lines.join(best.select("root", F.col("handle").alias("dst"), F.col("path").alias("own")), ["root", "dst"], "left")
    rows = top.union(lines.select("root", "dst", "path", (F.col("own") != F.col("path")).alias("repeat")))
    return rows.select("root", F.row_number().over(Window.partitionBy("root").orderBy("path")).alias("line"), "handle", F.size("path").alias("generation"), "repeat")
