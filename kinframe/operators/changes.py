"""Batch changes: an old snapshot and change rows give a new snapshot, refusals and log rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.operators.references import REFERENCES, edges
from kinframe.plans.checkpoints import cut
from kinframe.tree import Tree


def merge_lists(existing: Column, incoming: Column, element: T.DataType) -> Column:
    """Union of two lists, the existing first.

    Items with a ``ref`` are told apart by it and strings by value, both against
    the existing list alone: repeats inside the incoming list stay. Items without
    ``ref`` are told apart by whole content, within the incoming list too. An
    empty existing list takes refs and strings as they come.
    """
    old, new = F.coalesce(existing, F.array().cast(T.ArrayType(element))), F.coalesce(incoming, F.array().cast(T.ArrayType(element)))
    if isinstance(element, T.StructType) and "ref" in element.names:
        more = F.filter(new, lambda x: ~F.exists(old, lambda y: y["ref"].eqNullSafe(x["ref"])))
        return F.concat(old, F.when(F.size(old) == 0, new).otherwise(more))
    if isinstance(element, T.StructType):
        return F.concat(old, F.array_except(new, old))
    return F.concat(old, F.filter(new, lambda x: ~F.array_contains(old, x)))


def upsert(df: DataFrame, changes: DataFrame, replace_lists: Sequence[str] = ()) -> DataFrame:
    """New snapshot: mentioned fields replace, ``*_list`` fields unite, all else stays.

    ``changes`` has ``handle``, some of the record's columns, and ``present``, the
    array of fields a row mentions (null alone does not tell). A list named in
    ``replace_lists`` is replaced, so an empty one clears it. New handles are
    added. One change per handle; several fail the job, as the caller must say which
    of them counts.
    """
    unknown = set(replace_lists) - {c for c in df.columns if c.endswith("_list")}
    if unknown:
        raise ValueError(f"not lists of the record: {', '.join(sorted(unknown))}")
    new = changes.select(F.col("handle").alias("__h"), *(F.col(c).alias(f"__new_{c}") for c in changes.columns if c in df.columns and c != "handle"), F.col("present").alias("__present"))
    once = new.groupBy("__h").agg(F.count("*").alias("__n"), F.first(F.struct(*(c for c in new.columns if c != "__h"))).alias("__c"))
    single = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("several changes of "), F.col("__h")))).otherwise(F.col("__h"))
    new = once.select(single.alias("__h"), "__c.*")
    joined = df.join(new, df["handle"] == new["__h"], "full_outer")
    out = [F.coalesce(df["handle"], F.col("__h")).alias("handle")]
    for f in df.schema.fields:
        if f.name == "handle":
            continue
        if f"__new_{f.name}" not in new.columns:
            out.append(df[f.name])
            continue
        value = F.col(f"__new_{f.name}")
        if f.name.endswith("_list") and isinstance(f.dataType, T.ArrayType) and f.name not in replace_lists:
            value = F.when(df[f.name].isNull(), value).otherwise(merge_lists(df[f.name], value, f.dataType.elementType))
        out.append(F.when(F.array_contains("__present", F.lit(f.name)), value).otherwise(df[f.name]).alias(f.name))
    return joined.select(*out)


def guarded_delete(tree: Tree, kind: str, targets: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new table, refusals): records others refer to stay unless ``force``.

    Refusals have (handle, referrers, first): the count and the first 20
    referrers as type:handle; with ``force`` they list what was severed.
    """
    wanted = targets.select(F.col(targets.columns[0]).alias("dst")).distinct()
    links = edges(tree).where(F.col("dst_type") == kind).join(wanted, "dst", "left_semi").select("dst", F.concat_ws(":", "src_type", "src").alias("by")).distinct()
    refusals = links.groupBy("dst").agg(F.count("*").alias("referrers"), F.slice(F.array_sort(F.collect_set("by")), 1, 20).alias("first")).withColumnRenamed("dst", "handle")
    gone = wanted if force else wanted.join(refusals.select(F.col("handle").alias("dst")), "dst", "left_anti")
    table = tree.tables()[kind]
    return table.join(gone.withColumnRenamed("dst", "handle"), "handle", "left_anti"), refusals


def detach(df: DataFrame, field: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new table, errors): take one reference out of one list of each target (handle, ref).

    A missing record, list or element is an error row with its reason. Several
    references may go from one record.
    """
    element = df.schema[field].dataType.elementType
    key = (lambda x: x["ref"]) if isinstance(element, T.StructType) else (lambda x: x)
    rows = targets.select("handle", "ref").distinct()
    out = rows.groupBy("handle").agg(F.collect_set("ref").alias("__refs"))
    kept = df.join(out, "handle", "left")
    new = kept.withColumn(field, F.when(F.col("__refs").isNull(), F.col(field)).otherwise(F.filter(field, lambda x: ~F.array_contains("__refs", key(x)))))
    there = df.select("handle", F.col(field).alias("__list"))
    errors = rows.join(there.withColumn("__known", F.lit(True)), "handle", "left").select("handle", "ref", (
        F.when(F.col("__known").isNull(), "no such record").when(F.coalesce(F.size("__list"), F.lit(0)) <= 0, "list is empty")
        .when(~F.exists("__list", lambda x: key(x) == F.col("ref")), "no such element").alias("reason"))).where("reason is not null")
    return new.select(*df.columns), errors


def merge_records(tree: Tree, kind: str, pairs: DataFrame) -> tuple[Tree, DataFrame]:
    """(new tree, mapping): absorbed records vanish and every reference to them points to the survivor.

    ``pairs`` has (survivor, absorbed). Chains are followed to their end; a
    record absorbed into itself, twice, or in a ring is an error. The survivor's
    lists unite with those of what it absorbs.
    """
    if kind == "tag":
        raise ValueError("tags cannot be merged")
    step = cut(pairs.select(F.col("absorbed").alias("old"), F.col("survivor").alias("new")).distinct())
    if not step.where("old = new").isEmpty() or not step.groupBy("old").count().where("count > 1").isEmpty():
        raise ValueError("a record cannot be absorbed into itself or twice")
    mapping, nxt = step, step.select(F.col("old").alias("new"), F.col("new").alias("then"))
    for _ in range(64):
        mapping = cut(mapping.join(nxt, "new", "left").select("old", F.coalesce("then", "new").alias("new")))
        if not mapping.where("old = new").isEmpty():
            raise ValueError("the merges form a ring")
        if mapping.join(nxt, "new", "left_semi").isEmpty():
            break
        nxt = mapping.select(F.col("old").alias("new"), F.col("new").alias("then"))
    tables = {}
    for name, df in tree.tables().items():
        for src, field, shape, dst in REFERENCES:
            if src == name and dst == kind and field in df.columns:
                df = _repoint(df, field, shape, mapping)
        if name == kind:
            df = _absorb(df, mapping)
        tables[name] = df
    return tree.with_tables(**tables), mapping


def _repoint(df: DataFrame, field: str, shape: str, mapping: DataFrame) -> DataFrame:
    if shape == "handle":
        m = mapping.select(F.col("old").alias(field), F.col("new").alias("__new"))
        return df.join(m, field, "left").withColumn(field, F.coalesce("__new", field)).select(*df.columns)
    refs = df.select("handle", F.explode(F.col(f"{field}.ref") if shape == "refs" else F.col(field)).alias("old"))
    moved = refs.join(mapping, "old").groupBy("handle").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("old", "new")))).alias("__moved"))
    at = (lambda x: x.withField("ref", F.coalesce(F.try_element_at("__moved", x["ref"]), x["ref"]))) if shape == "refs" else (lambda x: F.coalesce(F.try_element_at("__moved", x), x))
    return df.join(moved, "handle", "left").withColumn(field, F.when(F.col("__moved").isNull(), F.col(field)).otherwise(F.array_distinct(F.transform(field, at)))).select(*df.columns)


def _absorb(df: DataFrame, mapping: DataFrame) -> DataFrame:
    gone = df.join(mapping.withColumnRenamed("old", "handle"), "handle")
    lists = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    extra = gone.groupBy("new").agg(F.lit(1).alias("__one"), *(F.flatten(F.collect_list(f.name)).alias(f"__more_{f.name}") for f in lists)).withColumnRenamed("new", "handle")
    kept = df.join(mapping.select(F.col("old").alias("handle")), "handle", "left_anti").join(extra, "handle", "left")
    united = {f.name: F.when(F.col("__one").isNull(), F.col(f.name)).otherwise(merge_lists(F.col(f.name), F.col(f"__more_{f.name}"), f.dataType.elementType)) for f in lists}
    return kept.withColumns(united).select(*df.columns)


def undo(current: DataFrame, log: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(inverse rows, conflicts) of log rows (handle, action, old, new), objects as JSON strings.

    A row conflicts when the record no longer is what the change made it (for a
    delete: when it is there again); ``force`` undoes it all the same. Inverse of
    add is delete, of delete is add, of update the old object. JSON is compared
    by value, not by spelling.
    """
    now = current.select("handle", F.col("json").alias("now"))
    same = lambda a, b: F.to_json(F.try_parse_json(a)).eqNullSafe(F.to_json(F.try_parse_json(b)))
    rows = log.join(now, "handle", "left").withColumn("conflict", ~F.when(F.col("action") == "delete", F.col("now").isNull()).otherwise(same(F.col("now"), F.col("new"))))
    inverse = F.when(F.col("action") == "add", "delete").when(F.col("action") == "delete", "add").otherwise("update")
    take = rows if force else rows.where("not conflict")
    return take.select("handle", inverse.alias("action"), F.col("new").alias("old"), F.col("old").alias("new")), rows.where("conflict").select("handle", "action")


def undo_transactions(tree: Tree, log: DataFrame, transactions: DataFrame, force: bool = False) -> tuple[Tree, DataFrame, DataFrame]:
    """(new tree, conflicts, inverse) of undoing whole transactions together.

    ``log`` is every change there was (tx_id, pos, class, handle, old, new; objects as JSON, null where
    the record was not there); ``transactions`` has their ids in its first column. All their
    changes of one record come down to one step back: from the ``new`` of the last to the
    ``old`` of the first. Objects are read by the schema of their class's table, so
    that a record is compared by value, spelling and absent fields aside.

    ``conflicts`` (class, handle, reason): "changed since" where the record is not what the last of the changes
    made it, "changed between" where another transaction changed it in between, "unreadable" where
    an object is no record of its class. They are told before anything is
    made: unless ``force``, one conflict leaves the whole tree as it is. Unreadable objects
    stop it even then. ``inverse`` has the log rows (class, handle, action, old, new) of what was done.
    Work is by aggregation and joins, so a record with very many changes is
    no group in one task.
    """
    ids = transactions.select(F.col(transactions.columns[0]).alias("tx_id")).distinct()
    marked = log.join(ids.withColumn("taken", F.lit(True)), "tx_id", "left").withColumn("at", F.struct("tx_id", "pos"))
    taken = marked.where("taken").groupBy("class", "handle").agg(
        F.min("at").alias("from"), F.max("at").alias("to"), F.min_by(F.struct("old"), "at").alias("first"), F.max_by(F.struct("new"), "at").alias("last"))
    steps = cut(taken.select("class", "handle", "from", "to", F.col("first.old").alias("old"), F.col("last.new").alias("new")))
    inside = marked.where("taken is null").select("class", "handle", "at").join(steps.select("class", "handle", "from", "to"), ["class", "handle"])
    between = inside.where((F.col("at") > F.col("from")) & (F.col("at") < F.col("to"))).select("class", "handle").distinct().withColumn("between", F.lit(True))
    steps = steps.join(between, ["class", "handle"], "left")
    tables, judged, back = tree.tables(), [], {}
    kinds = sorted(r[0].lower() for r in steps.select("class").distinct().collect())  # of ten at most
    if unknown := set(kinds) - set(tables):
        raise ValueError(f"the tree has no tables of {', '.join(sorted(unknown))}")
    if not kinds:
        return tree, log.select("class", "handle", F.lit("").alias("reason")).limit(0), log.select("class", "handle", F.lit("").alias("action"), "old", "new").limit(0)
    for kind in kinds:
        df = tables[kind]
        mine = steps.where(F.lower("class") == kind)
        read = lambda c: F.from_json(F.col(c), df.schema)  # noqa: B023, E731
        odd = lambda c: F.col(c).isNotNull() & (F.col(f"{c}_rec").isNull() | F.coalesce(F.size(F.array_except(F.json_object_keys(c), F.array(*map(F.lit, df.columns)))) > 0, F.lit(True)) | ~F.col(f"{c}_rec.handle").eqNullSafe(F.col("handle")))  # noqa: B023, E731
        now = df.select("handle", F.struct(*df.columns).alias("now"))
        rows = mine.withColumns({"old_rec": read("old"), "new_rec": read("new")}).join(now, "handle", "left")
        reason = F.when(odd("old") | odd("new"), "unreadable").when(~F.col("now").eqNullSafe(F.col("new_rec")), "changed since").when(F.col("between"), "changed between")
        back[kind] = cut(rows.withColumn("reason", reason))
        judged.append(back[kind].where("reason is not null").select("class", "handle", "reason"))
    conflicts = reduce(DataFrame.union, judged)
    barred = conflicts.where("reason = 'unreadable'") if force else conflicts
    if not barred.isEmpty():
        return tree, conflicts, log.select("class", "handle", F.lit("").alias("action"), "old", "new").limit(0)
    inverse = []
    for kind in kinds:
        df = tables[kind]
        kept = df.join(back[kind].select("handle"), "handle", "left_anti").select(*df.columns)
        tables[kind] = kept.union(back[kind].where("old is not null").select("old_rec.*").select(*df.columns))
        action = F.when(F.col("old").isNull(), "delete").when(F.col("now").isNull(), "add").otherwise("update")
        was = F.when(F.col("now").isNotNull(), F.to_json("now"))
        inverse.append(back[kind].where("now is not null or old is not null").select("class", "handle", action.alias("action"), was.alias("old"), F.col("old").alias("new")))
    return tree.with_tables(**tables), conflicts, reduce(DataFrame.union, inverse)


def validate(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): ``rules`` are (message, Column that must hold); rejected rows carry all messages in ``reasons``."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), message) for message, ok in rules)))
    judged = rows.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def sourced_events(tree: Tree, rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Sources, citations and events wired together from rows (row_id, source_handle, source_title, page, type, place).

    A row names a source by handle or by new title, exactly one of them; an
    unknown handle, and a title that is taken, are refused before anything is
    made. Handles of new records are digests of the row, so a repeated run makes
    the same ones. Rows of one new title share the source.
    """
    has = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    known = tree.source.select(F.col("handle").alias("source_handle"), F.lit(True).alias("known"))
    taken = tree.source.select(F.col("title").alias("source_title"), F.lit(True).alias("taken")).distinct()
    r = rows.join(known, "source_handle", "left").join(taken, "source_title", "left")
    reason = F.when(has("source_handle") == has("source_title"), "needs a source handle or a title, not both").when(has("source_handle") & F.col("known").isNull(), "no such source").when(has("source_title") & F.col("taken").isNotNull(), "title exists")
    judged = r.withColumn("reason", reason)
    ok = judged.where("reason is null").withColumn("source", F.when(has("source_handle"), F.col("source_handle")).otherwise(F.sha2(F.concat(F.lit("source|"), "source_title"), 256).substr(1, 32)))
    ok = ok.withColumn("citation", F.sha2(F.concat(F.lit("citation|"), F.col("row_id").cast("string")), 256).substr(1, 32)).withColumn("event", F.sha2(F.concat(F.lit("event|"), F.col("row_id").cast("string")), 256).substr(1, 32))
    made = {
        "source": ok.where(has("source_title")).select(F.col("source").alias("handle"), F.col("source_title").alias("title")).distinct(),
        "citation": ok.select(F.col("citation").alias("handle"), F.col("source").alias("source_handle"), "page"),
        "event": ok.select(F.col("event").alias("handle"), "type", "place", F.array("citation").alias("citation_list")),
    }
    return made, judged.where("reason is not null").select("row_id", "reason")
