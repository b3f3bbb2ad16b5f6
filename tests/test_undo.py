"""Undoing whole transactions."""

import json

import pytest

from kinframe.operators.changes import undo_transactions
from kinframe.tree import Tree

PERSON = "handle string, name string, refs array<struct<ref:string>>"


def person(handle, name, *refs):
    return (handle, name, [(r,) for r in refs])


def js(p, **more):
    return None if p is None else json.dumps({"handle": p[0], "name": p[1], "refs": [{"ref": r[0]} for r in p[2]]} | more)


def run(spark, now, log, txs, **kw):
    t = Tree(person=spark.createDataFrame(now, PERSON), tag=spark.createDataFrame([("t", "x")], "handle string, name string"))
    rows = spark.createDataFrame(log, "tx_id long, pos int, class string, handle string, old string, new string").repartition(3)
    new, conflicts, inverse = undo_transactions(t, rows, spark.createDataFrame([(x,) for x in txs], "tx_id long"), **kw)
    return {r.handle: (r.name, [x.ref for x in r.refs]) for r in new.person.collect()}, {(r.handle, r.reason) for r in conflicts.collect()}, {(r.handle, r.action, r.new) for r in inverse.collect()}


def test_undo(spark):
    a0, a1, a2, b1, c0 = person("a", "zero"), person("a", "one", "x"), person("a", "two", "x", "y"), person("b", "new"), person("c", "gone")
    log = [(1, 0, "Person", "a", js(a0), js(a1)), (1, 1, "Person", "a", js(a1), js(a2)), (1, 2, "Person", "b", None, js(b1)), (3, 0, "Person", "c", js(c0), None), (2, 0, "Person", "d", None, js(person("d", "stays")))]
    now = [a2, b1, person("d", "stays"), person("e", "never")]
    rest = {"d": ("stays", []), "e": ("never", [])}
    got, conflicts, inverse = run(spark, now, log, [1, 3])
    assert got == rest | {"a": ("zero", []), "c": ("gone", [])} and not conflicts
    assert inverse == {("a", "update", js(a0)), ("b", "delete", None), ("c", "add", js(c0))}
    assert run(spark, now, log, [3, 3])[0] == rest | {"a": ("two", ["x", "y"]), "b": ("new", []), "c": ("gone", [])}
    assert run(spark, now, log, [77])[0] == rest | {"a": ("two", ["x", "y"]), "b": ("new", [])}


def test_conflicts_come_first(spark):
    v = [person("a", str(k)) for k in range(4)]
    log = [(k, 0, "Person", "a", js(v[k - 1]), js(v[k])) for k in (1, 2, 3)] + [(1, 1, "Person", "b", None, js(person("b", "x")))]
    now = [v[3], person("b", "x")]
    whole = {"a": ("3", []), "b": ("x", [])}
    assert run(spark, now, log, [1]) == (whole, {("a", "changed since")}, set())
    assert run(spark, now, log, [1, 3]) == (whole, {("a", "changed between")}, set())
    assert run(spark, now, log, [1, 2, 3])[0] == {"a": ("0", [])}
    forced = run(spark, now, log, [1], force=True)
    assert forced[0] == {"a": ("0", [])} and forced[1] == {("a", "changed since")}
    typo = [(1, 0, "Person", "a", js(v[0], typo=1), js(v[3])), (2, 0, "Person", "b", "not json", js(person("b", "x"))), (3, 0, "Person", "b", js(person("z", "y")), js(person("b", "x")))]
    for tx, h in ((1, "a"), (2, "b"), (3, "b")):
        assert run(spark, now, typo, [tx], force=True) == (whole, {(h, "unreadable")}, set())
    spelled = [(5, 0, "Person", "b", None, '{"name" : "x", "handle":"b","refs":[]}')]
    assert run(spark, now, spelled, [5])[0] == {"a": ("3", [])}
    with pytest.raises(ValueError):
        run(spark, now, [(1, 0, "Place", "a", None, None)], [1])


def test_undo_is_the_inverse(spark):
    """Many records, very many changes of one: undoing all gives the first state."""
    log = [(k, 0, "Person", "hot", js(person("hot", str(k - 1))), js(person("hot", str(k)))) for k in range(1, 400)] + [(k, 1, "Person", f"p{k}", js(person(f"p{k}", "old", "r")), js(person(f"p{k}", "new"))) for k in range(1, 60)]
    now = [person("hot", "399")] + [person(f"p{k}", "new") for k in range(1, 60)]
    got, conflicts, _ = run(spark, now, log, list(range(1, 400)))
    assert not conflicts and got == {"hot": ("0", [])} | {f"p{k}": ("old", ["r"]) for k in range(1, 60)}
