"""The nested log as a stream: late rows, sessions, and a snapshot by buckets."""

import glob
import json
import os
from datetime import datetime, timezone

from kinframe.streaming import history, transactions


def tx(number, at, *changes, user="ann"):
    """``at`` in minutes; changes are (action, class, handle, new)."""
    rows = [{"type": a, "_class": c, "handle": h, "old": None, "new": n} for a, c, h, n in changes]
    return {"id": number, "connection": {"user": {"name": user}}, "undo": False, "timestamp": 1_700_000_000.0 + 60 * at, "changes": rows}


def put(folder, name, *rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def run(spark, folder, query, name, mode="append"):
    flat = transactions.flatten_changes(transactions.read_transactions(spark, folder, stream=True, files_a_batch=1))
    writer = query(flat).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.table(name).collect()


def add(h, n=1):
    return ("add", "Person", h, json.dumps({"n": n}))


def test_flat_in_batch_and_stream(spark, tmp_path):
    folder = str(tmp_path / "log")
    put(folder, "a.json", tx(1, 0, add("p1"), ("update", "Family", "f1", {"x": [1, 2]})), tx(2, 1))
    put(folder, "b.json", tx(3, 2.5, ("delete", "Person", "p1", None), user="bob"))
    batch = transactions.flatten_changes(transactions.read_transactions(spark, folder))
    rows = sorted(map(tuple, batch.collect()))
    assert [(r[0], r[1], r[3], r[5], r[6], r[7]) for r in rows] == [(1, 0, "ann", "add", "Person", "p1"), (1, 1, "ann", "update", "Family", "f1"), (3, 0, "bob", "delete", "Person", "p1")]
    assert json.loads(rows[1][9]) == {"x": [1, 2]} and rows[2][9] is None
    assert rows[2][2].astimezone(timezone.utc) == datetime.fromtimestamp(1_700_000_150, timezone.utc)
    assert sorted(map(tuple, run(spark, folder, lambda f: f, "flat_rows"))) == rows


def test_late_rows_are_dropped_and_sessions_close(spark, tmp_path):
    folder = str(tmp_path / "log")
    put(folder, "1.json", tx(1, 0, add("a")), tx(2, 5, add("b")))
    put(folder, "2.json", tx(3, 300, add("c")))  # moves the watermark on
    put(folder, "3.json", tx(5, 310, add("d")))  # late rows are told by the watermark of the batch before
    put(folder, "4.json", tx(4, 1, add("late")), tx(6, 900, add("e")))
    for k, name in enumerate(("1", "2", "3", "4")):
        os.utime(f"{folder}/{name}.json", (1000 + k, 1000 + k))
    windows = run(spark, folder, lambda f: history.change_windows(f, "10 minutes", late="1 hour"), "windows")
    assert sum(r.changes for r in windows) == 4  # a, b, c, d; the late row is gone and the last window is open
    sessions = run(spark, folder, lambda f: history.change_sessions(f, "30 minutes", late="1 hour"), "sessions")
    assert sorted(r.changes for r in sessions) == [2, 2]  # a and b; c and d; the last is open
    batch = transactions.flatten_changes(transactions.read_transactions(spark, folder))
    assert sorted(r.changes for r in history.change_sessions(batch, "30 minutes").collect()) == [1, 2, 3]  # a batch has no late rows


def files(folder):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/data/*/*/*.parquet")}


def state(snapshot):
    return {(r["class"], r.handle): (r.tx_id, json.loads(r.new)["n"]) for r in snapshot.read().collect()}


def test_snapshot_follows_a_stream(spark, tmp_path):
    folder, out = str(tmp_path / "log"), str(tmp_path / "snapshot")
    snapshot = transactions.BucketedSnapshot(spark, out, buckets=8, keep=2)
    stream = lambda: transactions.follow(transactions.flatten_changes(transactions.read_transactions(spark, folder, stream=True, files_a_batch=1)), snapshot, str(tmp_path / "checkpoint"))
    put(folder, "1.json", tx(1, 0, *(add(f"p{k}", k) for k in range(40))))
    stream().trigger(availableNow=True).start().awaitTermination()
    want = {("Person", f"p{k}"): (1, k) for k in range(40)}
    assert state(snapshot) == want and len(snapshot.manifest()) == 8
    before = files(out)
    put(folder, "2.json", tx(5, 1, ("update", "Person", "p3", json.dumps({"n": 33})), ("update", "Person", "p3", json.dumps({"n": 34}))))
    stream().trigger(availableNow=True).start().awaitTermination()
    want["Person", "p3"] = (5, 34)
    assert state(snapshot) == want
    new = set(files(out)) - set(before)
    assert len(new) == 1 and sum(map(os.path.getsize, new)) < sum(map(os.path.getsize, before)) / 3  # one bucket
    put(folder, "3.json", tx(7, 2, ("delete", "Person", "p3", None)), tx(4, 2, ("update", "Person", "p5", json.dumps({"n": 55}))))
    put(folder, "4.json", tx(6, 3, ("update", "Person", "p3", json.dumps({"n": 99}))), tx(2, 3, ("update", "Person", "p5", json.dumps({"n": 22}))))  # late: both came after a newer one
    stream().trigger(availableNow=True).start().awaitTermination()
    del want["Person", "p3"]
    want["Person", "p5"] = (4, 55)
    assert state(snapshot) == want
    assert len({f.split("/manifest/")[1].split("/")[0] for f in glob.glob(f"{out}/manifest/*/*.parquet")}) == 2  # old manifests and folders go


def test_replays_and_broken_batches(spark, tmp_path):
    rows = lambda *r: transactions.flatten_changes(spark.createDataFrame([json.loads(json.dumps(x)) | {"description": None, "first": None, "last": None} for x in r], transactions.TRANSACTION_DDL))
    snapshot = transactions.BucketedSnapshot(spark, str(tmp_path / "s"), buckets=4)
    assert snapshot.read().count() == 0
    one, two = rows(tx(1, 0, add("a", 1), add("b", 1))), rows(tx(2, 0, add("a", 2)))
    assert snapshot.apply(one, 0) and snapshot.apply(two, 1)
    kept = files(tmp_path / "s")
    assert snapshot.apply(one, 0) == [] == snapshot.apply(two, 1) and files(tmp_path / "s") == kept
    os.remove(glob.glob(f"{tmp_path}/s/manifest/batch=1/_SUCCESS")[0])  # as if the batch had died before its manifest
    assert state(snapshot) == {("Person", "a"): (1, 1), ("Person", "b"): (1, 1)}
    assert snapshot.apply(two, 1) and state(snapshot) == {("Person", "a"): (2, 2), ("Person", "b"): (1, 1)}
    assert snapshot.apply(two.limit(0), 2) == [] and state(snapshot) == {("Person", "a"): (2, 2), ("Person", "b"): (1, 1)}
