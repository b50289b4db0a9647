"""The commit log and the store: numbers given once, conflicts, snapshots beside other writers, removal, schemas, plans."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from archivelake.functions import hashing as H
from archivelake.sources.commit_log import EVERY, CommitConflict, CommitLog, applied, merged
from archivelake.sources.store import DELTA, Store


def derive(assets):
    return assets.select(F.lit("text").alias("space"), F.col("asset_id").alias("vec_id"), "asset_id", H.hash_embedding(F.col("text")).alias("embedding"))


def rows(spark, *names, text="t"):
    return spark.createDataFrame([(n, f"{text} {n}") for n in names], "asset_id string, text string").coalesce(1)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "asset_id string").coalesce(1)


def held(store, version=None):
    own = {r["asset_id"]: r["text"] for r in store.assets(version).collect()}
    assert sorted(r["asset_id"] for r in store.vectors(version).collect()) == sorted(own)
    return own


def pair(spark, tmp_path, **options):
    return Store(spark, f"file://{tmp_path}/s", derive, **options), Store(spark, f"file://{tmp_path}/s", derive, **options)


def test_a_number_is_given_once(spark, tmp_path):
    log, got = CommitLog(spark, f"file://{tmp_path}/log"), []

    def write(own):
        for i in range(6):
            got.append(log.append({"folder": f"{own}-{i}", "op": "insert", "whole": False, "vectors": False}, 0))

    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(1, 37))
    state = log.state()
    assert state["version"] == 36 and len({c["folder"] for c in state["live"]}) == 36
    assert sum(n.endswith(".checkpoint") for n in log.names()) == 36 // EVERY and not any(n.startswith(".") and not n.endswith(".crc") for n in log.names())
    assert log.put(f"{3:012d}", {}) is False
    assert log.state(25)["version"] == 25
    # entries before the last checkpoint can go, and the state stays
    assert log.clean(0) > 0 and log.state() == state
    with pytest.raises(ValueError, match="no version 25"):
        log.state(25)


def test_state_of_snapshots_in_any_order():
    entry = lambda n, **more: {"number": n, "folder": f"f{n}", "whole": False, "vectors": True, "time": 1.0} | more
    state = {"version": 0, "live": [], "gone": [], "schemas": {}}
    for e in (entry(1), entry(2), entry(3), entry(4, whole=True, of=2), entry(5, whole=True, of=3), entry(6, whole=True, of=2), entry(7)):
        state = applied(state, e)
    assert [c["folder"] for c in state["live"]] == ["f5", "f7"] and {g["folder"] for g in state["gone"]} == {"f1", "f2", "f3", "f4", "f6"}
    assert [c["folder"] for c in applied(state, entry(8, whole=True))["live"]] == ["f8"]


def test_a_snapshot_keeps_what_is_committed_meanwhile(spark, tmp_path):
    store, other = pair(spark, tmp_path)
    store.insert(rows(spark, "one", "two", "gone"))

    def meanwhile():
        other.insert(rows(spark, "three"))
        other.update(rows(spark, "two", text="new"))
        other.delete(ids(spark, "gone"))

    store.compact(meanwhile)
    want = {"one": "t one", "two": "new two", "three": "t three"}
    assert held(store) == held(other) == want
    store.compact()
    assert held(other) == want and len(store.commits()) == 1


def test_two_snapshots_at_once(spark, tmp_path):
    store, other = pair(spark, tmp_path)
    store.insert(rows(spark, "one"))

    def meanwhile():
        other.insert(rows(spark, "two"))
        other.compact()

    store.compact(meanwhile)  # shows an older version than the one that came first
    assert held(store) == {"one": "t one", "two": "t two"} and len(store.commits()) == 1
    assert store.vacuum(0) == 3 and held(store) == {"one": "t one", "two": "t two"}


def test_changes_follow_others_or_are_made_anew(spark, tmp_path, monkeypatch):
    store, other = pair(spark, tmp_path)
    store.insert(rows(spark, "a", "b"))
    tried, write = [], store._write

    def between(make):
        def own(assets, *args, **more):
            tried.append(1)
            return write(assets, *args, **(more | {"before_pointer": make if len(tried) == 1 else None}))

        tried.clear()
        monkeypatch.setattr(store, "_write", own)

    between(lambda: other.insert(rows(spark, "c")))  # touches nothing of it
    store.delete(ids(spark, "a"))
    assert len(tried) == 1 and set(held(store)) == {"b", "c"}
    between(lambda: other.insert(rows(spark, "d")))  # not there when the delete began
    store.delete(ids(spark, "d", "b"))
    assert len(tried) == 2 and set(held(store)) == {"c"}
    between(lambda: other.delete(ids(spark, "c")))
    store.update(rows(spark, "c", text="changed"))  # gone meanwhile: nothing is left to update
    assert len(tried) == 2 and held(store) == {}

    def always(assets, *args, **more):
        return write(assets, *args, **(more | {"before_pointer": lambda: other.insert(rows(spark, "e"))}))

    other.insert(rows(spark, "e"))
    monkeypatch.setattr(store, "_write", always)
    with pytest.raises(CommitConflict):
        store.delete(ids(spark, "e"))
    assert set(held(store)) == {"e"}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_plans_versions_snapshots_and_removal(spark, tmp_path):
    store, _ = pair(spark, tmp_path, compact_after=12)
    for i in range(12):
        store.insert(rows(spark, f"n{i}", "same", text=f"v{i}"))
        if i == 1:
            few = scans(store.vectors())
    assert len(store.commits()) == 12 and scans(store.assets()) == 1 and scans(store.vectors()) == few <= 3  # as many as after two commits; one may prune partitions
    assert held(store)["same"] == "v11 same" and held(store, 4) == {"n0": "v0 n0", "n1": "v1 n1", "n2": "v2 n2", "n3": "v3 n3", "same": "v3 same"}
    store.insert(rows(spark, "last"))  # one too many: a snapshot follows
    assert len(store.commits()) == 1 and len(held(store)) == 14
    assert len(held(store, 12)) == 13  # replaced files stay for readers at work
    assert store.vacuum() == 0 and store.vacuum(0) == 13
    folders = [n for n in (tmp_path / "s/assets").iterdir()]
    assert len(folders) == 1 and folders[0].name.startswith(DELTA) and len(held(store)) == 14
    assert store.recover(older_than=0) == {"abandoned": 0, "reindexed": 0}


def test_schemas_grow_and_must_agree(spark, tmp_path):
    store, _ = pair(spark, tmp_path)
    store.insert(rows(spark, "a"))
    store.insert(rows(spark, "b").withColumn("pages", F.lit(3)))
    got = {r["asset_id"]: r["pages"] for r in store.assets().collect()}
    assert got == {"a": None, "b": 3}
    with pytest.raises(ValueError, match="pages"):
        store.insert(rows(spark, "c").withColumn("pages", F.lit("three")))
        store.assets()
    field = lambda name, kind: {"name": name, "type": kind, "nullable": True, "metadata": {}}
    assert [f["type"] for f in merged({"fields": [field("x", "void")]}, {"fields": [field("x", "long"), field("y", "void")]})["fields"]] == ["long", "void"]


def test_entries_say_what_they_have_read(spark, tmp_path):
    store, other = pair(spark, tmp_path)
    store.insert(rows(spark, "a"))
    store._write(store._ready(rows(spark, "b")), "insert", False, lambda: other.insert(rows(spark, "c")))
    found = [json.loads((tmp_path / f"s/commits/{n:012d}").read_text()) for n in (1, 2, 3)]
    assert [(e["number"], e["read"]) for e in found] == [(1, 0), (2, 1), (3, 1)]
