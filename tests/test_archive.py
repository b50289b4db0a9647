"""The folder stream and what stands on it, jobs, uploads, odd ids, questions without matches."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from archivelake import models
from archivelake.archive import Archive
from archivelake.operators import search
from archivelake.operators.tables import kept, scope
from archivelake.sources import scan
from archivelake.streaming import folder_source
from test_engine import noise, pages_reader, png

PICTURE = [png(noise(i), 48, 48, 6) for i in range(6)]


def put(folder, name, data, age=10.0):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    at = time.time() - age
    os.utime(path, (at, at))
    return path


def reader(folder, log, **more):
    return folder_source.Reader({"path": f"file://{folder}", "log": f"file://{log}", "extensions": "png,pdf", **{k: str(v) for k, v in more.items()}})


def batch(own, start, end):
    return sorted(os.path.basename(r[0]) for p in own.partitions(start, end) for r in own.read(p))


def test_offsets_see_edits_and_go_on_after_a_restart(tmp_path, monkeypatch):
    folder, log = tmp_path / "in", tmp_path / "log"
    for i in range(5):
        put(folder, f"d{i % 2}/f{i}.PNG", b"x" * i, age=100 - i)
    put(folder, "_hidden/a.png", b"1")
    put(folder, "b.txt", b"1")
    own = reader(folder, log, filesPerBatch=2, tasks=3)
    at = [own.initialOffset()]
    while (now := own.latestOffset()) != at[-1]:
        at.append(now)
    assert [batch(own, a, z) for a, z in zip(at, at[1:])] == [["f0.PNG", "f1.PNG"], ["f2.PNG", "f3.PNG"], ["f4.PNG"]]  # oldest first
    put(folder, "d0/f2.PNG", b"other", age=5)
    put(folder, "new.png", b"n", age=0)  # may still be written
    again = reader(folder, log, filesPerBatch=2)
    assert batch(again, at[-1], again.latestOffset()) == ["f2.PNG"]
    assert batch(again, at[1], at[2]) == ["f2.PNG", "f3.PNG"]  # a batch is planned the same again
    put(folder, "new.png", b"n", age=2)
    assert batch(again, {"batch": 4}, again.latestOffset()) == ["new.png"] and again.latestOffset() == {"batch": 5}
    monkeypatch.setattr(folder_source, "EVERY", 2)
    for i in range(9):
        put(folder, "new.png", b"n" * i, age=3)
        again.latestOffset()
    names = sorted(os.listdir(log))
    assert sum(n.endswith(".seen") for n in names) <= 2 and sum(n.endswith(".batch") for n in names) <= 5
    assert len(json.loads((log / [n for n in names if n.endswith(".seen")][-1]).read_text())) == 6
    one = reader(folder / "b.txt", tmp_path / "log1")  # a single file is taken whatever its name
    assert batch(one, {"batch": 0}, one.latestOffset()) == ["b.txt"]
    with pytest.raises(ValueError, match="log"):
        folder_source.Reader({"path": "x"})


def until(true, seconds=120):
    end = time.time() + seconds
    while not true():
        assert time.time() < end, "took too long"
        time.sleep(0.3)


def test_watch_indexes_edits_only_goes_on_and_reports_failure(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    put(folder, "a.png", PICTURE[0])
    put(folder, "sub/b.png", PICTURE[1])
    own, taken, index = Archive(spark, f"file://{tmp_path}/archive"), [], Archive.index

    def counted(self, where, *args, **more):
        taken.append(sorted(os.path.basename(p) for p in where))
        return index(self, where, *args, **more)

    monkeypatch.setattr(Archive, "index", counted)
    own.watch(f"file://{folder}", 0.2)
    assert own.watching
    until(lambda: own.watch_status()["files"] == 2)
    before = own.asset(str(folder / "a.png"))["sha256"]
    put(folder, "a.png", PICTURE[2], age=1)
    until(lambda: own.watch_status()["files"] == 3)
    assert taken == [["a.png", "b.png"], ["a.png"]] and own.asset(str(folder / "a.png"))["sha256"] != before
    assert own.watch_status()["stats"] == {"indexed": 2, "updated": 1}
    own.unwatch()
    assert not own.watching
    again = Archive(spark, f"file://{tmp_path}/archive")
    put(folder, "c.png", PICTURE[3], age=1)
    again.watch(f"file://{folder}", 0.2)
    until(lambda: again.watch_status()["files"] == 1)
    assert taken[2:] == [["c.png"]]

    def broken(*_, **__):
        raise RuntimeError("no more room")

    monkeypatch.setattr(Archive, "index", broken)
    put(folder, "d.png", PICTURE[4], age=1)
    until(lambda: not again.watching)
    assert "no more room" in again.watch_status()["error"]
    monkeypatch.setattr(Archive, "index", counted)
    again.watch(f"file://{folder}", 0.2)  # the batch that failed comes again
    until(lambda: again.watch_status()["files"] == 1)
    again.unwatch()
    assert taken[3:] == [["d.png"]] and again.stats()["assets"] == 4
    assert not [n for n in os.listdir(tmp_path / "archive") if n.startswith("kept")]


def test_reindex_takes_indexed_files_that_exist_and_no_others(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "a[1].png", PICTURE[0])
    put(folder, "sub/b.png", PICTURE[1])
    gone = put(folder, "sub/deep/c.png", PICTURE[2])
    own = Archive(spark, f"file://{tmp_path}/archive")
    assert own.index(f"file://{folder}")["processed"] == 3
    gone.unlink()
    put(folder, "sub/never.png", PICTURE[3])
    assert own.reindex_all() == {"processed": 2, "files": 2, "batches": 1}
    assert own.asset(str(folder / "sub/never.png")) is None
    assert scan.outermost(["/a/b", "/a", "/ab", "/a/c/d", "/b/x/"]) == ["/a", "/ab", "/b/x"]


def test_uploads_and_single_files_of_any_name(spark, tmp_path):
    own = Archive(spark, f"file://{tmp_path}/archive")
    assert own.process("picture", PICTURE[0])["stats"] == {"indexed": 1}
    odd = put(tmp_path, "note.xyz", b"no picture")
    assert own.index(f"file://{odd}")["stats"] == {"indexed": 1}
    assert scan.files(spark, f"file://{odd}").count() == 1 and scan.files(spark, f"file://{tmp_path}").where("path like '%note%'").count() == 0


def test_ids_with_a_number_sign(spark, tmp_path):
    folder = tmp_path / "in"
    names = [str(put(folder, n, PICTURE[i])) for i, n in enumerate(("a#b.png", "a", "a#p1", "doc#1.pdf"))]
    put(folder, "doc#1.pdf", b"Some text that stands on the first page of it|0")
    own = Archive(spark, f"file://{tmp_path}/archive", reader=pages_reader())
    own.index([f"file://{n}" for n in names])
    assert own._document(f"{names[3]}#p0") == names[3] and own._document(names[2]) == names[2]
    own.delete(names[0])
    assert own.asset(names[0]) is None and own.asset(names[1]) is not None
    own.delete(f"{names[3]}#p0")
    assert own.asset(names[3]) is None and own.stats()["assets"] == 2


def test_questions_with_page_text_and_without_matches(spark, tmp_path):
    folder = tmp_path / "in"
    text = "The harbour master counts the boats every morning before the tide turns."
    put(folder, "doc.pdf", f"{text}|0".encode())
    own = Archive(spark, f"file://{tmp_path}/archive", reader=pages_reader())
    empty = own.ask("what boats", lambda: lambda q, c: f"{q}? {c}").first()
    assert empty["answer"] == "what boats? (no matching items)" and empty["sources"] == []
    own.index(f"file://{folder}")
    found = own.ask("harbour master boats", lambda: lambda q, c: c).first()
    assert found["context"] == found["answer"] and found["context"].endswith(text) and found["sources"][0].endswith("doc.pdf#p0")
    assert search.NOTHING not in found["context"]


def test_a_running_job_shows_its_progress(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(4):
        put(folder, f"{i}.png", PICTURE[i])
    own = Archive(spark, f"file://{tmp_path}/archive", models.Models(scene=models.Model(lambda: lambda p: time.sleep(0.5) or "Caption: slow", "slow")))
    name, seen = own.start(lambda a: a.index(f"file://{folder}")), []
    while own.status(name)["state"] == "running":
        seen.append(own.status(name))
        time.sleep(0.1)
    assert own.status(name)["state"] == "done" and own.status(name)["processed"] == 4
    done = [s["tasks_done"] for s in seen]
    assert done == sorted(done) and len(set(done)) > 3 and done[-1] <= own.status(name)["tasks_done"]
    stages = list(dict.fromkeys(s.get("stage") for s in seen if s.get("stage")))
    assert stages[0] == "scan" and "vlm" in stages and any(s.get("total") == 4 for s in seen)


def test_kept_tables_go_with_their_scope(spark):
    with scope():
        outer = kept(spark.range(3))
        with scope():
            inner = kept(outer.where("id > 0"))
            assert inner.count() == 2
        at = inner.inputFiles()[0].removeprefix("file:").replace("//", "/")
        assert not os.path.exists(at) and outer.count() == 3
    assert kept(spark.range(2)).agg(F.sum("id")).first()[0] == 1


def test_shapes_of_recognised_text():
    blocks = models.text_blocks
    assert blocks([{"rec_texts": ["a", "", 7]}, {"other": 1}, None]) == ["a", "7"]
    assert blocks([[[[0, 0], ("north", 0.9)], None, "x", [[1, 1]], [[2, 2], ("", 0.1)], [[3, 3], "y"]]]) == ["north"]
    assert blocks(None) == blocks([]) == []
