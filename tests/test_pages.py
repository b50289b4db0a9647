"""The pages source: columns and pages that nobody asks for aren't built; awkward containers; the bench's memory."""

import json
import os

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains, StringStartsWith
from pyspark.sql.types import _parse_datatype_string

import bench
from archivelake.sources import pages as P

BUILT = []


class Paper:
    def __init__(self, n):
        self.n = n

    def __len__(self):
        return self.n

    def text(self, i):
        BUILT.append(("text", i))
        return f"text {i}"

    def boxes(self, i):
        BUILT.append(("boxes", i))
        return [[0.0, 0.0, 1.0, float(i)]]


def paper(data):
    """Of test files: as many pages as they have letters."""
    if data == b"broken":
        raise ValueError("broken")
    return Paper(len(data))


def rows(folder, schema, filters=(), **options):
    BUILT.clear()
    own = P.AskingReader(_parse_datatype_string(schema), {"path": f"file://{folder}", **options})
    left = list(own.pushFilters(list(filters)))
    parts = own.partitions()
    return sorted((r for p in parts for r in own.read(p)), key=str), left, len(parts)


def test_only_what_is_asked_for_is_built(spark, tmp_path):
    for name, data in (("a.doc", b"xxx"), ("b.doc", b"xx"), ("bad.doc", b"broken"), ("_hidden", b"x")):
        (tmp_path / name).write_bytes(data)
    a, b = str(tmp_path / "a.doc"), str(tmp_path / "b.doc")
    opener = {"opener": f"{__name__}:paper"}
    got, _, parts = rows(tmp_path, "path string, page_index int, n_pages int", **opener)
    assert got == [(a, 0, 3), (a, 1, 3), (a, 2, 3), (b, 0, 2), (b, 1, 2)] and not BUILT and parts == 1
    got, _, parts = rows(tmp_path, "text string, page_index int", splitBytes=4, **opener)
    assert len(got) == 5 and {k for k, _ in BUILT} == {"text"} and parts == 3
    got, left, _ = rows(tmp_path, "boxes array<array<double>>, path string", [EqualTo(("path",), a), GreaterThanOrEqual(("page_index",), 1), LessThan(("page_index",), 2), StringContains(("text",), "x")], **opener)
    assert got == [([[0.0, 0.0, 1.0, 1.0]], a)] and BUILT == [("boxes", 1)] and [type(f).__name__ for f in left] == ["StringContains"]
    assert rows(tmp_path, "page_index int", [In(("path",), (b, "x")), StringStartsWith(("path",), str(tmp_path))], **opener)[0] == [(0,), (1,)]
    with pytest.raises(ValueError, match="other"):
        rows(tmp_path, "other int")
    with pytest.raises(ValueError, match="path"):
        P.Reader(_parse_datatype_string("path string"), {})


def test_containers_in_a_plan(spark, tmp_path):
    long = "é" * 700_000  # lines longer than what is read at a time
    docs = [{"path": f"/d{i}", "pages": [{"text": f"t{i}{j}", "boxes": [[1, 2, 3, 4]] * j} for j in range(i)]} for i in range(5)] + [{"path": "/long", "pages": [{"text": long}, {"boxes": None, "text": None}]}]
    for k in range(2):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(json.dumps(d, ensure_ascii=k == 0) for d in docs[k::2]) + "\n" * (1 - k) + "\n" * (1 - k))
    spark.dataSource.register(P.PagesSource)
    load = lambda schema, **more: spark.read.format("archive_pages").schema(schema).options(path=f"file://{tmp_path}", **more).load()
    every = load(P.PAGES)
    assert sorted((r["path"], r["page_index"], r["text"], len(r["boxes"])) for r in every.collect()) == sorted((d["path"], j, p.get("text"), len(p.get("boxes") or [])) for d in docs for j, p in enumerate(d["pages"]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = load("path string, page_index int, text string", pushdown="true").where("path in ('/d3', '/d4') and page_index >= 2")
        assert sorted(tuple(r) for r in some.collect()) == [("/d3", 2, "t32"), ("/d4", 2, "t42"), ("/d4", 3, "t43")]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_memory_of_all_processes(spark):
    pids = bench.family(os.getpid())
    now = bench.used_mb(pids)
    assert len(pids) >= 2 and now["jvm"] > 100 and now["python"] > 20
    peak = bench.Peak(0.05)
    peak.start()
    spark.range(1000).count()
    peak.over.wait(0.5)
    peak.over.set()
    assert peak.most["all"] >= peak.most["jvm"] > 100
