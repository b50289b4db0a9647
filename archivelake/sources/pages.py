"""A batch data source of pages: ``spark.read.format("archive_pages")`` over paged files and containers of many documents.

Options: ``path`` (a folder or file on any file system that pyarrow opens), ``opener`` (``module:function``, which gives a document from bytes; without it
files are containers, a document of JSON per line: path and pages with text and boxes), ``splitBytes`` (of files per task), ``pushdown`` (true where the session
has spark.sql.python.filterPushdown.enabled). The columns are path, page_index, text, boxes and n_pages;
with ``.schema(...)`` only those named are made, so a plan that asks for page numbers never builds a text. With ``pushdown`` conditions on path and page_index are
taken by the reader: pages and documents that they exclude aren't built either.

A document gives ``len``, ``text(i)`` and ``boxes(i)``; one that can't be opened has no pages and doesn't stop the others.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

PAGES = "path string, page_index int, text string, boxes array<array<double>>, n_pages int"
SPLIT = 32 << 20
#: How a condition on a value is asked.
ASKED: dict[type, Callable] = {
    D.EqualTo: lambda f: lambda x: x == f.value, D.In: lambda f: lambda x: x in f.value, D.GreaterThan: lambda f: lambda x: x > f.value, D.GreaterThanOrEqual: lambda f: lambda x: x >= f.value,
    D.LessThan: lambda f: lambda x: x < f.value, D.LessThanOrEqual: lambda f: lambda x: x <= f.value, D.StringStartsWith: lambda f: lambda x: x.startswith(f.value), D.IsNotNull: lambda f: lambda x: x is not None,
}


@dataclass
class Split(D.InputPartition):
    files: list


class Stored:
    """A document of a container."""

    def __init__(self, pages: list[dict]):
        self.pages = pages

    def __len__(self) -> int:
        return len(self.pages)

    def text(self, i: int) -> str | None:
        return self.pages[i].get("text")

    def boxes(self, i: int) -> list:
        return self.pages[i].get("boxes") or []


class Reader(D.DataSourceReader):
    def __init__(self, schema: StructType, options):
        if "path" not in options:
            raise ValueError("the pages source needs the option 'path'")
        self.columns, self.where, self.opener = schema.names, options["path"], options.get("opener")
        if unknown := set(self.columns) - {c.split()[0] for c in PAGES.split(", ")}:
            raise ValueError(f"the pages source has no column {sorted(unknown)}")
        self.split = int(options.get("splitBytes", SPLIT))
        self.asked: dict[str, list] = {"path": [], "page_index": []}

    def partitions(self) -> list[Split]:
        """Files by size, none in two tasks, about ``splitBytes`` in each."""
        own, path = fs.FileSystem.from_uri(self.where)
        info = own.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else own.get_file_info(fs.FileSelector(path, recursive=True))
        out, size = [], 0
        for i in sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
            if not out or size + i.size > self.split:
                out.append([])
                size = 0
            out[-1].append(i.path)
            size += i.size
        return [Split(files) for files in out]

    def read(self, partition: Split) -> Iterator[tuple]:
        own = fs.FileSystem.from_uri(self.where)[0]
        wants_path, wants_page = ([ASKED[type(f)](f) for f in self.asked[c]] for c in ("path", "page_index"))
        opener = None
        if self.opener:
            module, name = self.opener.split(":")
            opener = getattr(importlib.import_module(module), name)
        for at in partition.files:
            for path, document in self._documents(own, at, opener, lambda p: all(ask(p) for ask in wants_path)):
                n = len(document)
                for i in range(n):
                    if all(ask(i) for ask in wants_page):
                        yield tuple(path if c == "path" else i if c == "page_index" else n if c == "n_pages" else getattr(document, c)(i) for c in self.columns)

    @staticmethod
    def _documents(own, at: str, opener, wanted) -> Iterator[tuple]:
        if opener is None:
            with own.open_input_stream(at) as raw:
                rest = b""
                while block := raw.read(1 << 20):
                    *lines, rest = (rest + block).split(b"\n")
                    yield from ((d["path"], Stored(d["pages"])) for line in lines if line.strip() and wanted((d := json.loads(line))["path"]))
                if rest.strip() and wanted((d := json.loads(rest))["path"]):
                    yield d["path"], Stored(d["pages"])
        elif wanted(at):
            with own.open_input_stream(at) as raw:
                data = raw.read()
            try:
                document = opener(data)
            except Exception:  # noqa: BLE001 - an unreadable document must not stop the others
                return
            yield at, document


class AskingReader(Reader):
    """Spark refuses a reader with this method where its setting is off."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            if type(f) in ASKED and column in self.asked and len(f.attribute) == 1:
                self.asked[column].append(f)
            else:
                yield f


class PagesSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return (AskingReader if self.options.get("pushdown", "").lower() == "true" else Reader)(schema, self.options)
