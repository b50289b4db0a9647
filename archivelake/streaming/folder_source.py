"""A streaming source of the new and edited files of a folder, in bounded batches.

A file is (path, size, modified): with another size or time it is a new one, so edits are seen, which Spark's own file stream, which knows paths only,
misses. Nothing is opened here; whoever takes a batch reads its files, and files that are as before are neither read, hashed nor decoded again.

The offset is a batch's number. What a batch holds lies in the source's log, beside the stream's checkpoint: one file per batch and now and then a snapshot
of all files seen, so a restarted stream plans the same batch again and goes on from there. Folder and log may lie on any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Batches from one snapshot of the log to the next; batch files before the last two snapshots are removed.
EVERY = 20


@dataclass
class Files(InputPartition):
    rows: list


class Log:
    """Batches of files that a stream has planned, in a folder."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path, recursive=True)

    def _names(self, kind: str) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(self.path))
        return sorted(int(i.base_name.split(".")[0]) for i in found if i.base_name.endswith(kind))

    def _read(self, name: str):
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def _write(self, name: str, body) -> None:
        """Seen with all its text or not at all."""
        aside = f"{self.path}/{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(body).encode())
        self.fs.move(aside, f"{self.path}/{name}")

    def last(self) -> int:
        return max(self._names(".batch"), default=0)

    def batch(self, number: int) -> list:
        return self._read(f"{number:012d}.batch")

    def seen(self) -> dict[str, list]:
        """Size and time of each file as last planned."""
        base = max(self._names(".seen"), default=0)
        out = self._read(f"{base:012d}.seen") if base else {}
        for n in self._names(".batch"):
            if n > base:
                out |= {path: [size, at] for path, size, at in self.batch(n)}
        return out

    def add(self, rows: list, seen: dict[str, list]) -> int:
        number = self.last() + 1
        self._write(f"{number:012d}.batch", rows)
        if number % EVERY == 0:
            self._write(f"{number:012d}.seen", seen | {path: [size, at] for path, size, at in rows})
            for kind, before in ((".batch", number - 2 * EVERY), (".seen", number - EVERY)):
                for n in self._names(kind):
                    if n <= before:
                        self.fs.delete_file(f"{self.path}/{n:012d}{kind}")
        return number


def listed(uri: str, extensions: set[str]) -> Iterator[tuple[str, int, int]]:
    """(path, size, nanoseconds) of the files below a folder, or of one file."""
    own, path = fs.FileSystem.from_uri(uri)
    prefix = "" if isinstance(own, fs.LocalFileSystem) else uri[: uri.index(path)] if path in uri else ""
    info = own.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else own.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    for i in found:
        hidden = any(p.startswith((".", "_")) for p in i.path[len(path) :].split("/"))
        if i.type == fs.FileType.File and (i.path == path or (not hidden and i.base_name.rpartition(".")[2].lower() in extensions)):
            yield prefix + i.path, i.size, i.mtime_ns or 0


class Reader(DataSourceStreamReader):
    def __init__(self, options):
        for name in ("path", "log"):
            if name not in options:
                raise ValueError(f"the folder stream needs the option {name!r}")
        self.folder, self.log_at = options["path"], options["log"]
        self.most, self.settle = int(options.get("filesPerBatch", 1000)), float(options.get("settleSeconds", 0.5))
        self.tasks = max(1, int(options.get("tasks", 8)))
        self.extensions = set(options.get("extensions", "").lower().split(","))

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        """Plan one more batch if there is something: the oldest changes first; files changed just now may still be written and wait."""
        log = Log(self.log_at)
        seen, limit = log.seen(), time.time_ns() - int(self.settle * 1e9)
        rows = sorted((at, path, size) for path, size, at in listed(self.folder, self.extensions) if at <= limit and seen.get(path) != [size, at])[: self.most]
        return {"batch": log.add([[path, size, at] for at, path, size in rows], seen) if rows else log.last()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        log = Log(self.log_at)
        rows = {r[0]: r for n in range(start["batch"] + 1, end["batch"] + 1) for r in log.batch(n)}
        rows = list(rows.values())
        return [Files(rows[i :: self.tasks]) for i in range(min(self.tasks, len(rows)))]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size, at in partition.rows:
            yield path, size, at


class FolderSource(DataSource):
    """``path``: the folder, ``log``: where planned batches are kept, ``filesPerBatch``, ``settleSeconds``, ``extensions`` (by commas), ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return "archive_folder"

    def schema(self) -> str:
        return "path string, size bigint, modified_ns bigint"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Reader(self.options)
