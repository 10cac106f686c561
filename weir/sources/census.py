"""A data source that lists files, folders and links below a root: format `weir_census`.

    spark.dataSource.register(Census)
    spark.read.format("weir_census").option("ignore", "[\\".git\\"]").load("file:///share/tree")

The driver looks only for enough folders to share the work (`folders`, 64 by default); executors list these, each with all that
is below it. Contents are never read. Files and mounted shares are listed with their links; a link is never followed. Other stores are
listed by Arrow's file systems (hdfs, s3, gs, abfss), which know no links.

Rows: path (from the root on, with /), ext (lower case, with its dot; none for a leading dot), bytes (0 for folders and links), kind (file,
dir or link), target (of a link: from the root on where it is inside, else as the link has it; null where it is dead), dead. Files of no
length, names with blanks and empty folders are listed; a missing root is an error; what goes away meanwhile is left out.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, ext string, bytes long, kind string, target string, dead boolean"
IGNORE = (".git", "node_modules")


def _ext(name: str) -> str:
    return os.path.splitext(name)[1].lower()


class _Mounted:
    """Listing by the operating system."""

    def __init__(self, root: str):
        self.root = os.path.realpath(root)
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder: {root}")

    def entries(self, folder: str) -> Iterator[tuple]:
        try:
            found = list(os.scandir(os.path.join(self.root, folder)))
        except (FileNotFoundError, NotADirectoryError):
            return
        for e in found:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_symlink():
                    yield path, "", 0, "link", *self._target(e.path)
                elif e.is_dir(follow_symlinks=False):
                    yield path, "", 0, "dir", None, None
                elif e.is_file(follow_symlinks=False):
                    yield path, _ext(e.name), e.stat(follow_symlinks=False).st_size, "file", None, None
            except FileNotFoundError:
                continue

    def _target(self, path: str) -> tuple[str | None, bool]:
        try:
            real = os.path.realpath(path, strict=True)
        except OSError:  # nothing there, or a ring of links
            return None, True
        inside = real == self.root or real.startswith(self.root.rstrip("/") + "/")
        return (os.path.relpath(real, self.root) if inside else os.readlink(path)), False


class _Store:
    """Listing by Arrow's file systems."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.root = self.root.rstrip("/")
        if self.fs.get_file_info(self.root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder: {root}")

    def entries(self, folder: str) -> Iterator[tuple]:
        from pyarrow import fs

        base = f"{self.root}/{folder}" if folder else self.root
        for i in self.fs.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            path = f"{folder}/{i.base_name}" if folder else i.base_name
            if i.type == fs.FileType.Directory:
                yield path, "", 0, "dir", None, None
            elif i.type == fs.FileType.File:
                yield path, _ext(i.base_name), i.size, "file", None, None


def _listing(root: str):
    where = urlsplit(root)
    if where.scheme in ("", "file"):
        return _Mounted(unquote(where.path) if where.scheme else root)
    return _Store(root)


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool  # with all that is below

    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class CensusReader(DataSourceReader):
    def __init__(self, root: str, ignore: list[str], folders: int):
        self.root, self.ignore, self.folders = root, frozenset(ignore), folders

    def _below(self, listing, folder: str) -> list[str]:
        return [path for path, _, _, kind, _, _ in listing.entries(folder) if kind == "dir" and path.rsplit("/", 1)[-1] not in self.ignore]

    def partitions(self) -> list[Folder]:
        """Folders are opened, widest level first, until there are enough of them to share; an opened one is listed without what is below."""
        listing, opened, waiting = _listing(self.root), [], [""]
        while waiting and len(waiting) + len(opened) < self.folders:
            at = waiting.pop(0)
            opened.append(at)
            waiting += self._below(listing, at)
        return [Folder(p, False) for p in opened] + [Folder(p, True) for p in waiting]

    def read(self, partition: Folder) -> Iterator[tuple]:
        listing, waiting = _listing(self.root), [partition.path]
        while waiting:
            for row in listing.entries(waiting.pop()):
                if row[3] == "dir":
                    if row[0].rsplit("/", 1)[-1] in self.ignore:
                        continue
                    if partition.deep:
                        waiting.append(row[0])
                yield row


class Census(DataSource):
    """Options: path (the root), ignore (a JSON list of folder names), folders (that share the work)."""

    @classmethod
    def name(cls) -> str:
        return "weir_census"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CensusReader:
        return CensusReader(self.options["path"], json.loads(self.options.get("ignore", json.dumps(IGNORE))), int(self.options.get("folders", 64)))
