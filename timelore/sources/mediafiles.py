"""A data source of media files below a folder that all executors can see (a mounted share).

    spark.dataSource.register(MediaFiles)
    spark.read.format("media_files").load("/mnt/library")

The driver lists a few folders only, until there are enough to deal out; the rest is listed by the tasks. Of a file's content
only the first and the last EDGE_BYTES are read, by seeking. Rows: files with a supported extension (`skipped` and
`error` null); symbolic links, which are not followed, and files of other kinds (`skipped`: link, other); what can't be
listed or read (`error`). Hidden files and folders and the insides of packages give no rows. A root that isn't a folder is
an error.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from timelore.functions.columns import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS

EDGE_BYTES = 65_536
#: Folders with these extensions are packages.
PACKAGES = ("app", "bundle", "fcpbundle", "framework", "imovielibrary", "photoslibrary", "rtfd", "tvlibrary")
#: So many folders are dealt out, or as many as there are.
ENOUGH_FOLDERS = 64
SCHEMA = (
    "relative_path string, path string, file_size long, modified double, file_identifier string, media_kind string, "
    "fingerprint string, content_fingerprint string, metadata_fingerprint string, skipped string, error string"
)


def extension(name: str) -> str:
    return os.path.splitext(name)[1].removeprefix(".").lower()


def edges(path: str, size: int) -> bytes:
    """The first EDGE_BYTES, and the last ones of a file that has more."""
    with open(path, "rb") as f:
        out = f.read(EDGE_BYTES)
        if size > EDGE_BYTES:
            f.seek(size - EDGE_BYTES)
            out += f.read(EDGE_BYTES)
    return out


def fingerprints(size: int, modified: float, content: bytes) -> tuple[str, str, str]:
    """SHA-256 of size, time and edges; of size and edges; of size and time, with a prefix."""
    digest = lambda b: hashlib.sha256(b).hexdigest()
    head = f"{size}|{modified!r}".encode()
    return digest(head + content), digest(f"{size}|".encode() + content), f"metadata-{digest(head)}"


@dataclass
class Folder(InputPartition):
    """A folder, with all below it or with its own files only."""

    path: str
    below: bool


def listed(path: str) -> Iterator[os.DirEntry]:
    with os.scandir(path) as found:
        yield from sorted((e for e in found if not e.name.startswith(".")), key=lambda e: e.name)


def is_folder(e: os.DirEntry) -> bool:
    return not e.is_symlink() and e.is_dir()


class MediaReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folder]:
        """Folders level by level, until there are enough; those that were listed keep their own files."""
        if not os.path.isdir(self.root):
            raise ValueError(f"not a folder: {self.root}")
        listed_here, waiting = [], [self.root]
        while waiting and len(listed_here) + len(waiting) < ENOUGH_FOLDERS:
            path = waiting.pop(0)
            try:
                inner = [e.path for e in listed(path) if is_folder(e) and extension(e.name) not in PACKAGES]
            except OSError:
                inner = []  # its task will say why
            listed_here.append(path)
            waiting += inner
        return [*(Folder(p, False) for p in listed_here), *(Folder(p, True) for p in waiting)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        waiting = [partition.path]
        while waiting:
            path = waiting.pop()
            try:
                entries = list(listed(path))
            except OSError as e:
                yield self.row(path, error=f"{path}: {e.strerror}")
                continue
            for e in entries:
                if e.is_symlink():
                    yield self.row(e.path, skipped="link")
                elif e.is_dir():
                    if partition.below and extension(e.name) not in PACKAGES:
                        waiting.append(e.path)
                else:
                    yield self.file(e)

    def row(self, path: str, **known) -> tuple:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        values = {"relative_path": os.path.relpath(path, self.root), "path": path} | known
        return tuple(values.get(n) for n in names)

    def file(self, e: os.DirEntry) -> tuple:
        kind = "video" if extension(e.name) in VIDEO_EXTENSIONS else "image" if extension(e.name) in IMAGE_EXTENSIONS else None
        if kind is None or not e.is_file():
            return self.row(e.path, skipped="other")
        try:
            s = e.stat(follow_symlinks=False)
            whole, content, metadata = fingerprints(s.st_size, s.st_mtime, edges(e.path, s.st_size))
        except OSError as bad:
            return self.row(e.path, error=f"{e.path}: {bad.strerror}")
        return self.row(e.path, file_size=s.st_size, modified=s.st_mtime, file_identifier=f"{s.st_dev}:{s.st_ino}", media_kind=kind, fingerprint=whole, content_fingerprint=content, metadata_fingerprint=metadata)


class MediaFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(os.path.abspath(self.options["path"].removeprefix("file://")))
