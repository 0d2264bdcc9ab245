"""Folder trees as rows: a walk by tasks, one round for each depth.

The folders of a round are rows. Tasks list them and give the files that are asked for,
with size and time of change but unopened, and the folders to enter next; those that
are excluded or skipped are cut where they are listed. The driver knows the roots, and
how many folders a round has. Every round is written to the shared folder, so a lost
executor costs its own listings.

A link to a folder that it is in (or that one above is in) isn't entered; folders are
known by device and inode. Folders that can't be read have no entries.
"""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspur.runtime import ensure_importable, written

ENTRY = "path string, is_folder boolean, mtime bigint, size bigint"
_KINDS = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("mtime", pa.int64()), ("size", pa.int64())])
#: Folders that one task lists, about.
FOLDERS = 200


def is_env(name: str) -> bool:
    return name == ".env" or name.startswith(".env.") or (name.endswith(".env") and len(name.encode()) > 4)


def compiled(patterns: Iterable[str]) -> list[re.Pattern]:
    """Those that can be compiled; the others are left out with a warning."""
    out = []
    for p in patterns:
        try:
            out.append(re.compile(p))
        except re.error:
            warnings.warn(f"not a pattern, left out: {p!r}", stacklevel=3)
    return out


def ancestors(path: str) -> Iterator[str]:
    """A path and all folders above it."""
    while path and path != "/":
        yield path
        path = path.rpartition("/")[0]


class Wanted:
    """What a walk looks for: file names, and what it leaves out. Excluded folders are a set that
    a path's ancestors are looked up in, so their number doesn't matter."""

    def __init__(self, name: Callable[[str], bool], skipped: Iterable[str], folders: Iterable[str], patterns: Iterable[str], follow_links: bool):
        self.name, self.skipped, self.folders = name, frozenset(skipped), frozenset(f.rstrip("/") for f in folders)
        self.patterns, self.follow_links = compiled(patterns), follow_links

    def is_out(self, path: str) -> bool:
        return any(p in self.folders for p in ancestors(path))

    def enters(self, folder: str, entry: os.DirEntry) -> bool:
        if entry.name in self.skipped or f"{folder}/{entry.name}" in self.folders:
            return False
        if not entry.is_symlink():
            return True
        return self.follow_links and not is_above(entry, folder)

    def takes(self, folder: str, entry: os.DirEntry) -> bool:
        path = f"{folder}/{entry.name}"
        return self.name(entry.name) and path not in self.folders and not any(p.search(path) for p in self.patterns) and (self.follow_links or not entry.is_symlink())


def is_above(link: os.DirEntry, folder: str) -> bool:
    """Whether a link leads to the folder that it is in, or to one above."""
    try:
        to = os.stat(link.path)
        above = os.path.realpath(folder)
        while True:
            own = os.stat(above)
            if (own.st_dev, own.st_ino) == (to.st_dev, to.st_ino):
                return True
            if above == "/":
                return False
            above = os.path.dirname(above)
    except OSError:
        return True


def listed(folder: str, wanted: Wanted) -> Iterator[tuple]:
    """(path, is_folder, mtime, size) of what is wanted in one folder."""
    try:
        entries = list(os.scandir(folder))
    except OSError:
        return
    for entry in entries:
        try:
            is_folder = entry.is_dir()
        except OSError:
            is_folder = False
        if is_folder:
            if wanted.enters(folder, entry):
                yield f"{folder}/{entry.name}", True, None, None
        elif wanted.takes(folder, entry):
            try:
                info = entry.stat()
                yield f"{folder}/{entry.name}", False, int(info.st_mtime), info.st_size
            except OSError:  # a link that leads nowhere
                yield f"{folder}/{entry.name}", False, None, None


def _lists(wanted: Wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(listed(folder, wanted))
                columns = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KINDS, strict=True)], schema=_KINDS)

    return run


def walk(
    spark: SparkSession, roots: Iterable[str], max_depth: int, name: Callable[[str], bool] = is_env, skipped: Iterable[str] = (),
    folders: Iterable[str] = (), patterns: Iterable[str] = (), follow_links: bool = True,
) -> DataFrame:
    """(path, mtime, size) of the files below the roots whose names are asked for; none is opened.
    A file that is below several roots comes once for each."""
    ensure_importable(spark)
    wanted = Wanted(name, skipped, folders, patterns, follow_links)
    roots = [r.rstrip("/") for r in roots]
    roots = [(r,) for r in dict.fromkeys(roots) if os.path.isdir(r) and not wanted.is_out(r)]
    files = spark.createDataFrame([], "path string, mtime bigint, size bigint")
    front, n, depth = spark.createDataFrame(roots, "path string"), len(roots), 0
    while n:
        # dealt out by path, so that the folders of one large folder are listed by many tasks
        found = written(front.repartition(max(1, -(-n // FOLDERS)), "path").mapInArrow(_lists(wanted), ENTRY), "folders")
        files = files.unionByName(found.where("not is_folder").select("path", "mtime", "size"))
        depth += 1
        front = found.where("is_folder").select("path")
        n = front.count() if depth < max_depth else 0
    return files
