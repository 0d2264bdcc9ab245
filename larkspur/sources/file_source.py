"""Files as a data source of Spark: ``spark.read.format("larkspur_files").load(folder)``.

Rows are (path, text, mtime, size); names that start with a dot are read like
others. Filters on path, mtime and size are decided by what the listing says, before
any file is opened; a schema without ``text`` opens none. Files are dealt into
partitions by size. Options: ``max_bytes``, ``max_depth``, ``follow_links``,
``names`` (``env`` or ``all``), and ``partition_bytes``.

The listing is made by the planning process, folder by folder; ``sources/tree.py`` has a walk by tasks for
trees that are too large for that. Binary and too large files have no row, like files
that are gone when they are opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from larkspur.operators import summaries
from larkspur.runtime import ensure_importable
from larkspur.sources import files, tree

NAME = "larkspur_files"
SCHEMA = "path string, text string, mtime bigint, size bigint"
KINDS = {"path": pa.string(), "text": pa.string(), "mtime": pa.int64(), "size": pa.int64()}
PARTITION_BYTES = 32 * 2**20
#: What a file counts for at least when files are dealt out.
OPEN_COST = 2**16
COMPARED = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


def decidable(f: Filter) -> bool:
    """Whether a listing alone decides a filter."""
    if isinstance(f, Not):
        return decidable(f.child)
    return (type(f) in COMPARED or isinstance(f, IsNotNull)) and f.attribute in (("path",), ("mtime",), ("size",))


def meets(f: Filter, row: dict) -> bool:
    if isinstance(f, Not):
        return not meets(f.child, row)
    x = row[f.attribute[0]]
    return x is not None if isinstance(f, IsNotNull) else COMPARED[type(f)](x, f.value)


@dataclass
class Files(InputPartition):
    """(path, mtime, size) of the files of one task."""

    rows: list[tuple[str, int, int]]


class FilesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.filters = schema.fieldNames(), []
        if unknown := set(self.names) - set(KINDS):
            raise ValueError(f"files have no columns {sorted(unknown)}")
        self.roots = [p for p in options.get("path", "").split(",") if p]
        self.max_bytes, self.max_depth = int(options.get("max_bytes", files.MAX_BYTES)), int(options.get("max_depth", files.MAX_DEPTH))
        self.part = int(options.get("partition_bytes", PARTITION_BYTES))
        every = options.get("names", "all") == "all"
        self.wanted = tree.Wanted(_any if every else tree.is_env, () if every else summaries.SKIPPED_FOLDERS, (), (), options.get("follow_links", "true").lower() == "true")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if decidable(f):
                self.filters.append(f)
            else:
                yield f

    def listing(self) -> Iterator[tuple[str, int, int]]:
        front = [r.rstrip("/") for r in self.roots]
        for _ in range(self.max_depth):
            entries = [e for folder in front for e in tree.listed(folder, self.wanted)]
            for path, is_folder, mtime, size in entries:
                row = {"path": path, "mtime": mtime, "size": size}
                if not is_folder and size is not None and size <= self.max_bytes and all(meets(f, row) for f in self.filters):
                    yield path, mtime, size
            front = [path for path, is_folder, _, _ in entries if is_folder]

    def partitions(self) -> list[Files]:
        parts, held = [Files([])], 0
        for row in sorted(set(self.listing())):
            if held and held + row[2] > self.part:
                parts.append(Files([]))
                held = 0
            parts[-1].rows.append(row)
            held += max(row[2], OPEN_COST)
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, mtime, size in partition.rows:
            row = {"path": path, "mtime": mtime, "size": size}
            if "text" in self.names:
                found = files.content(path, self.max_bytes)
                if found is None:
                    continue
                row |= dict(zip(("text", "mtime", "size"), found, strict=True))
                # a file may have changed since it was listed
                if not all(meets(f, row) for f in self.filters):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([row[n]], KINDS[n]) for n in self.names], names=self.names)


def _any(name: str) -> bool:
    return True


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ensure_importable(spark)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilesSource)

