"""Files as rows (path, text, mtime, size).

Files that are too large or binary are left out; text is UTF-8, else Latin-1.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import summaries
from larkspur.runtime import ensure_importable
from larkspur.sources import tree

MAX_BYTES = 10 * 1024 * 1024
MAX_DEPTH = 10
# Well-known configuration files below the home folder, and their formats.
CLOUD_TARGETS = (
    (".aws/credentials", "ini"), (".aws/config", "ini"), (".config/gcloud/application_default_credentials.json", "json"), (".config/gcloud/properties", "ini"),
    (".azure/accessTokens.json", "json"), (".azure/azureProfile.json", "json"), (".azure/msal_token_cache.json", "json"), (".docker/config.json", "json"),
    (".kube/config", "yaml"), (".config/gh/hosts.yml", "yaml"), (".config/hub", "yaml"),
)
APP_TARGETS = (
    (".npmrc", "ini"), (".pypirc", "ini"), (".netrc", "netrc"), (".pgpass", "pgpass"), (".my.cnf", "ini"),
    (".cargo/credentials.toml", "toml"), (".cargo/credentials", "toml"), (".gem/credentials", "yaml"),
)


def as_text(binary: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """binaryFile rows -> path, text, mtime (seconds), size."""
    content = F.col("content")
    is_text = F.position(F.lit(b"\x00"), F.substring(content, 1, 512)) == 0
    # the guard comes first: decode() fails on broken UTF-8
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    rows = binary.where(F.col("length") <= max_bytes).where(is_text)
    path = F.regexp_replace("path", "^file:(//)?(?=/)", "")
    return rows.select(path.alias("path"), text.alias("text"), F.col("modificationTime").cast("long").alias("mtime"), F.col("length").alias("size"))


LISTED = "path string, mtime bigint, size bigint"
_LISTED = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64())])


def _stats(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    info = os.stat(path)
                except OSError:
                    continue  # gone or forbidden: no item
                if stat.S_ISREG(info.st_mode) and info.st_size <= max_bytes:
                    rows.append((path, int(info.st_mtime), info.st_size))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTED, strict=True)], schema=_LISTED)

    return run


def listed(spark: SparkSession, paths: Iterable[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, mtime, size) of the files of a list that exist and aren't too large; none is opened."""
    ensure_importable(spark)
    rows = [(p,) for p in paths]
    if not rows:
        return spark.createDataFrame([], LISTED)
    parts = min(len(rows), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(rows, "path string").repartition(parts).mapInArrow(_stats(max_bytes), LISTED)


def content(path: str, max_bytes: int) -> tuple[str, int, int] | None:
    """(text, mtime, size) of one file, as it is when opened; None if it is gone, too large, no file or binary."""
    try:
        with open(path, "rb") as f:
            info = os.fstat(f.fileno())
            if not stat.S_ISREG(info.st_mode) or info.st_size > max_bytes:
                return None
            data = f.read()
    except OSError:
        return None
    if b"\0" in data[:512]:
        return None
    try:
        return data.decode("utf-8"), int(info.st_mtime), info.st_size
    except UnicodeDecodeError:
        return data.decode("latin-1"), int(info.st_mtime), info.st_size


def _contents(names: list[str], max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                if found := content(path, max_bytes):
                    row = batch.slice(k, 1)
                    own = [pa.array([v], t) for v, t in zip(found, (pa.string(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*row.columns, *own], names=[*names, "text", "mtime", "size"])

    return run


def opened(listing: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files of a listing, read by tasks from a mounted file system: their text, and time and
    size as they are at that moment. Further columns are passed on.

    Spark's own file sources skip names that start with a dot, which is what
    most of these files have; ``as_text`` serves stores without such names.
    """
    ensure_importable(listing.sparkSession)
    names = ["path", *(c for c in listing.columns if c not in ("path", "text", "mtime", "size"))]
    rows = listing.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_contents(names, max_bytes), f"{kinds}, text string, mtime bigint, size bigint")


def read_files(spark: SparkSession, paths: Iterable[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, text, mtime, size) of the files of a list that exist."""
    return opened(listed(spark, paths, max_bytes), max_bytes).select("path", "text", "mtime", "size")


def env_files(spark: SparkSession, roots: Iterable[str], max_bytes: int = MAX_BYTES, **walk) -> DataFrame:
    """(path, mtime, size) of the .env files below those of the roots that are folders."""
    walk = {"max_depth": MAX_DEPTH, "skipped": summaries.SKIPPED_FOLDERS} | walk
    found = tree.walk(spark, roots, **walk).where(F.col("size") <= max_bytes)
    return found.dropDuplicates(["path"])


def targets(spark: SparkSession, home: str, table: tuple[tuple[str, str], ...], source_type: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Well-known files that exist, with the format of the table."""
    formats = F.create_map(*(F.lit(x) for p, f in table for x in (f"{home}/{p}", f)))
    files = listed(spark, [f"{home}/{p}" for p, _ in table], max_bytes)
    return files.withColumn("hint", F.element_at(formats, F.col("path"))).withColumn("source_type", F.lit(source_type))


def folder_listing(spark: SparkSession, folder: str, follow_links: bool = True) -> DataFrame:
    """(path, is_dir, mode) of a folder and its files; Spark's reader has no modes."""
    rows = [(folder, True, stat.S_IMODE(os.stat(folder).st_mode))]
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        info = entry.stat(follow_symlinks=False)
        if not stat.S_ISDIR(info.st_mode) and (follow_links or not stat.S_ISLNK(info.st_mode)):
            rows.append((entry.path, False, stat.S_IMODE(info.st_mode)))
    return spark.createDataFrame(rows, "path string, is_dir boolean, mode int")
