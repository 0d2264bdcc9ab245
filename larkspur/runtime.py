"""Small helpers that every job of the library shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows of whole documents reach Python workers in batches of this size, unless the session says how.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "250", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it, and
    take rows of whole documents in smaller batches unless the session says how.

    On a cluster the package is installed or sent with ``--py-files``; then
    this entry of PYTHONPATH is one more place that is looked at. The sizes of batches stay
    set, for results are lazy and read them when they run; ``batches_as_before`` takes them back.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    own = dict(spark.conf.getAll)
    for key, value in BATCHES.items():
        if key not in own:
            spark.conf.set(key, value)


def batches_as_before(spark: SparkSession) -> None:
    """Take back the sizes of batches that ``ensure_importable`` has set, once results have been read."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) == value:
            spark.conf.unset(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local folder is made and set, but only in
    local mode: executors on other machines wouldn't see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks, not the
    work before this point.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _RUNS:
        _RUNS[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_RUNS: list[list[str]] = []
#: Where the tables are that ``written`` has returned.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has returned, once nothing reads them any more: all that was
    made of them has been written itself."""
    for df in tables:
        removed(df.sparkSession, _PATHS.pop(df))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete what is ``written`` inside, once it is over: the intermediate tables of operators, whose
    results are lazy and must have been written or read by then. Outside of it, they stay."""
    own: list[str] = []
    _RUNS.append(own)
    try:
        yield
    finally:
        _RUNS.remove(own)
        for path in own:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, wherever it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
