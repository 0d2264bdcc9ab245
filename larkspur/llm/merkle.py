"""Merkle manifest of a dataset, in external memory.

Every row is a leaf: the SHA-256 of its fields, each with its length. The leaves
of a tree (one for each value of ``tree``) ascend by ``order``; while a tree has
several nodes, every FANOUT consecutive ones become the hash of their digests.
What remains are subroots, which are the leaves of one more tree: its root is
that of the dataset.

Nodes are stored by level, as Parquet in folders ``level=0``, ``level=1``, ...
of two stores (``trees`` and ``top``). Leaves are dealt out by ranges and sorted
within them; a row's place in its tree is its place in its sorted run plus the
rows of the tree in earlier runs. A level is made by reading the one below,
run by run: ranges of parents keep the children of a node together, so a run is
turned into its parents without another shuffle. A node is stored with the digests
of its children, 64 letters each. A level has an eighth of the rows of the one below.

Proofs are taken from the top down: each level's nodes are joined, by the
coordinate (tree, index), with what is known of their parents, which adds the
children beside a node. Only rows that are asked for are followed. Nothing is
collected but the root (one digest) and the number of nodes of a level.

Defined results: a null field is ``-``. A null tree value is a tree of its own,
before all others. Null ids come first in their tree; rows of equal ids follow
each other by their digests, so equal rows may change places without any effect.
An empty table has no nodes, and no root (None). Only the columns named are read,
so further columns can't clash.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.columns import picked
from larkspur.runtime import shared_dir

FANOUT, DIGEST = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Runs of leaves and trees whose first places are broadcast at most.
MAX_BROADCAST = 100_000
NODE = "tree string, idx bigint, digest string, run string"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows give the same text."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row of FIELDS, or of what it would be with other values."""
    return hashed(*(field(changed.get(f, F.col(f))) for f in FIELDS))


def tree_key(value: Column) -> Column:
    """Never null, and in the order of the values, null first."""
    return F.coalesce(F.concat(F.lit(":"), value.cast("string")), F.lit(""))


def level_path(path: str, level: int) -> str:
    return f"{path}/level={level}"


def _read(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.parquet(level_path(path, level))


def _write_leaves(rows: DataFrame, order: list[str], path: str) -> None:
    """Rows with a tree, a digest and further columns, as level 0 with their places."""
    spark, by = rows.sparkSession, ["tree", *order, "digest"]
    raw = f"{path}/runs"
    # row numbers of Spark: the task in the upper bits, the place in its sorted run in the lower 33
    rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).write.parquet(raw)
    runs = spark.read.parquet(raw).withColumn("run", F.shiftright("at", 33))
    firsts = runs.groupBy("tree", "run").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # a tree has one row here for each run that it is in
    earlier = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("tree", "run", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    firsts.write.parquet(f"{path}/firsts")
    firsts = spark.read.parquet(f"{path}/firsts")
    held = F.broadcast(firsts) if firsts.count() <= MAX_BROADCAST else firsts
    placed = runs.join(held, ["tree", "run"]).withColumn("idx", F.col("at") + F.col("shift"))
    placed.drop("run", "at", "shift").withColumn("run", F.lit(None).cast("string")).write.parquet(level_path(path, 0))


def _parents(level: DataFrame) -> DataFrame:
    """The level above: nothing for trees that have one node left."""
    below = level.select("tree", "idx", "digest", F.floor(F.col("idx") / FANOUT).alias("parent"))
    nodes = F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("nodes")
    # ranges of parents keep their children together: the sum takes no further shuffle
    up = below.repartitionByRange("tree", "parent").groupBy("tree", "parent").agg(nodes)
    up = up.where((F.col("parent") > 0) | (F.size("nodes") > 1)).withColumn("run", F.array_join("nodes.digest", ""))
    return up.select("tree", F.col("parent").alias("idx"), hashed(F.col("run")).alias("digest"), "run").sortWithinPartitions("tree", "idx")


def _build(rows: DataFrame, order: list[str], path: str) -> int:
    """Write all levels of a store; how many there are."""
    spark = rows.sparkSession
    _write_leaves(rows, order, path)
    n, levels = _read(spark, path, 0).count(), 0
    while n:
        levels += 1
        _parents(_read(spark, path, levels - 1)).write.parquet(level_path(path, levels))
        n = _read(spark, path, levels).count()
    return levels


def _subroots(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """(tree, digest, top): the highest node of each tree and its level."""
    firsts = None
    for k in range(levels):
        own = _read(spark, path, k).where("idx = 0").select("tree", "digest", F.lit(k).alias("top"))
        firsts = own if firsts is None else firsts.unionByName(own)
    return firsts.groupBy("tree").agg(F.max_by("digest", "top").alias("digest"), F.max("top").alias("top"))


class Manifest(NamedTuple):
    """Where the nodes are, how many levels the two stores have, and the root."""

    path: str
    levels: int
    top_levels: int
    root: str | None


def write_manifest(rows: DataFrame, path: str | None = None, tree: str = "lang", order: str = "doc_id") -> Manifest:
    """``rows``: a digest, the columns ``tree`` and ``order``, and further ones that are stored with the leaves."""
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
    rows = rows.withColumn("tree", tree_key(F.col(tree)))
    levels = _build(rows, [order], f"{path}/trees")
    if not levels:
        return Manifest(path, 0, 0, None)
    subroots = _subroots(spark, f"{path}/trees", levels).select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", "top")
    top_levels = _build(subroots, ["key"], f"{path}/top")
    root = _subroots(spark, f"{path}/top", top_levels).first()
    return Manifest(path, levels, top_levels, root.digest)


STEP = "array<struct<left:string,right:string>>"


def _beside(run: Column, idx: Column) -> Column:
    """The children before and after one of them."""
    at = (idx % FANOUT * DIGEST).cast("int")
    return F.struct(F.substring(run, F.lit(1), at).alias("left"), F.substring(run, at + DIGEST + 1, F.length(run)).alias("right"))


def _coordinates(nodes: DataFrame, above: int) -> DataFrame:
    """The coordinates of nodes' ancestors so many levels above, each once."""
    return nodes.select("tree", F.floor(F.col("idx") / FANOUT**above).alias("idx")).distinct()


def _paths(spark: SparkSession, path: str, levels: int, roots: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Level 0 with the steps from each node to the root: ``roots`` has, for each tree, the
    level ``top`` of its highest node, the steps from there on, and what is known of the tree."""
    more = [c for c in roots.columns if c not in ("tree", "top", "steps")]
    known = None
    for k in reversed(range(levels)):
        nodes = _read(spark, path, k)
        if wanted is not None:
            nodes = nodes.join(_coordinates(wanted, k), ["tree", "idx"], "left_semi")
        # the highest nodes are one for each tree
        own = nodes.where("idx = 0").join(roots.where(F.col("top") == k).drop("top"), "tree")
        if known is not None:
            above = known.select("tree", F.col("idx").alias("parent"), F.col("run").alias("children"), F.col("steps").alias("further"), *more)
            inner = nodes.withColumn("parent", F.floor(F.col("idx") / FANOUT)).join(above, ["tree", "parent"])
            steps = F.concat(F.array(_beside(F.col("children"), F.col("idx"))), F.col("further"))
            own = own.unionByName(inner.withColumn("steps", steps).drop("parent", "children", "further"))
        if k:
            kept = f"{path}/steps-{uuid.uuid4().hex}"
            own.write.parquet(kept)
            own = spark.read.parquet(kept)
        known = own
    return known


def proofs(spark: SparkSession, m: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """Stored leaves with ``subroot`` and ``steps``: for each level from the leaf to the root,
    the digests before and after the node in its run, joined. ``wanted`` (tree, idx) asks for some leaves only."""
    roots = _subroots(spark, f"{m.path}/top", m.top_levels).select("tree", "top", F.array().cast(STEP).alias("steps"))
    top = _paths(spark, f"{m.path}/top", m.top_levels, roots, None)
    top = top.select(F.col("key").alias("tree"), "top", "steps", F.col("digest").alias("subroot"))
    # one row for each tree, read at every level
    kept = f"{m.path}/subroots-{uuid.uuid4().hex}"
    top.write.parquet(kept)
    return _paths(spark, f"{m.path}/trees", m.levels, spark.read.parquet(kept), wanted).drop("run")


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, digest, lambda h, s: hashed(s["left"], h, s["right"]))


def leaves(docs: DataFrame, tampered: Column | None = None, when: Column | None = None) -> DataFrame:
    """(doc_id, lang, digest, other): the leaf of each row; ``other`` is the leaf with
    the text ``tampered`` where ``when`` holds, and null elsewhere."""
    rows = picked(docs, **{f: f for f in FIELDS})
    other = F.when(when, leaf(text=tampered)) if tampered is not None else F.lit(None).cast("string")
    return rows.select("doc_id", "lang", leaf().alias("digest"), other.alias("other"))
