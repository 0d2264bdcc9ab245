"""Mixing sources to target weights, with DataFrame functions only.

Words are summed by source (partial sums before the shuffle). Targets: sources
in code-point order, null last, weigh 5, 2, 1, repeating; they share all words
by weight, but none gets more than MAX_RATE times its own words, and what is
over is shared again by weight. That has a closed form: with sources sorted by
the level at which each would be full, one running sum gives the level.
A document of a source with rate r is taken floor(r) times, and once more if a
number in [0, 1) is below the fraction. That number comes from a hash of the seed, the
id, the text's MD5 and the row's number among the rows of the same id, text and
source, so rows are drawn one by one, however often an id or a row comes. Rows are
numbered where they repeat only: a task numbers its own, and counts of the tasks before
it are added, so no task sees all rows of a group.

Up to MAX_BROADCAST sources are ordered in one window and broadcast; more are
ordered by range, with sums of the ranges, and joined by a shuffle, but for the
fewer than HOT_PART sources that hold more than 1 / HOT_PART of the documents.

Defined results: null text has size 0; documents of size 0 and sources without
words have rate 0 where the source has no words, and take 0 words in any case.
A null source is a source. Of rows that repeat id, text and source, which one gets
which number follows the table's parts; how many are taken doesn't.
An empty table gives an empty table. ``rates`` passes on all columns but those
named like its own results; ``mixed`` passes on exactly the columns it gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.columns import by_place, place, with_results
from larkspur.runtime import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
MAX_BROADCAST = 100_000
HOT_PART = 1000
RESULTS = ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit("-"))


def in_order(rows: DataFrame, order: list[Column], few: bool, *sums: str) -> DataFrame:
    """``rows`` with their place from 0, and for each of ``sums`` what all rows before sum up to."""
    if few:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
        return rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})
    # written, so that each row keeps its range
    cut = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ordered")
    parts = cut.groupBy("part").agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in sums))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = parts.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_start") for c in ("rows", *sums)))
    inside = Window.partitionBy("part").orderBy(*order)
    cut = cut.join(F.broadcast(starts), "part").withColumn("place", F.col("rows_start") + F.row_number().over(inside) - 1)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumns({f"{c}_before": F.col(f"{c}_start") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})
    return cut.drop("part", "rows_start", *(f"{c}_start" for c in sums))


def targets(totals: DataFrame, few: bool = True) -> DataFrame:
    """(source, source_size) -> and target, rate."""
    by_name = [F.col("source").isNull(), F.col("source")]
    t = in_order(totals, by_name, few)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    t = t.withColumn("weight", weight).withColumn("full_at", MAX_RATE * F.col("source_size") / F.col("weight"))
    t = in_order(t.drop("place"), [F.col("full_at"), *by_name], few, "source_size", "weight")
    t = written(t, "source-order")
    all_words, all_weights = t.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(all_words) - MAX_RATE * F.col("source_size_before")) / (F.lit(all_weights) - F.col("weight_before"))
    found = t.withColumn("level", level).where("level <= full_at").agg(F.min(F.struct("full_at", "level"))["level"]).first()[0]
    target = F.least(MAX_RATE * F.col("source_size").cast("double"), F.lit(found).cast("double") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(MAX_RATE)))).otherwise(0.0)
    return t.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` (key, ...) with ``number``, from 0, among the rows of a key; ``repeated`` has the keys of several rows."""
    n_keys = repeated.count()
    if not n_keys:
        return rows.withColumn("number", F.lit(0).cast("long"))
    held = F.broadcast(repeated) if n_keys <= MAX_BROADCAST else repeated
    # written, so that each row keeps its task
    several = written(rows.join(held, "key", "left_semi").withColumn("part", F.spark_partition_id()), "repeated")
    counts = several.groupBy("key", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = written(counts.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")), "starts")
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy("part"))
    several = several.withColumn("own", own).join(F.broadcast(starts) if starts.count() <= MAX_BROADCAST else starts, ["key", "part"])
    several = several.withColumn("number", F.col("start") + F.col("own") - 1).select(*rows.columns, "number")
    return several.unionByName(rows.join(held, "key", "left_anti").withColumn("number", F.lit(0).cast("long")))


def rates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, size: str | None = None, digest: str | None = None) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_rate and mix_copies.

    ``size`` and ``digest``: columns with the words and the MD5 of a text, where they are known.
    """
    names = docs.columns
    col = lambda c: F.col(f"c{place(names, c)}")
    words = word_count(col(text)) if size is None else col(size)
    told = text_digest(col(text)) if digest is None else col(digest)
    identity = F.concat(F.coalesce(col(doc_id).cast("string"), F.lit("")), F.lit(":"), told)
    key = F.md5(F.concat_ws("|", identity, F.concat(F.lit("of:"), col(source))))
    sized = by_place(docs).withColumns({"words": words, "identity": identity, "key": key})
    groups = written(sized.groupBy(col(source).alias("source"), "key").agg(F.sum("words").alias("words"), F.count("*").alias("rows")), "groups")
    totals = written(groups.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows")), "totals")
    n_sources, n_rows = totals.agg(F.count("*"), F.sum("rows")).first()
    few = n_sources <= MAX_BROADCAST
    found = written(targets(totals.select("source", "source_size"), few), "sources")
    sized = _numbered(sized, groups.where("rows > 1").select("key").distinct())
    same = lambda t: col(source).eqNullSafe(t["source"])
    if few:
        both = sized.join(F.broadcast(found), same(found))
    else:
        hot = totals.where(F.col("rows") * HOT_PART > n_rows).select("source")
        often = found.join(F.broadcast(hot), found["source"].eqNullSafe(hot["source"]), "left_semi")
        both = sized.join(F.broadcast(often), same(often)).unionByName(sized.join(F.broadcast(hot), same(hot), "left_anti").join(found, same(found)))
    seeded = F.concat(F.lit(f"{seed}:"), F.col("identity"), F.lit(":"), F.col("number").cast("string"))
    draw = F.conv(F.substring(F.md5(seeded), 1, 13), 16, 10).cast("double") / float(1 << 52)
    rate = F.col("rate")
    whole = F.floor(rate)
    got = (F.col("words"), F.col("source_size"), F.col("target"), rate, whole + (draw < rate - whole).cast("long"))
    return with_results(both, names, dict(zip(RESULTS, got, strict=True)))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns that it came with."""
    names = docs.columns
    at = {k: f"c{place(names, c)}" for k, c in (("doc_id", doc_id), ("text", text), ("source", source))}
    taken = rates(by_place(docs), **at, **more).where("mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("mix_copy")
    return taken.select(*(f"c{k}" for k in range(len(names))), copies).drop("mix_copy").toDF(*names)
