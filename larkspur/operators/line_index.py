"""A persistent index of lines by trigrams, so that a new rule reads only lines that it may match.

Lines get numbers and are stored in blocks of BLOCK; a posting is a row (gram, block,
places of the lines that hold the gram), in folders by a checksum of the gram.
``candidates`` turns the regex of each rule into an AND of ORs of ANDs of grams
(``functions/literals.trigrams``), keeps the rarest grams of each (``plan``), reads the
folders of those alone, and intersects and unites their places block by block. Only the
lines that remain are read and matched; folders of lines without any are skipped.

An index is made of segments. ``add`` writes one more and never changes another, so
files that came later are indexed without reading the old ones; a segment is
seen once its mark is written, so one that was cut short counts for nothing.
``live`` leaves out lines of files that changed or went since.

Rules whose regex asks for no gram (shorter than three letters, or unreadable) get
every line, as they do without an index. Null lines match nothing and aren't stored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.literals import Condition, folded, trigrams
from larkspur.functions.rules import BUILT_IN, Rule
from larkspur.operators.detect import rule_matches
from larkspur.runtime import ensure_importable, written

#: Lines of a block: a posting has at most so many.
BLOCK = 1 << 14
#: Blocks in a folder of lines, and folders of postings.
FOLDER, BUCKETS = 1 << 8, 64
GRAM = 3
#: Bytes of lines whose grams a task sorts at once.
MOST_BYTES = 1 << 21
#: Grams of an alternative that are looked up.
RAREST = 3
#: Folders of lines that are broadcast at most.
MAX_BROADCAST = 100_000


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _of_lines(rows: pa.Table) -> pa.RecordBatch | None:
    """(gram, block, places) of lines, each gram of a line once: windows of three letters, sorted by gram."""
    lengths = pc.utf8_length(rows["folded"]).to_numpy()
    letters = np.frombuffer("".join(rows["folded"].to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    line = np.repeat(np.arange(len(lengths)), lengths)
    inside = line[: 1 - GRAM] == line[GRAM - 1 :]
    gram = np.bitwise_or.reduce([letters[k : len(letters) - GRAM + 1 + k] << 21 * (GRAM - 1 - k) for k in range(GRAM)])[inside] if inside.any() else letters[:0]
    if not len(gram):
        return None
    order = np.argsort(gram, kind="stable")
    gram, line = gram[order], line[: 1 - GRAM][inside][order]
    block = rows["block"].to_numpy()[line]
    differs = lambda *columns: np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
    once = differs(gram, line)
    gram, line, block = gram[once], line[once], block[once]
    starts = np.flatnonzero(differs(gram, block))
    spelled = np.stack([gram[starts] >> 21 * (GRAM - 1 - k) & (1 << 21) - 1 for k in range(GRAM)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gram)), pa.int32()), pa.array(rows["place"].to_numpy()[line], pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([spelled[k : k + GRAM] for k in range(0, len(spelled), GRAM)], pa.string()), pa.array(block[starts], pa.int64()), places], ["gram", "block", "places"])


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the lines (folded, block, place) of a task, for each MOST_BYTES of lines."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= MOST_BYTES:
            if (out := _of_lines(pa.Table.from_batches(held))) is not None:
                yield out
            held, n = [], 0
    if held and (out := _of_lines(pa.Table.from_batches(held))) is not None:
        yield out


def add(lines: DataFrame, path: str) -> str:
    """Index lines (``line`` and any further columns, such as path and line_number) as a new segment."""
    spark, segment = lines.sparkSession, f"s{uuid.uuid4().hex}"
    taken = {"at", "block", "folder", "segment", "rule_ids"} & {c.lower() for c in lines.columns}
    if taken:
        raise ValueError(f"names that the index needs itself: {sorted(taken)}")
    # the numbers of a task are consecutive, and their upper bits tell it from others
    at = F.monotonically_increasing_id()
    numbered = lines.where(F.col("line").isNotNull()).withColumn("at", at).withColumn("block", F.shiftright("at", BLOCK.bit_length() - 1))
    numbered.withColumn("folder", F.floor(F.col("block") / FOLDER)).write.partitionBy("folder").parquet(f"{path}/lines/segment={segment}")
    stored = spark.read.parquet(f"{path}/lines/segment={segment}")
    ensure_importable(spark)
    asked = stored.select(folded(F.col("line")).alias("folded"), "block", F.col("at").bitwiseAND(BLOCK - 1).cast("int").alias("place"))
    # equal grams of a block meet in the task that reads it before anything is shuffled; a shuffle by
    # bucket and folder brings together blocks that more than one task has read
    parts = asked.mapInArrow(postings, "gram string, block bigint, places array<int>")
    parts = parts.withColumn("bucket", (F.crc32("gram") % BUCKETS).cast("int")).withColumn("of", F.floor(F.col("block") / FOLDER)).repartition("bucket", "of")
    whole = parts.groupBy("bucket", "of", "gram", "block").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places")).drop("of")
    whole = whole.sortWithinPartitions("bucket", "gram", "block")
    whole.write.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    spark.createDataFrame([(segment,)], "name string").coalesce(1).write.mode("append").parquet(f"{path}/whole")
    return segment


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    """Lines or postings of the segments that are whole."""
    whole = [r.name for r in spark.read.parquet(f"{path}/whole").collect()]  # one for each call of add
    return spark.read.parquet(f"{path}/{what}").where(F.col("segment").isin(whole))


def plan(condition: Condition, counts: dict[str, int]) -> Condition:
    """The cheap part of a condition: of each alternative the RAREST grams that fewest lines
    hold, and of all parts those that let through not many more lines than the best one."""
    slim = [tuple(dict.fromkeys(frozenset(sorted(a, key=lambda g: (counts.get(g, 0), g))[:RAREST]) for a in part)) for part in condition]
    lines = {part: sum(min(counts.get(g, 0) for g in a) for a in part) for part in slim}
    least = min(lines.values(), default=0)
    return tuple(p for p in dict.fromkeys(slim) if lines[p] <= 10 * least or lines[p] == least)


def candidates(spark: SparkSession, path: str, rules: Sequence[Rule]) -> tuple[DataFrame, list[int]]:
    """((segment, block, at, rule_ids) of the lines that some rule may match, ids of rules that every line may match)."""
    conditions = {k: trigrams(r.regex) for k, r in enumerate(rules, 1)}
    every = [k for k, c in conditions.items() if not c]
    wanted = sorted({g for c in conditions.values() for part in c for a in part for g in a})
    read = lambda gs: _read(spark, path, "postings").where(F.col("bucket").isin(sorted({bucket(g) for g in gs})) & F.col("gram").isin(gs))
    # as many rows as the rules have grams, however many lines there are
    counts = {r.gram: r.n for r in read(wanted).groupBy("gram").agg(F.sum(F.size("places")).alias("n")).collect()}
    asked = []
    for k, condition in conditions.items():
        parts = plan(condition, counts)
        asked += [(g, k, len(parts), p, a, len(grams_)) for p, part in enumerate(parts) for a, grams_ in enumerate(part) for g in grams_]
    table = spark.createDataFrame(asked, "gram string, rule_id int, n_parts int, part int, alternative int, n_grams int")
    # the table of what is asked is made of the rules alone
    met = read(sorted({row[0] for row in asked})).join(F.broadcast(table), "gram")
    both = lambda lists: F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.get(lists, F.lit(0)), F.array_intersect)
    group = ["segment", "block", "rule_id", "n_parts"]
    met = met.groupBy(*group, "part", "alternative", "n_grams").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == F.col("n_grams"))
    met = met.select(*group, "part", both(F.col("lists")).alias("places"))
    met = met.groupBy(*group, "part").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    met = met.groupBy(*group).agg(F.collect_list("places").alias("lists")).where(F.size("lists") == F.col("n_parts"))
    lines = met.select("segment", "block", "rule_id", F.explode(both(F.col("lists"))).alias("place"))
    at = F.shiftleft("block", BLOCK.bit_length() - 1) + F.col("place")
    return lines.groupBy("segment", "block", at.alias("at")).agg(F.collect_list("rule_id").alias("rule_ids")), every


def candidate_lines(spark: SparkSession, path: str, rules: Sequence[Rule], live: DataFrame | None = None) -> DataFrame:
    """Stored lines with ``rule_ids``: the rules (by their places, from 1) that may match them."""
    found, every = candidates(spark, path, rules)
    found = written(found.withColumn("folder", F.floor(F.col("block") / FOLDER)).drop("block"), "candidates")
    lines = _read(spark, path, "lines")
    if live is not None:
        lines = lines.join(live, [c for c in live.columns if c in lines.columns], "left_semi")
    if not every:
        # the scan skips the other folders
        folders = written(found.select("segment", "folder").distinct(), "folders")
        few = folders.count() <= MAX_BROADCAST
        folders = folders.where("folder >= 0")
        lines = lines.join(F.broadcast(folders) if few else folders, ["segment", "folder"], "left_semi")
    both = lines.join(found, ["segment", "folder", "at"], "left" if every else "inner")
    ids = F.concat(F.coalesce("rule_ids", F.array().cast("array<int>")), F.array(*map(F.lit, every)).cast("array<int>"))
    return both.withColumn("rule_ids", ids).drop("segment", "folder", "block", "at")


def indexed_matches(spark: SparkSession, path: str, rules: Sequence[Rule] = BUILT_IN, live: DataFrame | None = None) -> DataFrame:
    """``rule_matches`` over the stored lines; rules are tried only where the index lets them."""
    found = rule_matches(candidate_lines(spark, path, rules, live), rules, F.col("rule_ids"))
    return found.drop("rule_ids")


def changed(new: Sequence[Rule], old: Sequence[Rule]) -> list[Rule]:
    """Rules that are new, or whose regex is: those that stored lines have to be matched with again."""
    known = {(r.name, r.regex) for r in old}
    return [r for r in new if (r.name, r.regex) not in known]
