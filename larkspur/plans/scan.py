"""A scan of a home folder, or of any files: sources -> findings -> report.

A source is a value of ``Source``: how it is called, what its items are, whether
it is there at all. ``SOURCES`` are the built-in ones in the order of the report's
targets; a scan takes any others beside or instead of them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.config import Settings
from larkspur.functions.rules import BUILT_IN, Rule
from larkspur.functions.text import lines
from larkspur.operators import detect, ssh, state, summaries
from larkspur.operators.lines import text_lines
from larkspur.runtime import removed, shared_dir, written
from larkspur.sources import files, histories, structured

STATE = "path string, mtime bigint, size bigint, findings_count bigint"
CHECK_RULE = 1000


class Place(NamedTuple):
    """Where a scan looks, with ``~`` spelled out in the settings."""

    spark: SparkSession
    home: str
    settings: Settings

    def kept(self, rows: DataFrame) -> DataFrame:
        s = self.settings
        return rows.where(~summaries.excluded(F.col("path"), list(s.exclude_paths), list(s.exclude_patterns)))


class Source(NamedTuple):
    """``read`` lists files (path, mtime, size, perhaps hint), unopened; new and changed ones are then
    opened, once. Rows that have a ``text`` are taken as they are. ``items`` turns files with
    texts into lines with context, and ``checks`` may add findings of its own."""

    name: str
    source_type: str
    read: Callable[[Place], DataFrame]
    items: Callable[[DataFrame], DataFrame] = text_lines
    is_available: Callable[[Place], bool] = lambda place: True
    checks: Callable[[Place], DataFrame] | None = None


def with_format(rows: DataFrame) -> DataFrame:
    hint = F.col("hint") if "hint" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("format", structured.file_format(F.col("path"), hint))


def _structured(rows: DataFrame) -> DataFrame:
    return structured.structured_items(with_format(rows))


def _walk(s: Settings) -> dict:
    return {"max_depth": s.max_depth, "folders": s.exclude_paths, "patterns": s.exclude_patterns, "follow_links": s.follow_links}


def dotfiles(p: Place) -> DataFrame:
    """Fixed files; exclusions don't hold for them. Extra paths are files, or folders with env files."""
    folders = [x for x in p.settings.extra_paths if os.path.isdir(x)]
    single = [x for x in (*p.settings.dotfiles, *p.settings.extra_paths) if x not in folders]
    more = files.env_files(p.spark, folders, p.settings.max_file_size, **_walk(p.settings))
    return files.listed(p.spark, dict.fromkeys(single), p.settings.max_file_size).unionByName(more)


def ssh_folder(p: Place) -> str:
    return f"{p.home}/.ssh"


def ssh_files(p: Place) -> DataFrame:
    found = [e.path for e in os.scandir(ssh_folder(p)) if e.is_file(follow_symlinks=p.settings.follow_links)]
    return p.kept(files.listed(p.spark, found, p.settings.max_file_size))


def posture(p: Place) -> DataFrame:
    rows = files.folder_listing(p.spark, ssh_folder(p), p.settings.follow_links)
    rows = rows.join(files.opened(ssh_files(p), p.settings.max_file_size).select("path", lines(F.col("text")).alias("lines")), "path", "left")
    rows = rows.where(F.col("is_dir") | F.col("lines").isNotNull()).withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    return ssh.ssh_checks(rows)


def _history(shell: str) -> Source:
    path = lambda p: f"{p.home}/{histories.FILES[shell]}"
    return Source(
        f"{shell}_history", "shell_history", lambda p: files.listed(p.spark, [path(p)], p.settings.max_file_size),
        lambda rows: histories.history_items(rows, shell), lambda p: os.path.isfile(path(p)),
    )


SOURCES = (
    Source("dotfiles", "dotfile", dotfiles),
    Source("env_files", "env_file", lambda p: files.env_files(p.spark, p.settings.search_roots, p.settings.max_file_size, **_walk(p.settings))),
    Source("cloud", "cloud_config", lambda p: p.kept(files.targets(p.spark, p.home, files.CLOUD_TARGETS, "cloud_config", p.settings.max_file_size)), _structured),
    Source("applications", "application_config", lambda p: p.kept(files.targets(p.spark, p.home, files.APP_TARGETS, "application_config", p.settings.max_file_size)), _structured),
    Source("ssh", "ssh_key", ssh_files, text_lines, lambda p: os.path.isdir(ssh_folder(p)), posture),
    *map(_history, histories.FILES),
)


def available(p: Place, sources: Sequence[Source] = SOURCES) -> list[Source]:
    return [s for s in sources if s.is_available(p)]


def targets_scanned(sources: Sequence[Source]) -> list[str]:
    """Their types in order; neighbours of one type count once."""
    return [kind for kind, _ in groupby(s.source_type for s in sources)]


class Scanned(NamedTuple):
    """Findings in report order, the state for the next scan, and what was scanned. All of them
    are made from one snapshot of the files, which ``close`` deletes."""

    findings: DataFrame
    state: DataFrame
    facts: DataFrame
    targets: list[str]
    folder: str = ""

    def close(self) -> None:
        if self.folder:
            removed(self.findings.sparkSession, self.folder)


SNAPSHOT = "path string, text string, mtime bigint, size bigint, hint string, source string, source_type string"


def snapshot(rows: list[tuple[Source, DataFrame]], fresh: DataFrame, max_bytes: int, folder: str) -> DataFrame:
    """The new and changed files of all sources, each opened once and written with its time and size at
    that moment: what is found in a file and what the state says of it can't differ."""
    out = fresh.sparkSession.createDataFrame([], SNAPSHOT)
    for x, listing in rows:
        own = listing.join(fresh.select("path"), "path", "left_semi")
        own = own if "text" in own.columns else files.opened(own, max_bytes)
        hint = F.col("hint") if "hint" in own.columns else F.lit(None)
        own = own.select("path", "text", "mtime", "size", hint.cast("string").alias("hint"), F.lit(x.name).alias("source"), F.lit(x.source_type).alias("source_type"))
        out = out.unionByName(own)
    return written(out, "snapshot", folder)


def scan(spark: SparkSession, home: str, s: Settings = Settings(), rules: Sequence[Rule] = BUILT_IN, old: DataFrame | None = None, sources: Sequence[Source] = SOURCES, **extensions) -> Scanned:
    p = Place(spark, home.rstrip("/"), s.at_home(home))
    own = available(p, sources)
    old = old if old is not None and s.incremental else spark.createDataFrame([], STATE)
    folder = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    read = [(x, x.read(p)) for x in own]
    listing = spark.createDataFrame([], "path string, mtime bigint, size bigint, source string")
    listing = reduce(DataFrame.unionByName, [f.select("path", "mtime", "size", F.lit(x.name).alias("source")) for x, f in read], listing)
    listing = written(listing, "listing", folder)
    seen = listing.select("path", "mtime", "size").dropDuplicates(["path"])
    fresh = written(state.stale(seen, old), "fresh", folder)
    taken = snapshot(read, fresh, s.max_file_size, folder)
    kept = ["path", "line_number", "line", "context_before", "context_after", "source_type"]
    items = spark.createDataFrame([], "path string, line_number int, line string, context_before array<string>, context_after array<string>, source_type string, source string")
    for x in own:
        lines_ = x.items(taken.where(F.col("source") == x.name).drop("source"))
        items = items.unionByName(lines_.select(*kept).withColumn("source", F.lit(x.name)))
    # without entropy the bare engine runs, which has no context signals either
    found = detect.findings(items.drop("source"), rules, redact=s.redact, use_entropy=s.use_entropy, use_context=s.use_context and s.use_entropy, **extensions)
    for x in own:
        if x.checks:
            found = found.unionByName(x.checks(p).withColumn("source_type", F.lit(x.source_type)).withColumn("rule_id", F.lit(CHECK_RULE)), allowMissingColumns=True)
    found = summaries.at_least(found, s.min_confidence)
    # files with lines are remembered; others are looked at again
    read_now = taken.select("path", "mtime", "size").dropDuplicates(["path"]).join(items.select("path").distinct(), "path", "left_semi")
    counted = state.with_counts(read_now, summaries.per_path(found))
    # what was cached has no lines here, but counts as a file of its source
    cached = listing.join(fresh.select("path"), "path", "left_anti").select("source", "path", F.lit(None).cast("string").alias("line"), F.lit(True).alias("cached"))
    facts = summaries.scan_facts(items.select("source", "path", "line", F.lit(False).alias("cached")).unionByName(cached))
    return Scanned(summaries.in_report_order(found), state.updated(state.pruned(old, seen), counted), facts, targets_scanned(own), folder)
