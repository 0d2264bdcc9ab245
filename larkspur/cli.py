"""Command line: scan, report, init. Exit 0: nothing found; 1: findings; 2: an error."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larkspur.config import ConfigError, Layers, Settings, default_file, in_home
from larkspur.functions.scoring import severity_rank
from larkspur.operators import summaries
from larkspur.plans.scan import scan
from larkspur.sources import report, saved_state

SETTINGS, STATE = "~/.config/larkspur/config.toml", "~/.cache/larkspur/state.jsonl"
NO_FACTS = {"files_scanned": 0, "files_cached": 0, "bytes_scanned": 0}


def written_out(r: report.Report, kind: str, output: str | None) -> int:
    if kind not in report.REPORTERS:
        raise ConfigError(f"unknown format {kind!r}")
    parts = report.REPORTERS[kind](r)
    if output:
        report.save(output, parts)
    else:
        sys.stdout.writelines(parts)
    return int(any(r.counts.values()))


def counted(findings) -> dict[str, int]:
    return summaries.severity_counts(findings).first().asDict()


def run_scan(spark: SparkSession, a: argparse.Namespace) -> int:
    home = os.path.expanduser(a.home)
    options = {
        "format": a.format, "min_confidence": a.min_confidence, "extra_paths": a.paths or None, "verbosity": "quiet" if a.quiet else "verbose" if a.verbose else None,
        "use_entropy": False if a.no_entropy else None, "use_context": False if a.no_context else None, "redact": False if a.show_secrets else None, "incremental": False if a.no_cache else None,
    }
    settings: Settings = Layers([os.path.expanduser(SETTINGS), ".larkspur.toml"]).load(options)
    state_path = in_home(a.state, home)
    began = datetime.now(UTC)
    scanned = scan(spark, home, settings, old=saved_state.load(spark, state_path) if settings.incremental else None)
    findings = scanned.findings.cache()
    facts = scanned.facts.first().asDict()
    counts = counted(findings)
    if settings.incremental:
        saved_state.save(scanned.state, state_path)
    shown = written_out(report.Report(findings, counts, facts, scanned.targets, began, datetime.now(UTC), settings.verbosity, home), settings.format, a.output or in_home(settings.output_path, home) or None)
    scanned.close()
    return shown


def run_report(spark: SparkSession, a: argparse.Namespace) -> int:
    meta, findings = report.read_report(spark, a.file)
    said = meta.first()
    findings = summaries.in_report_order(findings.withColumn("severity_rank", severity_rank(F.col("severity"))).withColumn("rule_id", F.lit(0))).cache()
    at = lambda name: datetime.fromisoformat(said[name]) if said[name] else datetime.fromtimestamp(0, UTC)
    facts = {k: said[k] or 0 for k in NO_FACTS}
    return written_out(report.Report(findings, counted(findings), facts, [report.type_of(t) for t in said.targets_scanned or ()], at("started_at"), at("completed_at"), "verbose"), a.format, a.output)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="larkspur")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("paths", nargs="*")
    s.add_argument("--home", default="~")
    s.add_argument("--state", default=STATE)
    for name in ("--format", "--min-confidence", "--output"):
        s.add_argument(name)
    for name in ("--no-entropy", "--no-context", "--no-cache", "--show-secrets", "--quiet", "--verbose"):
        s.add_argument(name, action="store_true")
    r = sub.add_parser("report")
    r.add_argument("file")
    r.add_argument("--format", default="terminal")
    r.add_argument("--output")
    i = sub.add_parser("init")
    i.add_argument("--path", default=os.path.expanduser(SETTINGS))
    i.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    try:
        if a.command == "init":
            default_file(a.path, a.force)
            return 0
        spark = SparkSession.builder.getOrCreate()
        return run_report(spark, a) if a.command == "report" else run_scan(spark, a)
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
