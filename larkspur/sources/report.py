"""Reports: JSON out and in, plain text and HTML out.

Rows are made in tasks and come to the writer one task at a time, so a report may be
larger than the driver's memory. A reporter is a function of a ``Report`` that gives
the parts of its text; ``REPORTERS`` has the built-in ones by format.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scoring
from larkspur.functions.text import home_shortened, html_escaped
from larkspur.operators.summaries import shown

VERSION = "0.1.0"
FINDING = (
    "struct<id:string,secret_type:string,severity:string,confidence:double,value:string,"
    "location:struct<path:string,line:int,source_type:string>,description:string,remediation:string>"
)
REPORT = (
    "version string, scan struct<started_at:string,completed_at:string,files_scanned:bigint,files_cached:bigint,bytes_scanned:bigint,targets_scanned:array<string>>,"
    f"summary struct<critical:bigint,high:bigint,medium:bigint,low:bigint,info:bigint>, findings array<{FINDING}>"
)
#: What reports call the sources.
SOURCE_NAMES = {
    "shell_history": "shell_history", "dotfile": "dotfile", "env_file": "env_file", "cloud_config": "cloud_config", "ssh_key": "ssh_key",
    "application_config": "app_config", "clipboard": "clipboard", "browser_storage": "browser_storage",
}
#: Names that earlier reports of this library have.
OLDER_NAMES = {"application_config": "application_config"}


def source_name(source_type: Column) -> Column:
    """What a report calls a source; sources of one's own keep their names."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SOURCE_NAMES.items() for x in pair)), source_type), source_type)


def source_type(name: Column) -> Column:
    """The source that a report calls so, or null."""
    back = {v: k for k, v in SOURCE_NAMES.items()} | OLDER_NAMES
    return F.element_at(F.create_map(*(F.lit(x) for pair in back.items() for x in pair)), name)


def type_of(name: str) -> str:
    """``source_type`` for one name; unknown ones stay."""
    return next((k for k, v in SOURCE_NAMES.items() if v == name), name)


def finding_rows(findings: DataFrame) -> DataFrame:
    """A JSON object for each finding; a report is written row by row. A finding without a line has ``"line":null``."""
    where = F.struct(F.col("path"), F.col("line_number").alias("line"), source_name(F.col("source_type")).alias("source_type"))
    row = F.struct("id", "secret_type", "severity", "confidence", "value", where.alias("location"), "description", "remediation")
    return findings.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("finding"))


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON lines, by as many tasks as there are partitions."""
    finding_rows(findings).write.text(path)


def parse_findings(rows: DataFrame) -> DataFrame:
    """Rows of JSON -> findings; severity follows the confidence again, and
    findings with an unknown source or without the fields needed are dropped."""
    # through a generator, so that a row is parsed (and what it is made of computed) once, not for each field that a filter asks for
    rows = rows.select(F.inline(F.array(F.from_json("finding", FINDING)))).withColumn("source_type", source_type(F.col("location.source_type")))
    rows = rows.where("id is not null and confidence is not null and location.path is not null and source_type is not null")
    return rows.select(
        "id", "secret_type", scoring.severity(F.col("confidence")).alias("severity"), "confidence", "value",
        F.col("location.path").alias("path"), F.col("location.line").alias("line_number"), "source_type", "description", "remediation",
    )


#: Findings are elements of an array in an object: indented by four.
INDENT = "    "


def _own_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").startswith(INDENT + "{") & (F.length("value") > len(INDENT) + 1))


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, findings) of a saved single-document report.

    Reports with a finding on each line, as they are written here, and indented ones are read in
    parallel, finding by finding, however large they are; of their other lines few are
    left. Any other layout is read as one row.
    """
    lines = spark.read.text(path)
    rows = None
    if _own_lines(lines).head(1):
        rows = _own_lines(lines).select(F.rtrim("value", F.lit(",")).alias("finding"))
        rest = lines.where(~F.col("value").startswith(INDENT + "{"))
    elif lines.where(F.col("value") == INDENT + "{").head(1):
        # an element ends with a brace at its own depth; strings hold no raw line ends
        parts = spark.read.option("lineSep", f"\n{INDENT}}}").text(path)
        parts = parts.where(F.contains("value", F.lit(f"\n{INDENT}{{")))
        rows = parts.select(F.concat(F.lit("{"), F.substring_index("value", f"\n{INDENT}{{", -1), F.lit("}")).alias("finding"))
        deeper = F.col("value").rlike(r"^ {8}|^ {4}[{}]|^ {6}([}]|\x22[a-z_]+\x22:)")
        rest = lines.where(~deeper)
    if rows is None:
        doc = spark.read.schema(REPORT).option("multiLine", True).json(path)
        rows = doc.select(F.explode("findings").alias("f")).select(F.to_json("f").alias("finding"))
    else:
        head = "\n".join(r.value for r in rest.collect())  # the lines of the document that aren't findings
        doc = spark.createDataFrame([(head,)], "value string").select(F.from_json("value", REPORT).alias("d")).select("d.*")
    meta = doc.select("version", "scan.*", "summary").withColumn("files_cached", F.coalesce("files_cached", F.lit(0)))
    return meta, parse_findings(rows)


def write_report(r: Report, path: str) -> None:
    """A report by tasks: ``path``/findings has its parts in report order, a finding on each line, and
    ``path``/head the rest of the document. ``joined`` makes one document of them."""
    spark = r.findings.sparkSession
    finding_rows(r.findings).write.text(f"{path}/findings")
    head, _ = _around(r)
    spark.createDataFrame([(head,)], "head string").coalesce(1).write.parquet(f"{path}/head")


def joined(spark: SparkSession, path: str) -> Iterator[str]:
    """The document of a report written by tasks, part after part."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{path}/findings")
    parts = sorted(str(x.getPath()) for x in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root) if x.getPath().getName().startswith("part-"))
    yield spark.read.parquet(f"{path}/head").first().head
    first = True
    for part in parts:
        for row in spark.read.text(part).toLocalIterator():
            yield ("" if first else ",") + f"\n{INDENT}" + row.value
            first = False
    yield END


def label(name: Column) -> Column:
    """A type or source as a reader sees it: ``aws-access-key-id`` as Aws Access Key Id."""
    return F.initcap(F.translate(name, "-_", "  "))


def text_lines(findings: DataFrame, home: str = "") -> DataFrame:
    """(severity, line): a line of plain text for each finding."""
    path = home_shortened(F.col("path"), home) if home else F.col("path")
    place = F.concat(path, F.coalesce(F.concat(F.lit(":"), F.col("line_number").cast("string")), F.lit("")))
    return findings.select("severity", F.concat_ws("  ", F.format_string("%3d%%", F.round(F.col("confidence") * 100).cast("int")), label(F.col("secret_type")), place, "value").alias("line"))


def html_rows(findings: DataFrame) -> DataFrame:
    """A table row of HTML for each finding, escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), html_escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>"))
    cells = [cell(c) for c in (label(F.col("severity")), label(F.col("secret_type")), F.round(F.col("confidence"), 2), F.col("path"), F.col("line_number"), label(F.col("source_type")), F.col("value"), F.col("description"), F.col("remediation"))]
    return findings.select(F.concat(F.lit('<tr class="'), F.col("severity"), F.lit('">'), *cells, F.lit("</tr>")).alias("html"))


class Report(NamedTuple):
    """Findings in report order, and what is said about the scan."""

    findings: DataFrame
    counts: dict[str, int]
    facts: dict[str, int]
    targets: list[str]
    started_at: datetime
    completed_at: datetime
    verbosity: str = "normal"
    home: str = ""

    @property
    def seconds(self) -> float:
        return (self.completed_at - self.started_at).total_seconds()


END = "\n  ]\n}\n"


def _around(r: Report) -> tuple[str, str]:
    """What comes before and after the findings of a document."""
    scan = {"started_at": r.started_at.isoformat(), "completed_at": r.completed_at.isoformat(), **r.facts, "targets_scanned": [SOURCE_NAMES.get(t, t) for t in r.targets]}
    head = json.dumps({"version": VERSION, "scan": scan, "summary": r.counts}, indent=2)
    return head.removesuffix("\n}") + ',\n  "findings": [', END


def json_report(r: Report) -> Iterator[str]:
    head, end = _around(r)
    yield head
    for k, row in enumerate(finding_rows(r.findings).toLocalIterator()):
        yield ("," if k else "") + f"\n{INDENT}" + row.finding
    yield end


def terminal_report(r: Report) -> Iterator[str]:
    yield f"larkspur {VERSION}\n"
    yield f"Sources: {', '.join(r.targets) or 'none'}\n"
    yield f"Files: {r.facts['files_scanned']} ({r.facts['files_cached']} cached), {r.facts['bytes_scanned']} bytes, {r.seconds:.1f} s\n"
    severity = None
    for row in text_lines(shown(r.findings, r.verbosity), r.home).toLocalIterator():
        if row.severity != severity:
            severity = row.severity
            yield f"\n{severity.upper()} ({r.counts[severity]})\n"
        yield f"  {row.line}\n"
    hidden = r.counts["low"] + r.counts["info"] if r.verbosity == "normal" else 0
    yield "\n" + ", ".join(f"{v} {k}" for k, v in r.counts.items()) + (f" ({hidden} hidden)" if hidden else "") + "\n"


PAGE = """<!doctype html><meta charset="utf-8"><title>Findings</title>
<style>body{font:14px sans-serif}td{padding:.2em .6em;border-bottom:1px solid #ddd}tr.critical{background:#fdd}tr.high{background:#fed}</style>
<script>function show(){const q=document.querySelector('#q').value.toLowerCase();
for(const r of document.querySelectorAll('tr'))r.hidden=!r.textContent.toLowerCase().includes(q)||!document.querySelector('#'+r.className).checked}</script>
<input id="q" placeholder="search" oninput="show()">
"""


def html_report(r: Report) -> Iterator[str]:
    yield PAGE
    yield "".join(f'<label><input type="checkbox" id="{k}" checked onchange="show()">{k} ({v})</label> ' for k, v in r.counts.items())
    yield f"<p>{r.facts['files_scanned']} files, {r.facts['files_cached']} cached, {r.seconds:.1f} s</p><table>\n"
    for row in html_rows(r.findings).toLocalIterator():
        yield row.html + "\n"
    yield "</table>\n"


REPORTERS: dict[str, Callable[[Report], Iterable[str]]] = {"terminal": terminal_report, "json": json_report, "html": html_report}


def save(path: str, parts: Iterable[str]) -> None:
    """Write a report that only its owner can read."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        os.fchmod(f.fileno(), 0o600)
        f.writelines([parts] if isinstance(parts, str) else parts)
