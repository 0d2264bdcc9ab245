"""Columns over paths and lines. Byte limits count UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINE_BYTES = 4096
CUT = "  [truncated]"
CONTEXT = 2


def lines(text: Column) -> Column:
    """Lines of a text: split at \\n, one \\r before it dropped, no empty last line."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def truncated(line: Column) -> Column:
    """Lines of more than MAX_LINE_BYTES bytes, cut back to a whole character."""
    data = F.encode(line, "UTF-8")
    inside = lambda n: F.hex(F.substring(data, n, 1)).between("80", "BF")
    n = MAX_LINE_BYTES
    end = F.when(~inside(n + 1), n).when(~inside(n), n - 1).when(~inside(n - 1), n - 2).otherwise(n - 3)
    cut = F.concat(F.decode(data.substr(F.lit(1), end), "UTF-8"), F.lit(CUT))
    return F.when(F.octet_length(line) > n, cut).otherwise(line)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension; a leading dot starts none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)\z", 1))


def is_env_name(name: Column) -> Column:
    return (name == ".env") | name.startswith(".env.") | (name.endswith(".env") & (F.octet_length(name) > 4))


def below(path: Column, folder: str) -> Column:
    """Whether path is folder or inside it, by whole components."""
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/")


def home_shortened(path: Column, home: str) -> Column:
    return F.when(path.startswith(home), F.concat(F.lit("~"), path.substr(F.lit(len(home) + 1), F.length(path)))).otherwise(path)


def html_escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def redacted(value: Column) -> Column:
    """First and last four characters of values of 12 bytes or more."""
    n = F.octet_length(value)
    return F.when(n >= 12, F.concat(F.left(value, F.lit(4)), F.lit("****"), F.right(value, F.lit(4)))).otherwise(F.repeat(F.lit("*"), n))


def fingerprint(path: Column, line: Column, pattern: Column) -> Column:
    key = F.concat_ws(":", path, F.coalesce(line, F.lit(0)).cast("string"), F.coalesce(pattern, F.lit("")))
    return F.concat(F.lit("sha256:"), F.sha2(key, 256))


def line_of(text: Column, value: Column) -> Column:
    """Line of the first occurrence of a value; 1 if empty or absent."""
    at = F.instr(text, value)
    before = F.left(text, at - 1)
    found = 1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when((value == "") | (at == 0), F.lit(1)).otherwise(found)
