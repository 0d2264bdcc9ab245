"""Shell histories -> commands, as array expressions: one row per file, no shuffle.

Commands of several lines are found by where they start and end, so a file takes
time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import lines, truncated
from larkspur.operators.lines import with_context


def _numbered(text: Column) -> Column:
    return F.transform(lines(text), lambda s, i: F.struct((i + 1).cast("int").alias("line_number"), s.alias("line")))


def bash_commands(text: Column) -> Column:
    """Lines without empty ones; #<digits> lines are timestamps and go."""
    all_ = _numbered(text)
    is_time = lambda x: x["line"].rlike(r"^#[0-9]+\z")
    return F.filter(all_, lambda x: (x["line"] != "") & ~is_time(x))


def without_timestamp(line: Column) -> Column:
    return F.regexp_replace(line, r"^: [0-9]+:[0-9]+;", "")


def _spans(at: Column, ends: Column, command) -> Column:
    """command(first, last) for each pair of places in the two arrays."""
    return F.zip_with(at, ends, lambda i, j: F.struct(i.cast("int").alias("line_number"), command(i, j).alias("line")))


def _places(rows: Column, which) -> Column:
    """Places, from 1, of the lines that are asked for."""
    all_ = F.filter(F.sequence(F.lit(0), F.size(rows)), lambda i: i > 0)
    return F.filter(all_, lambda i: which(i))


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def zsh_commands(text: Column) -> Column:
    """Commands that end with a backslash go on in the next line."""
    return _let(F.transform(lines(text), without_timestamp), _zsh)


def _zsh(rows: Column) -> Column:
    goes_on = lambda i: F.coalesce(F.get(rows, i - 1).endswith("\\"), F.lit(False))
    bare = lambda line: F.when(line.endswith("\\"), F.left(line, F.length(line) - 1)).otherwise(line)
    starts = _places(rows, lambda i: (i == 1) | ~goes_on(i - 1))
    ends = _places(rows, lambda i: (i == F.size(rows)) | ~goes_on(i))
    commands = _spans(starts, ends, lambda i, j: F.array_join(F.transform(F.slice(rows, i, j - i + 1), bare), "\n"))
    return F.filter(commands, lambda x: x["line"] != "")


def fish_commands(text: Column) -> Column:
    """``- cmd:`` entries with their indented continuation lines, up to a line of metadata."""
    return _let(lines(text), lambda rows: _let(_places(rows, lambda i: F.get(rows, i - 1).startswith("- ")), lambda entries: _fish(rows, entries)))


def _fish(rows: Column, entries: Column) -> Column:
    ends = F.concat(F.transform(F.slice(entries, F.lit(2), F.greatest(F.size(entries) - 1, F.lit(0))), lambda i: i - 1), F.when(F.size(entries) > 0, F.array(F.size(rows))).otherwise(F.array().cast("array<int>")))

    def command(i: Column, j: Column) -> Column:
        first, rest = F.get(rows, i - 1), F.slice(rows, i + 1, j - i)
        meta = F.array_position(F.transform(rest, lambda s: s.startswith("  when:") | s.startswith("  paths:")), True).cast("int")
        rest = F.when(meta > 0, F.slice(rest, F.lit(1), meta - 1)).otherwise(rest)
        more = F.filter(rest, lambda s: s.startswith("  ") & ~s.startswith("    - "))
        more = F.transform(more, lambda s: F.regexp_replace(s, r"^(?U)\s+", ""))
        return F.when(first.startswith("- cmd: "), F.array_join(F.concat(F.array(first.substr(F.lit(8), F.length(first))), more), "\n"))

    return F.filter(_spans(entries, ends, command), lambda x: x["line"].isNotNull())


PARSERS = {"bash": bash_commands, "zsh": zsh_commands, "fish": fish_commands}
#: Where the shells keep their histories, below the home folder.
FILES = {"bash": ".bash_history", "zsh": ".zsh_history", "fish": ".local/share/fish/fish_history"}


def history_items(files: DataFrame, shell: str) -> DataFrame:
    """Files (path, text) -> items whose context is the neighbouring commands."""
    commands = F.transform(PARSERS[shell](F.col("text")), lambda x: F.struct(x["line_number"].alias("line_number"), truncated(x["line"]).alias("line")))
    return with_context(files.withColumn("source_type", F.lit("shell_history")), commands, ["path", "source_type"])
