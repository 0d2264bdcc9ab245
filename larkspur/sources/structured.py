"""Structured files -> leaves (key_path, value, line_number) -> items.

Flattening needs recursion, which SQL expressions don't have: files are parsed
in tasks by the standard parsers, file by file, and everything after that is
columns again. netrc is walked in the same way, pgpass is columns only.
"""

from __future__ import annotations

import datetime
import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import extension, line_of, lines, truncated
from larkspur.operators.lines import numbered, with_context
from larkspur.runtime import ensure_importable

Leaf = tuple[str, str]
FORMATS = {"json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini", "conf": "ini", "cnf": "ini"}


def scalar(v: object) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (datetime.datetime, datetime.date, datetime.time)):
        return v.isoformat()
    return v if isinstance(v, str) else json.dumps(v) if isinstance(v, float) else str(v)


def leaves(v: object, path: str) -> Iterator[Leaf]:
    """Leaves of a tree, keys sorted, nulls left out."""
    todo = [(path, v)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{scalar(k)}" if path else scalar(k), v[k]) for k in sorted(v, key=str, reverse=True)]
        elif isinstance(v, list):
            todo += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif v is not None:
            yield path, scalar(v)


def json_leaves(text: str) -> list[Leaf]:
    return list(leaves(json.loads(text), ""))


def _yaml_value(loader: yaml.SafeLoader, node: yaml.ScalarNode) -> object:
    """A scalar; an unknown tag counts for nothing."""
    tag = node.tag
    if tag not in loader.yaml_constructors:
        tag = loader.resolve(yaml.ScalarNode, node.value, (node.style is None, node.style is not None))
    return loader.construct_object(yaml.ScalarNode(tag, node.value, node.start_mark, node.end_mark, node.style))


def _yaml_key(loader: yaml.SafeLoader, node: yaml.Node) -> str:
    if isinstance(node, yaml.ScalarNode):
        value = _yaml_value(loader, node)
        return "null" if value is None else scalar(value)
    if isinstance(node, yaml.SequenceNode):
        return "[" + ", ".join(_yaml_key(loader, x) for x in node.value) + "]"
    return "{" + ", ".join(f"{_yaml_key(loader, k)}: {_yaml_key(loader, v)}" for k, v in node.value) + "}"


def yaml_leaves(text: str) -> list[Leaf]:
    """Leaves of all documents in order, from nodes: keys may be of any kind, tags are taken off."""
    loader, out = yaml.SafeLoader(text), []

    def walk(node: yaml.Node, path: str, above: frozenset[int]) -> None:
        if id(node) in above:
            raise ValueError("an anchor that holds itself")
        above = above | {id(node)}
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                key = _yaml_key(loader, k)
                walk(v, f"{path}.{key}" if path else key, above)
        elif isinstance(node, yaml.SequenceNode):
            for i, x in enumerate(node.value):
                walk(x, f"{path}[{i}]", above)
        elif (value := _yaml_value(loader, node)) is not None:
            out.append((path, scalar(value)))

    try:
        while loader.check_node():
            walk(loader.get_node(), "", frozenset())
    finally:
        loader.dispose()
    return out


def toml_leaves(text: str) -> list[Leaf]:
    return list(leaves(tomllib.loads(text), ""))


def ini_leaves(text: str) -> list[Leaf]:
    out, section = [], ""
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
        elif line and line[0] not in ";#" and (m := re.match(r"([^=:]+?)\s*[=:]\s*(.*)\Z", line)):
            value = m[2]
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            out.append((f"{section}.{m[1]}" if section else m[1], value))
    return out


NETRC_KEYS = ("login", "password", "account")


def netrc_leaves(text: str) -> list[tuple[str, str, int]]:
    """Tokens of netrc, with the line of each value; macros are skipped."""
    tokens, in_macro = [], False
    for n, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        if in_macro:
            in_macro = bool(bare)
        elif bare.startswith("macdef"):
            in_macro = True
        elif not bare.startswith("#"):
            tokens += [(word, n) for word in bare.split()]
    out, host, at = [], "unknown", 0
    while at < len(tokens):
        word, following = tokens[at][0], tokens[at + 1] if at + 1 < len(tokens) else None
        if word == "default":
            host = "default"
        elif following and word == "machine":
            host, at = following[0], at + 1
        elif following and word in NETRC_KEYS:
            out.append((f"machine.{host}.{word}", *following))
            at += 1
        at += 1
    return out


PARSERS = {"json": json_leaves, "yaml": yaml_leaves, "toml": toml_leaves, "ini": ini_leaves}
LEAVES = "array<struct<key_path:string,value:string,line_number:int>>"
ARROW = pa.list_(pa.struct([("key_path", pa.string()), ("value", pa.string()), ("line_number", pa.int32())]))


def _parsed(texts: pa.Array, formats: pa.Array) -> pa.Array:
    out = []
    for text, kind in zip(texts.to_pylist(), formats.to_pylist(), strict=True):
        found = None
        try:
            if kind == "netrc":
                found = netrc_leaves(text or "")
            elif kind in PARSERS:
                found = [(k, v, None) for k, v in PARSERS[kind](text or "")]
        except (ValueError, yaml.YAMLError, RecursionError):
            found = None  # not of that format: its lines are scanned instead
        out.append([{"key_path": k, "value": v, "line_number": n} for k, v, n in found] if found else None)
    return pa.array(out, ARROW)


def file_format(path: Column, hint: Column) -> Column:
    """By extension, else by hint (json, yaml, toml, ini, netrc, pgpass), else null."""
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.coalesce(F.element_at(known, extension(path)), hint)


def pgpass_leaves(text: Column) -> Column:
    """host:port:database.username and .password of lines with five fields."""
    fields = lambda s: F.transform(F.split(F.replace(F.replace(s, F.lit("\\\\"), F.lit("\x01")), F.lit("\\:"), F.lit("\x02")), ":"), lambda f: F.replace(F.replace(f, F.lit("\x01"), F.lit("\\")), F.lit("\x02"), F.lit(":")))
    rows = F.transform(lines(text), lambda s, i: F.struct((i + 1).cast("int").alias("n"), F.trim(s).alias("s")))
    rows = F.filter(rows, lambda r: (r["s"] != "") & ~r["s"].startswith("#") & (F.size(fields(r["s"])) == 5))
    entry = lambda r, k, what: F.struct(F.concat(F.concat_ws(":", F.slice(fields(r["s"]), 1, 3)), F.lit(what)).alias("key_path"), fields(r["s"])[k].alias("value"), r["n"].alias("line_number"))
    return F.flatten(F.transform(rows, lambda r: F.array(entry(r, 3, ".username"), entry(r, 4, ".password")))).cast(LEAVES)


def entries(files: DataFrame) -> DataFrame:
    """Files (path, text, format) with their leaves; null where lines do."""
    ensure_importable(files.sparkSession)
    tree = F.arrow_udf(_parsed, LEAVES)("text", "format")
    numbered_ = F.transform(tree, lambda x: F.struct(x["key_path"].alias("key_path"), x["value"].alias("value"), F.coalesce(x["line_number"], line_of(F.col("text"), x["value"])).cast("int").alias("line_number")))
    found = F.when(F.col("format") == "pgpass", pgpass_leaves(F.col("text"))).otherwise(numbered_)
    return files.withColumn("leaves", F.when(F.size(found) > 0, found))


def structured_items(files: DataFrame) -> DataFrame:
    """Leaves as lines ``key: value``; files that can't be parsed as lines."""
    rows = entries(files)
    as_lines = F.transform("leaves", lambda x: F.struct(x["line_number"].alias("line_number"), truncated(F.concat(x["key_path"], F.lit(": "), x["value"])).alias("line")))
    plain = F.transform(numbered(lines(F.col("text"))), lambda x: F.struct(x["line_number"].cast("int").alias("line_number"), x["line"].alias("line")))
    return with_context(rows, F.coalesce(as_lines, plain), ["path", "source_type"])
