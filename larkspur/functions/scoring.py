"""Entropy, context signals, confidence and severity as columns.

Java patterns take the (?dU) flags: Unicode classes, and only \\n ends a line.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import literals

FLAGS = "(?dU)"
# Thresholds and lengths of the entropy test.
ENTROPY_LIMITS = {"hex": (3.0, 32), "base64": (4.5, 20), "alphanumeric": (4.0, 16)}
WINDOW_OVER, WINDOW, ENTROPY_DELTA = 100, 64, 0.10
# Deltas and patterns of the context signals, in the order in which they are added.
KEY_VALUE = (0.20, r"""(?i)(?:[A-Za-z_][A-Za-z0-9_]*\s*=\s*\S|"[^"]+"\s*:\s*(?:"[^"]*"|\S)|[A-Za-z_][A-Za-z0-9_-]*\s*:\s*\S)""")
KEYWORD = (0.15, r"(?i)\b(secret|token|password|api[_-]?key|auth(?:en(?:tication)?|orization)?|credential)")
FILE_NAME = (0.10, r"(?i)^(?:\.env(?:\..+)?|credentials?(?:\.toml)?|secrets?|\.netrc|config\.json|settings\.(?:py|ya?ml)|\.npmrc|\.pypirc|\.pgpass|\.my\.cnf|terraform\.tfvars|vault\.ya?ml)\z")
ASSIGNMENT = (0.10, r"(?i)(?:\bexport\b|\bset\b[^=\n]*=|^\s*[A-Za-z_][A-Za-z0-9_]*\s*=)")
COMMENT = (-0.10, r"^\s*(?:#|//|/\*)")
PLACEHOLDER = (-0.30, r"(?i)example|test|dummy|changeme|your_|xxxx|<[^>]*>|TODO|placeholder")
VERSION_HASH = (-0.20, r"(?i)(?:^v?\d+\.\d+\.\d+|^[0-9a-f]{40}\z|(?:sha256|sha1|md5):[0-9a-f]+)")
URL_SEGMENT = (-0.15, "/")
#: From confidence, highest first.
SEVERITIES = (("critical", 0.90), ("high", 0.70), ("medium", 0.50), ("low", 0.30), ("info", 0.0))
RANK = {name: 4 - k for k, (name, _) in enumerate(SEVERITIES)}


def _charsets(v: Column) -> list[tuple[str, Column]]:
    """(name, whether it fits) of the sets of characters; the first that fits counts."""
    return [
        ("hex", v.rlike(r"^[0-9A-Fa-f]+\z")),
        ("base64", v.rlike(r"^[A-Za-z0-9+/=]+\z") & v.rlike("[+/=]")),
        ("alphanumeric", v.rlike(r"^[A-Za-z0-9]+\z")),
    ]


def charset(v: Column) -> Column:
    out = F
    for name, fits in _charsets(v):
        out = out.when(fits, name)
    return out.otherwise("other")


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def entropy(v: Column) -> Column:
    """Bits per character, summed in character order: of the sorted characters, each run is one character's count."""
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(v, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    shares = _let(F.length(v), lambda n: F.transform(runs, lambda r: F.length(r) / n))
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def _change(window: Column, following: Column) -> Column:
    """What the sum of n log n over the characters of a window changes by when the
    following character comes in and the first one goes: two terms, of their counts."""
    terms = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 1)))
    rest = F.substring(window, 2, WINDOW - 1)
    times = lambda r, c: (WINDOW - 1) - F.length(F.replace(r, c, F.lit("")))
    term = lambda n: F.get(terms, n)
    grown = lambda n: term(n + 1) - term(n)
    return _let(rest, lambda r: _let(times(r, following), grown) - _let(times(r, F.substring(window, 1, 1)), grown))


def widest_entropy(v: Column) -> Column:
    """The largest entropy of the windows of WINDOW characters; of the whole
    value if it has no more.

    A window's entropy falls with the sum of n log n over its characters' counts. That
    sum is rolled along the value by two terms a step; where it is least, the entropy is computed afresh,
    so rounding errors of the steps don't add up in the result.
    """
    last = F.length(v) - WINDOW  # windows start at 1 to last + 1
    places = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    cut = lambda s, i, n: F.substring(s, i, F.lit(n)).cast("string")
    steps = lambda s: F.transform(places, lambda i: _let(cut(s, i, WINDOW), lambda w: _change(w, cut(s, i + WINDOW, 1))))
    # bytes are found by their places, characters by a search from the start
    ascii_only = F.octet_length(v) == F.length(v)
    changes = F.when(ascii_only, _let(F.encode(v, "UTF-8"), steps)).otherwise(steps(v))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("least"), F.lit(1).alias("at"), F.lit(1).alias("here"))

    def step(s: Column, d: Column) -> Column:
        total, here = s["sum"] + d, s["here"] + 1
        less = total < s["least"]
        return F.struct(total.alias("sum"), F.when(less, total).otherwise(s["least"]).alias("least"), F.when(less, here).otherwise(s["at"]).alias("at"), here.alias("here"))

    best = F.aggregate(changes, start, step)["at"]
    return F.when(F.length(v) <= WINDOW, entropy(v)).otherwise(_let(cut(v, best, WINDOW), entropy))


def entropy_delta(v: Column) -> Column:
    """Never below 0. The characters are looked at once, and the entropy is computed only where it can count."""
    n, need = F.octet_length(v), F
    for name, fits in _charsets(v):
        least, length = ENTROPY_LIMITS[name]
        need = need.when(fits, F.when(n >= length, least))
    measured = F.when(n > WINDOW_OVER, widest_entropy(v)).otherwise(entropy(v))
    # on the left, for where it is null the right side isn't computed
    return F.when(need <= measured, ENTROPY_DELTA).otherwise(0.0)


def context_text(before: Column, after: Column) -> Column:
    """The first three context lines as one text for the keyword search."""
    return F.array_join(F.slice(F.concat(before, after), 1, 3), "\x01")


def found(c: Column, regex: str, strings: Sequence[str] = (), folded: Column | None = None) -> Column:
    """Whether a context pattern is found; it is tried only where the folded text holds one of ``strings``, or,
    if there are none, of the strings that the pattern can't do without. ``folded``: the folded text, where it is known."""
    strings = strings or literals.required(regex)[0]
    tried = c.rlike(FLAGS + regex)
    if not strings:
        return tried
    holds = lambda f: reduce(or_, (F.contains(f, F.lit(s)) for s in strings))
    return (_let(literals.folded(c), holds) if folded is None else holds(folded)) & tried


class Texts(NamedTuple):
    """What the context patterns look at, and the same folded."""

    value: Column
    line: Column
    near: Column
    name: Column
    folded_value: Column | None = None
    folded_line: Column | None = None
    folded_near: Column | None = None
    folded_name: Column | None = None


def signals(value: Column, line: Column, before: Column, after: Column, name: Column) -> list[tuple[str, Column]]:
    """(name, whether it fires) of each context signal, in order."""
    return signals_of(Texts(value, line, context_text(before, after), name))


def signals_of(t: Texts) -> list[tuple[str, Column]]:
    """``signals`` of texts that are columns already, which compiled code then reads."""
    at = F.instr(t.line, t.value)
    slash = (F.substring(t.line, at - 1, F.lit(1)) == "/") & (at > 1) | (F.substring(t.line, at + F.length(t.value), F.lit(1)) == "/")
    return [
        ("key_value", found(t.line, KEY_VALUE[1], "=:", t.folded_line)),
        ("keyword", found(t.line, KEYWORD[1], (), t.folded_line) | found(t.near, KEYWORD[1], (), t.folded_near)),
        ("file_name", found(t.name, FILE_NAME[1], (), t.folded_name)),
        ("assignment", found(t.line, ASSIGNMENT[1], (), t.folded_line)),
        ("comment", found(t.line, COMMENT[1], (), t.folded_line)),
        ("placeholder", found(t.value, PLACEHOLDER[1], (), t.folded_value)),
        ("version_hash", found(t.value, VERSION_HASH[1], (), t.folded_value)),
        ("url_segment", (at > 0) & slash),
    ]


DELTAS = {
    "key_value": KEY_VALUE[0], "keyword": KEYWORD[0], "file_name": FILE_NAME[0], "assignment": ASSIGNMENT[0], "comment": COMMENT[0],
    "placeholder": PLACEHOLDER[0], "version_hash": VERSION_HASH[0], "url_segment": URL_SEGMENT[0],
}


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def severity(confidence: Column) -> Column:
    out = F.when(confidence >= SEVERITIES[0][1], SEVERITIES[0][0])
    for name, least in SEVERITIES[1:-1]:
        out = out.when(confidence >= least, name)
    return out.otherwise(SEVERITIES[-1][0])


def severity_rank(name: Column) -> Column:
    out = F.lit(0)
    for k, rank in RANK.items():
        out = F.when(name == k, rank).otherwise(out)
    return out
