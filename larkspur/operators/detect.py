"""Rules over lines: matches, scores, findings. Narrow: nothing is shuffled.

A rule takes the first match in a line: its group 1, or all of it if the regex
has no group. A regex is tried only on lines that hold one of the rule's
literals, which are read off the regex where a rule names none; all regexes are literals of one projection, so each is compiled once
and lines are read once. Rules whose regex can't be compiled are left out with a
warning; the others keep their numbers.

Extensions are functions of columns: ``Signal`` adds to the score where it fires,
and any function of the value can stand in for the entropy measure.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import literals, scoring
from larkspur.functions.patterns import groups
from larkspur.functions.rules import BUILT_IN, Rule, remediation
from larkspur.functions.text import basename, fingerprint, redacted


class Match(NamedTuple):
    """The columns that a signal may look at."""

    value: Column
    line: Column
    context_before: Column
    context_after: Column
    path: Column
    rule: Column


class Signal(NamedTuple):
    """A context signal of one's own: what it adds, and where it fires."""

    name: str
    delta: float
    fires: Callable[[Match], Column]


def holds_literal(rule: Rule, line: Column, folded: Column | None = None) -> Column:
    """Whether a line may match: it holds one of the rule's literals, or, for a rule
    without any, of the strings that its regex can't do without. If there are none,
    the rule is tried on every line. ``folded``: the folded line, where it is known."""
    strings, exactly = (rule.literals, not rule.regex.startswith("(?i)")) if rule.literals else literals.required(rule.regex)
    where = line if exactly else literals.folded(line) if folded is None else folded
    out = F.lit(not strings)
    for s in strings:
        out = out | F.contains(where, F.lit(s))
    return out


def rule_matches(items: DataFrame, rules: Sequence[Rule] = BUILT_IN, candidates: Column | None = None) -> DataFrame:
    """Items with rule_id (from 1), rule and value: a row for each line and rule that match.
    ``candidates``: the ids of the rules that are to be tried on a line, where they are known."""
    line, usable = F.col("line"), {}
    for k, r in enumerate(rules, 1):
        n = groups(scoring.FLAGS + r.regex)
        if n is None:
            warnings.warn(f"rule {r.name!r} is left out, its regex can't be compiled: {r.regex!r}", stacklevel=2)
            continue
        usable[k] = (r, min(n, 1))
    if candidates is None:
        # the line is folded once, compiled code looks for all literals, and only the rules that it may match go on
        ids = [F.when(holds_literal(r, line, F.col("__folded")), F.lit(k)) for k, (r, _) in usable.items()]
        tried = items.withColumn("__folded", literals.folded(line)).select(*items.columns, F.array(*ids).cast("array<int>").alias("__tried"))
        candidates = F.col("__tried")
    else:
        tried = items
    # outer, for a filter on empty arrays would look for all literals once more
    tried = tried.select(*items.columns, F.explode_outer(candidates).alias("rule_id")).where(F.col("rule_id").isin(list(usable)))

    def value(k: Column) -> Column:
        out = F
        for at, (r, n) in usable.items():
            out = out.when(k == at, F.regexp_extract(line, scoring.FLAGS + r.regex, n))
        return out if usable else F.lit(None).cast("string")

    # inside of a function of arrays only the regex of the row's own rule is read, and none is part of the compiled code
    hits = F.filter(F.transform(F.array("rule_id"), value), lambda v: v != "")
    of_rule = F.element_at(F.array(*(F.lit(r.name) for r in rules)), F.col("rule_id"))
    return tried.select(*items.columns, "rule_id", of_rule.alias("rule"), F.explode(hits).alias("value"))


def scored(
    matches: DataFrame, rules: Sequence[Rule] = BUILT_IN, use_entropy: bool = True, use_context: bool = True,
    entropy: Callable[[Column], Column] = scoring.entropy_delta, more: Sequence[Signal] = (), least: float | None = None,
) -> DataFrame:
    """Matches with confidence (unrounded), severity and severity_rank. ``least``: matches of less
    confidence are left out, and where the other terms reach it, the entropy isn't computed to know."""
    base = F.element_at(F.array(*(F.lit(r.confidence) for r in rules)), F.col("rule_id"))
    found, deltas = matches, []
    if use_context:
        # texts are columns before they are looked at, so that compiled code looks at them
        texts = {"value": F.col("value"), "line": F.col("line"), "near": scoring.context_text(F.col("context_before"), F.col("context_after")), "name": basename(F.col("path"))}
        found = found.select("*", *(c.alias(f"__{k}") for k, c in texts.items()))
        found = found.select("*", *(literals.folded(F.col(f"__{k}")).alias(f"__folded_{k}") for k in texts))
        given = scoring.Texts(*(F.col(f"__{k}") for k in texts), *(F.col(f"__folded_{k}") for k in texts))
        own = Match(*map(F.col, ("value", "line", "context_before", "context_after", "path", "rule")))
        fires = [(c, scoring.DELTAS[k]) for k, c in scoring.signals_of(given)] + [(s.fires(own), float(s.delta)) for s in more]
        deltas = [F.col(f"__delta{k}") for k in range(len(fires))]
        # through a generator, so that filters on sums don't compute their terms again
        found = found.select("*", F.inline(F.array(F.struct(*(F.when(c, d).otherwise(0.0).alias(f"__delta{k}") for k, (c, d) in enumerate(fires))))))
    bare = scoring.clamped(sum(deltas, base))
    full = scoring.clamped(sum(deltas, base + entropy(F.col("value")))) if use_entropy else bare
    # the built-in measure only adds, and sums of doubles keep the order of their terms
    adds = use_entropy and entropy is scoring.entropy_delta
    confidence = F.when(bare >= 1.0, 1.0).otherwise(full) if adds else full
    if least is None:
        # through a generator again, for filters on the confidence
        found = found.withColumn("__confidence", confidence)
        out = found.select(*matches.columns, F.inline(F.array(F.struct(F.col("__confidence").alias("confidence")))))
    else:
        enough = (bare >= least) | (full >= least) if adds else full >= least
        out = found.where(enough).select(*matches.columns, confidence.alias("confidence"))
    out = out.withColumn("severity", scoring.severity(F.col("confidence")))
    return out.withColumn("severity_rank", scoring.severity_rank(F.col("severity")))


def findings(items: DataFrame, rules: Sequence[Rule] = BUILT_IN, full: bool = True, redact: bool = True, use_entropy: bool | None = None, use_context: bool | None = None, **extensions) -> DataFrame:
    """Lines -> findings. ``full=False`` scores by the rule alone; ``entropy`` and ``more`` are those of ``scored``."""
    use_entropy, use_context = (full if x is None else x for x in (use_entropy, use_context))
    found = scored(rule_matches(items, rules), rules, use_entropy, use_context, **extensions)
    of_rule = lambda what: F.element_at(F.array(*(F.lit(what(r)) for r in rules)), F.col("rule_id"))
    return found.select(
        fingerprint(F.col("path"), F.col("line_number"), F.col("rule")).alias("id"),
        of_rule(lambda r: r.secret_type).alias("secret_type"),
        "severity",
        "severity_rank",
        "confidence",
        (redacted(F.col("value")) if redact else F.col("value")).alias("value"),
        "path",
        "line_number",
        F.array_join("context_before", "\n").alias("context_before"),
        F.array_join("context_after", "\n").alias("context_after"),
        "source_type",
        F.concat(of_rule(lambda r: r.description), F.lit(" found in "), F.col("path")).alias("description"),
        of_rule(remediation).alias("remediation"),
        F.col("rule").alias("matched_pattern"),
        "rule_id",
    )
