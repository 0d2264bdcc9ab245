"""What a line must hold for a regex to match it, read off the regex's syntax tree.

``required`` gives strings of which every match holds at least one; ``trigrams``
gives a condition on the three-letter pieces of a line, as nested ANDs and ORs.
Both are sound: a line that fails them can't match. They are no more than
that, so a line that passes may still not match.

Regexes are in Java's dialect and the tree is Python's. Where the two read a
pattern differently, or Python can't read it, nothing is known: then every line
may match. With (?i), a line and the strings are compared in folded form
(``folded``), in which every letter that Java takes for an ASCII letter is that letter.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from functools import lru_cache
from re import _constants as op
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exact strings that a part of a regex may stand for, and members of a class that are spelled out.
MOST_EXACT, MOST_MEMBERS = 64, 16
#: A run of strings is cut when it gets longer: more letters make no line rarer.
LONGEST = 64
# Estimated cost, in microseconds a line, of one search for a string and of trying a regex, and how
# many lines hold a given string of so many letters.
SEARCH, TRY = 0.02, 0.3
SHARE = (1.0, 0.3, 0.05, 0.01, 0.001, 0.0001)
#: Letters beyond ASCII that Java's case-insensitive matching takes for ASCII ones, after lower-casing.
ALIKE = {"ſ": "s", "ı": "i", "K": "k", "̇": ""}


def fold(s: str) -> str:
    return "".join(ALIKE.get(c, c) for c in s.lower())


def folded(line: Column) -> Column:
    """``fold`` as a column; İ lower-cases to i and a dot above, which goes."""
    letters = [k for k, v in ALIKE.items() if v] + [k for k, v in ALIKE.items() if not v]
    lower = F.lower(line)
    # ASCII lines, which are most, hold none of those letters
    return F.when(F.octet_length(line) == F.length(line), lower).otherwise(F.translate(lower, "".join(letters), "".join(v for v in ALIKE.values() if v)))


class Part(NamedTuple):
    """What is known of a part of a regex: all strings that it can be (or None), and
    conditions of which each match meets all: sets of strings, one of which it holds."""

    exact: frozenset[str] | None
    needs: tuple[frozenset[str], ...] = ()


EMPTY, ANYTHING = Part(frozenset({""})), Part(None)


#: A class with another one in it (a union in Java), or with && (an intersection).
OWN_CLASSES = re.compile(r"\[(?:\\.|[^\]\\\[])+\[|&&", re.DOTALL)


@lru_cache(maxsize=1024)
def _tree(regex: str):
    """(tree, whether case counts), or None where the two dialects may differ."""
    # named groups are written in another way
    python = re.sub(r"\(\?<(?![=!])", "(?P<", regex)
    if OWN_CLASSES.search(re.sub(r"\\[^dDwWsSbBAzZ]", "..", python)):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = parser.parse(python)
    except (re.error, Warning, RecursionError, OverflowError, ValueError):
        return None
    if tree.state.flags & re.VERBOSE:
        return None
    return tree, not tree.state.flags & re.IGNORECASE


def _letters(codes: Iterable[int], exactly: bool) -> Part:
    """One character out of several."""
    chars = [chr(c) for c in codes]
    if not exactly:
        if any(ord(c) > 127 for c in chars):
            return ANYTHING  # too many letters are alike to some of these
        chars = [fold(c) for c in chars]
    return Part(frozenset(chars)) if len(set(chars)) <= MOST_MEMBERS else ANYTHING


def _members(items: Sequence, exactly: bool) -> Part:
    codes: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes.add(value)
        elif kind is op.RANGE and value[1] - value[0] < 4 * MOST_MEMBERS:
            codes.update(range(value[0], value[1] + 1))
        else:
            return ANYTHING  # negated, or a class of many
    return _letters(sorted(codes), exactly)


def _and(parts: Iterable[Part]) -> Part:
    """One part after the other. Neighbours of which all strings are known make longer strings."""
    run, needs, whole, plain = frozenset({""}), [], True, ""

    def close():
        if run != {""}:
            needs.append(run)

    for p in parts:
        needs += p.needs
        # letters that come one after the other may be worth more alone than with what surrounds them
        only = next(iter(p.exact)) if p.exact is not None and len(p.exact) == 1 else None
        if only is None and len(plain) > 1:
            needs.append(frozenset({plain}))
        plain = "" if only is None else plain + only
        if p.exact is None:
            close()
            run, whole = frozenset({""}), False
        elif len(run) * len(p.exact) <= MOST_EXACT and max(map(len, run)) <= LONGEST:
            run = frozenset(a + b for a in run for b in p.exact)
        else:
            close()
            run, whole = p.exact, False
    if len(plain) > 1:
        needs.append(frozenset({plain}))
    if whole:
        return Part(run, tuple(needs))
    close()
    return Part(None, tuple(needs))


def _or(parts: Sequence[Part]) -> Part:
    exact = None
    if all(p.exact is not None for p in parts):
        both = frozenset().union(*(p.exact for p in parts))
        exact = both if len(both) <= MOST_EXACT else None
    if exact is not None:
        return Part(exact)
    sides = [_best(p) for p in parts]
    if any(not s for s in sides):
        return ANYTHING
    return Part(None, (frozenset().union(*sides),))


def _times(p: Part, least: int, most: int) -> Part:
    if least == 0:
        if most == 1 and p.exact is not None and len(p.exact) < MOST_EXACT:
            return Part(p.exact | {""})
        return ANYTHING
    if least == most and p.exact is not None:
        return _and([p] * least) if least <= LONGEST and len(p.exact) ** least <= MOST_EXACT else Part(None, _and([p] * min(least, LONGEST)).needs)
    if p.exact is None:
        return p._replace(exact=None)
    return Part(None, _and([*[p] * min(least, LONGEST), ANYTHING]).needs)


def _part(tree, exactly: bool) -> Part:
    return _and(_one(kind, value, exactly) for kind, value in tree)


def _one(kind, value, exactly: bool) -> Part:
    if kind is op.LITERAL:
        return _letters([value], exactly)
    if kind is op.IN:
        return _members(value, exactly)
    if kind is op.SUBPATTERN:
        _, more, fewer, inner = value
        exactly = (exactly or bool(fewer & re.IGNORECASE)) and not more & re.IGNORECASE
        return _part(inner, exactly)
    if kind is op.ATOMIC_GROUP:
        return _part(value, exactly)
    if kind is op.BRANCH:
        return _or([_part(inner, exactly) for inner in value[1]])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        return _times(_part(inner, exactly), least, most)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return EMPTY
    return ANYTHING  # any character, negated ones, back references


def _least(strings: frozenset[str]) -> frozenset[str]:
    """Without strings that hold another one."""
    return frozenset(s for s in strings if not any(t != s and t in s for t in strings))


def _cost(strings: frozenset[str]) -> float:
    return len(strings) * SEARCH + TRY * min(1.0, sum(SHARE[min(len(s), len(SHARE) - 1)] for s in strings))


def _best(p: Part) -> frozenset[str]:
    """The cheapest condition that every match meets, or none."""
    sets = [_least(s) for s in (*p.needs, *([p.exact] if p.exact is not None else []))]
    sets = [s for s in sets if s and "" not in s]
    return min(sets, key=lambda s: (_cost(s), sorted(s)), default=frozenset())


def _known(regex: str) -> tuple[Part, bool] | None:
    read = _tree(regex)
    if read is None:
        return None
    tree, exactly = read
    try:
        # strings of groups with flags of their own are folded alone: then all are
        mixed = not exactly or "(?i" in regex
        return _part(tree, not mixed), not mixed
    except RecursionError:
        return None


def required(regex: str) -> tuple[tuple[str, ...], bool]:
    """(strings, whether case counts): every match holds one of them; no strings if nothing is known.
    Where case doesn't count, the folded line holds one."""
    known = _known(regex)
    if known is None:
        return (), True
    part, exactly = known
    best = _best(part)
    return (tuple(sorted(best)), exactly) if best and TRY * 1.0 > _cost(best) else ((), exactly)


#: A condition on the trigrams of a line: it meets every part; a part, if it meets one of
#: its alternatives; an alternative, if it holds all of its trigrams. No parts: any line.
Condition = tuple[tuple[frozenset[str], ...], ...]


def _grams(s: str) -> frozenset[str]:
    # how letters beyond ASCII lower-case may depend on what surrounds them
    return frozenset(s[k : k + 3] for k in range(len(s) - 2) if s[k : k + 3].isascii())


def trigrams(regex: str) -> Condition:
    """What the trigrams of a folded line must meet for the regex to match it."""
    known = _known(regex)
    if known is None:
        return ()
    part, _ = known
    parts = []
    for strings in (*part.needs, *([part.exact] if part.exact is not None else [])):
        alternatives = {_grams(fold(s)) for s in strings}
        # one that asks for more than another adds nothing
        least = [a for a in alternatives if not any(b < a for b in alternatives)]
        if frozenset() not in least:
            parts.append(tuple(sorted(least, key=sorted)))
    return tuple(dict.fromkeys(parts))
