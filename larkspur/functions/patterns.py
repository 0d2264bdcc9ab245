"""Regexes that users write: checked on the driver before any task meets them."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def groups(regex: str) -> int | None:
    """Capturing groups of a regex in Java's dialect, or None if it can't be compiled."""
    jvm = SparkSession.active()._jvm
    try:
        return jvm.java.util.regex.Pattern.compile(regex).matcher("").groupCount()
    except (Py4JError, PySparkException):
        return None


def usable(patterns: Iterable[str]) -> list[str]:
    """Those patterns that can be compiled; the others are left out with a warning."""
    out = []
    for p in patterns:
        if groups(p) is None:
            warnings.warn(f"not a pattern, left out: {p!r}", stacklevel=2)
        else:
            out.append(p)
    return out
