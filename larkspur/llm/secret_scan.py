"""Secrets in texts: fixed patterns, and strings that a tokenizer finds hard.

A vocabulary learnt from text covers words with few tokens and random letters
with many. A run of at least MIN_CHARS letters, digits and ``+/_=-`` is random if
it has at most MAX_RATIO characters a token. Excluded before are

* digests of a known kind: hexadecimal of the lengths of MD5 and the SHA family, and
  runs with such a name before them (``sha256-...``, ``md5:...``);
* identifiers: UUIDs, numbers with separators (dates, phone and card numbers),
  words of one case or capitalised, joined by ``_-/+=`` or by their capitals, with
  digits at their ends only (``max_retry_count2``, ``SomeClassName``, paths);
* what the fixed patterns have found.

Runs end at dots, so hosts and file names are taken part by part; a run is
trimmed of ``+/_=-`` in front and of ``+/_-`` behind. Tokens are counted in parts of
at most PART characters, so a run takes time in proportion to its length.

Fixed patterns come first and stay, whatever the tokenizer says. Places are code points of the
whole text, ends exclusive.

Defined results: null and empty texts have no spans. Rows are judged one by one,
so repeated rows, ties and null ids change nothing, and an empty table gives an
empty table. All columns are passed on, but for one named like the result, which
is replaced; names that differ in case only don't clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.columns import by_place, place, with_results
from larkspur.runtime import ensure_importable

# The patterns, what a match must have, and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of hex digits are whole matches, so the least length can be asked for at once.
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")
#: Every match of ASSIGN holds one of these in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

VOCABULARY = "byte_bpe_50k"
MIN_CHARS, MAX_RATIO, PART = 20, 1.9, 1000
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}")
#: Letters of hexadecimal digests (MD5, SHA-1, SHA-224 to SHA-512), and names before digests.
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
DIGEST_NAME = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512)|integrity|checksum|digest|etag)[\"']?\s?[-:=]\s?[\"']?\Z", re.ASCII | re.IGNORECASE)
NAMED_DIGEST = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512))[-_=]", re.ASCII | re.IGNORECASE)
ALL_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
NUMBER = re.compile(r"[0-9+/_=-]+\Z")
#: Words of three or more letters, abbreviations in capitals, or numbers, one after the other.
NAME = re.compile(r"(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|(?<![A-Za-z0-9])(?:[A-Z]?[a-z]{1,2}|[A-Z]{1,2}))[0-9]{0,4}(?![0-9])|(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9])|[+/_=-]+")

Span = tuple[str, int, int]


def base_spans(text: str) -> Iterator[Span]:
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        yield from (("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"])
    if "AKIA" in text:
        yield from (("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"])
    yield from (("hex", *m.span()) for m in HEX.finditer(text))


def is_name(s: str) -> bool:
    """Whether words and numbers, joined, make up all of it."""
    at = 0
    for m in NAME.finditer(s):
        if m.start() != at:
            return False
        at = m.end()
    return at == len(s)


def is_known(text: str, start: int, end: int) -> bool:
    """A digest or an identifier."""
    s = text[start:end]
    if len(s) in DIGEST_CHARS and ALL_HEX.match(s):
        return True
    if UUID.match(s) or NUMBER.match(s) or NAMED_DIGEST.match(s) or DIGEST_NAME.search(text, max(0, start - 16), start):
        return True
    return is_name(s)


@lru_cache(maxsize=2)
def counter(ranks_path: str) -> Callable[[str], int]:
    """text -> how many tokens it takes."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: sum(len(own.encode_ordinary(s[k : k + PART])) for k in range(0, len(s), PART))


def random_spans(text: str, known: list[Span], tokens: Callable[[str], int]) -> Iterator[Span]:
    for m in RUN.finditer(text):
        start = m.end() - len(m[0].lstrip("+/_=-"))
        end = start + len(text[start : m.end()].rstrip("+/_-"))
        if end - start < MIN_CHARS or any(a < end and start < b for _, a, b in known) or is_known(text, start, end):
            continue
        if end - start <= MAX_RATIO * tokens(text[start:end]):
            yield "random", start, end


def spans(text: str, tokens: Callable[[str], int]) -> list[Span]:
    """All spans of a text by start, then by kind."""
    found = list(base_spans(text))
    found += list(random_spans(text, found, tokens))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


RESULT = "array<struct<kind:string,start:bigint,end:bigint>>"
KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _found(ranks_path: str):
    def run(texts: pa.Array) -> pa.Array:
        tokens = counter(ranks_path)
        rows = (spans(t.as_py() or "", tokens) for t in texts)
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in rows], KIND)

    return run


def secret_spans(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, start, end), never null."""
    ensure_importable(docs.sparkSession)
    find = F.arrow_udf(_found(public_tokenizers.path(f"{vocabulary}.tiktoken")), RESULT)
    own = by_place(docs)
    found = own.withColumn("found", find(F.col(f"c{place(docs.columns, text)}")))
    return with_results(found, docs.columns, {"secrets": F.col("found")})


def joined(found: Column) -> Column:
    """``kind:start:end`` of each span, with commas between them."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
