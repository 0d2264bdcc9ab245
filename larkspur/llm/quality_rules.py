"""Quality rules, line first.

Every line of a document is judged by three kinds of rules: punctuation
(no sentence end on a short line, shouted or symbol-ridden words), navigation
(separators between few words) and boilerplate (legal and interface phrases in
English, German, French and Spanish). A line of any length is boilerplate if its
sentences with phrases make up more than half of its words, where a phrase counts
for PHRASE_WORDS words of its sentence at most. Lines that fail are removed; a
document that loses too large a part of its words is rejected, as is one that fails
the base measures.

Defined results: a null or empty text has no words, measures of 0, fails the
base rule (too few words) and is rejected; its cleaned text is the same null or
''. Rows are judged one by one, so repeated rows, ties and null ids change
nothing, an empty table gives an empty table, and columns of the input are all
passed on (those named like an output column, in any case, are replaced).
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.columns import by_place, place, with_results
from larkspur.runtime import ensure_importable

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected if it loses more than this part of its words.
MAX_LOSS = 0.5
#: A line of fewer words needs a sentence end.
SHORT_LINE = 6
#: Words that one boilerplate phrase can condemn.
PHRASE_WORDS = 60

SENTENCE_END = re.compile(r"""[.!?:;…。][)\]"'”’»]*$|["”»]$""")
SENTENCE_GAP = re.compile(r"""(?<=[.!?;…。])[)\]"'”’»]*\s+""")
NAVIGATION_MARKS = {b"|", b">", b"<", b">>", b"<<", b"/", "»".encode(), "«".encode(), "›".encode(), "•".encode(), "·".encode()}
#: Phrases of interfaces and legal notes, lower case.
BOILERPLATE = re.compile(
    "all rights reserved|cookie policy|use of cookies|uses cookies|privacy policy|terms of (?:use|service)"
    "|javascript is (?:disabled|required)|enable javascript|lorem ipsum|click here|sign up for|log ?in to"
    "|subscribe to our|share this (?:page|article|post)|powered by|back to top|skip to content"
    "|licensed under the|copyright (?:\\(c\\)|©)|© ?[12][0-9]{3}"
    "|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|verwendet cookies|verwenden cookies|javascript ist deaktiviert"
    "|hier klicken|klicken sie hier|newsletter abonnieren|zurück nach oben|zum seitenanfang|zum inhalt springen"
    "|tous droits réservés|politique de confidentialité|conditions d['’]utilisation|utilise des cookies|utilisons des cookies"
    "|javascript est désactivé|cliquez ici|abonnez-vous à|retour en haut|aller au contenu"
    "|todos los derechos reservados|política de privacidad|política de cookies|términos de uso|condiciones de uso|utiliza cookies"
    "|utilizamos cookies|javascript está desactivado|haz clic aquí|haga clic aquí|suscríbete a|volver arriba|saltar al contenido"
)
#: Every phrase above holds one of these, in lower case.
FRAGMENTS = (
    "rights reserved", "cookie", "privacy policy", "terms of", "javascript", "lorem ipsum", "click here", "sign up for", "log in to", "login to", "subscribe to our", "share this", "powered by", "back to top",
    "skip to content", "licensed under the", "copyright", "©", "rechte vorbehalten", "datenschutzerkl", "nutzungsbedingungen", "hier klicken", "klicken sie hier", "newsletter abonnieren", "nach oben",
    "zum seitenanfang", "zum inhalt springen", "droits r", "politique de confidentialit", "conditions d", "cliquez ici", "abonnez-vous", "retour en haut", "aller au contenu", "derechos reservados",
    "tica de privacidad", "rminos de uso", "condiciones de uso", "clic aqu", "suscr", "volver arriba", "saltar al contenido",
)
RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,kept:boolean,n_lines:bigint,n_lines_removed:bigint,n_words_removed:bigint,"
    "lost_punctuation:bigint,lost_navigation:bigint,lost_boilerplate:bigint{}>"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = defaultdict(count().__next__)
    a = np.fromiter(map(number.__getitem__, words), np.int64, n)
    v = len(number)
    first = a[:-2] * v + a[1:-1]
    if v >= 2_000_000:
        first = np.unique(first, return_inverse=True)[1].astype(np.int64)
    key = first * v + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def phrase_words(text: str) -> int:
    """Words of the sentences that hold boilerplate phrases."""
    hits = ((len(BOILERPLATE.findall(s)), len(s.split())) for s in SENTENCE_GAP.split(text))
    return sum(min(words, PHRASE_WORDS * n) for n, words in hits)


def may_hold_phrase(text: str) -> bool:
    """Whether a lower-case text can hold a boilerplate phrase at all: most texts can't."""
    return any(f in text for f in FRAGMENTS)


def line_fails(line: bytes, words: list[bytes], phrases: bool = True) -> str:
    """Which kind of rule a line with words breaks, or ''; ``phrases``: whether it can hold one."""
    n = len(words)
    marks = sum(w in NAVIGATION_MARKS for w in words)
    if marks >= 2 and 5 * marks >= n:
        return "navigation"
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols >= 3 and symbols >= n:
        return "punctuation"
    if line.count(b"!!") * 2 >= n and n >= 2:
        return "punctuation"
    text = line.decode("utf-8", "replace").strip()
    if n < SHORT_LINE and not SENTENCE_END.search(text):
        return "punctuation"
    if not phrases:
        return ""
    text = text.lower()
    if BOILERPLATE.search(text) and 2 * phrase_words(text) > n:
        return "boilerplate"
    return ""


def judge(data: bytes) -> tuple[tuple, list[bytes] | None]:
    """Measures and verdict of one text, and the lines that stay."""
    words = data.split()
    n = len(words)
    word_bytes = sum(map(len, words))
    chars = len(data) if data.isascii() else len(data.decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeat = repeated_words(words)
    lines = data.split(b"\n")
    phrases = may_hold_phrase(data.decode("utf-8", "replace").lower())
    seen: set[bytes] = set()
    dup = removed = removed_words = 0
    lost = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    keep = []
    for line in lines:
        own = line.split()
        if own:
            if line in seen:
                dup += 1
            seen.add(line)
            if why := line_fails(line, own, phrases):
                lost[why] += 1
                removed += 1
                removed_words += len(own)
                continue
        keep.append(line)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    kept = not failed and removed_words <= MAX_LOSS * n
    measures = (n, chars - (len(data) - word_bytes), symbols, dup, repeat, failed, kept, len(lines) if data else 0, removed, removed_words, *lost.values())
    return measures, keep


def _judged(texts: pa.Array, clean: bool) -> pa.Array:
    rows, cleaned = [], []
    for data in texts.cast(pa.large_binary()).to_pylist():
        measures, keep = judge(data or b"")
        rows.append(measures)
        cleaned.append(None if data is None else b"\n".join(keep) if clean else None)
    names = RESULT.format("")[7:-1].split(",")
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    arrays = [pa.array(c, pa.bool_() if n.endswith("boolean") else pa.int64()) for n, c in zip(names, columns, strict=True)]
    fields = [n.split(":")[0] for n in names]
    if clean:
        arrays.append(pa.array(cleaned, pa.large_binary()).cast(pa.large_string()).cast(pa.string()))
        fields.append("cleaned_text")
    return pa.StructArray.from_arrays(arrays, names=fields)


def _measures(texts: pa.Array) -> pa.Array:
    return _judged(texts, False)


def _measures_and_text(texts: pa.Array) -> pa.Array:
    return _judged(texts, True)


def quality_rules(docs: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """``docs`` with the measures, the verdict ``kept`` and ``cleaned_text``."""
    ensure_importable(docs.sparkSession)
    f = F.arrow_udf(_measures_and_text, RESULT.format(",cleaned_text:string")) if clean else F.arrow_udf(_measures, RESULT.format(""))
    names = [n.split(":")[0] for n in RESULT.format(",cleaned_text:string" if clean else "")[7:-1].split(",")]
    own, body = by_place(docs), F.col(f"c{place(docs.columns, text)}")
    return with_results(own.withColumn("rules", f(body)), docs.columns, {n: F.col(f"rules.{n}") for n in names})
