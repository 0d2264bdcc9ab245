"""DuckDB SQL of the scan: the same results, said in another way."""

from __future__ import annotations

from larkspur.functions import scoring
from larkspur.functions.rules import BUILT_IN, Rule
from larkspur.plans.corpus import items_sql


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def double(x: float) -> str:
    return f"({x!r})::double"


def pick(values: list[str]) -> str:
    return f"list_extract([{', '.join(values)}], rule_id)"


def entropy(v: str) -> str:
    p = f"((length({v}) - length(replace({v}, c, ''))) / length({v}))"
    return f"coalesce(list_sum(list_transform(list_sort(list_distinct(string_split({v}, ''))), lambda c: -{p} * log2({p}))), 0)"


def widest(v: str) -> str:
    return f"list_max(list_transform(range(1, length({v}) - {scoring.WINDOW - 2}), lambda i: {entropy(f'substr({v}, i, {scoring.WINDOW})')}))"


def charset(v: str) -> str:
    return (
        f"case when regexp_matches({v}, '^[0-9A-Fa-f]+$') then 'hex' when regexp_matches({v}, '^[A-Za-z0-9+/=]+$') and regexp_matches({v}, '[+/=]') then 'base64' "
        f"when regexp_matches({v}, '^[A-Za-z0-9]+$') then 'alphanumeric' else 'other' end"
    )


def entropy_delta(v: str) -> str:
    e = f"(case when strlen({v}) > {scoring.WINDOW_OVER} then {widest(v)} else {entropy(v)} end)"
    when = " or ".join(f"(({charset(v)}) = '{k}' and strlen({v}) >= {n} and {e} >= {t})" for k, (t, n) in scoring.ENTROPY_LIMITS.items())
    return f"(case when {when} then {double(scoring.ENTROPY_DELTA)} else 0::double end)"


BASENAME = "list_extract(string_split(path, '/'), -1)"
FIRST_THREE = "array_to_string(list_concat(context_before, context_after)[1:3], chr(1))"
SIGNALS = {
    "key_value": f"regexp_matches(line, {text(scoring.KEY_VALUE[1])})",
    "keyword": f"(regexp_matches(line, {text(scoring.KEYWORD[1])}) or regexp_matches({FIRST_THREE}, {text(scoring.KEYWORD[1])}))",
    "file_name": f"regexp_matches({BASENAME}, {text(scoring.FILE_NAME[1])})",
    "assignment": f"regexp_matches(line, {text(scoring.ASSIGNMENT[1])})",
    "comment": f"regexp_matches(line, {text(scoring.COMMENT[1])})",
    "placeholder": f"regexp_matches(value, {text(scoring.PLACEHOLDER[1])})",
    "version_hash": f"regexp_matches(value, {text(scoring.VERSION_HASH[1])})",
    "url_segment": "(strpos(line, value) > 0 and ((strpos(line, value) > 1 and substr(line, strpos(line, value) - 1, 1) = '/') or substr(line, strpos(line, value) + length(value), 1) = '/'))",
}
SEVERITY = "case " + " ".join(f"when confidence >= {double(least)} then '{name}'" for name, least in scoring.SEVERITIES[:-1]) + " else 'info' end"
RANK = "case severity " + " ".join(f"when '{k}' then {r}" for k, r in scoring.RANK.items()) + " end"
REDACTED = "case when strlen(value) >= 12 then left(value, 4) || '****' || right(value, 4) else repeat('*', strlen(value)) end"
FINGERPRINT = "'sha256:' || sha256(path || ':' || cast(line_number as string) || ':' || rule)"


def matches(items: str | None = None, rules: tuple[Rule, ...] = BUILT_IN) -> str:
    hits = ", ".join(f"struct_pack(rule_id := {k}, rule := {text(r.name)}, value := regexp_extract(line, {text(r.regex)}, 1))" for k, r in enumerate(rules, 1))
    return f"(select * exclude (m), m.rule_id as rule_id, m.rule as rule, m.value as value from (select *, unnest([{hits}]) as m from ({items or items_sql()}) i) x where m.value <> '')"


def scored(full: bool = True, items: str | None = None, rules: tuple[Rule, ...] = BUILT_IN) -> str:
    score = pick([double(r.confidence) for r in rules])
    if full:
        score += f" + {entropy_delta('value')}"
        score += "".join(f" + (case when {on} then {double(scoring.DELTAS[k])} else 0::double end)" for k, on in SIGNALS.items())
    inner = f"select *, greatest(0::double, least(1::double, {score})) as confidence from {matches(items, rules)} m"
    return f"(select *, {RANK} as severity_rank from (select *, {SEVERITY} as severity from ({inner}) a) b)"


def findings(full: bool = True, items: str | None = None, rules: tuple[Rule, ...] = BUILT_IN) -> str:
    return f"""(select {FINGERPRINT} as id, {pick([text(r.secret_type) for r in rules])} as secret_type, severity, cast(severity_rank as int) as severity_rank, confidence, {REDACTED} as value, path, line_number,
        array_to_string(context_before, chr(10)) as context_before, array_to_string(context_after, chr(10)) as context_after, source_type,
        {pick([text(r.description) for r in rules])} || ' found in ' || path as description, rule as matched_pattern, cast(rule_id as int) as rule_id from {scored(full, items, rules)} s)"""
