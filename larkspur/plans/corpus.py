"""Scan lines made from the driver's ``orders``, the same in Spark and DuckDB.

Each customer has up to seven files, so there are more files, not larger ones,
where the table is larger.

The built-in rules match nothing in the driver's tables, so lines of many
shapes are derived from order keys by hashing: one or more for each rule, and
comments, placeholders, versions, URLs and plain text. No line holds a real
credential.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.lines import with_context
from larkspur.runtime import table

#: SQL of the line shapes; h is an MD5 and s a SHA-256 in hex, both of the key.
SHAPES = (
    "'export AWS_ACCESS_KEY_ID=AKIA' || upper(substr(h, 1, 16))",
    "'aws_secret_access_key = ' || substr(s, 1, 40)",
    "'git clone with ghp_' || substr(s, 1, 36)",
    "'GITHUB_OAUTH: gho_' || substr(s, 5, 40)",
    "'github_pat_' || substr(s, 1, 30)",
    "'sk_live_' || substr(s, 1, 24)",
    "'stripe: sk_test_' || substr(s, 1, 26)",
    "'bot xoxb-' || '1234567890-' || '1234567890123-' || substr(s, 1, 24)",
    "'xoxp-' || '1234567890-' || '123456789012-' || substr(h, 1, 10) || '-' || substr(s, 1, 14)",
    "'-----BEGIN RSA PRIVATE KEY-----'",
    "'jwt eyJ' || substr(h, 1, 12) || '.' || substr(s, 1, 16) || '.' || substr(s, 17, 20)",
    "'DATABASE_URL=postgres://app:' || substr(h, 1, 8) || '@db.internal/main'",
    "'redis://cache:' || substr(h, 3, 9) || '@10.0.0.7:6379'",
    "'HEROKU_API_KEY=' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)",
    "'SG.' || substr(s, 1, 22) || '.' || substr(s, 23, 30)",
    "'twilio SK' || h",
    "'//registry.npmjs.org/:_authToken=npm_' || substr(s, 1, 36)",
    "'pypi-' || substr(s, 1, 60)",
    "'Authorization: Bearer ' || substr(s, 1, 30)",
    "'export PASSWORD_' || upper(substr(h, 1, 4)) || '=' || substr(s, 1, 12)",
    "'\"private_key_id\": \"' || substr(s, 1, 40) || '\"'",
    "'\"refresh_token\": \"1//' || substr(s, 1, 24) || '\"'",
    "'client_secret = ' || substr(s, 1, 36)",
    "'AccountKey=' || s || substr(h, 1, 24)",
    "'GET /blob?sv=2020&sig=' || substr(s, 1, 40)",
    "'dop_v1_' || s",
    "'glpat-' || substr(s, 1, 20)",
    "'run glptt-' || substr(s, 3, 22)",
    "'ATBB' || substr(s, 1, 32)",
    "'shpat_' || h",
    "'mailgun_api_key=key-' || h",
    "'DD_API_KEY: ' || h",
    "'VAULT hvs.' || substr(s, 1, 28)",
    "substr(h, 1, 14) || '.atlasv1.' || s",
    "'sk-proj-' || substr(s, 1, 24)",
    "'sk-ant-' || substr(s, 1, 32)",
    "'{\"auth\": \"' || substr(s, 1, 28) || '\"}'",
    "'token: ' || s || h || substr(s, 1, 20)",
    "'-----BEGIN OPENSSH PRIVATE KEY-----'",
    "'AGE-SECRET-KEY-1' || upper(substr(s, 1, 58))",
    "'github_app key -----BEGIN PRIVATE KEY-----'",
    "'see https://user:' || substr(h, 1, 7) || '@host.example.org/x'",
    "'# old key AKIA' || upper(substr(h, 5, 10)) || 'SAMPLE'",
    "'# dummy sk_test_' || 'example' || substr(s, 1, 20)",
    "'https://host/p/ATBB' || substr(s, 1, 34) || '/tail'",
    "'// nothing to see'",
    "'plain words ' || substr(h, 1, 6) || ' and more'",
    "''",
    "'  indented ATBBtest' || substr(s, 1, 30)",
    "'lorem ' || substr(s, 1, 4)",
    "'set color of the page'",
)
NAMES = ("/.env", "/deploy.sh", "/credentials", "/app.py", "/notes.txt", "/.env.local", "/settings.yml")
SOURCE_TYPES = ("env_file", "dotfile", "cloud_config", "dotfile", "dotfile", "env_file", "application_config")


def _case(key: str, values) -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end"


#: SQL of a key's file, the same in both engines.
PLACE = (
    _case("o_orderkey", [f"'{v}'" for v in SOURCE_TYPES]) + " as source_type",
    "'/home/u' || cast(o_custkey as string) || " + _case("o_orderkey", [f"'{v}'" for v in NAMES]) + " as path",
)
#: SQL of a key's line.
LINE = _case("k", SHAPES)


def items_sql() -> str:
    """DuckDB's lines with context, by windows."""
    first = ["o_orderkey as k", "md5(cast(o_orderkey as string)) as h", "sha256(cast(o_orderkey as string)) as s", *PLACE]
    second = ["k", "source_type", "path", f"{LINE} as line"]
    frame = lambda a, b: f"coalesce(list(line) over (partition by path order by k rows between {a} and {b}), [])"
    return f"""
    select path, source_type, k, cast(row_number() over (partition by path order by k) as int) as line_number, line,
        {frame("2 preceding", "1 preceding")} as context_before, {frame("1 following", "2 following")} as context_after
    from (select {", ".join(second)} from (select {", ".join(first)} from orders) a) b"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, source_type, rows): the lines of each path, as array<struct<k, line>>.

    Only keys are shuffled and sorted; their lines are made in the arrays, where of the many
    shapes the one that is asked for is read, and none is part of the compiled code.
    """
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", *PLACE)
    # by a number of its own: keys are few bytes, and Spark would join their partitions for fewer tasks than there are cores
    keys = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    keys = keys.groupBy("path", "source_type").agg(F.sort_array(F.collect_list(F.struct("k")))["k"].alias("keys"))
    line = f"get(transform(array(md5(cast(k as string))), h -> get(transform(array(sha2(cast(k as string), 256)), s -> {LINE}), 0)), 0)"
    return keys.select("path", "source_type", F.expr(f"transform(keys, k -> named_struct('k', k, 'line', {line}))").alias("rows"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with context from the arrays of their files, as of files that are read."""
    entries = F.transform("rows", lambda x, i: F.struct((i + 1).alias("line_number"), x["line"].alias("line"), x["k"].alias("k")))
    return with_context(files(spark, sf_dir), entries, ["path", "source_type"], more=("k",))
