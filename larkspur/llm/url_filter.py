"""URL filter: listed rules first, then gradient-boosted trees.

Rules name a host and the start of a path; the longest rule that fits decides.
URLs that no rule fits are judged by boosted trees on lexical features: length,
depth, labels of the host, digit ratio, character entropy, counts of parameters
and hyphens, and block rates of the host's suffix, alone and with the path's
first folder. The trees are trained on
URLs that rules have labelled, at most SAMPLE of them: the first ones by a hash
of url, page_id and the number of the copy among equal rows. Every suffix and
section has its own rate, which counts all labelled URLs; those without
labelled URLs get the mean.

Defined results: a null url, or one without ://, has an empty host and path and
fits no rule. Without labelled URLs everything else is allowed; if all labels
agree, they decide. Repeated rows are judged alike. An empty table gives an
empty table. Only page_id and url are read.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.columns import picked
from larkspur.runtime import written

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labelled URLs that the trees are trained on, at most.
SAMPLE = 20_000
#: Copies of equal rows that one row stands for while they are spread out.
BLOCK = 1000
#: More rates than this, of keys of at most 64 bytes, are joined by a shuffle.
MAX_BROADCAST = 100_000
#: A key with more than this part of the rows is hot in that shuffle.
HOT_PART = 1000
TREES, DEPTH = 15, 4
FEATURES = ["f_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_last", "f_fragment", "f_suffix", "f_section"]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; A-Z of the host are lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    _, name, start = rule
    return ((host == name) | host.endswith("." + name)) & path.startswith(start)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """host, path, rule and the rule's verdict."""
    host, path = parts(F.col("url"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    rule = verdict = None
    for r in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        ok = fits(r, F.col("host"), F.col("path"))
        rule = F.when(ok, r[1] + r[2]) if rule is None else rule.when(ok, r[1] + r[2])
        verdict = F.when(ok, r[0]) if verdict is None else verdict.when(ok, r[0])
    return pages.withColumn("rule", rule).withColumn("listed", verdict)


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    letters = F.array_distinct(F.split(s, ""))
    share = lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / F.greatest(F.length(s), F.lit(1))
    terms = F.transform(F.filter(letters, lambda c: c != ""), lambda c: -share(c) * F.log2(share(c)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def lexical(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))
    return (
        pages.withColumn("f_length", F.length(url).cast("double"))
        .withColumn("f_depth", count(F.col("path"), "/").cast("double"))
        .withColumn("f_labels", (count(F.col("host"), ".") + 1).cast("double"))
        .withColumn("f_digits", F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)))
        .withColumn("f_entropy", entropy(url))
        .withColumn("f_params", (count(url, "=") + count(url, "&")).cast("double"))
        .withColumn("f_hyphens", count(F.col("host"), "-").cast("double"))
        .withColumn("f_last", F.length(F.substring_index(F.col("path"), "/", -1)).cast("double"))
        .withColumn("f_fragment", F.contains(url, F.lit("#")).cast("double"))
        .withColumn("suffix", F.substring_index("host", ".", -1))
        .withColumn("section", bounded(F.concat_ws("/", "suffix", F.regexp_extract("path", "^/([^/]*)/", 1))))
        .withColumn("suffix", bounded(F.col("suffix")))
    )


def bounded(key: Column) -> Column:
    """A key of at most 64 bytes; only digests have 64."""
    return F.when(F.octet_length(key) < 64, key).otherwise(F.sha2(key, 256))


def suffix_rates(labelled: DataFrame) -> tuple[float, dict[str, DataFrame]]:
    """Mean block rate, and smoothed rates of every suffix and section."""
    mean = float(labelled.agg(F.avg("label")).first()[0] or 0.0)
    rates = {}
    for key, name in (("suffix", "f_suffix"), ("section", "f_section")):
        sums = labelled.groupBy(key).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
        rates[name] = written(sums.select(key, ((F.col("blocked") + 4 * mean) / (F.col("n") + 4)).alias(name)), "rates")
    return mean, rates


def _with_rate(pages: DataFrame, rates: DataFrame, mean: float) -> DataFrame:
    key, name = rates.columns
    if rates.count() <= MAX_BROADCAST:
        return pages.join(F.broadcast(rates), key, "left").withColumn(name, F.coalesce(name, F.lit(mean)))
    hot = pages.groupBy(key).count().where(F.col("count") * HOT_PART > pages.count())
    hot = written(hot.join(rates, key, "left").select(key, F.coalesce(name, F.lit(mean)).alias("hot_rate")), "hot-rates")
    # fewer than HOT_PART rows; rows of hot keys are spread, whatever they then meet is not used
    pages = pages.join(F.broadcast(hot), key, "left")
    pages = pages.withColumn("rate_key", F.when(F.col("hot_rate").isNull(), F.col(key)).otherwise(F.col("spread").cast("string")))
    pages = pages.join(rates.withColumnRenamed(key, "rate_key"), "rate_key", "left")
    return pages.withColumn(name, F.coalesce("hot_rate", name, F.lit(mean))).drop("rate_key", "hot_rate")


def with_rates(pages: DataFrame, mean: float, rates: dict[str, DataFrame]) -> DataFrame:
    pages = pages.withColumn("spread", F.monotonically_increasing_id())
    for own in rates.values():
        pages = _with_rate(pages, own, mean)
    return pages.drop("spread")


def with_suffix_rates(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """f_suffix, f_section: smoothed block rates among labelled URLs of the
    host's suffix, and of the suffix with the first folder of the path."""
    return with_rates(pages, *suffix_rates(labelled))


def drawn(labelled: DataFrame) -> DataFrame:
    """(page_id, url) of SAMPLE labelled rows at most; copies of a row are drawn
    one by one, and spread over tasks in blocks before that."""
    equal = labelled.groupBy("url", "page_id").agg(F.count("*").alias("n"))
    blocks = equal.select("url", "page_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("block"))
    blocks = blocks.where(F.col("n") <= BLOCK).unionAll(blocks.where(F.col("n") > BLOCK).repartition("url", "page_id", "block"))
    copies = blocks.select("url", "page_id", F.explode(F.sequence("block", F.least(F.col("block") + BLOCK, "n") - 1)).alias("copy"))
    return copies.orderBy(F.xxhash64("url", "page_id", "copy"), "url", "page_id", "copy").limit(SAMPLE).select("page_id", "url")


def fit(sample: DataFrame):
    """Boosted trees over a sample of labelled rows; None if the labels all agree."""
    sample = written(sample.select("label", *FEATURES), "labelled-urls")
    if sample.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.coalesce(1))
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.3, seed=11).fit(rows)


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' block_score."""
    rows = lexical(ruled(picked(pages, page_id="page_id", url="url"), rules))
    labelled = rows.where("listed is not null").withColumn("label", (F.col("listed") == "block").cast("double"))
    counts = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).first()
    mean, rates = suffix_rates(labelled)
    rows = with_rates(rows, mean, rates)
    model = None
    if counts.n:
        sample = lexical(ruled(written(drawn(labelled), "drawn-urls"), rules)).withColumn("label", (F.col("listed") == "block").cast("double"))
        model = fit(with_rates(sample, mean, rates))
    if model is None:
        scored = rows.withColumn("block_score", F.lit(float(counts["mean"] or 0.0)))
    else:
        model.setFeaturesCol("features").setProbabilityCol("").setRawPredictionCol("raw")
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)).withColumnRenamed("prediction", "block_score")
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("listed", own).alias("verdict"), F.col("block_score").cast("double").alias("block_score"))
