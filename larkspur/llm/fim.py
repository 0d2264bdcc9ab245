"""Fill-in-middle transformation, as relations of units.

A text is a sequence of units: code points, or the matches of a regex. Two cuts
between units, drawn from a hash of the id, split it into prefix, middle and
suffix, which are put into another order with markers between them.

1. Matches are exploded with their places; only their lengths leave the text. A
   match holds up to RUN code points, or one match of a regex of one's own.
2. Running sums by window give the first unit and the first character of each match.
3. Cut requests, two for each document, are joined on the ordinal of the match
   that holds the unit; the character offsets are summed up for each document.
4. The offsets come back to the texts by a hash join whose built side has one
   small row for each different document; substrings make the output.

A document is known by a digest of its id and text, so rows that repeat both are
one document in 1 to 3, and get the same output. No text is sorted; texts are shuffled
once, in step 4.

Defined results: null text is the empty text, which stays plain, as do texts that
hold a marker. A null id is drawn for like an empty one. An empty table gives an
empty table. All columns of the input are passed on, but for those named like a
result, which are replaced; names that differ in case only don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.columns import by_place, place, with_results

# Markers and shares.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORM_PERCENT, SPM_PERCENT = 90, 20
#: Code points of one exploded match.
RUN = 4096


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_lengths(text: Column, unit: str | None, run: int) -> Column:
    """Array of (units, chars) of the matches that a text is made of, in order."""
    if unit is None:
        found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{run}}}+"), F.lit(0))
        return F.transform(found, lambda s: F.struct(F.length(s).cast("long").alias("units"), F.length(s).cast("long").alias("chars")))
    # what is between two matches belongs to the later one, what comes after the last is a unit
    found = F.regexp_extract_all(text, F.lit(rf"(?s:.*?)(?:{unit})|(?s:.+)\z"), F.lit(0))
    return F.transform(found, lambda s: F.struct(F.lit(1).cast("long").alias("units"), F.length(s).cast("long").alias("chars")))


def cut_offsets(keyed: DataFrame, unit: str | None = None, seed: int = 1, run: int = RUN) -> DataFrame:
    """(key, id, text) -> (key, n, first_cut, second_cut): units, and the characters before each cut,
    of documents with any unit. Rows with one key count once."""
    lengths = F.posexplode(unit_lengths(F.col("text"), unit, run)).alias("match", "size")
    matches = keyed.select("key", "id", lengths).select("key", "id", "match", "size.*").groupBy("key", "match").agg(*(F.first(c).alias(c) for c in ("id", "units", "chars")))
    earlier = Window.partitionBy("key").orderBy("match").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before")
    placed = matches.select("key", "match", before("units"), before("chars"))
    whole = matches.groupBy("key").agg(F.first("id").alias("id"), F.sum("units").alias("n"), F.sum("chars").alias("all_chars"))
    h1, h2, *_ = draws(F.col("id"), seed)
    cuts = F.array_sort(F.array(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
    requests = whole.select("key", "n", "all_chars", F.posexplode(cuts).alias("cut", "unit"))
    per_match = run if unit is None else 1
    requests = requests.withColumn("match", F.floor(F.col("unit") / per_match).cast("int"))
    met = requests.join(placed, ["key", "match"], "left")
    # a cut after the last unit has no match: all characters come before it
    chars = F.coalesce(F.col("chars_before") + F.col("unit") - F.col("units_before"), F.col("all_chars"))
    offset = lambda k: F.max(F.when(F.col("cut") == k, chars))
    return met.groupBy("key").agg(F.first("n").alias("n"), offset(0).alias("first_cut"), offset(1).alias("second_cut"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str | None = None, seed: int = 1, run: int = RUN) -> DataFrame:
    """``docs`` with fim_units, fim_form (plain, psm or spm), fim_prefix_chars,
    fim_middle_chars (null if plain) and fim_text."""
    names = docs.columns
    own = by_place(docs)
    i, t = (F.col(f"c{place(names, c)}") for c in (doc_id, text))
    whole = F.coalesce(t, F.lit(""))
    key = F.md5(F.concat(F.coalesce(i.cast("string"), F.lit("-")), F.lit(":"), whole))
    offsets = cut_offsets(own.select(key.alias("key"), i.alias("id"), whole.alias("text")), unit, seed, run)
    both = own.withColumn("key", key).join(offsets.hint("shuffle_hash"), "key", "left")
    _, _, h3, h4 = draws(i, seed)
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = (whole == "") | marked | (h3 % 100 >= FORM_PERCENT)
    both = both.withColumn("form", F.when(plain, "plain").when(h4 % 100 < SPM_PERCENT, "spm").otherwise("psm"))
    a, b = F.col("first_cut").cast("int"), F.col("second_cut").cast("int")
    prefix, middle, suffix = F.substring(whole, F.lit(1), a), F.substring(whole, a + 1, b - a), F.substring(whole, b + 1, F.length(whole))
    mark = {k: F.lit(v) for k, v in (("p", PREFIX), ("s", SUFFIX), ("m", MIDDLE))}
    form = F.col("form")
    output = (
        F.when(form == "psm", F.concat(mark["p"], prefix, mark["s"], suffix, mark["m"], middle))
        .when(form == "spm", F.concat(mark["s"], suffix, mark["p"], prefix, mark["m"], middle))
        .otherwise(whole)
    )
    cut = form != "plain"
    results = {
        "fim_units": F.coalesce("n", F.lit(0).cast("long")), "fim_form": form, "fim_prefix_chars": F.when(cut, F.col("first_cut")),
        "fim_middle_chars": F.when(cut, F.col("second_cut") - F.col("first_cut")), "fim_text": output,
    }
    return with_results(both, names, results)
