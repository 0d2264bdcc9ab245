import base64
import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib
from html import unescape

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur import runtime
from larkspur.llm import ann, html_extract, mixing, ngram_join, packing, quality_model, quality_rules, queries, sharding, url_filter, warc_store

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = "word " * 30000
HARD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t", None, "b", 0), (4, LONG, "en", "a", 1), (4, LONG, "en", "a", 1), (None, "No id here.", "en", "b", 1), (7, "É à ü — ok.", "fr", "c", 1), (8, "<|endoftext|> x", "en", "c", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOC).withColumn("kept", F.lit("clash")).withColumn("shard", F.lit("clash"))


def test_quality_rules_against_brute_force(spark, docs, hard):
    for df in (docs, hard):
        texts = collections.defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r.doc_id].append(r.text or "")
        for r in quality_rules.quality_rules(df).collect():
            t = texts[r.doc_id][0]
            words = WORD.findall(t)
            grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
            hit = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


FOREIGN = (
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "verwenden cookies", "javascript ist deaktiviert", "hier klicken", "klicken sie hier", "newsletter abonnieren", "zurück nach oben", "zum seitenanfang", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "conditions d['’]utilisation", "utilise des cookies", "utilisons des cookies", "javascript est désactivé", "cliquez ici", "abonnez-vous à", "retour en haut", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "condiciones de uso", "utiliza cookies", "utilizamos cookies", "javascript está desactivado", "haz clic aquí", "haga clic aquí", "suscríbete a", "volver arriba", "saltar al contenido",
)


def plain_verdict(t):
    """(kept, cleaned text): the rules on str, line by line."""
    phrase = re.compile("|".join(["all rights reserved", "cookie policy", "use of cookies", "uses cookies", "privacy policy", "terms of (?:use|service)", "javascript is (?:disabled|required)", "enable javascript", "lorem ipsum", "click here", "sign up for", "log ?in to", "subscribe to our", "share this (?:page|article|post)", "powered by", "back to top", "skip to content", "licensed under the", r"copyright (?:\(c\)|©)", "© ?[12][0-9]{3}", *FOREIGN]))
    words, lost, stays = WORD.findall(t), 0, []
    for line in t.split("\n"):
        own = WORD.findall(line)
        n, low = len(own), line.strip().lower()
        marks = sum(w in ("|", ">", "<", ">>", "<<", "/", "»", "«", "›", "•", "·") for w in own)
        symbols = len(re.findall(r"[#*$%&|<>]", line))
        ends = re.search(r"[.!?:;…。][)\]\"'”’»]*$|[\"»]$", line.strip())
        sentences = re.split(r"(?<=[.!?;…。])[)\]\"'”’»]*\s+", low)
        legal = sum(min(len(x.split()), 60 * len(phrase.findall(x))) for x in sentences)
        bad = (marks >= 2 and 5 * marks >= n) or (symbols >= 3 and symbols >= n) or (n >= 2 and 2 * line.count("!!") >= n) or (n < 6 and not ends) or 2 * legal > n
        if n and bad:
            lost += n
        else:
            stays.append(line)
    return 2 * lost <= len(words), "\n".join(stays)


def test_quality_verdicts_against_plain_python(spark, hard):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = ["a | b | c", "Home > News > x", "!! what !!", "$$$ ### %%%", "no end here", "An end.", "We use of cookies for all of you here.", "© 2020 all rights reserved", "x" * 70, "The river ran past the mill and on to the sea that day."]
    rnd = random.Random(1)
    own = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 70))) + rnd.choice((".", ""))
    mixed = [(i, "\n".join(rnd.choice((own(), rnd.choice(lines) * rnd.choice((1, 1, 9)))) for _ in range(rnd.randrange(1, 30))), "en", "a", 0) for i in range(300)]
    for df in (whole, hard, spark.createDataFrame(mixed, DOC)):
        rows = quality_rules.quality_rules(df.withColumn("given", F.col("text"))).collect()
        assert len({r.kept for r in rows}) == 2 or df is hard
        for r in rows:
            kept, cleaned = plain_verdict(r.given or "")
            assert r.kept == (kept and not r.base_failed) and r.cleaned_text == (None if r.given is None else cleaned)
    assert "kept" in hard.columns


def test_boilerplate_on_long_lines():
    """Cookie paragraphs of any length are judged; one phrase doesn't condemn a long text."""
    legal, story = "This site uses cookies to tell visitors apart and to count them. ", "The river ran past the mill and on to the sea that day. "
    fails = lambda line: quality_rules.line_fails(line.encode(), line.encode().split())
    assert [fails(legal * k) for k in (1, 5, 6, 50)] == ["boilerplate"] * 4
    assert fails(legal * 20 + story * 8) == "boilerplate" and fails(legal * 8 + story * 20) == "" and fails(story * 50) == ""
    assert fails("word " * 65 + "click here") == "boilerplate" and fails("word " * 500 + "click here") == ""
    assert not quality_rules.judge((legal * 20).encode())[0][6] and quality_rules.judge((story * 3 + "\n" + legal * 6).encode())[1] == [(story * 3).encode()]


def test_boilerplate_has_one_measure_and_four_languages():
    """The share of a line that phrases condemn decides at any length; nothing changes at 60 words."""
    fails = lambda line: quality_rules.line_fails(line.encode(), line.encode().split())
    story = "The river ran past the old mill and on to the sea. "
    for n in range(1, 30):
        assert fails("Click here now. " + story * n) == ("boilerplate" if 3 * 2 > 3 + 11 * n else "")
    for phrase in ("Alle Rechte vorbehalten.", "Wir verwenden Cookies.", "Tous droits réservés.", "Cliquez ici.", "Todos los derechos reservados.", "Lea la política de privacidad."):
        assert fails("Und so weiter. " + phrase * 2 + " " + phrase) == "boilerplate", phrase
        assert fails(story * 3 + phrase) == "", phrase


def test_every_phrase_holds_a_fragment():
    for p in quality_rules.BOILERPLATE.pattern.split("|"):
        for tried in (p, re.sub(r"\(\?:|\)|\\\\", "", p)):
            for a, b in (("['’]", "'"), ("['’]", "’"), (" ?", ""), (" ?", " "), ("[12][0-9]{3}", "1999")):
                tried = tried.replace(a, b)
        if quality_rules.BOILERPLATE.search(tried):
            assert quality_rules.may_hold_phrase(tried), p
    for text in ("all rights reserved", "terms of use", "terms of service", "login to", "log in to", "share this post", "copyright (c)", "copyright ©", "© 2020", "©1999", "conditions d’utilisation", "conditions d'utilisation", *(f for f in FOREIGN if "[" not in f)):
        assert quality_rules.BOILERPLATE.search(text) and quality_rules.may_hold_phrase(text), text
    assert not quality_rules.may_hold_phrase("the river ran past the mill and on to the sea that day.")


def odd_names(df):
    """Further columns whose names differ in case only, hold backticks and dots, or are those of results."""
    names = ["Kept", "__rules", "Main_Text", "a`b", "a.b", "TEXT", "Doc_Id", "rules", "c0", "r0", "Quality_Score", "MIX_size", "source "]
    return df.select("*", *(F.lit(k) for k in range(len(names)))).toDF(*df.columns, *names)


def test_clashing_columns_everywhere(spark, docs, hard):
    df = odd_names(docs.limit(40).unionByName(hard.select(*docs.columns)))
    n = df.count()
    rules = quality_rules.quality_rules(df)
    assert rules.columns == [c for c in df.columns if c != "Kept"] + rules.columns[len(df.columns) - 1 :] and "kept" in rules.columns and len(rules.collect()) == n
    page = odd_names(docs.limit(3).select("doc_id", F.lit("<p>An article of a few words.</p>").alias("html")))
    out = html_extract.extracted(page)
    assert out.columns == [c for c in page.columns if c not in ("html", "Main_Text")] + ["main_text"] and len(out.collect()) == 3
    scores = quality_model.quality_scores(df)
    assert scores.columns == [c for c in df.columns if c != "Quality_Score"] + ["quality_score", "quality_kept"] and len(scores.collect()) == n
    assert mixing.mixed(df).columns == df.columns and sum(r.mix_copies for r in mixing.rates(df).collect()) == len(mixing.mixed(df).collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, SF).count() >= 0, name


def test_long_words_that_sums_confuse(spark):
    """The Thue-Morse word and its complement: sums of letters times powers are equal for both, modulo 2^64."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    pairs = [(w, w.translate(str.maketrans("ab", "ba"))) for w in (word[:32], word[:64], word[:512], word[:1024], word[:4096], word * 25)]
    rows = [(2 * k + i, w) for k, pair in enumerate(pairs) for i, w in enumerate(pair)]
    rows += [(100 + k, " ".join([w, "one", "two", "three", w])) for k, w in enumerate(pairs[3])] + [(200, word[:1024].upper())]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n, percent in ((5, 80), (4, 85)):
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(table, n, percent).collect()}
        assert got == {i: 6 if i == 200 else i for i, _ in rows}
    words = ngram_join.Words()
    assert len({int(words.hashes(w.encode())[0]) for pair in pairs for w in pair}) == 12
    assert words.hashes(b"A" * 100 + b" " + b"a" * 100 + b" \xc3\x89" * 1).tolist()[:2] == [int(words.hashes(b"a" * 100)[0])] * 2


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_ngram_join_against_brute_force(spark, docs, hard):
    base = " ".join(f"w{i}" for i in range(60))
    near = [(i, f"{base} x{i} y{i} z{i}", "en", "a", 1) for i in range(10_000, 10_030)] + [(10_040, base.upper(), "en", "a", 1), (10_041, "two words", "en", "a", 1), (10_042, "Two  Words", "en", "a", 1)]
    df = docs.unionByName(spark.createDataFrame(near, DOC))
    for n, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, n, percent).collect()}
        assert got == brute_components([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], n, percent)
    rows = {r.doc_id: r for r in ngram_join.ngram_join(hard).collect()}
    assert rows[1].n_shingles == 0 and rows[1].component_id == 1 and rows[None].component_id is None and rows[4].component_id == 4
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def test_ngram_join_of_dense_near_copies(spark):
    """Copies with so many edits that most are just beyond the limit of each other."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(4000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rnd.randrange(1, 9)):
            k = rnd.randrange(len(own))
            own[k : k + rnd.randrange(1, 3)] = [f"w{rnd.randrange(4000)}"]
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n, percent in ((4, 85), (5, 80)):
        expected = brute_components(rows, n, percent)
        assert 10 < len({c for _, c in expected.values()}) < 150
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, n, percent).collect()} == expected


def dense_components(rows, n, percent):
    """Components by a whole matrix of intersections, for large groups."""
    sets = {}
    for i, t in rows:
        words = t.split()
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    ids, grams = sorted(sets), {g: k for k, g in enumerate(set().union(*sets.values()))}
    m = np.zeros((len(ids), len(grams)), np.float32)
    for k, i in enumerate(ids):
        m[k, [grams[g] for g in sets[i]]] = 1
    both, size = m @ m.T, m.sum(1)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label = np.arange(len(ids))
    while True:
        new = np.where(linked, label[None, :], len(ids)).min(1)
        if (new == label).all():
            return {i: (len(sets[i]), ids[label[k]]) for k, i in enumerate(ids)}
        label = new


def test_ngram_join_keeps_little_on_disk(spark, tmp_path, monkeypatch):
    """Equal sets in many tasks share their n-grams with nobody else; intermediate tables go when they have been read;
    counters tell n-grams of a hundred sets from rare ones among more n-grams than a small table has counters for."""
    copies = spark.createDataFrame([(k, " ".join(f"w{k % 3}x{j}" for j in range(200))) for k in range(60)], "doc_id long, text string").repartition(20)
    order = spark.sparkContext.broadcast(np.zeros(ngram_join.COUNTERS, np.uint16))
    assert ngram_join._meetings(copies, 4, 85, order).count() == 0

    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(copies, 4, 85).collect()}
    assert got == {k: k % 3 for k in range(60)}
    assert {p.name.rpartition("-")[0] for p in tmp_path.iterdir()} == {"documents", "components", "links"}

    common = "of the and that in it"
    texts = spark.range(0, 3000, 1, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.when(F.col("id") < 100, common), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(300)), lambda j: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("_"), j.cast("string"))), " ")).alias("text"))
    counts = ngram_join._order(texts.mapInArrow(ngram_join._profile(4), ngram_join.PROFILE))
    assert counts.sum() == 3000 * 298 + 100 * 6 and counts[ngram_join._counter(ngram_join.shingles(common.encode(), 4, ngram_join.Words()))].min() >= 100
    assert (counts >= 100).sum() == 3


def test_packed_counters():
    r = np.random.default_rng(3)
    for top in (2, 300, 1 << 20):
        a, b = (r.integers(0, top, ngram_join.BLOCK, np.uint32) for _ in range(2))
        assert (ngram_join._unpacked(ngram_join._packed(a)) == a).all()
        batch = lambda x: pa.RecordBatch.from_arrays([pa.array([5], pa.int32()), pa.array([ngram_join._packed(x)], pa.binary())], names=["block", "counts"])
        (out,) = ngram_join._summed(iter([batch(a), batch(b)]))
        assert out.column(0).to_pylist() == [5] and (ngram_join._unpacked(out.column(1)[0].as_py()) == a + b).all()
        (out,) = ngram_join._summed(iter([batch(a), batch(np.full(ngram_join.BLOCK, 0xFFFFFFFF, np.uint32))]))
        assert (ngram_join._unpacked(out.column(1)[0].as_py()) == 0xFFFFFFFF).all()


def test_ngram_join_of_a_large_group(spark):
    """2,000 near copies, most of them just beyond the limit of all others, in several lengths; ids that repeat and null ids."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(4000)}" for _ in range(200)]
    rows = []
    for i in range(2000):
        own = list(base[: rnd.choice((120, 150, 200))])
        for _ in range(rnd.randrange(2, 9)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for n, percent in ((4, 85), (5, 80)):
        expected = dense_components(rows, n, percent)
        assert 100 < len({c for _, c in expected.values()}) < 1900
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, n, percent).collect()} == expected
    odd = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (2, None), (3, "G H I J K L"), (None, "g h i j k l"), (None, "m n"), (4, ""), (1, "a b c d e f")] * 3
    got = {tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame(odd, "doc_id long, text string"), 4, 85).collect()}
    assert got == {(1, 3, 1), (2, 3, 1), (2, 0, 2), (3, 3, 1), (None, 3, None), (None, 1, None), (4, 0, 4)}


def exact_nearest(ids, vectors, rows, k=20):
    """(ids, scores) of the k nearest of each of the rows, by all inner products."""
    out = []
    for q in rows:
        s = np.array([float(np.dot(v[: len(vectors[q])], vectors[q][: len(v)])) for v in vectors]) if len({len(v) for v in vectors}) > 1 else np.stack(vectors) @ vectors[q]
        other = np.delete(np.arange(len(ids)), q)
        best = other[np.lexsort((ids[other], -s[other]))[:k]]
        out.append((ids[best], s[best]))
    return out


def test_nearest_recall_and_odd_vectors(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    odd = spark.createDataFrame([(900_000, None, 0), (900_020, [0.0] * 64, 0), (900_040, [float("nan")] * 64, 0), (900_060, [1.0, None] * 32, 0), (None, [1.0] * 64, 0)], "vec_id bigint, embedding array<float>, label int")
    monkeypatch.setattr(ann, "CELL", 64)  # 32 cells
    monkeypatch.setattr(ann, "CHUNK", 40)
    monkeypatch.setattr(ann, "BLOCK", 30)
    got = ann.nearest(rows.unionByName(odd), F.col("vec_id") % 20 == 0).toPandas()
    data = rows.toPandas()
    ids, vectors = data.vec_id.to_numpy(), [np.array(v, float) for v in data.embedding]
    asked = np.flatnonzero(ids % 20 == 0)
    found = []
    for q, (best, _) in zip(asked, exact_nearest(ids, vectors, asked), strict=True):
        g = got[got.query_id == ids[q]].sort_values("rank")
        found.append(len(set(best) & set(g.vec_id)) / 20)
        place = {v: k for k, v in enumerate(ids)}
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, [vectors[place[v]] @ vectors[q] for v in g.vec_id], rtol=1e-12)
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
    assert np.mean(found) >= 0.9 and len(got) == 20 * len(asked)
    assert ann.nearest(rows.limit(0), F.lit(True)).count() == 0


def test_nearest_of_repeated_ids_ties_and_lengths(spark):
    r = np.random.default_rng(4)
    rows = [(20, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [3.0, 1.0]), (20, [0.0, 1.0, 5.0]), (3, [2.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("cell", F.lit("clash"))
    got = collections.Counter(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()))
    ids, vectors = np.array([i for i, _ in rows]), [np.array(v) for _, v in rows]
    want = collections.Counter()
    for q, (best, scores) in zip((0, 4), exact_nearest(ids, vectors, (0, 4)), strict=True):
        want.update((20, k, int(i), float(s)) for k, (i, s) in enumerate(zip(best, scores, strict=True), 1))
    assert got == want and sum(got.values()) == 14
    same = [(i, [float(x) for x in v]) for i, v in enumerate(np.repeat(r.standard_normal((3, 4)), 50, axis=0))]
    top = ann.nearest(spark.createDataFrame(same, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [x.vec_id for x in top] == [1, 2, 3, 4, 5] or top[0].score > np.dot(same[0][1], same[0][1])


def plain_jump(key, shards):
    """Jump consistent hash of one key, one step at a time."""
    k = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", int(key)), seed=42)
    b, j = -1, 0
    while j < shards:
        b = j
        k = (k * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_jump_hash_moves_only_into_the_new_shard(spark, docs, hard):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one_id = spark.createDataFrame([(7, f"t{i % 90}") for i in range(300)] + [(None, "x")] * 50, "doc_id long, text string")
    for df in (docs, hard, whole, one_id):
        rows = sharding.sharded(df).toPandas()
        assert all(g == s or g == 16 for s, g in zip(rows.shard, rows.grown_shard, strict=True))
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
        want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_jump(i, 16), plain_jump(i, 17)) for i, t in (tuple(r) for r in df.select("doc_id", "text").collect()))
        assert want == collections.Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows[["doc_id", "size", "text_crc32", "shard", "grown_shard"]].itertuples(index=False))
        assert set(rows.law) == {"key"}
    assert sharding.sharded(docs.limit(0)).count() == 0
    keys = np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64)
    for n in (1, 2, 7, 40):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert ((a == b) | (b == n)).all() and a.max() < n
        assert abs((b == n).mean() - 1 / (n + 1)) < 0.03


def plain_rule(url):
    """Host, path and the longest rule that fits, read off one url."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max(fit, key=lambda r: len(r[1] + r[2]), default=None)


def test_url_rules_and_held_out_accuracy(spark):
    rows = [(1, "http://www.example.com/en/x"), (2, "http://EXAMPLE.com/en/x?q"), (3, "https://a.net/es/"), (4, "https://a.net"), (5, "no url"), (6, None), (7, "http://b.com#x"), (8, "http://x.org/de/1")]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert [got[i].rule for i in range(1, 9)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, None]
    assert (got[2].host, got[2].path, got[6].host, got[7].path) == ("example.com", "/en/x", "", "")
    assert len(got) == 8 and url_filter.judged(spark.createDataFrame(rows * 3, "page_id bigint, url string")).count() == 24
    assert url_filter.judged(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.org/")] * 2, "page_id bigint, url string")
    assert {r.verdict for r in url_filter.judged(one).collect()} == {"allow"}
    none = spark.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    assert [(r.rule, r.verdict, r.host) for r in url_filter.judged(none).collect()] == [(None, "allow", "a.org")]
    whole = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r, (url,) in zip(*(x.orderBy("page_id").collect() for x in (url_filter.judged(whole), whole.select("url", "page_id").orderBy("page_id").select("url"))), strict=True):
        host, path, rule = plain_rule(url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1] + rule[2]) and (rule is None or r.verdict == rule[0])
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = url_filter.lexical(url_filter.ruled(pages)).where("listed is not null").withColumn("label", (F.col("listed") == "block").cast("double"))
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    train = url_filter.with_suffix_rates(labelled.where(fold > 0), labelled.where(fold > 0))
    test = url_filter.with_suffix_rates(labelled.where(fold == 0), labelled.where(fold > 0))
    model = url_filter.fit(train)
    scored = model.transform(url_filter.VectorAssembler(inputCols=url_filter.FEATURES, outputCol="features").transform(test))
    assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] >= 0.95


def test_url_rates_of_all_sections_and_copies(spark, monkeypatch):
    """Sections beyond the first 1,000 have rates of their own, in both joins; copies of a url are drawn one by one."""
    rows = [(i, f"http://a.{'net' if i % 2 else 'com'}/{'f' * (i % 90)}{i // 4}/x") for i in range(6000)] + [(i, "http://hot.com/same/x") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").repartition(4)
    rows = url_filter.lexical(url_filter.ruled(pages)).withColumn("label", (F.col("page_id") % 3 == 0).cast("double"))
    labelled = rows.where("page_id % 5 > 0")
    data = rows.toPandas()
    known = data[data.page_id % 5 > 0]
    mean = known.label.mean()
    want = {}
    for key in ("suffix", "section"):
        sums = known.groupby(key).label.agg(["size", "sum"])
        want[key] = ((sums["sum"] + 4 * mean) / (sums["size"] + 4)).to_dict()
    assert len(want["section"]) > 2500 and data.section.str.len().max() == 64
    for most in (100_000, 5, 1):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST", most)
        got = url_filter.with_suffix_rates(rows, labelled).toPandas()
        assert len(got) == len(data) and sorted(got.page_id) == sorted(data.page_id)
        for key in want:
            assert np.allclose(got[f"f_{key}"], [want[key].get(k, mean) for k in got[key]])
    monkeypatch.setattr(url_filter, "SAMPLE", 900)
    copies = rows.where("url = 'http://hot.com/same/x'").withColumn("page_id", F.lit(None).cast("long"))
    for hot in (rows.where("url = 'http://hot.com/same/x'"), copies):
        sample = url_filter.drawn(rows.where("url <> 'http://hot.com/same/x'").unionByName(hot)).toPandas()
        assert len(sample) == 900 and 240 < (sample.url == "http://hot.com/same/x").sum() < 360
    assert url_filter.drawn(rows.limit(0)).count() == 0


def test_quality_model_against_labels(spark, hard):
    d = "/root/testdata/sf0.01"
    got = quality_model.quality_scores(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    right = got.groupBy("quality").agg(F.avg((F.col("quality_kept") == (F.col("quality") == 1)).cast("double"))).collect()
    assert dict(map(tuple, right))[1] >= 0.98 and dict(map(tuple, right))[0] >= 0.9
    rows = {r.doc_id: r for r in quality_model.quality_scores(hard).collect()}
    assert not rows[1].quality_kept and not rows[2].quality_kept and len(rows) == 7


def test_words_and_shapes_against_plain_python():
    reader, rnd = quality_model.Reader(), random.Random(2)

    def shape(word):
        for pattern, sign in ((rb"[a-z\x80-\xff]+", b"x"), (rb"[A-Z]+", b"X"), (rb"[0-9]+", b"9")):
            word = re.sub(pattern, sign, word)
        return re.sub(rb"([^xX9])\1+", rb"\1\1", word)

    text = b" ".join(bytes(rnd.choice(b"aabABxX019--!!|\xc3\xa9") for _ in range(rnd.randrange(1, 9))) for _ in range(3000)) + b"\n\t " + b"long" * 100_000
    for data in (text, b"", b" ", b"a", text * 3):
        own, words = quality_model.Read(data, reader), data.split()
        low = [re.sub(b"[A-Z]", lambda m: m[0].lower(), w) for w in words]
        for got, want in ((own.hashes, low), (own.shapes, list(map(shape, words)))):
            assert len(got) == len(want) and len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))
        assert own.sizes.tolist() == list(map(len, words))
        assert sorted(quality_model._runs(own.hashes)) == sorted(collections.Counter(low).values())


def test_expectation_maximisation_by_hand():
    """One round from known posteriors against sums written out; planted labellers are found again."""
    r, n = np.random.default_rng(8), quality_model.LABELLERS
    kind = np.where(r.random(20_000) < 0.8, n, r.integers(0, n, 20_000))  # n: good; others: bad in what one labeller sees
    wrong = r.random((20_000, n)) < np.where(np.arange(n) == kind[:, None], 0.9, 0.01)
    patterns = np.where(r.random((20_000, n)) < 0.1, quality_model.NONE, np.where(wrong, quality_model.BAD, quality_model.GOOD))
    own, which, counts = np.unique(patterns, axis=0, return_inverse=True, return_counts=True)
    p = quality_model.expectation_maximisation(own, counts.astype(float))
    assert np.mean((p[which.ravel()] >= 0.5) == (kind == n)) > 0.9
    few = np.array([[1] * n, [0] + [1] * (n - 1), [2] * n])
    count = np.array([6.0, 3.0, 1.0])
    start = np.zeros((3, n + 1))
    for k, row in enumerate(few):  # the first guess, then one round by plain sums
        bad = [v == 0 for v in row]
        start[k, 0] = 0.1 if any(bad) else 0.95
        rest = [b + 0.01 for b in bad]
        start[k, 1:] = [(1 - start[k, 0]) * x / sum(rest) for x in rest]
    want = []
    for row in few:
        weights = []
        for c in range(n + 1):
            x = (sum(start[k, c] * count[k] for k in range(3)) + 0.5) / (10 + 0.5 * (n + 1))
            for j, v in enumerate(row):
                if v != 2:
                    seen = [sum(start[k, c] * count[k] for k in range(3) if few[k][j] == u) + 0.5 for u in (0, 1)]
                    x *= seen[v] / sum(seen)
            weights.append(x)
        want.append(weights[0] / sum(weights))
    assert np.allclose(quality_model.expectation_maximisation(few, count, rounds=1), want)


def test_html_extraction():
    m, known = html_extract.trained(), html_extract._WordBuckets()
    story = "".join(f"<p>Sentence number {w} of the story goes on for a while, and then it ends.</p>" for w in ("one", "two", "three"))
    page = f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><div class='ad'>Buy now, click here!</div><article><h1>Head &amp; line</h1>{story}<p>Tail<br>end &eacute;.<p>Open</article><footer>&copy; me</footer></body>"
    text = html_extract.articles(m, [page, "", "<p", "<!-- x"], known)
    assert text[0].startswith("Head & line\n\nSentence number one") and text[0].endswith("Tail end é.\n\nOpen")
    assert not re.search("Home|News|Buy|©|var t", text[0]) and text[1] == "" and text[3] == ""
    r = np.random.default_rng(123)
    pages = [html_extract.made_up_page(r) for _ in range(60)]
    coded = [[html_extract.encoded(html_extract.tag_buckets(path), text, linked, known) for path, text, linked in p] for p, _ in pages]
    got = html_extract.probabilities(m, coded)
    assert np.mean(np.concatenate([(g >= 0.5) == (y > 0.5) for g, (_, y) in zip(got, pages, strict=True)])) >= 0.97


def read(html):
    return [(node.path(), text, linked) for node, text, linked in html_extract.blocks(html, html_extract.Paths(np.zeros((html_extract.TAGS, 2))))]


def test_html_blocks():
    """Only block elements end a block; nothing but scripts, styles and controls is left out; broken markup."""
    texts = lambda html: [t for _, t, _ in read(html)]
    inside = "<p>one <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <svg width=1><title>no</title><path d='M0'/><text>pic</text></svg> <noscript>two</noscript> <object>three</object><script>var a='<p>';</script> <custom-tag>four</custom-tag> <iframe src=x></iframe>five</p>"
    assert texts(inside) == ["one x=2 pic two three four five"]
    assert texts("<p>a<button>Share</button><select><option>x</select>b<textarea>t</textarea></p><div><button>open</div>c") == ["ab", "c"]
    assert texts("<p>a<button>x<p>b") == ["a", "b"] and texts("<div>x<select><option>1<div>2</select>y") == ["xy"]
    assert texts("<p>a &amp; b<p>c<br>d<ul><li>e<li>f</ul><table><tr><td>g<td>h<tr><td>i</table>") == ["a & b", "c d", "e", "f", "g", "h", "i"]
    assert texts("<p title='a>b'>x</p>y<z") == ["x", "y<z"] and texts("a<!-- b") == ["a"] and texts("<p title='>x</p>") == ["x"] and texts("a<!>b<?c>d<!-->e") == ["abde"]
    path, _, linked = read("<div class='a b'><p id=c>x <a href=y>yz</a></p></div>")[0]
    assert path == ("div", ".a", ".b", "p", ".c") and 0.4 < linked < 0.6
    assert [p for p, _, _ in read("<article><p>a</article>b</p></div>c")] == [("article", "p"), (), ()]


def test_html_of_a_megabyte_takes_seconds():
    m, known = html_extract.trained(), html_extract._WordBuckets()
    hard = ["<a ", "<a<", "<div>x", "<b>x</i>", "<b>", "<b><p>x", "<li><b>x", "<b ' >'", "<p title=\"'>x", "<!-", "<svg><title>", "<a x='", "<select>", "&amp;<br>", "<td>x", "</p>x", "<script>"]
    for k, unit in enumerate(hard):
        html = unit * ((1 << 20 if k < 4 else 1 << 17) // len(unit))
        began = time.time()
        html_extract.articles(m, [html], known)
        assert time.time() - began < 60, unit
    assert html_extract.articles(m, ["<article><p>" + "word " * 200_000 + "</p></article>"], known)[0].count("word") == 200_000


def test_html_of_the_pages_table(spark):
    """Every page of the table against the blocks of its article, cut out by hand."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-1, None, None), (None, "u", ""), (-2, "u", "<p>")], "page_id long, url string, html string")
    rows = html_extract.extracted(pages.unionByName(odd).withColumn("main_text", F.lit("clash"))).collect()
    got = {r.page_id: r.main_text for r in rows}
    assert len(rows) == pages.count() + 4 and {got[-1], got[None], got[-2]} == {""}
    wrong = 0
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        wrong += got[r.page_id] != "\n\n".join(x for x in parts if x)
    assert wrong == 0 and html_extract.extracted(pages.limit(0)).count() == 0


def filled(sizes):
    """Targets by the rounds of the contract."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, left = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        t = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if t[s] > 3 * sizes[s]]
        if not over:
            return full | t
        for s in over:
            full[s] = 3 * sizes[s]
            left -= full[s]


def test_mixing(spark, docs, hard, monkeypatch):
    many = spark.createDataFrame([(i, "w " * (i % 40), f"s{i % 301}" if i % 3 else "hot") for i in range(3000)], "doc_id long, text string, source string")
    for df in (docs, hard, many):
        rows = mixing.rates(df).toPandas()
        sizes = {s if isinstance(s, str) else None: int(g.mix_size.sum()) for s, g in rows.groupby("source", dropna=False)}
        want = filled(sizes)
        for r in rows.itertuples():
            s = r.source if isinstance(r.source, str) else None
            assert math.isclose(r.mix_target, want[s], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.mix_copies <= 3 and r.mix_source_size == sizes[s]
        assert mixing.mixed(df).count() == rows.mix_copies.sum() and mixing.mixed(df).columns == df.columns
        # more sources than are broadcast: the same, by ranges and joins
        with monkeypatch.context() as few:
            few.setattr(mixing, "MAX_BROADCAST", 0)
            few.setattr(mixing, "HOT_PART", 10)
            again = mixing.rates(df).toPandas()
        key = ["doc_id", "mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies"]
        assert again[key].sort_values(key).reset_index(drop=True).equals(rows[key].sort_values(key).reset_index(drop=True))
    assert mixing.mixed(docs.limit(0)).count() == 0


def mixed_by_hand(rows, seed=7):
    """(id, source, words) -> copies, by a loop over the rows; equal rows are numbered as they come."""
    sizes, seen, out = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = filled(sizes)
    for i, t, s in rows:
        told = "-" if t is None else hashlib.md5(t.encode()).hexdigest()
        rate = min(3, targets[s] / sizes[s]) if sizes[s] else 0
        draw = int(hashlib.md5(f"{seed}:{'' if i is None else i}:{told}:{seen[i, t, s]}".encode()).hexdigest()[:13], 16) / 2**52
        seen[i, t, s] += 1
        out[i, t, s] += int(rate) + (draw < rate - int(rate))
    return out


@pytest.mark.parametrize("broadcast", [mixing.MAX_BROADCAST, 0])
def test_mixing_draws_rows_one_by_one(spark, monkeypatch, broadcast):
    """Null ids, one id on a third of the rows, and equal rows: every source is near its target."""
    monkeypatch.setattr(mixing, "MAX_BROADCAST", broadcast)
    body = lambda k: "word " * (10 + k % 7) + str(k)
    rows = [(None, body(k), "a") for k in range(3000)] + [(k, body(k), "b") for k in range(3000)] + [(7, body(k), "c") for k in range(1000)] + [(8, "the same text", "d")] * 2500 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_hand = mixed_by_hand(rows)
    got = collections.Counter()
    for r in mixing.rates(df).collect():
        got[r.doc_id, r.text, r.source] += r.mix_copies
    assert got == by_hand
    for s in "abcd":
        mine = mixing.rates(df).where(F.col("source") == s).agg(F.sum(F.col("mix_copies") * F.col("mix_size")), F.first("mix_target")).first()
        assert abs(mine[0] - mine[1]) <= 0.05 * mine[1], s
    again = collections.Counter((r.doc_id, r.text, r.source) for r in mixing.mixed(df.repartition(7)).collect())
    assert again == +by_hand


def test_mixing_of_clashing_columns(spark, docs):
    extra = ["mix_copy", "mix_rate", "mix_size", "__source", "__rate", "__own_0", "source_size", "place", "a.b", "weight"]
    clash = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(extra)))
    rows = mixing.mixed(clash)
    assert rows.columns == clash.columns and rows.count() == mixing.mixed(docs).count()
    assert {tuple(r)[5:] for r in rows.collect()} == {tuple(range(len(extra)))}
    assert mixing.rates(clash).select("mix_copies").agg(F.sum("mix_copies")).first()[0] == rows.count()


def test_packing(spark, docs, hard):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, hard):
        rows = packing.packed(df, with_ids=True).toPandas()
        ids = [tuple(slow.encode(r.text or "", add_special_tokens=False).ids) + (0,) for r in df.collect()]
        assert rows.length.sum() == sum(map(len, ids)) and (rows.length == rows.ids.map(len)).all()
        for (_, _), g in rows.drop_duplicates(["doc_id", "piece"]).groupby([rows.doc_id.fillna(-1), rows.doc_id.isna()]):
            g = g.sort_values("piece")
            assert tuple(i for x in g.ids for i in x) in set(ids) and (g.length.iloc[1:] == packing.CAPACITY).all()
        used = rows.groupby("sequence_id").length.sum()
        assert used.max() <= packing.CAPACITY and len(used) <= 1.02 * rows.length.sum() / packing.CAPACITY + 1
        for _, g in rows.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
    assert packing.packed(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest():
    r = np.random.default_rng(4)
    lengths = sorted(map(int, r.integers(1, 2049, 3000)), reverse=True)
    rooms = []
    for (own, offset), n in zip(packing.best_fit(lengths), lengths, strict=True):
        open_ = [x for x in rooms if x >= n]
        if open_:
            assert rooms[own] == min(open_)
        else:
            assert own == len(rooms)
            rooms.append(packing.CAPACITY)
        assert offset == packing.CAPACITY - rooms[own]
        rooms[own] -= n


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "http://c", None), (4, "http://d", ""), (6, "http://e\r\nX: y", "é")]
    got = {r.page_id: r for r in warc_store.archived(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {i: (got[i].record_type, got[i].refers_to) for i in got} == {1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 5), 2: ("revisit", 4), 4: ("response", None), 6: ("response", None)}
    assert got[6].payload_bytes == 2 and got[1].payload_digest == warc_store.digest_bytes(b"same") == got[1].header_digest
    head, _, rest = bytes(got[5].record).partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert rest[:length].endswith(b"same") and rest[length:] == b"\r\n\r\n"


def test_warc_of_the_whole_table(spark):
    """Every record of the pages table is rebuilt byte for byte, with the digests and kinds that plain Python gives; rows that repeat, null ids and large payloads."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    odd = [(20_001, "http://x", "é" * 3_000_000), (20_002, "http://y", "é" * 3_000_000), (20_003, "u", "twice"), (20_003, "u", "twice"), (None, None, "twice"), (None, None, None)]
    df = pages.unionByName(spark.createDataFrame(odd, pages.schema)).withColumn("payload", F.lit("clash")).withColumn("sha256", F.lit(1))
    rows, records = df.collect(), warc_store.archived(df).collect()
    largest = {}
    for r in rows:
        data = (r.html or "").encode()
        largest[data] = max(largest.get(data, -math.inf), -math.inf if r.page_id is None else r.page_id)
    want = collections.Counter()
    for r in rows:
        data = (r.html or "").encode()
        revisit = r.page_id != largest[data] and not (r.page_id is None and largest[data] == -math.inf)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[r.page_id, len(data), digest, "revisit" if revisit else "response", largest[data] if revisit else None] += 1
    assert want == collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records)
    for r in records:
        record, payload = bytes(r.record), bytes(r.payload)
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        length = int(fields[b"Content-Length"])
        assert rest[length:] == b"\r\n\r\n" and fields[b"WARC-Payload-Digest"].decode() == f"sha1:{warc_store.digest_bytes(payload)}"
        assert rest[:length].endswith(b"\r\n\r\n" + (payload if r.record_type == "response" else b"")) and f"Content-Length: {len(payload)}\r\n".encode() in rest[:length]
    assert warc_store.archived(pages.limit(0)).count() == 0


def test_queries_and_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and out.groupby("sequence_id").length.sum().max() <= 2048
    assert len(queries.QUERIES) == 13 and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages(spark, docs):
    """Every stage on its own input, with rows that repeat, null and repeated ids, null and empty texts; and on nothing.
    Rules, join and mixing are held against loops in plain Python, the classifier against its operator (a trained
    model) and the labels, packing against ids, places and a bound on sequences."""
    story = " ".join(f"w{i}" for i in range(80))
    odd = [(None, story, "en", "a", 1), (None, story, "en", "a", 1), (5_000_001, story + " x", "en", None, 1), (5_000_001, story.upper(), "en", "a", 1), (5_000_001, "another text of a few words", None, "b", 1), (5_000_002, None, "en", "a", 0), (5_000_003, "", "en", "a", 0), (5_000_003, "", "en", "a", 0)]
    rows = docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(odd, DOC))
    stage = dict(corpus_pipeline.STAGES)
    tables = lambda df: collections.Counter(map(tuple, df.collect()))
    kept = quality_model.quality_scores(rows).where("quality_kept").select(*corpus_pipeline.COLUMNS)
    assert tables(stage["quality classifier"](spark, rows, SF)) == tables(kept)
    want = collections.Counter()
    for r in rows.collect():
        t = r.text or ""
        words = WORD.findall(t)
        keep, cleaned = plain_verdict(t)
        grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        if keep and len(words) >= 50 and 2 * len(hit) <= len(words):
            want[(r.doc_id, cleaned, r.lang, r.source, len(cleaned))] += 1
    assert tables(stage["quality rules"](spark, rows, SF)) == want
    listed = rows.collect()
    component = brute_components([(k, r.text) for k, r in enumerate(listed)], 5, 80)
    groups = collections.defaultdict(list)
    for k, r in enumerate(listed):
        groups[component[k][1]].append((r.doc_id is None, r.doc_id or 0))
    got = stage["n-gram Jaccard join"](spark, rows, SF).collect()
    assert collections.Counter((r.doc_id is None, r.doc_id or 0) for r in got) == collections.Counter(map(min, groups.values()))
    taken = +mixed_by_hand([(r.doc_id, r.text, r.source) for r in listed])
    assert collections.Counter((r.doc_id, r.text, r.source) for r in stage["mixing sources to target weights"](spark, rows, SF).collect()) == taken
    pieces = stage["best-fit packing"](spark, rows, SF).toPandas()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces.length.sum() == sum(len(slow.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in listed)
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.append(0, own.length.cumsum().to_numpy()[:-1])).all()
    assert pieces.sequence_id.nunique() <= 1.02 * -(-int(pieces.length.sum()) // 2048) + 2
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stays = {r.doc_id for r in stage["quality classifier"](spark, docs, SF).collect()}
    right = [(i in stays) == bool(q) for i, q in labels.items() if q is not None]
    assert sum(right) >= 0.9 * len(right)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, rows.limit(0), SF).count() == 0, name
