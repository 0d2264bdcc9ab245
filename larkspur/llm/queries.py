"""The queries of this subpackage, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import ann, fim, html_extract, merkle, mixing, ngram_join, packing, quality_model, quality_rules, secret_scan, sharding, url_filter, warc_store
from larkspur.llm.columns import picked
from larkspur.runtime import table, written


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), clean=False).drop("text")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=16)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.quality_scores(docs).select("doc_id", "quality_score", F.col("quality_kept").alias("kept"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # words are counted once; what is left of a document is small
    thin = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), mixing.text_digest(F.col("text")).alias("told"))
    return mixing.rates(written(thin, "sizes"), size="words", digest="told").select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, text = F.col("doc_id"), F.col("text")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = written(merkle.leaves(table(spark, sf_dir, "documents"), lower, F.crc32(number.cast("string")) % 3 == 0), "leaves")
    m = merkle.write_manifest(rows)
    if m.root is None:
        return spark.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    found = merkle.proofs(spark, m).withColumn("folded_root", merkle.folded(F.coalesce("other", "digest"), F.col("steps")))
    root = F.lit(m.root)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_scan.secret_spans(picked(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")).select("doc_id", "secrets")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.KINDS[:3]))
    return docs.select("doc_id", *map(n, secret_scan.KINDS), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("secrets")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fim.fill_in_middle(picked(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    back = fim.restored(F.col("fim_text"), F.col("fim_form"))
    names = {"fim_units": "n", "fim_form": "form", "fim_prefix_chars": "prefix_chars", "fim_middle_chars": "middle_chars"}
    return docs.select("doc_id", *(F.col(c).alias(n) for c, n in names.items()), F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_ngram_join, op3_nearest, op4_sharding, op5_url_filter, op6_quality_model, op7_html_extract, op8_mixing, op9_packing, op10_warc, op11_merkle, op12_secret_scan, op13_fill_in_middle)}
#: The others depend on trained models, hashes, tokens or links that SQL can't say
#: on whole tables; tests hold them against brute force, round trips or held-out data.
ORACLE_SQL: dict[str, str] = {
    "op8_mixing": """
with d as (
    select doc_id, source, coalesce(md5(text), '-') as told, row_number() over (partition by doc_id, text, source) - 1 as number,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
    from documents
),
w as (
    select source, source_size, [5, 2, 1][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight
    from (select source, sum(size)::bigint as source_size from d group by source) x
),
f as (select *, (3 * source_size)::double / weight as full_at from w),
l as (
    select *, (sum(source_size) over ()
        - 3 * coalesce(sum(source_size) over (order by full_at, source is null, source rows between unbounded preceding and 1 preceding), 0))::double
        / sum(weight) over (order by full_at, source is null, source rows between current row and unbounded following) as level
    from f
),
t as (
    select source, source_size, least(3.0::double * source_size, weight * (select arg_min(level, full_at) from l where level <= full_at)) as target from l
),
r as (
    select doc_id, size, source_size, target, case when source_size > 0 then least(target / source_size, 3.0::double) else 0.0::double end as rate,
        ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '') || ':' || told || ':' || number), 1, 13))::bigint / 4503599627370496.0::double as draw
    from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target, ((floor(rate)::bigint + case when draw < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken from r""",
    # nodes of all levels by recursion; crc32 of the decimal id bit by bit
    "op11_merkle": """
with recursive f as (
    select doc_id, lang, coalesce(':' || lang, '') as tree, text,
        coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') || coalesce(strlen(source)::varchar || ':' || source, '-')
            || coalesce(strlen(lang)::varchar || ':' || lang, '-') || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') as head,
        list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)), lambda c, b:
            list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)) as crc
    from documents
),
l as (
    select doc_id, tree, sha256(head || coalesce(strlen(text)::varchar || ':' || text, '-')) as leaf,
        case when xor(crc, 4294967295::bigint) % 3 = 0
            then sha256(head || coalesce(strlen(text)::varchar || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as other
    from f
),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx from l),
nodes as (
    select tree, 0 as level, idx, leaf as digest, null::varchar[] as run from p
    union all
    select tree, any_value(level) + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), list(digest order by idx)
    from nodes group by tree, idx // 8 having idx // 8 > 0 or count(*) > 1
),
subroots as (select tree, arg_max(digest, level) as digest, max(level) as height from nodes where idx = 0 group by tree),
top as (
    select 0 as level, row_number() over (order by tree) - 1 as idx, digest, null::varchar[] as run from subroots
    union all
    select any_value(level) + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), list(digest order by idx)
    from top group by idx // 8 having idx // 8 > 0 or count(*) > 1
),
root as (select arg_max(digest, level) as digest, max(level) as height from top where idx = 0),
places as (select tree, digest, height, row_number() over (order by tree) - 1 as idx from subroots),
steps as (
    select p.doc_id, p.leaf, n.level as lvl, n.run, (p.idx // (8 ** (n.level - 1))::bigint) % 8 + 1 as place
    from p join nodes n on n.tree = p.tree and n.level > 0 and n.idx = p.idx // (8 ** n.level)::bigint
    union all
    select p.doc_id, p.leaf, 1000 + t.level, t.run, (s.idx // (8 ** (t.level - 1))::bigint) % 8 + 1
    from p join places s on s.tree = p.tree join top t on t.level > 0 and t.idx = s.idx // (8 ** t.level)::bigint
),
proofs as (
    select doc_id, leaf, sha256(string_agg(array_to_string(run[:place - 1], '') || array_to_string(run[place + 1:], ''), '' order by lvl)) as proof_sha256,
        list({'h': array_to_string(run[:place - 1], ''), 't': array_to_string(run[place + 1:], '')} order by lvl) as steps
    from steps group by doc_id, leaf
),
folds as (
    select p.doc_id, p.leaf, s.digest as subroot, r.digest as root, coalesce(q.proof_sha256, sha256('')) as proof_sha256,
        list_reduce(list_prepend({'h': coalesce(p.other, p.leaf), 't': ''}, coalesce(q.steps, [])), lambda a, b: {'h': sha256(b.h || a.h || b.t), 't': ''}).h as folded_root
    from p join subroots s on s.tree = p.tree cross join root r left join proofs q on q.doc_id is not distinct from p.doc_id and q.leaf = p.leaf
)
select *, folded_root = root as verified from folds""",
    "op13_fill_in_middle": """
with h as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
n as (
    select doc_id, text, length(text) as n, ('0x' || x[1:8])::bigint % (length(text) + 1) as a, ('0x' || x[9:16])::bigint % (length(text) + 1) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || x[17:24])::bigint % 100 >= 90 then 'plain'
            when ('0x' || x[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form
    from h
),
c as (select *, substr(text, 1, least(a, b)) as prefix, substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) as middle, substr(text, greatest(a, b) + 1) as suffix from n)
select doc_id, n::bigint as n, form, case when form <> 'plain' then least(a, b) end::bigint as prefix_chars, case when form <> 'plain' then greatest(a, b) - least(a, b) end::bigint as middle_chars,
    sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
    sha256(text) as restored_sha256
from c""",
}
