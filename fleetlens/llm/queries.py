"""The registered queries of this subpackage, with production parameters over whole tables, and SQL where it can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import ann, licenses, neardup, ngramjoin, packing, quality, resample, sentencepiece, speculate, tokens_out, toxicity, variants, warc
from fleetlens.llm.bpe import public_path
from fleetlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encoded(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_out.token_table(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = speculate.encoded(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), decode=True)
    return out.select(
        F.col("id").alias("doc_id"), F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_nearest_neighbours, op3_warc_index, op4_toxicity, op5_embedding_near_dedup, op6_best_fit_packing,
        op7_ngram_jaccard_join, op8_sentencepiece, op9_license_scan, op10_token_ids, op11_spelling_variants, op12_importance_resampling, op13_bpe,
    )
}

_REACH = """
    ends as (select a, b from links union all select b, a from links),
    reach(id, other) as (select id, id from nodes union select reach.id, ends.b from reach join ends on reach.other = ends.a)
"""

#: DuckDB has no crc32: the table of its rule for a byte, and the crc32 of the UTF-8 bytes of a string ``s`` by it.
_CRC_TABLE = "crc_table as (select list_transform(range(256), lambda i: list_reduce([i::ubigint, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) as tbl)"
_CRC = "xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, strlen(s) * 2, 2), lambda i: ('0x' || substr(hex(encode(s)), i, 2))::ubigint)), lambda c, b: xor(tbl[(xor(c, b) & 255)::bigint + 1], c >> 8)), 4294967295::ubigint)::bigint"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op11_spelling_variants": f"""
        with recursive {_CRC_TABLE},
        r as (select doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
        d as (select concat(doc_id, ':', run) as s, run, count(*) as n from r where length(run) >= 7 group by all),
        h as (select run, n, {_CRC} as h from d, crc_table),
        w as (select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
        v as (select word, cast(sum(n) as bigint) as n from w where length(word) >= 7 group by word having sum(n) >= 2),
        k as (select word, n, unnest(range(1, length(word) + 1)) as p from v),
        wild as (select word, n, p, left(word, p - 1) as a, substr(word, p + 1) as b from k),
        cut as (select distinct word, n, a || b as short from wild),
        pairs as (
            select x.word, y.word as other, y.n as other_n from wild x join wild y using (p, a, b) where x.word <> y.word
            union all select cut.word, v.word, v.n from cut join v on v.word = short
            union all select v.word, cut.word, cut.n from cut join v on v.word = short
        ),
        near as (select word, count(*) as n_near, first(other order by other_n desc, other) as best, max(other_n) as best_n from pairs group by word),
        f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * v.n then best end as form, case when best_n >= 10 * v.n then best_n end as form_n from v left join near using (word)),
        chain(word, root) as (select word, word from f union all select chain.word, f.form from chain join f on f.word = chain.root where f.form is not null),
        ends as (select chain.word, root from chain join f on f.word = root where f.form is null)
        select f.word, form, root, n, n_near, form_n from f join ends using (word)
    """,
    "op12_importance_resampling": f"""
        with {_CRC_TABLE},
        t as (select 0 as k, doc_id as id, text from documents union all select 1, row_number() over (), text from benchmark),
        w as (select k, id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from t),
        g as (
            select k, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) as s from w
        ),
        n as (select k, id, s, count(*) as n from g group by all),
        b as (select s, {_CRC} % 10000 as bucket from (select distinct s from n), crc_table),
        x as (select k, id, bucket, n from n join b using (s)),
        c as (select bucket, coalesce(sum(n) filter (k = 0), 0)::double as s, coalesce(sum(n) filter (k = 1), 0)::double as t from x group by bucket),
        total as (select sum(s) as s, sum(t) as t from c),
        gain as (select bucket, floor(1000 * ln(((c.t + 1) * (total.s + 10000)) / ((c.s + 1) * (total.t + 10000))))::bigint as gain from c, total),
        weight as (select id, sum(n) as n_features, sum(n * gain) as weight from x join gain using (bucket) where k = 0 group by id),
        d as (
            select id, len(ws) >= 20 as fits, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || left(sha256('42:' || id), 8))::bigint as h
            from w left join weight using (id) where k = 0
        ),
        e as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from d),
        o as (select id, row_number() over (order by score desc, id) as place from e where fits)
        select id as doc_id, n_features, weight, score, case when place <= (select count(*) * 5 // 100 from o) then place end as rank from e left join o using (id)
    """,
    "op3_warc_index": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        q as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha256(body) as payload_digest from p),
        f as (select payload_digest, min(page_id) as first from q where payload_bytes >= 100 group by 1)
        select page_id, payload_bytes, payload_digest,
               case when first < page_id then 'revisit' else 'response' end as record_type,
               case when first < page_id then first end as refers_to
        from q left join f using (payload_digest)
    """,
    "op5_embedding_near_dedup": f"""
        with recursive v as (select vec_id as id, label, cast(embedding as double[]) as e from embeddings),
        u as (select id, label, e, sqrt(list_inner_product(e, e)) as n from v),
        links as (
            select a.id as a, b.id as b from u a join u b on a.label = b.label and a.id < b.id
            where a.n > 0 and b.n > 0 and list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93
        ),
        nodes as (select id from v), {_REACH},
        degree as (select a, count(*) as n from ends group by a)
        select id as vec_id, coalesce(any_value(degree.n), 0) as n_links, min(other) as component_id, id = min(other) as kept
        from reach left join degree on degree.a = id group by id
    """,
    "op7_ngram_jaccard_join": f"""
        with recursive w as (
            select doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
        ),
        s as (
            select id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                            when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w
        ),
        n as (select id, cast(len(sh) as bigint) as n from s),
        x as (select id, unnest(sh) as t from s),
        pairs as (select p.id as a, q.id as b, count(*) as n_both from x p join x q on p.t = q.t and p.id < q.id group by all),
        links as (select a, b from pairs join n m on m.id = a join n o on o.id = b where 100 * n_both >= 90 * (m.n + o.n - n_both)),
        nodes as (select id from n), {_REACH}
        select n.id as doc_id, n.n as n_shingles, min(other) as component_id from n join reach on reach.id = n.id group by all
    """,
}
