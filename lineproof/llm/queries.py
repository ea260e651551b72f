"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineproof.llm import alignment, ann, archive, bpe, langid, lexical, licenses, lines, neardup, packing, pii, substrings, topk
from lineproof.llm.shared import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_archive_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_pages(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.key_of(spark)).select("doc_id", "n_entities", "text")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats_removed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_line_dedup, op3_archive_converter, op4_language_id, op5_best_fit_packing, op6_exact_top_k, op7_byte_bpe, op8_anisotropic_search, op9_license_scan, op10_surrogates,
        op11_substring_dedup, op12_ranked_search, op13_token_alignment,
    )
}

SQL: dict[str, str] = {
    "op1_near_duplicates": r"""
        with recursive cut as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
        sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as s from cut),
        grams as (select doc_id, unnest(s) as g from sets),
        common as (select a.doc_id as x, b.doc_id as y, count(*) as n_both from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
        links as (select x, y from common join sets a on a.doc_id = x join sets b on b.doc_id = y
            where 100 * n_both >= 85 * (len(a.s) + len(b.s) - n_both)),
        edges as (select x, y from links union select y, x from links),
        reach as (select doc_id, doc_id as other from sets union select r.doc_id, e.y from reach r join edges e on e.x = r.other)
        select s.doc_id, len(s.s)::bigint as n_shingles, min(other) as component_id, s.doc_id = min(other) as kept
        from sets s join reach r on r.doc_id = s.doc_id group by s.doc_id, s.s""",
    "op2_line_dedup": """
        with cut as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
        lines as (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos from cut),
        keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
        repeated as (select key, max(doc_id) as keeper from keyed where length(key) >= 20
            group by key having count(distinct doc_id) >= 3)
        select doc_id, count(*) as n_lines, count(*) filter (where keeper <> doc_id) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where keeper is null or keeper = doc_id), '')) as kept_sha256
        from keyed left join repeated using (key) group by doc_id""",
    "op3_archive_converter": r"""
        with bits as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
        coded as (select page_id, hex, strlen(body) as payload_bytes, list_aggregate(list_transform(range(32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::bigint
            >> (35 - 5 * (i % 8)))::bigint) & 31)::int, 1)), 'string_agg', '') as payload_digest from bits),
        firsts as (select hex, min(page_id) as first_page from coded group by hex)
        select c.page_id, payload_bytes, payload_digest,
            case when first_page = c.page_id then 'response' else 'revisit' end as record_type,
            case when first_page <> c.page_id then first_page end as refers_to,
            coalesce(regexp_replace(url, '\s', '%20', 'g'), 'urn:page:' || c.page_id) as target_uri, '2024-01-01T00:00:00Z' as warc_date
        from coded c join firsts using (hex) join pages p on p.page_id = c.page_id""",
    "op6_exact_top_k": """
        with scaled as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        pairs as (select q.vec_id as query_id, c.vec_id,
            list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
            from scaled q join scaled c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
        select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 10""",
    "op11_substring_dedup": r"""
        with cut as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
        windows as (select doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) as g
            from (select doc_id, w, unnest(range(greatest(len(w) - 49, 0))) as i from cut)),
        lost as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as low from windows) where doc_id > low),
        covered as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from lost)),
        words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from cut),
        marked as (select words.*, covered.p is not null as gone from words left join covered using (doc_id, p)),
        kept as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by p) filter (where not gone) as t from marked group by doc_id)
        select cut.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from cut left join kept using (doc_id)""",
    "op12_ranked_search": r"""
        with cut as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
        docs as (select doc_id, w, len(w)::bigint as n from cut where len(w) > 0),
        stats as (select count(*)::bigint as nn, sum(n)::bigint as ll from docs),
        tf as (select doc_id, n, t, count(*)::bigint as tf from (select doc_id, n, unnest(w) as t from docs) group by all),
        df as (select t, count(*)::bigint as df from tf group by t),
        items as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
        weighted as (select item_id, t, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as w from items join df using (t), stats),
        scored as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
            from weighted join tf using (t), stats group by all),
        ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
        select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 50""",
}
