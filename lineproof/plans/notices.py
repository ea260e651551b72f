"""Queries over documents as notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineproof.functions import text as X
from lineproof.operators import lines as L
from lineproof.sources.views import table

KEY_SQL = r"lower(regexp_replace(line, '\s+', '', 'g'))"
LINES_SQL = f"""raw_lines as (select doc_id, unnest(string_split(text, chr(10))) as line0, unnest(range(len(string_split(text, chr(10))))) as pos0 from documents),
    lines as (select doc_id, pos0::int as pos, trim(line0) as line from raw_lines where regexp_matches(line0, '[\\pL\\pN]')),
    keyed as (select *, {KEY_SQL} as line_key from lines),
    firsts as (select * from keyed qualify row_number() over (partition by doc_id, line_key order by pos) = 1),
    inventory as (select *, row_number() over (partition by doc_id order by pos) as ordinal from firsts)"""
QUOTED_SQL = f"""{LINES_SQL},
    quotes as (select lower(regexp_replace(text, '\\s+', '', 'g')) as quote_key, text from benchmark),
    equal as (select distinct lower(regexp_replace(q, '\\s+', '', 'g')) as k from (select unnest(string_split(text, chr(10))) as q from benchmark)),
    keys as (select distinct line_key from inventory),
    hits as (select line_key from keys where line_key in (select k from equal)
        or (length(line_key) >= 8 and exists (select 1 from quotes where contains(quote_key, line_key))))"""


def docs(spark, sf):
    return table(spark, sf, "documents")


def s1_text_scan(spark, sf):
    return L.accepted_texts(docs(spark, sf), 20_000)


def s6_segments(spark, sf):
    return L.segments(docs(spark, sf), 2000).select("doc_id", "piece", F.length("part").alias("n_chars"), F.md5("part").alias("part_md5"))


def s7_geometry_by_occurrence(spark, sf):
    found = L.source_lines(docs(spark, sf))
    return L.attach_by_occurrence(found, found.filter(F.col("pos") % 3 != 0))


def a1_line_inventory(spark, sf):
    return L.line_inventory(docs(spark, sf)).select("doc_id", "ordinal", "line_id", "pos", F.md5("line").alias("line_md5"))


def j3_citation_coverage(spark, sf):
    return L.citation_coverage(docs(spark, sf), table(spark, sf, "benchmark"))


def a2_coverage_totals(spark, sf):
    t = j3_citation_coverage(spark, sf)
    return t.agg(F.count(F.lit(1)).alias("n_notices"), F.sum("total").alias("total"), F.sum("covered").alias("covered"), F.sum("uncovered").alias("uncovered"), F.count_if(F.col("covered") > 0).alias("n_quoted"))


def j1_evidence_match(spark, sf):
    return L.evidence_pairs(docs(spark, sf), table(spark, sf, "benchmark"))


def j2_unique_provenance(spark, sf):
    pairs = L.evidence_pairs(docs(spark, sf), table(spark, sf, "benchmark"))
    found = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_pages"), F.min("doc_id").alias("page"))
    every = table(spark, sf, "benchmark").select("item_id").join(found, "item_id", "left")
    one = F.coalesce(F.col("n_pages") == 1, F.lit(False))
    return every.select("item_id", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.when(one, F.col("page")).alias("page"), F.when(one, "supported").otherwise("needs_review").alias("state"))


def j5_unquoted_lines(spark, sf):
    return L.unquoted_lines(docs(spark, sf), table(spark, sf, "benchmark"))


def j16_retry_context(spark, sf):
    return L.context_neighbours(L.source_lines(docs(spark, sf)), F.length("line") % 11 == 0, F.length("line") % 13 == 0)


def p4_script_share(spark, sf):
    share = X.share_of(F.col("text"), "[À-ÿ]")
    return docs(spark, sf).select("doc_id", F.round(share, 6).alias("share"), (share >= 0.08).alias("appears"))


def p15_full_detail(spark, sf):
    return L.source_lines(docs(spark, sf)).select("doc_id", "pos", F.col("line").rlike("[,;·]|및|또는|그러나|다만").alias("full_detail"))


def p10_layout_kind(spark, sf):
    line = F.col("line")
    kind = F.when(line.rlike(r"^\s*([-•*·]|\d+[.)])"), "list").when(F.length(line) <= 20, "caption").when(~line.rlike(r"[.!?]$") & (F.length(line) <= 60), "heading").when(line.rlike("(?i)\\b(if|only|unless|must)\\b"), "condition").otherwise("paragraph")
    return L.source_lines(docs(spark, sf)).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def f1_comparison_key(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.comparison_key(F.col("text"))).alias("key_md5"), F.length(X.spaced_key(F.col("text"))).alias("n_spaced"))


def f26_derived_id(spark, sf):
    return docs(spark, sf).select("doc_id", X.derived_id("block-", F.col("text")).alias("block_id"))


def f30_printed_values(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(F.regexp_extract_all(F.upper("text"), F.lit("([0-9]+)"), F.lit(1))).alias("n_values"), F.array_join(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)), "|").alias("printed"))


def f2_exact_values(spark, sf):
    from lineproof.functions import literals as V

    t = F.col("text")
    return docs(spark, sf).select("doc_id", F.array_join(F.array_sort(V.emails(t)), "|").alias("emails"))


def a12_pass_dedup(spark, sf):
    """Lines of a page pass and a footer pass, first pass first, keys without punctuation."""
    from pyspark.sql import Window

    page = L.source_lines(docs(spark, sf)).withColumn("pass", F.lit(1))
    both = page.unionByName(page.filter("pos % 2 = 0").withColumn("pass", F.lit(2))).withColumn("k", F.lower(F.regexp_replace("line", r"[^\p{L}\p{N}]", "")))
    w = Window.partitionBy("doc_id", "k").orderBy("pass", "pos")
    return both.withColumn("n", F.row_number().over(w)).filter("n = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("pass").alias("last_pass"))


def a19_gap_messages(spark, sf):
    found = L.line_inventory(docs(spark, sf)).filter(F.length("line") < 25)
    nums = F.array_join(F.transform(F.array_sort(F.collect_set("ordinal")), lambda i: i.cast("string")), ", ")
    return found.groupBy("doc_id").agg(F.concat(F.lit("page 1, recovered lines "), nums).alias("message"))


def a20_request_plan(spark, sf):
    return L.request_plan(docs(spark, sf))


def k3_examples(spark, sf):
    ids = F.array_sort(F.collect_list("line_id"))
    more = F.greatest(F.size(ids) - 5, F.lit(0))
    return L.line_inventory(docs(spark, sf)).groupBy("doc_id").agg(F.concat(F.array_join(F.slice(ids, 1, 5), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")).alias("examples"))


def s4_assembled_pages(spark, sf):
    return L.assembled_pages(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("marked").alias("marked_md5"), "n_blank", "n_pages")


def s3_split_pages(spark, sf):
    marked = L.assembled_pages(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return L.split_pages(marked, "conv_id").select("conv_id", "page", F.md5("text").alias("text_md5"))


def s3b_page_faults(spark, sf):
    """Marked conversations, damaged in turn: text before the first page, a page repeated, renumbered, left out, two swapped."""
    marked = L.assembled_pages(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    n, k, pages = F.col("n_pages"), F.col("conv_id") % 6, F.col("marked")
    last = F.concat(F.lit("\n[Page "), n.cast("string"), F.lit("]"))
    damaged = (
        F.when(k == 1, F.concat(F.lit("loose\n"), pages)).when(k == 2, F.concat(pages, F.lit("\n[Page 1]\nagain"))).when(k == 3, F.concat(pages, F.lit("\n[Page 99]\nfar")))
        .when(k == 4, F.lit("plain text")).when(k == 5, F.concat(F.lit("[Page 2]\nb\n[Page 1]\na"))).otherwise(pages)
    )
    told = F.when(k == 5, F.lit(2)).otherwise(n).cast("int")
    return L.page_faults(marked.withColumn("marked", damaged).withColumn("told", told), "conv_id", F.col("told")).filter("fault is not null")


def s13_web_links(spark, sf):
    return L.web_links(table(spark, sf, "pages")).select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"))


def w12_batches(spark, sf):
    """Lines as units of their notice."""
    return L.packed_batches(L.source_lines(docs(spark, sf)), F.length("line"), 4, 300, "doc_id")


def s2_ingest_batches(spark, sf):
    """Documents as uploaded files: per-file and per-batch byte caps and the file count cap of a batch."""
    kind = F.when(F.col("doc_id") % 50 == 7, ".exe").otherwise(".PNG")
    d = docs(spark, sf).select(F.floor(F.col("doc_id") / 8).alias("batch_id"), F.octet_length("text").alias("n"), F.lower(kind).isin(L.FILE_TYPES).alias("allowed"))
    b = d.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_bytes"), F.max("n").alias("largest"), F.bool_and("allowed").alias("allowed"))
    return b.select("batch_id", "n_files", "n_bytes", F.when(~F.col("allowed"), "type").when(F.col("n_files") > 12, "count").when(F.col("largest") > 15_000, "file size").when(F.col("n_bytes") > 50_000, "batch size").otherwise("accepted").alias("status"))


def j17_blocked_source(spark, sf):
    found = L.line_inventory(docs(spark, sf))
    return found.join(L.quoted_lines(found, table(spark, sf, "benchmark")), "line_key", "left_semi").select("doc_id", "line_id")


def c11_unavailable(spark, sf):
    d = docs(spark, sf)
    lines = L.line_inventory(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    status = F.when(X.count_of(F.col("text"), r"\p{L}") < 400, "unavailable").otherwise("readable")
    return d.join(lines, "doc_id", "left").select("doc_id", status.alias("status"), F.coalesce("n_lines", F.lit(0)).alias("n_unverified"))


QUERIES = {f.__name__: f for f in (s1_text_scan, s2_ingest_batches, s3_split_pages, s3b_page_faults, s4_assembled_pages, s6_segments, s7_geometry_by_occurrence, s13_web_links, a1_line_inventory, a2_coverage_totals, a12_pass_dedup, a19_gap_messages, a20_request_plan, j1_evidence_match, j2_unique_provenance, j3_citation_coverage, j5_unquoted_lines, j16_retry_context, j17_blocked_source, p4_script_share, p10_layout_kind, p15_full_detail, f1_comparison_key, f2_exact_values, f26_derived_id, f30_printed_values, k3_examples, w12_batches, c11_unavailable)}

PAIRS_SQL = r"""qparts as (select item_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g')), lambda x: x <> '') as p from benchmark),
    solid as (select doc_id, regexp_replace(text, '\s+', '', 'g') as t, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g')), lambda x: x <> '') as p from documents),
    needs as (select item_id, line, count(*) as need from (select item_id, unnest(p) as line from qparts where len(p) > 1) group by all),
    haves as (select doc_id, line, count(*) as have from (select doc_id, unnest(p) as line from solid) where line in (select line from needs) group by all),
    pairs as (select doc_id, item_id from solid join qparts on len(qparts.p) = 1 and contains(t, qparts.p[1])
        union all select doc_id, item_id from haves join needs using (line) where have >= need group by doc_id, item_id
        having count(*) = (select count(*) from needs n where n.item_id = needs.item_id))"""
COVER_SQL = f"""with {QUOTED_SQL} select doc_id, count(*) as total, count(h.line_key) as covered, count(*) - count(h.line_key) as uncovered
    from inventory left join hits h using (line_key) group by doc_id"""
SQL = {
    "s1_text_scan": "select doc_id, case when text is null or trim(text) = '' then 'empty' when strlen(text) > 20000 then 'size' else 'accepted' end as status, strlen(text)::int as n_bytes from documents",
    "s2_ingest_batches": """select doc_id // 8 as batch_id, count(*) as n_files, sum(strlen(text))::bigint as n_bytes, case when bool_or(doc_id % 50 = 7) then 'type' when count(*) > 12 then 'count'
        when max(strlen(text)) > 15000 then 'file size' when sum(strlen(text)) > 50000 then 'batch size' else 'accepted' end as status from documents group by 1""",
    "s3_split_pages": "select conv_id, (turn + 1)::int as page, md5(trim(text)) as text_md5 from conversations",
    "s3b_page_faults": """select conv_id, case conv_id % 6 when 1 then 'text before the first page' when 2 then 'repeated page' when 3 then 'page out of range' when 4 then 'no marker' else 'out of order' end as fault
        from (select distinct conv_id from conversations) where conv_id % 6 > 0""",
    "s4_assembled_pages": """select conv_id, md5(string_agg('[Page ' || (turn + 1) || ']' || chr(10) || coalesce(trim(text), ''), chr(10) order by turn, trim(text))) as marked_md5,
        count(*) filter (where coalesce(trim(text), '') = '') as n_blank, count(*) as n_pages from conversations group by conv_id""",
    "s6_segments": """with n as (select doc_id, text, unnest(range(greatest(ceil(length(text) / 2000)::int, 1))) as piece from documents)
        select doc_id, piece::int as piece, length(substr(text, piece * 2000 + 1, 2000))::int as n_chars, md5(substr(text, piece * 2000 + 1, 2000)) as part_md5 from n""",
    "s7_geometry_by_occurrence": f"""with {LINES_SQL}, l as (select *, row_number() over (partition by doc_id, line order by pos) as k from lines),
        s as (select doc_id, line, pos as span_pos, row_number() over (partition by doc_id, line order by pos) as k from lines where pos % 3 <> 0)
        select l.doc_id, pos, l.k, span_pos from l left join s on s.doc_id = l.doc_id and s.line = l.line and s.k = l.k""",
    "s13_web_links": r"select page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host from pages where regexp_matches(url, '^https?://[^/@\s]+([/?#]|$)') and length(url) <= 2048",
    "a1_line_inventory": f"with {LINES_SQL} select doc_id, ordinal, printf('P001-L%04d', ordinal) as line_id, pos, md5(line) as line_md5 from inventory",
    "a2_coverage_totals": f"select count(*) as n_notices, sum(total)::bigint as total, sum(covered)::bigint as covered, sum(uncovered)::bigint as uncovered, count(*) filter (where covered > 0) as n_quoted from ({COVER_SQL})",
    "a12_pass_dedup": f"""with {LINES_SQL}, passes as (select *, 1 as pass from lines union all select *, 2 from lines where pos % 2 = 0),
        k as (select *, lower(regexp_replace(line, '[^\\pL\\pN]', '', 'g')) as k from passes),
        f as (select * from k qualify row_number() over (partition by doc_id, k order by pass, pos) = 1)
        select doc_id, count(*) as n_lines, max(pass) as last_pass from f group by doc_id""",
    "a19_gap_messages": f"with {LINES_SQL} select doc_id, 'page 1, recovered lines ' || string_agg(ordinal::varchar, ', ' order by ordinal) as message from inventory where length(line) < 25 group by doc_id",
    "a20_request_plan": f"with {LINES_SQL} select sha256(line) as chunk_id, min(doc_id) as first_notice, count(*) as n_places, min(length(line))::int as n_chars from lines group by 1",
    "j1_evidence_match": f"with {PAIRS_SQL} select doc_id, item_id from pairs",
    "j2_unique_provenance": f"""with {PAIRS_SQL}, n as (select item_id, count(*) as n, min(doc_id) as page from pairs group by 1)
        select b.item_id, coalesce(n, 0) as n_pages, case when n = 1 then page end as page, case when n = 1 then 'supported' else 'needs_review' end as state from benchmark b left join n using (item_id)""",
    "j3_citation_coverage": COVER_SQL,
    "j5_unquoted_lines": f"""with {QUOTED_SQL}, free as (select * from inventory where line_key not in (select line_key from hits)),
        r as (select doc_id, row_number() over (partition by doc_id order by ordinal) as rank, printf('P001-L%04d', ordinal) as line_id, count(*) over (partition by doc_id) as in_all from free)
        select * from r where rank <= 30""",
    "j16_retry_context": f"""with {LINES_SQL}, t as (select *, length(line) % 11 = 0 as target from lines)
        select distinct a.doc_id, a.pos from t a join t b on a.doc_id = b.doc_id and b.target and abs(a.pos - b.pos) <= 3 where not a.target and length(a.line) % 13 <> 0""",
    "j17_blocked_source": f"with {QUOTED_SQL} select doc_id, printf('P001-L%04d', ordinal) as line_id from inventory where line_key in (select line_key from hits)",
    "p4_script_share": r"""with n as (select doc_id, length(regexp_replace(text, '[^À-ÿ]', '', 'g'))::double as a, length(regexp_replace(text, '\s', '', 'g')) as b from documents)
        select doc_id, round(case when b > 0 then a / b else 0 end, 6) as share, (case when b > 0 then a / b else 0 end) >= 0.08 as appears from n""",
    "p10_layout_kind": rf"""with {LINES_SQL} select case when regexp_matches(line, '^\s*([-•*·]|\d+[.)])') then 'list' when length(line) <= 20 then 'caption'
        when not regexp_matches(line, '[.!?]$') and length(line) <= 60 then 'heading' when regexp_matches(line, '(?i)\b(if|only|unless|must)\b') then 'condition' else 'paragraph' end as kind, count(*) as n from lines group by 1""",
    "p15_full_detail": f"with {LINES_SQL} select doc_id, pos, regexp_matches(line, '[,;·]|및|또는|그러나|다만') as full_detail from lines",
    "f1_comparison_key": r"select doc_id, md5(lower(regexp_replace(text, '\s+', '', 'g'))) as key_md5, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::int as n_spaced from documents",
    "f2_exact_values": r"""select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})'), lambda x: lower(x)))), '|') as emails from documents""",
    "f26_derived_id": """with s as (select doc_id, 'block-' || text as v from documents)
        select doc_id, case when length(v) <= 128 then v else substr(v, 1, 111) || '-' || substr(sha256(v), 1, 16) end as block_id from s""",
    "f30_printed_values": "select doc_id, len(regexp_extract_all(text, '[0-9]+'))::int as n_values, array_to_string(regexp_extract_all(text, '[0-9]+'), '|') as printed from documents",
    "k3_examples": f"""with {LINES_SQL} select doc_id, array_to_string(list(printf('P001-L%04d', ordinal) order by ordinal)[1:5], ', ')
        || case when count(*) > 5 then ' (+' || (count(*) - 5) || ' more)' else '' end as examples from inventory group by doc_id""",
    "w12_batches": f"""with recursive {LINES_SQL}, o as (select doc_id, pos, length(line) as size, row_number() over (partition by doc_id order by pos) as i from lines),
        f as (select doc_id, pos, i, size as held, 1 as n, 0 as batch from o where i = 1
            union all select o.doc_id, o.pos, o.i, case when f.n >= 4 or f.held + o.size > 300 then o.size else f.held + o.size end,
                case when f.n >= 4 or f.held + o.size > 300 then 1 else f.n + 1 end, f.batch + case when f.n >= 4 or f.held + o.size > 300 then 1 else 0 end
            from f join o on o.doc_id = f.doc_id and o.i = f.i + 1)
        select doc_id, pos, batch::int as batch from f""",
    "c11_unavailable": f"""with {LINES_SQL}, n as (select doc_id, count(*) as n_lines from inventory group by 1)
        select doc_id, case when length(regexp_replace(text, '[^\\pL]', '', 'g')) < 400 then 'unavailable' else 'readable' end as status, coalesce(n_lines, 0) as n_unverified from documents left join n using (doc_id)""",
}
