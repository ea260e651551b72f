"""Queries of verdicts and audits over printed values (T1), positioned units (G1, G2) and document lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineproof.functions import literals as V
from lineproof.functions import text as X
from lineproof.functions import verdicts as J
from lineproof.operators import audits as A
from lineproof.operators import layout as Y
from lineproof.operators import lines as L
from lineproof.plans.literals import MISSING, WON
from lineproof.plans.notices import LINES_SQL, QUOTED_SQL
from lineproof.sources import views
from lineproof.sources.views import table

USEFUL = r"[^\s@]+@[^\s@]+\.[A-Za-z][A-Za-z]|https?://|(19|20)[0-9][0-9][.-][0-9]+[.-][0-9]+|0[0-9]+-[0-9]+-[0-9]+"
CLAIM = "[0-9]|que"


def t1(spark, sf):
    return views.t1(spark, sf)


def lines(spark, sf):
    return L.source_lines(table(spark, sf, "documents"))


def damaged_contact(spark, sf):
    """Contacts whose number has a letter for a digit in every fourth notice."""
    broken = F.regexp_replace("contact", ": 02-.", ": 02-O")
    return t1(spark, sf).withColumn("read", F.when(F.col("notice_id") % 4 == 0, broken).otherwise(F.col("contact")))


def p3_glyph_height(spark, sf):
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    polygon = F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h - F.col("l_partkey") % 3))
    return views.g1(spark, sf).select("notice_id", "ord", J.glyph_height(polygon).alias("height"))


def p5_useful_lines(spark, sf):
    return lines(spark, sf).filter((X.count_of(F.col("line"), "[À-ÿ]") >= 2) | F.col("line").rlike(USEFUL)).select("doc_id", "pos")


def p6_readable_gate(spark, sf):
    n = X.count_of(F.col("text"), "[À-ÿ]")
    return table(spark, sf, "documents").select("doc_id", F.when(n < 4, "unavailable").otherwise("readable").alias("status"))


def p7_constraints(spark, sf):
    """Orders as units, line items as block members; every 97th part names an unknown unit."""
    cited = F.when(F.col("l_partkey") % 97 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))
    members = table(spark, sf, "lineitem").select(cited.alias("unit_id"), (F.col("l_suppkey") % 20).alias("block_id"))
    return A.inventory_violations(table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id")), members)


def p8_span_text(spark, sf):
    """Spans whose text is no line of their page; every fifth span was altered."""
    found = lines(spark, sf)
    spans = found.withColumn("line", F.when(F.col("pos") % 5 == 0, F.concat("line", F.lit(" ?"))).otherwise(F.col("line")))
    return spans.join(found.select("doc_id", "line").distinct(), ["doc_id", "line"], "left_anti").select("doc_id", "pos")


def p11_short_cells(spark, sf):
    short = (F.length(F.trim("txt")) <= 8) & ~F.contains("txt", F.lit("\n"))
    return views.g2(spark, sf).groupBy("notice_id", "role").agg(F.bool_and(short).alias("short"))


def p14_recovery(spark, sf):
    rows = damaged_contact(spark, sf)
    need = (F.col("notice_id") % 7 == 0) | (F.size(J.damaged_phones(F.col("read"))) > 0) | (F.col("o_custkey") % 100 < 5)
    return rows.select("notice_id", need.alias("needs_recovery"))


def p16_fragments(spark, sf):
    """Clauses stand for lines that were cut short."""
    clauses = lines(spark, sf).select("doc_id", F.explode(F.split("line", "[,.]")).alias("line")).withColumn("line", F.trim("line"))
    return clauses.withColumn("why", J.fragment(F.col("line"))).filter("why is not null").groupBy("doc_id", "why").agg(F.count(F.lit(1)).alias("n"))


def p17_fee_evidence(spark, sf):
    text = F.when(F.col("notice_id") % 3 == 0, F.concat(F.lit("참가비 "), F.substring_index("amount", " ", -1))).when(F.col("notice_id") % 3 == 1, F.col("amount")).otherwise(F.col("deadline"))
    return t1(spark, sf).select("notice_id", J.fee_issue(text).alias("issue"))


def p21_roles(spark, sf):
    found = t1(spark, sf).select("notice_id", F.posexplode(F.array("deadline", "amount", "contact")).alias("line", "text"))
    return found.select("notice_id", "line", J.role(F.col("text")).alias("role"))


def f10_damaged_phones(spark, sf):
    return damaged_contact(spark, sf).select("notice_id", F.explode(J.damaged_phones(F.col("read"))).alias("printed"))


def scores(spark, sf):
    text = F.concat(F.lit("TOEIC "), F.lit(600) + F.col("notice_id") % 300, F.lit("점 이상 또는 TOEFL iBT "), F.lit(60) + F.col("o_custkey") % 50)
    return t1(spark, sf).withColumn("source", text).withColumn("told", F.when(F.col("notice_id") % 6 == 0, F.lit("TOEIC 990")).otherwise(F.regexp_replace(text, "점 이상 또는", " or")))


def f12_exam_scores(spark, sf):
    return scores(spark, sf).select("notice_id", F.explode(J.exam_scores(F.col("source"))).alias("score"))


def j25_score_claims(spark, sf):
    return scores(spark, sf).select("notice_id", F.explode(F.array_except(J.exam_scores(F.col("source")), J.exam_scores(F.col("told")))).alias("lost"))


def f13_romanized(spark, sf):
    return t1(spark, sf).select("notice_id", V.romanized(F.col("deadline")).alias("romanized"))


def f15_closed_cells(spark, sf):
    n = F.col("notice_id")
    cell = F.when(n % 4 == 0, F.concat(F.lit("최대 "), F.regexp_extract("amount", "([0-9]+)", 1), F.lit("원"))).when(n % 4 == 1, F.concat(n % 90 + 10, F.lit("명 내외"))).when(n % 4 == 2, F.lit("제한 없음")).otherwise(F.col("deadline"))
    return t1(spark, sf).select("notice_id", J.closed_cell(cell).alias("english"))


def f16_fallback_text(spark, sf):
    n = F.col("notice_id")
    cell = F.when(n % 3 == 0, F.concat(n % 90 + 10, F.lit("명 내외"))).when(n % 3 == 1, F.col("english")).otherwise(F.concat(F.lit("마감 "), n))
    return t1(spark, sf).select("notice_id", J.fallback_text(cell).alias("shown"))


def f17_lost_phrases(spark, sf):
    source = F.concat(F.lit('Bring "Form No '), F.col("notice_id"), F.lit('" (two copies)'))
    told = F.when(F.col("notice_id") % 5 == 0, F.lit("Bring two copies")).otherwise(F.concat(F.lit("Bring form no "), F.col("notice_id"), F.lit(" in copies of two")))
    return t1(spark, sf).select("notice_id", F.explode(J.lost_phrases(source, told)).alias("phrase"))


def f19_unsupported_values(spark, sf):
    return t1(spark, sf).select("notice_id", F.explode(J.unsupported_values(F.col("english"), F.col("amount"))).alias("added"))


def f21_pair_issues(spark, sf):
    return views.t1(spark, sf, dear=True).select("notice_id", F.explode(J.pair_issues(F.concat_ws("\n", "amount", "contact"), F.col("english"))).alias("issue"))


def f24_glossary(spark, sf):
    told = F.concat(F.lit("Support money KRW "), F.col("notice_id"), F.lit(", question: office"))
    rules = [("지원금", "support money", "grant"), ("문의", "question", "inquiries"), ("장학금", "grant", "scholarship")]
    source = F.when(F.col("notice_id") % 2 == 0, F.col("amount")).otherwise(F.concat_ws(" ", "amount", "contact"))
    return t1(spark, sf).select("notice_id", J.glossary_applied(source, told, rules).alias("english"))


def f27_display_text(spark, sf):
    optional = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(" (optional)"))).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" | ", F.nullif("p_name", F.lit("small ring")), optional, F.concat(F.lit("size "), F.col("p_size"))).alias("shown"))


def f31_answer_scoring(spark, sf):
    """Each turn as an answer to the one before it in its conversation; every second conversation repeats it between dashes."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    asked = F.lag("text").over(w)
    given = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("- "), asked, F.lit(" -"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").withColumn("right", J.scored(asked, given)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("n_right"))


def f32_claim_removal(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", F.md5(J.without_claims(F.col("line"), CLAIM)).alias("kept_md5"))


def f35_work_list(spark, sf):
    """Display fields that still hold accented letters, one row a field."""
    fields = F.explode(F.map_from_arrays(F.array(F.lit("text"), F.lit("source")), F.array("text", "source"))).alias("field", "shown")
    return table(spark, sf, "documents").select("doc_id", fields).filter(F.col("shown").rlike("[À-ÿ]")).select("doc_id", "field")


def u1_single_reading(spark, sf):
    """Amounts that only one of two readings confirms."""
    a = t1(spark, sf).select("notice_id", F.explode(F.transform(V.amounts(F.col("amount")), lambda x: x.cast("long"))).alias("won"))
    b = t1(spark, sf).select("notice_id", F.explode(F.transform(V.english_amounts(F.col("english")), lambda x: x.cast("long"))).alias("won"))
    both = a.withColumn("first", F.lit(1)).join(b.withColumn("second", F.lit(1)), ["notice_id", "won"], "full_outer")
    return both.filter("first is null or second is null").select("notice_id", "won", F.when(F.col("first") == 1, "first").otherwise("second").alias("reading"))


def u6_removed_text(spark, sf):
    """Lines left after those that a benchmark passage equals or holds are gone, numbered anew."""
    found = L.line_inventory(table(spark, sf, "documents"))
    left = found.join(L.quoted_lines(found, table(spark, sf, "benchmark")), "line_key", "left_anti")
    return left.select("doc_id", "line_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")).alias("n"))


def j7_reconciled_units(spark, sf):
    """Units sent back with changes, gaps, repeats, and citations of which some name no unit."""
    units = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("source_text"))
    text = F.when(F.col("unit_id") % 7 == 0, F.concat("source_text", F.lit("!"))).otherwise(F.col("source_text"))
    back = units.filter("unit_id % 11 <> 0").withColumn("source_text", text).withColumn("cited", F.array("unit_id", F.when(F.col("unit_id") % 17 == 0, -1).otherwise(F.col("unit_id"))))
    return A.reconciled_units(units, back.unionByName(back.filter("unit_id % 13 = 0")))


def j18_recovered_contacts(spark, sf):
    alternate = lambda text, conf: F.struct(text.alias("text"), F.lit(conf).alias("conf"))
    rows = damaged_contact(spark, sf).withColumn("alternates", F.array(alternate(F.substring_index("contact", ",", 1), 95), alternate(F.col("contact"), 80), alternate(F.concat("contact", F.lit(" .")), 80), alternate(F.col("read"), 99)))
    usable = lambda t: (F.size(V.phones(t)) > 0) & (F.size(J.damaged_phones(t)) == 0) & (F.size(V.emails(t)) > 0)
    return A.recovered_candidates(rows, "read", "alternates", usable).select("notice_id", F.col("recovered").alias("contact"))


def j19_phrase_places(spark, sf):
    return A.phrase_places(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 6)


def s5_observations(spark, sf):
    """Recognition output in JSON to unit rows on a unit square."""
    item = F.struct("ord", F.concat(F.lit("t"), "l_partkey").alias("text"), (F.col("conf") / 100).alias("score"), F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("box"))
    raw = views.g1(spark, sf).groupBy("notice_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("observed"))
    parsed = F.from_json("observed", "items array<struct<ord int, text string, score double, box array<int>>>")
    i = F.col("item")
    return raw.select("notice_id", F.explode(parsed["items"]).alias("item")).select("notice_id", i["ord"].alias("ord"), i["text"].alias("text"), i["score"].alias("score"), (i["box"][0] / 1000).alias("x"), ((i["box"][3] - i["box"][1]) / 1000).alias("h"))


def s12_reference_match(spark, sf):
    """Passages as references, their first line as title."""
    known = table(spark, sf, "benchmark").withColumn("title", F.substring_index("text", "\n", 1))
    return A.reference_match(table(spark, sf, "documents"), known)


def s14_inline_payloads(spark, sf):
    n = F.col("doc_id")
    raw = F.concat(F.when(n % 3 == 0, F.lit(bytearray(b"\x89PNG"))).otherwise(F.lit(bytearray(b"\x00\x01\x02\x03"))), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    payload = F.concat(F.when(n % 5 == 0, "data:text/plain;base64,").otherwise("data:image/png;base64,"), F.base64(raw))
    return table(spark, sf, "documents").select("doc_id", J.payload_status(payload, 2000).alias("status"))


def a13_folded_duplicates(spark, sf):
    return A.folded_duplicates(lines(spark, sf).withColumn("supported", F.col("pos") % 4 != 0)).select("doc_id", "first_pos", "n_places", "supported")


def w11_byte_chunks(spark, sf):
    """Chunks joined again, so that none is lost or out of order, and whether all keep the bound."""
    found = A.byte_chunks(table(spark, sf, "documents"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "chunk"))), lambda c: c["chunk"]), "")
    return found.groupBy("doc_id").agg(F.md5(whole).alias("joined_md5"), (F.max(F.octet_length("chunk")) <= 480).alias("bounded"))


def k6_catalog_order(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("notice_id"), (F.col("l_partkey") % 5).alias("block"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("ord"))
    return A.catalog_order(rows, "block")


def c9_overlays(spark, sf):
    """One rectangle a row of three units, failed where a reading of it is unsure."""
    rows = views.g1(spark, sf).withColumn("row", F.floor((F.col("ord") - 1) / 3).cast("int"))
    failed = rows.groupBy("notice_id", "row").agg(F.bool_or(F.col("conf") < 55).alias("failed"))
    return Y.union_boxes(rows, "notice_id", "row").join(failed, ["notice_id", "row"])


def c3_region_status(spark, sf):
    """Distinct lines share the outcome of one request: unchanged, translated, or failed where no answer came."""
    regions = lines(spark, sf)
    outcome = L.request_plan(table(spark, sf, "documents")).filter("n_chars % 9 <> 0").select("chunk_id", F.when(F.col("n_chars") % 4 == 0, "unchanged").otherwise("translated").alias("status"))
    told = regions.withColumn("chunk_id", F.sha2("line", 256)).join(outcome, "chunk_id", "left")
    return told.groupBy("doc_id", F.coalesce("status", F.lit("failed")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def x1_answered_chunks(spark, sf):
    """Distinct lines through a callable on the executors; a stand-in that turns them round takes the translator's place."""
    chunks = lines(spark, sf).select(F.sha2("line", 256).alias("chunk_id"), F.col("line").alias("chunk")).distinct()
    return A.translated_chunks(chunks, lambda texts: [t[::-1] for t in texts]).select("chunk_id", F.md5("answer").alias("answer_md5"))


def x4_stand_ins(spark, sf):
    """Lines answered from the benchmark as reference table; others get a labelled placeholder."""
    known = table(spark, sf, "benchmark").select(X.spaced_key(F.col("text")).alias("k"), "item_id").groupBy("k").agg(F.min("item_id").alias("item_id"))
    found = lines(spark, sf).withColumn("k", X.spaced_key(F.col("line"))).join(known, "k", "left")
    return found.select("doc_id", "pos", F.coalesce(F.concat(F.lit("reference "), F.col("item_id")), F.lit("placeholder")).alias("answer"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_glyph_height, p5_useful_lines, p6_readable_gate, p7_constraints, p8_span_text, p11_short_cells, p14_recovery, p16_fragments, p17_fee_evidence, p21_roles,
        f10_damaged_phones, f12_exam_scores, j25_score_claims, f13_romanized, f15_closed_cells, f16_fallback_text, f17_lost_phrases, f19_unsupported_values,
        f21_pair_issues, f24_glossary, f27_display_text, f31_answer_scoring, f32_claim_removal, f35_work_list, u1_single_reading, u6_removed_text, j7_reconciled_units,
        j18_recovered_contacts, j19_phrase_places, s5_observations, s12_reference_match, s14_inline_payloads, a13_folded_duplicates, w11_byte_chunks, k6_catalog_order,
        c9_overlays, c3_region_status, x1_answered_chunks, x4_stand_ins,
    )
}


T1, G1, G2 = (f"{n} as ({views.SQL[n]})" for n in ("t1", "g1", "g2"))
DAMAGED = "'02-O' || substr(lpad((o_custkey % 10000)::varchar, 4, '0'), 2) || '-' || lpad((o_orderkey % 10000)::varchar, 4, '0')"
TOEIC, TOEFL = "'TOEIC=' || (600 + o_orderkey % 300)", "'TOEFL=' || (60 + o_custkey % 50)"
SQL = {
    "p3_glyph_height": f"with {G1} select notice_id, ord, h - (l_partkey % 3) / 2 as height from g1",
    "p5_useful_lines": f"with {LINES_SQL} select doc_id, pos from lines where length(regexp_replace(line, '[^À-ÿ]', '', 'g')) >= 2 or regexp_matches(line, '{USEFUL}')",
    "p6_readable_gate": "select doc_id, case when length(regexp_replace(text, '[^À-ÿ]', '', 'g')) < 4 then 'unavailable' else 'readable' end as status from documents",
    "p7_constraints": """with m as (select case when l_partkey % 97 = 0 then -l_orderkey - 1 else l_orderkey end as k, l_suppkey % 20 as b from lineitem)
        select 'unknown_unit' as rule, k as key, count(*) as detail from m where k not in (select o_orderkey from orders) group by k
        union all select 'shared_unit', k, count(distinct b) from m group by k having count(distinct b) > 1
        union all select 'repeated_unit', o_orderkey, count(*) from orders group by o_orderkey having count(*) > 1""",
    "p8_span_text": f"""with {LINES_SQL}, s as (select doc_id, pos, line || case when pos % 5 = 0 then ' ?' else '' end as t from lines)
        select doc_id, pos from s where not exists (select 1 from lines l where l.doc_id = s.doc_id and l.line = s.t)""",
    "p11_short_cells": f"with {G2} select notice_id, role, bool_and(length(txt) <= 8) as short from g2 group by 1, 2",
    "p14_recovery": "select o_orderkey as notice_id, o_orderkey % 7 = 0 or o_orderkey % 4 = 0 or o_custkey % 100 < 5 as needs_recovery from orders",
    "p16_fragments": rf"""with {LINES_SQL}, w as (select doc_id, case when length(regexp_replace(line, '[^(]', '', 'g')) > length(regexp_replace(line, '[^)]', '', 'g')) then 'open bracket'
        when regexp_matches(line, '(?i)(^|\s)(and|or|of|et|de|mit|und)$') then 'dangling connective' when regexp_matches(line, '^[,;)]') then 'connector start' end as why from (select doc_id, trim(unnest(string_split_regex(line, '[,.]'))) as line from lines))
        select doc_id, why, count(*) as n from w where why is not null group by 1, 2""",
    "p17_fee_evidence": "select o_orderkey as notice_id, case o_orderkey % 3 when 1 then 'award' when 2 then 'no payment wording' end as issue from orders",
    "p21_roles": "select o_orderkey as notice_id, line::int as line, ['deadline', 'funding', 'contact'][line + 1] as role from orders, range(3) r(line)",
    "f10_damaged_phones": f"select o_orderkey as notice_id, {DAMAGED} as printed from orders where o_orderkey % 4 = 0",
    "f12_exam_scores": f"select o_orderkey as notice_id, {TOEIC} as score from orders union all select o_orderkey, {TOEFL} from orders",
    "j25_score_claims": f"select o_orderkey as notice_id, {TOEIC} as lost from orders where o_orderkey % 6 = 0 union all select o_orderkey, {TOEFL} from orders where o_orderkey % 6 = 0",
    "f13_romanized": f"with {T1} select notice_id, replace(deadline, '신청 마감', 'sincheong magam') as romanized from t1",
    "f15_closed_cells": f"""select o_orderkey as notice_id, case o_orderkey % 4 when 0 then 'up to KRW ' || {WON} when 1 then 'about ' || (o_orderkey % 90 + 10) || ' people' when 2 then 'no restriction' end as english from orders""",
    "f16_fallback_text": f"with {T1} select notice_id, case notice_id % 3 when 0 then 'about ' || (notice_id % 90 + 10) || ' people' when 1 then english else '[romanised] magam ' || notice_id end as shown from t1",
    "f17_lost_phrases": """select o_orderkey as notice_id, 'Form No ' || o_orderkey as phrase from orders where o_orderkey % 5 = 0
        union all select o_orderkey, 'two copies' from orders where o_orderkey % 5 <> 0""",
    "f19_unsupported_values": f"select o_orderkey as notice_id, 'amount:1' as added from orders where o_orderkey % 5 = 0 and {WON} <> 1",
    "f21_pair_issues": f"with {MISSING} select notice_id, 'missing:' || missing as issue from m union all select o_orderkey, 'added:amount:1' from orders where o_orderkey % 5 = 0 and {WON} <> 1",
    "f24_glossary": """select o_orderkey as notice_id, 'grant KRW ' || o_orderkey || case when o_orderkey % 2 = 0 then ', question: office' else ', inquiries: office' end as english from orders""",
    "f27_display_text": "select p_partkey, concat_ws(' | ', nullif(p_name, 'small ring'), p_type || case when p_size % 3 = 0 then ' (optional)' else '' end, 'size ' || p_size) as shown from part",
    "f31_answer_scoring": r"""with p as (select conv_id, lag(text) over w as asked, text from conversations window w as (partition by conv_id order by turn, text)),
        n as (select conv_id, lower(regexp_replace(asked, '[^\pL\pN]', '', 'g')) as a, lower(regexp_replace(case when conv_id % 2 = 0 then '- ' || asked || ' -' else text end, '[^\pL\pN]', '', 'g')) as b from p)
        select conv_id, count(*) as n, count(*) filter (where a <> '' and b <> '' and (contains(a, b) or contains(b, a))) as n_right from n group by 1""",
    "f32_claim_removal": rf"""with {LINES_SQL} select doc_id, pos, md5(array_to_string(list_filter(regexp_extract_all(line, '[^,;.]*[,;.]|[^,;.]+$'), lambda c: not regexp_matches(c, '{CLAIM}')), '')) as kept_md5 from lines""",
    "f35_work_list": "select doc_id, 'text' as field from documents where regexp_matches(text, '[À-ÿ]') union all select doc_id, 'source' from documents where regexp_matches(source, '[À-ÿ]')",
    "u1_single_reading": f"""select o_orderkey as notice_id, {WON} as won, 'first' as reading from orders where o_orderkey % 5 = 0 and {WON} <> 1
        union all select o_orderkey, 1, 'second' from orders where o_orderkey % 5 = 0 and {WON} <> 1""",
    "u6_removed_text": f"with {QUOTED_SQL} select doc_id, printf('P001-L%04d', ordinal) as line_id, row_number() over (partition by doc_id order by ordinal)::int as n from inventory where line_key not in (select line_key from hits)",
    "j7_reconciled_units": "select doc_id as unit_id, case when doc_id % 11 = 0 then 'missing' when doc_id % 13 = 0 then 'repeated' when doc_id % 7 = 0 and text is not null then 'changed' when doc_id % 17 = 0 then 'unknown citation' else 'accepted' end as state from documents",
    "j18_recovered_contacts": f"with {T1} select notice_id, contact from t1",
    "j19_phrase_places": r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') as w from documents), b as (select item_id, regexp_extract_all(lower(text), '[\pL\pN]+') as w from benchmark),
        r as (select doc_id, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) as run from d),
        k as (select distinct item_id, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) as run from b)
        select doc_id, item_id, count(*) as n_places from r join k using (run) group by 1, 2""",
    "s5_observations": f"with {G1} select notice_id, ord, 't' || l_partkey as text, conf / 100 as score, x / 1000 as x, h / 1000 as h from g1",
    "s12_reference_match": r"""with k as (select item_id, lower(regexp_replace(text, '\s+', '', 'g')) as w, lower(regexp_replace(split_part(text, chr(10), 1), '\s+', '', 'g')) as title from benchmark),
        d as (select doc_id, lower(regexp_replace(text, '\s+', '', 'g')) as t from documents)
        select doc_id, min(item_id) as item_id from d left join k on (t = w and w <> '') or (title <> '' and contains(t, title)) or (length(w) >= 40 and contains(t, substr(w, 1, 40))) group by 1""",
    "s14_inline_payloads": """select doc_id, case when doc_id % 5 = 0 then 'type' when doc_id % 3 <> 0 then 'magic' when strlen(coalesce(text, '')) + 4 > 2000 then 'size' else 'accepted' end as status from documents""",
    "a13_folded_duplicates": f"with {LINES_SQL} select doc_id, min(pos) as first_pos, count(*) as n_places, bool_and(pos % 4 <> 0) as supported from keyed group by doc_id, line_key",
    "w11_byte_chunks": "select doc_id, md5(text) as joined_md5, true as bounded from documents where text <> ''",
    "k6_catalog_order": """with f as (select l_orderkey as notice_id, l_partkey % 5 as block, min(l_linenumber * 1000000000::bigint + l_suppkey) as place from lineitem group by 1, 2)
        select notice_id, block, printf('B%03d', row_number() over (partition by notice_id order by place, block) - 1) as alias from f""",
    "c9_overlays": f"with {G1} select notice_id, ((ord - 1) // 3)::int as row, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h, bool_or(conf < 55) as failed from g1 group by 1, 2",
    "c3_region_status": f"""with {LINES_SQL} select doc_id, case when length(line) % 9 = 0 then 'failed' when length(line) % 4 = 0 then 'unchanged' else 'translated' end as status, count(*) as n from lines group by 1, 2""",
    "x1_answered_chunks": f"with {LINES_SQL}, u as (select distinct line from lines) select sha256(line) as chunk_id, md5(reverse(line)) as answer_md5 from u",
    "x4_stand_ins": rf"""with {LINES_SQL}, k as (select lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as k, min(item_id) as item_id from benchmark group by 1)
        select doc_id, pos, coalesce('reference ' || item_id, 'placeholder') as answer from lines left join k on k.k = lower(trim(regexp_replace(line, '\s+', ' ', 'g')))""",
}
