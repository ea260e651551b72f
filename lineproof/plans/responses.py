"""Queries that apply external answers to notices. Orders carry small notices in turn; the SQL lists what must come out."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lineproof.functions import english as E
from lineproof.operators import lines as L
from lineproof.operators import responses as R
from lineproof.operators.joins import grown
from lineproof.plans.cases import flag, register
from lineproof.plans.notices import LINES_SQL
from lineproof.sources import views
from lineproof.sources.scratch import stored
from lineproof.sources.views import table

QUERIES, SQL = {}, {}
C = F.col


def grouped(name: str, fields: str, groups: list[list[tuple]], rule, dear: bool = False) -> None:
    """A query of rule over the rows (notice_id, kase, i, fields) of the groups, and its SQL; rule gives (notice_id, kase, i, found). dear: as in case_rows."""
    names = fields.split()

    def query(spark, sf):
        return rule(views.case_rows(spark, sf, [[r[:-1] for r in g] for g in groups], *names, dear=dear)).select("notice_id", "kase", "i", "found")

    query.__name__ = name
    QUERIES[name], SQL[name] = query, views.case_rows_sql([[r[-1] for r in g] for g in groups])


register("a14_combined_evidence", "first second", [
    ("가 나\n다", "다\n라", "가 나\n다\n라"), ("가나 다", "가 나다 라", "가 나다 라"), ("A b", "a B", "A b"), ("", "가 {n}", "가 {n}"), (" 가 \n\n", "나", "가\n나"),
], lambda: R.combined_evidence(C("first"), C("second")))

register("f33_evidenced_fields", "time phone email evidence", [
    ("14:30", "02-1234-5678", "a@b.org", "14시 30분 02-1234-5678 a@b.org", "14:30|02-1234-5678|a@b.org|verified"), ("3 pm", "", "", "14시 30분", "|||needs_review"), ("soon", "", "", "14:30", "|||needs_review"),
    ("", "02-1234-5{n}", "", "02-1234-5{n}", "|02-1234-5{n}||verified"), ("", "02-1234-5{n}", "", "문의", "|||needs_review"), ("", "N/A", "none", "문의", "|||verified"), ("", "", "x@y.org", "a@b.org", "|||needs_review"), ("", "", "A@B.org", "a@b.org", "||A@B.org|verified"),
], lambda: F.concat_ws("|", *[R.evidenced(C("time"), C("phone"), C("email"), C("evidence"))[c] for c in ("time", "phone", "email", "state")]))

register("j1b_evidence_forms", "evidence page", [
    ("가 나", "x 가나 y", "yes"), ("가\n나", "나\n중간\n가", "yes"), ("가\n가", "가\n나", "no"), ("가\n나", "가 나", "no"), ("  ", "가", "no"), ("가", "", "no"), ("가\n\n", "앞 가 뒤", "yes"),
], lambda: flag(R.evidence_matches(C("evidence"), C("page"))))


def moved(rows):
    return R.moved_fees(rows).withColumn("found", F.concat_ws("|", "field", "label", "text"))


grouped("f33b_moved_fees", "field label text evidence", [
    [("fees", "", "Research fee: KRW {n}", "연구비 {n}원", "financial_support||Research funding: KRW {n}"), ("fees", "", "Activity fee KRW {n}", "활동비 납부 {n}원", "fees||Activity fee KRW {n}")],
    [("key_details", " Other ", "x", "y", "key_details|Other key details|x"), ("fees", "Fee", "KRW {n}", "참가비 {n}원", "fees|Fee|KRW {n}")],
], moved)


def documents(rows):
    docs = rows.withColumn("required", F.col("must") == "yes")
    actions = rows.select("notice_id", F.col("clause").alias("evidence"), F.split("items", ",").alias("items"))
    told = R.required_documents(docs.select("notice_id", "name", "evidence", "required"), actions)
    return rows.select("notice_id", "kase", "i", "name").join(grown(told), ["notice_id", "name"]).withColumn("found", flag(F.col("required")))


grouped("f33c_required_documents", "name evidence must clause items", [
    [("Form {n}", "신청서 제출", "no", "신청서  제출", "form {n},Photo", "yes"), ("Card", "신청서 제출", "no", "신청서 제출", "Photo", "no")],
    [("Form", "신청서 제출(해당자)", "no", "신청서 제출(해당자)", "Form", "no"), ("Card", "신분증", "yes", "x", "y", "yes")],
], documents)


def grounded(rows):
    """Items (role item) and facts (role fact) of a notice whose page is the row of role page."""
    pages = rows.filter("role = 'page'").select("notice_id", "text")
    facts = rows.filter("role = 'fact'").select("notice_id", F.col("i").cast("long").alias("fact_id"), "text")
    ids = F.transform(F.filter(F.split("ids", ","), lambda x: x != ""), lambda x: x.try_cast("long"))
    items = rows.filter("role = 'item'").select("notice_id", F.col("i").alias("item_id"), F.col("text").alias("evidence"), ids.alias("fact_ids"), F.lit("verified").alias("state"))
    told = R.grounded_items(items, facts, pages).withColumnRenamed("item_id", "i")
    shown = F.concat_ws(" ", F.array_join(F.transform("fact_ids", lambda x: x.cast("string")), ","), "state")
    return rows.join(grown(told), ["notice_id", "i"], "left").withColumn("found", F.when(F.col("fact_ids").isNull(), "gone").otherwise(shown))


grouped("j15_grounded_items", "role text ids", [
    [("page", "신청 마감 {n}\n문의 a@b.org\n서류 제출", "", "gone"), ("fact", "신청 마감 {n}", "", "gone"), ("fact", "다른 글", "", "gone"), ("item", "마감 {n}", "1", "1 verified"), ("item", "마감 {n}", "1,2", "1 needs_review"), ("item", "신청 마감 {n}", "", "1 verified"), ("item", "문의 a@b.org", "2", "3 needs_review"), ("item", "없는 글", "1", "gone"), ("item", "서류 제출", "", "4 needs_review")],
    [("page", "하나\n둘", "", "gone"), ("item", "둘\n하나", "", "1 needs_review"), ("item", "하나\n하나", "", "gone")],
], grounded)


def losses(rows):
    lost = R.collective_losses(rows.select("notice_id", "evidence", "text"), "notice_id").withColumn("found", F.array_join("lost", ", "))
    return rows.join(grown(lost), ["notice_id", "evidence"], "left").withColumn("found", F.coalesce("found", F.lit("")))


grouped("a17_collective_phrases", "evidence text", [
    [('교육 "Open Lab Day" (Free Entry)', "Open lab day", ""), ('교육 "Open Lab Day" (Free Entry)', "with free entry", ""), ('"Form No {n}"', "the form", "Form No {n}")],
    [("글", "text", ""), ('"Two Words"', "words two", "Two Words")],
], losses)


def x5_repaired_fields(spark, sf):
    """Lines of a document as display fields; every ninth document has one answer too few or too many."""
    fields = L.source_lines(table(spark, sf, "documents")).select("doc_id", "pos", F.col("pos").alias("field_id"), F.col("line").alias("text"))
    answers = fields.filter(~((F.col("doc_id") % 9 == 1) & (F.col("pos") == 2))).select("doc_id", "field_id", F.concat(F.lit("told "), "field_id").alias("english"))
    answers = answers.unionByName(answers.filter("doc_id % 9 = 2 and field_id = 3"))
    return R.repaired_fields(fields, answers, "doc_id", ["pos"]).groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.count_if("repaired").alias("n_repaired"))


def s16_request_rows(spark, sf):
    """Lines of documents as requests; short lines are context only."""
    lines = L.source_lines(table(spark, sf, "documents"))
    return R.request_rows(lines, "doc_id", ["pos"], "line", F.length("line") < 12).select("doc_id", F.md5("request").alias("request_md5"))


def x2_interpreted(spark, sf):
    """Requests through a callable that makes one item of the first unit and names what is no unit elsewhere."""
    lines = L.source_lines(table(spark, sf, "documents"))
    requests = R.request_rows(lines, "doc_id", ["pos"], "line", F.length("line") < 12)

    def first(request: dict) -> dict:
        units = request["units"]
        return {"items": [{"kind": "detail", "text": units[0]["text"][::-1], "source_unit_ids": [units[0]["alias"]]}]} if units else {"answer": "none"}

    return R.interpreted(requests, "doc_id", first).select("doc_id", "kind", F.md5("text").alias("text_md5"), F.array_join("source_unit_ids", ",").alias("units"))


def x3_recognised(spark, sf):
    """Images stand for what they hold: a JSON list of readings, which the callable returns."""
    reading = F.struct(F.concat(F.lit("t"), "l_partkey").alias("text"), (F.col("conf") / 100).alias("score"), F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("box"))
    images = views.g1(spark, sf).groupBy("notice_id").agg(F.encode(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", reading.alias("r")))), lambda u: u["r"])), "UTF-8").alias("content"))
    found = R.recognised(images, "notice_id", lambda image: json.loads(image))
    return found.select("notice_id", "ord", "text", "score", F.col("box")[3].alias("bottom"))


def s15_updated_snapshots(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("notice_id"), F.col("o_orderdate").cast("string").alias("created_at"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("summary"))
    u = o.filter("notice_id % 3 = 0").select("notice_id", F.when(F.col("notice_id") % 2 == 0, "new title").alias("title"), F.concat(F.lit("summary "), "notice_id").alias("summary"))
    return R.updated_snapshots(o, u, "notice_id", ["created_at"], ["title", "summary"])


def translated(rows):
    """Blocks with the answer to their text; an answer of - is missing, one that starts with ! comes twice, with ? as an error."""
    blocks = rows.select("notice_id", "kase", F.col("i").alias("block"), "text", (F.col("certain") == "yes").alias("certain"))
    told = rows.filter("answer <> '-'").select(F.sha2("text", 256).alias("chunk_id"), F.regexp_replace("answer", "^[!?]", "").alias("text"), F.startswith("answer", F.lit("?")).alias("error"), F.startswith("answer", F.lit("!")).alias("again"))
    once = told.distinct()
    answers = once.unionByName(once.filter("again")).drop("again")
    found = R.translated_blocks(blocks, answers, scratch=stored).withColumnRenamed("block", "i")
    return found.withColumn("found", F.concat_ws(": ", "status", "english"))


grouped("c2_translated_blocks", "text answer certain", [
    [("행사 {n}", "Event {n}", "yes", "translated: Event {n}"), ("English {n}", "-", "yes", "translated: English {n}"), ("학부 재학생", "-", "yes", "translated: Currently enrolled undergraduate students."), ("", "-", "yes", "source_crop: Image detail: see the original crop.")],
    [("지원금 {n}원", "A grant", "yes", "source_crop: [romanised] jiwongeum {n}won"), ("마루 가", "-", "yes", "source_crop: [romanised] maru ga"), ("마루 나", "!Floor", "yes", "source_crop: [romanised] maru na"), ("마루 다", "?Floor", "yes", "source_crop: [romanised] maru da"), ("마루 라", "마루", "yes", "source_crop: [romanised] maru ra")],
    [("마루 마", "Floor", "no", "source_crop: Partial English reading: Floor\n[romanised] maru ma"), ("마감 2026.08.24", "Closes August 24, 2026", "yes", "translated: Closes August 24, 2026")],
], translated, dear=True)


def repairs(rows):
    units = rows.filter("role = 'unit'").select("notice_id", F.col("i").alias("unit"), "text", F.col("english").alias("cited"))
    numbers = F.transform(F.split("units", ","), lambda x: x.try_cast("int"))
    details = rows.filter("role = 'detail'").select("notice_id", F.col("i").alias("detail"), numbers.alias("units"), F.col("english").alias("text"), F.lit(True).alias("certain"), F.lit("other").alias("category"))
    listed = lambda role: rows.filter(F.col("role") == role).select("notice_id", F.explode(numbers).alias("unit"))
    told = R.applied_repairs(units, details, listed("represented"), listed("blocked")).withColumnRenamed("unit", "i")
    return rows.join(grown(told), ["notice_id", "i"], "left").withColumn("found", F.coalesce("state", F.lit("")))


grouped("c4_applied_repairs", "role text english units", [
    [("unit", "지원금 {n}원", "", "", "detailed"), ("unit", "행사 안내", "Event", "", "represented"), ("unit", "행사, 강연", "Event", "", "unverified"), ("unit", "교내 행사", "Event", "", "unverified"), ("unit", "다른 글", "", "", "unverified"), ("detail", "", "KRW {n} grant", "0", ""), ("represented", "", "", "1,2,3", "")],
    [("unit", "하나", "", "", "unverified"), ("unit", "둘", "", "", "unverified"), ("unit", "셋", "", "", "detailed"), ("unit", "신청서 및", "", "", "detailed"), ("unit", "사진 제출", "", "", "detailed"), ("detail", "", "First", "0", ""), ("blocked", "", "", "0", ""), ("detail", "", "Second", "1", ""), ("represented", "", "", "1", ""), ("detail", "", "Third", "2", ""), ("detail", "", "Submit form and photo", "3,4", "")],
], repairs)


def interpretation(rows):
    units = rows.filter("role = 'unit'").select("notice_id", F.col("i").alias("unit"), F.col("page").cast("int").alias("page"), "text")
    items = rows.filter("role = 'item'").select("notice_id", F.col("i").alias("item"), "text", F.transform(F.split("units", ","), lambda x: x.try_cast("int")).alias("unit_ids"))
    kept, rest = R.applied_interpretation(units, items, stored)
    a, b = kept.select("notice_id", F.col("item").alias("i"), F.lit("stands").alias("told")), rest.select("notice_id", F.col("unit").alias("i"), F.col("issue").alias("told"))
    return rows.join(grown(a.unionByName(b)), ["notice_id", "i"], "left").withColumn("found", F.coalesce("told", F.when(F.col("role") == "unit", "told").otherwise("gone")))


grouped("c5_applied_interpretation", "role page text units", [
    [("unit", "1", "지원금 {n}원", "", "told"), ("unit", "1", "행사 안내", "", "no item"), ("unit", "2", "서류", "", "told"), ("item", "", "KRW {n} grant", "0", "stands"), ("item", "", "Both pages", "1,2", "gone"), ("item", "", "Documents", "2", "stands")],
    [("unit", "1", "지원금 {n}원", "", "missing value: amount:{n}"), ("unit", "1", "서류", "", "missing value: amount:{n}"), ("unit", "1", "강연", "", "told"), ("item", "", "A grant and documents", "0,1", "gone"), ("item", "", "Documents", "1", "gone"), ("item", "", "Lecture", "2", "stands"), ("item", "", "강연", "2", "gone"), ("item", "", "KRW 7", "2", "gone"), ("item", "", "Lecture", "2,2", "gone"), ("item", "", "Lecture", "99", "gone")],
], interpretation, dear=True)


def review(rows):
    """Fields and the verdicts on them; a verdict of twice is given two times."""
    fields = rows.select("notice_id", "kase", F.col("i").alias("field_no"), "field", "label", "evidence", "text")
    given = F.when(F.col("status") == "twice", F.array(F.lit("supported"), F.lit("supported"))).otherwise(F.array("status"))
    verdicts = rows.filter("status <> ''").select("notice_id", F.col("i").alias("field_no"), F.explode(given).alias("status"))
    return R.reviewed(fields, verdicts, stored).withColumnRenamed("field_no", "i").withColumn("found", F.col("state"))


grouped("c6_reviewed_fields", "field label evidence text status", [
    [("key_details", "Exam", "약 {n}문항", "{n} questions", "supported", "detached"), ("fees", "Fee", "참가비 {n}원", "KRW {n}, etc.", "supported", "open list"), ("fees", "Fee", "참가비 {n}원", "KRW 7", "supported", "unsupported amount"), ("deadlines", "Date", "2026.08.24 마감", "September 4", "supported", "unsupported date"), ("key_details", "Place", "도담 마루", "Dodam hall", "supported", "transliteration")],
    [("actions", "", '신청 "Open Lab Day"', "Apply to open lab day", "supported", "kept"), ("actions", "", '신청 "Open Lab Day"', "Apply soon", "supported", "kept"), ("actions", "", '신청 "Two Words"', "Apply soon", "supported", "lost phrase"), ("actions", "", "신청 가능", "Apply", "unsupported", "unsupported"), ("actions", "", "신청 가능", "Apply now", "", "insufficient"), ("actions", "", "신청 가능", "Apply late", "twice", "insufficient"), ("actions", "", "신청 가능", "Apply here", "maybe", "insufficient")],
], review, dear=True)


def f25_restored_expansions(spark, sf):
    """Quotes that print an expansion, and English that lacks it, changes it, explains the acronym otherwise, or stands well."""
    cases = [
        ("SSD (Solid State Drive) {n}", "The SSD {n}", "The SSD (Solid State Drive) {n}"), ("SSD (Solid State Drive)", "The SSD (solid state disk)", "The SSD (Solid State Drive)"), ("SSD (Solid State Drive)", "SSD (optional)", "SSD (optional)"),
        ("SSD (Solid State Drive), SSD (Some Such Day)", "The SSD", "The SSD"), ("SSD (Solid State Drive)", "A solid SSD", "A solid SSD"), ("SSD (고체)", "The SSD", "The SSD"), ("SSD", "The SSD", "The SSD"),
    ]
    rows = views.cases(spark, sf, cases, "evidence", "text", "want")
    return E.restored_expansions(rows.drop("want"), "text", "evidence", "found").select("notice_id", "kase", "found")


for f in (x5_repaired_fields, s16_request_rows, x2_interpreted, x3_recognised, s15_updated_snapshots, f25_restored_expansions):
    QUERIES[f.__name__] = f
UNITS_SQL = f"""{LINES_SQL}, u as (select doc_id, pos, line, length(line) < 12 as near from lines),
    a as (select *, case when not near then printf('U%03d', row_number() over (partition by doc_id, near order by pos) - 1) end as alias from u)"""
SQL |= {
    "x5_repaired_fields": f"""with {LINES_SQL}, b as (select doc_id, pos, ((row_number() over (partition by doc_id order by pos) - 1) // 40)::int as batch from lines),
        g as (select doc_id, batch, count(*) as n, bool_or((doc_id % 9 = 1 and pos = 2) or (doc_id % 9 = 2 and pos = 3)) as bad from b group by 1, 2)
        select doc_id, batch, n, case when bad then 0 else n end as n_repaired from g""",
    "s16_request_rows": f"""with {UNITS_SQL}, j as (select doc_id, coalesce(string_agg('{{"alias":"' || alias || '","text":' || to_json(line) || '}}', ',' order by pos) filter (where not near), '') as x,
        coalesce(string_agg(to_json(line)::varchar, ',' order by pos) filter (where near), '') as y from a group by 1) select doc_id, md5('{{"units":[' || x || '],"read_only_context":[' || y || ']}}') as request_md5 from j""",
    "x2_interpreted": f"with {UNITS_SQL} select doc_id, 'detail' as kind, md5(reverse(line)) as text_md5, alias as units from a where alias = 'U000'",
    "x3_recognised": f"with g1 as ({views.SQL['g1']}) select notice_id, (row_number() over (partition by notice_id order by ord) - 1)::int as ord, 't' || l_partkey as text, conf / 100 as score, y + h as bottom from g1",
    "s15_updated_snapshots": """with u as (select o_orderkey as notice_id, o_orderdate::varchar as created_at, case when o_orderkey % 6 = 0 then 'new title' else o_orderpriority end as title,
        case when o_orderkey % 3 = 0 then 'summary ' || o_orderkey else o_orderstatus end as summary, o_orderkey % 3 = 0 as touched from orders) select *, md5(title || chr(10) || summary) as digest from u""",
    "f25_restored_expansions": views.cases_sql(["The SSD (Solid State Drive) {n}", "The SSD (Solid State Drive)", "SSD (optional)", "The SSD", "A solid SSD", "The SSD", "The SSD"]),
}
