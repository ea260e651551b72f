"""Queries of the text rules over printed forms: every order carries one of a list of cases; the SQL lists the answers.

A case is (inputs..., expected). Expected is what the rule must say, written by hand, several issues joined by " | ".
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lineproof.functions import english as E
from lineproof.functions import literals as V
from lineproof.functions import text as X
from lineproof.functions import verdicts as J
from lineproof.operators.once import judged_once
from lineproof.sources import views

QUERIES, SQL = {}, {}
C = F.col


def joined(values):
    return F.array_join(values, " | ")


def flag(test):
    return F.when(test, "yes").otherwise("no")


def register(name: str, fields: str, cases: list[tuple], rule, once: bool = False) -> None:
    """A query of rule over the fields of the cases, and its SQL; once: the rule is dear, so that equal rows are judged together."""
    names = fields.split()

    def query(spark, sf):
        rows = views.cases(spark, sf, cases, *names)
        found = judged_once(rows, names, rule()) if once else rows.withColumn("found", rule())
        return found.select("notice_id", "kase", "found")

    query.__name__ = name
    QUERIES[name], SQL[name] = query, views.cases_sql([c[-1] for c in cases])


register("f2b_exact_forms", "source", [
    ("신청 https://a.org/x?{n}, 문의 a.b@c.org", "https://a.org/x?{n} | a.b@c.org"),
    ("₩ 1,{n} 또는 2026-03-04 (14:30)", "₩ 1,{n} | 2026-03-04 | 14:30"),
    ("양식 F{n}, 02-1234-5678", "F{n} | 02-12 | 34-56"),
    ("마감 12/24. 다시 12/24", "12/24"),
    ("값 없음", ""),
], lambda: joined(X.exact_values(C("source"))))

register("f4b_date_forms", "source", [
    ("2026.08.24 ~ 9.3", "2026-08-24 | 09-03"), ("2026년 8월 4일(화)", "2026-08-04"), ("2026-8-4 그리고 8월 4일", "2026-08-04"), ("접수 기간: 9.3 ~ 9.10", "09-03 | 09-10"),
    ("9.3(월) 설명회", "09-03"), ("9/3 ~ 9/10", "09-03 | 09-10"), ("버전 1.5, 학점 3.7", ""), ("13월 40일", ""), ("9.3 마감", "09-03"), (None, ""),
], lambda: joined(F.coalesce(F.transform(V.calendar_dates(C("source")), V.shown_day), F.array().cast("array<string>"))))

register("f6b_clock_forms", "source", [
    ("14:30", "14:30"), ("오후 2시 30분", "14:30"), ("오전 12시", "00:00"), ("14시", "14:00"), ("9:05 am and 3 PM", "09:05 | 15:00"), ("비율 1:2", ""), ("24시간", ""),
], lambda: joined(F.transform(F.array_sort(V.clock_minutes(C("source"))), E.clock)))

register("f7b_phone_forms", "source", [
    ("문의 02-1{n}-5678", "021{n}5678"), ("+82-2-1{n}-5678", "021{n}5678"), ("(02) 123-4{n}", "021234{n}"), ("01012345678", "01012345678"), ("1234567890", ""), ("전화 1234567890", "1234567890"),
    ("12345678901원", ""), ("+1 415-555-2{n}", "14155552{n}"), ("A02-1234-5678", ""),
], lambda: joined(F.map_keys(V.phones(C("source")))))

register("f15b_closed_forms", "source", [
    ("연구비: 1인당 최대 50만원", "Research funding: up to KRW 500,000 per person."), ("활동비 : 1인당 1,{n}원", "Activity funding: KRW 1,{n} per person."), ("* 프로그램 내 중복 참여 불허.", "Duplicate participation within the same program is not allowed."),
    ("2026학년도 1학기 학부 재학생", "Currently enrolled undergraduate students in the first semester of the 2026 academic year."), ("학부 재학생", "Currently enrolled undergraduate students."),
    ("서강대학교 학부 재학생(휴학생 참가 가능)", "Currently enrolled undergraduate students at Seogang University (name transliterated). Students on leave may participate."),
    ("개인 또는 팀(5인 이내) 참가 가능", "Individuals or teams of up to 5 people may participate."), ("지원을 받는 학생 및 팀은 참여 제한", "Students and teams receiving support are restricted from participation."),
    ("휴학생도 참여 가능하나, 연구비 및 활동비 지원 대상에서 제외", "Students on leave may participate, but are excluded from research funding and activity allowance support."), ("{n} 이상", "at least {n}"), ("그 외 {n}", None),
], lambda: J.closed_cell(C("source")))

register("f18b_missing_forms", "source english", [
    ("지원금 3만 원", "KRW 30,000", ""), ("지원금 3만 원", "30,000", "amount:30000"), ("지원금 1억 2천원", "KRW 100,000,000", "amount:2000"), ("마감 2026.08.24", "Aug. 24th, 2026", ""), ("마감 2026.08.24", "24 of August", "date:2026-08-24"),
    ("8월 4일", "4/8", "date:08-04"), ("2026년 봄", "spring", "year:2026"), ("{n}점 이상", "at least {n}", ""), ("{n}점 이상", "at least nine", "threshold:{n}"), ("3.5 이상", "3.5 or more", ""), ("3-5명", "teams of 3 to 6", "range:5"),
    ("{n}", "none", "number:{n}"), ("KAIST AI 과정", "KAIST course", "acronym:AI"), ("공모전 Open Source", "open source contests", ""), ("공모전 Open Source", "sources", "title:Open"), ("문의 a@b.org", "contact", "email:a@b.org"),
], lambda: joined(V.missing_values(C("source"), C("english"))))

register("f19b_unsupported_forms", "quote english", [
    ("1만원", "KRW 10,000 or KRW {n}", "amount:{n}"), ("₩{n}", "{n} won", ""), ("2026.08.24 ~ 9.3", "until September 3", ""), ("2026.08.24 ~ 9.3", "until September 4", "date:09-04"), ("8월 24일", "August 24, 2027", ""), ("2026.08.24", "August 24, 2027", "date:2027-08-24"), ("문의", "by May 4", "date:05-04"),
], lambda: joined(E.unsupported_values(C("english"), C("quote"))))

register("f20_cue_issues", "source english", [
    ("교내 학부 재학생", "Enrolled undergraduates on campus", ""), ("교내 학부 재학생", "Students", "enrolled undergraduates | on-campus scope"), ("최대 {n}원, 1인당", "up to {n} per person", ""), ("최대 {n}원, 1인당", "{n} won", "maximum limit | per-person amount"),
    ("중복 지원 불허", "allowed", "not allowed"), ("불허하지 않음", "allowed", ""), ("기자재 구입 및 대여", "buying or renting equipment", ""), ("기자재 구입 및 대여", "equipment", "purchase | rental"), ("방문하여 카드 결제", "Visit and pay by card", ""),
    ("방문하여 카드 결제", "You may visit and use a card", "prescribed in-person card-payment procedure"), ("휴학생은 연구비 및 활동비 지원 대상에서 제외", "Students on leave are excluded from research funds", "activity allowance exclusion"), ("동일하거나 유사한 주제", "the same topic", "similar topic"),
], lambda: joined(F.concat(E.missing_conditions(C("source"), C("english")), E.missing_spending(C("source"), C("english")))))

register("j22_installment_scope", "source english", [
    ("1차 지원금 지급, 2차 지원금은 보고서 제출 후 지급", "The second grant payment follows the report", ""), ("1차 지원금 지급, 2차 지원금은 보고서 제출 후 지급", "Two payments are made", "condition applying to installment 2"),
    ("3회차 장학금은 확인 시 지급", "installment no. 3 after the check", ""), ("보고서 제출 후 지급", "after the report", ""), ("1차 지급 " + "가" * 90 + " 제출 후", "paid", ""),
], lambda: joined(E.installment_scope(C("source"), C("english"))), once=True)

register("f21_pair_verdict", "source english", [
    ("14:30 접수", "Apply at 2:30 pm", ""), ("14:30 접수", "Apply at 3:30 pm", "missing time: 14:30 | unsupported time: 15:30"), ("https://a.org/x. 참고", "See https://a.org/x", ""), ("https://a.org/x 참고", "See the page", "missing URL: https://a.org/x"),
    ("제출 불가", "may not submit", ""), ("제출 불가", "may submit", "missing negation or exclusion"), ("재학생 필수", "Must be enrolled", ""), ("휴학생 추첨", "by lottery", "missing condition: leave-of-absence condition"),
    ("3명 이상", "at least three students", ""), ("{n}점 이하", "{n} points", "missing inclusive maximum for {n}"), ("TOEIC {n}점 이상", "TOEIC {n} or higher", ""), ("TOEIC {n} 이상 또는 TEPS 300 이상", "TOEIC 300 or higher, TEPS {n} or higher", "missing or changed score pairing: toeic / {n} | missing or changed score pairing: teps / 300 | changed threshold direction: toeic / inclusive minimum | changed threshold direction: teps / inclusive minimum"),
    ("문의 02-1234-5678", "Call 02-1234-5679", "missing value: phone:0212345678 | unsupported contact: 02-1234-5679"), ("TEPS {n}", "IELTS and TEPS {n}", "unsupported exam name: ielts"),
], lambda: joined(E.pair_issues(C("source"), C("english"))), once=True)

register("f22_unit_verdict", "source english", [
    ("재학생 (Capstone Design)", "Enrolled students of capstone design", ""), ("교육 (Capstone Design)", "Design capstone", "missing printed phrase: Capstone Design"), ("python 실습", "Programming practice", "missing printed term: python"), ("robot 실습", "Robots", ""),
    ("방문하여 카드 결제", "Visit in person or by card", "changed card-payment procedure"), ("지원을 받는 팀은 참여 제한", "Teams are restricted from receiving support", "changed condition direction"), ("논술 2문제", "An essay test of 2 questions", ""), ("논술 {n}문항", "English test, {n} questions", "missing essay count: {n}"),
    ("장학금 지급", "money is paid", "missing condition: scholarship category | missing condition: scholarship payment"),
], lambda: joined(E.unit_issues(C("source"), C("english"))), once=True)

register("f23_transliteration", "source english role", [
    ("도담 마루", "Dodam hall", "key_details", "yes"), ("도담 마루", "Dodammaru", "key_details", "no"), ("도담대학교", "Dodam University", "key_details", "no"), ("도담 마루", "Dodam hall", "location", "no"), ("도담 AI", "Dodam AI", "key_details", "no"), ("설명회", "Briefing", "key_details", "no"),
    ("마루나무 그늘", "the Namus of shade", "key_details", "yes"),
], lambda: flag(E.broken_transliteration(C("source"), C("english"), C("role"))))

register("p18_unsafe_items", "field text evidence source", [
    ("actions", "Submit the form", "신청서 제출", "신청서 제출", "no"), ("actions", "신청 Submit", "신청서 제출", "신청서 제출", "yes"), ("contacts", "Call 02-1234-5678", "문의", "문의 02-1234-5679", "yes"), ("fees", "KRW 100 prize", "상금 100원", "상금 100원", "yes"), ("fees", "KRW 100 fee", "참가비 100원", "참가비 100원", "no"),
    ("eligibility", "Vacancies: 0", "00명", "00명", "yes"), ("warnings", "Theses may not be used", "논문으로", "논문으로", "yes"), ("actions", "Bring it", "신청서 (사진", "신청서 (사진", "yes"), ("actions", "Bring it", "또는 신청서", "또는 신청서", "yes"), ("actions", "Bring it", "신청서 및", "신청서 및", "yes"),
], lambda: flag(E.unsafe_item(C("field"), C("text"), C("evidence"), C("source"))))

register("p19_detached_fragments", "field label evidence text", [
    ("key_details", "Other", "모집 기간", "Recruitment period", "yes"), ("financial_support", "Award", "우수상", "Excellence", "yes"), ("key_details", "Award", "팀 50만원", "KRW 500,000", "yes"), ("key_details", "Schedule", "5월 4일", "May 4", "yes"), ("deadlines", "Date", "5월 4일", "May 4", "no"),
    ("warnings", "Restriction", "인쇄비 항목", "Printing", "yes"), ("warnings", "Restriction", "인쇄비 사용 불가", "No printing", "no"), ("key_details", "other", "Dodam", "dodam.", "yes"), ("deadlines", "Period", "2026-1학기", "Application period", "yes"), ("key_details", "Place", "온라인 진행", "Online", "yes"),
    ("key_details", "Place", "매주 월요일", "Every Monday", "yes"), ("key_details", "Exam", "약 {n}문항", "{n} questions", "yes"), ("key_details", "other", "푸른 하늘", "Blue sky", "yes"), ("key_details", "other", "서류 제출", "Submission", "no"), ("key_details", "other", "푸른 하늘\n서류 제출", "Blue", "no"),
], lambda: flag(E.detached_fragment(C("field"), C("label"), C("evidence"), C("text"))))

register("p20_open_lists", "text evidence", [
    ("Books, paper, etc.", "도서, 종이", "yes"), ("Books and other related costs", "도서비", "yes"), ("Books and other related costs", "도서비 등", "no"), ("Books, no other costs", "도서비", "no"), ("Books and paper", "도서, 종이", "no"), ("Books among others", "고등 도서", "yes"), ("Books etc.", "기타 자료", "no"), ("Books etc.", "", "no"),
], lambda: flag(E.open_list(C("text"), C("evidence"))))

register("p24_detail_verdict", "first second text category", [
    ("의 신청", None, "Apply", "other", "unfinished start"), ("신청서 (사진", None, "Photo", "other", "unfinished continuation"), ("신청서 (사진", "포함) 제출", "Submit the form with a photo", "other", None), ("신청서 및", None, "Form", "other", "unfinished conjunction"), ("AB", None, "AB", "other", "copied fragment"),
    ("신청서를", None, "The form is required", "other", "unfinished requirement"), ("학교에서", None, "Not allowed at school", "other", "unfinished requirement"), ("교내 행사", None, "The on-campus scope", "other", "audit commentary"), ("행사 안내", None, "Old  claim", "other", "rejected before"),
    ("행사 안내", None, "Unclear event", "other", "uncertain"), ("00명", None, "Vacancies: 0", "other", "placeholder count"), ("상금 {n}원", None, "KRW {n}", "fee", "award"), ("금액 {n}원", None, "KRW {n}", "fee", "no payment owed"), ("참가비 {n}원", None, "Fee of KRW {n}", "fee", None),
    ("지원금 {n}원", None, "A grant", "funding", "values: amount:{n}"), ("도서 구입", None, "Books", "funding", "spending: purchase"), ("교내 행사", None, "An event", "other", "conditions: on-campus scope"), ("행사 안내", None, "Mail a@b.org", "contact", "contacts: a@b.org"),
], lambda: E.detail_issue(F.array_compact(F.array("first", "second")), C("text"), F.lit(True), C("category"), F.array(F.lit("Old claim")), C("text"), F.lit(False)))

register("f34_document_conditions", "name english evidence context", [
    ("Graduation certificate", "Graduation certificate", "졸업예정 증명서", None, "yes"), ("Graduation certificate", "Expected graduation certificate", "졸업예정 증명서", None, "no"), ("Graduation certificate", "Expected graduation certificate", "졸업(예정)증명서", None, "yes"),
    ("Graduation certificate", "Graduation or expected graduation certificate", "졸업(예정)증명서", None, "no"), ("Transcript", "Transcript", "졸업예정증명서, 성적표", None, "no"), ("Card", "Card", "신분증", "면접 후 신분증 제출", "yes"), ("Card", "Card, after the interview", "신분증", "면접 후 신분증 제출", "no"),
    ("Card", "Card at the interview", "신분증 면접 시 지참", None, "no"), ("Card", "Card", "면접 전형 신분증 지참", None, "no"),
], lambda: flag(E.omits_document_condition(C("name"), C("english"), C("evidence"), C("context"))))

register("p4b_hangul_share", "text", [
    ("한글 안내", "1.0 yes"), ("abc 한", "0.25 yes"), ("abcdefghijklmno 한", "0.0625 no"), ("", "0.0 no"), ("English only {n}", "0.0 no"),
], lambda: F.concat_ws(" ", X.share_of(C("text"), "[가-힣]").cast("string"), flag(X.share_of(C("text"), "[가-힣]") >= 0.08)))

register("p5b_useful_lines", "line", [
    ("한글", "yes"), ("한 a", "no"), ("2026-03-04", "yes"), ("a@b.org", "yes"), ("https://a.org", "yes"), ("02-1234-5678", "yes"), ("abc {n}", "no"),
], lambda: flag((X.count_of(C("line"), "[가-힣]") >= 2) | (F.size(X.exact_values(C("line"))) > 0)))

register("p6b_readable_gate", "text", [("한글안내", "readable"), ("한글 안", "unavailable"), ("English {n}", "unavailable"), ("", "unavailable")], lambda: F.when(X.count_of(C("text"), "[가-힣]") < 4, "unavailable").otherwise("readable"))

register("p21b_roles", "kind source", [
    ("detail", "문의: a@b.org", "contact"), ("detail", "문의", "detail"), ("detail", "접수 기간 2026.3.4", "deadline"), ("detail", "허위 사실은 합격 취소", "consequence"), ("detail", "자기소개서 표절 금지", "warning"), ("detail", "근무장소 본관", "location"), ("action", "수습기간 3개월", "detail"),
    ("detail", "신청서 제출", "document"), ("detail", "학부 재학생", "eligibility"), ("detail", "중복 참여 불가", "exception"), ("detail", "연구비: {n}원", "funding"), ("detail", "https://a.org", "link"), ("heading", "1. 개요", "detail"), ("table", "문의: a@b.org", "table"), ("heading", "안내", "heading"),
], lambda: J.corrected_role(C("kind"), C("source")))

register("f30b_printed_values", "text", [
    ("KRW 1,{n} and F{n}", "1,{n} | F{n}"), ("no value", ""), ("a-{n}/b 3", "-{n} | 3"),
], lambda: joined(X.printed_values(C("text"))))

register("f1b_compatibility_keys", "text", [
    ("Ａ Ｂ　ｃ", "abc"), ("① ㈜ ㎏", "1(주)kg"), ("ﬁn", "fin"), ("가 나", "가나"), (None, None),
], lambda: X.folded_key(C("text")))

register("f32b_claims_removed", "text", [
    ("TOEIC 800 or higher, apply by mail.", " apply by mail."), ("Apply by mail; IELTS 6.5 needed.", "Apply by mail;"), ("Apply by mail.", "Apply by mail."), ("TOEIC is accepted, {n} seats.", "TOEIC is accepted, {n} seats."), ("TEPS {n}", ""),
], lambda: J.without_claims(C("text"), E.SCORE_CLAIM, r"(?<=[,;.])(?![0-9])"))

register("f24b_glossary", "text evidence", [
    ("Original AI technology", "AI 원천 기술", "Core AI technologies"), ("Leaving students may apply", "휴학생", "Students on leave may apply"), ("Comparative integrated management system", "비교과 통합관리시스템", "Extracurricular Integrated Management System"),
    ("Personal information consent form", "개인정보 수집 및 이용 동의서", "Personal information collection and use consent form"), ("research fees", "연구비", "research funding"), ("research fees", "연구비 납부", "research fees"), ("Research and activity fees", "연구비 및 활동비", "Research funding and activity allowances"),
    ("Activity fee", "활동비", "Activity allowance"), ("research fees must be paid", "연구비 카드 결제", "research expenses must be paid"), ("Activity fee", "연구비", "Activity fee"),
], lambda: E.grounded_wording(C("text"), C("evidence")))

register("f27b_display_texts", "field text name required condition items", [
    ("key_details", "A fact", None, None, None, None, "A fact"), ("required_documents", None, "Form {n}", "no", "if new", None, "Form {n} (optional) — if new"), ("required_documents", None, "Form", "yes", "", None, "Form"), ("actions", "Apply", None, None, "by mail", "Form,Photo", "Apply — by mail — bring: Form; Photo"), ("actions", "Apply", None, None, None, "", "Apply"),
], lambda: E.display_text(C("field"), C("text"), C("name"), C("required") == "yes", C("condition"), F.filter(F.split(C("items"), ","), lambda x: x != "")))
