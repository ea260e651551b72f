"""What a source may demand of its English, as concepts with the words that tell them, and how words are found.

A demand names a concept and the source phrases that raise it; a concept lists English phrases, one of which must stand.
English is compared as words: lower case, without articles, once as written and once without endings; so a phrase
stands for all its inflections, and one that starts with = only for itself. a ~ b are two words at most ten apart, in
either order. In source phrases blanks are optional, … is anything on one line, ^ the start of a line.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineproof.functions.text import bound

ENDING = "(?<=[a-z]{3})(?:ations?|ments?|ings?|ions?|ed|es|ly|s|e)(?![a-z0-9'])"
ARTICLES = "(?<= )(?:the|a|an|this|that|our|their) "
NEAR = 10

CONCEPTS = {
    "one program": ["in program", "within program", "same program", "single program", "for program", "per program"],
    "extracurricular": ["extracurricular", "extra curricular"],
    "research supervision": ["research supervision", "research guidance", "supervised research", "guided research"],
    "research": ["research"],
    "activity": ["activity", "activities"],
    "enrolled": ["enrolled", "enrol", "currently attending", "currently registered", "registered undergraduate"],
    "campus": ["campus", "internal", "university wide", "within university", "within institution", "within school", "at university", "at institution", "at school", "from university", "from school", "by university", "of university", "of institution", "of school", "same university", "same institution", "same school"],
    "sameness": ["same", "identical"],
    "likeness": ["similar", "comparable"],
    "being supported": ["=supported", "=funded", "in receipt", "receiving ~ support", "receiving ~ funding", "receiving ~ grant", "getting ~ support", "got ~ support", "obtaining ~ support", "getting ~ funding", "obtaining ~ funding", "obtaining ~ grant"],
    "maximum": ["up to", "max", "maximum", "at most", "no more than", "capped at", "limited to", "limit to"],
    "each person": ["per person", "per student", "per participant", "per individual", "per capita", "each person", "each student", "each participant", "each individual"],
    "scholarship": ["scholarship"],
    "denial": ["no", "not allowed", "not permitted", "prohibited", "prohibition", "forbid", "forbidden", "disallowed", "cannot", "may not"],
    "exclusion": ["excluded", "exclusion", "ineligible", "not eligible", "not be", "not receive", "cannot receive", "without"],
    "equipment": ["equipment", "instrument", "apparatus", "device"],
    "purchase": ["purchase", "buy", "bought", "acquire", "acquisition"],
    "rental": ["rent", "rental", "hire", "borrow", "lease"],
    "materials": ["material", "supplies"],
    "books": ["book"],
    "printing": ["print"],
    "card": ["card"],
    "in person": ["visit", "in person", "go to"],
    "enrolment": ["enrolled", "enrol", "currently attending", "currently registered"],
    "leave": ["=leave"],
    "expected graduation": ["expected ~ graduation", "expected ~ graduate", "expecting ~ graduate", "scheduled ~ graduate", "scheduled ~ graduation", "prospective ~ graduate", "prospective ~ graduation", "soon ~ graduate"],
    "own topic": ["student ~ selected", "student ~ chosen", "student ~ choose", "student ~ choice", "student ~ own", "student ~ independent", "student ~ independently", "student ~ autonomous", "student ~ autonomously"],
    "restriction": ["restricted", "restriction", "limited", "ineligible", "not permitted", "prohibited", "prohibition", "forbid", "forbidden", "excluded", "exclusion"],
    "duty": ["required", "requirement", "must", "mandatory", "essential"],
    "lottery": ["lottery", "draw", "drawn", "random", "raffle"],
}
#: (what the audit calls it, concept, source phrases that raise it, source phrase that takes it back); the names are fixed values.
CONDITIONS = [
    ("duplicate participation within the same program", "one program", ["프로그램 내 중복 참여", "프로그램 내 중복 신청"], None),
    ("extracurricular system scope", "extracurricular", ["비교과 통합 관리"], None),
    ("receiving research supervision", "research supervision", ["연구지도 를 받는"], None),
    ("research funding exclusion", "research", ["휴학생…연구비 및 활동비…제외"], None),
    ("activity allowance exclusion", "activity", ["휴학생…연구비 및 활동비…제외"], None),
    ("enrolled undergraduates", "enrolled", ["학부 재학생"], None),
    ("on-campus scope", "campus", ["교내"], None),
    ("same topic", "sameness", ["동일"], None),
    ("similar topic", "likeness", ["유사"], None),
    ("receiving support qualification", "being supported", ["연구 주제…지원 을 받는"], None),
    ("maximum limit", "maximum", ["최대"], None),
    ("per-person amount", "each person", ["1 인당"], None),
    ("scholarship payment", "scholarship", ["장학금"], None),
    ("not allowed", "denial", ["불허"], "불허 하지"),
    ("exclusion from support", "exclusion", ["지원 대상 제외", "지원 대상에서 제외", "지원 대상에서는 제외"], None),
]
SPENDING = [
    ("equipment", "equipment", ["기자재"], None), ("purchase", "purchase", ["구입"], None), ("rental", "rental", ["대여"], None), ("materials", "materials", ["재료비"], None),
    ("books", "books", ["도서"], None), ("printing", "printing", ["인쇄"], None), ("card payment", "card", ["카드 결제"], None), ("in-person visit", "in person", ["방문"], None),
]
CONSTRAINTS = [
    ("enrolled-student condition", "enrolment", ["재학생", "재학 중"], None), ("leave-of-absence condition", "leave", ["휴학생", "휴학 중"], None), ("expected-graduation condition", "expected graduation", ["졸업 예정"], None),
    ("student-selected topic option", "own topic", ["학생 자율 선정 주제"], None), ("research funding category", "research", ["^연구비:"], None), ("activity funding category", "activity", ["^활동비:"], None),
    ("restriction", "restriction", ["제한"], None), ("maximum limit", "maximum", ["최대"], None), ("per-person scope", "each person", ["인당"], None), ("scholarship category", "scholarship", ["장학금"], None),
    ("card-payment procedure", "card", ["카드 결제"], None), ("mandatory condition", "duty", ["필수"], None), ("lottery condition", "lottery", ["추첨"], None),
]


def worded(english: Column) -> Column:
    """The words of a text between blanks, without articles: as written, a bar, and without endings."""
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(english), F.lit("([a-z0-9]+(?:'[a-z]+)?)"), F.lit(1)), " "), F.lit(" "))
    return bound(lambda bare: F.concat(bare, F.lit("|"), F.regexp_replace(bare, ENDING, "")), F.regexp_replace(words, ARTICLES, ""))


def needle(phrase: str) -> str:
    """The pattern of an English phrase in worded text."""
    if phrase.startswith("="):
        return phrase[1:]
    parts = [re.sub(ENDING, "", p) for p in phrase.split(" ~ ")]
    between = rf" (?:[a-z0-9']+ ){{0,{NEAR}}}"
    return parts[0] if len(parts) == 1 else f"(?:{parts[0]}{between}{parts[1]}|{parts[1]}{between}{parts[0]})"


def concept(name: str) -> str:
    return "(?<= )(?:" + "|".join(map(needle, CONCEPTS[name])) + ")(?= )"


def raised(phrase: str) -> str:
    """The pattern of a source phrase."""
    text = phrase.removeprefix("^").replace("…", r"[^\n]*").replace(" ", r"\s*").replace(":", r"\s*[:：]")
    return (r"(?m)^\s*" if phrase.startswith("^") else "") + text


def lead(phrase: str) -> str:
    """The first piece of a source phrase; a text without it holds no such phrase."""
    return re.split("[ …:]", phrase.removeprefix("^"))[0]


def unmet(source: Column, english: Column, demands: list[tuple[str, str, list[str], str | None]]) -> Column:
    """Names of the demands that the source raises and the English tells none of the words of, in their order."""

    def one(words: Column, name: str, idea: str, phrases: list[str], back: str | None) -> Column:
        shown = F.regexp_replace(source, raised(back), " ") if back else source
        return F.when(reduce(or_, (F.contains(source, F.lit(x)) for x in dict.fromkeys(map(lead, phrases)))) & shown.rlike("|".join(map(raised, phrases))) & ~words.rlike(concept(idea)), F.lit(name))

    leads = "|".join(dict.fromkeys(lead(p) for _, _, phrases, _ in demands for p in phrases))
    found = F.array_compact(bound(lambda words: F.array(*[one(words, *d) for d in demands]), worded(english)))
    return F.when(source.rlike(leads), found).otherwise(F.array().cast("array<string>"))
