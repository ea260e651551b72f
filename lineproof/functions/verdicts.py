"""Verdicts over a source text and its English: damaged contacts, exam scores, closed cells, cues, phrases, roles."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineproof.functions import literals as V
from lineproof.functions.text import bound

STRINGS = "array<string>"
#: Exam names.
EXAMS = ["TOEIC Speaking", "TOEIC", "TOEFL", "IELTS", "TEPS", "OPIc"]
SCORE = rf"({'|'.join(EXAMS)})[^0-9]{{0,45}}?([0-9]+(?:\.[0-9]+)?)"
#: A run that starts like a telephone number but holds letters among its digits.
DAMAGED = r"(?<![0-9A-Za-z-])(0[0-9OoIl]{1,2}-[0-9OoIlSB]{3,4}-[0-9OoIlSB]{4})(?![0-9A-Za-z])"
NUMBER = r"[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?"


def spelt(*parts: str) -> list[str]:
    """All texts of one alternative a part; a bar parts alternatives."""
    return ["".join(p) for p in product(*[part.split("|") for part in parts])]


#: Shapes of whole cells and their English, fixed values: no blanks, # for a number, %1 and %2 for the numbers in order.
SENTENCES = [
    (["최대#원"], "up to KRW %1"), (["#명내외"], "about %1 people"), (spelt("#", "~|-", "#인"), "teams of %1 to %2"), (["제한없음"], "no restriction"),
    (spelt("프로그램내중복참여", "불허|불가|금지"), "Duplicate participation within the same program is not allowed."),
    (spelt("개인또는팀(#", "인|명", "이내)", "참가|참여", "가능"), "Individuals or teams of up to %1 people may participate."),
    (spelt("휴학생도", "참여|참가", "|는", "가능하나연구비및활동비지원대상", "|에서|에서는", "제외"), "Students on leave may participate, but are excluded from research funding and activity allowance support."),
]
FUNDED, ENROLLED = spelt("연구비|활동비", ":#인당", "|최대", "#", "|천|만|억", "원"), spelt("|#학년도", "|#학기", "학부재학생")
SUPPORTED = {who: spelt("지원", "|을", "받는", who, "은|는", "참여", "|가", "제한") for who in ("학생및팀", "학생", "팀")}
AT_SCHOOL, MAY_ON_LEAVE = "대학교학부재학생", spelt("(휴학생", "참가|참여", "가능)")
#: Ordered cues of an item's role in a source line.
ROLES = [("contact", r"문의|연락처|@"), ("deadline", r"마감|까지|기한"), ("funding", r"지원금|장학금|원\b"), ("document", r"서류|제출"), ("eligibility", r"자격|대상")]
FREE, OWED, AWARD = r"무료", r"참가비|수수료|납부", r"지원금|장학금|상금"


def strings(found: Column) -> Column:
    return F.coalesce(found, F.array().cast(STRINGS))


def damaged_phones(text: Column) -> Column:
    """Printed runs of at least seven digits that hold letters where a telephone number has digits."""
    found = strings(F.regexp_extract_all(text, F.lit(DAMAGED), F.lit(1)))
    return F.filter(found, lambda p: p.rlike("[A-Za-z]") & (F.length(F.regexp_replace(p, "[^0-9]", "")) >= 7))


def exam_scores(text: Column) -> Column:
    """Distinct label=score strings of exams with a score within 45 characters."""
    return F.array_distinct(F.transform(V.matches(text, SCORE, 1, 2), lambda m: F.concat_ws("=", m["g1"], m["g2"])))


def closed_cell(text: Column) -> Column:
    """English of a cell that is wholly of one closed form; null for other cells.

    The cell's shape, without blanks, a bullet before it and a stop behind it, is looked up; its numbers fill the English.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "^[*·•-]", ""), r"\.$", "")
    read = lambda b: (strings(F.regexp_extract_all(b, F.lit(f"({NUMBER})"), F.lit(1))), F.translate(F.regexp_replace(b, NUMBER, "#"), "：,，", ":"))
    return bound(lambda t, b: bound(lambda n, shape: _closed_cell(t, n, shape), *read(b)), text, bare)


def _closed_cell(text: Column, n: Column, shape: Column) -> Column:
    first, second = F.coalesce(F.get(n, F.lit(0)), F.lit("")), F.coalesce(F.get(n, F.lit(1)), F.lit(""))
    filled = [F.when(shape.isin(shapes), F.replace(F.replace(F.lit(english), F.lit("%1"), first), F.lit("%2"), second)) for shapes, english in SENTENCES]
    has = lambda part, then, other="": F.when(F.contains(shape, F.lit(part)), then).otherwise(other)
    amount = F.format_number(F.get(V.amounts(F.concat(second, F.regexp_extract(shape, "([천만억]?원)$", 1))), F.lit(0)), 0)
    funding = F.concat(has("연구비", "Research", "Activity"), F.lit(" funding: "), has("최대", "up to "), F.lit("KRW "), amount, F.lit(" per person."))
    term = F.when(F.contains(shape, F.lit("학년도")), second).otherwise(first)
    dated = (~F.contains(shape, F.lit("학년도")) | first.rlike("^20[0-9]{2}$")) & (~F.contains(shape, F.lit("학기")) | term.isin("1", "2"))
    enrolled = F.concat(
        F.lit("Currently enrolled undergraduate students"), has("학기", F.concat(F.lit(" in the "), F.when(term == "1", "first").otherwise("second"), F.lit(" semester"))),
        has("학년도", F.concat(F.lit(" of the "), first, F.lit(" academic year"))), F.lit("."))
    name = F.regexp_extract(shape, f"^([가-힣]{{1,30}}){AT_SCHOOL}", 1)
    behind = F.replace(shape, F.concat(name, F.lit(AT_SCHOOL)), F.lit(""))
    school = F.concat(F.lit("Currently enrolled undergraduate students at "), F.initcap(V.romanized(name)), F.lit(" University (name transliterated)."), F.when(behind != "", " Students on leave may participate.").otherwise(""))
    who = {"학생및팀": "Students and teams", "학생": "Students", "팀": "Teams"}
    supported = F.coalesce(*[F.when(shape.isin(shapes), f"{who[k]} receiving support are restricted from participation.") for k, shapes in SUPPORTED.items()])
    return F.coalesce(
        *filled, V.threshold_cell(text), F.when(shape.isin(FUNDED) & (first == "1"), funding), F.when(shape.isin(ENROLLED) & dated, enrolled),
        F.when((name != "") & behind.isin("", *MAY_ON_LEAVE), school), supported,
    )


def fallback_text(text: Column) -> Column:
    """A labelled stand-in: the closed form, the text itself if it holds no Hangul, else its romanisation."""
    return F.coalesce(closed_cell(text), F.when(~text.rlike("[가-힣]"), text), F.concat(F.lit("[romanised] "), V.romanized(text)))


#: One of these stands before every quoted or bracketed phrase.
PHRASE_MARK = r'["“(\[]'


def quoted_phrases(text: Column) -> Column:
    """Distinct quoted or bracketed phrases of two or more words."""
    found = F.concat(*[strings(F.regexp_extract_all(text, F.lit(p), F.lit(1))) for p in (r'"([^"\n]+)"', r"“([^”\n]+)”", r"\(([^()\n]+)\)", r"\[([^\[\]\n]+)\]")])
    return F.array_distinct(F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p.rlike(r"[A-Za-z]\S*\s+\S")))


def lost_phrases(source: Column, english: Column) -> Column:
    """Quoted phrases whose words do not stand in order, side by side, in the English."""
    words = lambda c: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " "), F.lit(" "))
    return bound(lambda told: F.filter(quoted_phrases(source), lambda p: ~F.contains(told, words(p))), words(english))


def unsupported_values(english: Column, quote: Column) -> Column:
    """amount:value strings printed in the English without support in the quote."""
    whole = lambda values: F.transform(values, lambda x: x.cast("decimal(38,0)"))
    found = F.array_except(F.array_union(whole(V.english_amounts(english)), whole(V.amounts(english))), F.array_union(whole(V.amounts(quote)), whole(V.english_amounts(quote))))
    return F.transform(found, lambda x: F.concat(F.lit("amount:"), x.cast("string")))


def pair_issues(source: Column, english: Column) -> Column:
    """missing:, added: and score: strings of one pair of a source text and its English."""
    told = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(told("missing:", V.missing_values(source, english)), told("added:", unsupported_values(english, source)), told("score:", F.array_except(exam_scores(source), exam_scores(english)))))


def cue_issues(source: Column, english: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Labels of (source cue, English cue, label) rules whose source cue stands without its English cue."""
    return F.array_compact(F.array(*[F.when(source.rlike(s) & ~english.rlike(e), F.lit(label)) for s, e, label in rules]))


def glossary_applied(source: Column, english: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(source term, wrong English, right English) rules in order, each only where the source has its term."""
    for term, wrong, right in rules:
        english = F.regexp_replace(english, F.when(F.contains(source, F.lit(term)), rf"(?i)\b{wrong}\b").otherwise(F.lit("(?!)")), F.lit(right))
    return english


def role(text: Column) -> Column:
    found = F.lit("other")
    for name, cue in reversed(ROLES):
        found = F.when(text.rlike(cue), F.lit(name)).otherwise(found)
    return found


#: Ordered source cues that decide a role, each pattern must be found.
ROLE_CUES = [
    ("deadline", ["기간|마감|일시", "[0-9]{1,4}[./-][0-9]{1,2}"]), ("consequence", ["허위|거짓", "취소|무효"]), ("warning", ["자기소개서", "금지|불가"]), ("location", ["근무장소"]), ("detail", ["근무형식|수습기간"]),
    ("document", ["지원서|신청서|계획서|동의서|증명서|성적표", r"제출|구비|필요|필수|^[\s,·]*(?:신청서|연구계획서|개인정보.*동의서)"]), ("eligibility", [r"학부\s*재학생|휴학생|[0-9]\s*명.*팀|졸업\s*예정자|병역|공인어학성적|학력.*제한\s*없"]),
    ("exception", [r"중복.*(?:불허|불가)|참여\s*제한"]), ("funding", [r"(?m)^\s*(?:연구비|활동비)\s*[:：]"]),
]


def corrected_role(kind: Column, source: Column) -> Column:
    """The role that the source's own cues tell, else the given one; tables keep theirs."""
    contact = source.rlike("문의|연락처") & ((F.size(V.emails(source)) > 0) | (F.size(F.map_keys(V.phones(source))) > 0))
    found = F.when(kind == "table", kind).when(contact, "contact")
    for name, patterns in ROLE_CUES:
        test = source.rlike(patterns[0])
        for p in patterns[1:]:
            test &= source.rlike(p)
        found = found.when(test, name)
    found = found.when(source.rlike("https?://") & (F.size(F.split(F.trim(source), r"\s+")) < 12), "link").when(F.trim(source).rlike(r"^(?:[0-9]+[.)]|[*·•●○▶-])"), "detail")
    return found.when((kind == "heading") & ((F.length(source) > 80) | F.contains(source, F.lit("\n"))), "detail").otherwise(kind)


def fee_issue(text: Column) -> Column:
    """Why a text is no evidence of a fee; null where it is."""
    return F.when(text.rlike(AWARD) & ~text.rlike(OWED), "award").when(~text.rlike(OWED) & ~text.rlike(FREE), "no payment wording")


def fragment(text: Column) -> Column:
    """Why a line looks unfinished; null where it does not."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return F.when(count(r"\(") > count(r"\)"), "open bracket").when(text.rlike(r"(?i)(^|\s)(and|or|of|et|de|mit|und)$"), "dangling connective").when(text.rlike(r"^[,;)]"), "connector start")


def without_claims(text: Column, claim: str, ends: str = r"(?<=[,;.])") -> Column:
    """The clauses of a text that hold no claim, joined again."""
    return F.array_join(F.filter(F.split(text, ends), lambda c: ~c.rlike(claim)), "")


def scored(expected: Column, given: Column) -> Column:
    """An answer is right if either normalized text holds the other; an empty one is wrong."""
    a, b = (F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) for c in (expected, given))
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def payload_status(payload: Column, most_bytes: int) -> Column:
    """Whether an inline image is of an allowed type, decodes, starts as its type does and is small enough."""
    kind = F.regexp_extract(payload, r"^data:image/(png|jpeg|webp);base64,", 1)
    raw = F.try_to_binary(F.regexp_replace(payload, r"^data:[^,]*,", ""), F.lit("base64"))
    head = F.hex(F.substring(raw, 1, 4))
    magic = F.when(kind == "png", head == "89504E47").when(kind == "jpeg", head.startswith("FFD8FF")).otherwise(head == "52494646")
    return F.when(kind == "", "type").when(raw.isNull(), "encoding").when(~magic, "magic").when(F.octet_length(raw) > most_bytes, "size").otherwise("accepted")


def glyph_height(polygon: Column) -> Column:
    """Mean length of the two sides of a four-point polygon that run least sideways."""
    turned = F.concat(F.slice(polygon, 2, 3), F.slice(polygon, 1, 1))
    sides = F.zip_with(polygon, turned, lambda a, b: F.struct(F.abs(a["x"] - b["x"]).alias("dx"), F.hypot(a["x"] - b["x"], a["y"] - b["y"]).alias("n")))
    upright = F.slice(F.array_sort(sides), 1, 2)
    return (upright[0]["n"] + upright[1]["n"]) / 2
