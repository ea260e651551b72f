"""Literal values printed in notices: amounts, dates, clock times, telephone numbers, emails, thresholds, romanisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineproof.functions.text import bound

#: Korean money multipliers and threshold words.
MULTIPLIERS = {"천": 1_000, "만": 10_000, "억": 100_000_000}
THRESHOLDS = {"이상": "at least", "이하": "at most", "초과": "more than", "미만": "less than"}
AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(천|만|억)?\s*원"
DATE = r"((?:19|20)[0-9]{2})\s*[.년/-]\s*([0-9]{1,2})\s*[.월/-]\s*([0-9]{1,2})"
MONTH_DAY = r"(?<![0-9.년])([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일"
CLOCK = r"(?<![0-9:])([01]?[0-9]|2[0-4]):([0-5][0-9])(?![0-9:])"
KOREAN_CLOCK = r"(오전|오후)?\s*(?<![0-9])([01]?[0-9]|2[0-3])\s*시(?:\s*([0-5]?[0-9])\s*분)?"
ENGLISH_CLOCK = r"(?i)(?<![0-9:])(1[0-2]|0?[1-9])(?::([0-5][0-9]))?\s*([ap])\.?m\b"
PHONE = r"(?<![0-9A-Za-z_-])((?:\+[0-9]{1,3}[. -]?)?\(?[0-9]{1,4}\)?[. -]?[0-9]{3,4}[. -]?[0-9]{4})(?![0-9A-Za-z_])(?!\s*(?:억|만|천)?\s*원)"
#: Runs of digits alone are numbers to call only with a leading zero or a word before them.
CUED_RUN = r"(?i)(?:문의|전화|연락|\b(?:phone|tel|contact)\b)[^0-9]{0,11}([0-9]{9,15})(?![0-9A-Za-z_])"
EMAIL = r"([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
URL = r"(https?://[^\s<>\"')]+)"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Revised Romanization of Korean, by syllable part.
INITIALS = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
VOWELS = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
FINALS = ["", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]


def matches(text: Column, pattern: str, *groups: int, mark: str = "") -> Column:
    """Structs g1, g2, ... of the groups of every match; null text has none. mark: what every match holds, looked for first."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    told = F.transform(F.arrays_zip(*found), lambda m: F.struct(*[m[f"g{g}"].alias(f"g{g}") for g in groups]))
    return F.coalesce(F.when(F.contains(text, F.lit(mark)), told) if mark else told, F.array().cast("array<struct<" + ",".join(f"g{g}:string" for g in groups) + ">>"))


def parts(text: Column, pattern: str, *groups: int, mark: str = "") -> Column:
    """As matches, of a pattern that looks at nothing outside its match: one search of the text, groups are taken from what it finds."""
    told = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(f"g{g}") for g in groups]))
    return F.coalesce(F.when(F.contains(text, F.lit(mark)), told) if mark else told, F.array().cast("array<struct<" + ",".join(f"g{g}:string" for g in groups) + ">>"))


def held(text: Column, pattern: str, mark: str) -> Column:
    """The first group of every match of a pattern that holds the mark; null text has none."""
    return F.coalesce(F.when(F.contains(text, F.lit(mark)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), F.array().cast("array<string>"))


def amounts(text: Column) -> Column:
    """Won amounts as decimals, distinct, in order of first print."""
    unit = lambda u: F.coalesce(*[F.when(u == k, F.lit(v)) for k, v in MULTIPLIERS.items()], F.lit(1))
    value = lambda m: (F.regexp_replace(m["g1"], ",", "").try_cast("decimal(28,2)") * unit(m["g2"])).cast("decimal(38,2)")
    return F.array_distinct(F.transform(parts(text, AMOUNT, 1, 2, mark="원"), value))


#: An abbreviated month and day, and what ties it to the calendar: a weekday, a label before it, a word after it, a range.
SHORT_DAY = r"(?<![0-9./])(0?[1-9]|1[0-2])[ \t]*[./][ \t]*(0?[1-9]|[12][0-9]|3[01])(?![0-9]|[./][0-9])"
WEEKDAY = r"[ \t]*\([ \t]*(?:[월화수목금토일]|(?i:mon|tues|wednes|thurs|fri|satur|sun)day)[ \t]*\)"
NAMED = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + "|Sept)"
NAMED_DAY = rf"\b{NAMED}\.?[ \t]+(?:0?[1-9]|[12][0-9]|3[01])(?:st|nd|rd|th)?(?:[ \t]*,?[ \t]*20[0-9]{{2}})?(?![0-9])"
DAY_NAMED = rf"(?<![0-9])(?:0?[1-9]|[12][0-9]|3[01])(?:st|nd|rd|th)?[ \t]+(?:of[ \t]+)?{NAMED}\b\.?(?:[ \t]*,?[ \t]*20[0-9]{{2}})?"
SURE_DAY = rf"(?:(?:19|20)[0-9]{{2}}[ \t]*[.년/-][ \t]*[0-9]{{1,2}}[ \t]*[.월/-][ \t]*[0-9]{{1,2}}(?:[ \t]*일)?|[0-9]{{1,2}}[ \t]*월[ \t]*[0-9]{{1,2}}[ \t]*일|(?i:{NAMED_DAY})|(?i:{DAY_NAMED}))"
RANGE = r"[ \t]*(?:[~～–—-]|(?i:to|through|until))[ \t]*"
LABEL = r"(?:(?:기간|일시|일자|날짜|마감|일정|기한)|(?i:\b(?:dates?|deadlines?|period|schedule|opens?|closes?|starts?|ends?|due)(?: (?:is|are|on|from|at|by|between))?|\b(?:apply|applications?|register|registration) (?:by|until|from|on)))[ \t]*[:：|]?[ \t]*"
AFTER = r"[ \t]*(?:(?i:is[ \t]+(?:the[ \t]+)?)?(?:(?i:deadline|date)\b|마감|일시|일자|기한))"
CHAIN = rf"(?:{LABEL})?(?:{SURE_DAY}|{SHORT_DAY})(?:{WEEKDAY})?(?:{RANGE}(?:{SURE_DAY}|{SHORT_DAY})(?:{WEEKDAY})?)*(?:{AFTER})?"
TIED = rf"{SURE_DAY}|{WEEKDAY}|{LABEL}|{AFTER}"
#: How every abbreviated day begins, in a chain as in the text: a chain opens inside digits only at a year. The longer patterns need not be tried without it.
DAY_MARK = r"(?<![0-9./])(?:0?[1-9]|1[0-2])[ \t]*[./][ \t]*[0-9]"
#: Likewise of English clock times, English days and telephone numbers.
HALF_MARK, NAME_MARK, CALL_MARK = r"(?i)[0-9]\s*[ap]\.?m", "(?i)" + "|".join(m[:3] for m in MONTHS), "[0-9]{4}"
BARE_RANGE = rf"(?m)^[ \t]*{SHORT_DAY}[ \t]*[~～–—][ \t]*{SHORT_DAY}[ \t]*$"


def _day(month: Column, day: Column, year: Column | None = None) -> Column:
    number = lambda c: c.try_cast("int")
    return F.struct((F.lit(None).cast("int") if year is None else number(year)).alias("year"), number(month).alias("month"), number(day).alias("day"))


def _dated(found: Column) -> Column:
    """Possible days, distinct; those without a year only where no dated twin of the same month and day is found."""

    def told(found: Column, full: Column) -> Column:
        lone = F.filter(found, lambda d: d["year"].isNull() & ~F.exists(full, lambda f: (f["month"] == d["month"]) & (f["day"] == d["day"])))
        return F.array_distinct(F.filter(F.concat(full, lone), lambda d: d["month"].between(1, 12) & d["day"].between(1, 31)))

    return bound(lambda found: bound(lambda full: told(found, full), F.filter(found, lambda d: d["year"].isNotNull())), found)


def _source_days(text: Column) -> Column:
    """Full dates, month-day forms, and abbreviated days in a run of days that holds a cue or another form."""
    full = F.transform(parts(text, DATE, 1, 2, 3), lambda m: _day(m["g2"], m["g3"], m["g1"]))
    partial = F.transform(matches(text, MONTH_DAY, 1, 2, mark="월"), lambda m: _day(m["g1"], m["g2"]))
    chains = F.when(text.rlike(DAY_MARK), F.concat(F.filter(F.regexp_extract_all(text, F.lit(CHAIN), F.lit(0)), lambda c: c.rlike(TIED)), F.regexp_extract_all(text, F.lit(BARE_RANGE), F.lit(0))))
    short = F.transform(F.flatten(F.transform(F.coalesce(chains, F.array().cast("array<string>")), lambda c: matches(c, SHORT_DAY, 1, 2))), lambda m: _day(m["g1"], m["g2"]))
    return F.concat(full, partial, short)


def calendar_dates(text: Column) -> Column:
    """struct(year, month, day) of a source text; year null where it is not printed."""
    return _dated(bound(_source_days, text))


def explicit_dates(text: Column) -> Column:
    """As calendar_dates, with English forms such as May 4th, 2026 and 4 of May."""
    number = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m[:3].lower()), F.lit(str(i)))])
    month = lambda c: F.try_element_at(number, F.lower(F.substring(c, 1, 3)))
    year = lambda c: F.nullif(c, F.lit(""))
    worded = F.when(text.rlike(NAME_MARK), text)
    first = matches(worded, rf"(?i)\b({NAMED})\.?\s+(0?[1-9]|[12][0-9]|3[01])(?:st|nd|rd|th)?(?:\s*,?\s*(20[0-9]{{2}}))?(?![0-9])", 1, 2, 3)
    second = matches(worded, rf"(?i)(?<![0-9])(0?[1-9]|[12][0-9]|3[01])(?:st|nd|rd|th)?\s+(?:of\s+)?({NAMED})\b\.?(?:\s*,?\s*(20[0-9]{{2}}))?", 1, 2, 3)
    named = F.concat(F.transform(first, lambda m: _day(month(m["g1"]), m["g2"], year(m["g3"]))), F.transform(second, lambda m: _day(month(m["g2"]), m["g1"], year(m["g3"]))))
    return _dated(F.concat(_source_days(text), named))


def shown_day(d: Column) -> Column:
    """2026-05-04, or 05-04 without a year."""
    return F.concat_ws("-", d["year"].cast("string"), F.lpad(d["month"].cast("string"), 2, "0"), F.lpad(d["day"].cast("string"), 2, "0"))


def clock_minutes(text: Column) -> Column:
    """Minutes of the day of the 24-hour, Korean and English forms, distinct."""
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    half = lambda hour, late: (number(hour) % 12 + F.when(late, 12).otherwise(0)) * 60
    korean = F.transform(matches(text, KOREAN_CLOCK, 1, 2, 3, mark="시"), lambda m: F.when(m["g1"] == "", number(m["g2"]) * 60).otherwise(half(m["g2"], m["g1"] == "오후")) + number(m["g3"]))
    english = F.transform(matches(F.when(text.rlike(HALF_MARK), text), ENGLISH_CLOCK, 1, 2, 3), lambda m: half(m["g1"], F.lower(m["g3"]) == "p") + number(m["g2"]))
    clocks = bound(lambda bare: matches(bare, CLOCK, 1, 2, mark=":"), F.when(text.rlike(HALF_MARK), F.regexp_replace(text, ENGLISH_CLOCK, " ")).otherwise(text))
    plain = F.filter(F.transform(clocks, lambda m: number(m["g1"]) * 60 + number(m["g2"])), lambda x: x <= 1440)
    return F.array_distinct(F.concat(plain, korean, english))


def phone_digits(printed: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(printed, r"^\+82[ -]?0?", "0"), "[^0-9]", "")


def phones(text: Column) -> Column:
    """Map of canonical digits to the first printed form, of numbers of 9 to 15 digits."""
    empty = F.array().cast("array<string>")
    printed = F.coalesce(F.when(text.rlike(CALL_MARK), F.regexp_extract_all(text, F.lit(PHONE), F.lit(1))), empty)
    cued = F.coalesce(F.when(text.rlike("[0-9]{9}"), F.regexp_extract_all(text, F.lit(CUED_RUN), F.lit(1))), empty)
    fine = F.filter(printed, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(9, 15) & (~p.rlike("^[0-9]+$") | p.rlike("^0[0-9]{8,10}$") | F.array_contains(cued, p)))
    entries = F.transform(fine, lambda p: F.struct(phone_digits(p).alias("k"), p.alias("v")))
    first = lambda entries, keys: F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    return F.map_from_entries(bound(lambda entries: bound(lambda keys: first(entries, keys), F.transform(entries, lambda x: x["k"])), entries))


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(held(text, EMAIL, "@"), F.lower))


def urls(text: Column) -> Column:
    return F.array_distinct(F.transform(held(text, URL, "://"), lambda u: F.rtrim(u, F.lit(".,;"))))


def threshold_cell(text: Column) -> Column:
    """English of a cell that is one number with a threshold word; null for other cells."""
    number = F.regexp_extract(text, r"^\s*([0-9][0-9,.]*)\s*(이상|이하|초과|미만)\s*$", 1)
    word = F.regexp_extract(text, r"^\s*([0-9][0-9,.]*)\s*(이상|이하|초과|미만)\s*$", 2)
    english = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in THRESHOLDS.items()])
    return F.when(number != "", F.concat(english, F.lit(" "), number))


def romanized(text: Column) -> Column:
    """Hangul syllables by syllable arithmetic, other characters as they are."""
    table = lambda parts: F.array(*[F.lit(p) for p in parts])
    code = lambda c: F.ascii(c) - 44032

    def one(c: Column) -> Column:
        n = code(c)
        parts = F.concat(F.get(table(INITIALS), (F.floor(n / 588)).cast("int")), F.get(table(VOWELS), (F.floor(n % 588 / 28)).cast("int")), F.get(table(FINALS), (n % 28).cast("int")))
        return F.when(c.between("가", "힣"), parts).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def has_month_day(text: Column, month: Column, day: Column) -> Column:
    """Whether an English text prints the day: month name with day either way round, or numbers month/day."""
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month)
    short = F.substring(name, 1, 3)
    word = F.concat(short, F.lit("[a-z]*"))
    pattern = F.concat(F.lit(r"(?i)\b("), word, F.lit(r"\.? 0?"), day, F.lit(r"(?:st|nd|rd|th)?\b|\b0?"), day, F.lit(r"(?:st|nd|rd|th)? (?:of )?"), word, F.lit(r"\b|\b0?"), month, F.lit("[/.-]0?"), day, F.lit(r"\b)"))
    return F.regexp_like(text, pattern)


def english_amounts(text: Column) -> Column:
    """KRW and won amounts of an English text."""
    found = F.concat(matches(text, r"(?i)(?:\bKRW\s*|₩\s*)([0-9][0-9,]*(?:\.[0-9]+)?)", 1), matches(text, r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:KRW|won)\b", 1))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m["g1"], ",", "").try_cast("decimal(38,2)")))


def numbers(text: Column) -> Column:
    """Printed numbers as decimals, and the years of full dates, which otherwise hide in a dotted date."""
    plain = F.transform(matches(text, r"(?<![A-Za-z0-9])([0-9][0-9,]*(?:\.[0-9]+)?)(?![A-Za-z0-9])", 1), lambda m: F.regexp_replace(m["g1"], ",", "").try_cast("decimal(38,6)"))
    years = F.transform(matches(text, DATE, 1), lambda m: m["g1"].try_cast("decimal(38,6)"))
    return F.array_distinct(F.concat(plain, years))


def latin_words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+)"), F.lit(1)), F.array().cast("array<string>")), F.lower))


def missing_values(source: Column, english: Column) -> Column:
    """kind:value strings of what the source prints and the English lacks.

    Amounts need their number and a currency, dates their day and printed year; thresholds, count ranges and texts that
    are one number need the number; telephone numbers, emails and acronyms themselves; title terms a word that may be plural.
    """
    return bound(lambda s, e: bound(lambda *told: _missing(s, e, *told), numbers(e), latin_words(e), amounts(e)), source, english)


def _missing(source: Column, english: Column, shown: Column, words: Column, paid: Column) -> Column:
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    told = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(kind + ":"), x.cast("string")))
    value = lambda c: F.regexp_replace(c, ",", "").try_cast("decimal(38,6)")
    absent = lambda printed: F.filter(printed, lambda x: ~F.array_contains(shown, value(x)))
    money = F.regexp_like(english, F.lit(r"(?i)\b(?:KRW|won)\b|₩|원"))
    won = F.filter(F.transform(amounts(source), lambda x: x.cast("decimal(38,0)")), lambda x: ~money | ~(F.array_contains(shown, x.cast("decimal(38,6)")) | F.array_contains(F.transform(paid, lambda a: a.cast("decimal(38,0)")), x)))
    days = F.filter(calendar_dates(source), lambda d: ~has_month_day(english, d["month"], d["day"]) | (d["year"].isNotNull() & ~F.array_contains(shown, d["year"].cast("decimal(38,6)"))))
    years = absent(strings(F.regexp_extract_all(source, F.lit(r"(?<![0-9])(20[0-9]{2})\s*년"), F.lit(1))))
    limits = absent(strings(F.regexp_extract_all(source, F.lit(r"(?<![A-Za-z0-9.])([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:점\s*)?(?:이상|이하|초과|미만)"), F.lit(1))))
    ranges = absent(F.flatten(F.transform(matches(source, r"(?<![0-9])([0-9]+)\s*[-~–]\s*([0-9]+)\s*명", 1, 2, mark="명"), lambda m: F.array(m["g1"], m["g2"]))))
    alone = absent(F.array_compact(F.array(F.when(source.rlike(r"^\s*[0-9]+\s*$"), F.trim(source)))))
    acronyms = F.filter(strings(F.regexp_extract_all(source, F.lit(r"(?<![A-Za-z0-9])([A-Z]{2,}[A-Z0-9]*|[0-9]+[A-Z]{1,3})(?![A-Za-z0-9])"), F.lit(1))), lambda t: ~F.array_contains(words, F.lower(t)))
    titles = F.flatten(F.transform(strings(F.regexp_extract_all(source, F.lit(r"(?<![A-Za-z])((?:[A-Z][a-z]{2,}\s+)+[A-Z][a-z]{2,})(?![A-Za-z])"), F.lit(1))), lambda t: F.split(t, r"\s+")))
    plural = lambda t: F.arrays_overlap(words, F.array(F.lower(t), F.concat(F.lower(t), F.lit("s")), F.concat(F.lower(t), F.lit("es"))))
    terms = F.when(source.rlike("[가-힣]"), F.filter(titles, lambda t: ~plural(t))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(
        told("amount", won), told("date", F.transform(days, shown_day)), told("year", years), told("threshold", limits), told("phone", F.array_except(F.map_keys(phones(source)), F.map_keys(phones(english)))),
        told("email", F.array_except(emails(source), emails(english))), told("range", ranges), told("number", alone), told("acronym", acronyms), told("title", terms),
    ))


def literal_rows(text: Column) -> Column:
    """array of struct(kind, value): every typed literal of a text."""
    return bound(_literal_rows, text)


def _literal_rows(text: Column) -> Column:
    rows = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("value")))
    dates = F.transform(calendar_dates(text), shown_day)
    return F.concat(
        rows("amount", F.transform(amounts(text), lambda x: x.cast("decimal(38,0)"))), rows("date", dates), rows("time", clock_minutes(text)),
        rows("phone", F.map_keys(phones(text))), rows("email", emails(text)), rows("url", urls(text)),
    )
