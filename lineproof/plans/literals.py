"""Queries over printed values (view T1): the SQL takes the columns that the texts were printed from."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineproof.functions import literals as V
from lineproof.sources import views


def f3_amounts(spark, sf):
    return views.t1(spark, sf).select("notice_id", F.explode(F.transform(V.amounts(F.col("amount")), lambda a: a.cast("long"))).alias("won"))


def f4_calendar_dates(spark, sf):
    return views.t1(spark, sf).select("notice_id", F.inline(V.calendar_dates(F.col("deadline"))))


def f5_english_date(spark, sf):
    """Whether an English line prints the deadline's day; two in three do."""
    day = F.when(F.col("notice_id") % 3 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    text = F.concat(F.lit("Apply by "), day)
    return views.t1(spark, sf).select("notice_id", V.has_month_day(text, F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("told"))


def f6_clock_minutes(spark, sf):
    return views.t1(spark, sf).select("notice_id", F.explode(V.clock_minutes(F.col("deadline"))).alias("minutes"))


def f7_phone_digits(spark, sf):
    return views.t1(spark, sf).select("notice_id", F.explode(V.phones(F.col("contact"))).alias("digits", "printed"))


def f8_emails(spark, sf):
    return views.t1(spark, sf).select("notice_id", F.explode(V.emails(F.col("contact"))).alias("email"))


def f9_unsupported_contacts(spark, sf):
    """Telephone digits of an English line that the source lacks; every seventh notice has another number."""
    line = F.when(F.col("notice_id") % 7 == 0, F.lit("Call 02-555-0199")).otherwise(F.concat(F.lit("Call "), F.regexp_extract(F.col("contact"), "(02-[0-9]+-[0-9]+)", 1)))
    found = F.array_except(F.map_keys(V.phones(line)), F.map_keys(V.phones(F.col("contact"))))
    return views.t1(spark, sf).select("notice_id", F.explode(found).alias("digits"))


def f11_threshold_cells(spark, sf):
    return views.g2(spark, sf).select("notice_id", "role", "col", V.threshold_cell(F.col("txt")).alias("english"))


def f14_literal_counts(spark, sf):
    whole = F.concat_ws("\n", F.col("deadline"), F.col("amount"), F.col("contact"))
    return views.t1(spark, sf, dear=True).select("notice_id", F.size(V.literal_rows(whole)).alias("n_literals"))


def f18_missing_values(spark, sf):
    return views.t1(spark, sf, dear=True).select("notice_id", F.explode(V.missing_values(F.concat_ws("\n", F.col("amount"), F.col("contact")), F.col("english"))).alias("missing"))


def f36_deadline_display(spark, sf):
    parts = F.concat(F.regexp_extract_all(F.col("deadline"), F.lit(r"([0-9]{4}\.[0-9]{2}\.[0-9]{2})"), F.lit(1)), F.regexp_extract_all(F.col("deadline"), F.lit(V.CLOCK), F.lit(0)))
    return views.t1(spark, sf).select("notice_id", F.array_join(parts, " – ").alias("shown"))


def a21_reading_disagreement(spark, sf):
    """The kind of gap between a primary reading and an alternate: values first, then wording."""
    other = F.when(F.col("notice_id") % 4 == 0, F.concat(F.lit("지원금 "), F.lit("7원"))).when(F.col("notice_id") % 4 == 1, F.concat(F.col("amount"), F.lit(" 지급"))).otherwise(F.col("amount"))
    values = lambda c: F.transform(V.literal_rows(c), lambda r: F.concat_ws(":", r["kind"], r["value"]))
    gap = F.when(F.array_sort(values(F.col("amount"))) != F.array_sort(values(other)), "value").when(F.col("amount") != other, "wording").otherwise("none")
    return views.t1(spark, sf).select("notice_id", gap.alias("gap"))


def c12_literal_index(spark, sf):
    lines = F.posexplode(F.array(F.col("deadline"), F.col("amount"), F.col("contact"))).alias("line", "text")
    return views.t1(spark, sf, dear=True).select("notice_id", lines).select("notice_id", "line", F.inline(V.literal_rows(F.col("text"))))


def c13_pair_verdicts(spark, sf):
    found = views.t1(spark, sf, dear=True).select("notice_id", F.explode(V.missing_values(F.concat_ws("\n", F.col("amount"), F.col("contact")), F.col("english"))).alias("missing"))
    return found.groupBy("notice_id", F.substring_index("missing", ":", 1).alias("issue_kind")).agg(F.count(F.lit(1)).alias("n_issues"))


QUERIES = {
    f.__name__: f
    for f in (
        f3_amounts, f4_calendar_dates, f5_english_date, f6_clock_minutes, f7_phone_digits, f8_emails, f9_unsupported_contacts, f11_threshold_cells, f14_literal_counts,
        f18_missing_values, f36_deadline_display, a21_reading_disagreement, c12_literal_index, c13_pair_verdicts,
    )
}

WON = "floor(o_totalprice)::bigint"
A, B = "lpad((o_custkey % 10000)::varchar, 4, '0')", "lpad((o_orderkey % 10000)::varchar, 4, '0')"
DIGITS, EMAIL = f"'02' || {A} || {B}", "'c' || o_custkey || '@example.org'"
MINUTES = "(o_orderkey % 24 * 60 + 30)::int"
MISSING = f"""m as (select o_orderkey as notice_id, 'amount:' || {WON} as missing from orders where o_orderkey % 5 = 0 and {WON} <> 1
    union all select o_orderkey, 'phone:' || {DIGITS} from orders union all select o_orderkey, 'email:' || {EMAIL} from orders)"""
SQL = {
    "f3_amounts": f"select o_orderkey as notice_id, {WON} as won from orders",
    "f4_calendar_dates": "select o_orderkey as notice_id, year(o_orderdate)::int as year, month(o_orderdate)::int as month, day(o_orderdate)::int as day from orders",
    "f5_english_date": "select o_orderkey as notice_id, o_orderkey % 3 <> 0 as told from orders",
    "f6_clock_minutes": f"select o_orderkey as notice_id, {MINUTES} as minutes from orders",
    "f7_phone_digits": f"select o_orderkey as notice_id, {DIGITS} as digits, '02-' || {A} || '-' || {B} as printed from orders",
    "f8_emails": f"select o_orderkey as notice_id, {EMAIL} as email from orders",
    "f9_unsupported_contacts": "select o_orderkey as notice_id, '025550199' as digits from orders where o_orderkey % 7 = 0",
    "f11_threshold_cells": "select p_partkey // 12 as notice_id, r as role, (p_partkey % 12)::int as col, case when r = 'value' then 'at least ' || p_size end as english from part cross join (values ('label'), ('value')) t(r)",
    "f14_literal_counts": "select o_orderkey as notice_id, 5 as n_literals from orders",
    "f18_missing_values": f"with {MISSING} select * from m",
    "f36_deadline_display": "select o_orderkey as notice_id, strftime(o_orderdate, '%Y.%m.%d') || ' – ' || lpad((o_orderkey % 24)::varchar, 2, '0') || ':30' as shown from orders",
    "a21_reading_disagreement": f"select o_orderkey as notice_id, case when o_orderkey % 4 = 0 and {WON} <> 7 then 'value' when o_orderkey % 4 = 1 then 'wording' else 'none' end as gap from orders",
    "c12_literal_index": f"""select o_orderkey as notice_id, 0 as line, 'date' as kind, strftime(o_orderdate, '%Y-%m-%d') as value from orders union all select o_orderkey, 0, 'time', {MINUTES}::varchar from orders
        union all select o_orderkey, 1, 'amount', {WON}::varchar from orders union all select o_orderkey, 2, 'phone', {DIGITS} from orders union all select o_orderkey, 2, 'email', {EMAIL} from orders""",
    "c13_pair_verdicts": f"with {MISSING} select notice_id, split_part(missing, ':', 1) as issue_kind, count(*) as n_issues from m group by 1, 2",
}
