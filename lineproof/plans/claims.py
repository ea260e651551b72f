"""Queries of folded facts, score claims and page quality over line items, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineproof.operators import claims as A
from lineproof.sources import views
from lineproof.sources.views import table

C = F.col
FACTS = """select notice_id, ord as item, case when l_partkey % 2 = 0 then 'eligibility' else 'key_details' end as field, cast(1 - l_partkey % 2 as int) as rank, cast(1 + l_suppkey % 2 as int) as page,
    concat('Fact ', cast(l_partkey % 3 as {str})) as text, concat('quote ', cast(h % 2 as {str})) as evidence, {array}(cast(ord as int), cast(l_suppkey % 3 + 100 as int)) as fact_ids, conf > 75 as repair,
    case when w % 3 = 0 then 'needs_review' else 'verified' end as state, concat('image ', cast(l_suppkey % 2 as {str})) as image from {g1}"""


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def a13_folded_facts(spark, sf):
    """Line items as facts of few wordings and quotes; every other one came from a repair."""
    facts = spark.sql(FACTS.format(str="string", array="array", g1="{g1}"), g1=views.g1(spark, sf))
    found = A.folded_facts(facts)
    return found.select("notice_id", "item", "field", "page", "evidence", joined(C("fact_ids")).alias("ids"), "state", "image", "n")


def j25_score_claims_by_label(spark, sf):
    """Orders demand two exams; the English is whole, changes one score, names another exam, or gives the scores to the wrong exams."""
    o, k = views.spread(spark, sf, "orders", "o_orderkey", "o_custkey"), C("o_orderkey") % 5
    a, b = (C("o_orderkey") % 300 + 600).cast("string"), (C("o_custkey") % 50 + 60).cast("string")
    told = lambda x, y, more="": F.concat(F.lit("TOEIC "), x, F.lit(" or higher, TEPS "), y, F.lit(" or higher"), F.lit(more))
    english = F.when(k == 0, told(b, a)).when(k == 1, told(a, F.lit("999"))).when(k == 2, told(a, b, ", IELTS 7")).when(k == 3, F.concat(F.lit("TOEIC "), a)).otherwise(told(a, b))
    rows = o.select(C("o_orderkey").alias("notice_id"), F.concat(F.lit("TOEIC "), a, F.lit("점 이상, TEPS "), b, F.lit("점 이상")).alias("source"), english.alias("english"))
    return A.score_claims(rows)


def p13_photo_quality(spark, sf):
    """Parts as photos whose metrics follow from size, price and key."""
    n, k = C("p_size"), C("p_partkey")
    pages = table(spark, sf, "part").select(
        "p_partkey", (n * 30).alias("width"), F.lit(1200).alias("height"), (k % 90).alias("blur"), (n * 3).alias("brightness"), (k % 40 / 100).alias("glare"), (k % 31 / 100).alias("coverage"),
        (k % 7 * 2).alias("box_x"), F.lit(30).alias("box_y"), (n * 20).alias("box_w"), F.lit(900).alias("box_h"))
    return A.page_quality(pages).select("p_partkey", F.array_join("issues", ",").alias("issues"), "readable")


QUERIES = {f.__name__: f for f in (a13_folded_facts, j25_score_claims_by_label, p13_photo_quality)}
SQL = {
    "a13_folded_facts": f"""with g1 as ({views.SQL['g1']}), f as ({FACTS.format(str='varchar', array='list_value', g1='g1')}), r as (select *, rank * 1000 + item as place from f),
        m as (select *, min(place) over (partition by notice_id, page, field, text, evidence) as target from r where not repair), h as (select notice_id, page, text, min(target) as head from m group by 1, 2, 3),
        a as (select r.*, coalesce(head, min(place) over (partition by r.notice_id, r.page, r.text, r.field)) as target from r left join h on h.notice_id = r.notice_id and h.page = r.page and h.text = r.text where repair),
        e as (select * from m union all by name select * from a), q as (select notice_id, target, evidence, min(place) as spot from e group by 1, 2, 3),
        i as (select notice_id, target, id, min(spot) as spot from (select notice_id, target, place * 10 as spot, fact_ids[1] as id from e union all select notice_id, target, place * 10 + 1, fact_ids[2] from e) z group by 1, 2, 3),
        qs as (select notice_id, target, string_agg(evidence, chr(10) order by spot) as evidence from q group by 1, 2), ids as (select notice_id, target, string_agg(id::varchar, ',' order by spot) as ids from i group by 1, 2),
        g as (select notice_id, target, arg_min(item, abs(place - target)) as item, arg_min(field, abs(place - target)) as field, min(page) as page, case when bool_and(state = 'verified') then 'verified' else 'needs_review' end as state,
            case when min(image) = max(image) then min(image) end as image, count(*) as n from e group by 1, 2)
        select notice_id, item, field, page, evidence, ids, state, image, n from g join qs using (notice_id, target) join ids using (notice_id, target)""",
    "j25_score_claims_by_label": """with s as (select o_orderkey as notice_id, o_orderkey % 5 as k, (o_orderkey % 300 + 600)::varchar as a, (o_custkey % 50 + 60)::varchar as b from orders)
        select notice_id, 'toeic' as label, a as score, 'missing or changed' as issue from s where k = 0 union all select notice_id, 'teps', b, 'missing or changed' from s where k in (0, 1, 3)
        union all select notice_id, 'ielts', '7', 'unsupported exam' from s where k = 2""",
    "p13_photo_quality": """with p as (select p_partkey, p_size * 30 as width, least(p_size * 30, 1200) as side, p_partkey % 90 as blur, p_size * 3 as light, p_partkey % 40 / 100 as glare, p_partkey % 31 / 100 as coverage, p_partkey % 7 * 2 as x, p_size * 20 as w from part),
        q as (select *, greatest(4, floor(side * 0.01)) as edge from p)
        select p_partkey, concat_ws(',', case when side < 400 then 'very_low_resolution' when side < 800 then 'low_resolution' end, case when blur < 25 then 'severe_blur' when blur < 65 then 'blur' end,
            case when light < 40 then 'too_dark' when light < 68 then 'dark' end, case when glare > 0.06 and glare < 0.3 then 'glare' end, case when coverage > 0.01 and coverage < 0.12 then 'notice_too_small' end,
            case when coverage > 0.2 and (x <= edge or x + w >= width - edge) then 'possible_cutoff' end) as issues, not (side < 400 or blur < 25 or light < 40) as readable from q""",
}
