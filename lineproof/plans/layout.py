"""Queries over positioned units (views G1 and G2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineproof.operators import layout as Y
from lineproof.sources import views


def g1(spark, sf):
    return views.g1(spark, sf).withColumn("text_key", F.col("l_partkey") % 10)


def later_pass(spark, sf):
    """A second reading of the same pages: some boxes moved, some narrower, some clearer."""
    odd = F.col("l_partkey") % 2
    moved = F.when(F.col("l_partkey") % 3 == 0, 60).when(odd == 0, 2).otherwise(0)
    return g1(spark, sf).withColumn("x", (F.col("x") + moved).cast("int")).withColumn("w", (F.col("w") - 1 + odd).cast("int")).withColumn("conf", (F.col("conf") + F.col("l_suppkey") % 2 * 5).cast("int"))


def rows_of_three(spark, sf):
    return g1(spark, sf).withColumn("row", F.floor((F.col("ord") - 1) / 3).cast("int"))


def p1_box_validity(spark, sf):
    return views.g1(spark, sf).select("notice_id", "ord", Y.valid_box(900, 400).alias("valid"))


def p2_clamped_boxes(spark, sf):
    corner = lambda x, y: F.struct((F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"))
    polygon = F.array(corner(F.lit(-20), F.lit(0)), corner(F.col("w"), F.lit(2)), corner(F.col("w"), F.col("h")), corner(F.lit(-20), F.col("h") - 1))
    return views.g1(spark, sf).select("notice_id", "ord", Y.clamped_box(polygon, 860, 1000).alias("b")).select("notice_id", "ord", *[F.col(f"b.{c}").cast("int").alias(c) for c in "xywh"])


def p9_column_side(spark, sf):
    return views.g1(spark, sf).select("notice_id", "ord", Y.column_side().alias("side"))


def p12_value_cells(spark, sf):
    told = F.col("txt").rlike(Y.VALUE_CELL)
    return views.g2(spark, sf).groupBy("notice_id", "role").agg(F.count_if(told).alias("n_values"), F.bool_or(told).alias("holds_value"))


def j8_same_cell(spark, sf):
    found = Y.overlapping_pairs(g1(spark, sf), later_pass(spark, sf), Y.same_cell())
    return found.select(F.col("a.notice_id").alias("notice_id"), F.col("a.ord").alias("ord"), F.col("b.ord").alias("later_ord"))


def j9_same_area(spark, sf):
    found = Y.overlapping_pairs(g1(spark, sf), later_pass(spark, sf), Y.same_area())
    return found.select(F.col("a.notice_id").alias("notice_id"), F.col("a.ord").alias("ord"), F.col("b.ord").alias("later_ord"))


def j10_same_region(spark, sf):
    found = Y.overlapping_pairs(g1(spark, sf), later_pass(spark, sf), Y.same_region())
    return found.select(F.col("a.notice_id").alias("notice_id"), F.col("a.ord").alias("ord"), F.col("b.ord").alias("later_ord"))


def j11_label_values(spark, sf):
    return Y.label_values(views.g2(spark, sf))


def j13_nearest_column(spark, sf):
    return Y.nearest_columns(views.g2(spark, sf))


def a8_union_box(spark, sf):
    return Y.union_boxes(views.g1(spark, sf), "notice_id")


def a9_glyph_height(spark, sf):
    return views.g1(spark, sf).groupBy("notice_id").agg(F.median("h").alias("height"))


def a10_merged_readings(spark, sf):
    return Y.merged_readings(g1(spark, sf), later_pass(spark, sf)).drop("page_number")


def a11_clearer_readings(spark, sf):
    return Y.clearer_readings(g1(spark, sf), later_pass(spark, sf)).drop("page_number")


def a15_ambiguous_labels(spark, sf):
    return Y.ambiguous_labels(Y.label_values(views.g2(spark, sf)))


def a22_low_confidence(spark, sf):
    low = F.count_if(F.col("conf") < 70)
    return views.g1(spark, sf).groupBy("notice_id").agg(low.alias("n_low"), (low * 2 > F.count(F.lit(1))).alias("warned"))


def w3b_rows(spark, sf):
    close = views.g1(spark, sf).withColumn("y", (F.col("y") - 45 * F.col("ord")).cast("int"))
    return Y.rows_by_gap(close, 14).select("notice_id", "ord", "row")


def w4_segments(spark, sf):
    return Y.segments_by_gap(rows_of_three(spark, sf)).select("notice_id", "ord", "segment")


def w6_column_cuts(spark, sf):
    return Y.column_cuts(rows_of_three(spark, sf)).select("notice_id", "cut", "n_gaps")


def w13_title(spark, sf):
    """The tallest unit of those read with confidence, else of all; ties to the earliest."""
    rank = F.struct((F.col("conf") >= 70).alias("sure"), "h", (-F.col("ord")).alias("early"))
    return views.g1(spark, sf).groupBy("notice_id").agg(F.max_by("ord", rank).alias("title"))


def w14_span_budget(spark, sf):
    paged = views.g1(spark, sf).withColumn("page_number", F.floor((F.col("ord") - 1) / 3).cast("int"))
    return Y.within_budget(paged, 2, 3).select("notice_id", "page_number", "ord")


def k4_recovery_crops(spark, sf):
    return Y.crops_within_budget(views.g1(spark, sf), 100 - F.col("conf"), F.col("w") * F.col("h"), 4, 5000)


def k5_reading_order(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("notice_id").orderBy(F.col("y").asc_nulls_last(), "x", "ord")
    return views.g1(spark, sf).withColumn("y", F.when(F.col("conf") >= 60, F.col("y"))).select("notice_id", "ord", F.row_number().over(w).alias("place"))


def f29_layout_hints(spark, sf):
    return Y.layout_hints(views.g1(spark, sf)).select("notice_id", "hints")


QUERIES = {
    f.__name__: f
    for f in (
        p1_box_validity, p2_clamped_boxes, p9_column_side, p12_value_cells, j8_same_cell, j9_same_area, j10_same_region, j11_label_values, j13_nearest_column,
        a8_union_box, a9_glyph_height, a10_merged_readings, a11_clearer_readings, a15_ambiguous_labels, a22_low_confidence, w3b_rows, w4_segments, w6_column_cuts,
        w13_title, w14_span_budget, k4_recovery_crops, k5_reading_order, f29_layout_hints,
    )
}

G1, G2 = f"g1 as ({views.SQL['g1']})", f"g2 as ({views.SQL['g2']})"
BOTH = f"""{G1}, a as (select *, l_partkey % 10 as text_key from g1),
    b as (select * replace ((x + case when l_partkey % 3 = 0 then 60 when l_partkey % 2 = 0 then 2 else 0 end)::int as x, (w - 1 + l_partkey % 2)::int as w, (conf + l_suppkey % 2 * 5)::int as conf) from a),
    near as (select a.notice_id, a.ord, b.ord as later_ord, a.text_key = b.text_key as same, a.conf as conf, b.conf as later_conf, a.w as aw, b.w as bw, a.w * a.h as aa, b.w * b.h as ba,
        greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) as common from a join b using (notice_id))"""
SAME_AREA = "common > 0 and least(aw, bw) * 10 >= greatest(aw, bw) * 8 and common * 10 >= greatest(aa, ba) * 7"
SAME_REGION = "same and common > 0 and common * 100 >= least(aa, ba) * 35"
LABELLED = f"""{G2}, near as (select l.notice_id, l.txt as label, l.col as label_col, v.txt as value, v.col as value_col from g2 l join g2 v on l.notice_id = v.notice_id and l.role = 'label' and v.role = 'value'
        and abs((2 * v.x + v.w) - (2 * l.x + l.w)) <= 50 and (2 * v.y + v.h) - (2 * l.y + l.h) between 1 and 120),
    pairs as (select * from near qualify count(*) over (partition by notice_id, label_col) = 1 and count(*) over (partition by notice_id, value_col) = 1)"""
THREES = f"{G1}, r as (select *, (ord - 1) // 3 as row from g1)"
SQL = {
    "p1_box_validity": f"with {G1} select notice_id, ord, x >= 0 and y >= 0 and w > 0 and h > 0 and x + w <= 900 and y + h <= 400 as valid from g1",
    "p2_clamped_boxes": f"""with {G1}, c as (select *, greatest(x - 20, 0) as l, least(x + w, 860) as r, least(y + h, 1000) as bottom from g1)
        select notice_id, ord, case when r > l then l end::int as x, case when r > l then y end::int as y, case when r > l then r - l end::int as w, case when r > l then bottom - y end::int as h from c""",
    "p9_column_side": f"with {G1} select notice_id, ord, case when x + w <= 490 then 'left' when x >= 510 then 'right' else 'bridge' end as side from g1",
    "p12_value_cells": f"with {G2} select notice_id, role, count(*) filter (where role = 'value') as n_values, role = 'value' as holds_value from g2 group by notice_id, role",
    "j8_same_cell": f"with {BOTH} select notice_id, ord, later_ord from near where same and common > 0 and common * 10 >= (aa + ba - common) * 6",
    "j9_same_area": f"with {BOTH} select notice_id, ord, later_ord from near where {SAME_AREA}",
    "j10_same_region": f"with {BOTH} select notice_id, ord, later_ord from near where {SAME_REGION}",
    "j11_label_values": f"with {LABELLED} select * from pairs",
    "j13_nearest_column": f"""with {G2} select v.notice_id, v.col, arg_min(l.col, abs((2 * v.x + v.w) - (2 * l.x + l.w)) * 1000 + l.col) as column
        from g2 v join g2 l on l.notice_id = v.notice_id and l.role = 'label' where v.role = 'value' group by v.notice_id, v.col""",
    "a8_union_box": f"with {G1} select notice_id, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h from g1 group by notice_id",
    "a9_glyph_height": f"with {G1} select notice_id, median(h) as height from g1 group by notice_id",
    "a10_merged_readings": f"""with {BOTH}, home as (select notice_id, later_ord, min(ord) as ord from near where {SAME_AREA} group by 1, 2), n as (select notice_id, ord, count(*) as n from home group by 1, 2)
        select a.notice_id, a.ord, 1 as pass, coalesce(n, 0) as n_readings from a left join n using (notice_id, ord)
        union all select notice_id, ord, 2, 0 from b where (notice_id, ord) not in (select (notice_id, later_ord) from home)""",
    "a11_clearer_readings": f"""with {BOTH}, best as (select notice_id, ord, max(later_conf) as later from near where {SAME_REGION} group by 1, 2)
        select a.notice_id, a.ord, case when later > conf then 2 else 1 end as pass, greatest(conf, coalesce(later, 0))::int as conf from a left join best using (notice_id, ord)""",
    "a15_ambiguous_labels": f"with {LABELLED} select notice_id, label, count(*) as n_pairs, count(distinct value) as n_values, count(distinct value) > 1 as ambiguous from pairs group by 1, 2 having count(*) > 1",
    "a22_low_confidence": f"with {G1} select notice_id, count(*) filter (where conf < 70) as n_low, 2 * count(*) filter (where conf < 70) > count(*) as warned from g1 group by 1",
    "w3b_rows": f"""with {G1}, c as (select notice_id, ord, x, y - 45 * ord as y from g1), s as (select *, coalesce((y - lag(y) over (partition by notice_id order by y, x, ord) > 14)::int, 1) as s from c)
        select notice_id, ord, sum(s) over (partition by notice_id order by y, x, ord)::bigint as row from s""",
    "w4_segments": f"""with {THREES}, g as (select *, x - lag(x + w) over p as space, w >= 80 or lag(w) over p >= 80 as beside from r window p as (partition by notice_id, row order by x, ord)),
        s as (select *, coalesce((space > 150 or (space > 75 and beside))::int, 1) as s from g) select notice_id, ord, sum(s) over (partition by notice_id, row order by x, ord)::bigint as segment from s""",
    "w6_column_cuts": f"""with {THREES}, g as (select notice_id, x + w as a, lead(x) over (partition by notice_id, row order by x, ord) as b from r)
        select notice_id, median(a + b) / 2 as cut, count(*) as n_gaps from g where b - a > 100 group by 1 having count(*) >= 2""",
    "w13_title": f"with {G1} select notice_id, ord as title from g1 qualify row_number() over (partition by notice_id order by conf >= 70 desc, h desc, ord) = 1",
    "w14_span_budget": f"""with {G1}, p as (select notice_id, ((ord - 1) // 3)::int as page_number, ord from g1), f as (select * from p qualify row_number() over (partition by notice_id, page_number order by ord) <= 2)
        select * from f qualify row_number() over (partition by notice_id order by page_number, ord) <= 3""",
    "k4_recovery_crops": f"""with recursive {G1}, c as (select notice_id, ord, w * h as size, row_number() over (partition by notice_id order by conf, ord) as rank from g1),
        t as (select notice_id, 0::bigint as rank, 0::bigint as held, '' as taken from (select distinct notice_id from c) union all
            select t.notice_id, c.rank, case when held + size <= 5000 then held + size else held end, case when held + size <= 5000 then taken || ',' || ord else taken end from t join c on c.notice_id = t.notice_id and c.rank = t.rank + 1 and c.rank <= 4)
        select notice_id, ltrim(taken, ',') as taken, held from t qualify row_number() over (partition by notice_id order by rank desc) = 1""",
    "k5_reading_order": f"with {G1} select notice_id, ord, row_number() over (partition by notice_id order by case when conf >= 60 then y end nulls last, x, ord)::int as place from g1",
    "f29_layout_hints": f"with {G1} select notice_id, string_agg(printf('(%03d,%03d)', (2 * x + w) // 2, (2 * y + h) // 2), ' ' order by y, x, ord) as hints from g1 group by 1",
}
