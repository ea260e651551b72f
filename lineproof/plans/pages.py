"""Queries of page layout over document lines set as pages, positioned units (G1) and label and value cells (G2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineproof.functions import text as X
from lineproof.operators import layout as Y
from lineproof.operators import lines as L
from lineproof.operators import pages as P
from lineproof.plans.cases import register
from lineproof.plans.layout import G1, G2, LABELLED
from lineproof.plans.notices import LINES_SQL
from lineproof.sources import views
from lineproof.sources.views import table

ORD = ["notice_id", "ord"]


def two_columns(spark, sf):
    """Lines of a document left and right of the middle in turn, every fourteenth across it."""
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    u = L.source_lines(table(spark, sf, "documents")).withColumn("ord", i.cast("int"))
    x = F.when(F.col("ord") % 14 == 0, 100).when(F.col("ord") % 2 == 1, 50).otherwise(530)
    return u.select(F.col("doc_id").alias("notice_id"), F.lit(1).alias("page_number"), "ord", F.col("line").alias("text"), x.alias("x"), (20 * F.col("ord")).alias("y"), F.when(F.col("ord") % 14 == 0, 800).otherwise(380).alias("w"), F.lit(14).alias("h"), F.lit(90).alias("conf"))


def one_column(spark, sf):
    """Lines of a document one below the other; empty lines leave a space."""
    u = L.source_lines(table(spark, sf, "documents"))
    return u.select(F.col("doc_id").alias("notice_id"), F.lit(1).alias("page_number"), F.col("pos").alias("ord"), F.col("line").alias("text"), F.lit(100).alias("x"), (20 * F.col("pos")).alias("y"), F.lit(700).alias("w"), F.lit(14).alias("h"), F.lit(90).alias("conf"))


def cells(spark, sf):
    n = F.when(F.col("role") == "label", F.col("col")).otherwise(F.col("col") + 12)
    return views.g2(spark, sf).select("notice_id", F.lit(1).alias("page_number"), n.cast("int").alias("ord"), F.col("txt").alias("text"), "x", "y", "w", "h", F.lit(95).alias("conf"), "role", "col")


def w2_column_first(spark, sf):
    return P.column_first(two_columns(spark, sf)).select(*ORD, "place")


def w3_rows(spark, sf):
    close = views.g1(spark, sf).withColumn("y", (F.col("y") - 48 * F.col("ord")).cast("int"))
    return P.rows_by_centre(close).select(*ORD, "row")


def w5_grids(spark, sf):
    """Cells with their place in the grid of their page."""
    units = cells(spark, sf).withColumn("value", P.value_cell(F.col("text")))
    rows = units.join(P.rows_by_centre(units), ["notice_id", "page_number", "ord"])
    return P.grids(Y.segments_by_gap(rows, 150, 75, 250)).drop("page_number")


def w7_paragraphs(spark, sf):
    u = one_column(spark, sf).withColumn("typical", F.lit(14.0)).withColumn("column", F.lit(1))
    u = u.withColumn("kind", P.layout_kind(F.col("text"), F.col("h"), F.col("typical"))).withColumn("administrative", F.lit(False))
    return P.paragraphs(u).drop("page_number")


def w7b_paragraphs_by_gap(spark, sf):
    return P.paragraphs_by_gap(one_column(spark, sf), 10).select(*ORD, "block")


def c1_page_layout(spark, sf):
    """Every unit of a page of cells or of lines is placed once."""
    both = cells(spark, sf).drop("role", "col").withColumn("notice_id", -F.col("notice_id") - 1).unionByName(one_column(spark, sf))
    placed = P.page_layout(both).groupBy("notice_id").agg(F.count(F.lit(1)).alias("n_placed"), F.count_distinct("ord").alias("n_once"))
    return both.groupBy("notice_id").agg(F.count(F.lit(1)).alias("n_units")).join(placed, "notice_id", "left")


def w9_table_order(spark, sf):
    u = cells(spark, sf).withColumn("table", F.lit("t")).withColumn("trow", F.when(F.col("role") == "label", 0).otherwise(1)).withColumn("tcol", F.col("col"))
    return P.table_order(u, F.lit(False)).select(*ORD, "place")


def w10_busiest_region(spark, sf):
    return P.busiest_region(views.g1(spark, sf), F.when(F.col("conf") < 80, 180 - F.col("conf"))).drop("page_number")


def w13b_headed_title(spark, sf):
    u = views.g1(spark, sf).withColumn("kind", F.when(F.col("l_partkey") % 3 == 0, "heading").otherwise("paragraph"))
    return P.title(u.withColumn("text", F.when(F.col("l_suppkey") % 2 == 0, F.lit("한글제목")).when(F.col("l_suppkey") % 7 == 1, F.lit("see https://a.org")).otherwise("Title")))


def w16_regions(spark, sf):
    """Two readings of a page, the later one to the right or narrower by a little, as translation regions."""
    u, c = views.g1(spark, sf), F.col
    x, y, w = (100 + c("l_partkey") % 9).cast("int"), (c("y") - 36 * c("ord")).cast("int"), (500 - c("l_suppkey") % 40).cast("int")
    # One pass over the units tells both readings.
    both = F.array(F.struct(c("ord"), x.alias("x"), c("conf")), F.struct((c("ord") + 100).cast("int").alias("ord"), (x + 2).alias("x"), (c("conf") - 5).alias("conf")))
    told = u.select("notice_id", "page_number", F.concat(F.lit("• part "), "l_partkey").alias("text"), y.alias("y"), w.alias("w"), "h", F.explode(both).alias("r"))
    units = told.select("notice_id", "page_number", "r.ord", "text", "r.x", "y", "w", "h", "r.conf")
    return P.regions(units).select(*ORD, "region")


def j12_attached_suffixes(spark, sf):
    c = cells(spark, sf)
    return P.attached_suffixes(c.filter("role = 'label'"), c.filter("role = 'value'")).select(*ORD, "suffixes")


def j11b_row_labels(spark, sf):
    p = table(spark, sf, "part").select(F.expr("p_partkey div 12").alias("notice_id"), F.lit(1).alias("page_number"), (F.col("p_partkey") % 12).cast("int").alias("row"), "p_size")
    label = p.select("notice_id", "page_number", "row", F.col("row").alias("ord"), F.lit("label").alias("role"), F.lit(100).alias("x"), F.lit(40).alias("w"))
    value = p.select("notice_id", "page_number", "row", (F.col("row") + 12).alias("ord"), F.lit("value").alias("role"), (100 + 15 * F.col("p_size")).cast("int").alias("x"), F.lit(40).alias("w"))
    return P.row_labels(label.unionByName(value)).select(*ORD, "label_ord")


def qualifiers(spark, sf):
    """A line above each page's table; by page, a second one in the same words, in others, far above, or none."""
    n = cells(spark, sf).select("notice_id", "page_number").distinct()
    line = lambda text, x, y: F.struct(F.lit(text).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(300).alias("w"))
    k = F.col("notice_id") % 4
    second = F.when(k == 0, line(" · One of A", 150, 60)).when(k == 1, line("one of B", 150, 60)).when(k == 2, line("one of B", 150, 10))
    return n.select("notice_id", "page_number", F.explode(F.array_compact(F.array(line("one of A", 100, 60), second))).alias("q")).select("notice_id", "page_number", "q.*")


def choices(spark, sf):
    box = Y.union_boxes(cells(spark, sf), "notice_id", "page_number")
    return P.scoped_choices(box, qualifiers(spark, sf))


def j14_scoped_choices(spark, sf):
    return choices(spark, sf).select("notice_id", "choice")


def c8_published_scores(spark, sf):
    pairs = Y.label_values(views.g2(spark, sf)).select("notice_id", F.lit(1).alias("page_number"), F.col("label_col").alias("place"), "label", "value")
    return P.published_scores(pairs, choices(spark, sf)).drop("page_number")


def j20_placements(spark, sf):
    u = views.g1(spark, sf).withColumn("x", (100 + F.col("l_partkey") % 20).cast("int")).withColumn("y", (15 * F.col("ord") + F.col("l_suppkey") % 3).cast("int")).withColumn("w", F.lit(500)).withColumn("replace", F.col("l_partkey") % 4 != 0)
    return P.placements(u).select(*ORD, "top", "bottom", "reason")


def j21_realigned(spark, sf):
    """Lines of documents after a correction: some changed, some gone, and every fifth document upside down."""
    old = L.source_lines(table(spark, sf, "documents"))
    new = old.filter(~((F.col("doc_id") % 3 == 0) & (F.col("pos") % 11 == 5))).withColumn("line", F.when(F.col("pos") % 7 == 3, F.concat("line", F.lit(" x"))).otherwise(F.col("line")))
    return P.realigned(old, new.withColumn("pos", F.when(F.col("doc_id") % 5 == 0, -F.col("pos")).otherwise(F.col("pos"))))


def j23_related_crops(spark, sf):
    u = views.g1(spark, sf).withColumn("block", F.col("l_suppkey") % 3)
    return P.related_crops(u, F.when(F.col("conf") < 85, 200 - F.col("conf"))).select(*ORD, "crop")


def p22_discardable_captions(spark, sf):
    u = one_column(spark, sf)
    blocks = u.withColumn("kind", P.layout_kind(F.col("text"), F.col("h"), F.lit(14)))
    return P.discardable_captions(u, blocks).select(*ORD)


QUERIES = {
    f.__name__: f
    for f in (
        w2_column_first, w3_rows, w5_grids, w7_paragraphs, w7b_paragraphs_by_gap, c1_page_layout, w9_table_order, w10_busiest_region, w13b_headed_title, w16_regions, j12_attached_suffixes,
        j11b_row_labels, j14_scoped_choices, c8_published_scores, j20_placements, j21_realigned, j23_related_crops, p22_discardable_captions,
    )
}

CELLS = f"{G2}, c as (select *, case when role = 'label' then col else col + 12 end as ord from g2)"
CHOICES = "q as (select distinct notice_id from g2), choice as (select notice_id, 'one of A' as choice from q where notice_id % 4 <> 1)"
SQL = {
    "w2_column_first": f"""with {LINES_SQL}, u as (select doc_id as notice_id, (row_number() over (partition by doc_id order by pos) - 1)::int as ord from lines),
        b as (select *, ord % 14 = 0 as bridge, ord // 14 as band, max(ord) over (partition by notice_id) // 14 as last from u)
        select notice_id, ord, case when bridge or band >= last then ord else band * 14 + row_number() over (partition by notice_id, band, bridge order by ord % 2 desc, ord) end::int as place from b""",
    "w3_rows": f"""with recursive {G1}, c as (select notice_id, ord, x, y - 48 * ord as y, h from g1), o as (select *, 2 * y + h as m, row_number() over (partition by notice_id order by 2 * y + h, x, ord) as i from c),
        f as (select notice_id, ord, i, 1 as row, [m] as ms, [h] as hs from o where i = 1 union all
            select o.notice_id, o.ord, o.i, case when near then f.row else f.row + 1 end, case when near then list_append(f.ms, o.m) else [o.m] end, case when near then list_append(f.hs, o.h) else [o.h] end
            from (select o.*, abs(o.m - list_median(f.ms)) <= 1.1 * greatest(o.h, list_median(f.hs)) as near, f.row, f.ms, f.hs from f join o on o.notice_id = f.notice_id and o.i = f.i + 1) o, lateral (select o.row, o.ms, o.hs) f)
        select notice_id, ord, row from f""",
    "w7b_paragraphs_by_gap": f"""with {LINES_SQL}, s as (select doc_id, pos, coalesce((pos - lag(pos) over (partition by doc_id order by pos) > 1)::int, 1) as s from lines),
        g as (select *, sum(s) over (partition by doc_id order by pos) as g from s) select doc_id as notice_id, pos as ord, min(pos) over (partition by doc_id, g) as block from g""",
    "c1_page_layout": f"with {G2}, {LINES_SQL}, u as (select -notice_id - 1 as notice_id from g2 union all select doc_id from lines) select notice_id, count(*) as n_units, count(*) as n_placed, count(*) as n_once from u group by 1",
    "w9_table_order": f"""with {CELLS}, k as (select *, count(*) over (partition by notice_id) as n, row_number() over (partition by notice_id order by ord) as slot, row_number() over (partition by notice_id order by col, role) as want from c)
        select a.notice_id, a.ord::int as ord, case when a.n >= 6 then b.ord else a.ord end::int as place from k a join k b on a.notice_id = b.notice_id and a.want = b.slot""",
    "w10_busiest_region": f"""with {G1}, c as (select notice_id, ord, 2 * y + h as mid, 180 - conf as weight, 340 as size from g1 where conf < 80), s as (select *, greatest(0, least(2 * (1000 - size), mid - size)) as start from c),
        m as (select s.notice_id, s.ord, s.start, s.size, sum(c.weight)::bigint as weight from s join c on c.notice_id = s.notice_id and c.mid between s.start and s.start + 2 * s.size group by all)
        select notice_id, start / 2 as start, size as length, weight from m qualify row_number() over (partition by notice_id order by weight desc, ord) = 1""",
    "w13b_headed_title": f"""with {G1} select notice_id, ord as title from g1 where l_partkey % 3 = 0 and (l_suppkey % 2 = 0 or l_suppkey % 7 <> 1)
        qualify row_number() over (partition by notice_id order by l_suppkey % 2 = 0 desc, h desc, ord) = 1""",
    "j12_attached_suffixes": "select p_partkey // 12 as notice_id, (p_partkey % 12)::int as ord, p_size || ' 이상' as suffixes from part where p_size % 40 <= 20",
    "j11b_row_labels": "select p_partkey // 12 as notice_id, (p_partkey % 12 + 12)::int as ord, (p_partkey % 12)::int as label_ord from part where p_size between 1 and 40",
    "j14_scoped_choices": f"with {G2}, {CHOICES} select * from choice",
    "c8_published_scores": f"""with {LABELLED}, {CHOICES}, r as (select notice_id, label_col as place, 'language_score' as kind, label || ': ' || value || ' or higher' as text from pairs
        union all select notice_id, -1, 'language_score_choice', 'Meet at least one of the following English-test score thresholds.' from choice where notice_id in (select notice_id from pairs))
        select notice_id, printf('F%03d', row_number() over (partition by notice_id order by place)) as fact, kind, text from r""",
    "j20_placements": f"""with {G1}, u as (select notice_id, ord, 15 * ord + l_suppkey % 3 as y, h, l_partkey % 4 <> 0 as rep from g1),
        p as (select a.notice_id, a.ord as a, b.ord as b, a.y as a_y, a.h as a_h, b.y as b_y, b.h as b_h, a.rep as ar, b.rep as br,
            2 * (a.y + a.h - b.y) <= least(a.h, b.h) and abs(2 * a.y + a.h - 2 * b.y - b.h) >= least(a.h, b.h) as lines from u a join u b on a.notice_id = b.notice_id and b.ord > a.ord and a.y + a.h > b.y),
        blocked as (select notice_id, a as ord from p where not lines and ar union select notice_id, b from p where not lines and br),
        q as (select p.*, br and (notice_id, b) not in (select (notice_id, ord) from blocked) as bon, ar and (notice_id, a) not in (select (notice_id, ord) from blocked) as aon from p where lines),
        cut as (select notice_id, ord, max(t) as t, min(b) as b from (select notice_id, a as ord, null as t, case when bon then (greatest(a_y, b_y) + least(a_y + a_h, b_y + b_h)) / 2 else b_y end as b from q where ar
            union all select notice_id, b, case when aon then (greatest(a_y, b_y) + least(a_y + a_h, b_y + b_h)) / 2 else a_y + a_h end, null from q where br) group by all),
        f as (select u.*, greatest(y::double, coalesce(t, y)) as top, least((y + h)::double, coalesce(b, y + h)) as bottom, (notice_id, ord) in (select (notice_id, ord) from blocked) as bad from u left join cut using (notice_id, ord))
        select notice_id, ord, case when not bad and bottom > top then top end as top, case when not bad and bottom > top then bottom end as bottom, case when bad or bottom <= top then 'overlap' end as reason from f""",
    "j21_realigned": f"""with {LINES_SQL}, o as (select doc_id, pos, line, row_number() over (partition by doc_id order by pos) as i, count(*) over (partition by doc_id, line) as n from lines),
        m as (select doc_id, case when doc_id % 5 = 0 then -pos else pos end as pos, case when pos % 7 = 3 then line || ' x' else line end as line from lines where not (doc_id % 3 = 0 and pos % 11 = 5)),
        w as (select *, row_number() over (partition by doc_id order by pos) as i, count(*) over (partition by doc_id, line) as n from m),
        met as (select o.doc_id, o.i as ai, w.i as bi from o join w on o.doc_id = w.doc_id and o.line = w.line and o.n = 1 and w.n = 1),
        mixed as (select distinct doc_id from (select doc_id, ai <= lag(ai) over (partition by doc_id order by bi) as t from met) where t),
        anchors as (select * from met where doc_id not in (select doc_id from mixed)),
        ro as (select o.doc_id, o.pos, a.ai is not null as anchor, count(a.ai) over (partition by o.doc_id order by o.i) as run, o.i from o left join anchors a on a.doc_id = o.doc_id and a.ai = o.i where o.doc_id not in (select doc_id from mixed)),
        rw as (select w.doc_id, w.pos, a.bi is not null as anchor, count(a.bi) over (partition by w.doc_id order by w.i) as run, w.i from w left join anchors a on a.doc_id = w.doc_id and a.bi = w.i where w.doc_id not in (select doc_id from mixed)),
        ko as (select *, row_number() over (partition by doc_id, run order by i) as k, count(*) over (partition by doc_id, run) as size from ro), kw as (select *, row_number() over (partition by doc_id, run order by i) as k, count(*) over (partition by doc_id, run) as size from rw)
        select doc_id, kw.pos, ko.pos as old_pos from kw join ko using (doc_id, run, k) where kw.size = ko.size or kw.anchor""",
    "p22_discardable_captions": f"with {LINES_SQL} select doc_id as notice_id, pos as ord from lines where length(line) <= 2 and not regexp_matches(line, '{P.PROTECTED}')",
}

register("p10b_layout_kinds", "source height", [
    ("A1", "14", "caption"), ("유의사항 및 문의사항", "14", "heading"), ("※ 제출한 서류는 돌려주지 않습니다", "14", "condition"), ("다만 예외가 있습니다", "30", "condition"), ("1. 신청 방법을 확인하세요", "14", "list"), ("신청서를 작성하고 다음 서류를", "14", "paragraph"),
    ("큰 글씨로 된 아주 긴 제목입니다 하나 둘", "30", "heading"), ("안내", "14", "caption"), ("모집 안내", "14", "heading"), ("모집 {n}명", "14", "paragraph"), ("길고 평범한 문장입니다 그렇습니다 네", "14", "paragraph"),
], lambda: P.layout_kind(F.col("source"), F.col("height").cast("int"), F.lit(14)))

register("p12b_value_cells", "cell", [
    ("{n}", "yes"), ("TOEIC {n}", "yes"), ("{n} 이상", "yes"), ("IM2", "yes"), ("2026.3.4(수) 14:00", "yes"), ("팀 50만원", "yes"), ("{n}명", "yes"), ("화요일", "no"), ("설명", "no"), ("총 {n}명 모집", "no"),
], lambda: F.when(P.value_cell(F.col("cell")), "yes").otherwise("no"))
