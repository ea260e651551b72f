"""Queries in SQL over the functions that `functions.surface` registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineproof.functions import surface
from lineproof.operators import lines as L
from lineproof.plans import notices
from lineproof.sources import views


def x6_first_wins(spark, sf):
    """The status and flag pairs of an order's lines, each once, in order of their first line."""
    surface.register(spark)
    sql = "select l_orderkey, array_join(first_wins(collect_list(struct(cast(l_linenumber as bigint), concat(l_returnflag, l_linestatus, l_suppkey % 3)))), ' ') as found from {lineitem} group by l_orderkey"
    return spark.sql(sql, lineitem=views.table(spark, sf, "lineitem"))


def x6_union_box(spark, sf):
    surface.register(spark)
    box = "union_box(collect_list(struct(cast(x as bigint), cast(y as bigint), cast(w as bigint), cast(h as bigint))))"
    return spark.sql(f"select notice_id, b.x as x, b.y as y, b.w as w, b.h as h from (select notice_id, {box} as b from {{g1}} group by notice_id)", g1=views.g1(spark, sf))


def x6_greedy_batches(spark, sf):
    """Lines of documents to batches of at most 4 lines and 300 characters, as the table function."""
    surface.register(spark)
    rows = L.source_lines(notices.docs(spark, sf)).select(F.col("doc_id").cast("long").alias("key"), F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("size"))
    return spark.sql("select key as doc_id, pos, batch from greedy_batches(table(select * from {rows}) partition by (key) order by (pos), 4, 300)", rows=rows)


QUERIES = {f.__name__: f for f in (x6_first_wins, x6_union_box, x6_greedy_batches)}
SQL = {
    "x6_first_wins": """with f as (select l_orderkey, l_returnflag || l_linestatus || (l_suppkey % 3) as v, min(l_linenumber) as n from lineitem group by all)
        select l_orderkey, string_agg(v, ' ' order by n, v) as found from f group by 1""",
    "x6_union_box": f"with g1 as ({views.SQL['g1']}) select notice_id, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h from g1 group by notice_id",
    "x6_greedy_batches": notices.SQL["w12_batches"],
}
