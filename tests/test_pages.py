"""Page layout by small pages whose layout is plain to see, and closures by brute force."""

from pyspark.sql import functions as F

from lineproof.operators import facts as A
from lineproof.operators import layout as Y
from lineproof.operators import pages as P
from lineproof.plans import facts as plans
from lineproof.plans import pages
from lineproof.sources.scratch import stored
from lineproof.sources.views import table

UNIT = "notice_id long, page_number int, ord int, text string, x int, y int, w int, h int, conf int"


def page(spark, *units, confidence=95):
    return spark.createDataFrame([(1, 1, i, *u, confidence) for i, u in enumerate(units)], UNIT)


def told(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("ord").collect()]


def test_rows_follow_the_running_median(spark):
    df = page(spark, ("a", 0, 100, 50, 20), ("b", 200, 106, 50, 20), ("c", 400, 92, 50, 20), ("d", 0, 125, 50, 20), ("e", 100, 300, 50, 20))
    assert told(P.rows_by_centre(df), "ord", "row") == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 3)]


def grids(df):
    held = df.withColumn("value", P.value_cell(F.col("text")))
    rows = held.join(P.rows_by_centre(held), ["notice_id", "page_number", "ord"])
    return told(P.grids(Y.segments_by_gap(rows, 150, 75, 250)), "ord", "grid", "grid_row", "grid_column")


TABLE = [("구분", 100, 100, 60, 20), ("상금", 200, 100, 60, 20), ("최우수상", 100, 130, 70, 20), ("50만원", 200, 130, 60, 20), ("우수상", 100, 160, 60, 20), ("30만원", 200, 160, 60, 20)]


def test_repeated_grids(spark):
    cells = [(0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 1, 0), (3, 0, 1, 1), (4, 0, 2, 0), (5, 0, 2, 1)]
    assert grids(page(spark, *TABLE)) == cells
    # A trailing label without a value, a line across the columns, and what lies far below are no rows of the grid.
    assert grids(page(spark, *TABLE, ("문의", 100, 190, 60, 20))) == cells
    assert grids(page(spark, *TABLE, ("이 문장은 두 칸을 가로지릅니다", 90, 190, 300, 20), ("다음", 100, 220, 60, 20), ("10만원", 200, 220, 60, 20))) == cells
    assert grids(page(spark, *TABLE, ("다음", 100, 400, 60, 20), ("10만원", 200, 400, 60, 20))) == cells
    # Prose under two headings has no value; unsure headers start nothing.
    assert grids(page(spark, ("개요", 100, 100, 60, 20), ("방법", 200, 100, 60, 20), ("글이다", 100, 130, 60, 20), ("글이네", 200, 130, 60, 20))) == []
    assert grids(page(spark, *TABLE, confidence=60)) == []


def test_paragraphs_and_sections(spark):
    df = page(
        spark, ("모집 안내", 100, 0, 200, 30), ("이 문장은 첫 줄에서 시작하여 다음", 100, 40, 400, 20), ("옆", 700, 55, 30, 20), ("줄에서 끝난다는 긴 문장입니다", 100, 62, 390, 20), ("1. 첫 번째 항목은 이렇습니다", 100, 90, 300, 20),
        ("유의사항", 100, 120, 80, 20), ("마지막 줄은 새 절에 있습니다 그렇지요", 100, 150, 400, 20),
    )
    found = told(P.page_layout(df), "ord", "block", "section", "kind")
    assert found == [(0, 0, 0, "heading"), (1, 1, 0, "paragraph"), (2, 2, 0, "caption"), (3, 1, 0, "paragraph"), (4, 4, 0, "list"), (5, 5, 5, "heading"), (6, 6, 5, "paragraph")]


def test_layout_places_every_unit_once(spark):
    df = page(spark, *TABLE, ("긴 문장이 표 아래에 있습니다 그렇습니다", 100, 400, 500, 20))
    found = told(P.page_layout(df), "ord", "kind", "grid", "grid_row", "grid_column")
    assert [f[0] for f in found] == list(range(7)) and [f[1] for f in found] == ["table_cell"] * 6 + ["paragraph"] and found[3][2:] == (0, 1, 1)


def test_columns_are_read_left_first(spark):
    line = lambda i, side: (f"{side}{i}", {"l": 50, "r": 530, "b": 100}[side], 30 * i, {"l": 380, "r": 380, "b": 800}[side], 20)
    full = [line(0, "b"), *[line(i, "lr"[i % 2]) for i in range(1, 13)], line(13, "b"), line(14, "l"), line(15, "r")]
    got = told(P.column_first(page(spark, *full)), "ord", "place")
    order = [o for o, _ in sorted(got, key=lambda x: x[1])]
    assert order == [0, *[i for i in range(1, 13) if i % 2 == 0], *[i for i in range(1, 13) if i % 2], 13, 14, 15]
    few = [line(0, "b"), *[line(i, "lr"[i % 2]) for i in range(1, 9)], line(9, "b")]
    assert all(o == p for o, p in told(P.column_first(page(spark, *few)), "ord", "place"))


def test_regions(spark):
    df = page(spark, ("• 한 줄이 길게 이어지고", 100, 100, 400, 20), ("다음 줄로 넘어간다", 100, 124, 380, 20), ("한 줄이 길게 이어지고", 102, 101, 398, 20), ("표", 700, 300, 50, 20), ("칸", 800, 300, 50, 20), ("표 아래", 700, 324, 50, 20), ("값 {10}", 100, 500, 200, 20), ("값 {20}", 100, 500, 200, 20))
    assert [r for _, r in told(P.regions(df), "ord", "region")] == [1, 1, 0, 2, 3, 4, 5, 6]


def test_crops_claim_their_block_and_what_they_cover(spark):
    df = page(spark, ("a", 0, 0, 100, 20), ("b", 0, 100, 100, 20), ("c", 5, 2, 90, 18), ("d", 0, 200, 100, 20), ("e", 0, 300, 100, 20)).withColumn("block", F.element_at(F.array(*map(F.lit, [1, 2, 3, 1, 4])), F.col("ord") + 1))
    score = F.when(F.col("ord") == 0, 10).when(F.col("ord") == 1, 30).when(F.col("ord") == 2, 5)
    assert told(P.related_crops(df, score), "ord", "crop") == [(0, 1), (1, 0), (2, 1), (3, 1)]
    assert told(P.related_crops(df, score, most=1), "ord", "crop") == [(1, 0)]


def test_empty_pages(spark):
    none = page(spark, ("a", 0, 0, 1, 1)).filter("false")
    for found in (P.page_layout(none), P.column_first(none), P.regions(none), P.rows_by_centre(none)):
        assert found.count() == 0


def test_closure_equals_brute_force(spark, sf):
    edges = [(r.l_orderkey, -r.l_partkey - 1) for r in table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().collect()]
    low = {}

    def top(n):
        while low.setdefault(n, n) != n:
            low[n] = low[low[n]]
            n = low[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        low[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in plans.u3_group_closure(spark, sf).collect()}
    assert got == {n: top(n) for n in list(low)}
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a long, b long")
    assert {r.node: r.component for r in A.closure(loop, stored).collect()} == {1: 1, 2: 1, 3: 3}


def test_readings_move_without_what_is_told_of_them(spark, sf):
    """Before, marks and values of every reading were told by regex and both readings numbered their page anew."""
    plan = pages.w16_regions(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("Window") == 1 and "Union" not in plan


def test_readings_of_unlike_texts(spark):
    same, box = lambda a, b: [r for _, r in told(P.regions(page(spark, a, b)), "ord", "region")], (100, 100, 200, 20)
    assert same(("• a  b", *box), ("a b", *box)) == [1, 0] and same(("fee 10", *box), ("Fee: 10", 101, 100, 200, 20)) == [0, 1] and same(("fee 10", *box), ("fee 20", *box)) == [1, 2]
    assert same((None, *box), (None, *box)) == [1, 0] and same(("a", 100, 100, 0, 20), ("a", 100, 100, 0, 20)) == [1, 0]


def test_closure_draws_fewer_edges_each_round(spark):
    """Before, every round moved all edges both ways; a long chain is followed to its end in one."""
    written = []
    keep = lambda df: written.append(df := stored(df)) or df
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (None, 7), (9, None)], "a long, b long")
    got = {r.node: r.component for r in A.closure(chain, keep).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} and written[-1].isEmpty() and len(written) < 10
