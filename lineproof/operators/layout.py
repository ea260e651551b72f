"""Positioned units: box rules, overlap joins by grid cell, label/value association, rows, segments and reading order.

Units are rows with notice_id, page_number, ord and an integer box x, y, w, h on a grid of 1000. Overlap joins deal
boxes to grid cells and compare within a cell only, so their work follows the boxes that lie near each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["notice_id", "page_number"]
CELL = 128
#: Words after a number that make a cell a literal value.
VALUE_CELL = r"^\s*[0-9][0-9,.]*\s*(이상|이하|초과|미만|원|명|점|%)?\s*$"


def valid_box(width: int, height: int) -> Column:
    x, y, w, h = (F.col(c) for c in "xywh")
    return F.coalesce((x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height), F.lit(False))


def clamped_box(polygon: Column, width: int, height: int) -> Column:
    """The polygon's bounding box cut to the page; null where nothing of it lies on the page."""
    low = lambda axis: F.greatest(F.array_min(F.transform(polygon, lambda p: p[axis])), F.lit(0))
    high = lambda axis, most: F.least(F.array_max(F.transform(polygon, lambda p: p[axis])), F.lit(most))
    left, top, right, bottom = low("x"), low("y"), high("x", width), high("y", height)
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h")))


def column_side(page_width: int = 1000) -> Column:
    """Wholly left or right of the middle band of a page, else a bridge."""
    left = (F.col("x") + F.col("w")) * 100 <= 49 * page_width
    return F.when(left, "left").when(F.col("x") * 100 >= 51 * page_width, "right").otherwise("bridge")


def overlap(a: str = "a", b: str = "b") -> Column:
    """Area that two aliased boxes share."""
    c = lambda side, name: F.col(f"{side}.{name}")
    wide = F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x"))
    tall = F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y"))
    return F.greatest(wide, F.lit(0)) * F.greatest(tall, F.lit(0))


def area(side: str) -> Column:
    return F.col(f"{side}.w") * F.col(f"{side}.h")


def dealt_to_cells(units: DataFrame, cell: int = CELL) -> DataFrame:
    span = lambda at, size: F.explode(F.sequence(F.floor(at / cell), F.floor((at + size - 1) / cell)))
    return units.withColumn("cx", span(F.col("x"), F.col("w"))).withColumn("cy", span(F.col("y"), F.col("h")))


def overlapping_pairs(left: DataFrame, right: DataFrame, test: Column, cell: int = CELL) -> DataFrame:
    """Pairs of a page with a common area that pass a test on the aliases a and b; each pair comes once, from the cell of
    the common area's first corner, so no distinct is needed."""
    a, b = dealt_to_cells(left, cell).alias("a"), dealt_to_cells(right, cell).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*PAGE, "cx", "cy"]]
    corner = (F.col("a.cx") == F.floor(F.greatest("a.x", "b.x") / cell)) & (F.col("a.cy") == F.floor(F.greatest("a.y", "b.y") / cell))
    return a.join(b, same).filter(corner & (overlap() > 0) & test)


def same_cell() -> Column:
    """Equal text and an intersection of at least 0.6 of the union."""
    return (F.col("a.text_key") == F.col("b.text_key")) & (overlap() * 10 >= (area("a") + area("b") - overlap()) * 6)


def same_area() -> Column:
    """Widths within 0.8 of each other and 0.7 of the larger box in common."""
    narrow, broad = F.least("a.w", "b.w"), F.greatest("a.w", "b.w")
    return (narrow * 10 >= broad * 8) & (overlap() * 10 >= F.greatest(area("a"), area("b")) * 7)


def same_region() -> Column:
    """Equal text and 0.35 of the smaller box in common."""
    return (F.col("a.text_key") == F.col("b.text_key")) & (overlap() * 100 >= F.least(area("a"), area("b")) * 35)


def merged_readings(first: DataFrame, later: DataFrame) -> DataFrame:
    """First-pass units with the number of later readings of the same area, then later units that match none.

    A later reading goes to the first unit, by place, that it matches; no primary text is replaced.
    """
    pairs = overlapping_pairs(first, later, same_area())
    home = pairs.groupBy(*[F.col(f"b.{c}").alias(c) for c in [*PAGE, "ord"]]).agg(F.min("a.ord").alias("home"))
    counts = home.groupBy(*PAGE, F.col("home").alias("ord")).agg(F.count(F.lit(1)).alias("n_readings"))
    kept = first.join(counts, [*PAGE, "ord"], "left").select(*PAGE, "ord", F.lit(1).alias("pass"), F.coalesce("n_readings", F.lit(0)).alias("n_readings"))
    alone = later.join(home, [*PAGE, "ord"], "left_anti").select(*PAGE, "ord", F.lit(2).alias("pass"), F.lit(0).cast("long").alias("n_readings"))
    return kept.unionByName(alone)


def clearer_readings(first: DataFrame, later: DataFrame) -> DataFrame:
    """For each first-pass unit the pass and confidence of its clearest reading of the same text and region; ties to the first."""
    pairs = overlapping_pairs(first, later, same_region())
    best = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in [*PAGE, "ord"]]).agg(F.max("b.conf").alias("later_conf"))
    clearer = F.coalesce(F.col("later_conf") > F.col("conf"), F.lit(False))
    return first.join(best, [*PAGE, "ord"], "left").select(*PAGE, "ord", F.when(clearer, 2).otherwise(1).alias("pass"), F.when(clearer, F.col("later_conf")).otherwise(F.col("conf")).alias("conf"))


def label_values(cells: DataFrame, dx: int = 25, dy: int = 60) -> DataFrame:
    """(notice_id, label, label_col, value, value_col) where a value has one header above it and that header one value.

    Centres are held doubled, as integers. Headers are dealt to the vertical strips that their reach meets.
    """
    placed = cells.withColumn("mx", 2 * F.col("x") + F.col("w")).withColumn("my", 2 * F.col("y") + F.col("h"))
    strip = lambda c: F.floor(c / (4 * dx))
    labels = placed.filter("role = 'label'").select("notice_id", F.col("txt").alias("label"), F.col("col").alias("label_col"), F.col("mx").alias("lx"), F.col("my").alias("ly"))
    labels = labels.withColumn("strip", F.explode(F.sequence(strip(F.col("lx") - 2 * dx), strip(F.col("lx") + 2 * dx))))
    values = placed.filter("role = 'value'").select("notice_id", F.col("txt").alias("value"), F.col("col").alias("value_col"), "mx", "my").withColumn("strip", strip(F.col("mx")))
    rise = F.col("my") - F.col("ly")
    near = labels.join(values, ["notice_id", "strip"]).filter((F.abs(F.col("mx") - F.col("lx")) <= 2 * dx) & (rise > 0) & (rise <= 2 * dy))
    n = lambda key: F.count(F.lit(1)).over(Window.partitionBy("notice_id", key))
    counted = near.withColumn("n_values", n("label_col")).withColumn("n_labels", n("value_col"))
    return counted.filter("n_values = 1 and n_labels = 1").select("notice_id", "label", "label_col", "value", "value_col")


def ambiguous_labels(pairs: DataFrame) -> DataFrame:
    """Labels that stand more than once in a notice, with whether their values differ."""
    found = pairs.groupBy("notice_id", "label").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("value").alias("n_values"))
    return found.filter("n_pairs > 1").withColumn("ambiguous", F.col("n_values") > 1)


def nearest_columns(cells: DataFrame) -> DataFrame:
    """Each value's nearest header column, ties to the smaller; one header row a notice is held as an array."""
    anchors = cells.filter("role = 'label'").groupBy("notice_id").agg(F.collect_list(F.struct((2 * F.col("x") + F.col("w")).alias("at"), F.col("col").alias("col"))).alias("anchors"))
    middle = 2 * F.col("x") + F.col("w")
    nearest = F.array_min(F.transform("anchors", lambda a: F.struct(F.abs(a["at"] - middle).alias("d"), a["col"].alias("col"))))
    return cells.filter("role = 'value'").join(anchors, "notice_id").select("notice_id", "col", nearest["col"].alias("column"))


def union_boxes(units: DataFrame, *keys: str) -> DataFrame:
    """The box around each group; null where a member has none."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    whole = F.count("x") == F.count(F.lit(1))
    sides = {"x": F.min("x"), "y": F.min("y"), "w": right - F.min("x"), "h": bottom - F.min("y")}
    return units.groupBy(*keys).agg(*[F.when(whole, v).alias(k) for k, v in sides.items()])


def rows_by_gap(units: DataFrame, gap: int) -> DataFrame:
    """Row numbers from 1 down the page: a row starts where the top lies more than gap below the one before."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "ord")
    starts = F.coalesce((F.col("y") - F.lag("y").over(w) > gap).cast("int"), F.lit(1))
    return units.withColumn("starts", starts).withColumn("row", F.sum("starts").over(w)).drop("starts")


def segments_by_gap(units: DataFrame, gap: int = 150, wide_gap: int = 75, wide: int = 80, row: str = "row") -> DataFrame:
    """Segment numbers from 1 along a row: one starts beyond a gap, or beyond a smaller gap beside a wide cell."""
    w = Window.partitionBy(*PAGE, row).orderBy("x", "ord")
    space = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    beside = (F.col("w") >= wide) | (F.lag("w").over(w) >= wide)
    starts = F.coalesce(((space > gap) | ((space > wide_gap) & beside)).cast("int"), F.lit(1))
    return units.withColumn("starts", starts).withColumn("segment", F.sum("starts").over(w)).drop("starts")


def column_cuts(units: DataFrame, least_gap: int = 100, support: int = 2, row: str = "row") -> DataFrame:
    """The median middle of a page's wide gaps between row neighbours, where at least support gaps are wide."""
    w = Window.partitionBy(*PAGE, row).orderBy("x", "ord")
    right, following = F.col("x") + F.col("w"), F.lead("x").over(w)
    gaps = units.withColumn("right", right).withColumn("following", following).filter(F.col("following") - F.col("right") > least_gap)
    found = gaps.groupBy(*PAGE).agg(F.median(F.col("right") + F.col("following")).alias("twice"), F.count(F.lit(1)).alias("n_gaps"))
    return found.filter(F.col("n_gaps") >= support).select(*PAGE, (F.col("twice") / 2).alias("cut"), "n_gaps")


def within_budget(units: DataFrame, per_page: int = 250, per_notice: int = 600) -> DataFrame:
    """The first units of each page up to a cap, then of each notice in page order."""
    page = units.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord"))).filter(F.col("n") <= per_page)
    whole = Window.partitionBy("notice_id").orderBy("page_number", "ord")
    return page.withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= per_notice).drop("n")


def crops_within_budget(crops: DataFrame, score: Column, size: Column, most: int, budget: int) -> DataFrame:
    """The best crops of each notice under a size budget; one that does not fit is passed over, ties to the smaller ord."""
    w = Window.partitionBy("notice_id").orderBy(F.desc("score"), "ord")
    best = crops.withColumn("score", score).withColumn("size", size.cast("long")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    listed = best.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ord", "size"))).alias("crops"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, crop: Column) -> Column:
        fits = acc["held"] + crop["size"] <= budget
        held = F.when(fits, acc["held"] + crop["size"]).otherwise(acc["held"])
        return F.struct(held.alias("held"), F.when(fits, F.array_append(acc["taken"], crop["ord"])).otherwise(acc["taken"]).alias("taken"))

    return listed.select("notice_id", F.aggregate("crops", start, step).alias("end")).select("notice_id", F.array_join("end.taken", ",").alias("taken"), F.col("end.held").alias("held"))


def layout_hints(units: DataFrame) -> DataFrame:
    """One text a page: the centres of its units on the grid, zero-padded, in reading order."""
    middle = lambda at, size: F.floor((2 * F.col(at) + F.col(size)) / 2)
    hint = F.format_string("(%03d,%03d)", middle("x", "w"), middle("y", "h"))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "ord", hint.alias("hint"))))
    return units.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda u: u["hint"]), " ").alias("hints"))
