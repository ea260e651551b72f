"""Two-round repairs and routing at their edges; the queries hold them to SQL."""

import pytest

from lineproof.operators import rounds as R
from lineproof.operators import routing as O
from lineproof.sources.scratch import stored

UNIT = "notice_id long, unit int, page int, pos int, text string, cited string"
CLAIM = "notice_id long, claim int, kind string, units array<int>, context array<int>, text string, certain boolean, category string"


def claim(n, units, text, kind="detail", context=()):
    return (1, n, kind, units, list(context), text, True, "other")


@pytest.fixture(scope="module")
def repaired(spark):
    """Repairs of six units of one notice, the last on another page."""

    def run(first, second, blocked=()):
        units = spark.createDataFrame([(1, i, 1 + i // 6, i, f"지원금 {i}00원", "") for i in range(1, 7)], UNIT)
        stop = spark.createDataFrame([(1, b) for b in blocked], "notice_id long, unit int")
        found = R.retried_repairs(units, spark.createDataFrame(first, CLAIM), spark.createDataFrame(second, CLAIM), stop, stored).collect()
        return {r.unit: (r.state, r.round) for r in found}, {r.unit: r.reason for r in found if r.gap}

    return run


def grant(*units):
    return " and ".join(f"KRW {i}00 grant" for i in units)


def test_no_answer_leaves_all_as_gaps(repaired):
    states, reasons = repaired([], [])
    assert set(states.values()) == {("unverified", None)} and set(reasons.values()) == {"not assigned"}


def test_one_fault_takes_a_chain_of_details_along(repaired):
    first = [claim(1, [1, 2], grant(1, 2)), claim(2, [2, 3], grant(2, 3)), claim(3, [3, 4], grant(3, 4)), claim(4, [5], grant(5))]
    second = [claim(i, [i], grant(i)) for i in (1, 2, 3)] + [claim(5, [5], "never asked")]
    states, reasons = repaired(first, second)
    assert [states[i] for i in range(1, 7)] == [("detailed", 2)] * 3 + [("unverified", None), ("detailed", 1), ("unverified", None)]
    assert set(reasons) == {4, 6}


def test_contexts_pages_and_blocked_units(repaired):
    first = [claim(i, [i], grant(i)) for i in (1, 2, 4)]
    second = [claim(1, [3], grant(3, 2), context=[2]), claim(2, [5], grant(5, 4), context=[4]), claim(3, [6], grant(6, 5), context=[5])]
    states, reasons = repaired(first, second, blocked=[4])
    assert states[3] == ("detailed", 2) and states[1] == ("detailed", 1)
    assert reasons[4] == "blocked" and reasons[5] == reasons[6] == "context not offered"


def test_routes_of_titles_captions_and_lone_units(spark):
    unit = "notice_id long, unit int, ord int, page int, block int, section int, height int, text string, english string, translated boolean"
    rows = [(1, 1, 1, 1, 0, 1, 20, "작은 제목", "Small heading", True), (1, 2, 2, 1, 1, 1, 40, "커다란 제목", "Large heading", True), (1, 3, 3, 1, 2, 1, 9, "마루", "Maru", True), (1, 4, 4, 1, None, 1, 9, "행사 안내", "Event", False), (1, 5, 5, 1, 3, 1, 9, "지원금 500원", "Money", False)]
    blocks = spark.createDataFrame([(1, 0, "heading", None), (1, 1, "heading", None), (1, 2, "caption", None), (1, 3, "text", None)], "notice_id long, block int, kind string, english string")
    items = [(1, 0, "heading", "", "Small heading", [1]), (1, 1, "heading", "", "Large heading", [2]), (1, 2, "action", "", "Maru", [3])]
    kind = "notice_id long, item int, kind string, heading string, text string, unit_ids array<int>"
    routed, ends = O.routed_items(spark.createDataFrame(rows, unit), blocks, spark.createDataFrame(items, kind), stored)
    got = {r.fact_id: (r.origin, r.collection, r.place, r.label, r.text) for r in routed.collect()}
    assert got == {
        "F001": ("item", "key_details", 0, "Additional details", "Small heading"), "F002": ("item", "title", 0, "Additional details", "Large heading"),
        "F003": ("fallback", "key_details", 1, "Large heading", "Event"),
    }
    assert {r.unit: (r.ending, r.refs) for r in ends.collect()} == {1: ("item", "key_details:0"), 2: ("item", "title"), 3: ("gap", "translation_view"), 4: ("fallback", "key_details:1"), 5: ("gap", "translation_view")}
    none, ends = O.routed_items(spark.createDataFrame([], unit), blocks.limit(0), spark.createDataFrame([], kind), stored)
    assert none.count() == 0 and ends.count() == 0


def test_folds_of_repairs_into_primaries(spark):
    from lineproof.operators import claims as A

    kind = "notice_id long, item int, field string, rank int, page int, text string, evidence string, fact_ids array<int>, repair boolean, state string, image string"
    rows = [
        (1, 1, "fees", 0, 1, "A fee", "가 나", [1], False, "verified", "a"), (1, 2, "fees", 0, 1, "a  FEE", "가나", [2, 1], False, "verified", "b"), (1, 3, "links", 1, 1, "A fee", "다", [9], True, "needs_review", "a"),
        (1, 4, "links", 1, 2, "A fee", "다", [8], True, "verified", "a"), (1, 5, "links", 1, 2, "A fee", "라", [7], True, "verified", "a"), (1, 6, "fees", 0, 1, "A fee", None, [6], False, "verified", None), (1, 7, "fees", 0, None, "A fee", "가 나", [], False, "verified", "a"),
    ]
    got = {r.item: (r.evidence, r.fact_ids, r.state, r.image, r.n) for r in A.folded_facts(spark.createDataFrame(rows, kind)).collect()}
    assert got == {
        1: ("가 나\n다", [1, 2, 9], "needs_review", None, 3), 4: ("다\n라", [8, 7], "verified", "a", 2), 6: ("", [6], "verified", None, 1), 7: ("가 나", [], "verified", "a", 1),
    }
    assert A.folded_facts(spark.createDataFrame([], kind)).count() == 0


def test_quality_without_metrics(spark):
    from lineproof.operators import claims as A

    names = ("width", "height", "blur", "brightness", "glare", "coverage", "box_x", "box_y", "box_w", "box_h")
    none = spark.createDataFrame([(None,) * len(names)], ", ".join(f"{n} double" for n in names))
    assert A.page_quality(none).select("issues", "readable").first() == ([], True)


def test_vocabulary_finds_inflected_words(spark):
    from pyspark.sql import functions as F

    from lineproof.functions import vocabulary as W

    cases = [("교내", "for the on-campus students", []), ("교내", "within our university", []), ("교내", "for students", ["on-campus scope"]), ("불허하지", "x", []), ("연구 주제에 지원 을 받는", "students who received much public funding", []), (None, "x", []), ("최대", None, [])]
    told = spark.createDataFrame(cases, "s string, e string, want array<string>").select("want", W.unmet(F.col("s"), F.col("e"), W.CONDITIONS).alias("x")).collect()
    assert [r.x for r in told] == [r.want for r in told]


def test_an_open_unit_is_not_told_by_its_twin(spark):
    """Both units print one day; one is not translated, so the block has no reading although its values stand."""
    from lineproof.operators import routing as O

    day, told = "마감 2026.01.10 14:30", "By 2026-01-10 14:30 sharp"
    kinds = "notice_id long, unit int, ord int, page int, block int, section int, height int, text string, english string, translated boolean"
    rows = [(n, u, u, 1, 0, 1, 9, day, told if u == 1 or n == 2 else "A line", u == 1 or n == 2) for n in (1, 2) for u in (1, 2)]
    units = spark.createDataFrame(rows, kinds)
    blocks = spark.createDataFrame([(1, 0, "text", None), (2, 0, "text", None)], "notice_id long, block int, kind string, english string")
    none = units.select("notice_id", "unit").limit(0)
    assert {r.notice_id: r.text for r in O.fallbacks(units, blocks, none, none).collect()} == {1: None, 2: told}
