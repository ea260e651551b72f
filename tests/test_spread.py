"""Dear rules run on all cores, and marks that save a search lose no day."""

import re

import pytest
from pyspark.sql import functions as F

from lineproof import registry
from lineproof.functions import literals as V


@pytest.mark.parametrize("name", ["c12_literal_index", "f14_literal_counts", "f18_missing_values", "c13_pair_verdicts", "f21_pair_issues", "j25_score_claims_by_label"])
def test_dear_rules_are_dealt(spark, sf, name):
    """sf0.001 holds its orders in one row group; before, one task ran the rule."""
    assert "REPARTITION_BY_NUM" in registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_days_behind_the_mark(spark):
    texts = {
        "신청 마감: 2026.05.04 03:30": (["2026-05-04"], False), "12026. 3.155": (["2026-03-15", "03-15"], True), "기간 3.1 ~ 4.2": (["03-01", "04-02"], True), "(3.1)": ([], True),
        "문의: 02-1234-5678, c12@example.org": ([], False), "due 10/3": (["10-03"], True), "2026. 3.15.7": (["2026-03-15"], True),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", F.transform(V.calendar_dates(F.col("t")), V.shown_day).alias("d"), F.col("t").rlike(V.DAY_MARK).alias("m")).collect()
    for t, d, m in got:
        days, mark = texts[t]
        assert m == mark, t
        assert [x for x in d if x[:5] != "2026-" or x in days] == d and set(days) >= {x for x in d if x.startswith("2026")}, (t, d)
        if re.search(r"기간|due", t):
            assert d == days


def test_each_text_of_a_score_claim_is_searched_once(spark):
    """Three searches before; texts without a notice meet no others."""
    from lineproof.operators import claims as A

    texts = [(1, "TOEIC 700점, TEPS 80점", "TOEIC 700, IELTS 7"), (1, "FLEX", "FLEX 9"), (2, "TOEIC 600", "TOEIC 700"), (None, "TEPS 9", "TEPS 9")]
    rows = A.score_claims(spark.createDataFrame(texts, "notice_id long, source string, english string"))
    assert {tuple(r) for r in rows.collect()} == {
        (1, "teps", "80", "missing or changed"), (1, "ielts", "7", "unsupported exam"), (2, "toeic", "600", "missing or changed"),
        (None, "teps", "9", "missing or changed"), (None, "teps", "9", "unsupported exam"),
    }
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate explode") == 3


def test_no_sides_of_boxes_move_for_placements(spark, sf):
    plan = registry.queries()["j20_placements"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "_extract_" not in plan


def test_facts_are_folded_without_joins(spark, sf):
    """Before, seven branches numbered the units anew and met by joins."""
    plan = registry.queries()["a13_folded_facts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and plan.count("Relation") == 1
