"""Tables that grow with the notices are not held whole by the driver."""

import re

import pytest
from pyspark.sql import functions as F

from lineproof import registry
from lineproof.operators import joins
from lineproof.operators import responses as R
from lineproof.sources.scratch import stored


@pytest.mark.parametrize("name", ["f33c_required_documents", "c4_applied_repairs", "c5_applied_interpretation", "c4_retried_repairs"])
def test_growing_tables_are_not_broadcast(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin \[[^\]]*notice_id", plan)


@pytest.mark.parametrize("name", ["p7_constraints", "u5_retry_sets"])
def test_tasks_are_dealt_by_rows(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Broadcast" not in plan


def test_more_rows_make_more_tasks(spark):
    rows = spark.range(400)
    dealt = joins.dealt(rows, 400, "id", most=10)
    assert dealt.rdd.getNumPartitions() == 40 and dealt.count() == 400


def test_units_of_requests_are_dealt_by_rows(spark, sf):
    assert "REPARTITION_BY_NUM" in registry.queries()["s16_block_requests"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_equal_text_are_told_once(spark, sf):
    """Before, chunks and verdicts met their blocks by notice, and Spark built these tables on the driver."""
    plan = registry.queries()["c2_translated_blocks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and not re.search(r"Join \[[^\]]*notice_id", plan)


def test_reviewed_fields_meet_no_table_by_notice(spark, sf):
    plan = registry.queries()["c6_reviewed_fields"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and not re.search(r"Join \[[^\]]*notice_id", plan) and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("scratch", [None, stored])
def test_reviews_at_their_edges(spark, scratch):
    """Null texts and quotes, fields without a verdict, verdicts without a field, quotes that fields share."""
    quote = '신청 "Two Words"'
    fields = [(1, 0, "actions", "", quote, "Apply words"), (1, 1, "actions", "", quote, "two"), (2, 0, "actions", "", quote, "Two words"), (3, 0, "actions", "", None, "x"), (3, 1, "actions", "", "", "y"), (3, 2, "actions", "", "신청 가능", None)]
    given = [(n, i, "supported") for n, i in ((1, 0), (1, 1), (2, 0), (3, 0), (3, 2), (4, 0))] + [(2, 0, "supported")]
    rows = spark.createDataFrame(fields, "notice_id long, field_no int, field string, label string, evidence string, text string").withColumn("more", F.lit("m"))
    told = R.reviewed(rows, spark.createDataFrame(given, "notice_id long, field_no int, status string"), scratch).collect()
    assert {(r.notice_id, r.field_no): r.state for r in told} == {(1, 0): "lost phrase", (1, 1): "lost phrase", (2, 0): "insufficient", (3, 0): "kept", (3, 1): "insufficient", (3, 2): "kept"}
    assert len(told) == 6 and {r.more for r in told} == {"m"}


def test_interpretations_move_texts_without_joins(spark):
    """Before, texts of units met their items by three joins ahead of the first table; a chain of items falls with one unit."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    units = spark.createDataFrame([(1, i, 1, t) for i, t in enumerate(["지원금 300원", "행사", "강연", "서류", "장소"])] + [(2, 0, 1, "행사"), (2, 1, 2, None)], "notice_id long, unit int, page int, text string")
    items = [(1, 0, "A grant and event", [0, 1]), (1, 1, "Event, lecture", [1, 2]), (1, 2, "Documents", [3]), (1, 3, "No place", [9]), (1, 4, "None", []), (1, 5, "Twice", [4, 4]), (2, 0, "Event", [0]), (2, 1, "Two pages", [0, 1]), (2, 2, "Unknown", None)]
    found, rest = R.applied_interpretation(units, spark.createDataFrame(items, "notice_id long, item int, text string, unit_ids array<int>"), kept)
    assert "Join" not in plans[0] and "Repartition" in plans[0]
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (2, 0)]
    told = {(r.notice_id, r.unit): r.issue for r in rest.collect()}
    assert set(told) == {(1, 0), (1, 1), (1, 2), (1, 4), (2, 1)} and told[1, 4] == told[2, 1] == "no item" and "missing value: amount:300" in told[1, 0]
