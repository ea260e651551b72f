"""How often an expression names what is dear to compute."""

import pandas as pd
from pyspark.sql import functions as F

from lineproof.functions import english as E
from lineproof.functions import literals as V
from lineproof.functions.text import bound
from lineproof.plans import cases

def times(column, what):
    return str(column).count(what)


def test_a_bound_value_stands_once(spark):
    twice = bound(lambda v: F.concat(v, v), F.regexp_replace("s", "a", "b"))
    assert times(twice, "regexp_replace") == 1
    df = spark.createDataFrame([("aa",), (None,)], "s string")
    assert [r.x for r in df.select(twice.alias("x")).collect()] == ["bbbb", None]


def test_installments_are_found_once(spark):
    assert times(E.installment_scope(F.col("s"), F.col("e")), E.INSTALLMENT_CONDITION) <= 2


def test_equal_rows_are_judged_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def verdict(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.fillna("none")

    rows = spark.createDataFrame([(i, "ab"[i % 2] if i < 90 else None) for i in range(100)], "notice_id long, s string")
    got = cases.judged_once(rows, ["s"], F.pandas_udf(verdict, "string")("s")).collect()
    assert len(got) == 100 and all(r.found == (r.s or "none") for r in got) and seen.value == 3


def test_runs_of_days_are_found_once(spark):
    assert times(V.calendar_dates(F.col("s")), V.SURE_DAY) <= 8


def test_a_filter_on_verdicts_leaves_equal_rows_judged_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def verdict(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts

    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "notice_id long, s string")
    assert len(cases.judged_once(rows, ["s"], F.pandas_udf(verdict, "string")("s")).filter("found = 'a'").collect()) == 50
    assert seen.value <= 4  # a distinct text by the filter, then by the column
