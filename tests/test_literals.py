from pyspark.sql import functions as F

from lineproof.functions import literals as V


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first().x


def test_amounts_and_phones(spark):
    assert [int(x) for x in one(spark, V.amounts, "지원금 3만 원, 1,200원 그리고 3만원")] == [30000, 1200]
    assert one(spark, V.phones, "문의 02-1234-5678, +82-2-1234-5678") == {"0212345678": "02-1234-5678"}


def test_times_dates_romanisation(spark):
    assert sorted(one(spark, V.clock_minutes, "14:30, 오후 2시 30분, 9:05 am")) == [545, 870]
    assert [tuple(d) for d in one(spark, V.calendar_dates, "2025.03.04 그리고 3월 4일, 5월 6일")] == [(2025, 3, 4), (None, 5, 6)]
    assert one(spark, V.romanized, "한글 A") == "hangeul A"
    assert one(spark, V.threshold_cell, "60 이상") == "at least 60"


def test_missing_values(spark):
    df = spark.createDataFrame([("지원금 500원 02-111-2222", "KRW 500")], "s string, e string")
    assert df.select(V.missing_values(F.col("s"), F.col("e")).alias("x")).first().x == ["phone:021112222"]
