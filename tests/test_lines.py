"""Runs of characters against plain slices, and in time that grows as the text does."""

import time

from pyspark.sql import functions as F

from lineproof.operators import lines as L


def test_runs_of_characters(spark):
    texts = ["abcabcab", "ab", "", None, "가나\n다라마", "x😀y😀y\U0001f600z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", L.grams_of(F.col("t"), 3).alias("g")).collect()
    for k, g in rows:
        t = texts[k] or ""
        want = {t[i : i + 3] for i in range(len(t) - 2)}
        assert want <= set(g) and len(g) == len(set(g))
        if t.isascii():
            assert g == list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2)))


def test_runs_of_a_long_text_take_no_square(spark):
    """Half a million characters: places sought from the start of the text took minutes."""
    long = spark.range(1).select(F.repeat(F.lit("가나다라마바사아자차"), 50_000).alias("t"))
    start = time.time()
    assert long.select(F.size(L.grams_of(F.col("t"), 6)).alias("n")).first().n == 10
    assert time.time() - start < 30
