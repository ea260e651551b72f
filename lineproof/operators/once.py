"""Verdicts on texts that notices repeat."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineproof.operators.joins import sized


def judged_once(rows: DataFrame, names: list[str], verdict: Column, into: str = "found", scratch=None) -> DataFrame:
    """rows with the verdict on their fields; rows of equal fields share one verdict, as notices repeat printed forms.

    The distinct rows are dealt anew, so a dear verdict also runs on all cores where few files hold the rows. scratch
    stores the verdicts first: each is reached once however often rows are read, and their number tells how they meet.
    """
    # The count ties the verdict to the finished groups: a filter on a verdict of keys alone would move below them, to every row.
    told = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows")).select(*[F.col(n).alias(f"asked_{n}") for n in names], F.when(F.col("n_rows") > 0, verdict).alias(into))
    if scratch:
        told = scratch(told)
        told = sized(told, told.count())
    return rows.join(told, reduce(and_, (F.col(n).eqNullSafe(F.col(f"asked_{n}")) for n in names))).select(*rows.columns, into)
