"""Aggregates and a table function for SQL: register(spark), then call them by name.

first_wins(collect_list(struct(place, value)))  the values in order of place, each once, first place wins
union_box(collect_list(struct(x, y, w, h)))     the box around all; null for no box or where one lacks a side
greedy_batches(TABLE(...) PARTITION BY (key) ORDER BY (pos), most_rows, most_size)
    over (key, pos, size): (key, pos, batch); a row that would pass a cap opens the next batch

The first two are SQL functions that Catalyst inlines; both take a group's list, so a group must be bounded (a notice).
The last reads a sorted partition row by row with a carry of three numbers; null sizes count as 0.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

BOX = "STRUCT<x: BIGINT, y: BIGINT, w: BIGINT, h: BIGINT>"
FIRST_WINS = """CREATE OR REPLACE TEMPORARY FUNCTION first_wins(rows ARRAY<STRUCT<place: BIGINT, value: STRING>>) RETURNS ARRAY<STRING>
    RETURN array_distinct(transform(array_sort(rows), r -> r.value))"""
UNION_BOX = f"""CREATE OR REPLACE TEMPORARY FUNCTION union_box(boxes ARRAY<{BOX}>) RETURNS {BOX}
    RETURN CASE WHEN size(boxes) > 0 AND forall(boxes, b -> b.x IS NOT NULL AND b.y IS NOT NULL AND b.w IS NOT NULL AND b.h IS NOT NULL) THEN named_struct(
        'x', array_min(transform(boxes, b -> b.x)), 'y', array_min(transform(boxes, b -> b.y)),
        'w', array_max(transform(boxes, b -> b.x + b.w)) - array_min(transform(boxes, b -> b.x)),
        'h', array_max(transform(boxes, b -> b.y + b.h)) - array_min(transform(boxes, b -> b.y))) END"""


class GreedyBatches:
    def __init__(self):
        self.batch = self.n = self.held = 0

    def eval(self, row: Row, most_rows: int, most_size: int):
        size = row["size"] or 0
        if self.n and (self.n >= most_rows or self.held + size > most_size):
            self.batch, self.n, self.held = self.batch + 1, 0, 0
        self.n, self.held = self.n + 1, self.held + size
        yield row["key"], row["pos"], self.batch


def register(spark: SparkSession) -> None:
    """Make the three callable from SQL in this session; a second call replaces them."""
    spark.sql(FIRST_WINS)
    spark.sql(UNION_BOX)
    spark.udtf.register("greedy_batches", udtf(GreedyBatches, returnType="key: bigint, pos: bigint, batch: int"))
