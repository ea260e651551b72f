"""What the training-data operators share: scratch tables, input defaults and batch helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineproof.sources.scratch import path as scratch_path
from lineproof.sources.scratch import stored

__all__ = ["scratch_path", "stored"]

#: ASCII white space as the contracts define it, for SQL trims.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def groups_for(df: DataFrame, rows_each: int) -> int:
    """So many hash groups that each has about rows_each rows."""
    return max(1, -(-df.count() // rows_each))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of a column stay under most_bytes, one row at least; freed memory goes back between them."""
    for b in batches:
        start, held = 0, 0
        for i, v in enumerate(b.column(column)):
            n = v.as_buffer().size if v.is_valid else 0
            if held and held + n > most_bytes:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)
        pa.default_memory_pool().release_unused()


#: Bits of a filter of ids: 16 an id, within these bounds; the largest filter is 16 MB.
LEAST_BITS, MOST_BITS, PAGE_BITS = 1 << 20, 1 << 27, 1 << 15


def marked(rows: DataFrame, column: str, ids: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean flag: false where the long column is surely not among ids (a one-column table without nulls).

    A one-hash filter of at most MOST_BITS bits is broadcast, so its size is bounded whatever ids holds; with more ids
    more rows are flagged without need, and who needs to know joins those. Rows move nowhere.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))

    def at(col):
        return F.pmod(F.xxhash64(col.cast("long")), F.lit(bits))

    places = ids.select(at(F.col(ids.columns[0])).alias("at"))
    pages = places.groupBy(F.floor(F.col("at") / PAGE_BITS).alias("lineproof_page")).agg(F.bitmap_construct_agg(F.col("at") % PAGE_BITS).alias("lineproof_bits"))
    told = rows.withColumn("lineproof_at", at(F.col(column))).withColumn("lineproof_page_of", F.floor(F.col("lineproof_at") / PAGE_BITS))
    told = told.join(F.broadcast(pages), F.col("lineproof_page_of") == F.col("lineproof_page"), "left")
    place = (F.col("lineproof_at") % PAGE_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("lineproof_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce((F.floor(byte / F.pow(F.lit(2), place % 8)) % 2) == 1, F.lit(False))
    return told.select(*rows.columns, (bit & F.col(column).isNotNull()).alias(flag))
