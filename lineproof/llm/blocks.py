"""Vectors in index blocks: what a search precomputes of a block is stored once with it; queries alone move to the blocks.

Rows are dealt by hash to blocks of about ROW_BLOCK and become one row of binary columns a block: ids, vectors, and
what a search adds (a pivot table, packed codes). What is fitted for all blocks of a dimension (pivots, codebooks) comes
from a bounded sample of rows of least hash, in one task a dimension, and meets each block once, while it is built.
Queries travel in runs of QUERY_BLOCK at most; a task holds one block and one run of queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineproof.llm.shared import stored

QUERY_BLOCK = 8192
ROW_BLOCK = 16_384


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part; v as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0)).filter(fine).withColumn("dim", F.size("v"))


def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, in id order."""
    t = t.select(["vec_id", "v"]).combine_chunks().sort_by("vec_id")
    flat = t.column("v").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return t.column("vec_id").to_numpy(), flat.to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted(rows: DataFrame, sample_rows: int, fit: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(dim, model): fit of a dimension's rows of least hash, at most sample_rows."""
    least = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "v"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([fit(matrix(group)[1])], pa.binary())})

    # One count a dimension tells from which hash on a row cannot be among the least: few more than are taken move.
    counts = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    share = F.element_at(F.create_map(*[x for dim, n in counts.items() for x in (F.lit(dim), F.lit(4.0 * sample_rows / n))]), F.col("dim")) if counts else F.lit(0.0)
    near = rows.filter(F.shiftrightunsigned(F.xxhash64("vec_id"), 24) < share * 2.0**40)
    return stored(near.withColumn("n", least).filter(F.col("n") <= sample_rows).groupBy("dim").applyInArrow(run, "dim int, model binary"), "vector-models")


def indexed(rows: DataFrame, models: DataFrame, build: Callable[[bytes, np.ndarray, np.ndarray], dict[str, bytes]], columns: list[str], row_block: int = ROW_BLOCK) -> DataFrame:
    """(dim, block, ids, model, columns...): one row a block; build gives the binary columns of (model, ids, vectors)."""
    n = max(1, -(-rows.count() // row_block))
    schema = ", ".join(["dim int", "block long", "ids binary", "model binary", *[f"{c} binary" for c in columns]])

    def run(key: tuple, group: pa.Table, model: pa.Table) -> pa.Table:
        names = ["dim", "block", "ids", "model", *columns]
        if not group.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, [pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 2)], strict=True)})
        ids, v = matrix(group)
        told = {"ids": ids.tobytes(), "model": model.column("model")[0].as_py()}
        told |= build(told["model"], ids, v)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), **{c: pa.array([told[c]], pa.binary()) for c in names[2:]}})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    spread = models.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return stored(dealt.groupBy("dim", "block").cogroup(spread.groupBy("dim", "block")).applyInArrow(run, schema), "vector-blocks")


def searched(index: DataFrame, queries: DataFrame, search: Callable[[dict, pa.Table], pa.Table], schema: str, blocks: Column | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """What search finds for each (block, run of queries). queries: (vec_id, v, dim, ...); blocks: those that a query visits, all by default."""
    runs = max(1, -(-queries.count() // query_block))
    n = index.agg(F.max("block")).first()[0]
    every = F.sequence(F.lit(0).cast("long"), F.lit(n or 0).cast("long"))
    asked = queries.withColumn("run", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(runs))).withColumn("block", F.explode(every if blocks is None else blocks))
    held = index.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))

    def run(key: tuple, block: pa.Table, group: pa.Table) -> pa.Table:
        if not block.num_rows or not group.num_rows:
            return empty
        return search({c: block.column(c)[0].as_py() for c in block.schema.names}, group)

    empty = pa.schema([(part.split()[0], {"long": pa.int64(), "double": pa.float64()}[part.split()[1]]) for part in schema.split(", ")]).empty_table()
    keys = ["dim", "block", "run"]
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, schema)
