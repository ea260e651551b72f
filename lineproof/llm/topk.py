"""Exact top-k inner product over integer vectors by pivot-table elimination.

Inner product search becomes distance search by the usual lift: a candidate x gets one more component
sqrt(M^2 - |x|^2), M the largest norm, and a query gets 0. Many pivots are chosen once, farthest first, from a bounded
sample. The table of each candidate's distances to all pivots is precomputed once and stored with its block. The largest
|d(q, p) - d(x, p)| over the pivots bounds d(q, x) from below and so the score from above. A query takes a block's
candidates in falling order of that bound and stops when the bound is under its k-th score; scores are integers.

A query first meets the block of its own hash. Its k-th score there goes with it to the other blocks, so that a block
whose bounds are all under it is left at once and any other starts from a good score. Blocks stand still; queries alone
are copied, once a block. Nothing is broadcast or collected.

How much is eliminated is the data's: on vectors near a few centres few candidates are evaluated, on evenly spread ones
in many dimensions almost all (evaluated() tells; the README has figures).

Defined cases: rows without vec_id, null or empty vectors and vectors with null or non-finite components take no
part; vectors of different length never meet; rows that repeat a vec_id are candidates each but for the query's own
id; fewer than k candidates give all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineproof.llm import blocks as B
from lineproof.llm.shared import stored

K = 10
EVERY = 100
SCALE = 1024
PIVOTS = 64
SAMPLE_ROWS = 4096
#: Candidates are evaluated in runs, the first of so many, each following one twice as long up to a bound.
STEP, LONGEST = 64, 2048
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("evaluated", pa.int64())])


def scaled(v: np.ndarray) -> np.ndarray:
    """floor(1024 x) as doubles, which hold it exactly."""
    return np.floor(SCALE * v)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))])


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows, from the one farthest from the mean."""
    gap = ((x - x.mean(0)) ** 2).sum(1)
    chosen = [int(gap.argmax())]
    gap = np.full(len(x), np.inf)
    for _ in range(min(n, len(x)) - 1):
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(gap.argmax()))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots])


def products(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Integer inner products: doubles where they are exact, Python integers beyond."""
    if not x.size or np.abs(x).max() * np.abs(one).max() * x.shape[1] < 2**53:
        return x @ one
    exact = [int(c) for c in one.tolist()]
    return np.array([sum(int(a) * b for a, b in zip(row, exact, strict=True)) for row in x.tolist()], dtype=object)


def _build(top: float):
    def run(model: bytes, ids: np.ndarray, v: np.ndarray) -> dict[str, bytes]:
        x = scaled(v)
        pivots = np.frombuffer(model).reshape(-1, x.shape[1] + 1)
        return {"vectors": x.tobytes(), "table": distances(lifted(x, top), pivots).tobytes()}

    return run


def _search(k: int, top: float, step: int):
    def run(block: dict, queries: pa.Table) -> pa.Table:
        q_ids, q = B.matrix(queries)
        order = np.argsort(queries.column("vec_id").to_numpy(), kind="stable")
        floor = queries.column("floor").to_numpy(zero_copy_only=False)[order] if "floor" in queries.schema.names else np.full(len(q_ids), -np.inf)
        floor = np.where(np.isnan(floor), -np.inf, floor)
        ids, dim = np.frombuffer(block["ids"], np.int64), q.shape[1]
        x, q = np.frombuffer(block["vectors"]).reshape(-1, dim), scaled(q)
        table = np.frombuffer(block["table"]).reshape(-1, len(ids))
        to_pivots = distances(np.column_stack([q, np.zeros(len(q))]), np.frombuffer(block["model"]).reshape(-1, dim + 1)).T
        out: dict[str, list] = {f.name: [] for f in FOUND}
        for qid, one, near, least in zip(q_ids, q, to_pivots, floor, strict=True):
            low = np.abs(table - near[:, None]).max(0)
            size = one @ one
            limit = (size + top - low * low) / 2 + 1e-9 * (size + top) + 1e-6
            # Stored bounds hold up to rounding, so a candidate equal to the k-th score is still taken.
            own = ids == qid
            limit[own] = -np.inf
            n, at, got_id, got_s = len(ids) - int(own.sum()), 0, np.zeros(0, np.int64), np.zeros(0)
            first = np.argsort(-limit, kind="stable")
            while at < n:
                some = first[at : min(n, at + min(LONGEST, max(step, at)))]
                if limit[some[0]] < max(least, got_s[-1] if len(got_s) == k else -np.inf):
                    break
                all_id, all_s = np.concatenate([got_id, ids[some]]), np.concatenate([got_s, products(x[some], one)])
                keep = B.best(all_id, all_s, k)
                got_id, got_s, at = all_id[keep], all_s[keep], at + len(some)
            got = [(int(i), max(-(2**63), min(2**63 - 1, int(score)))) for i, score in zip(got_id, got_s, strict=True)]
            counts = [at] + [0] * len(got)
            for name, values in zip(out, ([int(qid)] * len(got), [i for i, _ in got], [score for _, score in got], counts[: len(got)]), strict=True):
                out[name] += values
        return pa.table(out, schema=FOUND)

    return run


SCHEMA = "query_id long, vec_id long, score long, evaluated long"


def _found(vectors: DataFrame, k: int, every: int, pivots: int, row_block: int) -> DataFrame:
    """Best of each (query, block); the first row of each tells the number of candidates evaluated there."""
    rows = stored(B.usable(vectors), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double"))
    top = (rows.agg(F.max(norm)).first()[0] or 0.0) * (1 + 1e-9)
    models = B.fitted(rows, SAMPLE_ROWS, lambda v: farthest(lifted(scaled(v), top), pivots).tobytes())
    index = B.indexed(rows, models, _build(top), ["vectors", "table"], row_block)
    n = max(1, -(-rows.count() // row_block))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(n))
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    near = stored(B.searched(index, queries, _search(k, top, STEP), SCHEMA, F.array(home)), "vectors-home")
    if n == 1:
        return near
    # With k found at home, the least of them bounds the k-th score from below.
    told = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
    asked = queries.join(told, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda b: b != home)
    return near.unionByName(B.searched(index, asked, _search(k, top, STEP), SCHEMA, others))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, row_block: int = B.ROW_BLOCK) -> DataFrame:
    """The k highest integer inner products of each query row against every other row."""
    return B.merged(_found(vectors, k, every, pivots, row_block), k)


def evaluated(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, row_block: int = B.ROW_BLOCK) -> float:
    """The share of all (query, candidate) pairs whose product was computed."""
    n = B.usable(vectors).agg(F.count(F.lit(1)), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    return _found(vectors, k, every, pivots, row_block).agg(F.sum("evaluated")).first()[0] / (n[1] * (n[0] - 1))
