"""Corpus line deduplication by probing a sharded minimal perfect hash.

Keys are 128-bit hashes of normalised lines (two 64-bit hashes). Every distinct key of the corpus is indexed: keys are
dealt to shards by hash, and each shard becomes one row of arrays: a minimal perfect hash, and by its index a
fingerprint, the number of documents and the largest doc_id that hold the line. Documents send their (hash, fingerprint)
pairs to the shards and probe the arrays there; the count found decides whether a line repeats. Line texts are never
shuffled or joined. Shards are sized by occurrences. One with more (a very common line) is copied so often that its
probes, spread by doc_id, come to about SHARD_ROWS a task.

Defined cases: a null or empty text is one empty line; a row without doc_id keeps all its lines and counts for no
document; rows that share a doc_id count as one document and lose the same lines; an empty table gives no rows; other
columns of the input, whatever their names, are ignored by dropped_lines and kept by dedup_lines, but for kept_text,
n_lines and n_dropped, which give way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from lineproof.llm.mph import MinimalPerfectHash
from lineproof.llm.shared import ASCII_SPACE, ascii_lower, marked, stored

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_ROWS = 65_536
SHARD = "shard long, table binary, fingerprint binary, n_docs binary, keeper binary, occurrences long"
LOST = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(ASCII_SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(key: Column) -> Column:
    """Hash pair of a line's key."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("fp"))


def keys_of(text: Column) -> Column:
    """The different keys of a text's lines that are long enough to count; strings are told apart by a hash set, structs by pairs."""
    return F.array_distinct(F.filter(F.transform(lines_of(text), line_key), lambda k: F.length(k) >= MIN_CHARS))


def _build(key: tuple, group: pa.Table) -> pa.Table:
    fp = group.column("fp").to_numpy().view(np.uint64)
    mph = MinimalPerfectHash.build(np.unique(fp))
    at = mph.index(fp)
    cols = {}
    for name in ("h", "n", "keeper"):
        array = np.zeros(mph.n, np.int64)
        array[at] = group.column(name).to_numpy()
        cols[name] = array
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int64()), "table": pa.array([mph.to_bytes()], pa.binary()),
        "fingerprint": pa.array([cols["h"].tobytes()], pa.binary()), "n_docs": pa.array([np.minimum(cols["n"], 2**31 - 1).astype(np.int32).tobytes()], pa.binary()),
        "keeper": pa.array([cols["keeper"].tobytes()], pa.binary()), "occurrences": pa.array([int(cols["n"].sum())], pa.int64()),
    })


def _probe(min_docs: int):
    """The probes whose line is found in min_docs documents or more and kept by another one."""

    def run(key: tuple, shards: pa.Table, probes: pa.Table) -> pa.Table:
        if not shards.num_rows or not probes.num_rows:
            return LOST.empty_table()
        raw = {c: shards.column(c)[0].as_py() for c in ("table", "fingerprint", "n_docs", "keeper")}
        h, fp, doc = (probes.column(c).to_numpy() for c in ("h", "fp", "doc_id"))
        at = MinimalPerfectHash.from_bytes(raw["table"]).index(fp.view(np.uint64))
        found = at >= 0
        at = np.where(found, at, 0)
        found &= np.frombuffer(raw["fingerprint"], np.int64)[at] == h
        found &= np.frombuffer(raw["n_docs"], np.int32)[at] >= min_docs
        found &= np.frombuffer(raw["keeper"], np.int64)[at] != doc
        return pa.table([doc[found], h[found], fp[found]], schema=LOST)

    return run


def line_shards(occurrences: DataFrame, shards: int) -> DataFrame:
    """Index rows over the distinct keys of (doc_id, h, fp)."""
    per_key = occurrences.groupBy("h", "fp").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    # h deals to shards and is the fingerprint, fp is the key of the perfect hash: all 128 bits decide.
    return stored(per_key.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInArrow(_build, SHARD), "line-shards")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, drops): structs (h, fp) of the lines that a document loses."""
    hashes = F.transform(keys_of(F.col("text")), hashed)
    found = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), hashes.alias("keys"))
    whole = stored(found, "line-keys")
    # Rows of one doc_id, where there are any, become one document.
    twice = whole.groupBy("doc_id").count().filter("count > 1")
    if not twice.isEmpty():
        whole = whole.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    occurrences = whole.select("doc_id", F.inline("keys"))
    shards = max(1, -(-(whole.agg(F.sum(F.size("keys"))).first()[0] or 0) // shard_rows))
    index = line_shards(occurrences, shards)
    split = F.greatest(F.lit(1), F.ceil(F.col("occurrences") / shard_rows)).cast("int")
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), split - 1)))
    probes = occurrences.withColumn("shard", F.pmod("h", F.lit(shards)))
    # Only shards above their size are told to the probes; the join is left to adaptive execution.
    heavy = index.select("shard", split.alias("split")).filter("split > 1")
    probes = probes.join(heavy, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("split", F.lit(1))).cast("int")).drop("split")
    lost = copies.groupBy("shard", "salt").cogroup(probes.groupBy("shard", "salt")).applyInArrow(_probe(min_docs), "doc_id long, h long, fp long")
    return lost.groupBy("doc_id").agg(F.collect_list(F.struct("h", "fp")).alias("drops"))


@F.pandas_udf(ArrayType(BooleanType()))
def _staying(h: pd.Series, fp: pd.Series, lost_h: pd.Series, lost_fp: pd.Series) -> pd.Series:
    """Whether each line stays: its hash pair is not among the lost ones. Null for a text without losses."""

    def one(a, b, c, d):
        if c is None:
            return None
        lost = set(zip(c.tolist(), d.tolist(), strict=True))
        return [pair not in lost for pair in zip(a.tolist(), b.tolist(), strict=True)]

    return pd.Series([one(*row) for row in zip(h, fp, lost_h, lost_fp, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped beside their own columns.

    Texts that lose no line stay where they are: a bounded filter picks those that may meet their drops.
    """
    drops = stored(dropped_lines(docs, min_docs), "line-drops")
    row = F.struct(*[F.col(c) for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("whole"), row.alias("row"))
    told = marked(rows, "id", drops.select("doc_id"), "asked")
    asked = told.filter("asked").join(drops.withColumnRenamed("doc_id", "loser"), F.col("id") == F.col("loser"), "left").drop("loser", "asked")
    same = told.filter("not asked").drop("asked").withColumn("drops", F.lit(None).cast(drops.schema["drops"].dataType))
    lines = lines_of(F.col("whole"))
    # Of a text that loses lines, one look-up a line in a set of its drops tells which stay.
    pairs = F.transform(lines, lambda x: hashed(line_key(x)))
    stay = _staying(F.transform(pairs, lambda p: p["h"]), F.transform(pairs, lambda p: p["fp"]), F.col("drops.h"), F.col("drops.fp"))
    asked = asked.withColumn("stay", F.when(F.col("drops").isNotNull(), stay))
    same = same.withColumn("stay", F.lit(None).cast("array<boolean>"))
    both = asked.unionByName(same)
    kept = F.when(F.col("stay").isNull(), lines).otherwise(F.filter(lines, lambda x, i: F.get("stay", i)))
    n = F.size(lines)
    return both.withColumn("kept", kept).select("row.*", F.array_join("kept", "\n").alias("kept_text"), n.cast("long").alias("n_lines"), (n - F.size("kept")).cast("long").alias("n_dropped"))
