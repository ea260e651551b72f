"""Ranked lexical search by Block-Max MaxScore over sharded inverted indexes.

Indexing is a map over documents: every SHARD_TERMS term occurrences become one row, a shard, so no text is shuffled.
A shard's postings lie in blocks of RANGE neighbouring documents, a byte for the place in the block and a byte for the
occurrences (rarer large ones beside them); of each block the index knows the most occurrences and the shortest
document, which bound every score in it without decoding. Corpus statistics are sums over the shards.

A query goes through a shard's ranges in the order of their bounds. Lists whose bounds together cannot reach the
threshold are not essential: only documents of the other lists are candidates, and a candidate is dropped before a
block of a non-essential list is decoded once the block maxima left cannot lift it to the threshold. The shards' heaps
are merged by rank. Bounds equal to the threshold are followed, so ties fall to the smaller doc_id exactly.

Queries reach the shards in blocks of QUERY_TERMS terms at most; each block is one job over all shards.

Defined cases: a null or empty text has no terms; a row without doc_id is no document and one without item_id no item;
rows that share an item_id are one item with the terms of all; repeated documents are ranked each; items without a
matching document give no rows, as does an empty table; other columns of the inputs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineproof.llm.shared import batch, sliced, stored

SHARD_TERMS = 1 << 20
#: Shards of a file of the index: a reader holds the rows of a file together, whatever their size.
FILE_SHARDS = 2
RANGE = 256
QUERY_TERMS = 1 << 18
#: Letters and digits of ASCII and all beyond it stay, A-Z in lower case; the other bytes separate.
FOLD = bytes((i + 32 if 65 <= i <= 90 else i) if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
ARRAYS = {"docs": "<i8", "lengths": "<i4", "block_at": "<i4", "block_range": "<i4", "most": "<i4", "shortest": "<i4", "posting_at": "<i4", "places": "u1", "counts": "u1", "large_at": "<i4", "large": "<i4"}
INDEX = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ARRAYS]])
INDEX_DDL = "shard long, n_docs long, n_terms long, terms array<binary>, df array<int>, " + ", ".join(f"{c} binary" for c in ARRAYS)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def shard_row(shard: int, docs: list[int], terms: list[list[bytes]]) -> pa.RecordBatch:
    """One index row over documents that have a term, in their given order."""
    flat = [t for d in terms for t in d]
    names = sorted(set(flat))
    number = {t: i for i, t in enumerate(names)}
    lengths = np.array([len(d) for d in terms], np.int64)
    key = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)) * len(docs) + np.repeat(np.arange(len(docs)), lengths)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // len(docs), key % len(docs)
    ranges = -(-len(docs) // RANGE)
    block = term * ranges + doc // RANGE
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    large = np.flatnonzero(tf >= 255)
    found = {
        "docs": np.array(docs), "lengths": lengths, "block_at": np.searchsorted(block[start], np.arange(len(names) + 1) * ranges), "block_range": block[start] % ranges,
        "most": np.maximum.reduceat(tf, start), "shortest": np.minimum.reduceat(lengths[doc], start), "posting_at": np.append(start, len(key)),
        "places": doc % RANGE, "counts": np.minimum(tf, 255), "large_at": large, "large": tf[large],
    }
    arrays = {c: [found[c].astype(kind).tobytes()] for c, kind in ARRAYS.items()}
    df = np.bincount(term, minlength=len(names)).astype(np.int32)
    return batch(INDEX, shard=[shard], n_docs=[len(docs)], n_terms=[len(flat)], terms=[names], df=[df], **arrays)


def _indexed(shard_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        docs, terms, held = [], [], 0
        for b in sliced(batches, "text", 4 << 20):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if found := terms_of(text):
                    docs.append(doc_id)
                    terms.append(found)
                    held += len(found)
                if held >= shard_terms:
                    yield shard_row(shard, docs, terms)
                    shard, docs, terms, held = shard + 1, [], [], 0
        if docs:
            yield shard_row(shard, docs, terms)

    return run


def index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The stored index: a row a shard, few rows a file, so that a task holds as much of it however many documents it indexed."""
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return stored(rows.mapInArrow(_indexed(shard_terms), INDEX_DDL), "lexical-index", FILE_SHARDS)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [(i, t) for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True) for t in set(terms_of(text))]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], names=["item_id", "term"])


class Shard:
    """One index row, opened for queries under the statistics of the whole corpus."""

    def __init__(self, row: dict, asked: set[bytes], n: int, total: int):
        self.a = {c: np.frombuffer(row[c], kind) for c, kind in ARRAYS.items()}
        self.at = {t: i for i, t in enumerate(row["terms"]) if t in asked}
        self.ranges = -(-len(self.a["docs"]) // RANGE)
        self.n, self.total = n, total
        self.large = dict(zip(self.a["large_at"].tolist(), self.a["large"].tolist(), strict=True))
        self.shares = self.share(self.a["most"].astype(np.int64), self.a["shortest"].astype(np.int64))
        self.norm = 20 * self.m(self.a["lengths"].astype(np.int64))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def m(self, lengths: np.ndarray) -> np.ndarray:
        return 50 + 50 * lengths * self.n // self.total

    def share(self, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 20 * self.m(lengths))

    def decoded(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the range and what an occurrence of weight 1 adds there."""
        if block not in self.open:
            a, start, stop = self.a, int(self.a["posting_at"][block]), int(self.a["posting_at"][block + 1])
            places, tf = a["places"][start:stop], a["counts"][start:stop].astype(np.int64)
            for i in np.flatnonzero(tf == 255).tolist():
                tf[i] = self.large[start + i]
            docs = int(a["block_range"][block]) * RANGE + places.astype(np.int64)
            self.open[block] = places, 1_000_000_000 * tf // (1000 * tf + self.norm[docs])
        return self.open[block]

    def top(self, weights: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best above 0, ties to smaller ids."""
        lists = [(self.at[t], w) for t, w in weights if t in self.at and w > 0]
        none = np.zeros(0, np.int64)
        if not lists:
            return none, none
        bounds, blocks = np.zeros((len(lists), self.ranges), np.int64), np.full((len(lists), self.ranges), -1, np.int64)
        for i, (t, w) in enumerate(lists):
            own = np.arange(self.a["block_at"][t], self.a["block_at"][t + 1])
            bounds[i, self.a["block_range"][own]] = w * self.shares[own]
            blocks[i, self.a["block_range"][own]] = own
        # Lists by rising bound: a prefix of them is not essential.
        order = np.argsort(bounds.max(1), kind="stable")
        lists, bounds, blocks = [lists[i] for i in order], bounds[order], blocks[order]
        reach, sums = np.cumsum(bounds.max(1)), bounds.sum(0)
        docs, scores, least = none, none, 1
        for r in np.argsort(-sums, kind="stable").tolist():
            if sums[r] < least:
                break
            split = int(np.searchsorted(reach, least))
            got = np.zeros(RANGE, np.int64)
            for i in range(split, len(lists)):
                if blocks[i, r] >= 0:
                    places, share = self.decoded(int(blocks[i, r]))
                    got[places] += lists[i][1] * share
            left = int(bounds[:split, r].sum())
            alive = (got > 0) & (got + left >= least)
            for i in range(split - 1, -1, -1):
                if blocks[i, r] < 0:
                    continue
                if not alive.any():
                    break
                places, share = self.decoded(int(blocks[i, r]))
                got[places] += np.where(alive[places], lists[i][1] * share, 0)
                left -= int(bounds[i, r])
                alive &= got + left >= least
            new = np.flatnonzero(alive & (got >= least))
            docs = np.concatenate([docs, self.a["docs"][r * RANGE + new]])
            scores = np.concatenate([scores, got[new]])
            if len(docs) >= k:
                keep = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[keep], scores[keep]
                least = max(least, int(scores[-1]))
        return docs, scores


def _searched(items: dict[int, list[tuple[bytes, int]]], n: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {t for weights in items.values() for t, _ in weights}
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.slice(i, 1).to_pylist()[0], asked, n, total)
                ids, docs, scores = [], [], []
                for item, weights in items.items():
                    d, s = shard.top(weights, k)
                    ids.append(np.full(len(d), item))
                    docs.append(d)
                    scores.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, docs, scores)], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50, shard_terms: int = SHARD_TERMS, query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score of each item of (item_id, text)."""
    spark = docs.sparkSession
    shards = index(docs, shard_terms)
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    pairs = rows.mapInArrow(_item_terms, "item_id long, term binary").distinct()
    frequency = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    frequency = frequency.groupBy("term").agg(F.sum("df").alias("df"))
    asked = stored(pairs.join(frequency, "term"), "lexical-items")
    blocks = max(1, -(-asked.count() // query_terms))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for at in range(blocks):
        held: dict[int, list[tuple[bytes, int]]] = {}
        for r in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == at).toLocalIterator():
            held.setdefault(r.item_id, []).append((bytes(r.term), math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))))
        if held:
            heaps = shards.drop("df", "n_docs", "n_terms").mapInArrow(_searched(held, n, total, k), "item_id long, doc_id long, score long")
            found = found.unionByName(heaps)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
