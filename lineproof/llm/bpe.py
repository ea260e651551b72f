"""Byte-level BPE encoding in two tiers, and decoding.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves. Tier two: the
other pre-tokens are merged with a heap of adjacent pairs over bytes linked as a list. Both tiers serve a bounded
cache of pre-tokens, so frequent words cost one look-up. Work is a map over rows; nothing is shuffled.

Defined cases: a null text is the empty text (no tokens); repeated rows give repeated results; other columns of the
input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineproof.llm.mph import MinimalPerfectHash
from lineproof.llm.shared import batch, sliced

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_ROWS = 250_000
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_rows: int = CACHE_ROWS):
        import regex
        import xxhash

        self.ranks, self.split, self.cache_rows = ranks, regex.compile(pattern).findall, cache_rows
        self.hash = xxhash.xxh3_64_intdigest
        self.token_of = {rank: token for token, rank in ranks.items()}
        keys = self.hashes(list(ranks))
        self.mph = MinimalPerfectHash.build(keys)
        self.slots: list[bytes] = [b""] * len(ranks)
        for token, slot in zip(ranks, self.mph.index(keys).tolist(), strict=True):
            self.slots[slot] = token
        self.slot_ids = [ranks[token] for token in self.slots]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def hashes(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hash, keys), np.uint64, len(keys))

    def merge(self, word: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, leftmost first, until no pair is a token."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it was merged into its left neighbour
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(word[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or not end[mid] or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            left = before[i]
            if left >= 0 and (r := ranks.get(word[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = end[i]
        return ids

    def learn(self, words: set[str]) -> None:
        """Afterwards the young generation has every word."""
        if len(self.young) > self.cache_rows:
            self.old, self.young = self.young, {}
        new = []
        for w in words:
            if w in self.young:
                continue
            if w in self.old:
                self.young[w] = self.old[w]
            else:
                new.append(w)
        raw = [w.encode() for w in new]
        for word, key, slot in zip(new, raw, self.mph.index(self.hashes(raw)).tolist(), strict=True):
            ids = [self.slot_ids[slot]] if slot >= 0 and self.slots[slot] == key else self.merge(key)
            self.young[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.young.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoded(path: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe = ByteBpe(read_ranks(path or public_tokenizers.path(VOCABULARY)), pattern or public_tokenizers.PATTERN)
        for b in sliced(batches, "text", 1 << 20):
            ids = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            yield batch(ENCODED, doc_id=b.column("doc_id"), n_tokens=[len(x) // 4 for x in ids], ids=ids, decoded=[bpe.decode(x) for x in ids])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document: ids as little-endian 32-bit integers, and the bytes they decode to."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_encoded(path, pattern), "doc_id long, n_tokens long, ids binary, decoded binary")
