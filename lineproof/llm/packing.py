"""Best-fit decreasing packing of tokenised documents into sequences of fixed capacity.

Tokenising is a map over documents. The pieces' lengths alone are dealt to hash groups of about GROUP_ROWS
documents; each group is packed on its own, so no task holds more than one group and the loss against one global
packing is at most one open sequence a group.

Defined cases: a null or empty text is the end token alone; equal lengths are placed by (doc_id, piece); repeated
rows are packed each; an empty table gives no rows; other columns of the input are ignored; a null doc_id is kept.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineproof.llm.shared import batch, groups_for, sliced, stored

CAPACITY = 4096
END_ID = 1
GROUP_ROWS = 40_000
CACHE_ROWS, DOCS_EACH = 240_000, 256
WORD = re.compile(r"([a-zß-öø-ÿ]+)([.,]?)")
MARK = "\x01"
VOCABULARY = "word_bpe_49k.json"
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Characters for which white space always separates pre-tokens and normalisation is by character; others take whole texts.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ňŊ-ſ]*")
#: The byte-level alphabet: bytes that print stand for themselves, the others in order for the signs from 256 on.
BYTE_SIGNS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Encoder:
    """Token ids of texts as little-endian bytes; chunks between white space are kept in a bounded cache."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def separate(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk from one call: a control character that no chunk holds stands between them."""
        if len(self.mark) != 1 or not chunks:
            return self.whole(chunks)
        text = f" {MARK} ".join(chunks)
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(ids == self.mark[0]) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)], strict=True)]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def plain_words(self, words: list[str]) -> list[bytes]:
        """Ids of single pre-tokens of lower-case Latin letters: their bytes, as the byte-level alphabet writes them, go straight to the merge model."""
        merge, raw = self.tokenizer.model.tokenize, self.raw
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_SIGNS) for w in words]
        return [b"".join([raw[t.id] for t in merge(w)]) for w in shown]

    def learn(self, chunks: set[str]) -> None:
        """Afterwards the young generation has every chunk, in lower case; a word and the same word with a stop share the look-up."""
        if len(self.young) > CACHE_ROWS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = chunks.difference(young)
        # difference() looks keys up in a dictionary, intersection() would walk through it.
        fresh = missing.difference(old)
        again = missing.difference(fresh)
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        parts, odd, split = {}, [], WORD.fullmatch
        for c in fresh:
            if m := split(c):
                parts[c] = m.groups()
            else:
                odd.append(c)
        words = {x for pair in parts.values() for x in pair}
        words.discard("")
        rest = words.difference(young)
        new = list(rest.difference(old))
        known = {w: young[w] for w in words.difference(rest)}
        known.update((w, old[w]) for w in rest.difference(new))
        known.update(zip(new, self.plain_words(new), strict=True), **{"": b""})
        young.update(zip(odd, self.separate(odd), strict=True))
        young.update((c, known[word] + known[stop]) for c, (word, stop) in parts.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if PLAIN.fullmatch(t) and "<|" not in t]
        odd = sorted(set(range(len(texts))).difference(plain))
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        for at in range(0, len(plain), DOCS_EACH):
            some = {i: texts[i].lower().split() for i in plain[at : at + DOCS_EACH]}
            self.learn(set().union(*some.values()))
            for i, chunks in some.items():
                out[i] = b"".join(map(self.young.__getitem__, chunks))
        return out


def _pieces(path: str | None, capacity: int, with_ids: bool = False):
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(path or public_tokenizers.path(VOCABULARY))
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in sliced(batches, "text", 2 << 20):
            cols: dict[str, list] = {f.name: [] for f in schema}
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, value in zip(cols, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        cols[name].append(value)
            yield batch(schema, **cols)

    return run


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, given in falling order.

    A segment tree over remaining capacities counts the open bins; the tightest bin that holds a length is the first
    non-empty leaf at or right of it, found by one climb and one descent.
    """
    width = 1 << capacity.bit_length()
    tree, open_bins = [0] * (2 * width), [[] for _ in range(capacity + 1)]
    bins, offsets, n = [], [], 0
    for need in lengths:
        i = need + width
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            i += i > 1
        found = -1
        if i > 1 and tree[i]:
            while i < width:
                i = 2 * i if tree[2 * i] else 2 * i + 1
            found = i - width
        if found < 0:
            bin_id, room, n = n, capacity, n + 1
        else:
            bin_id, room = open_bins[found].pop(), found
            i = found + width
            while i:
                tree[i] -= 1
                i >>= 1
        bins.append(bin_id)
        offsets.append(capacity - room)
        if left := room - need:
            open_bins[left].append(bin_id)
            i = left + width
            while i:
                tree[i] += 1
                i >>= 1
    return bins, offsets


def _pack(capacity: int):
    schema = PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.select(PIECES.names).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(group.column("length").to_pylist(), capacity)
        base = key[0].as_py() << 32
        return pa.table([*group.columns, pa.array([base + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())], schema=schema)

    return run


PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def placed(pieces: DataFrame, capacity: int, groups: int) -> DataFrame:
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack(capacity), PACKED)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row per piece: its place in its document, its length and CRC, and its sequence and offset there."""
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(path, capacity), PIECES_DDL)
    return placed(pieces, capacity, groups_for(docs, group_rows))


def sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, ids as little-endian 32-bit integers.

    Tokens are stored once with a number a piece; the packing sees the numbers, and the tokens meet their place by them.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    told = stored(rows.mapInArrow(_pieces(path, capacity, True), f"{PIECES_DDL}, ids binary").withColumn("number", F.monotonically_increasing_id()), "packing-pieces")
    # The number takes the document's place, so that pieces of equal documents are told apart.
    numbered = told.select(F.col("number").alias("doc_id"), "piece", "start", "length", "ids_crc32")
    places = placed(numbered, capacity, groups_for(docs, group_rows)).select(F.col("doc_id").alias("number"), "sequence_id", "offset")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return told.join(places, "number").groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
