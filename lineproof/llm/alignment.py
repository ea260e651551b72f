"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over a corpus.

Two passes. The first aligns every document and counts, a flush of distinct id pairs at a time, how many documents hold
each pair linked. The distinct pairs are dealt to shards; each shard is a minimal perfect hash with the pairs by slot.
The flushes become dense count vectors under it, every key verified, and the vectors are summed as a tree of FAN.
The second pass aligns the documents again and sends the pairs of a batch, packed, to the shards, where their counts
are looked up; what comes back is summed by document. Shards with many look-ups are copied, so a task holds about
PROBE_PAIRS of them whatever pair is in every text.

Neither tokenizer joins a character that is not white space with a space or line end after it, nor a Latin letter with
a stop, so texts are cut there and chunks are aligned once a worker, in a bounded cache. B's pieces are searched for
such joins when it is opened: without cuts before stops where there is one, and not at all where spaces are joined.

Defined cases: a null or empty text, and one whose joined token bytes differ from a space and the text, has no tokens,
zeros and an empty digest; repeated rows and rows without doc_id are documents of their own; an empty table gives no
rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineproof.llm.mph import MinimalPerfectHash, mix
from lineproof.llm.shared import batch, sliced, stored

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
CACHE_ROWS = 130_000
SLICE_BYTES = 2 << 20
#: Longer chunks and those with line ends are aligned one by one, the others CHUNKS_EACH at a time.
PLAIN_CHARS, CHUNKS_EACH = 400, 8192
FLUSH_PAIRS = 1 << 17
SHARD_PAIRS = 1 << 18
PROBE_PAIRS = 1 << 20
FAN = 32
SPACE_SIGN = "▁"
#: The byte-level alphabet: bytes that print stand for themselves, the others in order for the signs from 256 on.
SIGN_BYTES = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
SIGN_BYTES |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if chr(b) not in SIGN_BYTES)}
BYTE_SIGNS = {b: c for c, b in SIGN_BYTES.items()}
#: Latin letters, and the signs that end a word for A whatever follows; B's pieces are searched for such ends.
LETTERS, STOPS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
WORD = re.compile(f" ?[{LETTERS}]+").fullmatch
ALIGNED = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("shard", pa.int32()), ("size", pa.int64()), ("rows", pa.binary()), ("keys", pa.binary()), ("times", pa.binary())])
ALIGNED_DDL = "number long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, shard int, size long, rows binary, keys binary, times binary"


#: The groups of a chunk and its links. Plain tuples of texts and bytes leave the cyclic collector, which would walk a whole cache of objects.
Chunk = tuple[str, bytes]


class Aligner:
    """Alignments of chunks of texts, kept in two generations of a bounded cache; groups only where they are asked for."""

    def __init__(self, byte_path: str | None, piece_path: str | None, with_groups: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.with_groups = Tokenizer.from_file(byte_path or public_tokenizers.path(BYTE_VOCABULARY)), with_groups
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path or public_tokenizers.path(PIECE_VOCABULARY))
        self.a_bytes = {i: bytes(map(SIGN_BYTES.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = dict(enumerate(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)))
        spelt = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}|\n", p) for p in spelt):
            raise ValueError("a piece crosses from a word into a space or holds a line end")
        self.end_a, self.end_b = self.a.encode("\n", add_special_tokens=False).ids, self.b.encode("\n")[1:]
        n = 1 + max(*self.a_bytes, *self.b_bytes)
        self.sizes_a, self.sizes_b = (np.fromiter((len(x.get(i, b"")) for i in range(n)), np.int64, n) for x in (self.a_bytes, self.b_bytes))
        self.next_group, self.next_a, self.next_b, self.other_side = (np.array([f"{sign}{i}" for i in range(n)], object) for sign in ";,.|")
        whole = r"\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+"
        stop = any(re.search(f"[{LETTERS}][{STOPS}]", p) for p in spelt)
        self.cut = re.compile(whole if stop else rf"\s*[{LETTERS}]+(?=[{STOPS}])|{whole}").findall
        self.young: dict[str, Chunk | None] = {}
        self.old: dict[str, Chunk | None] = {}

    def align(self, text: str, a: list[int], b: list[int]) -> Chunk | None:
        """Groups between the offsets where tokens of both end; None where the tokens do not spell the text."""
        a_bytes, b_bytes, raw = self.a_bytes, self.b_bytes, text.encode()
        if b"".join([a_bytes[i] for i in a]) != raw or b"".join([b_bytes[i] for i in b]) != raw:
            return None
        shown, links = [], []
        i = j = end_a = end_b = 0
        while i < len(a):
            from_a, from_b = i, j
            end_a, end_b, i, j = end_a + len(a_bytes[a[i]]), end_b + len(b_bytes[b[j]]), i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a, i = end_a + len(a_bytes[a[i]]), i + 1
                else:
                    end_b, j = end_b + len(b_bytes[b[j]]), j + 1
            own_a, own_b = a[from_a:i], b[from_b:j]
            if self.with_groups:
                shown.append(",".join(map(str, own_a)) + "|" + ".".join(map(str, own_b)))
            links += [x << 32 | y for x in own_a for y in own_b]
        return ";".join(shown), np.array(links, np.int64).tobytes()

    def byte_ids(self, chunks: list[str]) -> list[list[int]]:
        """A's ids; a word of Latin letters is one pre-token and goes straight to the merge model, as its byte-level signs."""
        words, merge = [c for c in chunks if WORD(c)], self.a.model.tokenize
        found = {w: [t.id for t in merge(w.encode().decode("latin-1").translate(BYTE_SIGNS))] for w in words}
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, [e.ids for e in self.a.encode_batch_fast(rest, add_special_tokens=False)], strict=True))
        return [found[c] for c in chunks]

    def align_plain(self, chunks: list[str]) -> list[Chunk] | None:
        """Chunks without a line end or other white space at their ends than spaces before, in one text with a line end before each; None where that text is not spelt by its tokens."""
        text, end = "\n" + "\n".join(chunks) + "\n", self.end_a
        ids_a, raw = [*end, *chain.from_iterable(chain(ids, end) for ids in self.byte_ids(chunks))], text.encode()
        # Each chunk for itself costs less than their text; the space that B sets before it goes.
        ids_b = [*chain.from_iterable(ids[1:] for ids in self.b.encode(["\n" + c for c in chunks], num_threads=1)), *self.end_b]
        if b"".join(map(self.a_bytes.__getitem__, ids_a)) != raw or b"".join(map(self.b_bytes.__getitem__, ids_b)) != raw:
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        at_a, at_b = np.flatnonzero(a == end[0]), np.flatnonzero(b == self.end_b[0])
        if not len(at_a) == len(at_b) == len(chunks) + 1:
            return None
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        mark = np.zeros(len(raw) + 1, bool)
        mark[ends_a] = True
        both = ends_b[mark[ends_b]]
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        first_b = np.searchsorted(group_b, np.arange(len(both)))
        n_b = np.bincount(group_b, minlength=len(both))
        # Every A token meets the B tokens of its group.
        each = n_b[group_a]
        upto = np.concatenate([[0], np.cumsum(each)])
        nth = np.arange(upto[-1]) - np.repeat(upto[:-1], each)
        links = (np.repeat(a, each) << 32 | b[np.repeat(first_b[group_a], each) + nth]).tobytes()
        cut = [links[i:j] for i, j in zip((8 * upto[at_a[:-1] + 1]).tolist(), (8 * upto[at_a[1:]]).tolist(), strict=True)]
        if not self.with_groups:
            return [("", x) for x in cut]
        new_a, new_b = (np.concatenate([[True], g[1:] != g[:-1]]) for g in (group_a, group_b))
        signs = np.concatenate([np.where(new_a, self.next_group[a], self.next_a[a]), np.where(new_b, self.other_side[b], self.next_b[b])])
        signs = signs[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        shown, sizes = "".join(signs), np.concatenate([[0], np.cumsum(np.fromiter(map(len, signs), np.int64, len(signs)))])
        # A line end is one token of each: its two signs come just before those of its chunk.
        froms, to = sizes[(at_a + at_b)[:-1] + 2].tolist(), sizes[(at_a + at_b)[1:]].tolist()
        return [(shown[i + 1 : j], x) for i, j, x in zip(froms, to, cut, strict=True)]

    def learn(self, chunks: set[str]) -> None:
        """Afterwards the young generation has every chunk; None stands for one that is not spelt by its tokens."""
        if len(self.young) > CACHE_ROWS:
            self.old, self.young = self.young, {}
        missing = chunks.difference(self.young)
        fresh = missing.difference(self.old)
        again = missing.difference(fresh)
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        plain = [c for c in fresh if "\n" not in c and len(c) <= PLAIN_CHARS and (c[0] == " " or not c[0].isspace()) and not c[-1].isspace()]
        odd = list(fresh.difference(plain))
        for at in range(0, len(plain), CHUNKS_EACH):
            some = plain[at : at + CHUNKS_EACH]
            if (found := self.align_plain(some)) is None:
                odd += some
            else:
                self.young.update(zip(some, found, strict=True))
        # Behind a line end, whose own tokens go, B's ids of a chunk are those inside a text.
        ids_a, ids_b = self.a.encode_batch_fast(odd, add_special_tokens=False), self.b.encode(["\n" + c for c in odd], num_threads=1)
        for c, x, y in zip(odd, ids_a, ids_b, strict=True):
            self.young[c] = self.align(c, x.ids, y[2:])

    def documents(self, texts: list[str | None]) -> Iterator[tuple[str, np.ndarray]]:
        """Of each text its groups, B's ids with points between them, and its links; none where it has no tokens."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        for chunks in cut:
            told = [self.young[c] for c in chunks]
            groups, links = zip(*told, strict=True) if told and None not in told else ((), ())
            yield ";".join(groups) if self.with_groups else "", np.frombuffer(b"".join(links), np.int64)


def _counted(paths: tuple):
    """Flushes of sorted distinct pairs with the number of documents that hold each linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, part = Aligner(*paths, with_groups=False), Counter(), TaskContext.get().partitionId() << 32

        def flushed() -> pa.RecordBatch:
            keys = np.fromiter(held.keys(), np.int64, len(held))
            order = np.argsort(keys)
            counts = np.fromiter(held.values(), np.int64, len(held))[order]
            return pa.RecordBatch.from_pydict({"part": [part], "keys": [keys[order].tobytes()], "counts": [counts.tobytes()]})

        for b in sliced(batches, "text", SLICE_BYTES):
            found = [np.unique(links) for _, links in aligner.documents(b.column("text").to_pylist())]
            pairs, counts = np.unique(np.concatenate(found), return_counts=True)
            held.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
            if len(held) >= FLUSH_PAIRS:
                yield flushed()
                held, part = Counter(), part + 1
        if held:
            yield flushed()

    return run


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column("keys").to_pylist():
            yield pa.RecordBatch.from_pydict({"key": np.frombuffer(raw, np.int64)})


def _by_shard(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw, n in zip(*(b.column(c).to_pylist() for c in ("part", "keys", "counts")), strict=True):
                keys, counts = np.frombuffer(raw, np.int64), np.frombuffer(n, np.int64)
                to = shard_of(keys, shards)
                some = np.unique(to).tolist()
                yield pa.RecordBatch.from_pydict({"shard": pa.array(some, pa.int32()), "part": [part] * len(some), "keys": [keys[to == s].tobytes() for s in some], "counts": [counts[to == s].tobytes() for s in some]})

    return run


def _hashed(key: tuple, group: pa.Table) -> pa.Table:
    keys = group.column("key").to_numpy()
    mph = MinimalPerfectHash.build(keys.view(np.uint64))
    slots = np.zeros(mph.n, np.int64)
    slots[mph.index(keys.view(np.uint64))] = keys
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "table": [mph.to_bytes()], "slots": [slots.tobytes()]})


class Slots:
    """A shard's index, opened: the slot of each key, verified against the pair that stands there."""

    def __init__(self, index: pa.Table):
        self.keys = np.frombuffer(index.column("slots")[0].as_py(), np.int64)
        self.mph = MinimalPerfectHash.from_bytes(index.column("table")[0].as_py())

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.mph.index(keys.view(np.uint64))
        if (at < 0).any() or (self.keys[at] != keys).any():
            raise ValueError("a pair is not in the index")
        return at


def _vector(key: tuple, index: pa.Table, flushes: pa.Table) -> pa.Table:
    slots = Slots(index)
    counts = np.zeros(len(slots.keys), np.int64)
    for raw, n in zip(flushes.column("keys"), flushes.column("counts"), strict=True):
        counts[slots.of(np.frombuffer(raw.as_py(), np.int64))] += np.frombuffer(n.as_py(), np.int64)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int64()), "counts": [counts.tobytes()]})


def _summed(key: tuple, group: pa.Table) -> pa.Table:
    counts = sum(np.frombuffer(x.as_py(), np.int64) for x in group.column("counts"))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int64()), "counts": [counts.tobytes()]})


def _pairs(key: tuple, index: pa.Table, sums: pa.Table) -> pa.Table:
    keys = np.frombuffer(index.column("slots")[0].as_py(), np.int64)
    return pa.table({"shard": np.full(len(keys), key[0].as_py(), np.int32), "key": keys, "a": keys >> 32, "n": np.frombuffer(sums.column("counts")[0].as_py(), np.int64)})


def _flagged(key: tuple, index: pa.Table, counted: pa.Table) -> pa.Table:
    slots = Slots(index)
    at = slots.of(counted.column("key").to_numpy())
    counts, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    counts[at], best[at] = counted.column("n").to_numpy(), counted.column("best").to_numpy(zero_copy_only=False)
    return index.append_column("counts", pa.array([counts.tobytes()])).append_column("best", pa.array([best.tobytes()]))


INDEX_DDL = "shard int, table binary, slots binary"


def pair_index(rows: DataFrame, paths: tuple = (None, None), shard_pairs: int = SHARD_PAIRS, fan: int = FAN) -> tuple[DataFrame, int]:
    """The stored index over distinct linked pairs of (doc_id, text), and its number of shards, which the two vocabularies bound.

    Of each shard: its perfect hash, the pairs by slot, their document counts, and whether a count is its A id's highest.
    """
    flushes = stored(rows.select("text").mapInArrow(_counted(paths), "part long, keys binary, counts binary"), "alignment-flushes")
    keys = stored(flushes.select("keys").mapInArrow(_single, "key long").distinct(), "alignment-pairs")
    shards = max(1, -(-keys.count() // shard_pairs))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            yield pa.RecordBatch.from_pydict({"key": key, "shard": shard_of(key, shards)})

    index = stored(keys.mapInArrow(dealt, "key long, shard int").groupBy("shard").applyInArrow(_hashed, INDEX_DDL), "alignment-index")
    nodes = max(1, -(-flushes.count() // fan))
    dense = flushes.mapInArrow(_by_shard(shards), "shard int, part long, keys binary, counts binary").withColumn("node", F.pmod(F.xxhash64("part"), F.lit(nodes)))
    copies = index.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nodes - 1).cast("long"))))
    sums = stored(copies.groupBy("shard", "node").cogroup(dense.groupBy("shard", "node")).applyInArrow(_vector, "shard int, node long, counts binary"), "alignment-vectors")
    while nodes > 1:
        nodes = -(-nodes // fan)
        up = sums.withColumn("node", F.floor(F.col("node") / fan).cast("long"))
        sums = stored(up.groupBy("shard", "node").applyInArrow(_summed, "shard int, node long, counts binary"), "alignment-vectors")
    counted = index.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(_pairs, "shard int, key long, a long, n long")
    counted = counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))
    flagged = index.groupBy("shard").cogroup(counted.groupBy("shard")).applyInArrow(_flagged, f"{INDEX_DDL}, counts binary, best binary")
    return stored(flagged, "alignment-counts"), shards


def _aligned(paths: tuple, shards: int):
    """A row a document, and the pairs of each batch packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(*paths), TaskContext.get().partitionId() << 40
        for b in sliced(batches, "text", SLICE_BYTES):
            cols: dict[str, list] = {f.name: [] for f in ALIGNED}
            numbers, keys, times = [], [], []
            for doc_id, (groups, found) in zip(b.column("doc_id").to_pylist(), aligner.documents(b.column("text").to_pylist()), strict=True):
                links, n = np.unique(found, return_counts=True)
                n_groups = groups.count("|")
                digest = hashlib.sha256(groups.replace(".", ",").encode()).hexdigest() if groups else ""
                row = (number, doc_id, n_groups + groups.count(","), n_groups + groups.count("."), n_groups, len(found), digest)
                for name, value in zip(cols, (*row, None, None, None, None, None), strict=True):
                    cols[name].append(value)
                numbers.append(np.full(len(links), number, np.int64))
                keys.append(links)
                times.append(n)
                number += 1
            number_of, key, time = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, keys, times))
            to = shard_of(key, shards)
            for s in np.unique(to).tolist():
                own = to == s
                for name, value in zip(cols, (*[None] * 7, s, int(own.sum()), number_of[own].tobytes(), key[own].tobytes(), time[own].tobytes()), strict=True):
                    cols[name].append(value)
            yield batch(ALIGNED, **cols)

    return run


def _looked_up(key: tuple, index: pa.Table, probes: pa.Table) -> pa.Table:
    slots = Slots(index)
    counts, best = np.frombuffer(index.column("counts")[0].as_py(), np.int64), np.frombuffer(index.column("best")[0].as_py(), bool)
    out: list[list[np.ndarray]] = [[], [], []]
    for rows, keys, times in zip(*(probes.column(c) for c in ("rows", "keys", "times")), strict=True):
        at, times = slots.of(np.frombuffer(keys.as_py(), np.int64)), np.frombuffer(times.as_py(), np.int64)
        rows, start = np.unique(np.frombuffer(rows.as_py(), np.int64), return_index=True)
        for to, values in zip(out, (rows, np.add.reduceat(times * best[at], start), np.add.reduceat(times * counts[at], start)), strict=True):
            to.append(values)
    none = [np.zeros(0, np.int64)]
    return pa.table(dict(zip(("number", "n_best", "count_sum"), (np.concatenate(x or none) for x in out), strict=True)))


def align_documents(docs: DataFrame, paths: tuple = (None, None), shard_pairs: int = SHARD_PAIRS, probe_pairs: int = PROBE_PAIRS, fan: int = FAN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index, shards = pair_index(rows, paths, shard_pairs, fan)
    told = stored(rows.mapInArrow(_aligned(paths, shards), ALIGNED_DDL), "alignment-documents")
    probes = told.filter("shard is not null").select("shard", "size", "rows", "keys", "times")
    splits = stored(probes.groupBy("shard").agg(F.ceil(F.sum("size") / probe_pairs).cast("int").alias("splits")), "alignment-splits")
    # One row a shard at most, and the vocabularies bound the shards.
    dealt = probes.join(F.broadcast(splits), "shard").withColumn("split", F.pmod(F.xxhash64("rows"), F.col("splits")))
    copies = index.join(F.broadcast(splits), "shard").withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits").cast("long") - 1))).drop("splits")
    found = copies.groupBy("shard", "split").cogroup(dealt.select("shard", "split", "rows", "keys", "times").groupBy("shard", "split")).applyInArrow(_looked_up, "number long, n_best long, count_sum long")
    sums = found.groupBy("number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = told.filter("shard is null").select("number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "number", "left").drop("number")
    return whole.fillna(0, ["n_best", "count_sum"])


def groups_of(docs: DataFrame, paths: tuple = (None, None)) -> DataFrame:
    """(doc_id, groups): the groups themselves, as `a1,a2|b1;a3|b2,b3`; empty where a text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        for b in sliced(batches, "text", SLICE_BYTES):
            shown = [groups.replace(".", ",") for groups, _ in aligner.documents(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "groups": shown})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, groups string")
