"""Substring deduplication: repeated windows of words, found in super-k-mer buckets.

A window is WINDOW consecutive words of one document; its minimiser is the least hash of the runs of MINI words in it.
Consecutive windows with one minimiser travel as one packed string to the minimiser's bucket, where sorting the windows
finds equal ones and the smallest doc_id that holds each; equal hashes are confirmed on the words themselves.

A first pass over the texts counts the minimisers and their windows. A minimiser that one document alone holds cannot
repeat across documents, so a bounded filter keeps such strings at home; what it lets through by chance is judged all
the same. Buckets are sized by windows. One with more than its size (a group of copies, a common passage) is split by
document: each split drops what it sees twice and passes on one holder of each of its windows, under a 128-bit key of
the window's words, to a last comparison over windows; a window has at most one holder a split there.

Defined cases: a null or empty text has no words; a text under WINDOW words loses none; a row without doc_id loses
nothing and counts for no document; rows that share a doc_id are one document, each judged against smaller ids alone;
an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineproof.llm.mph import mix
from lineproof.llm.shared import batch, marked, sliced, stored

WINDOW = 50
MINI = 5
BUCKET_WINDOWS = 1 << 16
#: Windows of one packed string at most: a text of one repeated word is cut, its parts meet in the same bucket.
RUN_WINDOWS = 1024
FEW_ROWS = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
COUNTED = pa.schema([("mini", pa.int64()), ("doc_id", pa.int64()), ("windows", pa.int64())])
PACKED = pa.schema([("mini", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])
JUDGED = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("window", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    hash_of = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    return np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """The minimiser of the window at each word: the least hash of MINI words in a row."""
    n = len(hashes) - MINI + 1
    least = np.zeros(n, np.uint64)
    for j in range(MINI):
        least = least * BASE + hashes[j : j + n]
    least, span, width = mix(least), 1, window - MINI + 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def super_kmers(hashes: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, first word in all, windows, minimiser) of each run of windows with one minimiser, for texts laid end to end."""
    ends = np.cumsum(sizes)
    if not len(hashes) or sizes.max() < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    mini = minimisers(hashes, window)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(mini)]
    inside = np.arange(len(mini)) + window <= ends[doc]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (mini[1:] != mini[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    windows = np.add.reduceat(inside.astype(np.int64), starts)
    parts = -(-windows // RUN_WINDOWS)
    if parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(windows, parts) - nth * RUN_WINDOWS
        starts, windows = np.repeat(starts, parts) + nth * RUN_WINDOWS, np.minimum(left, RUN_WINDOWS)
    return doc[starts], starts, windows, mini[starts]


def _runs(window: int, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 2 << 20):
            texts = [t.split() for t in b.column("text").to_pylist()]
            words = [w for t in texts for w in t]
            sizes = np.array([len(t) for t in texts], np.int64)
            doc, start, windows, mini = super_kmers(word_hashes(words), sizes, window)
            ids = b.column("doc_id").to_numpy()[doc]
            if not packed:
                yield batch(COUNTED, mini=mini.view(np.int64), doc_id=ids, windows=windows)
                continue
            joined = b" ".join(words)
            at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
            cut = [joined[i:j] for i, j in zip(at[start].tolist(), (at[start + windows + window - 1] - 1).tolist(), strict=True)]
            own = (start - (np.cumsum(sizes) - sizes)[doc]).astype(np.int32)
            yield batch(PACKED, mini=mini.view(np.int64), doc_id=ids, digest=b.column("digest").to_numpy()[doc], start=own, words=cut)

    return run


def window_order(ids: np.ndarray, places: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """The smallest document that holds each window: windows of word numbers at places, sorted by hash, confirmed by word."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(ids), BASE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers)])
        back = np.cumprod(np.full(len(ids), BASE_INVERSE))
        hashes = (sums[places + window] - sums[places]) * back[places]
    order = np.lexsort((doc, hashes))
    fresh = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    least = np.empty(len(doc), doc.dtype)
    least[order] = doc[order][head]
    first = np.empty(len(doc), np.int64)
    first[order] = places[order][head]
    span, odd = np.arange(window), []
    others = np.flatnonzero(first != places)
    for at in range(0, len(others), 1 << 14):
        some = others[at : at + (1 << 14)]
        same = (ids[places[some][:, None] + span] == ids[first[some][:, None] + span]).all(1)
        odd += some[~same].tolist()
    if odd:  # different windows under one hash: these hashes are settled by the words
        held: dict[bytes, int] = {}
        shared = np.flatnonzero(np.isin(hashes, hashes[odd])).tolist()
        keys = {i: ids[places[i] : places[i] + window].tobytes() for i in shared}
        for i in shared:
            held[keys[i]] = min(held.get(keys[i], doc[i]), doc[i])
        for i in shared:
            least[i] = held[keys[i]]
    return least


def _judge(window: int):
    """Spans of windows that a smaller document holds; in a split bucket also one row for each window left to its smallest holder."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        import xxhash

        group = group.combine_chunks()
        packed = group.column("words").to_pylist()
        words = b" ".join(packed).split()
        number = {w: i for i, w in enumerate(set(words))}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        sizes = np.fromiter((p.count(b" ") + 1 for p in packed), np.int64, len(packed))
        windows = sizes - window + 1
        row = np.repeat(np.arange(len(packed)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        places = (np.cumsum(sizes) - sizes)[row] + nth
        docs, digests, starts = (group.column(c).to_numpy() for c in ("doc_id", "digest", "start"))
        doc = docs[row]
        gone = doc > window_order(ids, places, doc, window)
        first = gone.copy()
        first[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
        at = np.flatnonzero(first)
        n = np.add.reduceat(gone.astype(np.int32), at) if len(at) else np.zeros(0, np.int32)
        keys: list[bytes | None] = [None] * len(at)
        if key[2].as_py() > 1:
            left = np.flatnonzero(~gone)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            joined = b" ".join(words)
            froms = np.concatenate([[0], ends])[places[left]].tolist()
            keys += [xxhash.xxh3_128_digest(joined[i:j]) for i, j in zip(froms, (ends[places[left] + window - 1] - 1).tolist(), strict=True)]
            at, n = np.concatenate([at, left]), np.concatenate([n, np.ones(len(left), np.int32)])
        return pa.table([docs[row[at]], digests[row[at]], (starts[row[at]] + nth[at]).astype(np.int32), n.astype(np.int32), pa.array(keys, pa.binary())], schema=JUDGED)

    return run


def repeated_spans(rows: DataFrame, window: int = WINDOW, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(doc_id, digest, start, n): n consecutive windows from word start on, each held by a smaller document too; rows as repeats_removed makes them."""
    whole = rows.filter("doc_id is not null")
    counted = whole.select("doc_id", "text").mapInArrow(_runs(window, False), ddl(COUNTED))
    minis = counted.groupBy("mini").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("windows").alias("windows"))
    several = stored(minis.filter("low < high").select("mini", "windows"), "substring-minimisers")
    buckets = max(1, -(-(several.agg(F.sum("windows")).first()[0] or 0) // bucket_windows))
    bucket = F.pmod("mini", F.lit(buckets)).alias("bucket")
    large = several.groupBy(bucket).agg(F.sum("windows").alias("windows")).filter(F.col("windows") > 2 * bucket_windows)
    large = stored(large.select("bucket", F.ceil(F.col("windows") / bucket_windows).cast("int").alias("splits")), "substring-buckets")
    strings = marked(whole.mapInArrow(_runs(window, True), ddl(PACKED)), "mini", several.select("mini"), "lineproof_asked").filter("lineproof_asked")
    listed = F.broadcast(large) if large.count() <= FEW_ROWS else large
    dealt = strings.withColumn("bucket", bucket).join(listed, "bucket", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    dealt = dealt.withColumn("split", F.pmod(F.xxhash64("doc_id", "digest"), F.col("splits")))
    columns = ["bucket", "split", "splits", "doc_id", "digest", "start", "words"]
    judged = stored(dealt.select(*columns).groupBy("bucket", "split", "splits").applyInArrow(_judge(window), ddl(JUDGED)), "substring-spans")
    holders = judged.filter("window is not null").withColumn("least", F.min("doc_id").over(Window.partitionBy("window")))
    late = holders.filter("doc_id > least")
    return judged.filter("window is null").unionByName(late.drop("least")).select("doc_id", "digest", "start", "n")


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 2 << 20):
            cols: dict[str, list] = {f.name: [] for f in KEPT}
            for doc_id, text, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                words = text.split()
                stay = words
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["n"] + window - 1] -= 1
                    stay = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                for name, value in zip(cols, (doc_id, len(words), len(words) - len(stay), b" ".join(stay).decode()), strict=True):
                    cols[name].append(value)
            yield batch(KEPT, **cols)

    return run


def repeats_removed(docs: DataFrame, window: int = WINDOW, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): the words that no repeated window covers, joined by single spaces.

    Texts that lose nothing stay where they are: a bounded filter picks those that may meet their spans.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("digest"), F.encode("text", "UTF-8").alias("text"))
    spans = repeated_spans(rows, window, bucket_windows).distinct().groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    spans = stored(spans, "substring-lost")
    told = marked(rows, "doc_id", spans.select("doc_id"), "lineproof_asked")
    asked = told.filter("lineproof_asked").join(spans, ["doc_id", "digest"], "left").select("doc_id", "text", "spans")
    same = told.filter("not lineproof_asked").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return asked.unionByName(same).mapInArrow(_kept(window), ddl(KEPT))
