"""MinHash near-duplicate detection by chosen-path set similarity join.

Every document becomes the set of its word shingles. Equal sets form one class first, so copies cost one row each.
Classes then enter TREES independent random trees. A node of a tree selects one minwise coordinate (a second one with
probability 1/threshold - 1, so that a pair at the threshold keeps one common child on average) and a class goes to the
child of its minwise token there, to DEPTH. Nodes of at most NODE_ROWS classes are compared whole. Larger ones are first
cut in blocks, each with the node's shared leaders, which connects most of a group of near copies; then every two blocks
that hold a pair not connected by then are compared, so a task never holds many more than NODE_ROWS classes and all
pairs of a node meet.

Within a node the classes connected by estimated similarities above a margin under the threshold form a list. A list is
compared on the full shingle sets: each pair is confirmed, refuted, or already connected by confirmed links, so a group
of n near copies gives n - 1 links and no pair is left out. Components come from minimum-label propagation with pointer
jumping; nothing is collected.

At the threshold a pair survives a tree of depth 3 with probability 0.70 (0.64 at 0.80). As the trees share one sketch,
the average over sketches counts: 10 trees miss it with 2.5e-5 (1.0e-4 at 0.80), a pair above the threshold more rarely.

Defined cases: null or blank texts have the empty set, link with nothing and keep themselves; texts with fewer words
than a shingle have one shingle, the whole sequence; a null doc_id gives null component and kept; rows that share a
doc_id are one document, linked with all that any of its texts is linked with; ties do not arise (smallest doc_id wins);
other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineproof.llm.mph import mix
from lineproof.llm.shared import batch, marked, sliced, stored

WORDS, NUMERATOR = 3, 85
TREES = 10
DEPTH = 3
COORDINATES = 128
NODE_ROWS = 2048
LEADERS = 64
#: A pair at the threshold is estimated lower by more than this with probability under 1e-5.
MARGIN = 0.17
#: Shingles of the sets that one task holds at once; heavier lists are cut in blocks of which all pairs are compared.
LIST_SHINGLES = 1 << 20
WORD_CACHE = 120_000
SIGNATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("nodes", pa.list_(pa.int64())), ("sketch", pa.binary())])
SIGNATURES_DDL = "doc_id long, n_shingles long, set_hi long, set_lo long, nodes array<long>, sketch binary"
ODD = np.random.default_rng(20240101).integers(0, 2**63, (2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; word hashes are cached up to a bound."""

    def __init__(self, words: int):
        import xxhash

        self.words, self.hash = words, xxhash.xxh3_64_intdigest
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(self.cache) > WORD_CACHE:
            self.cache = {}
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = self.hash(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        span = min(self.words, len(h))
        with np.errstate(over="ignore"):
            total = mix(h[: len(h) - span + 1] + np.uint64(span))
            for i in range(1, span):
                total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - span + 1 + i])
        return np.unique(total)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minwise values; long sets go in parts so that memory stays bounded."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            np.minimum(low, (shingles[at : at + 4096, None] * ODD[0] + ODD[1]).min(0), out=low)
    return low


def leaves(mins: np.ndarray, trees: int, depth: int, second: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of the nodes at a depth that each row of minwise values reaches in each tree."""
    rows = np.repeat(np.arange(len(mins)), trees)
    with np.errstate(over="ignore"):
        node = mix(np.tile(np.arange(1, trees + 1, dtype=np.uint64), len(mins)) * np.uint64(0xD1342543DE82EF95))
        for _ in range(depth):
            r = mix(node + np.uint64(17))
            first = (r % np.uint64(COORDINATES)).astype(np.int64)
            other = ((r >> np.uint64(20)) % np.uint64(COORDINATES)).astype(np.int64)
            both = ((r >> np.uint64(40)) / 2.0**24 < second) & (other != first)
            parent, rows = np.concatenate([node, node[both]]), np.concatenate([rows, rows[both]])
            chosen = np.concatenate([first, other[both]])
            node = mix(parent * np.uint64(0x9E3779B97F4A7C15) + mix(mins[rows, chosen] + chosen.astype(np.uint64)))
    return rows, node


def digests_of(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits a set, as two integers."""
    import xxhash

    return np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8") for s in sets]).reshape(-1, 2).astype(np.int64)


def _signatures(words: int, trees: int, second: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in sliced(batches, "text", 1 << 20):
            sets = [shingle(t) for t in b["text"].to_pylist()]
            digests = digests_of(sets)
            mins = np.array([minwise(s) for s in sets]).reshape(-1, COORDINATES)
            full = np.flatnonzero([len(s) > 0 for s in sets])
            rows, node = leaves(mins[full], trees, DEPTH, second)
            order = np.argsort(rows, kind="stable")
            counts = np.zeros(len(sets), np.int64)
            counts[full] = np.bincount(rows, minlength=len(full))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            nodes = pa.ListArray.from_arrays(pa.array(ends), pa.array(node[order].view(np.int64)))
            sketches = (mins >> np.uint64(48)).astype("<u2")
            yield batch(SIGNATURES, doc_id=b["doc_id"], n_shingles=[len(s) for s in sets], set_hi=digests[:, 0], set_lo=digests[:, 1], nodes=nodes, sketch=[x.tobytes() for x in sketches])

    return run


def cut_lists(members: np.ndarray, weights: np.ndarray, most: int) -> list[np.ndarray]:
    """Lists of about most weight in which every two members meet: all pairs of blocks where the whole is heavier."""
    place = np.cumsum(weights) // (most // 2)
    blocks = [members[place == k] for k in np.unique(place)]
    if len(blocks) < 3:
        return [members]
    return [np.sort(np.concatenate([x, y])) for i, x in enumerate(blocks) for y in blocks[i + 1 :]]


def _lists(threshold: float):
    """Members of a task that are connected by sketches above the margin; members of one component need no comparison."""

    def run(group: pa.Table) -> pa.Table:
        # A leader meets its own block's copy of itself once.
        ids, first = np.unique(group.column("cid").to_numpy(), return_index=True)
        raw = group.column("sketch").to_pylist()
        sketch = np.array([np.frombuffer(raw[i], "<u2") for i in first])
        known, weights = group.column("component").to_numpy()[first], group.column("n_shingles").to_numpy()[first]
        label = np.arange(len(ids))
        for i in range(len(ids) - 1):
            apart = np.flatnonzero((label[i + 1 :] != label[i]) & (known[i + 1 :] != known[i])) + i + 1
            for k in np.unique(label[apart[(sketch[apart] == sketch[i]).mean(1) >= threshold - MARGIN]]):
                label[label == k] = label[i]
        found = []
        for k in np.flatnonzero(np.bincount(label) > 1):
            found += cut_lists(ids[label == k], weights[label == k], LIST_SHINGLES)
        return pa.table({"members": pa.array([x.tolist() for x in found], pa.list_(pa.int64()))})

    return run


def _links(numerator: int):
    """Links that connect the members of a list: a pair is tested on full sets unless links or components connect it."""

    def run(group: pa.Table) -> pa.Table:
        ids, first = np.unique(group.column("cid").to_numpy(), return_index=True)
        raw = group.column("shingles").to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in first]
        label = np.unique(group.column("component").to_numpy()[first], return_inverse=True)[1]
        sizes = np.array([len(x) for x in sets])
        # The places of the shingles among those of the list, so that a lookup counts what two sets share.
        every, place = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(place, np.cumsum(sizes)[:-1])
        held = np.zeros(len(every), np.int64)
        left, right = [], []
        for i in range(len(ids) - 1):
            low, high = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
            apart = np.flatnonzero((label[i + 1 :] != label[i]) & (100 * low >= numerator * high)) + i + 1
            if not len(apart):
                continue
            held[own[i]] = 1
            both = np.add.reduceat(held[np.concatenate([own[j] for j in apart])], np.cumsum(sizes[apart]) - sizes[apart])
            held[own[i]] = 0
            for j in apart[100 * both >= numerator * (sizes[i] + sizes[apart] - both)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    left.append(ids[i])
                    right.append(ids[j])
        return pa.table({"a": left, "b": right}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cid", pa.int64()), ("shingles", pa.binary())])
        shingle = Shingler(words)
        for b in sliced(batches, "text", 1 << 20):
            yield batch(schema, cid=b["cid"], shingles=[shingle(t).tobytes() for t in b["text"].to_pylist()])

    return run


def nodes_of(classes: DataFrame) -> DataFrame:
    """(node, cid, count) of the nodes of two classes or more."""
    entries = stored(classes.select(F.explode("nodes").alias("node"), "cid"), "near-entries")
    return stored(entries.join(entries.groupBy("node").count().filter("count > 1"), "node"), "near-nodes")


def nodes_to_compare(nodes: DataFrame) -> DataFrame:
    """(node, cid): members of the nodes of up to NODE_ROWS classes, and of blocks of larger ones."""
    small, large = nodes.filter(F.col("count") <= NODE_ROWS), nodes.filter(F.col("count") > NODE_ROWS)
    blocks = F.ceil(F.col("count") / NODE_ROWS).cast("long")
    place = F.pmod(F.xxhash64("cid", "node"), blocks)
    # Leaders: about LEADERS members of least hash; each goes to every block of its node.
    leads = F.shiftrightunsigned(F.xxhash64("node", "cid", F.lit(5)), 40) * F.col("count") < float(LEADERS * 2**24)
    spread = F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(place)))
    return small.select("node", "cid").unionByName(large.select("node", "cid", spread.alias("block")).select(F.xxhash64("node", "block").alias("node"), "cid"))


def pairs_of_blocks(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, cid, component): tasks in which every two members of a large node meet that no link connects so far.

    The members outside the node's largest component form blocks, then those inside it. An outer block meets every
    block; two inner blocks hold nothing to compare.
    """
    told = stored(large.select("node", "cid").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "near-told")
    sizes = told.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("node").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("inside"), (F.sum("n") - F.max("n")).alias("outside"))
    each = max(1, NODE_ROWS // 2)
    outer, inner = F.ceil(F.col("outside") / each).cast("long"), F.ceil(F.col("inside") / each).cast("long")
    placed = told.join(main.filter("outside > 0"), "node").withColumn("outer", outer).withColumn("inner", inner)
    outsider, draw = F.col("component") != F.col("main"), F.xxhash64("cid", "node", F.lit(9))
    block = F.when(outsider, F.pmod(draw, F.col("outer"))).otherwise(F.col("outer") + F.pmod(draw, F.col("inner")))
    others = F.sequence(F.lit(0).cast("long"), F.col("outer") - 1 + F.when(outsider, F.col("inner")).otherwise(0))
    met = placed.withColumn("block", block).withColumn("other", F.explode(others))
    return met.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "cid", "component")


def components(links: DataFrame) -> DataFrame:
    """(cid, component) of every class with a link: minimum labels, halved paths, until nothing changes."""
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")), "near-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(seen, "a").select("a", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        lower = stored(lower, "near-labels")
        jump = lower.select(F.col("a").alias("component"), F.col("component").alias("next"))
        after = lower.join(jump, "component", "left").select("a", "was", F.coalesce("next", "component").alias("component"))
        after = stored(after, "near-labels")
        if after.filter("component <> was").isEmpty():
            return after.select(F.col("a").alias("cid"), "component")
        labels = after.select("a", "component")


def links_within(tasks: DataFrame, classes: DataFrame, docs: DataFrame, words: int, numerator: int) -> DataFrame:
    """Confirmed (a, b) links that connect what is linked within a task. tasks: (node, cid, component)."""
    sketched = tasks.join(classes.select("cid", "sketch", "n_shingles"), "cid")
    # Trees often hold the same members; a list of them is compared once.
    lists = sketched.groupBy("node").applyInArrow(_lists(numerator / 100), "members array<long>").distinct()
    listed = stored(lists.select(F.xxhash64("members").alias("list"), F.explode("members").alias("cid")), "near-lists")
    known = tasks.select("cid", "component").distinct()
    # Texts stay where they are: a bounded filter picks those needed, with a few more that no list asks for.
    texts = marked(docs.select(F.col("doc_id").cast("long").alias("cid"), "text"), "cid", listed.select("cid").distinct(), "needed").filter("needed")
    sets = stored(texts.select("cid", "text").mapInArrow(_sets(words), "cid long, shingles binary"), "near-sets")
    full = listed.join(known, "cid").join(sets, "cid")
    return stored(full.groupBy("list").applyInArrow(_links(numerator), "a long, b long").distinct(), "near-confirmed")


def labels_between(classes: DataFrame, docs: DataFrame, words: int, numerator: int) -> DataFrame:
    """(cid, component) of every class with a link."""
    nodes = nodes_of(classes)
    links = links_within(nodes_to_compare(nodes).withColumn("component", F.col("cid")), classes, docs, words, numerator)
    labels = components(links)
    large = nodes.filter(F.col("count") > NODE_ROWS)
    if large.isEmpty():
        return labels
    return components(links.unionByName(links_within(pairs_of_blocks(large, labels), classes, docs, words, numerator)))


def _keyed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("set_hi", pa.int64()), ("set_lo", pa.int64())])
        shingle = Shingler(words)
        for b in sliced(batches, "text", 1 << 20):
            digests = digests_of([shingle(t) for t in b["text"].to_pylist()])
            yield batch(schema, doc_id=b["doc_id"], text=b["text"], set_hi=digests[:, 0], set_lo=digests[:, 1])

    return run


#: Ids of single rows of documents with several sets lie from here on.
ROW_IDS = 1 << 62


def by_set(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """rows (doc_id, set_hi, set_lo, ...) with a column id: doc_id, or for documents in twice a number of the row's set."""
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "set_hi", "set_lo"), 2) + ROW_IDS
    return rows.join(twice.withColumn("several", F.lit(True)), "doc_id", "left").withColumn("id", F.when(F.col("several"), own).otherwise(F.col("doc_id"))).drop("several")


def united(found: DataFrame, twice: DataFrame) -> DataFrame:
    """found (doc_id, component, ...) with the components of the rows of one document made one."""
    links = found.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component").alias("b")).distinct()
    whole = components(links).select(F.col("cid").alias("component"), F.col("component").alias("wider"))
    return found.join(whole, "component", "left").withColumn("component", F.coalesce("wider", "component")).drop("wider")


def near_duplicates(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs; links need similarity >= numerator / 100."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signatures = stored(rows.mapInArrow(_signatures(words, trees, 100 / numerator - 1), SIGNATURES_DDL), "near-signatures")
    key = ["set_hi", "set_lo"]
    twice = stored(signatures.filter("doc_id is not null").select("doc_id", *key).distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id"), "near-twice")
    several = not twice.isEmpty()
    if several:
        signatures = by_set(signatures, twice)
        apart = rows.filter("doc_id is not null").join(twice, "doc_id", "left_semi").mapInArrow(_keyed(words), "doc_id long, text string, set_hi long, set_lo long")
        texts = rows.join(twice, "doc_id", "left_anti").unionByName(by_set(apart, twice).select(F.col("id").alias("doc_id"), "text"))
    else:
        signatures, texts = signatures.withColumn("id", F.col("doc_id")), rows
    linked = signatures.filter("id is not null and n_shingles > 0")
    classes = stored(linked.groupBy(*key).agg(F.min("id").alias("cid"), F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")), "near-classes")
    labels = labels_between(classes, texts, words, numerator)
    of_set = classes.select(*key, "cid").join(labels, "cid", "left").select(*key, F.coalesce("component", "cid").alias("component"))
    found = signatures.select("doc_id", "n_shingles", *key).join(of_set, key, "left")
    found = found.withColumn("component", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")))
    if several:
        found = united(stored(found, "near-found"), twice)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
