"""Substring dedup, lexical search and token alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lineproof.llm import alignment, lexical, queries, substrings

TEXTS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def brute_repeats(rows, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def passages(rng):
    """Texts that share passages of 49 to 120 words, near copies, copies, one repeated word and short texts."""
    word = lambda: f"w{rng.randrange(40)}" if rng.random() < 0.3 else f"v{rng.randrange(10**6)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 120)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(0, 150))]
        for p in shared:
            if rng.random() < 0.4:
                at = rng.randrange(len(text) + 1)
                text = text[:at] + p + text[at:]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    base = [word() for _ in range(300)]
    rows += [(100 + i, " ".join(base[:at] + ["x%d" % i] + base[at + 1 :])) for i, at in enumerate(range(5, 300, 12))]
    rows += [(200 + i, " ".join(base)) for i in range(20)] + [(300, "a " * 3000), (301, "a " * 49), (302, "a " * 2999), (50, rows[3][1]), (50, "other")]
    return rows


@pytest.mark.parametrize("bucket", [1 << 16, 64])
def test_repeats_removed(spark, docs, bucket):
    """Whole buckets, and buckets so small that nearly every one is split."""
    rows = [*passages(random.Random(4)), (None, None), (None, "a " * 60), (7, None), (8, ""), (9, " \n "), (10, "w" * 100_000)]
    rng = random.Random(5)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TEXTS)
    want = brute_repeats(rows, substrings.WINDOW)
    columns = ("doc_id", "n_words", "n_removed", "kept_text")
    got = sorted((tuple(r[c] for c in columns) for r in substrings.repeats_removed(df, bucket_windows=bucket).collect()), key=repr)
    assert got == want and sum(r[2] for r in want) > 5000
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("mini", "bucket", "split", "splits", "digest", "start", "n", "window", "spans", "words", "windows", "low", "high", "least", "lineproof_asked")])
    assert sorted((tuple(r[c] for c in columns) for r in substrings.repeats_removed(extra, bucket_windows=bucket).collect()), key=repr) == want
    assert substrings.repeats_removed(df.filter("false")).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    """With every hash equal, the words decide."""
    import numpy as np

    ids = np.array([1, 2, 3, 4, 1, 2, 3, 9], np.int64)
    places, doc = np.array([0, 1, 4, 5]), np.array([5, 5, 3, 3])
    monkeypatch.setattr(substrings, "mix", lambda x: np.zeros_like(x))
    assert substrings.window_order(ids, places, doc, 3).tolist() == [3, 5, 3, 3]


def brute_ranking(rows, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(d, Counter(cut(t))) for d, t in rows if d is not None and cut(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(cut(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, terms", [(1 << 20, 1 << 18), (300, 40)])
def test_ranking(spark, shard, terms):
    rng = random.Random(8)
    zipf = lambda: f"{'Té'[rng.randrange(2)]}{int(rng.paretovariate(0.6))}"
    rows = [(rng.randrange(3000), " ".join(zipf() for _ in range(rng.randrange(1, 60)))) for _ in range(900)]
    rows += [(5000 + i, "tie one two") for i in range(80)] + [(6000, "rare " * 300 + "one"), (6001, "RARE, one"), (1, None), (2, ""), (3, "-- !"), (None, "rare tie"), (7000, "x" * 100_000)]
    items = [(i, " ".join(zipf() for _ in range(12))) for i in range(25)] + [(30, "Tie"), (31, "rare rare one"), (32, None), (33, ""), (34, "absent"), (None, "tie"), (35, "one"), (35, "two")]
    docs, asked = spark.createDataFrame(rows, TEXTS), spark.createDataFrame(items, "item_id long, text string")
    found = lexical.search(docs, asked, 10, shard, terms)
    columns = ("item_id", "rank", "doc_id", "score")
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == brute_ranking(rows, items, 10)
    extra = [df.select("*", *[F.lit("x").alias(c) for c in ("shard", "term", "terms", "df", "rank", "score", "docs", "n_docs", "n_terms")]) for df in (docs, asked)]
    assert sorted(tuple(r[c] for c in columns) for r in lexical.search(*extra, 10, shard, terms).collect()) == brute_ranking(rows, items, 10)
    assert lexical.search(docs.filter("false"), asked).count() == 0 and lexical.search(docs, asked.filter("false")).count() == 0


def test_blocks_are_skipped(monkeypatch):
    """Documents with the rare term settle the heap; most blocks of the common term are never decoded."""
    docs = list(range(40 * lexical.RANGE))
    row = lexical.shard_row(0, docs, [[b"the", b"rare"] if d % 4096 == 7 else [b"the", b"other"] for d in docs]).to_pylist()[0]
    shard = lexical.Shard(row, {b"the", b"rare"}, len(docs), 2 * len(docs))
    ids, scores = shard.top([(b"the", 10), (b"rare", 5000)], 3)
    assert ids.tolist() == [7, 4103, 8199] and len(set(scores.tolist())) == 1
    assert len(shard.open) <= 6


def brute_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    signs = alignment.SIGN_BYTES
    told, corpus = [], Counter()
    for doc_id, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False), b.encode(text)) if text else (None, [])
        ids = x.ids if text else []
        spelt_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids]
        spelt_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        links, groups, at, ends = Counter(), [], [0, 0], [0, 0]
        if text and b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
            group = ([], [])
            while at[0] < len(ids) or at[1] < len(y):
                side = 0 if ends[0] <= ends[1] else 1
                seq, spelt = ((ids, spelt_a), (y, spelt_b))[side]
                group[side].append(seq[at[side]])
                ends[side] += len(spelt[at[side]])
                at[side] += 1
                if ends[0] == ends[1]:
                    groups.append(group)
                    links.update((i, j) for i in group[0] for j in group[1])
                    group = ([], [])
        else:
            ids, y = [], []
        corpus.update(set(links))
        told.append((doc_id, len(ids), len(y), groups, links))
    best = {}
    for (i, _), n in corpus.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, links in told:
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if corpus[p] == best[p[0]]), sum(n * corpus[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ODD = [
    (None, None), (None, "no id"), (1, ""), (2, " "), (3, "\n"), (4, "a  b\n\n c \n"), (5, "▁x"), (6, "<|endoftext|> <s></s> <unk><0x0A>"), (7, "é ﬁ　x\xa0y  z"), (8, "int x() {\r\n\treturn 1;\r\n}\r\n"), (9, "日本語のテキスト。 한국어 텍스트"),
    (10, "w" * 20_000), (11, "\x1c \x85 \x00 ​ x"), (12, "it's  we'll\n's 's"), (12, "it's  we'll\n's 's"), (13, "😀😀 Ünïcödé \t\t tab"), (14, " leading and trailing  "), (15, " x\x0b\x0cy"),
]


@pytest.mark.parametrize("sizes", [{}, {"shard_pairs": 50, "probe_pairs": 40, "fan": 2}])
def test_alignment(spark, docs, sizes, monkeypatch):
    rows = ODD + [(r.doc_id + 1000, r.text) for r in docs.limit(60).collect()]
    df = spark.createDataFrame(rows, TEXTS).repartition(9)
    want = brute_alignment(rows)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = sorted((tuple(r[c] for c in columns) for r in alignment.align_documents(df, **sizes).collect()), key=repr)
    assert got == want
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("number", "shard", "size", "rows", "keys", "times", "key", "best", "part", "splits")])
    assert sorted((tuple(r[c] for c in columns) for r in alignment.align_documents(extra, **sizes).collect()), key=repr) == want
    assert alignment.align_documents(df.filter("false")).count() == 0
    shown = {r.doc_id: hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in alignment.groups_of(df).collect() if r.doc_id is not None}
    assert all(shown[r[0]] == r[-1] for r in want if r[0] is not None)


def test_new_queries(spark, sf):
    for name, n in (("op11_substring_dedup", 200), ("op13_token_alignment", 200), ("op12_ranked_search", 2000)):
        assert queries.QUERIES[name](spark, sf).count() == n


def test_a_file_of_the_index_holds_few_shards(spark):
    """A reader holds the rows of a file together; before, all shards of a task lay in one."""
    docs = spark.createDataFrame([(i, f"word{i} and more words") for i in range(60)], "doc_id long, text string").coalesce(1)
    found = lexical.index(docs, 8)
    rows = found.groupBy(F.input_file_name()).count().collect()
    assert found.count() == 30 and max(r["count"] for r in rows) <= lexical.FILE_SHARDS
