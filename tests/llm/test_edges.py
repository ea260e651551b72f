"""Every training-data operator on nulls, repeated rows, long words and lines, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from lineproof.llm import ann, archive, bpe, langid, licenses, lines, neardup, packing, pii, topk

KEY = b"test"
LINE = "this very line stands in many documents"
TEXTS = [
    (None, None), (None, "no id here " + LINE), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, f"{LINE}\nx"), (5, f"{LINE}\nx"), (6, f"{LINE}\ny"), (7, f" {LINE.upper()} \nz"),
    (8, "w" * 200_000), (9, "long line of words " * 8_000), (10, "mail a.b@x.org\nReleased under the MIT License."), (10, "another text of ten"), (11, "12 34 ?!"),
]
#: Names that the operators use inside.
CLASHING = ["cid", "id", "row", "drops", "asked", "h", "fp", "shard", "salt", "n", "keys", "component", "node", "nodes", "block", "run", "grp", "piece", "moved", "s", "token", "new", "v", "dim", "model", "lineproof_at", "lineproof_page", "lineproof_drops", "lineproof_n", "digest", "short", "first_page", "whole", "lost", "several"]
GIVEN = ["kept_text", "n_lines", "n_dropped", "lang_pred", "lang_score", "n_entities"]
MODEL = langid.train([("en", "the of and"), ("fr", "le la et")])
OPERATORS = {
    "op1": neardup.near_duplicates, "op2": lines.dedup_lines, "op4": lambda d: langid.identify(d, MODEL), "op4 rows": lambda d: langid.identify_rows(d, MODEL), "op4 words": lambda d: langid.identify_words(d, MODEL),
    "op5": packing.pack, "op7": bpe.encode_documents, "op9": licenses.scan_documents, "op10": lambda d: pii.pseudonymise(d, KEY),
}


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, plain, name):
    found = OPERATORS[name](plain)
    got = rows(found, found.columns)
    if name != "op5":
        assert len(got) == len(TEXTS)
    extra = plain.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    again = OPERATORS[name](extra)
    assert rows(again, found.columns) == got
    if name in ("op2", "op4 rows", "op10"):
        assert set(CLASHING) < set(again.columns) and rows(again, CLASHING) == [("x",) * len(CLASHING)] * len(TEXTS)
        named = OPERATORS[name](plain.select("*", *[F.lit("x").alias(c) for c in GIVEN]))
        assert rows(named, found.columns) == got
    empty = OPERATORS[name](extra.filter("false"))
    assert empty.count() == 0 and set(found.columns) <= set(empty.columns)


def test_line_results(spark, plain):
    got = {(r.doc_id, r.text): (r.kept_text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(plain).collect()}
    assert got[5, f"{LINE}\nx"] == ("x", 2, 1) and got[6, f"{LINE}\ny"] == ("y", 2, 1) and got[7, f" {LINE.upper()} \nz"] == (f" {LINE.upper()} \nz", 2, 0)
    assert got[None, "no id here " + LINE] == ("no id here " + LINE, 1, 0) and got[1, None] == ("", 1, 0)


def test_hot_lines_are_split(spark, monkeypatch):
    texts = [f"{LINE}\nonly line of document number {i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lost = lines.dropped_lines(df, shard_rows=16)
    assert sorted(r.doc_id for r in lost.collect()) == list(range(299))
    assert lines.dropped_lines(df, min_docs=301, shard_rows=16).count() == 0


def test_rows_of_one_document_are_united(spark):
    a, b = "a b c d e f g h", "p q r s t u v w x"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (4, b), (9, b), (5, ""), (7, "z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7}
    tied = spark.createDataFrame([(5, a), (5, b), (6, b)], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(tied).collect()} == {5}


VECTORS = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (5, [1.0, 0.0]), (6, None), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [0.5, 9.0]), (10, []), (None, [1.0, 0.0]), (12, [float("inf"), 0.0]), (13, [0.0, 0.0]), (14, [1.0, 2.0, 3.0])]


@pytest.mark.parametrize("name", ["op6", "op8"])
def test_vectors(spark, name):
    search = {"op6": topk.top_k, "op8": ann.search}[name]
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    found = search(df)
    got = rows(found, ["query_id", "rank", "vec_id", "score"])
    unit = 1024 * 1024 if name == "op6" else 1.0
    zero = [(13, 0)] if name == "op6" else []
    want = [(5, unit), (100, unit), (100, unit), (9, unit / 2), *zero]
    assert [(v, s) for q, _, v, s in got if q == 0] == want
    assert {q for q, *_ in got} == {0, 100}
    extra = df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c != "run"])
    assert rows(search(extra), ["query_id", "rank", "vec_id", "score"]) == got
    assert search(extra.filter("false")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_pages(spark, version):
    given = [(None, "u", "x"), (1, "http://a/x y", "p\r\n\r\nq"), (1, "http://a/x y", "p\r\n\r\nq"), (2, None, None), (3, "", ""), (4, "filedesc://c", "p\r\n\r\nq"), (5, "u", "w" * 300_000), (6, "v", "1 0 x\nURL Archive-length\n")]
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    found = archive.archive_pages(df, version)
    got = rows(found, ["page_id", "record_type", "refers_to", "target_uri"])
    assert got == sorted([(1, "response", None, "http://a/x%20y"), (1, "revisit", 1, "http://a/x%20y"), (2, "response", None, "urn:page:2"), (3, "revisit", 2, ""), (4, "revisit", 1, "filedesc://c"), (5, "response", None, "u"), (6, "response", None, "v")], key=repr)
    extra = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    assert rows(archive.archive_pages(extra, version), ["page_id", "record_type", "refers_to", "target_uri"]) == got
    assert archive.archive_pages(extra.filter("false"), version).count() == 0


def test_texts_of_very_many_lines(spark):
    """Line work is linear in a text's lines: two texts of 40,000 lines, half of which a third document holds."""
    import time

    common = [f"a line that repeats in the corpus {i}" for i in range(20_000)]
    texts = ["\n".join(common + [f"a line of its own, document {d}, number {i}" for i in range(20_000)]) for d in range(2)] + ["\n".join(common)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines.dedup_lines(df.limit(1)).count()
    start = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.length("kept_text")).collect()}
    assert got == {0: (40_000, 20_000), 1: (40_000, 20_000), 2: (20_000, 0)}
    assert time.time() - start < 30
