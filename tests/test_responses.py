"""Answers applied to notices: edges that the case queries do not hold."""

from pyspark.sql import functions as F

from lineproof.functions import english as E
from lineproof.operators import lines as L
from lineproof.operators import responses as R


def test_page_faults_and_batches(spark):
    df = spark.createDataFrame([(1, "[Page 1]\na\n[Page 3]\nb"), (2, "[Page 1]\na\n[Page 2]\nb")], "conv_id int, marked string")
    got = {r.conv_id: r.fault for r in L.page_faults(df, "conv_id", F.lit(3)).collect()}
    assert got == {1: "missing page", 2: "missing page"}
    assert {r.fault for r in L.page_faults(df.filter("conv_id = 2"), "conv_id").collect()} == {None}
    units = spark.createDataFrame([(k, i, n) for k in (1, 2) for i, n in enumerate([5, 5, 20, 1, 1, 1, 1])], "k int, pos int, size int")
    got = {(r.k, r.pos): r.batch for r in L.packed_batches(units, F.col("size"), 3, 12, "k").collect()}
    assert [got[1, i] for i in range(7)] == [got[2, i] for i in range(7)] == [0, 0, 1, 2, 2, 2, 3]


def test_quotes_of_every_length(spark):
    docs = spark.createDataFrame([(1, "x abc d e f g hij klmn opq rst uvw"), (2, "other text"), (3, None), (4, "")], "doc_id int, text string")
    quotes = [(1, "a"), (2, "hijk"), (3, "abcdefgh"), (4, "abcdefghijklmnopqrstuvw"), (5, "xabcdefghijklmnopqrstuvw"), (6, "zz"), (7, ""), (8, None), (9, "other text\nother text")]
    found = L.evidence_pairs(docs, spark.createDataFrame(quotes, "item_id int, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, i) for i in range(1, 6)}
    assert L.evidence_pairs(docs, spark.createDataFrame([], "item_id int, text string")).count() == 0


def test_answers_out_of_shape_give_no_row(spark):
    requests = spark.createDataFrame([(1, '{"units": []}')], "k int, request string")
    assert R.interpreted(requests, "k", lambda r: {"other": 1}).count() == 0
    assert R.interpreted(requests, "k", lambda r: {"items": [{"kind": "a", "text": "b", "source_unit_ids": ["U000"]}]}).first().text == "b"
    images = spark.createDataFrame([(1, bytearray(b"ab")), (2, None)], "k int, content binary")
    got = R.recognised(images, "k", lambda image: [{"text": chr(c), "score": 1, "box": [0, 0, 1, 1]} for c in image]).collect()
    assert [(r.k, r.ord, r.text) for r in got] == [(1, 0, "a"), (1, 1, "b")]


def test_an_update_without_a_value_keeps_the_old_one(spark):
    now = spark.createDataFrame([(1, "d", "a", "b"), (2, "d", "x", "y")], "k int, made string, t string, s string")
    new = spark.createDataFrame([(1, None, "c"), (3, "n", "n")], "k int, t string, s string")
    got = {r.k: (r.made, r.t, r.s, r.touched) for r in R.updated_snapshots(now, new, "k", ["made"], ["t", "s"]).collect()}
    assert got == {1: ("d", "a", "c", True), 2: ("d", "x", "y", False)}


def test_long_blocks_are_told_by_chunks(spark):
    text = "\n".join(f"마루 {i} 이야기는 길고 또 길게 이어집니다 그렇습니다" for i in range(20))
    blocks = spark.createDataFrame([(1, 0, text, True), (2, 5, text, True)], "notice_id long, block int, text string, certain boolean")
    from lineproof.operators import audits as A

    parts = A.byte_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("piece").collect()
    numbers = lambda c: " ".join(w for w in c.split() if w.isdigit())
    answers = [(p.chunk, f"Story {numbers(p.chunk)}", False) for p in parts]
    frame = spark.createDataFrame(answers, "chunk string, text string, error boolean").select(F.sha2("chunk", 256).alias("chunk_id"), "text", "error")
    got = {r.notice_id: r for r in R.translated_blocks(blocks, frame).collect()}
    assert len(parts) > 2 and got[1].status == got[2].status == "translated" and got[1].english == got[2].english == "\n".join(a for _, a, _ in answers)
    part = R.translated_blocks(blocks.filter("notice_id = 1"), frame.limit(1)).first()
    assert part.status == "source_crop" and part.english.startswith("Partial English reading: Story")


def test_expansions_and_null_pairs(spark):
    cases = [
        ("Use the SSD or an SSD", "SSD\n(Solid State Drive)", "Use the SSD (Solid State Drive) or an SSD (Solid State Drive)"), (None, "SSD (Solid State Drive)", None), ("SSD", None, "SSD"), ("An SSD [fast]", "SSD (Solid State Drive)", "An SSD [fast]"),
        ("SSD and (solid state drive)", "SSD (Solid State Drive)", "SSD and (solid state drive)"), ("SSD (solid state drive)", "SSD (Solid State Drive)", "SSD (solid state drive)"), ("SSD, AI", "SSD (Solid State Drive) AI (Applied Ideas", "SSD (Solid State Drive), AI"),
    ]
    told = spark.createDataFrame(cases, "t string, e string, want string").select("want", E.expanded(F.col("t"), F.col("e")).alias("x")).collect()
    assert [r.x for r in told] == [r.want for r in told]
    df = spark.createDataFrame([(None, "x"), ("x", None), (None, None)], "s string, e string")
    assert df.select(E.unit_issues(F.col("s"), F.col("e")).alias("x")).count() == 3
