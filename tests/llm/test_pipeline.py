"""The pipeline's stages, each against a brute-force version on its own input."""

import corpus_pipeline as P
from lineproof.llm import langid, pii
from lineproof.llm.shared import stored
from tests.llm.test_operators import DOCS

KEY = "key of the tests"


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def without_repeated_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            if d is not None and len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(d)
    gone = lambda d, line: d is not None and len(held.get(key(line), ())) >= 3 and max(held[key(line)]) != d
    return {(d, "\n".join(x for x in (text or "").split("\n") if not gone(d, x))) for d, text, *_ in rows}


def groups_of_near_copies(rows):
    sets = {}
    for d, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    comp = {d: d for d in sets}

    def top(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for a, s in sets.items():
        both = {}
        for g in s:
            for b in holders[g]:
                both[b] = both.get(b, 0) + 1
        for b, n in both.items():
            if a < b and 100 * n >= 80 * (len(s) + len(sets[b]) - n):
                low, high = sorted((top(a), top(b)))
                comp[high] = low
    return {d: top(d) for d in sets}


def test_stages(spark, sf):
    spark.conf.set(pii.KEY_SETTING, KEY)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = stored(P.language(spark, docs, sf), "test")
    model = langid.train(langid.sample(docs))
    want = [r for r in docs.collect() for lang, score in model.predict([r.text or ""]) if lang != langid.UNKNOWN and score >= P.LEAST_SCORE]
    assert collected(told) == sorted((tuple(r) for r in want), key=repr) and told.columns == docs.columns

    lines = stored(P.line_dedup(spark, told, sf), "test")
    assert {(r.doc_id, r.text) for r in lines.collect()} == without_repeated_lines(collected(told))
    assert all(r.n_chars == len(r.text) for r in lines.collect()) and lines.columns == docs.columns

    near = stored(P.near_dedup(spark, lines, sf), "test")
    groups = groups_of_near_copies(collected(lines))
    assert len(set(groups.values())) < len(groups)
    assert {r.doc_id for r in near.collect()} == {d for d, c in groups.items() if d == c} and near.columns == docs.columns

    clean = stored(P.personal_data(spark, near, sf), "test")
    # No name stands in these documents, so a text's surrogates do not depend on other texts.
    assert not any(pii.name_tokens(r.text) for r in near.collect())
    assert {r.doc_id: r.text for r in clean.collect()} == {r.doc_id: pii.replaced(r.text, None, KEY.encode())[0] for r in near.collect()}

    packed = P.pack(spark, clean, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in clean.collect()}
    assert collected(packed.drop("sequence_id", "offset")) == collected(P.run(spark, sf).drop("sequence_id", "offset"))


def test_edges(spark, sf):
    """Nulls, blanks, repeated rows, long words, clashing columns and empty tables through all stages."""
    line = "this very line stands in many documents"
    given = [(None, None), (1, None), (2, ""), (3, " \n "), (4, "der und die"), (5, f"{line}\nthe of and"), (5, f"{line}\nthe of and"), (6, f"{line}\nthe of a"), (7, line), (8, "w" * 100_000), (9, "the of and to " * 9_000), (None, "the of and to in")]
    rows = [(d, t, "en", "s", len(t or ""), "x", "y") for d, t in given]
    docs = spark.createDataFrame(rows, DOCS + ", drops string, asked string")
    for name, stage in P.STAGES[:-1]:
        after = stored(stage(spark, docs, sf), "test")
        assert after.columns == docs.columns, name
        assert stage(spark, docs.filter("false"), sf).count() == 0
        docs = after
    kept = docs.collect()
    assert {r.doc_id for r in kept} >= {4, 9, None} and not {1, 2, 3} & {r.doc_id for r in kept} and all(r.drops == "x" for r in kept)
    assert P.pack(spark, docs, sf).count() >= len(kept)


def test_near_copies_are_caught(spark, sf):
    """Of the pairs of documents at five words and 0.8 or more, by brute force, none is left in two groups."""
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    groups = groups_of_near_copies([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    kept = {r.doc_id for r in P.near_dedup(spark, docs, sf).collect()}
    assert kept == {d for d, c in groups.items() if d == c}
