"""Audits and applications of responses: constraints, reconciliation, recovery, phrase location, chunks, references."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineproof.functions import text as X
from lineproof.operators import lines as L
from lineproof.operators.joins import dealt, grown


def inventory_violations(units: DataFrame, members: DataFrame) -> DataFrame:
    """(rule, key, detail): units listed twice, members of unknown units, units in more than one block."""
    n = max(units.count(), members.count())
    units, members = dealt(units, n, "unit_id"), dealt(members, n, "unit_id")
    twice = units.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated_unit").alias("rule"), F.col("unit_id").alias("key"), F.col("n").alias("detail"))
    held = members.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block_id").alias("blocks"))
    unknown = held.join(grown(units), "unit_id", "left_anti").select(F.lit("unknown_unit").alias("rule"), F.col("unit_id").alias("key"), F.col("n").alias("detail"))
    shared = held.filter("blocks > 1").select(F.lit("shared_unit").alias("rule"), F.col("unit_id").alias("key"), F.col("blocks").alias("detail"))
    return twice.unionByName(unknown).unionByName(shared)


def reconciled_units(units: DataFrame, responses: DataFrame) -> DataFrame:
    """Every unit with the state of its response: accepted only if single, with an unchanged source text and citing known units."""
    found = responses.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.first("source_text").alias("returned"))
    cites = responses.select("unit_id", F.explode("cited").alias("to")).distinct()
    wrong = cites.join(units.select(F.col("unit_id").alias("to")), "to", "left_anti").select("unit_id", F.lit(True).alias("wrong")).distinct()
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(~F.col("returned").eqNullSafe(F.col("source_text")), "changed").when(F.col("wrong"), "unknown citation").otherwise("accepted")
    return units.join(found, "unit_id", "left").join(wrong, "unit_id", "left").select("unit_id", state.alias("state"))


def recovered_candidates(units: DataFrame, text: str, alternates: str, usable: Callable[[Column], Column], least_share: int = 65) -> DataFrame:
    """The unit's text, or the clearest usable alternate (text, conf) of at least that share of its length; ties to the first."""
    fits = F.filter(alternates, lambda a: usable(a["text"]) & (F.length(a["text"]) * 100 >= F.length(F.col(text)) * least_share))
    ranked = F.array_sort(F.transform(fits, lambda a, i: F.struct((-a["conf"]).alias("c"), i.alias("i"), a["text"].alias("t"))))
    best = F.when(F.size(ranked) > 0, ranked[0]["t"])
    return units.withColumn("recovered", F.when(usable(F.col(text)), F.col(text)).otherwise(F.coalesce(best, F.col(text))))


def phrase_places(docs: DataFrame, phrases: DataFrame, words: int, key: str = "doc_id", phrase_id: str = "item_id") -> DataFrame:
    """(key, phrase_id, n_places): runs of that many words of a phrase at their places in a text, across line ends.

    Runs meet in an equi-join on their hash; equal runs are told from equal hashes afterwards.
    """

    def runs(rows: DataFrame, name: str) -> DataFrame:
        w = rows.select(name, F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("w")).filter(F.size("w") >= words)
        return w.select(name, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.array_join(F.slice("w", i, words), " "))).alias("place", "run"))

    known = runs(phrases, phrase_id).select(phrase_id, "run").distinct()
    found = runs(docs, key).join(known, "run")
    return found.groupBy(key, phrase_id).agg(F.count_distinct("place").alias("n_places"))


def folded_duplicates(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each distinct line of a page: its first place, its number of places, and whether all were supported."""
    return lines.groupBy(key, X.comparison_key(F.col("line")).alias("line_key")).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_places"), F.bool_and("supported").alias("supported"))


def reference_match(docs: DataFrame, references: DataFrame, head: int = 40) -> DataFrame:
    """Each text with the smallest reference that it equals, white space aside, or whose title or first characters it holds.

    references: (item_id, title, text). Equality is an equi-join on a digest of the key; titles and heads of any length
    meet the texts through blocks of their first characters.
    """
    key = lambda c: X.comparison_key(F.col(c))
    equal = docs.select("doc_id", F.sha2(key("text"), 256).alias("k")).join(references.filter(F.length(key("text")) > 0).select("item_id", F.sha2(key("text"), 256).alias("k")), "k").select("doc_id", "item_id")
    heads = F.array_compact(F.array(key("title"), F.when(F.length(key("text")) >= head, F.substring(key("text"), 1, head))))
    parts = references.select(F.col("item_id").alias("quote_id"), F.explode(heads).alias("quote_key"))
    inside = L.contained_quotes(docs.select(F.col("doc_id").alias("text_id"), key("text").alias("text_key")), parts)
    found = equal.unionByName(inside.select(F.col("text_id").alias("doc_id"), F.col("quote_id").alias("item_id"))).groupBy("doc_id").agg(F.min("item_id").alias("item_id"))
    return docs.select("doc_id").join(found, "doc_id", "left")


def cut(text: str, most: int) -> list[str]:
    """Pieces of at most that many UTF-8 bytes that join to the text: whole lines where they fit, then words, then characters; a character above the bound stays whole."""
    out, held, size = [], [], 0
    stack = text.splitlines(keepends=True)[::-1]
    while stack:
        part = stack.pop()
        n = len(part.encode("utf-8", "surrogatepass"))
        if n > most and len(part) > 1:
            words = re.findall(r" *[^ ]+ ?| +", part)
            stack.extend((words if len(words) > 1 else list(part))[::-1])
            continue
        if size and size + n > most:
            out.append("".join(held))
            held, size = [], 0
        held.append(part)
        size += n
    return out + (["".join(held)] if held else [])


def chunks_of(text: Column, most: int = 480) -> Column:
    """The chunks of a text, each of at most that many UTF-8 bytes; null and empty texts have none."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: list(cut(t or "", most))), "array<string>")(text)


def byte_chunks(docs: DataFrame, most: int = 480, key: str = "doc_id") -> DataFrame:
    """(key, piece, chunk): texts in chunks of at most that many UTF-8 bytes; null and empty texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(k, i, c) for k, t in zip(f[key], f["text"], strict=True) for i, c in enumerate(cut(t or "", most))]
            yield pd.DataFrame(found, columns=[key, "piece", "chunk"]).astype({key: "int64", "piece": "int32"})

    return docs.select(F.col(key).cast("long"), "text").mapInPandas(run, f"{key} long, piece int, chunk string")


def translated_chunks(chunks: DataFrame, translate: Callable[[list[str]], list[str]], most: int = 200) -> DataFrame:
    """(chunk_id, answer) of distinct chunks (chunk_id, chunk), given in lists of at most that many to a callable that travels to the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), most):
                part = f.iloc[i : i + most]
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "answer": translate(part["chunk"].tolist())})

    return chunks.select("chunk_id", "chunk").mapInPandas(run, "chunk_id string, answer string")


def catalog_order(rows: DataFrame, group: str, key: str = "notice_id") -> DataFrame:
    """Groups of a notice in the order of their first (page, ord), with aliases B000, B001, ..."""
    first = rows.groupBy(key, group).agg(F.min(F.struct("page", "ord")).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first", group))
    return first.select(key, group, F.format_string("B%03d", place - 1).alias("alias"))
