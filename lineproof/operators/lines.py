"""Line inventories, quotation joins, coverage audits, request plans over notices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineproof.functions import text as X

HAS_SIGN = r"[\p{L}\p{N}]"
LEAST_QUOTE = 8
#: File types that are read.
FILE_TYPES = [".png", ".jpg", ".jpeg", ".webp", ".pdf", ".txt"]


def source_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line): every trimmed line that holds a letter or digit, with its 0-based place."""
    return docs.select(key, F.posexplode(X.lines(F.col(text))).alias("pos", "line")).withColumn("line", F.trim("line")).filter(F.col("line").rlike(HAS_SIGN))


def line_inventory(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of each distinct line of a notice with its ordinal and id; one shuffle by notice serves both windows."""
    found = source_lines(docs, key).withColumn("line_key", X.comparison_key(F.col("line"))).repartition(key)
    first = found.withColumn("n", F.row_number().over(Window.partitionBy(key, "line_key").orderBy("pos"))).filter("n = 1")
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return first.withColumn("ordinal", ordinal).select(key, "ordinal", F.format_string("P001-L%04d", "ordinal").alias("line_id"), "pos", "line", "line_key")


def grams_of(text: Column, size: int) -> Column:
    """Distinct runs of size characters at every place of a text that has as many.

    One pass over the text: substring would look for each place from the text's start, which takes the square of its length.
    """
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))), F.array().cast("array<string>"))


def quoted_lines(inventory: DataFrame, quotes: DataFrame, quote: str = "text", least: int = LEAST_QUOTE) -> DataFrame:
    """Keys of lines that a quote holds: equal to one of its lines, or inside it from least characters on.

    Containment is an equi-join on the hash of a line's first characters, more of them for longer lines, with those of
    the quotes' runs of that size. Quotes travel by number; their texts meet the pairs that are left, for an exact test.
    """
    keys = inventory.select("line_key").distinct()
    equal = quotes.select(F.explode(X.lines(F.col(quote))).alias("q")).select(X.comparison_key(F.col("q")).alias("line_key")).distinct()
    whole = quotes.select(X.comparison_key(F.col(quote)).alias("quote_key")).filter(F.length("quote_key") >= least).distinct().withColumn("quote", F.xxhash64("quote_key"))
    sizes = [least, 3 * least]
    grams = whole.select("quote", F.explode(F.array_union(*[F.transform(grams_of(F.col("quote_key"), n), lambda g: F.xxhash64(g)) for n in sizes])).alias("gram"))
    head = F.when(F.length("line_key") >= sizes[1], F.substring("line_key", 1, sizes[1])).otherwise(F.substring("line_key", 1, least))
    near = keys.filter(F.length("line_key") >= least).withColumn("gram", F.xxhash64(head)).join(grams, "gram").select("line_key", "quote")
    inside = near.join(whole, "quote").filter(F.contains("quote_key", "line_key")).select("line_key")
    return keys.join(equal, "line_key", "left_semi").unionByName(inside).distinct()


def citation_coverage(docs: DataFrame, quotes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, total, covered, uncovered) over the distinct lines of each notice."""
    inventory = line_inventory(docs, key)
    hit = quoted_lines(inventory, quotes).withColumn("hit", F.lit(1))
    return inventory.join(hit, "line_key", "left").groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("covered"), (F.count(F.lit(1)) - F.count("hit")).alias("uncovered"))


def solid(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def contained_quotes(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(text_id, quote_id) pairs where text_key holds quote_key, both without white space, quotes not empty.

    A text is cut into blocks of half a length class of quotes; a quote of that class that it holds covers one of them
    whole, so blocks meet the quotes' runs of that size by hash. Quotes under eight characters meet every run of their
    own length. Ids alone travel; an exact test follows on the pairs that are left.
    """
    size = F.when(F.length("quote_key") >= 24, 12).when(F.length("quote_key") >= 8, 4).otherwise(F.length("quote_key"))
    sized = quotes.filter("quote_key <> ''").withColumn("size", size)
    held = sorted({(r.size, r.short) for r in sized.select("size", (F.length("quote_key") < 8).alias("short")).distinct().collect()})  # at most nine
    near = None
    for n, short in held:
        some = sized.filter((F.col("size") == n) & ((F.length("quote_key") < 8) == short))
        grams = some.select("quote_id", F.explode(grams_of(F.col("quote_key"), n)).alias("gram")).select("quote_id", F.xxhash64("gram").alias("gram"))
        blocks = grams_of(F.col("text_key"), n) if short else F.array_distinct(F.regexp_extract_all("text_key", F.lit(f"(?s)(.{{{n}}})"), F.lit(1)))
        met = texts.select("text_id", F.explode(blocks).alias("gram")).select("text_id", F.xxhash64("gram").alias("gram")).join(grams, "gram").select("text_id", "quote_id")
        near = met if near is None else near.unionByName(met)
    if near is None:
        return texts.join(quotes, F.lit(False)).select("text_id", "quote_id")
    return near.distinct().join(quotes, "quote_id").join(texts, "text_id").filter(F.contains("text_key", "quote_key")).select("text_id", "quote_id")


def evidence_pairs(docs: DataFrame, quotes: DataFrame, key: str = "doc_id", quote_id: str = "item_id") -> DataFrame:
    """(key, quote_id) pairs of a text and a quote that matches it, white space aside.

    A quote of one line lies anywhere in the text. A quote of several needs every line, as often as it has it, among the
    text's whole lines, wherever they stand. A quote without a sign matches nothing.
    """
    parts = F.filter(F.transform(X.lines(F.col("text")), solid), lambda x: x != "")
    q = quotes.select(F.col(quote_id).alias("quote_id"), parts.alias("parts"))
    texts = docs.select(F.col(key).alias("text_id"), solid(F.col("text")).alias("text_key"))
    single = contained_quotes(texts, q.filter(F.size("parts") == 1).select("quote_id", F.get("parts", F.lit(0)).alias("quote_key")).distinct())
    several = q.filter(F.size("parts") > 1).withColumn("whole", F.size(F.array_distinct("parts"))).select("quote_id", "whole", F.explode("parts").alias("line")).groupBy("quote_id", "whole", "line").agg(F.count(F.lit(1)).alias("need"))
    lines = docs.select(F.col(key).alias("text_id"), F.explode(parts).alias("line")).join(several.select("line").distinct(), "line", "left_semi").groupBy("text_id", "line").agg(F.count(F.lit(1)).alias("have"))
    every = lines.join(several, "line").filter("have >= need").groupBy("text_id", "quote_id", "whole").count().filter("count = whole").select("text_id", "quote_id")
    return single.unionByName(every).distinct().select(F.col("text_id").alias(key), F.col("quote_id").alias(quote_id))


def unquoted_lines(docs: DataFrame, quotes: DataFrame, most: int = 30, key: str = "doc_id") -> DataFrame:
    """The first lines of each notice that no quote holds, with their number in all."""
    inventory = line_inventory(docs, key)
    free = inventory.join(quoted_lines(inventory, quotes), "line_key", "left_anti")
    w = Window.partitionBy(key)
    return free.withColumn("rank", F.row_number().over(w.orderBy("ordinal"))).withColumn("in_all", F.count(F.lit(1)).over(w)).filter(F.col("rank") <= most).select(key, "rank", "line_id", "in_all")


def occurrence_ordinals(lines: DataFrame, *keys: str) -> DataFrame:
    """The k of the k-th copy of a value within its keys, by place."""
    return lines.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))


def attach_by_occurrence(lines: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every line with the span of the same text and occurrence, null where there is none."""
    left = occurrence_ordinals(lines, key, "line")
    right = occurrence_ordinals(spans, key, "line").select(key, "line", "k", F.col("pos").alias("span_pos"))
    return left.join(right, [key, "line", "k"], "left").select(key, "pos", "k", "span_pos")


def context_neighbours(lines: DataFrame, target: Column, blocked: Column, reach: int = 3, key: str = "doc_id") -> DataFrame:
    """Lines within reach of a target on their page that are neither targets nor blocked."""
    w = Window.partitionBy(key).orderBy("pos").rangeBetween(-reach, reach)
    told = lines.withColumn("target", target).withColumn("near", F.max(F.col("target").cast("int")).over(w))
    return told.filter((F.col("near") == 1) & ~F.col("target") & ~blocked).select(key, "pos")


def segments(docs: DataFrame, most: int = 20_000, key: str = "doc_id") -> DataFrame:
    """(key, piece, part): texts in pieces of at most that many characters; an empty text is one empty piece."""
    n = F.greatest(F.ceil(F.length("text") / F.lit(most)).cast("int"), F.lit(1))
    return docs.filter("text is not null").select(key, "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece")).select(key, "piece", F.substring("text", F.col("piece") * most + 1, F.lit(most)).alias("part"))


def accepted_texts(docs: DataFrame, most_bytes: int) -> DataFrame:
    """(key, status, n_bytes): BOM removed; invalid encoding, emptiness and size decide the status."""
    bare = F.regexp_replace("text", "^﻿", "")
    status = F.when(F.col("text").isNull() | (F.trim(bare) == ""), "empty").when(~F.is_valid_utf8("text"), "encoding").when(F.octet_length(bare) > most_bytes, "size").otherwise("accepted")
    return docs.select("doc_id", status.alias("status"), F.octet_length(bare).alias("n_bytes"))


def request_plan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each distinct line once: its hash, first notice and the number of places that share the answer."""
    found = source_lines(docs, key)
    return found.groupBy(F.sha2("line", 256).alias("chunk_id")).agg(F.min(key).alias("first_notice"), F.count(F.lit(1)).alias("n_places"), F.length(F.first("line")).alias("n_chars"))


def packed_batches(rows: DataFrame, size: Column, most_rows: int, most_size: int, key: str) -> DataFrame:
    """(key, pos, batch): greedy batches of each group's rows in the order of pos; one that would pass a cap opens the next.

    A group's rows come sorted, in slices of bounded size, through one task with a carry of three numbers; nothing of a
    group is held. Callers key by notice, whose rows are bounded.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, n, held = None, 0, 0, 0
        for f in frames:
            out = []
            for k, s in zip(f[key].tolist(), f["size"].tolist(), strict=True):
                if k != now:
                    now, batch, n, held = k, 0, 0, 0
                if n and (n >= most_rows or held + s > most_size):
                    batch, n, held = batch + 1, 0, 0
                n, held = n + 1, held + s
                out.append(batch)
            yield pd.DataFrame({key: f[key], "pos": f["pos"], "batch": out})

    sized = rows.select(key, "pos", size.cast("long").alias("size")).repartition(key).sortWithinPartitions(key, "pos")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return sized.mapInPandas(run, f"{key} {kind[key]}, pos {kind['pos']}, batch int")


def assembled_pages(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """One marked text a notice, pages in order, and how many pages are blank."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.trim(text), F.lit("")).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda s: F.concat(F.lit("[Page "), (s["p"] + 1).cast("string"), F.lit("]\n"), s["t"])), "\n")
    return pages.groupBy(key).agg(joined.alias("marked"), F.count_if(F.coalesce(F.trim(text), F.lit("")) == "").alias("n_blank"), F.count(F.lit(1)).alias("n_pages"))


def split_pages(marked: DataFrame, key: str, text: str = "marked") -> DataFrame:
    """(key, page, text) of a text with page markers at line starts; what stands before the first marker is left out."""
    pattern = F.lit(r"(?s)\[Page (\d+)\]\n(.*?)(?=\n\[Page \d+\]\n|\z)")
    pages = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("page"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("text"))
    return marked.select(key, F.inline(pages)).withColumn("page", F.col("page").cast("int"))


def web_links(rows: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose link is http(s), at most 2048 characters, without control characters or credentials."""
    c = F.col(url)
    fine = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(c, F.lit("HOST")).isNotNull()
    return rows.filter(fine & (F.length(c) <= 2048) & ~c.rlike(r"[\x00-\x20\x7f]") & F.try_parse_url(c, F.lit("USERINFO")).isNull())


def page_faults(marked: DataFrame, key: str, pages: Column | None = None, text: str = "marked") -> DataFrame:
    """(key, fault) of texts whose page markers cannot be trusted: text before the first, repeated, out of range, missing, out of order."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\[Page (\d+)\][ \t]*$"), F.lit(1)), lambda n: n.cast("int"))
    n = F.coalesce(pages, F.size("numbers")) if pages is not None else F.size("numbers")
    told = marked.withColumn("numbers", numbers).withColumn("n_pages_told", n)
    first = F.trim(F.element_at(F.split(text, r"(?m)^\[Page \d+\]", 2), 1))
    fault = (
        F.when(F.size("numbers") == 0, "no marker").when(first != "", "text before the first page").when(F.size(F.array_distinct("numbers")) < F.size("numbers"), "repeated page")
        .when(F.exists("numbers", lambda i: (i < 1) | (i > F.col("n_pages_told"))), "page out of range").when(F.size("numbers") < F.col("n_pages_told"), "missing page").when(F.array_sort("numbers") != F.col("numbers"), "out of order")
    )
    return told.select(key, fault.alias("fault"))
