"""External answers applied to notices: translations, repairs, interpretations, reviews; requests that ask for them.

Answers come as tables keyed by what was asked. Nothing is called but through a callable that the caller gives.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineproof.functions import english as E
from lineproof.functions import literals as V
from lineproof.functions import text as X
from lineproof.functions import verdicts as J
from lineproof.operators import audits as A
from lineproof.operators import facts as T
from lineproof.operators import lines as L
from lineproof.operators.joins import dealt, grown, sized
from lineproof.operators.once import judged_once

HANGUL = "[가-힣ᄀ-ᇿ㄰-㆏]"
REPAIR_BATCH = 40
READINGS = 10_000


def evidence_lines(text: Column) -> Column:
    return F.filter(F.transform(X.lines(text), L.solid), lambda x: x != "")


def evidence_matches(evidence: Column, page: Column) -> Column:
    """Whether a page holds a quote: one line anywhere, several as whole lines, each as often as quoted."""
    need, have = evidence_lines(evidence), evidence_lines(page)
    times = lambda all_lines, x: F.size(F.filter(all_lines, lambda y: y == x))
    several = F.forall(F.array_distinct(need), lambda x: times(have, x) >= times(need, x))
    return F.when(F.size(need) == 0, False).when(F.size(need) == 1, F.contains(L.solid(page), F.get(need, F.lit(0)))).otherwise(several)


def combined_evidence(first: Column, second: Column) -> Column:
    """The lines of two quotes in order, each once; a line inside another is dropped for it."""
    keyed = F.filter(F.transform(F.concat(X.lines(first), X.lines(second)), lambda x: F.struct(F.trim(x).alias("line"), X.comparison_key(x).alias("key"))), lambda x: x["line"] != "")
    keys = F.transform(keyed, lambda x: x["key"])
    once = F.filter(keyed, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    whole = F.filter(once, lambda x: ~F.exists(once, lambda y: (y["key"] != x["key"]) & F.contains(y["key"], x["key"])))
    return F.array_join(F.transform(whole, lambda x: x["line"]), "\n")


def collective_losses(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, evidence, lost) of quotes whose items together lack a printed phrase. items: (keys, evidence, text)."""
    told = items.filter("evidence <> ''").groupBy(*keys, "evidence").agg(F.array_join(F.array_sort(F.collect_list("text")), " | ").alias("told"))
    return told.withColumn("lost", J.lost_phrases(F.col("evidence"), F.col("told"))).filter("size(lost) > 0").select(*keys, "evidence", "lost")


def grounded_items(items: DataFrame, facts: DataFrame, pages: DataFrame) -> DataFrame:
    """(notice_id, item_id, fact_ids, state) of the items whose quote stands in their notice.

    Facts out of the source go; an item keeps those of its facts whose text holds its quote or lies in it. Without one it
    takes a fact of the same text, else a new one, numbered behind the notice's facts in the order of the items. An item
    whose facts changed needs review. items: (notice_id, item_id, evidence, fact_ids, state), facts: (notice_id, fact_id long, text).
    """
    text = pages.select("notice_id", F.col("text").alias("page"))
    held = items.join(text, "notice_id").filter(evidence_matches(F.col("evidence"), F.col("page"))).drop("page").withColumn("key", L.solid(F.col("evidence")))
    known = facts.join(text, "notice_id").filter(evidence_matches(F.col("text"), F.col("page"))).select("notice_id", "fact_id", L.solid(F.col("text")).alias("fact_key"))
    listed = known.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "fact_key"))).alias("known"))
    last = facts.groupBy("notice_id").agg(F.max("fact_id").alias("last"))
    told = held.join(listed, "notice_id", "left").join(last, "notice_id", "left").withColumn("known", F.coalesce("known", F.array().cast(listed.schema["known"].dataType)))
    touches = lambda f: F.contains(f["fact_key"], F.col("key")) | F.contains(F.col("key"), f["fact_key"])
    own = F.filter("fact_ids", lambda i: F.exists("known", lambda f: (f["fact_id"] == i) & touches(f)))
    same = F.transform(F.filter("known", lambda f: f["fact_key"] == F.col("key")), lambda f: f["fact_id"])
    told = told.withColumn("own", own).withColumn("same", same).withColumn("new", (F.size("own") == 0) & (F.size("same") == 0))
    first = F.row_number().over(Window.partitionBy("notice_id").orderBy(~F.col("new"), "item_id"))
    ids = F.when(F.size("own") > 0, F.array_distinct("own")).when(~F.col("new"), F.col("same")).otherwise(F.array(F.coalesce("last", F.lit(0).cast("long")) + first))
    state = F.when((F.col("own") != F.col("fact_ids")) | F.col("new"), "needs_review").otherwise(F.col("state"))
    return told.select("notice_id", "item_id", ids.alias("fact_ids"), state.alias("state"))


def updated_snapshots(current: DataFrame, updates: DataFrame, key: str, kept: list[str], changed: list[str]) -> DataFrame:
    """One row a key after updates: kept columns never change, changed ones only where the update has a value; the digest is new."""
    u = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in changed], F.lit(True).alias("touched"))
    new = {c: F.coalesce(f"new_{c}", c) for c in changed}
    digest = F.md5(F.concat_ws("\n", *[new[c].cast("string") for c in changed]))
    return current.join(u, key, "left").select(key, *kept, *[v.alias(c) for c, v in new.items()], digest.alias("digest"), F.coalesce("touched", F.lit(False)).alias("touched"))


def request_rows(units: DataFrame, key: str, order: list[str], text: str, context: Column) -> DataFrame:
    """(key, request): a notice's units in order as one JSON request; units to be answered have aliases U000, ..., context has none."""
    place = F.row_number().over(Window.partitionBy(key, "context").orderBy(*order)) - 1
    told = units.withColumn("context", context).withColumn("alias", F.when(~F.col("context"), F.format_string("U%03d", place)))
    listed = F.array_sort(F.collect_list(F.struct(*order, "context", "alias", F.col(text).alias("text"))))
    asked = F.transform(F.filter(listed, lambda u: ~u["context"]), lambda u: F.struct(u["alias"].alias("alias"), u["text"].alias("text")))
    near = F.transform(F.filter(listed, lambda u: u["context"]), lambda u: u["text"])
    return told.groupBy(key).agg(F.to_json(F.struct(asked.alias("units"), near.alias("read_only_context"))).alias("request"))


INTERPRETATION = "items array<struct<kind: string, text: string, source_unit_ids: array<string>>>"


def interpreted(requests: DataFrame, key: str, interpret: Callable[[dict], dict]) -> DataFrame:
    """(key, kind, text, source_unit_ids) of the answers of a callable that runs on the executors; answers out of shape give no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "answer": [json.dumps(interpret(json.loads(r))) for r in f["request"]]})

    kind = requests.schema[key].dataType.simpleString()
    told = requests.select(key, "request").mapInPandas(run, f"{key} {kind}, answer string")
    return told.select(key, F.from_json("answer", INTERPRETATION)["items"].alias("items")).select(key, F.inline("items"))


def recognised(images: DataFrame, key: str, recognise: Callable[[bytes], list[dict]]) -> DataFrame:
    """(key, ord, text, score, box) of what a callable reads from each image on the executors; an image at a time.

    Readings leave in frames of at least READINGS rows: a frame an image costs more than most readings.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "ord", "text", "score", "box"]
        held = []
        for f in frames:
            for k, image in zip(f[key], f["content"], strict=True):
                held += [(k, i, u["text"], float(u["score"]), u["box"]) for i, u in enumerate(recognise(bytes(image or b"")) or ())]
                if len(held) >= READINGS:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=columns)

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "content").mapInPandas(run, f"{key} {kind}, ord int, text string, score double, box array<int>")


def repaired_fields(fields: DataFrame, answers: DataFrame, key: str, order: list[str], batch: int = REPAIR_BATCH) -> DataFrame:
    """(key, order..., batch, text) of display fields after repair in batches of a notice: a batch counts only if each of its ids has
    exactly one answer, not empty and in English. fields: (key, order..., field_id, text), answers: (key, field_id, english)."""
    n = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / batch).cast("int")
    asked = fields.withColumn("batch", n)
    told = answers.groupBy(key, "field_id").agg(F.count(F.lit(1)).alias("n"), F.first("english").alias("english"))
    met = asked.join(told, [key, "field_id"], "left")
    fine = F.coalesce((F.col("n") == 1) & (F.trim("english") != "") & ~F.col("english").rlike(HANGUL), F.lit(False))
    whole = F.min(fine.cast("int")).over(Window.partitionBy(key, "batch")) == 1
    return met.select(key, *order, "batch", F.when(whole, F.trim("english")).otherwise(F.col("text")).alias("text"), whole.alias("repaired"))


def translated_blocks(blocks: DataFrame, answers: DataFrame, most: int = 480, scratch=None) -> DataFrame:
    """(other columns of blocks, notice_id, block, status, english, issues) of blocks of source text.

    Closed forms and texts without Hangul are told locally. Others go in chunks of at most that many bytes, each distinct
    chunk once; answers (chunk_id, text, error) count if single, whole and without Hangul, and if the values that the
    chunk and then the block protect stand in the English. What fails falls back to a labelled reading. blocks:
    (notice_id, block, text, certain). All this follows from the text, so blocks of equal text are told once.
    """
    texts = blocks.select("text", "certain").distinct()
    told = _translated_texts(scratch(texts) if scratch else texts, answers, most).select(F.col("text").alias("asked"), F.col("certain").alias("sure"), "status", "english", "issues")
    if scratch:
        told = scratch(told)
    met = blocks.join(sized(told, told.count()) if scratch else grown(told), F.col("text").eqNullSafe(F.col("asked")) & F.col("certain").eqNullSafe(F.col("sure")))
    return met.select(*[c for c in blocks.columns if c not in ("text", "certain")], "status", "english", "issues")


def _translated_texts(texts: DataFrame, answers: DataFrame, most: int) -> DataFrame:
    """(text, certain, status, english, issues) of distinct texts."""
    local = F.coalesce(F.when(~F.col("text").rlike(HANGUL), F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("Image detail: see the original crop."))), J.closed_cell(F.col("text")))
    told = texts.withColumn("local", local)
    asked = told.filter("local is null").select("text").distinct()
    chunks = asked.select("text", F.posexplode(A.chunks_of(F.col("text"), most)).alias("place", "chunk")).withColumn("chunk_id", F.sha2("chunk", 256))
    reply = answers.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("answer"), F.max(F.col("error").cast("int")).alias("error"))
    fine = F.coalesce((F.col("n") == 1) & (F.col("error") == 0) & (F.trim("answer") != "") & ~F.col("answer").rlike(HANGUL), F.lit(False))
    # A distinct chunk is checked once, whatever the number of places that share it.
    checked = chunks.select("chunk_id", "chunk").distinct().join(grown(reply), "chunk_id", "left").withColumn("fine", fine)
    checked = checked.withColumn("issues", F.when(F.col("fine"), E.pair_issues(F.col("chunk"), F.col("answer"))).otherwise(F.array(F.lit("incomplete translation chunk"))))
    checked = checked.select("chunk_id", "issues", F.when(F.size("issues") == 0, F.trim("answer")).alias("piece"))
    parts = F.array_sort(F.collect_list(F.struct("place", "piece", "issues")))
    pieces = chunks.select("text", "place", "chunk_id").join(grown(checked), "chunk_id").groupBy("text").agg(parts.alias("parts"))
    joined = F.array_join(F.array_compact(F.transform("parts", lambda p: p["piece"])), "\n")
    met = told.join(grown(pieces), "text", "left").withColumn("joined", F.coalesce(joined, F.lit(""))).withColumn("lost", F.flatten(F.transform("parts", lambda p: p["issues"])))
    whole = F.when((F.size("lost") == 0) & F.col("local").isNull(), E.pair_issues(F.col("text"), F.col("joined"))).otherwise(F.array().cast("array<string>"))
    met = met.withColumn("whole", whole).withColumn("issues", F.array_distinct(F.concat(F.coalesce("lost", F.array().cast("array<string>")), "whole")))
    reading = F.when(F.size("whole") > 0, "").otherwise(F.col("joined"))
    partial = lambda shown: F.concat(F.lit("Partial English reading: "), shown, F.lit("\n"), J.fallback_text(F.col("text")))
    fallback = F.when(reading != "", partial(reading)).otherwise(J.fallback_text(F.col("text")))
    shown = F.when(F.col("local").isNotNull(), F.col("local")).when(F.size("issues") > 0, fallback).otherwise(F.col("joined"))
    blank = F.trim("text") == ""
    failed = (F.size("issues") > 0) | blank
    status = F.when(failed | ~F.col("certain"), "source_crop").otherwise("translated")
    english = F.when(~failed & ~F.col("certain"), partial(shown)).otherwise(shown)
    return met.select("text", "certain", status.alias("status"), english.alias("english"), "issues")


def applied_repairs(units: DataFrame, details: DataFrame, represented: DataFrame, blocked: DataFrame) -> DataFrame:
    """(notice_id, unit, state) after a coverage repair: detailed, represented, or unverified.

    A unit is detailed if a detail without an issue cites it, represented if it is listed, cited, of one clause, and its cited English holds its
    values, spending rules and conditions; all else is unverified, as is what is blocked, listed twice or not at all.
    units: (notice_id, unit, text, cited), details: (notice_id, detail, units array, text, certain, category), represented: (notice_id, unit), blocked: (notice_id, unit).
    """
    key = ["notice_id", "unit"]
    each = details.select("notice_id", "detail", F.posexplode("units").alias("at", "unit"))
    texts = grown(each).join(units, key).groupBy("notice_id", "detail").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("sources"), F.bool_and(F.col("cited") != "").alias("all_cited"))
    stopped = grown(each).join(blocked, key, "left_semi").select("notice_id", "detail").distinct().withColumn("stopped", F.lit(True))
    told = details.join(grown(texts), ["notice_id", "detail"]).join(grown(stopped), ["notice_id", "detail"], "left")
    issue = E.detail_issue(F.col("sources"), F.col("text"), F.col("certain"), F.col("category"), F.array().cast("array<string>"), F.col("text"), F.col("all_cited"))
    judged = judged_once(told.filter("stopped is null"), ["sources", "text", "certain", "category", "all_cited"], issue, "issue")
    good = judged.filter("issue is null").select("notice_id", F.explode("units").alias("unit")).distinct().withColumn("detailed", F.lit(True))
    listed = each.select(*key).unionByName(represented.select(*key)).groupBy(*key).agg(F.count(F.lit(1)).alias("times"))
    complete = (F.size(V.missing_values(F.col("text"), F.col("cited"))) == 0) & (F.size(E.missing_spending(F.col("text"), F.col("cited"))) == 0) & (F.size(E.missing_conditions(F.col("text"), F.col("cited"))) == 0)
    shown = units.join(grown(represented.select(*key).distinct()), key, "left_semi").filter("cited <> ''")
    whole = judged_once(shown, ["text", "cited"], ~F.col("text").rlike(E.SEVERAL_CLAUSES) & complete, "whole").filter("whole").select(*key, "whole").distinct()
    met = units.join(grown(good), key, "left").join(grown(whole), key, "left").join(grown(blocked.select(*key).distinct().withColumn("blocked", F.lit(True))), key, "left").join(grown(listed), key, "left")
    state = F.when(F.col("blocked").isNotNull() | (F.col("times") > 1), "unverified").when(F.col("detailed"), "detailed").when(F.col("whole"), "represented").otherwise("unverified")
    return met.select(*key, state.alias("state"))


def applied_interpretation(units: DataFrame, items: DataFrame, scratch) -> tuple[DataFrame, DataFrame]:
    """((notice_id, item), (notice_id, unit, issue)): items that stand, and units that need another answer.

    An item stands if its units are distinct and known, on one page, its text is English and adds no value, and if every
    unit it cites is told whole by the items that cite it. A unit that fails takes all items that cite it along, and
    with them their other units, until nothing changes. units: (notice_id, unit, page, text), items: (notice_id, item, text, unit_ids array).

    Units and citations are dealt by notice, and what follows by unit or item needs no other exchange. Only notices with
    a failing unit that an item cites are followed further.
    """
    key, unit = ["notice_id", "unit"], F.struct("unit", F.col("text").alias("t"))
    once = F.array_distinct("unit_ids")
    cites = items.select("notice_id", F.explode(once).alias("unit"), "item", F.col("text").alias("told"), F.size("unit_ids").alias("named"), F.size(once).alias("n_named"))
    n = units.count()
    both = units.select(*key, "page", "text", F.lit(True).alias("asked")).unionByName(cites, allowMissingColumns=True)
    same = Window.partitionBy(*key)
    met = dealt(both, n, "notice_id").select(*key, "asked", "item", "told", "named", "n_named", F.count("asked").over(same).alias("known"), F.max("page").over(same).alias("page"), F.max("text").over(same).alias("text"))
    # A unit is a group of its own beside the items.
    groups = met.groupBy("notice_id", "item", F.when(F.col("asked"), F.col("unit")).alias("lone")).agg(
        F.sum("known").alias("known"), F.min("page").alias("page"), F.max("page").alias("last_page"), *[F.first(c).alias(c) for c in ("told", "named", "n_named")], F.array_sort(F.collect_list(F.when(F.col("known") > 0, unit))).alias("held"))
    fine = F.col("lone").isNull() & (F.col("known") == F.col("named")) & (F.col("n_named") == F.col("named")) & (F.col("page") == F.col("last_page")) & (F.trim("told") != "") & ~F.col("told").rlike(HANGUL)
    texts = lambda held: F.array_join(F.transform(held, lambda x: x["t"]), "\n")
    groups = scratch(groups.select("notice_id", "item", "lone", "held", F.when(fine, texts("held")).alias("source"), F.when(fine, F.col("told")).alias("told")))
    added = F.exists(E.unit_issues(F.col("source"), F.col("told")), lambda i: F.startswith(i, F.lit("unsupported")))
    standing = judged_once(groups, ["source", "told"], F.when(F.col("told").isNotNull(), added), "added", scratch).filter("lone is not null or not added")
    each = dealt(standing, n, "notice_id").select("notice_id", "item", "told", "held", F.explode(F.transform("held", lambda x: x["unit"])).alias("unit"))
    # A unit is judged with the whole context of the items that cite it.
    around = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("told").isNotNull(), F.col("held"))))))
    cited = each.groupBy(*key).agg(F.collect_set("item").alias("items"), F.array_sort(F.collect_set("told")).alias("english"), around.alias("around"))
    cited = cited.select(*key, "items", *[F.when(F.size("items") > 0, c).alias(n) for n, c in (("english", F.array_join("english", "\n")), ("source", texts("around")))])
    issues = F.when(F.col("english").isNull(), F.array(F.lit("no item"))).otherwise(E.unit_issues(F.col("source"), F.col("english")))
    judged = judged_once(cited, ["source", "english"], F.array_join(issues, " | "), "issue").select(*key, "items", F.coalesce("issue", F.lit("")).alias("issue"))
    failing = F.max((F.size("items") > 0) & (F.col("issue") != "")).over(Window.partitionBy("notice_id"))
    judged = scratch(judged.withColumn("failing", failing))
    line, item = F.struct(*key).alias("line"), F.struct("notice_id", "item").alias("item")
    graph = judged.filter("failing").withColumn("item", F.explode("items")).select(item, line)
    lost = T.contaminated(graph, judged.filter("issue <> '' and size(items) > 0").select(line), scratch)
    gone = grown(graph).join(lost, "line", "left_semi").select("item").distinct()
    kept = graph.select("item").distinct().join(grown(gone), "item", "left_anti").select("item.*")
    kept = kept.unionByName(judged.filter("not failing").select("notice_id", F.explode("items").alias("item")).distinct())
    tied = judged.filter("failing and issue = ''").select(line).join(grown(lost), "line", "left_semi").select("line.*", F.lit("replace the connected item").alias("issue"))
    return kept, judged.filter("issue <> ''").select(*key, "issue").unionByName(tied)


def reviewed(fields: DataFrame, verdicts: DataFrame, scratch=None) -> DataFrame:
    """(other columns of fields, notice_id, field_no, state): why a display field goes, or kept.

    Local rules come first: detached fragments, open lists, amounts and days without support, broken transliterations;
    then phrases that the fields left for a quote lack together; then a support verdict given exactly once. fields:
    (notice_id, field_no, field, label, evidence, text), verdicts: (notice_id, field_no, status). Fields and verdicts
    are dealt by notice once; all that follows by field or quote needs no other exchange and no join.
    """
    f = {c: F.col(c) for c in ("field", "label", "evidence", "text")}
    quoted = f["evidence"] != ""
    local = (
        F.when(E.detached_fragment(f["field"], f["label"], f["evidence"], f["text"]), "detached").when(E.open_list(f["text"], f["evidence"]), "open list")
        .when(quoted & (F.size(J.unsupported_values(f["text"], f["evidence"])) > 0), "unsupported amount").when(quoted & (F.size(E.unsupported_dates(f["text"], f["evidence"], always=False)) > 0), "unsupported date")
        .when(E.broken_transliteration(f["evidence"], f["text"], F.when(f["label"] != "", f["label"]).otherwise(f["field"])), "transliteration")
    )
    told = judged_once(fields, list(f), local, "local", scratch).drop("field", "label")
    both = told.withColumn("asked", F.lit(True)).unionByName(verdicts.select("notice_id", "field_no", F.col("status").alias("given")), allowMissingColumns=True)
    same = Window.partitionBy("notice_id", "field_no")
    fine = (F.count_if(F.col("asked").isNull()).over(same) == 1) & F.min("given").over(same).isin("supported", "unsupported")
    verdict = F.when(fine, F.min("given").over(same)).otherwise("insufficient")
    met = dealt(both, fields.count(), "notice_id").withColumn("verdict", verdict).filter("asked")
    rest = [c for c in told.columns if c not in ("notice_id", "evidence", "text", "local")]
    left = F.array_join(F.array_sort(F.collect_list(F.when(F.col("local").isNull(), F.col("text")))), " | ").alias("told")
    quotes = met.groupBy("notice_id", "evidence").agg(F.collect_list(F.struct(*rest, "local", "verdict")).alias("held"), left)
    # A quote without a mark holds no phrase.
    lost = F.coalesce(f["evidence"].rlike(J.PHRASE_MARK) & (F.size(J.lost_phrases(f["evidence"], F.col("told"))) > 0), F.lit(False))
    state = F.coalesce("local", F.when(F.col("lost"), "lost phrase"), F.when(F.col("verdict") != "supported", F.col("verdict")), F.lit("kept"))
    return quotes.select("notice_id", lost.alias("lost"), F.inline("held")).select("notice_id", *rest, state.alias("state"))


#: Words of payment and of support, and contacts that say nothing.
PAYABLE, SUPPORT, NO_CONTACT = "납부|부담|입금|납입|수수료|등록금|참가비", "연구비|활동비|장학금|지원금액", ["n/a", "none", "not provided"]


def moved_fees(items: DataFrame) -> DataFrame:
    """items with fees that are support moved to it and reworded; labels that name no topic get the common one."""
    support = (F.col("field") == "fees") & F.col("evidence").rlike(SUPPORT) & ~F.col("evidence").rlike(PAYABLE)
    text = F.regexp_replace(F.regexp_replace("text", r"(?i)\bResearch fee\b", "Research funding"), r"(?i)\bActivity fee\b", "Activity allowance")
    plain = (F.col("field") == "key_details") & F.lower(F.trim("label")).isin("key_details", "other")
    return items.withColumn("text", F.when(support, text).otherwise(F.col("text"))).withColumn("label", F.when(plain, "Other key details").otherwise(F.col("label"))).withColumn("field", F.when(support, "financial_support").otherwise(F.col("field")))


def evidenced(time: Column, phone: Column, email: Column, evidence: Column) -> Column:
    """struct(time, phone, email, state): what the quote does not print is emptied and needs review."""
    at = V.clock_minutes(time)
    good_time = (F.trim(time) == "") | ((F.size(at) > 0) & (F.size(F.array_except(at, V.clock_minutes(evidence))) == 0))
    none = lambda c: F.when(F.lower(F.trim(c)).isin(NO_CONTACT), "").otherwise(c)
    called, mailed = none(phone), none(email)
    good_phone = (called == "") | (F.size(F.array_except(F.map_keys(V.phones(called)), F.map_keys(V.phones(evidence)))) == 0) & (F.size(F.map_keys(V.phones(called))) > 0)
    good_mail = (mailed == "") | F.array_contains(V.emails(evidence), F.lower(mailed))
    state = F.when(good_time & good_phone & good_mail, "verified").otherwise("needs_review")
    shown = lambda good, c: F.when(good, c).otherwise("")
    return F.struct(shown(good_time, time).alias("time"), shown(good_phone, called).alias("phone"), shown(good_mail, mailed).alias("email"), state.alias("state"))


def required_documents(documents: DataFrame, actions: DataFrame) -> DataFrame:
    """(notice_id, name, required): an optional document becomes required where its own quote orders to submit it without an
    alternative and an action of the same quote lists it. documents: (notice_id, name, evidence, required), actions: (notice_id, evidence, items array)."""
    key = L.solid(F.col("evidence"))
    ordered = key.rlike("제출|필수|구비") & ~key.rlike("해당자|선택|가능|경우|한하여")
    asked = actions.select("notice_id", key.alias("key"), F.explode("items").alias("name")).select("notice_id", "key", X.spaced_key(F.col("name")).alias("named")).distinct().withColumn("listed", F.lit(True))
    told = documents.withColumn("key", key).withColumn("named", X.spaced_key(F.col("name"))).withColumn("ordered", ordered)
    return told.join(grown(asked), ["notice_id", "key", "named"], "left").select("notice_id", "name", (F.col("required") | (F.col("ordered") & F.coalesce("listed", F.lit(False)))).alias("required"))
