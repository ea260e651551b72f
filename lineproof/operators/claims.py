"""Claims held against each other: exact repetitions folded into one fact, score claims by label, page quality from metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineproof.functions import english as E
from lineproof.functions import text as X
from lineproof.operators import responses as R

KEY = ["notice_id", "item"]


def folded_facts(facts: DataFrame) -> DataFrame:
    """(notice_id, item, field, page, text, evidence, fact_ids, state, image, has_box, n) of the facts that stay.

    facts: (notice_id, item, field, rank, page, text, evidence, fact_ids array, repair boolean, state, image); rank and
    then item order them. A fact without page or ids stays as it is. Primary facts fold into the first of their page and
    field with the same English and quote; one without a quote stays. A repair folds into the first primary of its page with the same English,
    else into the first repair of its field. What stays joins the quotes and ids of all, is verified only if all are,
    names an image only if all do the same, and keeps its box only if nothing was folded into it. Equal quotes meet before a
    fact's quotes are joined, so a fact repeated in very many rows holds its distinct quotes alone.
    """
    c = F.col
    by = lambda *columns: Window.partitionBy("notice_id", *columns)
    told = facts.filter("notice_id is not null").withColumn("told", X.spaced_key(c("text"))).withColumn("quote", X.folded_key(c("evidence")))
    # Places are numbers, so that what follows is compared and summed without structs; all of it meets by the notice.
    told = told.withColumn("at", F.dense_rank().over(by().orderBy("rank", "item")))
    able = F.coalesce(c("page").isNotNull() & (F.size("fact_ids") > 0), F.lit(False))
    # A fact that is able but does not say whether it is a repair takes no part.
    told = told.withColumn("able", able).filter("not able or repair is not null").withColumn("main", c("able") & ~c("repair")).withColumn("again", c("able") & c("repair"))
    exact = F.min(F.when(c("main"), c("at"))).over(by("page", "told", "field", "quote"))
    told = told.withColumn("into", F.when(c("main") & F.coalesce(c("quote") != "", F.lit(False)), exact).otherwise(c("at")))
    head = F.when(c("told").isNotNull(), F.min(F.when(c("main"), c("into"))).over(by("page", "told")))
    own = F.min(F.when(c("again"), c("at"))).over(by("page", "told", "field"))
    each = told.withColumn("into", F.when(c("again"), F.coalesce(head, own)).otherwise(c("into")))
    # A row for the quote of a fact and one for each of its ids; equal ones meet before a notice's are listed.
    quote = F.array(F.struct(F.lit(True).alias("quoted"), c("evidence"), F.lit(0).alias("i"), F.lit(None).cast(facts.schema["fact_ids"].dataType.elementType).alias("id")))
    ids = F.transform(F.coalesce("fact_ids", F.array().cast(facts.schema["fact_ids"].dataType)), lambda x, i: F.struct(F.lit(False).alias("quoted"), F.lit(None).cast("string").alias("evidence"), i.alias("i"), x.alias("id")))
    first = F.when(c("at") == c("into"), F.struct("item", "field", "page", "text", c("state").alias("was")))
    rows = each.select("notice_id", "into", "at", (c("state") == "verified").alias("fine"), "image", first.alias("first"), F.explode(F.concat(quote, ids)).alias("r"))
    rows = rows.select("notice_id", "into", "at", "fine", "image", F.when(c("r.quoted"), c("first")).alias("first"), "r.*")
    each = rows.groupBy("notice_id", "into", "quoted", "evidence", "id").agg(
        F.min(c("at").cast("long") * 2**31 + c("i")).alias("at"), F.count(F.lit(1)).alias("n"), F.bool_and("fine").alias("fine"), F.min("image").alias("low"), F.max("image").alias("high"), F.count("image").alias("imaged"), F.collect_list("first").alias("firsts"))
    q = lambda value: F.when(c("quoted"), value)
    listed = lambda test, value: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("at", value.alias("v"))))), lambda x: x["v"])
    met = each.groupBy("notice_id", "into").agg(
        listed(c("quoted"), c("evidence")).alias("quotes"), listed(~c("quoted"), c("id")).alias("fact_ids"), F.sum(q(c("n"))).alias("n"), F.bool_and(q(c("fine"))).alias("fine"),
        F.min(q(c("low"))).alias("low"), F.max(q(c("high"))).alias("high"), F.sum(q(c("imaged"))).alias("imaged"), F.flatten(F.collect_list("firsts")).alias("firsts"))
    kept = met.select("*", F.explode("firsts").alias("first")).select("*", "first.*")
    quotes = F.transform("quotes", lambda x: F.coalesce(x, F.lit("")))
    evidence = F.when(F.size("quotes") == 1, F.get(quotes, F.lit(0))).otherwise(F.aggregate(quotes, F.lit(""), lambda a, b: R.combined_evidence(a, b)))
    state = F.when(c("n") == 1, c("was")).when(c("fine"), "verified").otherwise("needs_review")
    image = F.when((c("low") == c("high")) & (c("imaged") == c("n")), c("low"))
    return kept.select(*KEY, "field", "page", "text", evidence.alias("evidence"), "fact_ids", state.alias("state"), image.alias("image"), (c("n") == 1).alias("has_box"), "n")


def score_tails(rows: DataFrame, text: str) -> DataFrame:
    """(notice_id, label, score) of the exams that a text names, distinct; score is null where none stands behind the name."""
    tail = F.explode(E.exam_tails(F.col(text))).alias("t")
    score = F.lower(F.regexp_extract("t.tail", E.SCORE, 1))
    return rows.select("notice_id", tail).select("notice_id", F.col("t.label").alias("label"), F.nullif(score, F.lit("")).alias("score")).distinct()


def score_claims(rows: DataFrame) -> DataFrame:
    """(notice_id, label, score, issue): scores of the source that the English does not give the same exam, and exams that only
    the English names. rows: (notice_id, source, english), any number a notice; each text is searched once, and all meets by the notice and the label."""
    sides = score_tails(rows, "source").withColumn("printed", F.lit(True)).unionByName(score_tails(rows, "english").withColumn("printed", F.lit(False)))
    each = sides.groupBy("notice_id", "label", "score").agg(F.bool_or("printed").alias("printed"), F.bool_or(~F.col("printed")).alias("told"))
    known = F.bool_or("printed").over(Window.partitionBy("notice_id", "label"))
    met = F.col("notice_id").isNotNull()  # texts without a notice meet no others
    lost = F.col("printed") & F.col("score").isNotNull() & ~(F.col("told") & met)
    added = F.col("told") & ~(F.col("known") & met)
    issues = F.array_compact(F.array(F.when(lost, "missing or changed"), F.when(added, "unsupported exam")))
    return each.withColumn("known", known).select("notice_id", "label", "score", F.explode(issues).alias("issue"))


#: Bounds of a readable photo. Each metric has a warning bound and, for the first three, a blocking one.
SHORTEST, BLUR, BRIGHTNESS, GLARE, SMALL, LARGE, MARGIN = (800, 400), (65, 25), (68, 40), (0.06, 0.30), (0.01, 0.12), 0.2, (4, 0.01)


def page_quality(pages: DataFrame) -> DataFrame:
    """pages with issues (array of codes in fixed order) and readable: no code blocks.

    pages: (width, height, blur, brightness, glare, coverage, box_x, box_y, box_w, box_h) besides others; a null metric raises no issue.
    """
    side = F.least("width", "height")
    under = lambda c, bounds, soft, hard: F.when(c < bounds[1], hard).when(c < bounds[0], soft)
    margin = F.greatest(F.lit(MARGIN[0]), F.floor(side * MARGIN[1]))
    touches = (F.col("box_x") <= margin) | (F.col("box_y") <= margin) | (F.col("box_x") + F.col("box_w") >= F.col("width") - margin) | (F.col("box_y") + F.col("box_h") >= F.col("height") - margin)
    inside = lambda c, bounds: (F.col(c) > bounds[0]) & (F.col(c) < bounds[1])
    issues = F.array_compact(F.array(
        under(side, SHORTEST, "low_resolution", "very_low_resolution"), under(F.col("blur"), BLUR, "blur", "severe_blur"), under(F.col("brightness"), BRIGHTNESS, "dark", "too_dark"),
        F.when(inside("glare", GLARE), "glare"), F.when(inside("coverage", SMALL), "notice_too_small"), F.when((F.col("coverage") > LARGE) & touches, "possible_cutoff"),
    ))
    return pages.withColumn("issues", issues).withColumn("readable", ~F.arrays_overlap("issues", F.array(F.lit("very_low_resolution"), F.lit("severe_blur"), F.lit("too_dark"))))
