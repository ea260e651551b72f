"""Fact references, fidelity, responses, assignments, snapshots, study and run metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineproof.operators.joins import grown, sized


def fact_references(facts: DataFrame, items: DataFrame) -> DataFrame:
    """(notice_id, fact_id, issue): critical facts that no item cites are missing, cited facts that do not exist invented."""
    missing = facts.filter("critical").join(items, ["notice_id", "fact_id"], "left_anti").select("notice_id", "fact_id", F.lit("missing").alias("issue"))
    invented = items.select("notice_id", "fact_id").distinct().join(facts, ["notice_id", "fact_id"], "left_anti").select("notice_id", "fact_id", F.lit("invented").alias("issue"))
    return missing.unionByName(invented)


def fidelity(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of facts, critical, missing and invented references of each notice, checks and the serious flag."""
    issues = fact_references(facts, items).groupBy("notice_id").agg(F.count_if(F.col("issue") == "missing").alias("n_missing"), F.count_if(F.col("issue") == "invented").alias("n_invented"))
    counts = facts.groupBy("notice_id").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if("critical").alias("n_critical"))
    both = counts.join(issues, "notice_id", "full_outer").na.fill(0)
    checks = F.array_compact(F.array(F.when(F.col("n_missing") > 0, F.concat(F.col("n_missing").cast("string"), F.lit(" critical facts missing"))), F.when(F.col("n_invented") > 0, F.concat(F.col("n_invented").cast("string"), F.lit(" references invented")))))
    return both.select("*", F.array_join(checks, "; ").alias("checks"), ((F.col("n_missing") > 0) | (F.col("n_invented") > 0)).alias("serious"))


def reconciled(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """(key, n_responses, status): a request needs exactly one response without error and with text; never deduplicated first."""
    r = responses.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"), F.max(F.col("error").cast("int")).alias("error"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("error") == 1, "error").when(F.trim("text") == "", "empty").otherwise("accepted")
    return requests.select(key).join(r, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_responses"), status.alias("status"))


def verdicts(expected: DataFrame, given: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Every expected id classified exactly once; anything else is insufficient."""
    g = given.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("status").alias("status"))
    fine = (F.col("n") == 1) & F.col("status").isin(allowed)
    return expected.select(key).join(g, key, "left").select(key, F.when(fine, F.col("status")).otherwise("insufficient").alias("status"))


def assignment_audit(expected: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """(key, issue) over the union of id lists: unknown, unassigned, repeated in one list, in several lists."""
    n = assigned.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("list").alias("lists"))
    issue = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "unassigned").when(F.col("lists") > 1, "overlap").when(F.col("n") > 1, "duplicate")
    both = n.join(expected.select(key).distinct().withColumn("known", F.lit(1)), key, "full_outer")
    return both.select(key, issue.alias("issue")).filter("issue is not null")


def latest(rows: DataFrame, key: str, *version: Column) -> DataFrame:
    """One row a key, of the highest version; the struct maximum needs no sort and combines before the shuffle."""
    whole = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(version)], F.struct(*rows.columns).alias("row"))
    return rows.groupBy(key).agg(F.max(whole).alias("m")).select("m.row.*")


def renumbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    return rows.withColumn("step", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def template_flags(items: DataFrame, key: str, override: str | None = None) -> DataFrame:
    """Presentation flags of each notice from the counts of its collections; an override decides where it is set."""
    n = lambda name: F.count_if(F.col("field") == name)
    flags = {"checklist": n("documents") > 0, "step_flow": n("actions") > 1, "timeline": n("deadlines") > 1, "decision": n("conditions") > 0, "warnings": n("warnings") > 0}
    return items.groupBy(key).agg(*[c.alias(k) for k, c in flags.items()]).withColumn("information", ~(F.col("checklist") | F.col("step_flow") | F.col("timeline") | F.col("decision") | F.col("warnings")))


def run_metrics(rows: DataFrame, key: str) -> DataFrame:
    """Latency, requests and nullable tokens of each notice; complete only if every stage is and gave its tokens."""
    fine = F.col("complete") & F.col("tokens").isNotNull() & (F.coalesce("tokens", F.lit(-1)) >= 0)
    return rows.groupBy(key).agg(F.sum("latency_ms").alias("latency_ms"), F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"), F.bool_and(fine).alias("complete"))


def study_metrics(responses: DataFrame) -> DataFrame:
    """Correct and scored answers, accuracy and miss rate; null where nothing was scored. answers: array of booleans."""
    scored = F.filter("answers", lambda a: a.isNotNull())
    right = F.size(F.filter(scored, lambda a: a))
    accuracy = F.when(F.size(scored) > 0, right / F.size(scored))
    return responses.select("*", right.alias("correct"), F.size(scored).alias("scored"), F.round(accuracy, 6).alias("accuracy"), F.round(1 - accuracy, 6).alias("miss_rate"))


def trailing_counts(events: DataFrame, key: str, seconds: int = 60, most: int = 6) -> DataFrame:
    """Starts of a key in the last seconds, this one included, and whether they pass the rate."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    n = F.count(F.lit(1)).over(w)
    return events.select("event_id", key, n.alias("n_recent"), (n > most).alias("over_rate"))


def closure(edges: DataFrame, scratch) -> DataFrame:
    """(node, component): smallest node reachable. edges: (a, b); scratch cuts the lineage of a table each round.

    In a round each node points to its smallest neighbour or itself, pointers are followed to their ends, and edges are
    drawn between these ends alone; so rows moved fall from round to round. The pointers of all rounds, one behind the
    other, lead to the component.
    """
    edges, rounds = edges.select("a", "b").filter("a is not null and b is not null"), []
    while not rounds or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = scratch(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")))
        while True:
            after = grown(ends).join(grown(ends.select(F.col("a").alias("c"), F.col("c").alias("next"))), "c").select("a", F.col("next").alias("c"), (F.col("next") != F.col("c")).alias("moved"))
            after = scratch(after)
            ends = after.select("a", "c")
            if after.filter("moved").isEmpty():
                break
        rounds.append(ends)
        drawn = edges.join(grown(ends.select("a", F.col("c").alias("ca"))), "a").join(grown(ends.select(F.col("a").alias("b"), F.col("c").alias("cb"))), "b").filter("ca <> cb")
        edges = scratch(drawn.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    found = rounds.pop()
    while rounds:
        found = rounds.pop().join(grown(found.select(F.col("a").alias("c"), F.col("c").alias("next"))), "c", "left").select("a", F.coalesce("next", "c").alias("c"))
    return found.select(F.col("a").alias("node"), F.col("c").alias("component"))


def contaminated(cites: DataFrame, unverified: DataFrame, scratch) -> DataFrame:
    """Lines reached from unverified lines through items that cite them. cites: (item, line).

    Each round follows only what the one before it found: new lines reach new items, those reach new lines, and the
    table of reached items and lines is asked once for each new one. The rows moved fall with the frontier, so a long
    chain costs its length in small rounds, not in scans of all that is seen. scratch cuts the lineage of a round.
    """
    fresh = scratch(unverified.select("line").distinct())
    parts, items = [fresh], []
    while n := fresh.count():
        found = cites.join(sized(fresh, n), "line", "left_semi").select("item").distinct()
        for seen in items:
            found = grown(found).join(seen, "item", "left_anti")
        found = scratch(found)
        items = [*items, found] if len(items) < FRONTIERS else [scratch(reduce(DataFrame.unionByName, [*items, found]))]
        fresh = cites.join(sized(found, found.count()), "item", "left_semi").select("line").distinct()
        for seen in parts:
            fresh = grown(fresh).join(seen, "line", "left_anti")
        fresh = scratch(fresh)
        parts = [*parts, fresh] if len(parts) < FRONTIERS else [scratch(reduce(DataFrame.unionByName, [*parts, fresh]))]
    return reduce(DataFrame.unionByName, parts)


def active_requests(requests: DataFrame, key: str, most: int = 2, slice_seconds: int = 86_400) -> DataFrame:
    """(event_id, key, n_active, over_active): how many requests of a key run when one starts, itself included.

    requests: (event_id, key, started, ended) in microseconds; one that ends as another starts runs no more, one that
    ends no later than it starts runs at no time but counts itself. A sweep over starts and ends: each key is cut into
    slices of time, the slices' totals run up as carries, and inside a slice the changes do; so a task sorts one slice of
    a key, however many requests the key has.
    """
    width = slice_seconds * 1_000_000
    change = F.explode(F.array(F.struct(F.col("started").alias("at"), F.lit(1).alias("n"), F.col("event_id").alias("start")), F.struct(F.col("ended").alias("at"), F.lit(-1).alias("n"), F.lit(None).cast("long").alias("start"))))
    runs = F.col("ended") > F.col("started")
    changes = requests.filter(runs).select(key, change.alias("c")).select(key, "c.*")
    alone = requests.filter(~runs).select(key, F.col("started").alias("at"), F.lit(0).alias("n"), F.col("event_id").alias("start"))
    rows = changes.unionByName(alone).withColumn("slice", F.floor(F.col("at") / width))
    totals = rows.groupBy(key, "slice").agg(F.sum("n").alias("net"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "slice", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("carry"))
    # Starts of one moment see each other; ends come first.
    upto = Window.partitionBy(key, "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("inside", F.sum("n").over(upto)).filter("start is not null").join(carried, [key, "slice"])
    n = F.col("carry") + F.col("inside") + F.when(F.col("n") == 0, 1).otherwise(0)
    return swept.select(F.col("start").alias("event_id"), key, n.cast("long").alias("n_active"), (n > most).alias("over_active"))


#: Frontiers held apart before they become one table.
FRONTIERS = 8
#: The collections of a notice that hold grounded items, in their fixed order.
COLLECTIONS = ("audience", "eligibility", "exceptions", "warnings", "consequences", "locations", "fees", "financial_support", "links", "key_details", "actions", "deadlines", "required_documents", "contacts", "conditional_groups")


def flattened(notices: DataFrame, key: str, collections: tuple[str, ...] = COLLECTIONS) -> DataFrame:
    """(key, field, item): every item of every collection of a notice; one pass over the arrays, no union of scans."""
    named = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("items")) for c in collections])
    return notices.select(key, F.inline(named)).select(key, "field", F.explode("items").alias("item"))


def coverage_lists(units: DataFrame, key: str, unit: Column, lists: dict[str, Column], message: Column, gap: Column) -> DataFrame:
    """The ordered distinct ids of each list as texts, and the distinct messages of the units that are gaps."""
    text = lambda c, sep: F.array_join(F.array_sort(F.collect_set(c)), sep)
    ids = {name: F.array_join(F.transform(F.array_sort(F.collect_set(F.when(test, unit))), lambda i: i.cast("string")), ",") for name, test in lists.items()}
    return units.groupBy(key).agg(*[c.alias(name) for name, c in ids.items()], text(F.when(gap, message), "; ").alias("gaps"))


def expanded_context(units: DataFrame, targets: DataFrame, section: list[str], block: str, tabled: str) -> DataFrame:
    """Units of a target's block or table within its section, and the section's headings and conditions; one shuffle by section."""
    told = targets.groupBy(*section).agg(F.collect_set(block).alias("blocks"), F.collect_set(tabled).alias("tables"))
    near = F.array_contains("blocks", F.col(block)) | F.array_contains("tables", F.col(tabled)) | F.col("kind").isin("heading", "condition")
    return units.join(told, section).filter(near).drop("blocks", "tables")
