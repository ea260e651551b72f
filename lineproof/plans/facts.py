"""Queries over orders and lineitem as facts and items, and events as study answers, request log and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineproof.functions import text as X
from lineproof.operators import facts as A
from lineproof.operators.joins import dealt, grown
from lineproof.sources.scratch import stored
from lineproof.sources.views import table

URGENT = ["1-URGENT", "2-HIGH"]


def facts(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("notice_id"), F.col("o_orderkey").alias("fact_id"), F.col("o_orderpriority").isin(URGENT).alias("critical"))


def items(spark, sf):
    """Items cite the order of their row; every 97th cites one that does not exist."""
    cited = F.when(F.col("l_partkey") % 97 == 0, F.col("l_orderkey") + 10_000_000).otherwise(F.col("l_orderkey"))
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("notice_id"), cited.alias("fact_id"))


def j4_fact_references(spark, sf):
    return A.fact_references(facts(spark, sf), items(spark, sf))


def a3_fidelity(spark, sf):
    return A.fidelity(facts(spark, sf), items(spark, sf))


def j6_reconciled_responses(spark, sf):
    requests = table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"))
    responses = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("chunk_id"), F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_returnflag")).alias("text"), (F.col("l_discount") > 0.09).alias("error"))
    return A.reconciled(requests, responses, "chunk_id")


def p25_support_verdicts(spark, sf):
    e = table(spark, sf, "events")
    return A.verdicts(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), e.select("user_id", F.col("event_type").alias("status")), "user_id", ["click", "view"])


def a16_assignment_audit(spark, sf):
    li = table(spark, sf, "lineitem")
    return A.assignment_audit(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), li.select((F.col("l_partkey") + F.when(F.col("l_quantity") > 49, 1_000_000).otherwise(0)).alias("id"), F.col("l_returnflag").alias("list")), "id")


def u5_retry_sets(spark, sf):
    """Assignments outside the retry set stay; retry targets without an assignment become unresolved."""
    li = table(spark, sf, "lineitem")
    retry = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    n = li.count()
    asked, told = dealt(retry, n, "id"), dealt(li.select(F.col("l_orderkey").alias("id")), n, "id")
    kept = told.distinct().join(grown(asked), "id", "left_anti").withColumn("status", F.lit("kept"))
    lost = asked.join(grown(told), "id", "left_anti").withColumn("status", F.lit("unresolved"))
    return kept.unionByName(lost)


def u2_flattened_items(spark, sf):
    """A notice's fifteen collections as arrays of one row, flattened to items with their field."""
    held = F.array_sort(F.collect_list(F.struct("n", "text")))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.element_at(F.array(*map(F.lit, A.COLLECTIONS)), (F.col("l_partkey") % 15 + 1).cast("int")).alias("field"), F.col("l_linenumber").alias("n"), F.concat_ws("-", "l_returnflag", "l_suppkey").alias("text"))
    notices = li.groupBy("notice_id").pivot("field", list(A.COLLECTIONS)).agg(held)
    return A.flattened(notices, "notice_id").select("notice_id", "field", F.col("item.n").alias("n"), F.col("item.text").alias("text"))


def p23_templates(spark, sf):
    flag = F.col("l_returnflag")
    field = F.when(flag == "R", "actions").when(F.col("l_linestatus") == "O", "documents").when(F.col("l_quantity") > 45, "warnings").otherwise("information")
    return A.template_flags(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("notice_id"), field.alias("field")), "notice_id")


def f28_digest(spark, sf):
    """Sections in fixed order, lines in order within a section, one text a notice."""
    section = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("notice_id"), section.alias("s"), F.col("l_linenumber").alias("n"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("t"))
    each = rows.groupBy("notice_id", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "; ").alias("body"))
    return each.groupBy("notice_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "body"))), lambda x: F.concat(F.lit("["), x["s"].cast("string"), F.lit("] "), x["body"])), "\n").alias("digest"))


def k1_newest_notices(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


def w8_renumbered(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_discount > 0.02")
    cols = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")]
    return A.renumbered(li, "l_orderkey", *cols).select("l_orderkey", "l_linenumber", "l_partkey", "step")


def s8_latest_snapshot(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return A.latest(e, "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type", "value")


def s9_payload_lookup(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k")).filter("k < 10").orderBy(F.desc("event_id"))


def s10_study_rows(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("event_id")), lambda i: F.struct(i.alias("question_id")))).alias("answers"))


def s11_safe_csv(spark, sf):
    e = table(spark, sf, "events")
    cell = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("="), F.col("event_type"))).when(F.col("event_id") % 7 == 0, F.concat(F.lit("-"), F.col("event_type"))).otherwise(F.col("event_type"))
    return e.select("event_id", X.csv_safe(cell).alias("cell"))


def study(spark, sf):
    e = table(spark, sf, "events").withColumn("answer", F.when(F.col("event_type") != "error", F.col("value") > 10))
    return e.groupBy("user_id").agg(F.collect_list(F.struct("answer")).alias("a"), F.round(F.avg("value"), 4).alias("duration")).select("user_id", F.transform("a", lambda x: x["answer"]).alias("answers"), "duration")


def a4_study_metrics(spark, sf):
    return A.study_metrics(study(spark, sf)).select("user_id", "correct", "scored", "accuracy", "miss_rate")


def a5_study_rollup(spark, sf):
    e = table(spark, sf, "events").withColumn("condition", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("user_id") % 3 + 1).cast("int")))
    return e.rollup("condition", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.stddev("value"), 4).alias("sd_value"), F.countDistinct("user_id").alias("n_participants"))


def a6_acquisition(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("notice_id"), F.col("l_quantity").cast("long").alias("latency_ms"), F.lit(1).cast("long").alias("requests"), F.when(F.col("l_linenumber") != 5, F.col("l_partkey")).alias("tokens"), (F.col("l_returnflag") != "R").alias("complete"))
    return A.run_metrics(rows, "notice_id")


def a7_token_usage(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("run_id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") % 1000).alias("tokens"))
    return o.groupBy("run_id").agg(F.sum("tokens").alias("tokens"), F.bool_and(F.col("tokens").isNotNull() & (F.col("tokens") >= 0)).alias("complete"))


def a18_coverage_lists(spark, sf):
    """Ordered ids of each list and the distinct gap messages of the lines that fell back."""
    li = table(spark, sf, "lineitem")
    return A.coverage_lists(li, "l_orderkey", F.col("l_linenumber"), {"source": F.lit(True), "translated": F.col("l_linestatus") == "O", "fallback": F.col("l_returnflag") == "R"}, F.concat(F.lit("no reading of "), F.col("l_returnflag"), F.lit("-"), F.col("l_linestatus")), F.col("l_returnflag") == "R")


def w15_trailing_requests(spark, sf):
    return A.trailing_counts(table(spark, sf, "events"), "user_id", 3600, 6)


def w15b_active_requests(spark, sf):
    """Requests that run for as many minutes as their value says."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select("event_id", "user_id", at.alias("started"), (at + F.floor(F.col("value") * 60).cast("long") * 1_000_000).alias("ended"))
    return A.active_requests(rows, "user_id", 2)


def u3_group_closure(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (-F.col("l_partkey") - 1).alias("b"))
    return A.closure(edges, stored)


def j24_contamination(spark, sf):
    cites = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("line"))
    return A.contaminated(cites, cites.filter("line % 50 = 0"), stored)


def j26_context_expansion(spark, sf):
    """Units that share the block (order and flag) or the table (order and status) of a target, and the headings and conditions of its section."""
    u = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_partkey")
    u = u.withColumn("kind", F.when(F.col("l_suppkey") % 5 == 0, "heading").when(F.col("l_suppkey") % 5 == 1, "condition").otherwise("paragraph"))
    return A.expanded_context(u, u.filter("l_partkey % 40 = 0"), ["l_orderkey"], "l_returnflag", "l_linestatus").select("l_orderkey", "l_linenumber", "l_partkey").distinct()


def u4_batch_merge(spark, sf):
    o = table(spark, sf, "orders").withColumn("batch", F.col("o_orderkey") % 4)
    parts = [o.filter(F.col("batch") == i).select(F.concat(F.lit(f"batch-{i}-"), F.col("o_orderkey").cast("string")).alias("block_id"), (F.col("o_custkey") % 50).alias("ms")) for i in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(F.substring("block_id", 1, 8).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"), F.max("block_id").alias("last_block"))


def p13_page_quality(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 40).alias("width"), F.col("p_retailprice").alias("blur"), (F.col("p_size") * 5).alias("brightness"))
    issues = F.array_compact(F.array(F.when(F.col("width") < 900, "low resolution"), F.when(F.col("blur") < 1000, "blurred"), F.when(F.col("brightness") < 40, "dark"), F.when(F.col("brightness") > 230, "glare")))
    blocking = F.arrays_overlap(issues, F.array(F.lit("low resolution"), F.lit("dark")))
    return p.select("p_partkey", F.array_join(issues, ", ").alias("issues"), (~blocking).alias("readable"))


def c7_result(spark, sf):
    fid = A.fidelity(facts(spark, sf), items(spark, sf)).select("notice_id", "n_missing", "n_invented", "serious")
    flags = A.template_flags(table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("notice_id"), F.when(F.col("l_returnflag") == "R", "actions").otherwise("documents").alias("field")), "notice_id")
    return fid.join(flags.select("notice_id", "checklist", "step_flow"), "notice_id", "left")


def c10_display_records(spark, sf):
    e = table(spark, sf, "events")
    shown = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("last_view"))
    return e.select("user_id").distinct().join(shown, "user_id", "left").select("user_id", F.when(F.col("last_view").isNotNull(), "list,page").otherwise("list").alias("destinations"))


QUERIES = {f.__name__: f for f in (s8_latest_snapshot, s9_payload_lookup, s10_study_rows, s11_safe_csv, j4_fact_references, j6_reconciled_responses, j24_contamination, j26_context_expansion, p13_page_quality, p23_templates, p25_support_verdicts, a3_fidelity, a4_study_metrics, a5_study_rollup, a6_acquisition, a7_token_usage, a16_assignment_audit, a18_coverage_lists, w8_renumbered, w15_trailing_requests, w15b_active_requests, k1_newest_notices, u2_flattened_items, u3_group_closure, u4_batch_merge, u5_retry_sets, f28_digest, c7_result, c10_display_records)}

FACTS_SQL = """facts as (select o_orderkey % 500 as notice_id, o_orderkey as fact_id, o_orderpriority in ('1-URGENT', '2-HIGH') as critical from orders),
    items as (select l_orderkey % 500 as notice_id, case when l_partkey % 97 = 0 then l_orderkey + 10000000 else l_orderkey end as fact_id from lineitem),
    issues as (select notice_id, fact_id, 'missing' as issue from facts f where critical and not exists (select 1 from items i where i.notice_id = f.notice_id and i.fact_id = f.fact_id)
        union all select distinct notice_id, fact_id, 'invented' from items i where not exists (select 1 from facts f where i.notice_id = f.notice_id and i.fact_id = f.fact_id)),
    fid as (select coalesce(c.notice_id, i.notice_id) as notice_id, coalesce(n_facts, 0) as n_facts, coalesce(n_critical, 0) as n_critical, coalesce(n_missing, 0) as n_missing, coalesce(n_invented, 0) as n_invented
        from (select notice_id, count(*) as n_facts, count(*) filter (where critical) as n_critical from facts group by 1) c
        full join (select notice_id, count(*) filter (where issue = 'missing') as n_missing, count(*) filter (where issue = 'invented') as n_invented from issues group by 1) i on i.notice_id = c.notice_id)"""
SQL = {
    "s8_latest_snapshot": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "s9_payload_lookup": "select event_id, (props->>'k')::int as k from events where (props->>'k')::int < 10",
    "s10_study_rows": "select user_id, '[' || string_agg('{\"question_id\":' || event_id || '}', ',' order by event_id) || ']' as answers from events group by 1",
    "s11_safe_csv": "select event_id, case when event_id % 5 = 0 then '''=' || event_type when event_id % 7 = 0 then '''-' || event_type else event_type end as cell from events",
    "j4_fact_references": f"with {FACTS_SQL} select * from issues",
    "a3_fidelity": f"""with {FACTS_SQL} select *, concat_ws('; ', case when n_missing > 0 then n_missing || ' critical facts missing' end, case when n_invented > 0 then n_invented || ' references invented' end) as checks,
        n_missing > 0 or n_invented > 0 as serious from fid""",
    "j6_reconciled_responses": """with r as (select l_partkey as chunk_id, case when l_linenumber = 7 then '' else l_returnflag end as text, l_discount > 0.09 as error from lineitem),
        n as (select chunk_id, count(*) as n, min(text) as text, bool_or(error) as error from r group by 1)
        select p_partkey as chunk_id, coalesce(n, 0) as n_responses, case when n is null then 'missing' when n > 1 then 'repeated' when error then 'error' when trim(text) = '' then 'empty' else 'accepted' end as status from part left join n on chunk_id = p_partkey""",
    "j24_contamination": """with recursive c as (select l_orderkey as item, l_partkey as line from lineitem),
        r as (select line from c where line % 50 = 0 union select c2.line from r join c c1 on c1.line = r.line join c c2 on c2.item = c1.item) select distinct line from r""",
    "j26_context_expansion": """with t as (select * from lineitem where l_partkey % 40 = 0) select distinct l_orderkey, l_linenumber, l_partkey from lineitem u
        where exists (select 1 from t where t.l_orderkey = u.l_orderkey and (t.l_returnflag = u.l_returnflag or t.l_linestatus = u.l_linestatus or u.l_suppkey % 5 < 2))""",
    "p13_page_quality": """select p_partkey, concat_ws(', ', case when p_size * 40 < 900 then 'low resolution' end, case when p_retailprice < 1000 then 'blurred' end,
        case when p_size * 5 < 40 then 'dark' end, case when p_size * 5 > 230 then 'glare' end) as issues, not (p_size * 40 < 900 or p_size * 5 < 40) as readable from part""",
    "p23_templates": """with f as (select l_orderkey as notice_id, case when l_returnflag = 'R' then 'actions' when l_linestatus = 'O' then 'documents' when l_quantity > 45 then 'warnings' else 'information' end as field from lineitem),
        g as (select notice_id, count(*) filter (where field = 'documents') > 0 as checklist, count(*) filter (where field = 'actions') > 1 as step_flow, false as timeline, false as decision, count(*) filter (where field = 'warnings') > 0 as warnings from f group by 1)
        select *, not (checklist or step_flow or timeline or decision or warnings) as information from g""",
    "p25_support_verdicts": """with g as (select user_id, count(*) as n, min(event_type) as status from events group by 1)
        select c_custkey as user_id, case when n = 1 and status in ('click', 'view') then status else 'insufficient' end as status from customer left join g on user_id = c_custkey""",
    "a4_study_metrics": """with s as (select user_id, count(*) filter (where event_type <> 'error' and value > 10) as correct, count(*) filter (where event_type <> 'error' and value is not null) as scored from events group by 1)
        select user_id, correct::int as correct, scored::int as scored, round(case when scored > 0 then correct / scored end, 6) as accuracy, round(case when scored > 0 then 1 - correct / scored end, 6) as miss_rate from s""",
    "a5_study_rollup": """with e as (select *, case user_id % 3 when 0 then 'A' when 1 then 'B' else 'C' end as condition from events)
        select condition, event_type, count(*) as n, round(avg(value), 4) as mean_value, round(stddev(value), 4) as sd_value, count(distinct user_id) as n_participants from e group by rollup (condition, event_type)""",
    "a6_acquisition": """select l_orderkey as notice_id, sum(trunc(l_quantity)::bigint)::bigint as latency_ms, count(*) as requests, sum(case when l_linenumber <> 5 then l_partkey end)::bigint as tokens,
        bool_and(l_returnflag <> 'R' and l_linenumber <> 5) as complete from lineitem group by 1""",
    "a7_token_usage": "select o_custkey % 200 as run_id, sum(case when o_orderkey % 9 <> 0 then o_orderkey % 1000 end)::bigint as tokens, bool_and(o_orderkey % 9 <> 0) as complete from orders group by 1",
    "a16_assignment_audit": """with a as (select l_partkey + case when l_quantity > 49 then 1000000 else 0 end as id, l_returnflag as list from lineitem),
        n as (select id, count(*) as n, count(distinct list) as lists from a group by 1),
        j as (select coalesce(n.id, p_partkey) as id, case when p_partkey is null then 'unknown' when n is null then 'unassigned' when lists > 1 then 'overlap' when n > 1 then 'duplicate' end as issue from n full join part on p_partkey = n.id)
        select * from j where issue is not null""",
    "a18_coverage_lists": """select l_orderkey, coalesce(string_agg(distinct l_linenumber, ',' order by l_linenumber), '') as source, coalesce(string_agg(distinct l_linenumber, ',' order by l_linenumber) filter (where l_linestatus = 'O'), '') as translated,
        coalesce(string_agg(distinct l_linenumber, ',' order by l_linenumber) filter (where l_returnflag = 'R'), '') as fallback, coalesce(string_agg(distinct 'no reading of ' || l_returnflag || '-' || l_linestatus, '; ' order by 'no reading of ' || l_returnflag || '-' || l_linestatus) filter (where l_returnflag = 'R'), '') as gaps
        from lineitem group by 1""",
    "w8_renumbered": """select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)::int as step from lineitem where l_discount > 0.02""",
    "w15_trailing_requests": """with e as (select event_id, user_id, ts from events), n as (select *, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as n_recent from e)
        select event_id, user_id, n_recent, n_recent > 6 as over_rate from n""",
    "w15b_active_requests": """with r as (select event_id, user_id, epoch_us(ts) as a, epoch_us(ts) + floor(value * 60)::bigint * 1000000 as b from events)
        select x.event_id, x.user_id, count(*) as n_active, count(*) > 2 as over_active from r x join r y on x.user_id = y.user_id and (y.event_id = x.event_id or (y.a <= x.a and y.b > x.a)) group by 1, 2""",
    "k1_newest_notices": "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey",
    "u2_flattened_items": f"select l_orderkey as notice_id, ({list(A.COLLECTIONS)})[l_partkey % 15 + 1] as field, l_linenumber as n, l_returnflag || '-' || l_suppkey as text from lineitem",
    "u4_batch_merge": """select 'batch-' || (o_orderkey % 4) || '-' as batch, count(*) as n, sum(o_custkey % 50)::bigint as ms, max('batch-' || (o_orderkey % 4) || '-' || o_orderkey) as last_block from orders group by 1""",
    "u5_retry_sets": """with retry as (select o_orderkey as id from orders where o_orderpriority = '1-URGENT') select distinct l_orderkey as id, 'kept' as status from lineitem where l_orderkey not in (select id from retry)
        union all select id, 'unresolved' from retry where id not in (select l_orderkey from lineitem)""",
    "f28_digest": """with r as (select l_orderkey as notice_id, case l_returnflag when 'N' then 1 when 'A' then 2 else 3 end as s, l_linenumber as n, 'part ' || l_partkey as t from lineitem),
        e as (select notice_id, s, string_agg(t, '; ' order by n, t) as body from r group by 1, 2) select notice_id, string_agg('[' || s || '] ' || body, chr(10) order by s) as digest from e group by 1""",
    "c7_result": f"""with {FACTS_SQL}, t as (select l_orderkey % 500 as notice_id, count(*) filter (where l_returnflag <> 'R') > 0 as checklist, count(*) filter (where l_returnflag = 'R') > 1 as step_flow from lineitem group by 1)
        select fid.notice_id, n_missing, n_invented, n_missing > 0 or n_invented > 0 as serious, checklist, step_flow from fid left join t on t.notice_id = fid.notice_id""",
    "c10_display_records": "select user_id, case when bool_or(event_type = 'view') then 'list,page' else 'list' end as destinations from events group by 1",
}
