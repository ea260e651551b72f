"""Queries that stream the given tables; the SQL says what the batch form of each would return."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineproof.functions import text as X
from lineproof.streaming import notices as S

ANSWER_SECONDS, HOUR = 45, 3600


def events(spark, sf):
    return S.arriving(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def documents(spark, sf):
    return S.arriving(spark, f"{sf}/documents.parquet")


def st1_arrivals(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.size(X.lines(F.col("text"))).alias("n_lines"), (X.share_of(F.col("text"), "[À-ÿ]") >= 0.08).alias("appears"))
    return S.landed(rows).drop("batch")


def st2_latest_snapshots(spark, sf):
    return S.latest_snapshots(events(spark, sf), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


def st3_admission(spark, sf):
    """At most six starts of a user in any hour, so that the table holds refusals."""
    return S.admitted(events(spark, sf), "user_id", 6, HOUR)


def st3b_admission_with_release(spark, sf):
    """Six starts of a user in any twelve hours and two active ones; purchases release, a lease ends after eight hours."""
    rows = events(spark, sf).select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("release"))
    return S.admitted_with_release(rows, "user_id", 6, 12 * HOUR, 2, 8 * HOUR).drop("batch")


def st4_responses(spark, sf):
    """Every third event asks, the two after it answer where they are no views; those 45 s or later do not count."""
    asked = events(spark, sf).filter("event_id % 3 = 0").select(F.col("event_id").alias("request_id"), F.col("ts").alias("asked_at"))
    told = events(spark, sf).filter("event_id % 3 <> 0 and event_type <> 'view'").select((F.col("event_id") - F.col("event_id") % 3).alias("request_id"), F.col("ts").alias("told_at"))
    return S.correlated(asked, told, ANSWER_SECONDS).drop("batch")


def st5_requests(spark, sf):
    return S.requested_once(documents(spark, sf))


def st5b_requests_each_day(spark, sf):
    """Each kind of request of a user once a day."""
    chunk = F.concat_ws("-", "user_id", "event_type").alias("chunk_id")
    found = S.requested_each(events(spark, sf).select(chunk, "ts"), "chunk_id", "ts", "1 day")
    return found.select("chunk_id", F.date_format("start", "yyyy-MM-dd").alias("day"))


def st6_current_status(spark, sf):
    """Stages 1 to 3 by kind of event: the furthest that each user reached."""
    stage = lambda kind, n: events(spark, sf).filter(F.col("event_type") == kind).select("user_id", F.lit(n).alias("stage"))
    return S.current_status([stage("view", 1), stage("click", 2), stage("purchase", 3)], "user_id")


QUERIES = {f.__name__: f for f in (st1_arrivals, st2_latest_snapshots, st3_admission, st3b_admission_with_release, st4_responses, st5_requests, st5b_requests_each_day, st6_current_status)}
SQL = {
    "st1_arrivals": r"""with n as (select doc_id, text, length(regexp_replace(text, '[^À-ÿ]', '', 'g'))::double as a, length(regexp_replace(text, '\s', '', 'g')) as b from documents)
        select doc_id, (len(string_split(text, chr(10))) - case when text like '%' || chr(10) then 1 else 0 end)::int as n_lines, coalesce(a / nullif(b, 0) >= 0.08, false) as appears from n""",
    "st2_latest_snapshots": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "st3_admission": """with recursive o as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
        f as (select user_id, 0::bigint as i, null::bigint as event_id, []::bigint[] as kept, true as admitted, 0::double as retry_after from (select distinct user_id from events)
            union all select o.user_id, o.i, o.event_id, case when len(p) < 6 then list_append(p, us) else p end, len(p) < 6, case when len(p) < 6 then 0 else (p[1] + 3600000000 - us) / 1e6 end
            from (select o.*, list_filter(f.kept, lambda s: s > o.us - 3600000000) as p from f join o on o.user_id = f.user_id and o.i = f.i + 1) o)
        select user_id, event_id, admitted, retry_after from f where i > 0""",
    "st3b_admission_with_release": """with recursive o as (select user_id, event_id, epoch_us(ts) as us, event_type = 'purchase' as rel, row_number() over (partition by user_id order by ts, event_id) as i from events),
        f as (select user_id, 0::bigint as i, null::bigint as event_id, false as rel, []::bigint[] as kept, []::bigint[] as act, 0::int as retry_after from (select distinct user_id from events)
            union all select user_id, i, event_id, rel, case when not rel and wait = 0 then list_append(p, us) else p end,
                case when rel then q[2:] when wait = 0 then list_append(q, us) else q end, wait
            from (select *, case when rel then 0 when len(q) >= 2 then 5 when len(p) >= 6 then greatest(1, ceil((p[1] + 43200000000 - us) / 1e6))::int else 0 end as wait
                from (select o.*, list_filter(f.kept, lambda s: s > o.us - 43200000000) as p, list_filter(f.act, lambda s: s > o.us - 28800000000) as q
                    from f join o on o.user_id = f.user_id and o.i = f.i + 1) o) o)
        select user_id, event_id, retry_after = 0 as admitted, retry_after from f where i > 0 and not rel""",
    "st4_responses": """with a as (select event_id as request_id, ts from events where event_id % 3 = 0), b as (select event_id - event_id % 3 as request_id, ts as told from events where event_id % 3 <> 0 and event_type <> 'view'),
        n as (select a.request_id, count(*) as n from a join b on a.request_id = b.request_id and told between ts and ts + interval 45 seconds group by 1)
        select request_id, coalesce(n, 0) as n_responses, case when n = 1 then 'accepted' when n > 1 then 'repeated' else 'fallback' end as state from a left join n using (request_id)""",
    "st5_requests": r"""with l as (select unnest(string_split(text, chr(10))) as line from documents) select distinct sha256(trim(line)) as chunk_id from l where regexp_matches(line, '[\pL\pN]')""",
    "st5b_requests_each_day": "select distinct user_id || '-' || event_type as chunk_id, strftime(ts, '%Y-%m-%d') as day from events",
    "st6_current_status": "select user_id, max(case event_type when 'view' then 1 when 'click' then 2 else 3 end)::int as stage from events where event_type in ('view', 'click', 'purchase') group by 1",
}
