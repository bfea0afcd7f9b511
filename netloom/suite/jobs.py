"""Registered queries over the job log."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import jobs as J
from netloom.plans.views import check_sql, view
from netloom.suite.registry import at, duck_stamp, query, stamp

NOW = "1998-01-01 00:00:00"
LATER = "1999-02-15 00:00:00"
PAGE_JOBS = "mode = 'single_urls'"


@query("j01_group_stats", check_sql(f"""
select group_id, status, count(*) as n from jobs where {PAGE_JOBS} group by all
union all
select group_id, 'backlog', count(*) from backlog where {PAGE_JOBS} group by all
""", "jobs", "backlog"))
def _(spark, sf):
    return J.group_stats(view(spark, sf, "jobs"), view(spark, sf, "backlog"))


_ERRORS = "select id as group_id, 'crawl broke' as error from groups where id % 3 = 0"


@query("j02_crawl_status", check_sql(f"""
select g.id as group_id,
  case when e.error is not null and coalesce(s.total, 0) = 0 and g.status = 'completed' then 'failed'
       when g.status = 'active' then 'scraping' else g.status end as status,
  coalesce(s.completed, 0) as completed, coalesce(s.total, 0) as total,
  case when e.error is not null and coalesce(s.total, 0) = 0 and g.status = 'completed'
       then e.error end as error
from groups g left join (
  select group_id, sum(case when status = 'completed' then 1 else 0 end)::bigint as completed,
    sum(case when status <> 'failed' then 1 else 0 end)::bigint as total
  from (select group_id, status from jobs where {PAGE_JOBS}
        union all select group_id, 'backlog' from backlog where {PAGE_JOBS})
  group by group_id) s on s.group_id = g.id
left join ({_ERRORS}) e on e.group_id = g.id
""", "jobs", "backlog", "groups"))
def _(spark, sf):
    groups = view(spark, sf, "groups")
    errors = groups.where("id % 3 = 0").select(
        F.col("id").alias("group_id"), F.lit("crawl broke").alias("error"))
    return J.crawl_status(groups, view(spark, sf, "jobs"), view(spark, sf, "backlog"), errors)


@query("j03_error_report", check_sql(f"""
select * from (
  select group_id, id, {duck_stamp('finished_at')} as finished_at,
    case when contains(failedreason, '|') then split_part(failedreason, '|', 1) end as code,
    case when contains(failedreason, '|')
      then json_extract_string(substr(failedreason, strpos(failedreason, '|') + 1), '$.message')
      else failedreason end as error
  from jobs where status = 'failed' and {PAGE_JOBS})
where coalesce(code, '') <> 'SCRAPE_RACED_REDIRECT_ERROR'
""", "jobs"))
def _(spark, sf):
    return J.error_report(view(spark, sf, "jobs")).withColumn("finished_at", stamp("finished_at"))


PAGE_SKIP, PAGE_LIMIT, PAGE_BYTES = 1, 5, 400_000


@query("j04_result_page", check_sql(f"""
select p.group_id, p.id, p.rank, p.bytes, p.bytes_so_far,
  s.total > max(p.rank) over (partition by p.group_id) or g.status <> 'completed' as has_next
from (
  select *, sum(bytes) over (partition by group_id order by rank)::bigint as bytes_so_far
  from (select group_id, id, bytes,
      row_number() over (partition by group_id order by finished_at, created_at, id) as rank
    from jobs where status = 'completed' and {PAGE_JOBS})
  where rank > {PAGE_SKIP} and rank <= {PAGE_SKIP + PAGE_LIMIT}
  qualify bytes_so_far <= {PAGE_BYTES} or rank = {PAGE_SKIP + 1}) p
join groups g on g.id = p.group_id
join (select group_id, count(*) as total from
   (select group_id from jobs where {PAGE_JOBS} and status <> 'failed'
    union all select group_id from backlog where {PAGE_JOBS}) group by group_id) s
  on s.group_id = p.group_id
""", "jobs", "backlog", "groups"))
def _(spark, sf):
    jobs, groups = view(spark, sf, "jobs"), view(spark, sf, "groups")
    page = J.result_page(jobs, PAGE_SKIP, PAGE_LIMIT, PAGE_BYTES)
    none = groups.where("false").select(F.col("id").alias("group_id"), F.lit("").alias("error"))
    status = J.crawl_status(groups, jobs, view(spark, sf, "backlog"), none)
    follow = J.result_page_next(page, status).select("group_id", "has_next")
    return page.join(follow, "group_id")


@query("j05_next_jobs", check_sql(f"""
select id, priority, {duck_stamp('created_at')} as created_at from jobs
where status = 'queued' order by priority, jobs.created_at, id limit 500
""", "jobs"))
def _(spark, sf):
    return J.next_jobs(view(spark, sf, "jobs")).select(
        "id", "priority", stamp("created_at").alias("created_at"))


@query("j06_admit_per_crawl", check_sql("""
select group_id, id, case when slots is null or rn <= slots then 'eligible' else 'deferred' end as bucket
from (select j.group_id, j.id, row_number() over (partition by j.group_id order by created_at, j.id) as rn,
    case j.group_id % 3 when 0 then null when 1 then 1 else j.group_id % 4 end as slots
  from jobs j)
""", "jobs"))
def _(spark, sf):
    jobs = view(spark, sf, "jobs")
    limits = view(spark, sf, "groups").select(
        F.col("id").alias("group_id"),
        F.expr("case when id % 3 = 1 then 500 end").alias("delay"),
        F.expr("case when id % 3 = 2 then id % 4 end").alias("max_concurrency"))
    return J.admit_per_crawl(jobs, limits)


@query("j07_promote_backlog", check_sql("""
select id, group_id, status, 'jobs' as place from jobs
union all select id, group_id, 'queued', 'jobs' from backlog where id % 2 = 0
union all select id, group_id, 'waiting', 'backlog' from backlog where id % 2 <> 0
""", "jobs", "backlog"))
def _(spark, sf):
    jobs, backlog = view(spark, sf, "jobs"), view(spark, sf, "backlog")
    moved, left = J.promote_backlog(jobs, backlog, backlog.where("id % 2 = 0").select("id"))
    return moved.select("id", "group_id", "status", F.lit("jobs").alias("place")).unionByName(
        left.select("id", "group_id", F.lit("waiting").alias("status"),
                    F.lit("backlog").alias("place")))


@query("j08_reap_stalled", check_sql(f"""
select id,
  case when hit and stalls < 9 then 'queued' when hit then 'failed' else status end as status,
  case when hit then stalls + 1 else stalls end as stalls,
  case when not hit then {duck_stamp('locked_at')} end as locked_at
from (select *, coalesce(status = 'active' and locked_at <= timestamp '{NOW}' - interval '1' minute, false) as hit
      from jobs)
""", "jobs"))
def _(spark, sf):
    reaped = J.reap_stalled(view(spark, sf, "jobs"), at(NOW))
    return reaped.select("id", "status", "stalls", stamp("locked_at").alias("locked_at"))


@query("j09_finish_groups", check_sql(f"""
select id, owner_id, case when closing then 'completed' else status end as status,
  case when closing then {duck_stamp(f"timestamp '{NOW}' + interval '1' day")}
       else {duck_stamp('expires_at')} end as expires_at,
  closing as finished_now
from (select g.*, g.status = 'active'
    and not exists (select 1 from jobs j where j.group_id = g.id and j.status in ('active', 'queued'))
    and not exists (select 1 from backlog b where b.group_id = g.id) as closing
  from groups g)
""", "jobs", "backlog", "groups"))
def _(spark, sf):
    updated, finished = J.finish_groups(
        view(spark, sf, "groups"), view(spark, sf, "jobs"), view(spark, sf, "backlog"), at(NOW))
    done = finished.select(F.col("group_id").alias("id"), F.lit(True).alias("_f"))
    return updated.join(done, "id", "left").select(
        "id", "owner_id", "status", stamp("expires_at").alias("expires_at"),
        F.col("_f").isNotNull().alias("finished_now"))


@query("j10_retention", check_sql(f"""
select 'job' as kind, id from (select id, status, created_at,
    case when id % 6 = 0 then null else group_id end as group_id from jobs) j
where not (group_id is null and ((status = 'completed' and created_at < timestamp '{LATER}' - interval '1' hour)
    or (status = 'failed' and created_at < timestamp '{LATER}' - interval '6' hour)))
  and (group_id is null or group_id not in
    (select id from groups where status = 'completed' and expires_at < timestamp '{LATER}'))
union all
select 'group', id from groups where not (status = 'completed' and expires_at < timestamp '{LATER}')
union all
select 'backlog', id from backlog where group_id not in
  (select id from groups where status = 'completed' and expires_at < timestamp '{LATER}')
""", "jobs", "backlog", "groups"))
def _(spark, sf):
    jobs = view(spark, sf, "jobs").withColumn(
        "group_id", F.expr("case when id % 6 <> 0 then group_id end"))
    kept = J.retention(jobs, view(spark, sf, "groups"), view(spark, sf, "backlog"), at(LATER))
    out = None
    for kind, df in zip(("job", "group", "backlog"), kept):
        part = df.select(F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("j11_expire_backlog", check_sql(f"""
select id, group_id from backlog where times_out_at is null or times_out_at >= timestamp '{NOW}'
""", "backlog"))
def _(spark, sf):
    return J.expire_backlog(view(spark, sf, "backlog"), at(NOW)).select("id", "group_id")


@query("j12_queue_depth", check_sql(
    "select status, count(*) as n from jobs where status in ('queued', 'active') group by status",
    "jobs"))
def _(spark, sf):
    return J.queue_depth(view(spark, sf, "jobs"))


@query("j13_backlog_owners", check_sql("""
select owner_id, null::bigint as id from (select distinct owner_id from backlog)
union all select owner_id, id from backlog where owner_id = 3
""", "backlog"))
def _(spark, sf):
    backlog = view(spark, sf, "backlog")
    return J.backlog_owners(backlog).select(
        "owner_id", F.lit(None).cast("bigint").alias("id")).unionByName(
        J.backlog_ids_of(backlog, 3).select(F.lit(3).cast("bigint").alias("owner_id"), "id"))


@query("j14_jobs_by_id", check_sql("""
select id, status, mode from jobs where status in ('completed', 'failed')
  and id in (select l_orderkey from lineitem where l_linenumber = 1)
""", "jobs"))
def _(spark, sf):
    ids = view(spark, sf, "lineitem").where("l_linenumber = 1").select(
        F.col("l_orderkey").alias("id"))
    return J.jobs_by_id(view(spark, sf, "jobs"), ids, ["completed", "failed"]).select(
        "id", "status", "mode")


@query("j15_any_job", check_sql(f"""
select group_id, owner_id, min(id) as id, arg_min(status, id) as status
from jobs where {PAGE_JOBS} group by group_id, owner_id
""", "jobs"))
def _(spark, sf):
    return J.any_job(view(spark, sf, "jobs"))


@query("j16_ongoing_groups", check_sql(
    "select id, owner_id from groups where status = 'active' and owner_id = 5", "groups"))
def _(spark, sf):
    return J.ongoing_groups(view(spark, sf, "groups"), 5).select("id", "owner_id")


_OUTCOMES = """
select owner_id as group_id, job_id, ts, event_id as seq, action = 'completed' as success
from job_events where action in ('completed', 'failed')
"""


@query("j17_done_jobs", check_sql(f"""
select group_id, job_id, {duck_stamp('ts')} as done_at, rank, n from (
  select *, row_number() over (partition by group_id order by ts, job_id) as rank,
    count(*) over (partition by group_id) as n
  from (select * from ({_OUTCOMES})
        qualify row_number() over (partition by group_id, job_id order by ts desc, seq desc) = 1)
  where success and ts <= timestamp '2024-01-20 00:00:00')
where rank > 2 and rank <= 12
""", "job_events"))
def _(spark, sf):
    events = view(spark, sf, "job_events").where("action in ('completed', 'failed')").select(
        F.col("owner_id").alias("group_id"), "job_id", "ts", F.col("event_id").alias("seq"),
        (F.col("action") == "completed").alias("success"))
    until = at("2024-01-20 00:00:00")
    listed = J.done_jobs(events, until, start=2, count=10)
    return listed.join(J.done_job_counts(events, until), "group_id").select(
        "group_id", "job_id", stamp("done_at").alias("done_at"), "rank", "n")


@query("j18_crawl_finished", check_sql("""
select g.id as group_id,
  coalesce((select bool_and(status in ('completed', 'failed')) from jobs j
            where j.group_id = g.id and mode = 'single_urls'), true)
  and coalesce((select bool_and(status in ('completed', 'failed')) from jobs j
            where j.group_id = g.id and mode = 'kickoff'), true)
  and g.id % 5 <> 0 as finished
from groups g
""", "jobs", "groups"))
def _(spark, sf):
    jobs = view(spark, sf, "jobs").withColumn(
        "done", F.col("status").isin("completed", "failed"))
    kickoffs = view(spark, sf, "groups").select(
        F.col("id").alias("group_id"), F.expr("id % 5 <> 0").alias("kicked_off"))
    return J.crawl_finished(
        jobs.where("mode = 'single_urls'"), jobs.where("mode = 'kickoff'"), kickoffs)


@query("j19_crawl_summary", check_sql(f"""
select g.id as group_id, coalesce(n, 0) as num_docs, coalesce(b, 0) as bytes,
  {duck_stamp('first_created')} as first_created,
  case when g.id % 9 = 0 then 'failed' else 'completed' end as state
from groups g left join (
  select group_id, count(*) as n, sum(bytes)::bigint as b, min(created_at) as first_created
  from jobs where status = 'completed' group by group_id) j on j.group_id = g.id
""", "jobs", "groups"))
def _(spark, sf):
    crawls = view(spark, sf, "groups").select(
        F.col("id").alias("group_id"), F.expr("id % 9 = 0").alias("cancelled"))
    return J.crawl_summary(view(spark, sf, "jobs"), crawls).withColumn(
        "first_created", stamp("first_created"))


_KEYED = """
select event_id as request_id, ts, case user_id % 4 when 0 then ''
  when 1 then 'not-a-uuid' else lpad(cast(event_id // 3 as varchar), 8, '0')
    || '-0000-4000-8000-' || lpad(cast(user_id % 3 as varchar), 12, '0') end as idempotency_key
from events
"""


@query("j20_dedupe_requests", f"""
select request_id, idempotency_key, case when idempotency_key = '' then 'accepted'
  when not regexp_matches(idempotency_key, '^[0-9a-f]{{8}}-') then 'invalid_key'
  when row_number() over (partition by idempotency_key order by ts, request_id) = 1 then 'accepted'
  else 'duplicate' end as verdict
from ({_KEYED})
""")
def _(spark, sf):
    requests = view(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), "ts", F.expr("""
          case user_id % 4 when 0 then '' when 1 then 'not-a-uuid'
          else lpad(string(event_id div 3), 8, '0') || '-0000-4000-8000-'
            || lpad(string(user_id % 3), 12, '0') end""").alias("idempotency_key"))
    return J.dedupe_requests(requests).select("request_id", "idempotency_key", "verdict")


@query("j21_cancel_crawls", check_sql("""
select 'group' as kind, id, case when id % 6 = 0 then
    case when status = 'completed' then 'already_completed' else 'cancelled' end end as answer,
  (id % 6 = 0 and status <> 'completed') as flag
from groups
union all
select 'job', j.id, case when d.id is not null and j.status in ('queued', 'active')
    then 'failed' else j.status end, d.id is not null
from jobs j left join (select id from groups where id % 6 = 0 and status <> 'completed') d
  on d.id = j.group_id
""", "jobs", "groups"))
def _(spark, sf):
    groups = view(spark, sf, "groups")
    marked, jobs = J.cancel_crawls(
        groups, view(spark, sf, "jobs"),
        groups.where("id % 6 = 0").select(F.col("id").alias("group_id")))
    dead = marked.where("cancelled").select(F.col("id").alias("group_id"),
                                            F.lit(True).alias("_d"))
    out = jobs.join(dead, "group_id", "left").select(
        F.lit("job").alias("kind"), "id", F.col("status").alias("answer"),
        F.col("_d").isNotNull().alias("flag"))
    return marked.select(F.lit("group").alias("kind"), "id", "answer",
                         F.col("cancelled").alias("flag")).unionByName(out)


def _duck_histogram(edges, seconds):
    return ", ".join(
        f"count(*) filter (where {seconds} <= {float(e)}) as le_{str(e).replace('.', '_')}"
        for e in edges)


@query("j22_route_latency", check_sql(f"""
select method, '/crawl/:id/status' as route, cast(status as bigint) as status, count(*) as n,
  round(sum(seconds), 2) as seconds, {_duck_histogram(J.HTTP_BUCKETS, 'seconds')}
from request_log group by method, status
""", "request_log"))
def _(spark, sf):
    return J.route_latency(view(spark, sf, "request_log")).withColumns({
        "seconds": F.round("seconds", 2), "status": F.col("status").cast("bigint")})


@query("j22_job_latency", check_sql(f"""
select mode, case when status = 'completed' then 'success' else 'failed' end as outcome,
  count(*) as n, sum(t) as seconds, {_duck_histogram(J.JOB_BUCKETS, 't')}
from (select mode, status, date_diff('microsecond', created_at, finished_at) / 1e6 as t
      from jobs where status in ('completed', 'failed')) group by mode, status
""", "jobs"))
def _(spark, sf):
    return J.job_latency(view(spark, sf, "jobs"))
