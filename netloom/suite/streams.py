"""Registered queries over streams (T01-T09), run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.plans.views import check_sql, view
from netloom.streaming import feeds, stateful
from netloom.streaming.runner import run_available, work_folder
from netloom.suite.registry import duck_stamp, query, stamp


def stream(spark, sf, table):
    """A base table as a stream, with zoned event times."""
    schema = view(spark, sf, table).schema
    # a pattern, since a stream takes a plain path for a folder only, and a table is a file or a folder of files
    rows = spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


_ACTION = """case event_type when 'signup' then 'queued' when 'click' then 'active'
  when 'view' then 'heartbeat' when 'purchase' then 'completed' else 'failed' end"""


def job_events(spark, sf):
    return stream(spark, sf, "events").selectExpr(
        "event_id", "event_id div 4 as job_id", "user_id as owner_id", f"{_ACTION} as action", "ts")


@query("t01_document_feed", check_sql(
    "select distinct job_id from job_events where action = 'completed'", "job_events"))
def _(spark, sf):
    return run_available(feeds.document_feed(job_events(spark, sf)).select("job_id"), "feed")


@query("t01_feed_done", check_sql("""
select owner_id, bool_and(d) as done from (select owner_id, job_id, bool_or(action in ('completed', 'failed')) as d
  from job_events group by all) group by owner_id
""", "job_events"))
def _(spark, sf):
    return feeds.feed_done(view(spark, sf, "job_events"))


@query("t02_claim_urls_stream", """
select distinct user_id % 9 as crawl_id, 'https://h' || (user_id % 5) || '.example.com/p' || (event_id % 37) as key from events
""")
def _(spark, sf):
    urls = stream(spark, sf, "events").selectExpr(
        "user_id % 9 as crawl_id", "ts",
        "'https://h' || (user_id % 5) || '.example.com/p' || (event_id % 37) || '#x' as url")
    return run_available(feeds.claim_urls_stream(urls).select("crawl_id", "key"), "claims")


def requests(df):
    return df.selectExpr("event_id as request_id", "user_id as key", "event_type as mode", "ts")


def _points():
    return F.when(F.col("mode") == "view", 1).otherwise(2)


@query("t03_rate_limit", """
select event_id as request_id, row_number() over (partition by user_id, event_type, date_trunc('day', ts)
  order by ts, event_id) <= case when event_type = 'view' then 1 else 2 end as allowed from events
""")
def _(spark, sf):
    rows = requests(view(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return feeds.rate_limit(rows, _points(), "1 day").select("request_id", "allowed")


@query("t03_rate_limit_stream", f"""
select user_id as key, event_type as mode, {duck_stamp("date_trunc('day', ts)")} as window_start, count(*) as requests,
  least(count(*), case when event_type = 'view' then 1 else 2 end) as allowed
from events group by user_id, event_type, date_trunc('day', ts)
""")
def _(spark, sf):
    limited = feeds.rate_limit_stream(requests(stream(spark, sf, "events")), _points(), "1 day", "1 day")
    return run_available(limited, "rates", "update", ("key", "mode", "window_start")).withColumn("window_start", stamp("window_start"))


LEASE_TTL = 12 * 3_600_000
STALL_LOCK = 3_600_000


def lease_events(df):
    return df.selectExpr("event_id", "user_id as owner_id", "event_id % 7 as holder", "ts", """
      case event_type when 'view' then 'heartbeat' when 'error' then 'release' else 'acquire' end as action""")


# Live leases of an owner, carried event by event.
_LEASES = f"""
with recursive e as (
  select event_id, user_id as owner_id, event_id % 7 as holder, epoch_us(ts) // 1000 as ms,
    case event_type when 'view' then 'heartbeat' when 'error' then 'release' else 'acquire' end as action,
    row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as n from events),
walk as (
  select owner_id, 0::bigint as n, []::struct(holder bigint, expiry bigint)[] as live,
    null::bigint as event_id, null::bigint as holder, null::varchar as action, false as granted
  from (select distinct owner_id from e)
  union all
  select owner_id, n, case
      when action = 'acquire' and not present and granted or action = 'heartbeat' and present
        then list_append([x for x in kept if x.holder <> holder], {{'holder': holder, 'expiry': ms + {LEASE_TTL}}})
      when action = 'release' then [x for x in kept if x.holder <> holder] else kept end,
    event_id, holder, action, granted
  from (select *, case action when 'acquire' then present or len(kept) < 2 else present end as granted
    from (select *, len([x for x in kept if x.holder = holder]) > 0 as present
      from (select e.*, [x for x in w.live if x.expiry > e.ms] as kept
        from walk w join e on e.owner_id = w.owner_id and e.n = w.n + 1))))
select owner_id, event_id, holder, action, granted, len(live)::int as in_use from walk where n > 0
"""


@query("t04_lease_audit", _LEASES)
def _(spark, sf):
    audited = stateful.lease_audit(lease_events(stream(spark, sf, "events")), 2, LEASE_TTL)
    return run_available(audited, "leases")


@query("t04_lease_audit_batch", _LEASES)
def _(spark, sf):
    events = lease_events(view(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return stateful.lease_audit_batch(events, 2, LEASE_TTL)


# Deadline, stalls and activity of a job, carried event by event; at the end
# the locks that the watermark has passed.
_STALLS = check_sql(f"""
with recursive e as (
  select job_id, action, epoch_us(ts) // 1000 as ms, row_number() over (partition by job_id order by epoch_us(ts) // 1000, event_id) as n
  from job_events),
walk as (
  select job_id, 0::bigint as n, 0::bigint as until, 0 as stalls, false as active, null::bigint as at_ms, 0 as at_stalls
  from (select distinct job_id from e)
  union all
  select job_id, n, case when starts then ms + {STALL_LOCK} when action in ('completed', 'failed', 'queued') then ms + {stateful.KEEP_MS}
      else until2 end, stalls3, starts or active2 and action not in ('completed', 'failed', 'queued'),
    case when late then until end, stalls2
  from (select *, action = 'active' or action = 'heartbeat' and active2 as starts,
      case when not active2 and ms >= until2 then 0 else stalls2 end as stalls3
    from (select *, active and not late as active2, case when late then until + {stateful.KEEP_MS} else until end as until2,
        case when late then stalls + 1 else stalls end as stalls2
      from (select e.*, w.until, w.stalls, w.active, w.active and e.ms >= w.until as late
        from walk w join e on e.job_id = w.job_id and e.n = w.n + 1)))),
found as (
  select job_id, at_ms, at_stalls as stalls from walk where at_ms is not null
  union all
  select job_id, until, stalls + 1 from (select * from walk qualify row_number() over (partition by job_id order by n desc) = 1)
  where active and until <= (select max(ms) from e) - 60000)
select job_id, at_ms, case when stalls > 9 then 'failed' else 'requeued' end as outcome, stalls from found
""", "job_events", recursive=True)


@query("t05_stalled_jobs_stream", _STALLS)
def _(spark, sf):
    return run_available(stateful.stalled_jobs_stream(job_events(spark, sf), STALL_LOCK), "stalls")


# Open jobs of a group after each event; it finishes where none is left.
@query("t06_group_completion_stream", check_sql("""
with e as (select owner_id as group_id, event_id, job_id, epoch_us(ts) // 1000 as ms,
  case when action in ('queued', 'active') then 1 when action in ('completed', 'failed') then 0 end as state from job_events),
p as (select *, coalesce(last_value(state ignore nulls) over (partition by group_id, job_id order by ms, event_id
  rows between unbounded preceding and 1 preceding), 0) as was from e),
d as (select *, case when state = 1 and was = 0 then 1 when state = 0 and was = 1 then -1 else 0 end as delta from p),
o as (select *, sum(delta) over w as still_open, sum((delta = 1)::int) over w as jobs from d
  window w as (partition by group_id order by ms, event_id rows unbounded preceding))
select group_id, ms as finished_ms, jobs::int as jobs from o where still_open = 0
qualify row_number() over (partition by group_id order by ms, event_id) = 1
""", "job_events"))
def _(spark, sf):
    # Every event is followed by the end of the kickoff: a group finishes at
    # the first event that leaves no job open.
    events = job_events(spark, sf).withColumnRenamed("owner_id", "group_id")
    kickoff = events.select("group_id", (F.col("event_id") + (1 << 40)).alias("event_id"), "job_id",
                            F.lit("kickoff_done").alias("action"), "ts")
    both = events.union(kickoff.select(*events.columns))
    return run_available(stateful.group_completion_stream(both), "groups")


@query("t07_exchange_stream", check_sql(
    "select session_id, id % 4294967296 as turn, sequence, user_message, assistant_message from exchanges",
    "exchanges"))
def _(spark, sf):
    return run_available(stateful.exchange_stream(stream(spark, sf, "conversations")), "exchanges")


@query("t08_suggestion_stream", check_sql("""
select id as source_exchange_id, 'likes ' || length(user_message) as content, 'memory' as target, 0.9::double as confidence,
  'pending' as status from exchanges
""", "exchanges"))
def _(spark, sf):
    folder = work_folder(spark, "suggestions")
    source = f"{folder}/exchanges"
    view(spark, sf, "exchanges").write.parquet(source)
    exchanges = spark.readStream.schema(view(spark, sf, "exchanges").schema).parquet(source)

    def extractor(batch):
        # Stands for a model: one suggestion per exchange.
        item = F.to_json(F.struct(
            F.concat(F.lit("likes "), F.length("user_message").cast("string")).alias("content"),
            F.lit("memory").alias("target"), F.lit(0.9).alias("confidence"),
            F.col("exchange_id").alias("sourceExchangeId")))
        return batch.groupBy("batch_id").agg(
            F.concat(F.lit("["), F.concat_ws(",", F.collect_list(item)), F.lit("]")).alias("raw"))

    run = feeds.suggestion_stream(
        exchanges, extractor, f"{folder}/pending", f"{folder}/state", now=F.lit(1800000000),
        availableNow=True)
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/pending").select(
        "source_exchange_id", "content", "target", "confidence", "status")


@query("t09_last_success", check_sql(f"""
select owner_id, {duck_stamp('max(ts)')} as last_success from job_events where action = 'completed'
group by owner_id having max(ts) > timestamp '2024-01-30 00:00:00' - interval '24' hour
""", "job_events"))
def _(spark, sf):
    events = view(spark, sf, "job_events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.to_timestamp(F.lit("2024-01-30 00:00:00"))
    return feeds.last_success(events, now).withColumn("last_success", stamp("last_success"))


@query("t09_last_success_stream", check_sql(f"""
select owner_id, {duck_stamp('max(ts)')} as last_success from job_events where action = 'completed' group by owner_id
having max(epoch_us(ts) // 1000) + {stateful.KEEP_MS} > (select max(epoch_us(ts) // 1000) from job_events) - 60000
""", "job_events"))
def _(spark, sf):
    latest = run_available(stateful.last_success_stream(job_events(spark, sf)), "success", "update", ("owner_id",))
    return latest.where("last_success is not null").withColumn("last_success", stamp("last_success"))
