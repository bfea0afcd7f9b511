"""Crawl-job log: reports and table rewrites.

A job row has ``id, group_id, owner_id, status, mode, priority, created_at,
finished_at, locked_at, stalls, bytes, failedreason``.  Rewrites return a new
table version; :mod:`netloom.sources.tables` writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.plans.ranking import rank_by_range, top_n

SCRAPE_MODE = "single_urls"
RESULT_PAGE_BYTES = 10_485_760

# Transportable error codes.
ERROR_CODES = (
    "SCRAPE_TIMEOUT", "MAP_TIMEOUT", "UNKNOWN_ERROR", "SCRAPE_ALL_ENGINES_FAILED",
    "SCRAPE_SSL_ERROR", "SCRAPE_SITE_ERROR", "SCRAPE_PROXY_SELECTION_ERROR",
    "SCRAPE_PDF_PREFETCH_FAILED", "SCRAPE_DOCUMENT_PREFETCH_FAILED", "SCRAPE_JOB_CANCELLED",
    "SCRAPE_RETRY_LIMIT", "SCRAPE_ZDR_VIOLATION_ERROR", "SCRAPE_DNS_RESOLUTION_ERROR",
    "SCRAPE_PDF_INSUFFICIENT_TIME_ERROR", "SCRAPE_PDF_ANTIBOT_ERROR", "SCRAPE_PDF_OCR_REQUIRED",
    "SCRAPE_DOCUMENT_ANTIBOT_ERROR", "SCRAPE_UNSUPPORTED_FILE_ERROR", "SCRAPE_ACTION_ERROR",
    "SCRAPE_RACED_REDIRECT_ERROR", "SCRAPE_NO_CACHED_DATA", "SCRAPE_SITEMAP_ERROR",
    "SCRAPE_ACTIONS_NOT_SUPPORTED", "CRAWL_DENIAL",
)
RACED_REDIRECT = "SCRAPE_RACED_REDIRECT_ERROR"

# Histogram bucket edges in seconds.
HTTP_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60)
JOB_BUCKETS = (0.1, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300, 600, 900, 1800, 3600)


def group_stats(jobs: DataFrame, backlog: DataFrame, mode: str = SCRAPE_MODE) -> DataFrame:
    """Counts by group and status for one mode, backlog as its own status."""
    live = jobs.where(F.col("mode") == mode).groupBy("group_id", "status").agg(
        F.count("*").alias("n"))
    waiting = backlog.where(F.col("mode") == mode).groupBy("group_id").agg(
        F.count("*").alias("n")).select("group_id", F.lit("backlog").alias("status"), "n")
    return live.unionByName(waiting)


def _stats_wide(jobs: DataFrame, backlog: DataFrame, mode: str) -> DataFrame:
    stats = group_stats(jobs, backlog, mode)

    def n(*statuses):
        return F.coalesce(F.sum(F.when(F.col("status").isin(*statuses), F.col("n"))), F.lit(0))

    return stats.groupBy("group_id").agg(
        n("completed").alias("completed"),
        n("completed", "active", "queued", "backlog").alias("total"))


def crawl_status(groups: DataFrame, jobs: DataFrame, backlog: DataFrame, errors: DataFrame,
                 mode: str = SCRAPE_MODE) -> DataFrame:
    """Status, completed and total per crawl; failed jobs do not count."""
    wide = _stats_wide(jobs, backlog, mode)
    base = (
        groups.select(F.col("id").alias("group_id"), F.col("status").alias("_s"))
        .join(wide, "group_id", "left")
        .join(errors.select("group_id", "error"), "group_id", "left")
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("completed", F.coalesce("completed", F.lit(0)))
    )
    failed = F.col("error").isNotNull() & (F.col("total") == 0) & (F.col("_s") == "completed")
    status = F.when(failed, "failed").when(F.col("_s") == "active", "scraping").otherwise(
        F.col("_s"))
    return base.select("group_id", status.alias("status"), "completed", "total",
                       F.when(failed, F.col("error")).alias("error"))


def error_report(jobs: DataFrame, mode: str = SCRAPE_MODE) -> DataFrame:
    """Failed page jobs with code and message; raced redirects are hidden."""
    failed = jobs.where(
        (F.col("status") == "failed") & (F.col("mode") == mode)
        & F.col("failedreason").isNotNull() & (F.col("failedreason") != ""))
    parts = F.split("failedreason", r"\|", 2)
    known = F.get(parts, 0).isin(list(ERROR_CODES))
    return failed.select(
        "group_id", "id", "finished_at",
        F.when(known, F.get(parts, 0)).alias("code"),
        F.when(known, F.get_json_object(F.get(parts, 1), "$.message")).otherwise(
            F.col("failedreason")).alias("error"),
    ).where(F.coalesce(F.col("code"), F.lit("")) != RACED_REDIRECT)


def robots_blocked(filtered: DataFrame, by: str = "crawl_id") -> DataFrame:
    """Distinct URLs denied by robots rules, as rows (a set per crawl has no bound)."""
    return filtered.where(F.col("reason") == "ROBOTS_TXT").select(by, "url").distinct()


def result_page(jobs: DataFrame, skip: int = 0, limit: int = 100,
                max_bytes: int = RESULT_PAGE_BYTES, mode: str = SCRAPE_MODE) -> DataFrame:
    """One result page per crawl: by finish time, cut by size, at least one row.

    The window works on at most ``skip + limit`` rows per crawl.
    """
    from pyspark.sql import Window

    done = jobs.where((F.col("status") == "completed") & (F.col("mode") == mode))
    ranked = top_n(done, ["group_id"],
                   [F.col("finished_at"), F.col("created_at"), F.col("id")], skip + limit)
    page = ranked.where(F.col("rank") > skip)
    size = F.sum(F.coalesce("bytes", F.lit(0))).over(
        Window.partitionBy("group_id").orderBy("rank"))
    return (
        page.withColumn("bytes_so_far", size)
        .where((F.col("bytes_so_far") <= max_bytes) | (F.col("rank") == skip + 1))
        .select("group_id", "id", "rank", "bytes", "bytes_so_far")
    )


def result_page_next(page: DataFrame, status: DataFrame) -> DataFrame:
    """Where the next page starts, and whether there is one."""
    last = page.groupBy("group_id").agg(F.max("rank").alias("last_rank"))
    joined = status.join(last, "group_id", "left").withColumn(
        "next_skip", F.coalesce("last_rank", F.lit(0)).cast("bigint"))
    return joined.select(
        "group_id", "next_skip",
        ((F.col("total") > F.col("next_skip")) | (F.col("status") != "completed")).alias(
            "has_next"))


def next_jobs(jobs: DataFrame, n: int = 500) -> DataFrame:
    return jobs.where(F.col("status") == "queued").orderBy(
        "priority", "created_at", "id").limit(n)


def admit_per_crawl(jobs: DataFrame, limits: DataFrame) -> DataFrame:
    """Bucket of each new job: the first free slots of a crawl are eligible.

    ``limits`` has ``group_id, delay, max_concurrency``.  Without either there
    is no limit; with a delay alone it is one.
    """
    slots = limits.select(
        "group_id",
        F.when(F.col("delay").isNull() & F.col("max_concurrency").isNull(), None)
        .otherwise(F.greatest(F.coalesce("max_concurrency", F.lit(1)), F.lit(0))).alias("slots"))
    tagged = jobs.join(slots, "group_id", "left")
    limited = tagged.where(F.col("slots").isNotNull())
    ranked = rank_by_range(limited, ["group_id"], [F.col("created_at"), F.col("id")])
    out = ranked.select(
        "group_id", "id",
        F.when(F.col("rank") <= F.col("slots"), "eligible").otherwise("deferred").alias("bucket"))
    return out.unionByName(tagged.where(F.col("slots").isNull()).select(
        "group_id", "id", F.lit("eligible").alias("bucket")))


def promote_backlog(jobs: DataFrame, backlog: DataFrame,
                    ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves the named backlog rows into the job table unless already there."""
    chosen = backlog.join(ids.select("id").distinct(), "id", "left_semi")
    added = chosen.join(jobs.select("id"), "id", "left_anti").withColumn(
        "status", F.lit("queued"))
    new_jobs = jobs.unionByName(added.drop("times_out_at"), allowMissingColumns=True)
    return new_jobs, backlog.join(ids.select("id"), "id", "left_anti")


def reap_stalled(jobs: DataFrame, now: Column, lock_seconds: int = 60,
                 max_stalls: int = 9) -> DataFrame:
    """Jobs whose lock ran out go back to the queue, or fail at the ninth stall."""
    stalls = F.coalesce("stalls", F.lit(0))
    hit = (F.col("status") == "active") & (
        F.col("locked_at") <= now - F.make_dt_interval(secs=F.lit(lock_seconds)))
    hit = F.coalesce(hit, F.lit(False))
    return jobs.withColumns({
        "status": F.when(hit & (stalls < max_stalls), "queued").when(hit, "failed").otherwise(
            F.col("status")),
        "stalls": F.when(hit, stalls + 1).otherwise(F.col("stalls")),
        "locked_at": F.when(~hit, F.col("locked_at")),
    })


def finish_groups(groups: DataFrame, jobs: DataFrame, backlog: DataFrame,
                  now: Column) -> tuple[DataFrame, DataFrame]:
    """Closes active groups with nothing left to do.

    Returns the new group table and one finished row per closed group.
    """
    busy = (
        jobs.where(F.col("status").isin("active", "queued")).select("group_id")
        .unionByName(backlog.select("group_id"))
        .where("group_id is not null").distinct()
        .select(F.col("group_id").alias("id"), F.lit(True).alias("_busy"))
    )
    marked = groups.join(busy, "id", "left").withColumn(
        "_closing", (F.col("status") == "active") & F.col("_busy").isNull())
    ttl_seconds = F.expr("ttl div 1000")
    updated = marked.withColumns({
        "status": F.when(F.col("_closing"), "completed").otherwise(F.col("status")),
        "expires_at": F.when(
            F.col("_closing"), now + F.make_dt_interval(secs=ttl_seconds)).otherwise(
            F.col("expires_at")),
    }).drop("_busy", "_closing")
    finished = marked.where("_closing").select(F.col("id").alias("group_id"), "owner_id")
    return updated, finished


def retention(jobs: DataFrame, groups: DataFrame, backlog: DataFrame, now: Column,
              completed_hours: int = 1, failed_hours: int = 6):
    """Drops old ungrouped jobs, and everything of expired completed groups."""
    expired = groups.where(
        (F.col("status") == "completed") & (F.col("expires_at") < now))
    gone = expired.select(F.col("id").alias("group_id"))

    def age(hours):
        return F.col("created_at") < now - F.make_dt_interval(hours=F.lit(hours))

    stale = F.col("group_id").isNull() & (
        ((F.col("status") == "completed") & age(completed_hours))
        | ((F.col("status") == "failed") & age(failed_hours)))
    kept_jobs = jobs.where(~F.coalesce(stale, F.lit(False))).join(gone, "group_id", "left_anti")
    kept_groups = groups.join(expired.select("id"), "id", "left_anti")
    return kept_jobs, kept_groups, backlog.join(gone, "group_id", "left_anti")


def expire_backlog(backlog: DataFrame, now: Column) -> DataFrame:
    return backlog.where(F.col("times_out_at").isNull() | (F.col("times_out_at") >= now))


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "active")).groupBy("status").agg(
        F.count("id").alias("n"))


def backlog_owners(backlog: DataFrame) -> DataFrame:
    return backlog.select("owner_id").distinct()


def backlog_ids_of(backlog: DataFrame, owner) -> DataFrame:
    return backlog.where(F.col("owner_id") == owner).select("id")


def jobs_by_id(jobs: DataFrame, ids: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Rows of an id set."""
    found = jobs.where(F.col("status").isin(statuses)) if statuses else jobs
    return found.join(ids.select("id").distinct(), "id", "left_semi")


def any_job(jobs: DataFrame, mode: str = SCRAPE_MODE) -> DataFrame:
    """One page job per (group, owner): the one with the smallest id."""
    return jobs.where(F.col("mode") == mode).groupBy("group_id", "owner_id").agg(
        F.min("id").alias("id"), F.min_by("status", "id").alias("status"))


def ongoing_groups(groups: DataFrame, owner=None) -> DataFrame:
    active = groups.where(F.col("status") == "active")
    return active if owner is None else active.where(F.col("owner_id") == owner)


def done_jobs(events: DataFrame, until: Column | None = None, start: int = 0,
              count: int | None = None) -> DataFrame:
    """Successful jobs by completion time; a later failure removes a job.

    ``events`` has ``group_id, job_id, ts, seq, success``.
    """
    last = events.groupBy("group_id", "job_id").agg(
        F.max_by(F.struct("success", "ts"), F.struct("ts", "seq")).alias("_last"))
    ok = last.where("_last.success").select(
        "group_id", "job_id", F.col("_last.ts").alias("done_at"))
    if until is not None:
        ok = ok.where(F.col("done_at") <= until)
    order = [F.col("done_at"), F.col("job_id")]
    if count is None:
        ranked = rank_by_range(ok, ["group_id"], order)
    else:
        ranked = top_n(ok, ["group_id"], order, start + count)
    return ranked.where(F.col("rank") > start)


def done_job_counts(events: DataFrame, until: Column | None = None) -> DataFrame:
    last = events.groupBy("group_id", "job_id").agg(
        F.max_by(F.struct("success", "ts"), F.struct("ts", "seq")).alias("_last"))
    ok = last.where("_last.success")
    if until is not None:
        ok = ok.where(F.col("_last.ts") <= until)
    return ok.groupBy("group_id").agg(F.count("*").alias("n"))


def crawl_finished(jobs: DataFrame, sitemap_jobs: DataFrame, kickoffs: DataFrame) -> DataFrame:
    """A crawl is finished when all page and sitemap jobs are, and kickoff is done.

    Job tables have ``group_id, done``; ``kickoffs`` has ``group_id, kicked_off``.
    """
    pages = jobs.groupBy("group_id").agg(F.bool_and("done").alias("pages_done"))
    maps = sitemap_jobs.groupBy("group_id").agg(F.bool_and("done").alias("sitemaps_done"))
    joined = kickoffs.select("group_id", "kicked_off").join(pages, "group_id", "left").join(
        maps, "group_id", "left")
    return joined.select(
        "group_id",
        (F.coalesce("pages_done", F.lit(True)) & F.coalesce("sitemaps_done", F.lit(True))
         & F.col("kicked_off")).alias("finished"))


def crawl_summary(jobs: DataFrame, crawls: DataFrame) -> DataFrame:
    """Documents and bytes per crawl, and the final state.

    Jobs without a result (NULL bytes) are not documents.
    """
    docs = jobs.where(F.col("bytes").isNotNull() & (F.col("status") == "completed")).groupBy(
        "group_id").agg(
        F.count("*").alias("num_docs"), F.sum("bytes").alias("bytes"),
        F.min("created_at").alias("first_created"))
    return crawls.select("group_id", "cancelled").join(docs, "group_id", "left").select(
        "group_id", F.coalesce("num_docs", F.lit(0)).alias("num_docs"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"), "first_created",
        F.when(F.col("cancelled"), "failed").otherwise("completed").alias("state"))


UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """Adds ``verdict``: accepted, invalid_key or duplicate.

    Requests without a key are always accepted; of equal keys the first by
    (ts, request_id) wins.
    """
    key = F.coalesce("idempotency_key", F.lit(""))
    valid = key.rlike(UUID)
    firsts = requests.where(valid).groupBy(F.lower("idempotency_key").alias("_k")).agg(
        F.min_by("request_id", F.struct("ts", "request_id")).alias("_winner"))
    joined = requests.join(firsts, F.lower(key) == F.col("_k"), "left")
    verdict = (
        F.when(key == "", "accepted").when(~valid, "invalid_key")
        .when(F.col("request_id") == F.col("_winner"), "accepted").otherwise("duplicate"))
    return joined.select(*[requests[c] for c in requests.columns], verdict.alias("verdict"))


def cancel_crawls(groups: DataFrame, jobs: DataFrame,
                  requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies cancel requests.

    Returns the groups with ``cancelled`` and the answer to each request
    (`cancelled`, `already_completed`), and the jobs with open ones of
    cancelled crawls failed.
    """
    asked = requests.select(F.col("group_id").alias("id")).distinct().withColumn(
        "_asked", F.lit(True))
    marked = groups.join(asked, "id", "left").withColumns({
        "cancelled": F.col("_asked").isNotNull() & (F.col("status") != "completed"),
        "answer": F.when(F.col("_asked").isNull(), None)
        .when(F.col("status") == "completed", "already_completed").otherwise("cancelled"),
    }).drop("_asked")
    dead = marked.where("cancelled").select(
        F.col("id").alias("group_id"), F.lit(True).alias("_dead"))
    new_jobs = jobs.join(dead, "group_id", "left").withColumns({
        "status": F.when(
            F.col("_dead").isNotNull() & F.col("status").isin("queued", "active"), "failed"
        ).otherwise(F.col("status")),
    }).drop("_dead")
    return marked, new_jobs


UUID_ANYWHERE = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def _histogram(df: DataFrame, labels: list[str], seconds: Column, edges) -> DataFrame:
    t = df.withColumn("_t", seconds)
    buckets = [
        F.count_if(F.col("_t") <= F.lit(float(e))).alias(f"le_{str(e).replace('.', '_')}")
        for e in edges]
    return t.groupBy(*labels).agg(
        F.count("*").alias("n"), F.sum("_t").alias("seconds"), *buckets)


def route_latency(request_log: DataFrame, edges=HTTP_BUCKETS) -> DataFrame:
    """Request duration by method, route pattern and status, with histogram."""
    routed = request_log.withColumn(
        "route", F.regexp_replace("path", UUID_ANYWHERE, ":id"))
    return _histogram(routed, ["method", "route", "status"], F.col("seconds"), edges)


def job_latency(jobs: DataFrame, edges=JOB_BUCKETS) -> DataFrame:
    """Duration of finished jobs by mode and outcome, with histogram."""
    done = jobs.where(F.col("status").isin("completed", "failed")).withColumn(
        "outcome", F.when(F.col("status") == "completed", "success").otherwise("failed"))
    seconds = F.expr("timestampdiff(MICROSECOND, created_at, finished_at)") / 1e6
    return _histogram(done, ["mode", "outcome"], seconds, edges)
