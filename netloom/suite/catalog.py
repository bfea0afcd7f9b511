"""All registered queries."""

from __future__ import annotations

from netloom.suite import crawl, extras, jobs, layout, memory, pages, search, streams, urls  # noqa: F401
from netloom.plans.views import check_sql
from netloom.suite import sqltext as T
from netloom.suite.registry import CHECKS, QUERIES, query

__all__ = ["CHECKS", "QUERIES", "site_link_report"]


@query("site_link_report", check_sql(f"""
select domain, reason, count(*) as n from (
  select {T.base_domain('url')} as domain, case when regexp_matches({T.path('link')}, '^/[a-z]{{2}}$') then 'EXCLUDE_PATTERN'
    when regexp_matches({T.path('link')}, '[.](png|jpg|js|css|zip|inc)$') then 'FILE_TYPE' else 'ALLOWED' end as reason
  from (select distinct page_id, url, {T.resolve('href', 'url')} as link from links) where link <> '')
group by all
""", "links"))
def site_link_report(spark, sf_dir):
    """Flagship: why links of a corpus would not be crawled, per site.

    Reads pages, extracts and resolves links, applies the crawl policy of each
    page's own site, and counts denial reasons per registrable domain.
    """
    from pyspark.sql import functions as F

    from netloom.functions import url as U
    from netloom.operators import crawl as C
    from netloom.operators import pages as P
    from netloom.sources.readers import read_pages

    links = P.extract_links(read_pages(spark, f"{sf_dir}/pages.parquet"))
    seeded = links.withColumn("initial_url", F.concat(U.origin("url"), F.lit("/")))
    policy = C.valid_patterns(spark, C.CrawlPolicy(excludes=("^/[a-z]{2}$",)))
    judged = U.with_domain(C.filter_links(seeded, policy), domain=U.host("url"))
    counted = judged.groupBy("domain", F.coalesce("reason", F.lit("ALLOWED")).alias("reason")).agg(
        F.count("*").alias("n"))
    return counted
