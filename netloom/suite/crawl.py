"""Registered queries over crawl operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import url as U
from netloom.functions.tables import SKIPPED_FILE_EXTENSIONS, SOCIAL_SITES
from netloom.operators import crawl as C
from netloom.operators import discovery, robots, sitemaps
from netloom.operators.crawl import CrawlPolicy
from netloom.plans.ranking import rank_by_range
from netloom.plans.views import check_sql, view
from netloom.session import write_table
from netloom.suite import sqltext as T
from netloom.suite.registry import query

# Five forms of every link, so that each check has something to refuse.
_FORMS = ("[link, link || '/pic.png', 'mailto:x' || page_id || '@example.com', "
          "'https://www.twitter.com/u' || page_id, regexp_replace(link, '#.*$', '') || '#part']")
VARIANTS = f"""variants as (
select page_id, url, pos * 5 + generate_subscripts(m, 1) - 1 as pos, unnest(m) as link
from (select page_id, url, pos, {_FORMS} as m from (
  select page_id, url, pos, {T.resolve('href', 'url')} as link from all_links)))"""


def variants(spark, sf):
    links = view(spark, sf, "all_links").select(
        "page_id", "url", "pos", U.resolve_url("href", "url").alias("link"))
    n = F.col("page_id").cast("string")
    forms = F.array(
        F.col("link"), F.concat("link", F.lit("/pic.png")),
        F.concat(F.lit("mailto:x"), n, F.lit("@example.com")),
        F.concat(F.lit("https://www.twitter.com/u"), n),
        F.concat(F.regexp_replace("link", "#.*$", ""), F.lit("#part")))
    return links.select("page_id", "url", F.col("pos").alias("_p"),
                        F.posexplode(forms).alias("_i", "link")).select(
        "page_id", "url", (F.col("_p") * 5 + F.col("_i")).alias("pos"), "link")


def _sql_any(target, patterns):
    if not patterns:
        return "false"
    return "(" + " or ".join(f"regexp_matches({target}, '{p}')" for p in patterns) + ")"


def duck_reason(p: CrawlPolicy, initial: str, redirect: bool = False) -> str:
    """CASE over ``variants`` for one policy."""
    link, path = "link", T.path("link")
    target = link if p.regex_on_full_url and not redirect else path
    exts = ", ".join(f"'{e}'" for e in SKIPPED_FILE_EXTENSIONS)
    social = " or ".join(f"contains(link, '{s}')" for s in SOCIAL_SITES)
    part = r"regexp_extract(link, '#([^#]*)', 1)"
    include = (f"not {_sql_any(target, p.includes)}" if p.includes and not redirect else "false")
    external = (f"{T.bare_host(initial)} = {T.bare_host('url')} and not regexp_matches({path}, '^/*$')"
                if p.allow_external else "false")
    same_site = (f"{T.base_domain('link')} = {T.base_domain('url')}" if p.allow_subdomains else "false")
    backward = ("false" if p.allow_backward or redirect
                else f"not starts_with({path}, {T.path(initial)})")
    early = "" if redirect else (
        f"when {T.depth('link')} > {p.max_depth} then 'DEPTH_LIMIT' "
        rf"when regexp_extract({path}, '(\.[^.]*)$', 1) in ({exts}) then 'FILE_TYPE' ")
    return f"""case when link like 'mailto:%' then 'NON_WEB_PROTOCOL' {early}
  when {T.bare_host('link')} = {T.bare_host('url')} then case
    when contains(link, '#') and not (length({part}) > 1 and contains({part}, '/')) then 'SECTION_LINK'
    when {backward} then 'BACKWARD_CRAWLING'
    when {_sql_any(target, p.excludes)} then 'EXCLUDE_PATTERN'
    when {include} then 'INCLUDE_PATTERN' end
  else case when {social} then 'SOCIAL_MEDIA'
    when {_sql_any('link', p.excludes)} then 'EXCLUDE_PATTERN'
    when {external} then null
    when {same_site} and {include} then 'INCLUDE_PATTERN'
    when {same_site} then null else 'EXTERNAL_LINK' end end"""


SITE = CrawlPolicy(excludes=("^/[a-z]{2}$",))
WIDE = CrawlPolicy(includes=("^/(en|de)/", "^/T"), max_depth=2, allow_subdomains=True)
OUT = CrawlPolicy(excludes=("page=2",), allow_external=True, allow_backward=True,
                  regex_on_full_url=True, max_depth=1)
_ROOT = f"({T.origin('url')} || '/')"
_CASES = (("site", SITE, True), ("wide", WIDE, True), ("out", OUT, False))


@query("c01_filter_links", check_sql(" union all ".join(f"""
select '{name}' as policy, page_id, pos, link, {duck_reason(p, _ROOT if root else 'url')} as reason
from variants""" for name, p, root in _CASES), "all_links", extra=VARIANTS))
def _(spark, sf):
    rows, out = variants(spark, sf), None
    for name, policy, root in _CASES:
        initial = F.concat(U.origin("url"), F.lit("/")) if root else F.col("url")
        part = C.filter_links(rows.withColumn("initial_url", initial), C.valid_patterns(
            spark, policy)).select(F.lit(name).alias("policy"), "page_id", "pos", "link", "reason")
        out = part if out is None else out.unionByName(part)
    return out


@query("c02_filter_redirects", check_sql(f"""
select page_id, pos, {duck_reason(OUT, 'url', redirect=True)} as reason from variants
""", "all_links", extra=VARIANTS))
def _(spark, sf):
    pairs = variants(spark, sf).withColumns({"page_url": F.col("url"), "base_url": F.col("url")})
    return C.filter_redirects(pairs, OUT, href="link").select("page_id", "pos", "reason")


def flagged(spark, sf):
    rows = variants(spark, sf).withColumn("initial_url", F.concat(U.origin("url"), F.lit("/")))
    return C.filter_links(rows, SITE)


@query("c03_denial_report", check_sql(f"""
select domain, reason, count(*) as n, 'This URL ' || case reason
  {" ".join(f"when '{k}' then '{v}'" for k, v in C.DENIAL_TEXT.items())} end || '.' as message
from (select {T.base_domain('url')} as domain, {duck_reason(SITE, _ROOT)} as reason from variants)
where reason is not null group by all
""", "all_links", extra=VARIANTS))
def _(spark, sf):
    rows = U.with_domain(flagged(spark, sf), domain=U.host("url"))
    return C.denial_report(rows, "domain")


@query("c04_link_limit", check_sql(f"""
select page_id, pos, judged, case when judged then reason end as reason, judged and reason is null as allowed
from (select *, coalesce(sum(case when reason is null then 1 else 0 end) over (
        partition by page_id order by pos rows between unbounded preceding and 1 preceding), 0) < 4 as judged
  from (select page_id, pos, {duck_reason(SITE, _ROOT)} as reason from variants))
""", "all_links", extra=VARIANTS))
def _(spark, sf):
    return C.link_limit(flagged(spark, sf), 4).select("page_id", "pos", "judged", "reason", "allowed")


_HOSTS = f"(select distinct {T.host('url')} as host from pages)"


def robots_files(spark, sf):
    """One robots file per host of the page table."""
    return view(spark, sf, "pages").select(U.host("url").alias("host")).distinct().withColumn(
        "text", F.concat(
            F.lit("# file of "), F.col("host"),
            F.lit("\r\nUser-Agent: *\nDisallow: /de/ # not here\nAllow: /de/1\nCrawl-delay: 2\n\n"
                  "User-agent: loombot\nUser-agent: otherbot\nDisallow: /*page=\nDisallow: /x$\n"
                  "Sitemap: http://"), F.col("host"), F.lit("/sitemap.xml\nUser-agent: idle\n")))


@query("c05_parse_robots", f"""
select host, agent, kind, value from {_HOSTS}, (values
  ('*', 'disallow', '/de/'), ('*', 'allow', '/de/1'), ('*', 'delay', '2.0'),
  ('loombot', 'disallow', '/*page='), ('otherbot', 'disallow', '/*page='),
  ('loombot', 'disallow', '/x$'), ('otherbot', 'disallow', '/x$'), ('idle', 'none', null))
  v(agent, kind, value)
union all select host, null, 'sitemap', 'http://' || host || '/sitemap.xml' from {_HOSTS}
""")
def _(spark, sf):
    files = robots_files(spark, sf)
    rules = robots.parse_robots(files).select(
        "host", "agent", F.when(F.col("pattern").isNull(), "none").when(F.col("allow"), "allow")
        .otherwise("disallow").alias("kind"), F.col("pattern").alias("value"))
    delays = robots.crawl_delays(files).select(
        "host", "agent", F.lit("delay").alias("kind"), F.col("delay").cast("string").alias("value"))
    maps = robots.robots_sitemaps(files).select(
        "host", F.lit(None).cast("string").alias("agent"), F.lit("sitemap").alias("kind"),
        F.col("sitemap").alias("value"))
    return rules.unionByName(delays).unionByName(maps)


@query("c06_robots_allowed", check_sql(f"""
select page_id, pos, not (starts_with(p, '/de/') and not starts_with(p, '/de/1'))
    and not (p = '/de' and not contains(link, '?') and not contains(link, '#')) as any_agent,
  not contains({T.path('link')} || case when {T.query('link')} = '' then '' else '?' || {T.query('link')} end, 'page=')
    and p <> '/x' as loombot
from (select *, {T.path('link')} as p from (select page_id, pos, {T.resolve('href', 'url')} as link from all_links))
""", "all_links"))
def _(spark, sf):
    links = view(spark, sf, "all_links").select(
        "page_id", "pos", U.resolve_url("href", "url").alias("link"))
    # Links of other hosts meet the rules of their own host.
    rules = robots.parse_robots(robots_files(spark, sf))
    return robots.robots_checks(links, rules, {"any_agent": ("*",), "loombot": ("loombot",)}, "link").select(
        "page_id", "pos", "any_agent", "loombot")


def site_files(spark, sf):
    """A urlset per host, a nested one per host and one index of all hosts.

    Sorting inside a host keeps the text fixed; a sitemap is one document.
    """
    pages = view(spark, sf, "pages").select("page_id", "url", U.host("url").alias("host"))
    amp = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("<url><loc> "), amp, F.lit(" </loc></url>"))
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))),
                                    lambda s: s["e"]), "")
    sets = pages.groupBy("host").agg(body.alias("body")).select(
        F.concat(F.lit("http://"), F.col("host"), F.lit("/pages.xml")).alias("sitemap_url"),
        F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><urlset {ns}>'), "body",
                 F.lit("</urlset>")).alias("xml"))
    tops = pages.select("host").distinct().select(
        F.concat(F.lit("http://"), F.col("host"), F.lit("/sitemap.xml")).alias("sitemap_url"),
        F.concat(F.lit(f"<sitemapindex {ns}><sitemap><loc>http://"), "host",
                 F.lit("/pages.xml</loc></sitemap><sitemap><loc>http://"), "host",
                 F.lit("/more.xml</loc></sitemap></sitemapindex>")).alias("xml"))
    more = pages.select("host").distinct().select(
        F.concat(F.lit("http://"), F.col("host"), F.lit("/more.xml")).alias("sitemap_url"),
        F.concat(F.lit(f"<urlset {ns}><url><loc>http://"), "host", F.lit("/pages.xml</loc></url><url><loc>http://"),
                 "host", F.lit("/logo.PNG</loc></url><url><loc>http://"), "host",
                 F.lit("/extra</loc></url></urlset>")).alias("xml"))
    bad = pages.select("host").distinct().select(
        F.concat(F.lit("http://"), F.col("host"), F.lit("/bad.xml")).alias("sitemap_url"),
        F.lit("<urlset><url><loc>oops").alias("xml"))
    return sets.unionByName(tops).unionByName(more).unionByName(bad)


@query("c07_sitemap_entries", f"""
select 'http://' || {T.host('url')} || '/pages.xml' as sitemap_url, url as loc, 'process' as action from pages
union all select 'http://' || host || '/sitemap.xml', 'http://' || host || '/pages.xml', 'recurse' from {_HOSTS}
union all select 'http://' || host || '/sitemap.xml', 'http://' || host || '/more.xml', 'recurse' from {_HOSTS}
union all select 'http://' || host || '/more.xml', 'http://' || host || '/pages.xml', 'recurse' from {_HOSTS}
union all select 'http://' || host || '/more.xml', 'http://' || host || '/extra', 'process' from {_HOSTS}
union all select 'http://' || host || '/bad.xml', null, 'bad' from {_HOSTS}
""")
def _(spark, sf):
    return sitemaps.sitemap_entries(site_files(spark, sf)).select("sitemap_url", "loc", "action")


@query("c08_expand_sitemaps", f"""
select h.id as crawl_id, p.url, 1 as level from pages p join (
  select host, row_number() over (order by host) as id from {_HOSTS}) h on {T.host('p.url')} = h.host
union all select row_number() over (order by host), 'http://' || host || '/extra', 1 from {_HOSTS}
""")
def _(spark, sf):
    roots = sitemap_roots(spark, sf)
    return sitemaps.expand_sitemaps(site_files(spark, sf), roots).select(
        "crawl_id", "url", F.col("level").cast("bigint").alias("level"))


def sitemap_roots(spark, sf):
    """One crawl per host, numbered by host name."""
    hosts = view(spark, sf, "pages").select(U.host("url").alias("host")).distinct().withColumn("all", F.lit(0))
    return rank_by_range(hosts, ["all"], [F.col("host")], "crawl_id").select(
        F.col("crawl_id").cast("bigint").alias("crawl_id"),
        F.concat(F.lit("http://"), "host", F.lit("/sitemap.xml")).alias("sitemap_url"),
        F.lit(0).cast("bigint").alias("pos"))


@query("c09_sitemap_candidates", f"""
select crawl_id, sitemap_url, min(pos)::bigint as pos, arg_min(only_host, pos) as only_host from (
  select page_id as crawl_id, unnest([
    regexp_replace({T.origin('url')} || {T.path('url')}, '/$', '') || '/sitemap.xml',
    {T.origin('url')} || '/sitemap.xml',
    {T.scheme('url')} || '://' || {T.base_domain('url')} || '/sitemap.xml',
    'http://' || {T.host('url')} || '/sitemap.xml']) as sitemap_url,
    unnest([1000, 1001, 1002, 9]) as pos,
    unnest([null, null, {T.host('url')}, null]) as only_host from pages)
group by crawl_id, sitemap_url
""")
def _(spark, sf):
    seeds = view(spark, sf, "pages").select(F.col("page_id").alias("crawl_id"), "url")
    return sitemaps.sitemap_candidates(seeds, robots.robots_sitemaps(robots_files(spark, sf)).withColumn(
        "n", F.lit(9)))


@query("c10_claim_urls", check_sql(f"""
with c as (select page_id % 7 as crawl_id, page_id * 10000 + pos as pos,
    {T.resolve('href', 'url')} as link from all_links),
k as (select crawl_id, pos, link, {T.normalize('link')} as plain, {T.similar_key(T.normalize('link'))} as sim from c),
seen as (select crawl_id, plain, sim from k where pos % 11 = 0),
p as (select crawl_id, arg_min(link, pos) as url, plain as key, min(pos) as pos from k
  where (crawl_id, plain) not in (select crawl_id, plain from seen) group by crawl_id, plain),
s as (select crawl_id, arg_min(link, pos) as url, sim as key, min(pos) as pos from k
  where (crawl_id, sim) not in (select crawl_id, sim from seen) group by crawl_id, sim)
select 'plain' as mode, p.crawl_id, url, key from p
  left join (select crawl_id, count(distinct plain) as used from seen group by 1) u using (crawl_id)
  qualify row_number() over (partition by crawl_id order by pos, key) + coalesce(used, 0) <= 60
union all select 'similar', crawl_id, url, key from s
""", "all_links"))
def _(spark, sf):
    rows = view(spark, sf, "all_links").select(
        F.expr("page_id % 7").alias("crawl_id"), (F.col("page_id") * 10000 + F.col("pos")).alias("pos"),
        U.resolve_url("href", "url").alias("url"))
    # one pass over the links gives both keys; claims and visited URLs read the written rows
    keyed = write_table(C.with_url_keys(rows))
    out = None
    for mode, limit in (("plain", 60), ("similar", None)):
        own = keyed.select("crawl_id", "url", "pos", F.col(f"{mode}_key").alias("key"))
        part = C.claim_keys(own, own.where("pos % 11 = 0"), limit, F.floor(F.col("pos") / 1_000_000)).select(
            F.lit(mode).alias("mode"), "crawl_id", "url", "key")
        out = part if out is None else out.unionByName(part)
    return out


_WEB = CrawlPolicy(allow_external=True, allow_backward=True, max_depth=10)


@query("c11_crawl_corpus", check_sql(f"""
with recursive edges as (
  select distinct {T.normalize('url')} as src, {T.normalize('link')} as dst,
    {T.bare_host('url')} as src_host, {T.bare_host('link')} as dst_host, contains(link, '#') as section
  from (select url, {T.resolve('href', 'url')} as link from page_links)),
walk(crawl_id, seed_host, key, depth) as (
  select page_id, {T.bare_host('url')}, {T.normalize('url')}, 0 from pages where page_id % 40 = 3
  union
  select w.crawl_id, w.seed_host, e.dst, w.depth + 1 from walk w join edges e on e.src = w.key
  where w.depth < 3 and (e.src_host = e.dst_host and not e.section
    or e.src_host <> e.dst_host and e.src_host = w.seed_host))
select crawl_id, key, min(depth)::bigint as depth, true as captured from walk group by crawl_id, key
""", "page_links", recursive=True))
def _(spark, sf):
    # The page table with its cross-page links written into the pages.
    links = view(spark, sf, "page_links").groupBy("page_id").agg(F.concat_ws("", F.array_sort(
        F.collect_list(F.concat(F.lit('<a href="'), F.col("href"), F.lit('">x</a>'))))).alias("html"))
    corpus = view(spark, sf, "pages").select("page_id", "url").join(links, "page_id")
    seeds = corpus.where("page_id % 40 = 3").select(F.col("page_id").alias("crawl_id"), "url")
    found = discovery.crawl_corpus(corpus, seeds, _WEB, max_discovery_depth=3)
    return found.select("crawl_id", "key", F.col("depth").cast("bigint").alias("depth"), "captured")


@query("c12_kickoff_jobs", check_sql(f"""
with all_urls as (
  select page_id as crawl_id, url, 15 as priority from pages
  union all select page_id, {T.resolve('href', 'url')}, 20 from all_links
  union all select page_id, {T.origin('url')} || '/', 21 from pages
  union all select page_id, url, 21 from pages)
select crawl_id, {T.normalize('url')} as key, min(priority)::bigint as priority from all_urls group by all
""", "all_links"))
def _(spark, sf):
    pages = view(spark, sf, "pages").select(F.col("page_id").alias("crawl_id"), "url", F.lit(0).alias("pos"))
    found = view(spark, sf, "all_links").select(
        F.col("page_id").alias("crawl_id"), U.resolve_url("href", "url").alias("url"), "pos")
    maps = pages.unionByName(pages.select(
        "crawl_id", F.concat(U.origin("url"), F.lit("/")).alias("url"), F.lit(1).alias("pos")))
    return C.kickoff_jobs(pages, maps, found).select("crawl_id", "key", "priority")


@query("c13_reconcile_redirects", f"""
with f as (select page_id % 5 as crawl_id, page_id as fetch_id, url as source_url,
  case page_id % 6 when 0 then url when 1 then regexp_replace(url, '^http:', 'https:')
    when 2 then {T.origin('url')} || '/moved/' || (page_id % 4) when 3 then 'https://other.example.com/en/1'
    when 4 then {T.origin('url')} || '/seen' else 'https://www.twitter.com/x' end as final_url,
  page_id % 12 = 3 as is_seed from pages),
k as (select *, {T.normalize('source_url')} as s, {T.normalize('final_url')} as d from f),
j as (select *, {T.similar_key('s')} as sc, {T.similar_key('d')} as dc,
  {T.bare_host('final_url')} = {T.bare_host('source_url')} as same_host,
  case when s <> d and not is_seed then
    case when {T.bare_host('final_url')} = {T.bare_host('source_url')}
           then case when contains(final_url, '#') then 'SECTION_LINK' end
         when contains(final_url, 'twitter.com') then 'SOCIAL_MEDIA'
         when {T.base_domain('final_url')} <> {T.base_domain('source_url')} then 'EXTERNAL_LINK' end end as reason
  from k),
b as (select *, s <> d and reason is null and {T.base_domain('final_url')} = 'example.net' as blocked from j),
c as (select *, s <> d and reason is null and not blocked and sc <> dc as candidate from b)
select crawl_id, fetch_id, case when s = d then 'same' when reason is not null then 'denied' when blocked then 'blocked'
    when not candidate then 'equivalent'
    when {T.path('final_url')} = '/seen' then 'raced'
    when fetch_id <> min(case when candidate then fetch_id end) over (partition by crawl_id, dc) then 'raced'
    else 'moved' end as outcome,
  reason, case when is_seed and s <> d and not same_host then final_url end as new_origin
from c
""")
def _(spark, sf):
    site = U.origin("url")
    kind = F.col("page_id") % 6
    final = (
        F.when(kind == 0, F.col("url")).when(kind == 1, F.regexp_replace("url", "^http:", "https:"))
        .when(kind == 2, F.concat(site, F.lit("/moved/"), (F.col("page_id") % 4).cast("string")))
        .when(kind == 3, F.lit("https://other.example.com/en/1"))
        .when(kind == 4, F.concat(site, F.lit("/seen"))).otherwise(F.lit("https://www.twitter.com/x")))
    pages = view(spark, sf, "pages")
    fetches = pages.select(
        F.expr("page_id % 5").alias("crawl_id"), F.col("page_id").alias("fetch_id"),
        F.col("url").alias("source_url"), final.alias("final_url"), F.col("url").alias("base_url"),
        F.expr("page_id % 12 = 3").alias("is_seed"))
    visited = pages.select(F.expr("page_id % 5").alias("crawl_id"),
                           F.concat(site, F.lit("/seen")).alias("url"))
    policy = CrawlPolicy(allow_subdomains=True)
    listed = spark.createDataFrame([("example.net",), ("spam.example",)], "domain string")
    return C.reconcile_redirects(fetches, visited, policy, blocklist=listed).select(
        "crawl_id", "fetch_id", "outcome", "reason", "new_origin")


def blocklist(spark):
    return spark.createDataFrame([("example.org",), ("spam.net",)], "domain string")


@query("c14_drop_blocked", f"""
select page_id, url from pages where not ({T.base_domain('url')} = 'example.org' and not contains(url, '/en/'))
""")
def _(spark, sf):
    return C.drop_blocked(view(spark, sf, "pages").select("page_id", "url"), blocklist(spark),
                          allowed_keywords=("/EN/",), unblocked=("spam.net",))


@query("c15_route_by_domain", f"""
select page_id, case {T.base_domain('url')} when 'example.net' then 'browser' when 'example.com' then 'plain' end
  as route from pages
""")
def _(spark, sf):
    mapping = spark.createDataFrame(
        [(0, "*.Example.net", "browser"), (1, "net", "never"), (2, "example.com", "plain"),
         (3, "*.example.com", "late")], "ordinal int, pattern string, route string")
    return C.route_by_domain(view(spark, sf, "pages").select("page_id", "url"), mapping).select(
        "page_id", "route")


def attempts(spark, sf):
    """Two attempts per URL: the plain text, then the rendered one."""
    rows = view(spark, sf, "attempts")
    return rows.select("url", "page_id", F.lit(1).alias("attempt"), "status", F.col("plain").alias("content")
                       ).unionByName(rows.select(
                           "url", "page_id", F.lit(2).alias("attempt"), F.lit(200).alias("status"),
                           F.col("rendered").alias("content")))


@query("c16_best_attempt", check_sql("""
select url, attempt, status, needs_proxy from (
  select url, 1 as attempt, status, trim(plain) <> '' or not (status between 200 and 299 or status = 304) as usable,
    status in (401, 403, 429) as needs_proxy from attempts
  union all select url, 2, 200, trim(rendered) <> '', false from attempts)
where usable qualify row_number() over (partition by url order by attempt) = 1
""", "attempts"))
def _(spark, sf):
    # pages may share a URL; the SQL leaves their order open, here the first page goes first
    return C.best_attempt(attempts(spark, sf), ("attempt", "page_id")).select("url", "attempt", "status", "needs_proxy")


@query("c17_fetcher_verdict", check_sql(f"""
with v as (select {T.host('site_url')} as site, rendered = '' as failed,
    coalesce(rendered <> '' and plain <> '' and 1.0 - levenshtein(rendered, plain)
      / cast(greatest(length(rendered), length(plain)) as double) >= 0.9, false) as ok from attempts),
s as (select site, count(*) as total, count(*) filter (where failed) as render_failed,
  count(*) filter (where ok) as plain_ok, count(*) filter (where not ok and not failed) as browser_needed
  from v group by site)
select *, case when render_failed / total > 0.5 or total = render_failed then 'uncertain'
  when plain_ok / (total - render_failed) >= 0.7 then 'plain_ok' else 'browser_required' end as verdict from s
""", "attempts"))
def _(spark, sf):
    rows = view(spark, sf, "attempts").select(
        U.host("site_url").alias("site"), "url", F.col("rendered").alias("rendered_basic"),
        F.lit(None).cast("string").alias("rendered_stealth"), F.col("plain").alias("plain_basic"),
        F.lit(None).cast("string").alias("plain_stealth"))
    return C.fetcher_verdict(rows, 0.9, 0.7, 0.5)


@query("c18_change_status", """
with prev as (select url, case when page_id % 5 = 1 then html || 'x' else html end as h, page_id from pages where page_id % 7 <> 2),
cur as (select url, html as h from pages where page_id % 6 <> 4)
select url, case when prev.h is null then 'new' when cur.h is null then 'removed'
  when prev.h = cur.h then 'same' else 'changed' end as status, page_id as previous_at
from prev full outer join cur using (url)
""")
def _(spark, sf):
    pages = view(spark, sf, "pages")
    previous = pages.where("page_id % 7 <> 2").select(
        "url", F.expr("case when page_id % 5 = 1 then html || 'x' else html end").alias("content"),
        F.col("page_id").alias("fetched_at"))
    current = pages.where("page_id % 6 <> 4").select("url", F.col("html").alias("content"), F.lit(0).alias("fetched_at"))
    return C.change_status(previous, current)


@query("c19_batch_urls", f"""
with u as (select page_id % 4 as batch_id, page_id,
  case page_id % 5 when 0 then 'ftp://x.example.com/' || page_id when 1 then regexp_replace(url, '^https?://', '')
    else url end as url, {T.base_domain('url')} = 'example.org' as blocked, page_id % 5 = 0 as bad from pages),
v as (select batch_id, case when page_id % 5 = 1 then 'http://' || url else url end as url,
  case when count(*) over (partition by batch_id) > 1000 then 21 else 20 end as priority
  from u where not bad and not blocked)
select batch_id, url, priority, null as reason from v
union all select batch_id, url, null, case when bad then 'unsupported_protocol' else 'blocked' end from u where bad or blocked
""")
def _(spark, sf):
    rows = view(spark, sf, "pages").select(F.expr("page_id % 4").alias("batch_id"), F.expr(
        """case page_id % 5 when 0 then 'ftp://x.example.com/' || page_id
           when 1 then regexp_replace(url, '^https?://', '') else url end""").alias("url"))
    valid, invalid = C.batch_urls(rows, blocklist(spark))
    return valid.withColumn("reason", F.lit(None).cast("string")).unionByName(
        invalid.withColumn("priority", F.lit(None).cast("bigint")))


@query("c20_coverage_warning", f"""
select page_id as crawl_id, (page_id % 3)::bigint as n, case when page_id % 3 <= 1 and page_id % 4 <> 0
  then 'Only ' || page_id % 3 || ' result(s) found. For broader coverage, try the base domain: '
    || {T.base_domain('url')} end as warning
from pages
""")
def _(spark, sf):
    pages = view(spark, sf, "pages")
    seeds = pages.select(F.col("page_id").alias("crawl_id"), F.when(
        F.col("page_id") % 4 == 0, F.concat(F.lit("https://www."), U.base_domain("url")))
        .otherwise(F.col("url")).alias("url"))
    results = pages.select(F.col("page_id").alias("crawl_id"), F.explode(F.expr(
        "slice(array(1, 2), 1, cast(page_id % 3 as int))")))
    return C.coverage_warning(results, seeds)


@query("c21_drop_ad_urls", check_sql(f"""
select page_id, pos, link from (
  select page_id, pos, case when pos % 3 = 0 then 'https://cdn.adnxs.com/' || page_id
    else {T.resolve('href', 'url')} end as link from all_links)
where not contains({T.host('link')}, 'adnxs.com')
""", "all_links"))
def _(spark, sf):
    links = view(spark, sf, "all_links").select("page_id", "pos", F.when(
        F.col("pos") % 3 == 0, F.concat(F.lit("https://cdn.adnxs.com/"), F.col("page_id").cast("string")))
        .otherwise(U.resolve_url("href", "url")).alias("link"))
    return C.drop_ad_urls(links, url="link")
