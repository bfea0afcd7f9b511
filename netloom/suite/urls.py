"""Registered queries over URL expressions.

They read every page URL and every link of the page table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import url as U
from netloom.functions.tables import SKIPPED_FILE_EXTENSIONS
from netloom.plans.views import check_sql, view
from netloom.suite import sqltext as T
from netloom.suite.registry import query

ABS = f"(select page_id, pos, url, {T.resolve('href', 'url')} as link from all_links)"


def links(spark, sf):
    return view(spark, sf, "all_links").select(
        "page_id", "pos", "url", U.resolve_url("href", "url").alias("link"))


@query("u01_url_parts", check_sql(f"""
select page_id, pos, {T.scheme('link')} as scheme, {T.host('link')} as host, {T.path('link')} as path,
  {T.query('link')} as query, {T.fragment('link')} as fragment from {ABS}
""", "all_links"))
def _(spark, sf):
    return links(spark, sf).select("page_id", "pos", U.url_parts("link").alias("p")).select(
        "page_id", "pos", "p.scheme", "p.host", "p.path", "p.query", "p.fragment")


@query("u02_resolve_url", check_sql(f"select page_id, pos, link from {ABS}", "all_links"))
def _(spark, sf):
    return links(spark, sf).select("page_id", "pos", "link")


@query("u03_normalize_url", check_sql(f"""
select page_id, pos, {T.normalize('link')} as kept, {T.normalize('link', True)} as no_query from {ABS}
""", "all_links"))
def _(spark, sf):
    return links(spark, sf).select(
        "page_id", "pos", U.normalize_url("link").alias("kept"),
        U.normalize_url("link", True).alias("no_query"))


@query("u04_canonical_url", check_sql(
    f"select page_id, pos, {T.canonical('link')} as canonical from {ABS}", "all_links"))
def _(spark, sf):
    return links(spark, sf).select("page_id", "pos", U.canonical_url("link").alias("canonical"))


@query("u05_hostname_only", check_sql(f"""
select page_id, pos, {T.bare_host('link')} as host,
  split_part({T.canonical('href')}, '/', 1) as loose_host
from (select *, {T.canonical('link')} as href from {ABS})
""", "all_links"))
def _(spark, sf):
    return links(spark, sf).select(
        "page_id", "pos", U.hostname_only("link").alias("host"),
        U.hostname_only(U.canonical_url("link")).alias("loose_host"))


@query("u06_url_depth", check_sql(f"""
select page_id, pos, {T.depth('link')} as depth, {T.depth('url')} + 3 as max_depth from {ABS}
""", "all_links"))
def _(spark, sf):
    return links(spark, sf).select(
        "page_id", "pos", U.url_depth("link").cast("bigint").alias("depth"),
        U.adjusted_max_depth("url", 3).cast("bigint").alias("max_depth"))


@query("u07_base_domain", check_sql(f"""
select page_id, pos, {T.base_domain('link')} as base_domain,
  {T.bare_host('link')} = {T.base_domain('link')} and {T.path('link')} = '/' as is_base,
  {T.base_domain('link')} as by_table
from {ABS}
""", "all_links"))
def _(spark, sf):
    suffixes = spark.createDataFrame([("com",), ("net",), ("org",), ("co.uk",)], "suffix string")
    rows = links(spark, sf).select(
        "page_id", "pos", U.base_domain("link").alias("base_domain"),
        U.is_base_domain("link").alias("is_base"), U.host("link").alias("host"))
    return U.with_base_domain(rows, suffixes, "host", "by_table").drop("host")


@query("u08_same_site", check_sql(f"""
select page_id, pos, {T.last_two(T.bare_host('link'))} = {T.last_two(T.bare_host('url'))} as same_domain,
  {T.bare_host('link')} = {T.bare_host('url')} as same_subdomain from {ABS}
""", "all_links"))
def _(spark, sf):
    return links(spark, sf).select(
        "page_id", "pos", U.same_domain("link", "url").alias("same_domain"),
        U.same_subdomain("link", "url").alias("same_subdomain"))


_FORMS = "['/index.html', '/index.php', '/', '']"


@query("u09_url_permutations", check_sql(f"""
select distinct page_id, s || '://' || w || host || case when stem || f = '' then '/' else stem || f end
  || tail as spelling
from (select page_id, {T.bare_host('url')} as host, {T.stem('url')} as stem, {T.tail('url')} as tail,
        unnest(['www.', '']) as w from pages),
  (select unnest(['http', 'https']) as s), (select unnest({_FORMS}) as f)
"""))
def _(spark, sf):
    return view(spark, sf, "pages").select(
        "page_id", F.explode(U.url_permutations("url")).alias("spelling"))


@query("u10_similar_url_key", check_sql(f"""
select page_id, pos, {T.similar_key('link')} as similar_key from {ABS}
""", "all_links"))
def _(spark, sf):
    return links(spark, sf).select("page_id", "pos", U.similar_url_key("link").alias("similar_key"))


@query("u11_validate_url", check_sql(r"""
select page_id, k, case when regexp_matches(u, '^(?i)[^.:]+://') then u else 'http://' || u end as url,
  k in (0, 1) as ok,
  case k when 2 then 'unsupported_protocol' when 3 then 'no_top_level_domain'
    when 4 then 'invalid_protocol' end as reason
from (select page_id, k, case k when 0 then url
        when 1 then regexp_replace(url, '^https?://', '')
        when 2 then regexp_replace(url, '^https?', 'gopher') when 3 then 'http://localhost/' || page_id
        else 'http://' || url end as u
      from (select *, cast(unnest([0, 1, 2, 3, 4]) as bigint) as k from pages))
"""))
def _(spark, sf):
    cases = view(spark, sf, "pages").select(
        "page_id", F.posexplode(F.array(
            F.col("url"), F.regexp_replace("url", "^https?://", ""),
            F.regexp_replace("url", "^https?", "gopher"),
            F.concat(F.lit("http://localhost/"), F.col("page_id").cast("string")),
            F.concat(F.lit("http://"), F.col("url")))).alias("k", "u"))
    v = U.validate_url("u")
    return cases.select("page_id", F.col("k").cast("bigint").alias("k"),
                        v["url"].alias("url"), v["ok"].alias("ok"), v["reason"].alias("reason"))


@query("u12_clean_map_url", check_sql(rf"""
select page_id, pos, trim(split_part(regexp_replace(link, '/$', ''), '?', 1)) as cleaned,
  trim(regexp_replace(link, '/$', '')) as with_query
from {ABS}
""", "all_links"))
def _(spark, sf):
    return links(spark, sf).select(
        "page_id", "pos", U.clean_map_url("link").alias("cleaned"),
        U.clean_map_url("link", False).alias("with_query"))


@query("u13_rewrite_export_url", r"""
select page_id, k, case k
  when 0 then 'https://docs.google.com/document/d/D' || page_id || '/export?format=html'
  when 1 then 'https://docs.google.com/presentation/d/P-' || page_id || '/export?format=html'
  when 2 then 'https://drive.google.com/uc?export=download&id=F_' || page_id
  when 3 then 'https://docs.google.com/spreadsheets/d/S' || page_id || '/gviz/tq?tqx=out:html&gid=' || page_id
  end as export_url
from (select page_id, cast(unnest([0, 1, 2, 3, 4, 5]) as bigint) as k from pages)
""")
def _(spark, sf):
    n = F.col("page_id").cast("string")
    cases = F.array(
        F.concat(F.lit("https://docs.google.com/document/d/D"), n, F.lit("/edit")),
        F.concat(F.lit("http://docs.google.com/presentation/d/P-"), n, F.lit("/edit#slide=1")),
        F.concat(F.lit("https://drive.google.com/file/d/F_"), n, F.lit("/view")),
        F.concat(F.lit("https://docs.google.com/spreadsheets/d/S"), n, F.lit("/edit#gid="), n),
        F.concat(F.lit("https://docs.google.com/document/d/e/X"), n, F.lit("/pub")),
        F.col("url"))
    return view(spark, sf, "pages").select("page_id", F.posexplode(cases).alias("k", "u")).select(
        "page_id", F.col("k").cast("bigint").alias("k"), U.rewrite_export_url("u").alias("export_url"))


_EXT_LIST = ", ".join(f"'{e}'" for e in SKIPPED_FILE_EXTENSIONS)


@query("u14_content_route", check_sql(rf"""
select page_id, pos,
  case when ct = 'text/rtf' then 'document'
    when ct = 'application/pdf; q=1' then 'pdf'
    when ct = 'application/octet-stream' then 'document'
    when regexp_extract({T.path('link')}, '(\.[^.]*)$', 1) in ({_EXT_LIST}) then 'skip'
    else 'html' end as route
from (select *, case (page_id + pos) % 7 when 0 then 'text/rtf' when 1 then 'application/pdf; q=1'
    when 2 then 'application/octet-stream' when 3 then null else 'text/html' end as ct from {ABS})
""", "all_links"))
def _(spark, sf):
    ct = F.expr("""case (page_id + pos) % 7 when 0 then 'text/rtf' when 1 then 'application/pdf; q=1'
        when 2 then 'application/octet-stream' when 3 then null else 'text/html' end""")
    return links(spark, sf).select(
        "page_id", "pos", U.content_route("link", ct, F.lit("PK..")).alias("route"))


@query("u15_repo_ref", check_sql(rf"""
select page_id, pos, string_split({T.path('link')}, '/')[2] as owner,
  regexp_replace(string_split({T.path('link')}, '/')[3], '\.git$', '') as repo
from {ABS} where len(list_filter(string_split({T.path('link')}, '/'), lambda s: s <> '')) >= 2
""", "all_links"))
def _(spark, sf):
    moved = F.regexp_replace("link", r"^https?://[^/]+", "https://github.com")
    return links(spark, sf).select("page_id", "pos", U.repo_ref(moved).alias("r")).where(
        "r is not null").select("page_id", "pos", "r.owner", "r.repo")


@query("u16_locale_ok", r"""
select page_id, country, ok as country_ok,
  case when country = '' then 'us-generic' when ok then lower(country) end as country_used
from (select *, country in ('FR', 'en', 'ES', 'de', 'us-generic', '') and country <> 'en' as ok
  from (select page_id, case when page_id % 11 = 0 then '' when page_id % 7 = 0 then 'us-generic'
      when page_id % 5 = 0 then 'zz' else
      case regexp_extract(html, '<html lang="([a-z]*)"', 1) when 'fr' then 'FR' when 'es' then 'ES'
        when 'de' then 'de' else 'en' end end as country from pages))
""")
def _(spark, sf):
    rows = view(spark, sf, "pages").select("page_id", F.expr(r"""
      case when page_id % 11 = 0 then '' when page_id % 7 = 0 then 'us-generic'
        when page_id % 5 = 0 then 'zz' else
        case regexp_extract(html, '<html lang="([a-z]*)"', 1) when 'fr' then 'FR' when 'es' then 'ES'
          when 'de' then 'de' else 'en' end end""").alias("country"))
    return U.locale_ok(rows, U.country_table(spark))
