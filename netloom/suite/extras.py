"""Registered queries over sources, sinks and extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom import extensions as X
from netloom.functions import url as U
from netloom.operators import jobs as J
from netloom.operators import sitemaps
from netloom.plans.views import check_sql, view
from netloom.sources import readers, tables
from netloom.streaming.runner import work_folder
from netloom.suite import sqltext as T
from netloom.suite.pages import duck_blocks, duck_main
from netloom.suite.registry import joined, query


@query("s02_read_fetch_capture", """
select page_id * 1000 as ms, url, 'GET' as method, 200 + page_id % 3 as status, length(html) as chars from pages
""")
def _(spark, sf):
    folder = work_folder(spark, "capture")
    record = F.struct(
        (F.col("page_id") * 1000).alias("time"),
        F.struct("url", F.lit("GET").alias("method"), F.lit(1).alias("tryCount")).alias("options"),
        F.struct((F.col("page_id") % 3 + 200).alias("status"), F.col("html").alias("body")).alias("result"))
    # Each capture file is one JSON array, as the recorder writes it.
    view(spark, sf, "pages").groupBy(F.expr("page_id div 20")).agg(
        F.to_json(F.collect_list(record)).alias("value")).select("value").write.option(
        "lineSep", "\n").option("maxRecordsPerFile", 1).text(folder)
    log = readers.read_fetch_capture(spark, folder, "document")
    return log.select(F.unix_millis("time").alias("ms"), "url", "method", F.col("status").cast("bigint").alias("status"),
                      F.length("body").cast("bigint").alias("chars"))


@query("s04_read_sitemaps", f"""
select 'http://' || {T.host('url')} || '/pages.xml' as sitemap_url, url as loc from pages
""")
def _(spark, sf):
    from netloom.suite.crawl import site_files

    folder = work_folder(spark, "sitemaps")
    site_files(spark, sf).where("sitemap_url like '%/pages.xml'").select(
        F.regexp_extract("sitemap_url", "://([^/]*)", 1).alias("host"), "xml").repartition("host").write.option(
        "compression", "gzip").option("lineSep", "\u0001").partitionBy("host").text(folder)
    read = readers.read_sitemaps(spark, f"{folder}/*/*.gz").withColumn("xml", F.explode(F.filter(
        F.split("xml", "\u0001"), lambda x: x != "")))
    host = F.regexp_extract("file", "host=([^/]*)/", 1)
    return sitemaps.sitemap_entries(read.select(
        F.concat(F.lit("http://"), host, F.lit("/pages.xml")).alias("sitemap_url"), "xml")).select(
        "sitemap_url", "loc")


@query("s05_read_robots", f"select distinct {T.host('url')} as host, true as has_rule from pages")
def _(spark, sf):
    from netloom.operators.robots import parse_robots
    from netloom.suite.crawl import robots_files

    folder = work_folder(spark, "robots")
    robots_files(spark, sf).select("host", F.col("text").alias("value")).repartition("host").write.option(
        "lineSep", "\n").partitionBy("host").text(folder)
    return parse_robots(readers.read_robots(spark, f"{folder}/*/*.txt")).groupBy("host").agg(F.bool_or(F.col("pattern") == "/de/1").alias("has_rule"))


@query("s06_read_jobs", check_sql("""
select id, json_extract_string(data, '$.mode') as mode, json_extract_string(data, '$.url') as url from job_payloads
where json_extract_string(data, '$.mode') = 'single_urls'
""", "job_payloads"))
def _(spark, sf):
    folder = work_folder(spark, "jobs")
    view(spark, sf, "job_payloads").write.parquet(folder)
    return readers.read_jobs(spark, folder, J.SCRAPE_MODE).select("id", "mode", "url")


@query("s08_write_documents", check_sql(f"""
select p.page_id, p.url, {T.base_domain('p.url')} as domain, coalesce(n, 0) as n_links from pages p left join (
  select page_id, count(distinct {T.resolve('href', 'url')}) as n from links where {T.resolve('href', 'url')} <> '' group by 1) l
  on l.page_id = p.page_id
""", "links"))
def _(spark, sf):
    from netloom.operators.pages import with_links

    folder = work_folder(spark, "documents")
    tables.write_documents(with_links(view(spark, sf, "pages")).withColumn("markdown", F.lit("x")), folder, ["links"])
    return spark.read.parquet(folder).select("page_id", "url", "domain", F.size("links").cast("bigint").alias("n_links"))


@query("s09_upsert_table", """
select page_id, 'new' || page_id % 4 as state from pages where page_id % 3 = 0
union all select page_id, 'old' from pages where page_id % 3 <> 0
union all select page_id + 1000000, 'added' from pages where page_id % 10 = 0
""")
def _(spark, sf):
    folder = work_folder(spark, "table")
    pages = view(spark, sf, "pages")
    tables.upsert_table(pages.select("page_id", F.lit("old").alias("state")), folder, ["page_id"])
    tables.upsert_table(pages.where("page_id % 3 = 0").select("page_id", F.expr("'new' || page_id % 4").alias("state")),
                        folder, ["page_id"])
    more = pages.where("page_id % 10 = 0")
    extra = more.select((F.col("page_id") + 1000000).alias("page_id"), F.lit("added").alias("state")).unionByName(
        more.select("page_id", F.lit("ignored").alias("state")))
    tables.upsert_table(extra, folder, ["page_id"], update=False)
    return tables.read_table(spark, folder)


@query("e01_register_postprocessor", r"""
select page_id, case page_id % 3 when 0 then 'T:' || page_id else 'plain' end as markdown,
  case page_id % 3 when 0 then 'shout' else '' end as used
from pages
""")
def _(spark, sf):
    X.register_postprocessor("shout", lambda: F.col("page_id") % 3 != 1, lambda: F.when(
        F.col("page_id") % 3 == 0, F.concat(F.lit("T:"), F.col("page_id").cast("string"))))
    try:
        docs = X.apply_postprocessors(view(spark, sf, "pages").withColumn("markdown", F.lit("plain")))
        return X.apply_postprocessors(docs).select("page_id", "markdown", joined("postprocessors_used").alias("used"))
    finally:
        X.unregister_postprocessor("shout")


@query("e02_derive", check_sql(f"""
select p.page_id, coalesce(n, 0) as n_links, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, coalesce(letters, sha256('')) as letters
from pages p left join (select page_id, count(distinct {T.resolve('href', 'url')}) as n from links
  where {T.resolve('href', 'url')} <> '' group by 1) l on l.page_id = p.page_id
left join (select page_id, sha256(regexp_replace(string_agg(text, '' order by pos), '[^\\p{{L}}]', '', 'g')) as letters
  from ({duck_blocks(duck_main())}) group by page_id) m on m.page_id = p.page_id
""", "links"))
def _(spark, sf):
    docs = X.derive(view(spark, sf, "pages"), ["markdown", "links", "metadata"])
    return docs.select(
        "page_id", F.size("links").cast("bigint").alias("n_links"), F.get(F.col("metadata")["language"], 0).alias("lang"),
        F.sha2(F.regexp_replace(F.regexp_replace("markdown", r"\]\([^)]*\)", ""), r"[^\p{L}]", ""), 256).alias("letters"))


@query("e03_url_spellings", f"""
select page_id, s || w || {T.bare_host('url')} || case when {T.stem('url')} || f = '' then '/' else {T.stem('url')} || f end
  || {T.tail('url')} as spelling
from pages, (select unnest(['http://', 'https://']) as s), (select unnest(['www.', '']) as w),
  (select unnest(['/index.html', '/index.php', '/', '']) as f)
""")
def _(spark, sf):
    X.register_sql(spark)
    return spark.sql("select page_id, s.spelling from {pages}, lateral url_spellings(url) s", pages=view(spark, sf, "pages"))


@query("e03_page_links_sql", check_sql(f"""
select distinct page_id, {T.resolve('href', 'url')} as href from links where {T.resolve('href', 'url')} <> ''
""", "links"))
def _(spark, sf):
    X.register_sql(spark)
    return spark.sql("select page_id, l.href from {pages}, lateral page_links(html, url) l",
                     pages=view(spark, sf, "pages"))
