"""Sitemaps: reading entries, following indexes, guessing locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import url as U
from netloom.plans.ranking import first_per_key, top_n
from netloom.session import cut_lineage

SITEMAP_CAP = 25

_SCHEMA = "url array<struct<loc: string>>, sitemap array<struct<loc: string>>, _bad string"


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """One row per entry: ``sitemap_url, pos, loc, action``.

    ``sitemaps`` has ``sitemap_url, xml``.  Index entries and ``.xml`` /
    ``.xml.gz`` entries are to `recurse`, other pages to `process`; file links
    are left out.  Text that is not a sitemap gives one row with action `bad`.
    """
    parsed = F.from_xml("xml", _SCHEMA, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = sitemaps.withColumn("_x", parsed).withColumn(
        "_root", F.regexp_extract(
            "xml", r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:\w+:)?(\w+)", 1))
    bad = F.col("_x").isNull() | F.col("_x._bad").isNotNull() | ~F.col("_root").isin(
        "urlset", "sitemapindex")
    none = F.array().cast("array<struct<loc: string, action: string>>")

    def page(u):
        loc = F.trim(F.regexp_replace(u["loc"], r"^\s+|\s+$", ""))
        nested = F.lower(loc).rlike(r"\.xml(\.gz)?$")
        usable = U.is_web_url(loc) & ~U.is_skipped_file(F.lower(U.path(loc)))
        return F.struct(loc.alias("loc"), F.when(nested, "recurse").when(
            usable, "process").otherwise("skip").alias("action"))

    def child(s):
        return F.struct(F.regexp_replace(s["loc"], r"^\s+|\s+$", "").alias("loc"),
                        F.lit("recurse").alias("action"))

    listed = F.when(F.col("_root") == "sitemapindex", F.transform("_x.sitemap", child)).otherwise(
        F.transform("_x.url", page))
    broken = F.array(F.struct(F.lit(None).cast("string").alias("loc"), F.lit("bad").alias("action")))
    entries = F.when(bad, broken).otherwise(F.coalesce(listed, none))
    return rows.select("sitemap_url", F.posexplode_outer(entries).alias("pos", "_e")).where(
        "_e is not null").select(
        "sitemap_url", "pos", "_e.loc", "_e.action").where(
        "action = 'bad' or (action <> 'skip' and loc is not null)")


def expand_sitemaps(sitemaps: DataFrame, roots: DataFrame, cap: int = SITEMAP_CAP) -> DataFrame:
    """Pages reachable from root sitemaps: ``crawl_id, url, sitemap_url, level``.

    ``roots`` has ``crawl_id, sitemap_url, pos``.  A crawl reads each sitemap
    once and at most ``cap`` of them, in order of their path of positions, so
    there are at most ``cap`` levels.  Entries are read once and the loop joins
    on the sitemap URL; the driver only sees whether a level is empty.
    """
    entries = cut_lineage(sitemap_entries(sitemaps).where("action <> 'bad'"))
    frontier = first_per_key(
        roots.select("crawl_id", "sitemap_url", F.array(F.col("pos").cast("bigint")).alias("pos")), ["crawl_id", "sitemap_url"], F.col("pos"))
    seen, pages, level = None, None, 0
    while True:
        if seen is not None:
            frontier = frontier.join(
                seen.select("crawl_id", "sitemap_url"), ["crawl_id", "sitemap_url"], "left_anti")
            used = seen.groupBy("crawl_id").agg(F.count("*").alias("_used"))
            frontier = frontier.join(used, "crawl_id", "left")
        else:
            frontier = frontier.withColumn("_used", F.lit(0))
        ranked = top_n(frontier, ["crawl_id"], [F.col("pos"), F.col("sitemap_url")], cap, "_rank")
        chosen = cut_lineage(ranked.where(
            F.col("_rank") + F.coalesce("_used", F.lit(0)) <= cap).select(
            "crawl_id", "sitemap_url", "pos", F.lit(level).alias("level")))
        if chosen.isEmpty():
            break
        seen = chosen if seen is None else seen.unionByName(chosen)
        found = chosen.join(entries.withColumnRenamed("pos", "_entry_pos"), "sitemap_url")
        got = found.where("action = 'process'").select(
            "crawl_id", F.col("loc").alias("url"), "sitemap_url", "level", "_entry_pos")
        pages = got if pages is None else pages.unionByName(got)
        nested = found.where("action = 'recurse'").select(
            "crawl_id", F.col("loc").alias("sitemap_url"),
            F.concat("pos", F.array(F.col("_entry_pos").cast("bigint"))).alias("pos"))
        frontier = first_per_key(nested, ["crawl_id", "sitemap_url"], F.col("pos"))
        level += 1
    if pages is None:
        return entries.limit(0).select(
            F.lit(None).cast("bigint").alias("crawl_id"), F.col("loc").alias("url"),
            "sitemap_url", F.lit(0).alias("level"), F.col("pos").alias("_entry_pos"))
    return pages


def sitemap_candidates(seeds: DataFrame, robots_sitemaps: DataFrame | None = None) -> DataFrame:
    """Where a crawl looks for sitemaps: ``crawl_id, sitemap_url, pos, only_host``.

    Robots entries first, then next to the seed, at the host root, and at the
    registrable domain.  ``only_host`` is set when results of a parent domain
    count for the seed's host only.
    """
    site = U.origin("url")
    beside = F.concat(
        site, F.regexp_replace(U.path("url"), r"/$", ""), F.lit("/sitemap.xml"))
    named = U.with_domain(seeds, _site=U.host("url"))
    parent = F.concat(U.scheme("url"), F.lit("://"), F.col("_site"), F.lit("/sitemap.xml"))
    is_file = F.col("url").rlike(r"\.xml(\.gz)?$")

    def entry(pos, where, host=None):
        return F.struct(F.lit(pos).cast("bigint").alias("pos"), where.alias("sitemap_url"),
                        (host if host is not None else F.lit(None).cast("string")).alias("only_host"))

    guesses = F.when(is_file, F.array(entry(0, F.col("url")))).otherwise(F.array(
        entry(1000, beside), entry(1001, F.concat(site, F.lit("/sitemap.xml"))),
        entry(1002, parent, F.when(U.host("url") != F.col("_site"), U.host("url")))))
    out = named.select("crawl_id", F.explode_outer(guesses).alias("g")).select(
        "crawl_id", "g.pos", "g.sitemap_url", "g.only_host").where("sitemap_url is not null")
    if robots_sitemaps is not None:
        listed = seeds.where(~is_file).select("crawl_id", U.host("url").alias("host")).join(
            robots_sitemaps, "host").select(
            "crawl_id", F.col("n").cast("bigint").alias("pos"),
            F.col("sitemap").alias("sitemap_url"), F.lit(None).cast("string").alias("only_host"))
        out = out.unionByName(listed)
    return first_per_key(out, ["crawl_id", "sitemap_url"], F.col("pos")).select(
        "crawl_id", "sitemap_url", "pos", "only_host")
