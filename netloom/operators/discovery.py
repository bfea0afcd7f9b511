"""Breadth-first discovery of a site over captured pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.crawl import CrawlPolicy, claim_urls, filter_links, url_key, within_limit
from netloom.operators.pages import explode_computed, with_links
from netloom.operators.robots import robots_allowed
from netloom.plans.ranking import first_per_key
from netloom.session import checkpoint_folder, cut_lineage

MERGED = 8  # levels kept apart before they are merged


class Visited:
    """Claimed URLs as tables bucketed by (crawl_id, key), one for each level, in the checkpoint folder.

    Candidates are dealt to the buckets once and meet the tables where they lie,
    so a level shuffles its own rows only.  After ``MERGED`` levels the tables
    become one, so a candidate never meets more than that.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _save(self, rows: DataFrame) -> str:
        name = f"visited_{uuid.uuid4().hex}"
        rows.write.option("path", f"{checkpoint_folder(self.spark)}/{name}").bucketBy(
            self.buckets, "crawl_id", "key").sortBy("crawl_id", "key").saveAsTable(name)
        return name

    def add(self, rows: DataFrame) -> DataFrame:
        """Stores a level; its rows as stored."""
        self.tables.append(self._save(rows))
        level = self.spark.table(self.tables[-1])
        if len(self.tables) > MERGED:
            merged, old = self._save(self._union(self.tables[:-1])), self.tables[:-1]
            self.tables = [merged, self.tables[-1]]
            self._drop(old)
        return level

    def without(self, candidates: DataFrame) -> DataFrame:
        for name in self.tables:
            candidates = candidates.join(self.spark.table(name).select("crawl_id", "key"), ["crawl_id", "key"], "left_anti")
        return candidates

    def _union(self, names: list[str]) -> DataFrame:
        first, *rest = map(self.spark.table, names)
        for table in rest:
            first = first.unionByName(table)
        return first

    def all(self) -> DataFrame:
        return self._union(self.tables)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")

    def drop(self) -> None:
        self._drop(self.tables)


def crawl_corpus(pages: DataFrame, seeds: DataFrame, policy: CrawlPolicy,
                 max_discovery_depth: int | None = None, limit: int | None = None,
                 robots_rules: DataFrame | None = None, agents: tuple[str, ...] = ("*",),
                 similar: bool = False, ignore_query: bool = False) -> DataFrame:
    """Every URL a crawl would claim: ``crawl_id, url, key, depth, captured``.

    ``seeds`` has ``crawl_id, url``.  Links of captured pages are extracted and
    written once, keyed by page; each level is then one join of the frontier
    with that link table, and one of what it finds with the levels before it.
    Levels are tables of their own, and the driver only learns whether the
    frontier is empty; without a depth the crawl goes on until it is.  A level
    whose depth equals ``max_discovery_depth`` is captured but not expanded.
    """
    keyed = pages.withColumn("_page_key", url_key("url", ignore_query, similar))
    links = cut_lineage(
        explode_computed(with_links(keyed.select("_page_key", "url", "html")), ["_page_key", "url"],
                         F.col("links"), "pos", "link")
        .select(F.col("_page_key").alias("key"), F.col("url").alias("base"), "pos", "link")
        .repartition("key"))
    known = keyed.select(F.col("_page_key").alias("key"), F.lit(True).alias("captured")).distinct()

    start = seeds.select("crawl_id", "url", F.lit(0).cast("bigint").alias("pos"))
    none = seeds.where("false").select("crawl_id", F.lit("").alias("key"))
    visited = Visited(pages.sparkSession)
    frontier = visited.add(claim_urls(start, none, limit, ignore_query, similar)
                           .select("crawl_id", "url", "key", F.lit(0).alias("depth")))
    used = cut_lineage(frontier.groupBy("crawl_id").agg(F.count("*").alias("used"))) if limit is not None else None
    initial, level = seeds.select("crawl_id", F.col("url").alias("initial_url")), 0
    while max_discovery_depth is None or level != max_discovery_depth:
        found = frontier.select("crawl_id", "key").join(links, "key").join(
            initial, "crawl_id").withColumnRenamed("base", "page_url")
        if robots_rules is not None:
            found = robots_allowed(found, robots_rules, agents, url="link")
        allowed = filter_links(
            found, policy, "link", "page_url", "initial_url",
            "robots_ok" if robots_rules is not None else None).where("allowed")
        # Pages of one level have no order of their own: a hash gives a fixed
        # one whose high bits are even buckets for the running count.
        order = F.struct(F.xxhash64("key").alias("hash"), "pos")
        candidates = allowed.select("crawl_id", F.col("link").alias("url"), order.alias("pos")).withColumn(
            "key", url_key("url", ignore_query, similar))
        fresh = visited.without(first_per_key(candidates, ["crawl_id", "key"], F.struct("pos", "url")))
        if limit is not None:
            fresh = within_limit(fresh, used, limit, F.shiftright("pos.hash", 52))
        frontier = visited.add(fresh.select("crawl_id", "url", "key", F.lit(level + 1).alias("depth")))
        if frontier.isEmpty():
            break
        if limit is not None:
            used = cut_lineage(used.unionByName(frontier.groupBy("crawl_id").agg(F.count("*").alias("used")))
                               .groupBy("crawl_id").agg(F.sum("used").alias("used")))
        level += 1
    result = cut_lineage(visited.all().join(known, "key", "left").select(
        "crawl_id", "url", "key", "depth", F.coalesce("captured", F.lit(False)).alias("captured")))
    visited.drop()
    return result
