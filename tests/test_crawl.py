"""Hand-written cases for robots rules, sitemaps and discovery."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import discovery, robots, sitemaps
from netloom.operators.crawl import CrawlPolicy, valid_patterns

ROBOTS = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n\nUser-agent: bot\nDisallow: /c/\n\nUser-agent: free\n"


@pytest.mark.parametrize("url,agent,allowed", [
    ("https://h.com/a/x", "*", False), ("https://h.com/a/b/c", "*", True), ("https://h.com/f.pdf", "*", False),
    ("https://h.com/f.pdfx", "*", True), ("https://h.com/a/x", "bot", True), ("https://h.com/c", "bot", False),
    ("https://h.com/a/x", "free", True), ("https://other.com/a", "*", True),
])
def test_robots(spark, url, agent, allowed):
    rules = robots.parse_robots(spark.createDataFrame([("h.com", ROBOTS)], "host string, text string"))
    urls = spark.createDataFrame([(url,)], "url string")
    assert robots.robots_allowed(urls, rules, (agent,)).first().robots_ok is allowed


def test_ties_allow(spark):
    rules = robots.parse_robots(spark.createDataFrame(
        [("h.com", "User-agent: *\nDisallow: /p\nAllow: /p")], "host string, text string"))
    urls = spark.createDataFrame([("https://h.com/p",)], "url string")
    assert robots.robots_allowed(urls, rules).first().robots_ok


def test_bad_patterns_are_dropped(spark):
    kept = valid_patterns(spark, CrawlPolicy(includes=("a(", "b"), excludes=("[",)))
    assert kept.includes == ("b",) and kept.excludes == ()


def test_sitemap_cap(spark):
    xml = "".join(f"<sitemap><loc>http://h/{i}.xml</loc></sitemap>" for i in range(40))
    rows = [("http://h/s.xml", f"<sitemapindex>{xml}</sitemapindex>")]
    rows += [(f"http://h/{i}.xml", f"<urlset><url><loc>http://h.com/{i}</loc></url></urlset>") for i in range(40)]
    maps = spark.createDataFrame(rows, "sitemap_url string, xml string")
    roots = spark.createDataFrame([(1, "http://h/s.xml", 0)], "crawl_id bigint, sitemap_url string, pos bigint")
    assert sitemaps.expand_sitemaps(maps, roots, cap=25).count() == 24


def test_discovery_limit_and_depth(spark):
    pages = spark.createDataFrame(
        [(i, f"https://h.com/p{i}", f'<a href="/p{i + 1}">n</a><a href="/p{i + 2}">m</a>') for i in range(10)],
        "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([(1, "https://h.com/p0")], "crawl_id bigint, url string")
    policy = CrawlPolicy(allow_backward=True)
    full = discovery.crawl_corpus(pages, seeds, policy)
    assert full.count() == 12 and full.where("not captured").count() == 2
    assert discovery.crawl_corpus(pages, seeds, policy, max_discovery_depth=1).count() == 3
    assert discovery.crawl_corpus(pages, seeds, policy, limit=4).count() == 4


def test_a_level_shuffles_its_own_rows_only(spark):
    """Many levels, merged on the way; visited tables are read where they lie."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    visited = discovery.Visited(spark)
    for level in range(discovery.MERGED + 4):
        rows = spark.range(level * 100, level * 100 + 100).select(
            F.lit(1).alias("crawl_id"), F.col("id").cast("string").alias("url"), F.col("id").cast("string").alias("key"), F.lit(level).alias("depth"))
        assert visited.add(rows).count() == 100
    assert len(visited.tables) <= discovery.MERGED + 1 and visited.all().count() == 100 * (discovery.MERGED + 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        candidates = spark.range(500, 2000).select((F.col("id") % 3 + 1).cast("int").alias("crawl_id"), F.col("id").cast("string").alias("key"))
        fresh = visited.without(candidates)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("LeftAnti") == len(visited.tables)
        assert fresh.count() == sum(i % 3 > 0 or i >= 100 * (discovery.MERGED + 4) for i in range(500, 2000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        visited.drop()
    chain = spark.createDataFrame([(i, f"https://h.com/p{i}", f'<a href="/p{i + 1}">n</a>') for i in range(14)],
                                  "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([(1, "https://h.com/p0")], "crawl_id bigint, url string")
    deep = discovery.crawl_corpus(chain, seeds, CrawlPolicy(allow_backward=True))
    assert sorted(r.depth for r in deep.collect()) == list(range(15))


def test_nested_sitemaps(spark):
    first = ["http://h/0.xml"] + [f"http://h/{i}.xml" for i in range(1, 7)]
    rows = [(u, f"<sitemapindex><sitemap><loc>{n}</loc></sitemap></sitemapindex>") for u, n in zip(first, first[1:])]
    rows.append((first[-1], "<urlset><url><loc>http://h.com/end</loc></url></urlset>"))
    maps = spark.createDataFrame(rows, "sitemap_url string, xml string")
    roots = spark.createDataFrame([(1, first[0], 1001)], "crawl_id bigint, sitemap_url string, pos bigint")
    assert [(r.url, r.level) for r in sitemaps.expand_sitemaps(maps, roots).collect()] == [("http://h.com/end", 6)]


def test_limit_takes_links_in_page_order(spark):
    html = "".join(f'<a href="/p{i}">x</a>' for i in range(5000))
    pages = spark.createDataFrame([(1, "https://h.com/", html)], "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([(1, "https://h.com/")], "crawl_id bigint, url string")
    found = discovery.crawl_corpus(pages, seeds, CrawlPolicy(allow_backward=True), limit=4501)
    assert {r.url for r in found.collect()} == {"https://h.com/"} | {f"https://h.com/p{i}" for i in range(4500)}


def test_robots_of_many_rules(spark):
    """100,000 plain rules of one host, and every kind of rule against a plain reading of them."""
    import random
    import re

    from netloom.operators import robots

    rng = random.Random(4)
    word = lambda: "/" + "".join(rng.choice("ab/x?") for _ in range(rng.randrange(1, 5)))
    rules = [("h", a, rng.random() < 0.5, word() + rng.choice(["", "", "*", "$", "*x", "*b$", "$c"])) for a in ("*", "bot") for _ in range(40)]
    rules += [("h", "idle", None, None), ("g", "*", False, "/")]
    table = spark.createDataFrame(rules, "host string, agent string, allow boolean, pattern string")
    urls = [(f"http://{h}{word()}{word()}{rng.choice(['', '#f'])}",) for h in ("h", "g", "k") for _ in range(60)]
    df = spark.createDataFrame(urls, "url string")

    def by_hand(url, agents):
        host, rest = re.match("http://([^/]*)(.*)", url).groups()
        target = rest.split("#")[0]

        def verdict(agent, path):
            names = {a for h, a, _, _ in rules if h == host}
            own = [(len(p), ok) for h, a, ok, p in rules if h == host and a == (agent if agent in names else "*") and p
                   and re.match(re.sub(r"\\\*+", ".*", re.escape(p.removesuffix("$"))) + ("$" if p.endswith("$") else ""), path)]
            return max(own, default=(0, True))[1]

        return any(verdict(a, target) and (url.endswith("/") or "#" in url or verdict(a, target + "/")) for a in agents)

    for agents in (("*",), ("bot",), ("idle", "bot"), ("idle",)):
        got = {r.url: r.robots_ok for r in robots.robots_allowed(df, table, agents).collect()}
        assert got == {u: by_hand(u, agents) for u, in urls}

    many = spark.range(100_000).select(F.lit("h").alias("host"), F.lit("*").alias("agent"), F.lit(False).alias("allow"),
                                       F.concat(F.lit("/p"), F.col("id").cast("string"), F.lit("/")).alias("pattern"))
    asked = spark.range(0, 200_000, 50).select(F.concat(F.lit("http://h/p"), F.col("id").cast("string"), F.lit("/a")).alias("url"))
    judged = robots.robots_allowed(asked, many)
    assert judged.where("not robots_ok").count() == 2_000 and judged.count() == 4_000
