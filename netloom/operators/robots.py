"""Robots files: parsing and URL checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import url as U
from netloom.session import write_table


def _lines(robots: DataFrame) -> DataFrame:
    """Field lines of robots files in order: ``host, n, field, value``."""
    parts = robots.select(
        F.lower("host").alias("host"),
        F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line"))
    clean = F.trim(F.regexp_replace("line", r"#.*$", ""))
    return parts.select("host", "n", clean.alias("line")).where(F.col("line").contains(":")).select(
        "host", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"),
        F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))


def rule_regex(pattern: Column) -> Column:
    """Anchored regular expression of a rule: `*` any text, `$` the end."""
    quoted = F.regexp_replace(pattern, r"([.+?^{}()|\[\]\\])", r"\\$1")
    starred = F.regexp_replace(quoted, r"\*+", ".*")
    inner = F.regexp_replace(starred, r"\$(?=.)", r"\\\$")
    return F.concat(F.lit("^"), inner)


def parse_robots(robots: DataFrame) -> DataFrame:
    """Rules per host and agent: ``host, agent, allow, pattern``.

    Consecutive agent lines share the rules that follow.  A group without
    rules is kept with a NULL pattern, so that it still shadows `*`.  One file
    is one input row, so the windows here stay small.
    """
    lines = _lines(robots).where(
        F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("host").orderBy("n")
    starts = (F.col("field") == "user-agent") & (
        F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = lines.withColumn("_start", starts.cast("int")).withColumn(
        "_group", F.sum("_start").over(order))
    agents = grouped.where("field = 'user-agent'").select(
        "host", "_group", F.lower("value").alias("agent"))
    rules = grouped.where("field in ('allow', 'disallow') and value <> ''").select(
        "host", "_group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(rules, ["host", "_group"], "left").select(
        "host", "agent", "allow", "pattern").distinct()


def crawl_delays(robots: DataFrame) -> DataFrame:
    """``host, agent, delay`` in seconds."""
    lines = _lines(robots).where(
        F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("host").orderBy("n")
    starts = (F.col("field") == "user-agent") & (
        F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = lines.withColumn("_start", starts.cast("int")).withColumn(
        "_group", F.sum("_start").over(order))
    agents = grouped.where("field = 'user-agent'").select(
        "host", "_group", F.lower("value").alias("agent"))
    delays = grouped.where("field = 'crawl-delay'").select(
        "host", "_group", F.col("value").try_cast("double").alias("delay"))
    return agents.join(delays.where("delay is not null"), ["host", "_group"]).groupBy(
        "host", "agent").agg(F.max("delay").alias("delay"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemap lines: ``host, n, sitemap``."""
    return _lines(robots).where("field = 'sitemap'").select(
        "host", "n", F.col("value").alias("sitemap"))


def _chosen_rules(rules: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """Rules that count for each asked agent, by its number ``k``: its own group's, else those of `*`.

    ``kind`` tells how a rule is tested: by the start of the path, by the whole of
    it, or by an expression if it has a `*` that is not at its end.
    """
    asked = rules.select("host", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(a.lower()).alias("name")) for k, a in enumerate(agents)])).alias("a")).select(
        "host", "a.k", "a.name").distinct()
    named = rules.select("host", F.col("agent").alias("name"), F.lit(True).alias("_own")).distinct()
    used = asked.join(named, ["host", "name"], "left").select(
        "host", "k", F.when(F.col("_own"), F.col("name")).otherwise("*").alias("agent"))
    body = F.regexp_replace("pattern", r"\*+$", "")
    kind = (F.when(body.contains("*"), "wild").when(F.col("pattern").endswith("$"), "whole").otherwise("start"))
    return rules.where("pattern is not null").join(used, ["host", "agent"]).select(
        "host", "k", "allow", F.length("pattern").alias("len"), kind.alias("kind"), "pattern",
        F.when(kind == "whole", F.regexp_replace("pattern", r"\$$", "")).otherwise(body).alias("body"))


def _best_rules(targets: DataFrame, rules: DataFrame, agents: int) -> DataFrame:
    """Of each (host, target) the longest matching rule of every agent, as ``v0, v1, ...`` (allowed or not)."""
    starts, whole, wild = (rules.where(F.col("kind") == k) for k in ("start", "whole", "wild"))
    # a path is cut at the lengths that the starts of its host's rules have, and the cuts meet the rules
    lengths = starts.groupBy("host").agg(F.array_sort(F.collect_set(F.length("body"))).alias("lengths"))
    cuts = targets.join(lengths, "host").select("host", "target", F.explode(F.filter(
        "lengths", lambda n: n <= F.length("target"))).alias("n")).select(
        "host", "target", F.expr("left(target, n)").alias("body"))
    by_start = cuts.join(starts, ["host", "body"]).select("host", "target", "k", "len", "allow")
    by_whole = targets.join(whole.withColumnRenamed("body", "target"), ["host", "target"]).select("host", "target", "k", "len", "allow")
    # rules with a star inside: first their plain beginning, then the expression
    head = F.substring_index("pattern", "*", 1)
    by_star = targets.join(wild, "host").where(
        F.col("target").startswith(head) & F.rlike("target", rule_regex(F.col("pattern")))).select("host", "target", "k", "len", "allow")
    hits = by_start.unionByName(by_whole).unionByName(by_star)
    best = [F.max(F.when(F.col("k") == k, F.struct("len", "allow")))["allow"].alias(f"v{k}") for k in range(agents)]
    return hits.groupBy("host", "target").agg(*best)


def robots_checks(urls: DataFrame, rules: DataFrame, checks: dict[str, tuple[str, ...]], url: str = "url") -> DataFrame:
    """Adds a column for each entry of ``checks``: may any of its agents fetch the URL.

    The longest matching rule wins and ties allow.  A URL without a final
    slash must also pass with one.  Hosts without rules allow everything.

    Distinct paths meet the rules once for all agents: plain rules by equal
    starts, so their number doesn't matter; only rules with a `*` inside are tried
    one by one.
    """
    agents = tuple(dict.fromkeys(a for names in checks.values() for a in names))
    chosen = write_table(_chosen_rules(rules, agents))
    rows = urls.withColumns({
        "_host": U.host(url),
        "_target": F.concat(U.path(url), F.regexp_extract(F.col(url), r"^[^?#]*(\?[^#]*)", 1))})
    # behind a fragment a further slash does not reach the robots rules
    rows = rows.withColumn("_slashed", F.when(
        ~(F.col(url).endswith("/") | F.col(url).contains("#")), F.concat("_target", F.lit("/"))))
    asked = rows.select(F.col("_host").alias("host"), F.explode(F.array("_target", "_slashed")).alias("target")).where(
        "target is not null").distinct().join(chosen.select("host").distinct(), "host", "left_semi")
    best = write_table(_best_rules(asked, chosen, len(agents)))
    for name in ("_target", "_slashed"):
        found = best.select(F.col("host").alias("_host"), F.col("target").alias(name),
                            *[F.col(f"v{k}").alias(f"{name}{k}") for k in range(len(agents))])
        rows = rows.join(found, ["_host", name], "left")
    out = {}
    for column, names in checks.items():
        passes = F.lit(False)
        for k in map(agents.index, names):
            passes = passes | (F.coalesce(F.col(f"_target{k}"), F.lit(True)) & F.coalesce(F.col(f"_slashed{k}"), F.lit(True)))
        out[column] = passes
    return rows.select(*[F.col(c) for c in urls.columns if c not in checks], *[v.alias(c) for c, v in out.items()])


def robots_allowed(urls: DataFrame, rules: DataFrame, agents: tuple[str, ...] = ("*",),
                   url: str = "url", out: str = "robots_ok") -> DataFrame:
    """Adds ``out``: may any of the agents fetch the URL (see :func:`robots_checks`)."""
    return robots_checks(urls, rules, {out: agents}, url)
