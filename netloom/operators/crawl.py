"""Which links a crawl follows, and the bookkeeping of URLs.

A policy is a handful of values known when the job is built, so its checks
become one ordered ``CASE`` over literals: cheap tests first, and no row is
tested further than its first failure.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import url as U
from netloom.functions.tables import ADSERVER_DOMAINS, NON_WEB_PROTOCOLS, SOCIAL_SITES
from netloom.plans.ranking import first_per_key, running_rank
from netloom.session import cut_lineage, write_table

# What each denial code means.
DENIAL_TEXT = {
    "URL_PARSE_ERROR": "not a valid URL",
    "NON_WEB_PROTOCOL": "uses a protocol other than http or https",
    "DEPTH_LIMIT": "has more path segments than the depth limit",
    "FILE_TYPE": "points to a file type that is not crawled",
    "SECTION_LINK": "points to a section of a page, not to another page",
    "BACKWARD_CRAWLING": "is outside the path of the starting URL",
    "EXCLUDE_PATTERN": "matches an exclude pattern",
    "INCLUDE_PATTERN": "matches no include pattern",
    "ROBOTS_TXT": "is disallowed by the robots file of its host",
    "SOCIAL_MEDIA": "points to a social media or contact site",
    "EXTERNAL_LINK": "points to another site and external links are off",
    "DISCOVERY_DEPTH": "was found at the last discovery level",
}


@dataclass(frozen=True)
class CrawlPolicy:
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    max_depth: int = 10
    allow_backward: bool = False
    allow_external: bool = False
    allow_subdomains: bool = False
    regex_on_full_url: bool = False
    ignore_robots: bool = False


def valid_patterns(spark: SparkSession, policy: CrawlPolicy) -> CrawlPolicy:
    """Drops user patterns that do not compile, once, on the driver.

    An invalid pattern inside ``rlike`` would fail the whole job.
    """
    compiler = spark._jvm.java.util.regex.Pattern

    def ok(pattern: str) -> bool:
        try:
            compiler.compile(pattern)
            return True
        except Exception:
            return False

    return replace(policy, includes=tuple(filter(ok, policy.includes)),
                   excludes=tuple(filter(ok, policy.excludes)))


def _any_match(target: Column, patterns) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | target.rlike(p)
    return hit


def _contains_any(text: Column, words) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def _is_internal(a: Column, b: Column) -> Column:
    return U.strip_www(a) == U.strip_www(b)


def _is_section(full: Column) -> Column:
    """A fragment that is not a client-side route."""
    part = F.regexp_extract(full, "#([^#]*)", 1)
    return full.contains("#") & ~((F.length(part) > 1) & part.contains("/"))


def _is_root(path_text: Column) -> Column:
    return path_text.rlike("^/*$")


def _url_columns(df: DataFrame, source: str, prefix: str) -> DataFrame:
    return df.withColumns({
        f"{prefix}host": U.host(source), f"{prefix}path": U.path(source)})


_PARTS = ["_full", "_uhost", "_upath", "_bhost", "_ihost", "_ipath", "_chost", "_usite", "_bsite"]


def _with_sites(rows: DataFrame, policy: CrawlPolicy) -> DataFrame:
    """Registrable domains of link and page, where the policy asks for them."""
    return U.with_domain(rows, _usite=F.col("_uhost"), _bsite=F.col("_bhost")) if policy.allow_subdomains else rows


def _same_site(policy: CrawlPolicy) -> Column:
    return F.coalesce(F.col("_usite") == F.col("_bsite"), F.lit(False)) if policy.allow_subdomains else F.lit(False)


def filter_links(links: DataFrame, policy: CrawlPolicy, link: str = "link",
                 base_url: str = "url", initial_url: str = "initial_url",
                 robots_ok: str | None = None) -> DataFrame:
    """Adds ``reason`` (NULL when allowed) and ``allowed`` to each link.

    ``base_url`` and ``initial_url`` are columns; ``robots_ok`` names a
    boolean column made by :func:`netloom.operators.robots.robots_allowed`.
    """
    rows = links.withColumn("_full", U.resolve_url(link, base_url))
    rows = _url_columns(_url_columns(rows, "_full", "_u"), initial_url, "_i").withColumn(
        "_bhost", U.host(base_url))
    rows = _with_sites(rows, policy)
    full, path = F.col("_full"), F.col("_upath")
    target = full if policy.regex_on_full_url else path
    internal = _is_internal(F.col("_uhost"), F.col("_bhost"))
    backward = ~path.startswith(F.col("_ipath")) if not policy.allow_backward else F.lit(False)
    missing_include = (
        ~_any_match(target, policy.includes) if policy.includes else F.lit(False))
    robots_denied = (
        ~F.col(robots_ok) if robots_ok is not None and not policy.ignore_robots else F.lit(False))
    content_allowed = F.lit(policy.allow_external) & _is_internal(
        F.col("_ihost"), F.col("_bhost")) & ~_is_root(path)
    same_site = _same_site(policy)
    none = F.lit(None).cast("string")
    inside = (
        F.when(_is_section(full), "SECTION_LINK").when(backward, "BACKWARD_CRAWLING")
        .when(_any_match(target, policy.excludes), "EXCLUDE_PATTERN")
        .when(missing_include, "INCLUDE_PATTERN").when(robots_denied, "ROBOTS_TXT"))
    outside = (
        F.when(_contains_any(full, SOCIAL_SITES), "SOCIAL_MEDIA")
        .when(_any_match(full, policy.excludes), "EXCLUDE_PATTERN")
        .when(content_allowed, none)
        .when(same_site & missing_include, "INCLUDE_PATTERN").when(same_site, none)
        .otherwise("EXTERNAL_LINK"))
    reason = (
        F.when(~full.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), "URL_PARSE_ERROR")
        .when(full.rlike("^(" + "|".join(NON_WEB_PROTOCOLS) + ")"), "NON_WEB_PROTOCOL")
        .when(U.path_depth(path) > policy.max_depth, "DEPTH_LIMIT")
        .when(U.is_skipped_file(path), "FILE_TYPE")
        .when(internal, inside).otherwise(outside))
    return rows.withColumn("reason", reason).withColumn(
        "allowed", F.col("reason").isNull()).drop(*_PARTS)


def filter_redirects(pairs: DataFrame, policy: CrawlPolicy, href: str = "href",
                     page_url: str = "page_url", base_url: str = "base_url",
                     robots_ok: str | None = None) -> DataFrame:
    """The shorter check for one (href, page) pair.

    No depth, file-type, include or backward test; excludes see the path of an
    internal URL and the whole of an external one.
    """
    rows = pairs.withColumn("_full", F.when(
        F.col(href).startswith("http"), F.col(href)).otherwise(U.resolve_url(href, page_url)))
    rows = _url_columns(rows, "_full", "_u").withColumn("_bhost", U.host(base_url)).withColumn(
        "_chost", U.host(page_url))
    rows = _with_sites(rows, policy)
    full, path = F.col("_full"), F.col("_upath")
    robots_denied = (
        ~F.col(robots_ok) if robots_ok is not None and not policy.ignore_robots else F.lit(False))
    none = F.lit(None).cast("string")
    inside = (
        F.when(_is_section(full), "SECTION_LINK")
        .when(_any_match(path, policy.excludes), "EXCLUDE_PATTERN")
        .when(robots_denied, "ROBOTS_TXT"))
    outside = (
        F.when(_contains_any(full, SOCIAL_SITES), "SOCIAL_MEDIA")
        .when(_any_match(full, policy.excludes), "EXCLUDE_PATTERN")
        .when(F.lit(policy.allow_external) & _is_internal(F.col("_chost"), F.col("_bhost"))
              & ~_is_root(path), none)
        .when(_same_site(policy), none)
        .otherwise("EXTERNAL_LINK"))
    reason = (
        F.when(~full.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), "URL_PARSE_ERROR")
        .when(full.rlike("^(" + "|".join(NON_WEB_PROTOCOLS) + ")"), "NON_WEB_PROTOCOL")
        .when(_is_internal(F.col("_uhost"), F.col("_bhost")), inside).otherwise(outside))
    return rows.withColumn("reason", reason).withColumn(
        "allowed", F.col("reason").isNull()).drop(*_PARTS)


def denial_message(reason: Column) -> Column:
    """Explanation of a denial code."""
    out = F.when(F.lit(False), "")
    for code, text in DENIAL_TEXT.items():
        out = out.when(reason == code, "This URL " + text + ".")
    return out


def denial_report(filtered: DataFrame, by: str | None = None) -> DataFrame:
    """Counts per denial code, with its explanation."""
    keys = [by] if by else []
    denied = filtered.where(F.col("reason").isNotNull())
    return denied.groupBy(*keys, "reason").agg(F.count("*").alias("n")).withColumn(
        "message", denial_message(F.col("reason")))


def link_limit(filtered: DataFrame, n: int, by: str = "page_id", pos: str = "pos") -> DataFrame:
    """First ``n`` allowed links of each page; later links are not judged.

    A page is one row of the corpus, so its links fit one task.
    """
    before = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("allowed").cast("int")).over(before), F.lit(0))
    judged = filtered.withColumn("judged", used < n)
    return judged.withColumns({
        "reason": F.when(F.col("judged"), F.col("reason")),
        "allowed": F.col("judged") & F.col("allowed")})


# --- claiming --------------------------------------------------------------


def url_key(url, ignore_query: bool = False, similar: bool = False) -> Column:
    if similar:
        return U.normalized_similar_key(url, ignore_query)
    return U.normalize_url(url, ignore_query)


def with_url_keys(urls: DataFrame, ignore_query: bool = False, url: str = "url") -> DataFrame:
    """Adds both claim keys, ``plain_key`` and ``similar_key``; a URL is read once for both."""
    return urls.withColumns({"plain_key": U.normalize_url(url, ignore_query),
                             "similar_key": U.normalized_similar_key(url, ignore_query)})


def claim_keys(candidates: DataFrame, visited: DataFrame, limit: int | None = None,
               bucket: Column | None = None) -> DataFrame:
    """:func:`claim_urls` for candidates that have their ``key`` already.

    One grouping of candidates and visited keys finds the first position of each
    key and whether it was claimed before, so the tables meet in one shuffle.
    """
    mine = candidates.select("crawl_id", "key", F.lit(0).alias("_old"), F.struct(
        "pos", *[c for c in candidates.columns if c not in ("crawl_id", "key", "pos")]).alias("_row"))
    taken = visited.select("crawl_id", "key", F.lit(1).alias("_old"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    met = mine.unionByName(taken).groupBy("crawl_id", "key").agg(
        F.max("_old").alias("_claimed"), F.min_by("_row", F.when(F.col("_old") == 0, F.struct("_row.pos", "_row.url"))).alias("_row"))
    columns = [F.col("key") if c == "key" else F.col("crawl_id") if c == "crawl_id" else F.col(f"_row.{c}").alias(c)
               for c in candidates.columns]
    if limit is None:
        return met.where("_claimed = 0").select(*columns)
    # read by the count of claimed keys and by the ranking
    met = write_table(met)
    used = met.where("_claimed = 1").groupBy("crawl_id").agg(F.count("*").alias("used"))
    return within_limit(met.where("_claimed = 0").select(*columns), used, limit, bucket)


def within_limit(fresh: DataFrame, used: DataFrame, limit: int, bucket: Column | None = None) -> DataFrame:
    """The first claims of each crawl, as many as its limit leaves beside those ``used`` (crawl_id, used)."""
    ranked = running_rank(fresh, ["crawl_id"], bucket if bucket is not None else F.floor(F.col("pos") / 4096),
                          [F.col("pos"), F.col("key")], "_rank")
    held = used.select("crawl_id", F.col("used").alias("_used"))
    return ranked.join(held, "crawl_id", "left").where(
        F.col("_rank") + F.coalesce("_used", F.lit(0)) <= limit).drop("_rank", "_used")


def claim_urls(candidates: DataFrame, visited: DataFrame, limit: int | None = None,
               ignore_query: bool = False, similar: bool = False,
               bucket: Column | None = None) -> DataFrame:
    """URLs claimed for the first time in their crawl, up to the crawl's limit.

    ``candidates`` has ``crawl_id, url, pos``; ``visited`` has ``crawl_id, key``.
    The first position of a key wins.
    """
    keyed = candidates.withColumn("key", url_key("url", ignore_query, similar))
    return claim_keys(keyed, visited, limit, bucket)


PRIORITY_SEED, PRIORITY_FOUND, PRIORITY_SITEMAP, PRIORITY_SINGLE = 15, 20, 21, 10


def kickoff_jobs(seeds: DataFrame, sitemap_urls: DataFrame, found: DataFrame | None = None,
                 limit: int | None = None, similar: bool = False) -> DataFrame:
    """Work list of a crawl start: seed, discovered and sitemap URLs, each once.

    Inputs have ``crawl_id, url, pos``.  The most urgent source of a URL wins.
    """
    parts = [(seeds, PRIORITY_SEED, 0), (found, PRIORITY_FOUND, 1), (sitemap_urls, PRIORITY_SITEMAP, 2)]
    jobs = None
    for df, priority, rank in parts:
        if df is None:
            continue
        part = df.select("crawl_id", "url", F.lit(priority).cast("bigint").alias("priority"),
                         (F.col("pos") + F.lit(rank * (1 << 40))).alias("pos"))
        jobs = part if jobs is None else jobs.unionByName(part)
    none = jobs.where("false").select("crawl_id", F.lit("").alias("key"))
    return claim_urls(jobs, none, limit, similar=similar)


def single_jobs(urls: DataFrame) -> DataFrame:
    return urls.withColumn("priority", F.lit(PRIORITY_SINGLE))


def reconcile_redirects(fetches: DataFrame, visited: DataFrame, policy: CrawlPolicy,
                        ignore_query: bool = False, blocklist: DataFrame | None = None) -> DataFrame:
    """Outcome of each fetch that may have been redirected.

    ``fetches`` has ``crawl_id, fetch_id, source_url, final_url, base_url,
    is_seed``; ``visited`` has ``crawl_id, url``; ``blocklist`` has ``domain``.
    ``outcome`` is one of `same`, `denied`, `blocked` (the final URL's domain is on
    the list), `equivalent`, `raced`, `moved`; ``new_origin`` is set for a seed that
    moved to another host.  Of several redirects to one page the first fetch
    keeps it.
    """
    rows = fetches.withColumns({
        "_src": U.normalize_url("source_url", ignore_query), "_dst": U.normalize_url("final_url", ignore_query),
        "_src_class": U.normalized_similar_key("source_url", ignore_query),
        "_dst_class": U.normalized_similar_key("final_url", ignore_query)})
    listed = flag_blocked(rows, blocklist, url="final_url") if blocklist is not None else rows.withColumn("blocked", F.lit(False))
    checked = filter_redirects(listed, policy, "final_url", "source_url", "base_url").withColumn(
        "_moved", F.col("_src") != F.col("_dst"))
    checked = checked.withColumn("_denied", F.col("_moved") & ~F.col("allowed") & ~F.col("is_seed")).withColumn(
        "_candidate", F.col("_moved") & ~F.col("_denied") & ~F.col("blocked") & (F.col("_src_class") != F.col("_dst_class")))
    seen = visited.select("crawl_id", U.normalized_similar_key("url", ignore_query).alias("_dst_class")).distinct().withColumn(
        "_seen", F.lit(True))
    # judged once: winners and the join read the written rows
    checked = cut_lineage(checked.select(
        *fetches.columns, "reason", "blocked", "_moved", "_denied", "_candidate", "_dst_class",
        (U.hostname_only("final_url") != U.hostname_only("source_url")).alias("_other_host")))
    winners = checked.where("_candidate").groupBy("crawl_id", "_dst_class").agg(F.min("fetch_id").alias("_winner"))
    joined = checked.join(seen, ["crawl_id", "_dst_class"], "left").join(winners, ["crawl_id", "_dst_class"], "left")
    raced = F.col("_seen").isNotNull() | (F.col("fetch_id") != F.col("_winner"))
    outcome = (
        F.when(~F.col("_moved"), "same").when(F.col("_denied"), "denied").when(F.col("blocked"), "blocked")
        .when(~F.col("_candidate"), "equivalent").when(raced, "raced").otherwise("moved"))
    return joined.select(
        *[joined[c] for c in fetches.columns], outcome.alias("outcome"), F.when(F.col("_denied"), F.col("reason")).alias("reason"),
        F.when(F.col("is_seed") & F.col("_moved") & F.col("_other_host"), F.col("final_url")).alias("new_origin"))


# --- site lists ------------------------------------------------------------


def _suffixes(domain: Column) -> Column:
    """A domain and its parent domains."""
    labels = F.size(F.split(domain, r"\."))
    return F.transform(F.sequence(F.lit(1), labels), lambda k: F.array_join(
        F.slice(F.split(domain, r"\."), labels - k + 1, k), "."))


def blocked_domains(domains: DataFrame, blocklist: DataFrame,
                    unblocked: tuple[str, ...] = ()) -> DataFrame:
    """Of the distinct ``domain`` values, those on the list or below an entry."""
    active = blocklist.select(F.col("domain").alias("_s")).where(
        ~F.col("_s").isin(list(unblocked)) if unblocked else F.lit(True)).distinct()
    runs = domains.select("domain").where("domain is not null").distinct().select(
        "domain", F.explode(_suffixes(F.col("domain"))).alias("_s"))
    return runs.join(active, "_s", "left_semi").select("domain").distinct()


def flag_blocked(urls: DataFrame, blocklist: DataFrame, allowed_keywords=(), unblocked=(),
                 url: str = "url") -> DataFrame:
    """Adds ``blocked``.  Domains are reduced to distinct values before the match."""
    tagged = U.with_domain(urls, _domain=U.host(F.lower(F.col(url))))
    hit = blocked_domains(tagged.select(F.col("_domain").alias("domain")), blocklist, unblocked)
    marked = tagged.join(
        hit.select(F.col("domain").alias("_domain"), F.lit(True).alias("_hit")),
        "_domain", "left")
    keyword = F.lit(False)
    for k in allowed_keywords:
        keyword = keyword | F.lower(F.col(url)).contains(k.lower())
    return marked.select(
        *[marked[c] for c in urls.columns],
        (F.col("_hit").isNotNull() & ~keyword).alias("blocked"))


def drop_blocked(urls: DataFrame, blocklist: DataFrame, allowed_keywords=(), unblocked=(),
                 url: str = "url") -> DataFrame:
    return flag_blocked(urls, blocklist, allowed_keywords, unblocked, url).where(
        "not blocked").drop("blocked")


def route_by_domain(urls: DataFrame, mapping: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``route``: that of the first pattern matching the URL's domain.

    ``mapping`` has ``ordinal, pattern, route``; `*.x` and `x` both cover x and
    everything below it.  Matching is an equi join of domain suffixes.
    """
    tagged = U.with_domain(urls, _domain=U.host(F.lower(F.col(url))))
    runs = tagged.select("_domain").where("_domain is not null").distinct().select(
        "_domain", F.explode(_suffixes(F.col("_domain"))).alias("_s"))
    rules = mapping.select(
        F.regexp_replace(F.lower("pattern"), r"^\*\.", "").alias("_s"), "ordinal", "route")
    chosen = runs.join(rules, "_s").groupBy("_domain").agg(
        F.min_by("route", "ordinal").alias("route"))
    joined = tagged.join(chosen, "_domain", "left")
    return joined.select(*[joined[c] for c in urls.columns], "route")


def drop_ad_urls(urls: DataFrame, ad_domains=ADSERVER_DOMAINS, url: str = "url") -> DataFrame:
    return urls.where(~U.is_ad_host(url, ad_domains))


# --- outcomes --------------------------------------------------------------


def attempt_flags(attempts: DataFrame) -> DataFrame:
    """Adds ``usable`` and ``needs_proxy`` to fetch attempts (status, content)."""
    good = F.col("status").between(200, 299) | (F.col("status") == 304)
    return attempts.withColumns({
        "usable": (F.trim(F.coalesce("content", F.lit(""))) != "") | ~good,
        "needs_proxy": F.col("status").isin(401, 403, 429)})


def best_attempt(attempts: DataFrame, order: tuple[str, ...] = ("attempt",)) -> DataFrame:
    """First usable attempt per URL, by ``order``; of attempts equal in it, the one with the least fields.

    The choice never depends on how rows meet, so each run gives the same rows.
    """
    flagged = attempt_flags(attempts).where("usable")
    rest = [c for c in flagged.columns if c not in ("url", "usable")]
    return flagged.groupBy("url").agg(
        F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_best")).select(
        "url", *[F.col(f"_best.{c}").alias(c) for c in rest])


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length in bytes."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when((longest > 0) & (a != b), 1.0 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def url_verdicts(results: DataFrame, min_similarity: float = 0.9) -> DataFrame:
    """Per URL: did rendering fail, and is the plain text close enough.

    ``results`` has ``site, url, rendered_stealth, rendered_basic,
    plain_stealth, plain_basic`` (text, NULL when that fetch failed).
    """
    rendered = F.coalesce("rendered_stealth", "rendered_basic")
    plain = F.coalesce("plain_stealth", "plain_basic")
    no_render = F.coalesce(rendered, F.lit("")) == ""
    no_plain = F.coalesce(plain, F.lit("")) == ""
    both = ~no_render & ~no_plain
    longest = F.greatest(F.octet_length(rendered), F.octet_length(plain))
    # The bounded distance stops early (-1) on texts that are too far apart.
    bound = F.floor(longest * (1.0 - min_similarity) + 1e-9).cast("int")
    distance = F.when(rendered == plain, 0).when(
        F.abs(F.char_length(rendered) - F.char_length(plain)) > bound, -1).otherwise(
        F.call_function("levenshtein", rendered, plain, bound))
    close = F.when(both, (distance >= 0) & (1.0 - distance / longest >= min_similarity))
    return results.select(
        "site", "url", no_render.alias("render_failed"),
        F.coalesce(close, F.lit(False)).alias("plain_ok"),
        F.when(both, similarity(rendered, plain)).alias("similarity"))


def fetcher_verdict(results: DataFrame, min_similarity: float = 0.9, min_success: float = 0.8,
                    max_failure: float = 0.5) -> DataFrame:
    """Per site: is a plain fetch enough, is a browser needed, or unclear."""
    per_site = url_verdicts(results, min_similarity).groupBy("site").agg(
        F.count("*").alias("total"), F.count_if("render_failed").alias("render_failed"),
        F.count_if("plain_ok").alias("plain_ok"),
        F.count_if(~F.col("plain_ok") & ~F.col("render_failed")).alias("browser_needed"))
    comparable = F.col("total") - F.col("render_failed")
    verdict = (
        F.when(F.col("render_failed") / F.col("total") > max_failure, "uncertain")
        .when(comparable == 0, "uncertain")
        .when(F.col("plain_ok") / comparable >= min_success, "plain_ok")
        .otherwise("browser_required"))
    return per_site.withColumn("verdict", verdict)


def change_status(previous: DataFrame, current: DataFrame) -> DataFrame:
    """new / same / changed / removed per URL, by content hash.

    Both have ``url, content, fetched_at``.
    """
    old = previous.select("url", F.sha2("content", 256).alias("_old"),
                          F.col("fetched_at").alias("previous_at"))
    new = current.select("url", F.sha2("content", 256).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") == F.col("_new"), "same").otherwise("changed"))
    return old.join(new, "url", "full_outer").select(
        "url", status.alias("status"), "previous_at")


BIG_BATCH = 1000


def batch_urls(urls: DataFrame, blocklist: DataFrame,
               ignore_invalid: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid URLs with their priority, and invalid or blocked ones.

    ``urls`` has ``batch_id, url``.  Without ``ignore_invalid`` a batch with a
    bad URL is refused whole and has no valid rows.
    """
    checked = urls.withColumn("_v", U.validate_url("url"))
    flagged = flag_blocked(checked.withColumn("_full", F.col("_v.url")), blocklist, url="_full")
    bad = ~F.col("_v.ok") | F.col("blocked")
    invalid = flagged.where(bad).select(
        "batch_id", "url", F.when(F.col("_v.ok"), "blocked").otherwise(F.col("_v.reason"))
        .alias("reason"))
    valid = flagged.where(~bad).select("batch_id", F.col("_full").alias("url"))
    if not ignore_invalid:
        valid = valid.join(invalid.select("batch_id").distinct(), "batch_id", "left_anti")
    sizes = valid.groupBy("batch_id").agg(F.count("*").alias("_n"))
    priority = F.when(F.col("_n") > BIG_BATCH, 21).otherwise(20)
    return valid.join(sizes, "batch_id").select(
        "batch_id", "url", priority.cast("bigint").alias("priority")), invalid


def coverage_warning(results: DataFrame, seeds: DataFrame) -> DataFrame:
    """Warns when a seed below its base domain gave at most one result.

    ``results`` has ``crawl_id``; ``seeds`` has ``crawl_id, url``.
    """
    counts = results.groupBy("crawl_id").agg(F.count("*").alias("n"))
    joined = seeds.join(counts, "crawl_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    warning = F.when(
        (F.col("n") <= 1) & ~U.is_base_domain("url") & U.base_domain("url").isNotNull(),
        F.concat(F.lit("Only "), F.col("n").cast("string"), F.lit(
            " result(s) found. For broader coverage, try the base domain: "), U.base_domain("url")))
    return joined.select("crawl_id", "n", warning.alias("warning"))
