"""Site maps and search results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import url as U
from netloom.functions.tables import (
    CHINESE_FILLERS,
    CHINESE_STOP_WORDS,
    DEFINITION_PATTERN,
    DEFINITION_SUFFIX,
    ENGLISH_STOP_WORDS,
    LANGUAGE_ROUTES,
    QUERY_SUFFIXES,
    QUERY_TYPE_PATTERNS,
    TIME_RANGE_PATTERNS,
)
from netloom.operators.crawl import flag_blocked


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- term ranking ----------------------------------------------------------


def _term_vector(text: Column, words: Column) -> Column:
    """Occurrences of each word divided by the text length.

    An empty word (a query that starts with a separator) matches between all
    characters, as an empty pattern does.
    """
    lowered = F.lower(text)
    size = F.length(text)

    def share(word):
        hits = (F.length(lowered) - F.length(F.replace(lowered, word, F.lit("")))) / F.length(word)
        return F.when(word == "", size + 1).otherwise(hits).cast("double") / size

    return F.transform(words, share)


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def term_score(url, query) -> Column:
    """Cosine of the word shares of a URL and of the query itself."""
    words = F.split(F.lower(_c(query)), "[^A-Za-z0-9_]+")
    own, text = _term_vector(_c(query), words), _term_vector(_c(url), words)
    dot = F.aggregate(F.zip_with(own, text, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    length = _norm(own) * _norm(text)
    return F.when(F.coalesce(length, F.lit(0.0)) == 0, 0.0).otherwise(dot / length)


def rank_by_terms(urls: DataFrame, query, url: str = "url") -> DataFrame:
    """Adds ``score``; sort by it descending, then by ``pos``."""
    return urls.withColumn("score", term_score(url, query if isinstance(query, Column) else F.lit(query)))


# --- site map --------------------------------------------------------------


def dedupe_map_docs(docs: DataFrame, order: Column | None = None, by=()) -> DataFrame:
    """One row per URL: the first, or the first with a title if it has none.

    The row keeps the least ``order`` and the first position of all its
    documents, which may be another's.  ``docs`` has ``url, title,
    description, pos``.
    """
    rank = order if order is not None else F.struct("pos")
    body = F.struct("title", "description")
    return docs.groupBy(*by, "url").agg(
        F.min(rank).alias("order"), F.min("pos").alias("first_pos"),
        F.min_by(body, F.struct(F.col("title").isNull(), rank)).alias("_d"),
    ).select(*by, "url", "_d.title", "_d.description", "order", "first_pos")


def site_map(known: DataFrame, sitemap_urls: DataFrame, seed: str, query: str | None = None,
             limit: int = 5000, include_subdomains: bool = True, filter_by_path: bool = True,
             ignore_query: bool = True, sitemap: str = "include") -> DataFrame:
    """Ranked URLs of one site: ``url, title, description, order, first_pos``.

    Inputs have ``url, title, description, pos``.  ``sitemap`` is `include`,
    `skip`, or `only` (which leaves out the first entry).  One shuffle for the
    distinct URLs, then a bounded top-k.
    """
    shift = F.lit(1 << 40)
    listed = sitemap_urls.select("url", "title", "description", (F.col("pos") + shift).alias("pos"))
    if sitemap == "only":
        first = sitemap_urls.agg(F.min("pos")).scalar()
        docs = listed.where(F.col("pos") > first + shift)
    elif sitemap == "skip":
        docs = known.select("url", "title", "description", "pos")
    else:
        docs = known.select("url", "title", "description", "pos").unionByName(listed)
    score = term_score("url", F.lit(query.lower())) if query else F.lit(0.0)
    base = F.lit(seed)
    cleaned = docs.withColumn("_order", F.struct((-score).alias("s"), F.col("pos").alias("p"))
                              ).withColumn("url", U.clean_map_url("url", ignore_query)).where(
        F.col("url").isNotNull() & U.same_domain("url", base))
    if not include_subdomains:
        cleaned = cleaned.where(U.same_subdomain("url", base))
    if filter_by_path:
        route = U.path(base)
        cleaned = cleaned.where((route == "/") | U.path("url").startswith(route))
    merged = dedupe_map_docs(cleaned, F.col("_order"))
    top = merged.orderBy("order").limit(limit)
    return top.select("url", "title", "description", "order", "first_pos")


def prefer_https(urls: DataFrame) -> DataFrame:
    """One URL per page: https over http, then bare host over www.

    ``urls`` has ``url, pos``; ``first_pos`` keeps where the page first stood.
    """
    tail = F.regexp_extract("url", r"^[^?#]*(.*)$", 1)
    key = F.concat(U.strip_www(U.host("url")), U.path("url"), tail)
    rank = F.struct((U.scheme("url") != "https").alias("a"),
                    U.host("url").startswith("www.").alias("b"), F.col("pos").alias("c"))
    return urls.groupBy(key.alias("key")).agg(
        F.min_by("url", rank).alias("url"), F.min("pos").alias("first_pos"))


# --- queries ---------------------------------------------------------------


def query_language(query) -> Column:
    q = _c(query)
    chinese = F.regexp_count(q, F.lit("[一-鿿]"))
    kana = F.regexp_count(q, F.lit("[ぁ-ゟ゠-ヿ]"))
    share = chinese / F.nullif(F.length(q), F.lit(0))
    return (F.when(kana > 0, "mixed").when(share > 0.3, "zh").when(share < 0.05, "en")
            .otherwise("mixed"))


def query_keywords(query, language) -> Column:
    q, lang = _c(query), _c(language)
    stripped = F.regexp_replace(q, f"[{CHINESE_FILLERS}]", "")
    chinese = F.trim(F.array_join(F.filter(
        F.split(stripped, r"\s+"), lambda w: ~w.isin(list(CHINESE_STOP_WORDS))), " "))
    english = F.array_join(F.filter(
        F.split(q, r"\s+"), lambda w: ~F.lower(w).isin(list(ENGLISH_STOP_WORDS))), " ")
    return F.when(lang == "en", english).otherwise(chinese)


def _first_match(query: Column, table, default) -> Column:
    out = None
    for name, pattern in table:
        test = query.rlike("(?i)" + pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out if default is None else out.otherwise(default)


def time_range(query) -> Column:
    return _first_match(_c(query), TIME_RANGE_PATTERNS, None)


def query_type(query) -> Column:
    return _first_match(_c(query), QUERY_TYPE_PATTERNS, "general")


def rewrite_query(keywords, kind) -> Column:
    k, t = _c(keywords), _c(kind)
    out = F.when((t == "factual") & k.rlike(DEFINITION_PATTERN),
                 F.concat(k, F.lit(DEFINITION_SUFFIX)))
    for name, suffix in QUERY_SUFFIXES.items():
        out = out.when(t == name, F.concat(k, F.lit(suffix)))
    return out.otherwise(k)


def analyze_queries(queries: DataFrame, query: str = "query") -> DataFrame:
    """Adds language, time range, type, routes, keywords and rewritten query."""
    rows = queries.withColumns({
        "language": query_language(query), "time_range": time_range(query),
        "query_type": query_type(query)})
    rows = rows.withColumn("keywords", query_keywords(query, "language"))
    routes = F.lit(LANGUAGE_ROUTES["mixed"])
    for lang in ("zh", "en"):
        routes = F.when(F.col("language") == lang, LANGUAGE_ROUTES[lang]).otherwise(routes)
    return rows.withColumns({
        "routes": routes, "rewritten": rewrite_query("keywords", "query_type"),
        "lang": F.when(F.col("language").isin("zh", "en"), F.col("language")).otherwise("auto")})


# --- results ---------------------------------------------------------------


def diversify_by_domain(results: DataFrame, k: int = 3, by=("query_id",),
                        order: str = "rank") -> DataFrame:
    """At most ``k`` results per host in rank order; unreadable URLs pass.

    The literal bound cuts each host on the map side.
    """
    tagged = results.withColumn("_host", F.when(U.is_web_url("url"), U.host("url")))
    w = Window.partitionBy(*by, "_host").orderBy(order)
    kept = tagged.where("_host is not null").withColumn("_n", F.row_number().over(w)).where(
        F.col("_n") <= k).drop("_n")
    return kept.unionByName(tagged.where("_host is null")).drop("_host")


def significant_tokens(query) -> Column:
    q = _c(query)
    words = F.filter(F.regexp_extract_all(q, F.lit("[a-zA-Z]{2,}"), F.lit(0)),
                     lambda w: ~F.lower(w).isin(list(ENGLISH_STOP_WORDS)))
    return F.transform(F.concat(
        F.regexp_extract_all(q, F.lit("[一-鿿]{2,}"), F.lit(0)), words,
        F.regexp_extract_all(q, F.lit("[A-Z]{2,6}"), F.lit(0))), lambda t: F.lower(t))


def filter_by_relevance(results: DataFrame, by: str = "query_id",
                        query: str = "query") -> DataFrame:
    """Keeps results naming a significant token, unless fewer than two would stay."""
    rows = results.withColumn("_tokens", significant_tokens(query)).withColumn(
        "_text", F.lower(F.concat_ws(
            " ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))))
    rows = rows.withColumn("_hit", (F.size("_tokens") == 0) | F.exists(
        "_tokens", lambda t: F.col("_text").contains(t)))
    strong = rows.groupBy(by).agg(F.count_if("_hit").alias("_hits"))
    joined = rows.join(strong, by)
    return joined.where((F.col("_hits") < 2) | F.col("_hit")).drop(
        "_tokens", "_text", "_hit", "_hits")


def rank_results(results: DataFrame, n: int, page_size: int = 10,
                 by: str = "query_id") -> DataFrame:
    """Result list per query: ``rank`` 1..n.

    Positive scores only, best first within a page of the source; pages are
    taken until ``n`` results are there or a page is empty.  Then at most three
    per host, relevance, and the cut.  Windows see at most one page beyond
    ``n`` rows of a query.
    """
    pages = max(1, math.ceil(n / page_size))
    rows = results.withColumn("_page", F.floor(F.col("position") / page_size)).where(
        (F.col("_page") < pages) & (F.col("score") > 0))
    counts = rows.groupBy(by, "_page").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by).orderBy("_page")
    usable = counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_nth": F.row_number().over(w)}).where(
        (F.col("_before") < n) & (F.col("_nth") == F.col("_page") + 1)).select(by, "_page")
    taken = rows.join(usable, [by, "_page"], "left_semi")
    order = Window.partitionBy(by).orderBy("_page", F.desc("score"), "position")
    ranked = taken.withColumn("rank", F.row_number().over(order)).drop("_page")
    kept = filter_by_relevance(diversify_by_domain(ranked, 3, (by,)), by)
    final = Window.partitionBy(by).orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= n)


def search(results: DataFrame, limit: int, page_size: int = 10) -> DataFrame:
    """Asks for twice the limit, so that dropped results can be replaced."""
    return rank_results(results, limit * 2, page_size).where(F.col("rank") <= limit)


def items_to_fetch(web: DataFrame, news: DataFrame, images: DataFrame,
                   blocklist: DataFrame, allowed_keywords=(), unblocked=()) -> DataFrame:
    """URLs worth fetching, with the title and text of their result."""
    def part(df, kind, description):
        return df.where(F.col("url").isNotNull()).select(
            "query_id", "url", F.coalesce("title", F.lit("")).alias("title"),
            description.alias("description"), F.lit(kind).alias("kind"))

    everything = part(web, "web", F.col("description")).unionByName(
        part(news, "news", F.coalesce("snippet", F.lit("")))).unionByName(
        part(images, "image", F.lit("")))
    return flag_blocked(everything, blocklist, allowed_keywords, unblocked).where(
        "not blocked").drop("blocked")


def merge_fetched(results: DataFrame, documents: DataFrame, on: tuple[str, ...] = ("url",)) -> DataFrame:
    """Result rows with the fields of the fetched page laid over them.

    ``documents`` has ``on, title, description, markdown, status``; a fetch
    without a status counts as failed with status 500.  Of several fetches with
    the same ``on`` the lowest status counts, so a result never turns into two.
    """
    fetched = documents.select(
        *on, F.col("title").alias("_t"), F.col("description").alias("_d"), "markdown",
        F.coalesce("status", F.lit(500)).alias("status"))
    fields = F.struct("_t", "_d", "markdown", "status")
    docs = fetched.groupBy(*on).agg(F.min_by(fields, F.struct("status", F.col("markdown").isNull(), fields)).alias("_f")
                                    ).select(*on, "_f.*")
    joined = results.join(docs, list(on), "left")
    return joined.select(
        *[F.coalesce("_t", results["title"]).alias("title") if c == "title"
          else F.coalesce("_d", results["description"]).alias("description") if c == "description"
          else joined[c] for c in results.columns],
        "markdown", "status")
