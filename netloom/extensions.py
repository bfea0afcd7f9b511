"""Extension surface: page postprocessors, derivation stack, SQL functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import blocks as B
from netloom.operators import pages as P
from netloom.sources.tables import FORMAT_FIELDS, coerce_formats

# --- postprocessors --------------------------------------------------------


@dataclass(frozen=True)
class Postprocessor:
    """A named change of ``markdown`` for the pages its predicate picks.

    ``run`` gives the new text or NULL, and NULL leaves the page as it was, so
    a page that cannot be processed is never lost.
    """

    name: str
    predicate: Callable[[], Column]
    run: Callable[[], Column]


_REGISTERED: dict[str, Postprocessor] = {}


def register_postprocessor(name: str, predicate: Callable[[], Column],
                           run: Callable[[], Column]) -> Postprocessor:
    if name in _REGISTERED:
        raise ValueError(f"postprocessor {name!r} exists")
    _REGISTERED[name] = Postprocessor(name, predicate, run)
    return _REGISTERED[name]


def unregister_postprocessor(name: str) -> None:
    del _REGISTERED[name]


def registered() -> list[Postprocessor]:
    return list(_REGISTERED.values())


def apply_postprocessors(docs: DataFrame, processors: list[Postprocessor] | None = None) -> DataFrame:
    """Runs each postprocessor at most once per page, in order.

    ``postprocessors_used`` names the ones that changed the page.
    """
    out = docs
    for column, kind in (("markdown", "string"), ("postprocessors_used", "array<string>")):
        if column not in out.columns:
            empty = F.array() if column == "postprocessors_used" else F.lit(None)
            out = out.withColumn(column, empty.cast(kind))
    for p in processors if processors is not None else registered():
        picked = p.predicate() & ~F.array_contains("postprocessors_used", p.name)
        out = out.withColumn("_new", F.when(F.coalesce(picked, F.lit(False)), p.run()))
        out = out.withColumns({
            "markdown": F.coalesce("_new", "markdown"),
            "postprocessors_used": F.when(F.col("_new").isNotNull(), F.concat(
                "postprocessors_used", F.array(F.lit(p.name)))).otherwise(
                F.col("postprocessors_used"))}).drop("_new")
    return out


def video_postprocessor() -> Postprocessor:
    return Postprocessor("youtube", lambda: P.is_video_page("url"),
                         lambda: P.video_markdown(F.col("html"), F.col("url")))


# --- derivation stack ------------------------------------------------------


def derive(pages: DataFrame, formats, main_only: bool = True, include=(), exclude=(),
           remove_base64: bool = True, processors: list[Postprocessor] | None = None,
           attributes: list[tuple[str, str]] = (), previous: DataFrame | None = None) -> DataFrame:
    """Requested document fields of raw pages.

    Only what a requested format needs is computed: the tree is parsed for
    markdown and attributes alone, and links, images and metadata are
    expressions that the optimizer drops when unused.
    """
    unknown = set(formats) - set(FORMAT_FIELDS)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    docs = pages.select("page_id", "url", "html", F.col("html").alias("raw_html"))
    if "links" in formats:
        docs = P.with_links(docs)
    if "images" in formats:
        docs = P.with_images(docs)
    if "metadata" in formats:
        docs = P.with_metadata(docs)
    docs = apply_postprocessors(docs, list(processors or []))
    needs_markdown = "markdown" in formats or "changeTracking" in formats
    if needs_markdown or "attributes" in formats:
        keep = tuple(c for c in docs.columns if c != "html")
        trees = B.page_trees(docs, keep)
        if "attributes" in formats:
            asked = B.extract_attributes(trees, list(attributes)).groupBy("page_id").agg(
                F.collect_list(F.struct("selector", "attribute", "values")).alias("attributes"))
            trees = trees.join(asked, "page_id", "left")
        preset = trees.withColumnRenamed("markdown", "_preset")
        rendered = (B.markdown_with_fallback(preset, include, exclude).drop("fell_back") if main_only
                    else B.page_markdown(preset, include, exclude, False))
        docs = rendered.withColumn("markdown", F.coalesce("_preset", "markdown")).drop("_preset")
        docs = docs.withColumn("html", F.col("raw_html"))
    if "changeTracking" in formats and previous is not None:
        old = previous.select("url", F.sha2("content", 256).alias("_old"))
        docs = docs.join(old, "url", "left").withColumn("change_status", F.when(
            F.col("_old").isNull(), "new").when(F.col("_old") == F.sha2("markdown", 256), "same")
            .otherwise("changed")).drop("_old")
    out = coerce_formats(docs, formats)
    if remove_base64 and "markdown" in out.columns:
        out = out.withColumn("markdown", B.strip_inline_images("markdown"))
    return out


# --- SQL table functions ---------------------------------------------------

def register_sql(spark: SparkSession) -> None:
    """Makes two table functions callable in SQL, for lateral joins.

    ``url_spellings(url)`` is a SQL function over built-in expressions and is
    inlined by the optimizer; ``page_links(html, url)`` reads the element tree
    and runs as an Arrow-free Python table function, for ad-hoc SQL.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, href string")
    class PageLinks:
        def eval(self, html: str, url: str):
            from urllib.parse import urljoin

            from netloom.functions.pagetree import read_page

            nodes, _ = read_page(html)
            seen = {}
            for n in nodes:
                href = dict(n["attrs"]).get("href") if n["tag"] == "a" else None
                if href is None or href.strip().startswith("#"):
                    continue
                href = href.strip()
                absolute = href if href.startswith(("http://", "https://", "mailto:")) else urljoin(url, href)
                if absolute:
                    seen.setdefault(absolute, len(seen))
            for href, pos in seen.items():
                yield pos, href

    spark.udtf.register("page_links", PageLinks)
    bare = r"regexp_replace(lower(regexp_extract(page_url, '://([^/?#:]*)', 1)), '^www[.]', '')"
    port = (r"regexp_extract(regexp_replace(lower(page_url), '^(http://[^/?#]*):80(?=[/?#]|$)|^(https://[^/?#]*):443(?=[/?#]|$)', '$1$2'), "
            r"'://[^/?#]*?(:[0-9]+)(?=[/?#]|$)', 1)")
    stem = r"regexp_replace(regexp_extract(page_url, '://[^/?#]*([^?#]*)', 1), '(/index[.](html|php)|/)$', '')"
    rest = r"regexp_extract(page_url, '^[^?#]*(.*)$', 1)"
    spark.sql(f"""
      create or replace temporary function url_spellings(page_url string)
      returns table (spelling string)
      return select distinct s || w || {bare} || {port} ||
          case when {stem} || f = '' then '/' else {stem} || f end || {rest}
        from (select explode(array('http://', 'https://')) as s)
        cross join (select explode(array('www.', '')) as w)
        cross join (select explode(array('/index.html', '/index.php', '/', '')) as f)
    """)
