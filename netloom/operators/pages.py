"""Raw pages to links, images, metadata and other page fields.

A page table has ``page_id, url, html``.  All operators here are row-local:
they read ``html`` once, keep results in arrays and only then explode, so no
page is shuffled and one scan serves several extractions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import html as H
from netloom.functions import url as U
from netloom.functions.tables import TYPED_META
from netloom.session import write_table


def explode_computed(df: DataFrame, keep: list[str], array: Column, pos: str,
                     value: str) -> DataFrame:
    """Explodes an array that is costly to compute.

    A plain ``explode`` makes the optimizer add a size filter, which computes
    the array a second time; the outer form with a NULL filter does not.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(
        F.col(value).isNotNull())


def base_href(html, url) -> Column:
    """Base URL for links: the first ``base`` element, else the page URL."""
    written = H.unquote(F.regexp_extract(html, H.BASE_HREF, 1))
    resolved = H.once(H.unescape(written, attribute=True), lambda raw: F.nullif(U.resolve_url(raw, url), F.lit("")))
    return F.when(html.rlike(H.BASE_HREF), F.coalesce(resolved, url)).otherwise(url)


def hrefs(html) -> Column:
    """``href`` of every anchor in document order, as written."""
    found = F.regexp_extract_all(H.strip_noise(html), F.lit(H.A_HREF), F.lit(1))
    decoded = F.transform(found, lambda h: H.unescape(H.unquote(h), attribute=True))
    return F.transform(decoded, U.clean_href)


def _with_base(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_base", base_href(F.col("html"), F.col("url")))


def _resolved_links(base: str = "_base", found: str = "_hrefs") -> Column:
    resolved = F.transform(F.col(found), lambda h: U.resolve_clean(h, F.col(base)))
    return F.array_distinct(F.filter(resolved, lambda u: u != ""))


def with_links(pages: DataFrame, out: str = "links") -> DataFrame:
    """Adds the distinct resolved links of each page, first position kept."""
    return _with_base(pages).withColumn("_hrefs", hrefs(F.col("html"))).withColumn(
        out, _resolved_links()).drop("_base", "_hrefs")


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per distinct link of a page: ``page_id, url, pos, link``."""
    return explode_computed(
        with_links(pages.select("page_id", "url", "html")), ["page_id", "url"],
        F.col("links"), "pos", "link")


def link_report(pages: DataFrame) -> DataFrame:
    """http links by origin, with the page's totals on every row."""
    rows = with_links(pages.select("page_id", "url", "html")).select(
        "page_id", "url",
        F.filter("links", lambda u: u.startswith("http")).alias("links"),
        U.origin("url").alias("_origin"))
    typed = rows.withColumn("_typed", F.transform(
        "links", lambda u: F.struct(
            u.alias("link"),
            F.when(U.origin(u) == F.col("_origin"), "internal").otherwise("external").alias("type"))))
    internal = F.size(F.filter("_typed", lambda t: t["type"] == "internal"))
    return typed.select(
        "page_id", "url", F.size("_typed").alias("total"), internal.alias("internal"),
        (F.size("_typed") - internal).alias("external"), F.explode_outer("_typed").alias("_t"),
    ).select("page_id", "url", "_t.link", "_t.type", "total", "internal", "external")


# --- images ----------------------------------------------------------------


def _srcset_urls(srcset: Column) -> Column:
    parts = F.transform(F.split(srcset, ","), lambda p: F.split(F.trim(p), r"\s+").getItem(0))
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


IMAGE_META = ("og:image", "og:image:url", "og:image:secure_url", "twitter:image",
              "twitter:image:src", "image")


def _of_kind(kind: int, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def image_sources(html) -> Column:
    """Every image reference of a page, unresolved, in a fixed order of kinds."""
    img = H.tags(html, "img")
    pictures = F.array_join(
        F.regexp_extract_all(html, F.lit(r"(?is)<picture\b.*?</picture\s*>"), F.lit(0)), " ")
    metas = F.filter(H.tags(html, "meta"), lambda t: F.coalesce(
        (H.raw_attribute(t, "property").isin(*IMAGE_META[:3]))
        | (H.raw_attribute(t, "name").isin(*IMAGE_META[3:5]))
        | (H.raw_attribute(t, "itemprop") == IMAGE_META[5]), F.lit(False)))
    icons = F.filter(H.tags(html, "link"), lambda t: F.coalesce(
        H.raw_attribute(t, "rel").rlike("icon|apple-touch-icon|image_src"), F.lit(False)))
    styled = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?is)<[a-z][^>]*\bstyle\s*=[^>]*>"), F.lit(0)),
        lambda t: F.coalesce(H.raw_attribute(t, "style").contains("background"), F.lit(False)))
    sets = F.concat(F.transform(img, lambda t: H.raw_attribute(t, "srcset")),
                    F.transform(H.tags(pictures, "source"), lambda t: H.raw_attribute(t, "srcset")))
    styles = F.transform(styled, lambda t: H.raw_attribute(t, "style"))
    kinds = [
        F.transform(img, lambda t: H.raw_attribute(t, "src")), F.transform(img, lambda t: H.raw_attribute(t, "data-src")),
        sets, F.transform(metas, lambda t: H.raw_attribute(t, "content")),
        F.transform(icons, lambda t: H.raw_attribute(t, "href")),
        F.transform(H.tags(html, "video"), lambda t: H.raw_attribute(t, "poster")), styles]
    # all values are decoded in one place: (kind, value)
    valued = F.concat(*[_of_kind(i, values) for i, values in enumerate(kinds)])
    decoded = F.transform(valued, lambda x: F.struct(x["kind"].alias("kind"), H.unescape(x["value"], attribute=True).alias("value")))
    return _present(F.flatten(F.transform(decoded, lambda x: (
        F.when(x["kind"] == 2, _srcset_urls(x["value"]))
        .when(x["kind"] == 6, F.transform(
            F.regexp_extract_all(x["value"], F.lit(r"url\(['\"]?([^'\")]+)['\"]?\)"), F.lit(1)), lambda u: F.trim(u)))
        .otherwise(F.array(x["value"]))))))


def with_images(pages: DataFrame, out: str = "images") -> DataFrame:
    rows = _with_base(pages).withColumn("_src", image_sources(H.strip_noise("html")))

    def resolve(src):
        return (
            F.when(src.rlike("^(data|blob):|^https?://"), src)
            .when(src.startswith("//"), U.resolve_clean(src, F.col("url")))
            .otherwise(U.resolve_clean(src, F.col("_base"))))

    rows = rows.withColumn("_src", F.transform("_src", U.clean_href))
    found = F.filter(F.transform("_src", resolve), lambda u: (
        ~F.lower(u).startswith("javascript:") & (u != "")
        & (u.rlike("^(data|blob):") | u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))))
    return rows.withColumn(out, F.array_distinct(found)).drop("_base", "_src")


def extract_images(pages: DataFrame) -> DataFrame:
    return explode_computed(
        with_images(pages.select("page_id", "url", "html")), ["page_id", "url"],
        F.col("images"), "pos", "image")


def biggest_srcset(srcset, src) -> Column:
    """Largest candidate of a ``srcset``; ``src`` counts as 1x if all are x."""
    def parse(part):
        words = F.split(F.trim(part), " ")
        last = F.element_at(words, -1)
        sized = (F.size(words) > 1) & last.rlike(r"[xw]$")
        size_text = F.when(sized, last).otherwise(F.lit("1x"))
        return F.struct(
            F.regexp_replace(size_text, r"[xw]$", "").try_cast("double").alias("size"),
            F.when(sized, F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
            .otherwise(F.trim(part)).alias("url"),
            size_text.endswith("x").alias("is_x"))

    source = F.coalesce(F.col(src) if isinstance(src, str) else src, F.lit(""))
    text = F.col(srcset) if isinstance(srcset, str) else srcset
    sizes = F.filter(F.transform(F.split(text, ","), parse), lambda s: s["size"].isNotNull())
    own = F.array(F.struct(F.lit(1.0).alias("size"), source.alias("url"), F.lit(True).alias("is_x")))
    everything = F.when(
        F.forall(sizes, lambda s: s["is_x"]) & (source != ""), F.concat(sizes, own)).otherwise(sizes)
    # First of the largest: order by size, then by earlier position.
    indexed = F.transform(everything, lambda s, i: F.struct(
        s["size"].alias("size"), (-i).alias("order"), s["url"].alias("url")))
    return F.coalesce(F.array_max(indexed)["url"], F.when(source != "", source))


# --- metadata --------------------------------------------------------------


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _parsed_metas(html: Column) -> Column:
    """Attributes of every ``meta`` element, read once."""
    names = ("name", "property", "itemprop", "content")
    values = F.transform(H.tags(html, "meta"), lambda t: F.transform(
        F.array(*[H.raw_attribute(t, n) for n in names]), lambda v: H.unescape(v, attribute=True)))
    return F.transform(values, lambda v: F.struct(*[F.get(v, i).alias(n) for i, n in enumerate(names)]))


def _first_meta(attr: str, key: str) -> Column:
    hits = F.filter("_metas", lambda m: F.coalesce(m[attr] == key, F.lit(False)))
    return F.get(hits, 0)["content"]


def page_title(html) -> Column:
    """Text of the first ``title`` element; NULL when there is none."""
    raw = F.regexp_extract(html, r"(?is)(<title\b[^>]*>.*?)</title\s*>", 1)
    return F.when(raw != "", H.unescape(F.regexp_replace(raw, r"(?is)^<title\b[^>]*>", "")))


def page_language(html) -> Column:
    return H.attribute(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang")


def _meta_entries() -> Column:
    """Typed fields, then every ``meta`` element under its own key."""
    exact = F.filter("_links", lambda t: F.coalesce(H.raw_attribute(t, "rel") == "icon", F.lit(False)))
    favicon = H.attribute(F.coalesce(F.get(exact, 0), F.get("_links", 0)), "href")
    typed = [
        _entry(F.lit("title"), F.col("_title")), _entry(F.lit("favicon"), favicon),
        _entry(F.lit("language"), F.col("_lang")),
    ]
    typed += [_entry(F.lit(out), _first_meta(attr, key))
              for out, (attr, key) in TYPED_META.items()]
    alternates = F.transform(
        F.filter("_metas", lambda m: F.coalesce(
            m["property"] == "og:locale:alternate", F.lit(False))),
        lambda m: _entry(F.lit("ogLocaleAlternate"), m["content"]))
    keyed = F.transform("_metas", lambda m: _entry(
        F.coalesce(m["name"], m["property"], m["itemprop"]), m["content"]))
    return F.filter(F.concat(F.array(*typed), alternates, keyed),
                    lambda e: e["key"].isNotNull() & e["value"].isNotNull())


def _entry_map(entries: Column) -> Column:
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))

    def values(key):
        own = F.transform(F.filter(entries, lambda e: e["key"] == key), lambda e: e["value"])
        return (
            F.when(key == "title", F.slice(own, 1, 1))
            .when(key == "description", F.array(F.array_join(own, ", ")))
            .otherwise(own))

    return F.map_from_entries(F.transform(keys, lambda k: F.struct(
        k.alias("key"), values(k).alias("value"))))


def with_metadata(pages: DataFrame, out: str = "metadata") -> DataFrame:
    """Adds MAP<STRING, ARRAY<STRING>> of all page metadata.

    Repeated keys collect their values; ``description`` values are joined by a
    comma; a page title is never replaced, and is filled from the social tags
    when missing.
    """
    clean = F.col("_clean")
    rows = (
        pages.withColumn("_clean", H.strip_noise("html"))
        .withColumns({
            "_metas": _parsed_metas(clean), "_title": page_title(clean),
            "_lang": page_language(clean),
            "_links": F.filter(H.tags(clean, "link"), lambda t: F.coalesce(
                H.raw_attribute(t, "rel").contains("icon"), F.lit(False)))})
        .withColumn("_entries", _meta_entries())
        .withColumn("_map", _entry_map(F.col("_entries"))))

    def only(key):
        return F.get(F.col("_map")[key], 0)

    fallback = F.coalesce(only("ogTitle"), only("og:title"), only("twitter:title"))
    needs = ~F.map_contains_key("_map", "title") & F.coalesce(fallback != "", F.lit(False))
    filled = F.when(needs, F.map_concat(
        F.col("_map"), F.create_map(F.lit("title"), F.array(fallback)))).otherwise(F.col("_map"))
    return rows.withColumn(out, filled).drop(
        "_entries", "_map", "_clean", "_metas", "_title", "_lang", "_links")


def extract_metadata(pages: DataFrame) -> DataFrame:
    """One row per page with typed columns next to the open map."""
    m = F.col("metadata")
    names = ["title", "description", "language", "favicon", *TYPED_META]
    return with_metadata(pages.select("page_id", "url", "html")).select(
        "page_id", "url", *[F.get(m[n], 0).alias(n) for n in names], "metadata")


# --- other page fields -----------------------------------------------------

_DATA_FRAME = r"(?is)<iframe\s(?:[^>]*?\s)?src\s*=\s*(\"data:text/html[^\"]*\"|'data:text/html[^']*')"


def inline_frames(html) -> Column:
    """Decoded HTML of frames whose source is a data URL."""
    raw = F.regexp_extract_all(html, F.lit(_DATA_FRAME), F.lit(1))
    texts = F.transform(raw, lambda s: F.try_url_decode(
        F.replace(F.get(F.split(H.unquote(s), ",", 3), 1), F.lit("+"), F.lit("%2B"))))
    return F.filter(texts, lambda t: t.isNotNull())


def data_iframe_links(pages: DataFrame) -> DataFrame:
    """Links of a page and of the inline frames nested in it, at any depth.

    The frames of one level are written once and are the next level's pages;
    nested text is shorter than what holds it, so the loop ends.
    """
    level = pages.select("page_id", "url", "html", F.lit(0).alias("frame_depth"))
    out = None
    while True:
        found = explode_computed(
            with_links(level), ["page_id", "url", "frame_depth"], F.col("links"), "pos", "link"
        ).drop("pos")
        out = found if out is None else out.unionByName(found)
        level = write_table(explode_computed(
            level.withColumn("frame_depth", F.col("frame_depth") + 1),
            ["page_id", "url", "frame_depth"], inline_frames(F.col("html")), "pos", "html"
        ).drop("pos"))
        if level.isEmpty():
            break
    return out.groupBy("page_id", "url", "link").agg(F.min("frame_depth").alias("frame_depth"))


_PLAYER = """struct<
  videoDetails: struct<title: string, author: string, lengthSeconds: string, viewCount: string,
    shortDescription: string, isPrivate: boolean,
    thumbnail: struct<thumbnails: array<struct<url: string, width: int, height: int>>>>,
  microformat: struct<playerMicroformatRenderer: struct<canonicalUrl: string, isUnlisted: boolean,
    ownerProfileUrl: string, uploadDate: string, publishDate: string, likeCount: string,
    category: string>>,
  endscreen: struct<endscreenRenderer: struct<elements: array<struct<endscreenElementRenderer:
    struct<style: string, title: struct<simpleText: string>,
      endpoint: struct<commandMetadata: struct<webCommandMetadata: struct<url: string>>>>>>>>
>"""


def is_video_page(url) -> Column:
    name, route = U.host(url), U.path(url)
    watch = name.rlike(r"(^|\.)youtube\.com$") & (route == "/watch") & (
        F.regexp_extract(U.query(url), r"(?:^|&)v=([^&]+)", 1) != "")
    return watch | ((name == "youtu.be") & (route != "/"))


def video_markdown(html, url) -> Column:
    """Text of a video page from its embedded player data; NULL if unreadable."""
    raw = F.split(F.get(F.split(html, "var ytInitialPlayerResponse = ", 2), 1), ";var meta =", 2)
    data = F.from_json(F.get(raw, 0), _PLAYER)
    video, info = data["videoDetails"], data["microformat"]["playerMicroformatRenderer"]
    thumb = F.try_element_at(video["thumbnail"]["thumbnails"], F.lit(-1))
    seconds = video["lengthSeconds"].try_cast("double").cast("bigint")
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds / 60) % 60

    def two(n):
        return F.lpad(n.cast("bigint").cast("string"), 2, "0")

    length = F.concat(
        F.when(hours > 0, F.concat(two(hours), F.lit(":"))).otherwise(""),
        two(minutes), F.lit(":"), two(seconds % 60))
    ends = F.filter(
        F.coalesce(data["endscreen"]["endscreenRenderer"]["elements"], F.from_json(
            F.lit("[]"), "array<struct<endscreenElementRenderer: struct<style: string, "
            "title: struct<simpleText: string>, endpoint: struct<commandMetadata: "
            "struct<webCommandMetadata: struct<url: string>>>>>>")),
        lambda e: F.coalesce(e["endscreenElementRenderer"]["style"] == "VIDEO", F.lit(False)))
    end_lines = F.transform(ends, lambda e: F.concat(
        F.lit("- ["), e["endscreenElementRenderer"]["title"]["simpleText"], F.lit("]("),
        U.resolve_url(
            e["endscreenElementRenderer"]["endpoint"]["commandMetadata"]["webCommandMetadata"]["url"],
            url), F.lit(")")))
    visibility = F.when(video["isPrivate"], "Private").when(
        info["isUnlisted"], "Unlisted").otherwise("Public")
    head = F.concat(
        F.lit("![Thumbnail ("), thumb["width"].cast("string"), F.lit("x"),
        thumb["height"].cast("string"), F.lit(")]("), thumb["url"], F.lit(")\n# ["),
        video["title"], F.lit("]("), info["canonicalUrl"], F.lit(")"))
    fields = F.concat_ws(
        "\n", F.concat(F.lit("**Visibility**: "), visibility),
        F.concat(F.lit("**Uploaded by**: ["), video["author"], F.lit("]("),
                 info["ownerProfileUrl"], F.lit(")")),
        F.concat(F.lit("**Uploaded at**: "), info["uploadDate"]),
        F.concat(F.lit("**Published at**: "), info["publishDate"]),
        F.concat(F.lit("**Length**: "), length),
        F.concat(F.lit("**Views**: "), video["viewCount"]),
        F.concat(F.lit("**Likes**: "), info["likeCount"]),
        F.concat(F.lit("**Category**: "), info["category"]))
    body = F.concat(F.lit("## Description\n\n```\n"), video["shortDescription"], F.lit("\n```"))
    tail = F.when(F.size(ends) > 0, F.concat(
        F.lit("\n\n## Endscreen\n\n"), F.array_join(end_lines, "\n"))).otherwise("")
    return F.concat(head, F.lit("\n\n"), fields, F.lit("\n\n"), body, tail)


def video_page_markdown(pages: DataFrame) -> DataFrame:
    return pages.where(is_video_page("url")).select(
        "page_id", "url", video_markdown(F.col("html"), F.col("url")).alias("markdown"))


def repo_listing(pages: DataFrame) -> DataFrame:
    """Entries of code-host directory pages.

    ``pages`` has ``page_id, html, owner, repo, branch`` and ``base_path``
    (empty for the root).  Directories come before files; a path is listed
    once.  Without matching links the embedded data is used.
    """
    def entries(kind_path: str, kind: str) -> Column:
        quoted = [F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")
                  for c in (F.col("owner"), F.col("repo"), F.col("branch"))]
        pattern = F.concat(
            F.lit('href="/'), quoted[0], F.lit("/"), quoted[1], F.lit(f"/{kind_path}/"),
            quoted[2], F.lit('/([^"]+)"'))
        paths = F.transform(F.regexp_extract_all("html", pattern, F.lit(1)),
                            lambda p: F.coalesce(F.try_url_decode(
                                F.replace(p, F.lit("+"), F.lit("%2B"))), p))
        inside = F.transform(paths, lambda p: F.struct(
            F.when(F.col("base_path") == "", p).otherwise(F.regexp_replace(
                F.substr(p, F.length("base_path") + 1), r"^/", "")).alias("name"), p.alias("path"), F.lit(kind).alias("type")))
        return F.filter(inside, lambda e: (e["name"] != "") & ~e["name"].contains("/"))

    pages = pages.withColumn("_linked", F.concat(entries("tree", "dir"), entries("blob", "file")))
    pages = pages.withColumn("_paths", F.transform("_linked", lambda e: e["path"]))
    first = F.filter("_linked", lambda e, i: F.array_position("_paths", e["path"]) == i + 1)
    payload = F.regexp_extract(
        "html", r'(?s)<script[^>]*data-target="react-app.embeddedData"[^>]*>(.*?)</script>', 1)
    item = "array<struct<name: string, path: string, contentType: string>>"
    tree = F.from_json(payload, "struct<payload: struct<tree: struct<items: " + item
                       + ">, fileTree: struct<items: " + item + ">>>")
    items = F.coalesce(tree["payload"]["tree"]["items"], tree["payload"]["fileTree"]["items"])
    embedded = F.transform(items, lambda x: F.struct(
        F.coalesce(x["name"], x["path"]).alias("name"),
        F.concat(F.when(F.col("base_path") == "", "").otherwise(
            F.concat("base_path", F.lit("/"))), F.coalesce(x["name"], x["path"])).alias("path"),
        F.when(x["contentType"] == "directory", "dir").otherwise("file").alias("type")))
    chosen = F.when(F.size(first) > 0, first).otherwise(embedded)
    return pages.select("page_id", F.posexplode(chosen).alias("pos", "_e")).select(
        "page_id", "pos", "_e.name", "_e.path", "_e.type")
