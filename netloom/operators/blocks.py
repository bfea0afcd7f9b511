"""Element trees as a table, and the content work on top of them.

``page_trees`` is the one job that parses pages: an Arrow map over partitions
with one output row per page, so nothing is shuffled and a page stays whole.
``nodes`` and ``blocks`` are nested arrays; selecting main content is a
higher-order filter on them, and only corpus-wide questions explode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from netloom.functions import html as H
from netloom.functions import url as U
from netloom.functions.tables import (
    BOILERPLATE_SELECTORS,
    FORCE_KEEP_SELECTORS,
    NEVER_CONTENT_TAGS,
)
from netloom.operators.pages import page_title
from netloom.session import cut_lineage

NODE = ("struct<pos: int, tag: string, id: string, classes: array<string>, "
        "attrs: map<string, string>, ancestors: array<int>>")
BLOCK = ("struct<pos: int, ancestors: array<int>, tag: string, level: int, text: string, "
         "markdown: string>")

_NODE_ARROW = pa.struct([
    ("pos", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
    ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
    ("ancestors", pa.list_(pa.int32()))])
_BLOCK_ARROW = pa.struct([
    ("pos", pa.int32()), ("ancestors", pa.list_(pa.int32())), ("tag", pa.string()),
    ("level", pa.int32()), ("text", pa.string()), ("markdown", pa.string())])


# Bytes of text whose Python objects a task holds at a time; a longer text stands alone.
PIECE_BYTES = 1 << 18


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows with about ``PIECE_BYTES`` of text.

    A batch has many thousands of rows and their elements take many times the
    bytes of the text, so objects are made run by run.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE_BYTES)) + 1
    starts = [0, *cuts.tolist()] if len(sizes) else []
    return zip(starts, np.diff([*starts, len(sizes)]).tolist())


def _parse_batches(batches):
    from netloom.functions.pagetree import read_page

    for batch in batches:
        at = batch.schema.names.index("html")
        names = [n for n in batch.schema.names if n != "html"]
        for start, length in pieces(batch.column(at)):
            rows = batch.slice(start, length)
            nodes, blocks = zip(*(read_page(h) for h in rows.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(n) for n in names), pa.array(nodes, pa.list_(_NODE_ARROW)),
                 pa.array(blocks, pa.list_(_BLOCK_ARROW))],
                names=[*names, "nodes", "blocks"])


def page_trees(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the ``keep`` columns, ``nodes`` and ``blocks``."""
    source = pages.select(*keep, "html")
    types = dict(source.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return source.mapInArrow(_parse_batches, f"{schema}, nodes array<{NODE}>, blocks array<{BLOCK}>")


def page_blocks(pages: DataFrame) -> DataFrame:
    """One row per text block: position, tag path, id, classes, level, text."""
    trees = page_trees(pages)
    return trees.select("page_id", "url", "nodes", F.explode("blocks").alias("b")).select(
        "page_id", "url", "b.pos", "b.tag", "b.level", "b.text", "b.markdown",
        F.array_join(F.transform("b.ancestors", lambda a: F.get(F.col("nodes"), a)["tag"]), ">")
        .alias("tag_path"),
        F.get(F.col("nodes"), F.element_at("b.ancestors", -1))["id"].alias("elem_id"),
        F.get(F.col("nodes"), F.element_at("b.ancestors", -1))["classes"].alias("classes"))


def page_nodes(pages: DataFrame) -> DataFrame:
    """One row per element."""
    return page_trees(pages).select("page_id", "url", F.explode("nodes").alias("n")).select(
        "page_id", "url", "n.*")


# --- selectors -------------------------------------------------------------


def _split_selectors(selectors) -> tuple[list[str], list[str], list[str]]:
    names = [s for s in selectors if s[0] not in ".#"]
    ids = [s[1:] for s in selectors if s[0] == "#"]
    classes = [s[1:] for s in selectors if s[0] == "."]
    return names, ids, classes


def node_matches(node: Column, selectors) -> Column:
    """True if an element matches any selector: `tag`, `#id` or `.class`."""
    names, ids, classes = _split_selectors(selectors)
    hit = F.lit(False)
    if names:
        hit = hit | node["tag"].isin(names)
    if ids:
        hit = hit | F.coalesce(node["id"].isin(ids), F.lit(False))
    if classes:
        hit = hit | F.arrays_overlap(node["classes"], F.array(*[F.lit(c) for c in classes]))
    return hit


def _positions(nodes: Column, test) -> Column:
    return F.transform(F.filter(nodes, test), lambda n: n["pos"])


def content_blocks(include=(), exclude=(), main_only: bool = True) -> Column:
    """Blocks left after content selection, as an array.

    Head, scripts and the like never count.  With ``include`` only blocks in
    matching elements stay; ``exclude`` drops matching elements; with
    ``main_only`` page furniture is dropped unless it holds a keep marker.
    """
    nodes, blocks = F.col("nodes"), F.col("blocks")
    dropped = _positions(nodes, lambda n: node_matches(
        n, [*NEVER_CONTENT_TAGS, *exclude]))
    if main_only:
        # Elements that contain a keep marker: all ancestors of marked elements.
        safe = F.array_distinct(F.flatten(F.transform(
            F.filter(nodes, lambda n: node_matches(n, FORCE_KEEP_SELECTORS)),
            lambda n: n["ancestors"])))
        furniture = _positions(nodes, lambda n: node_matches(n, BOILERPLATE_SELECTORS))
        dropped = F.concat(dropped, F.array_except(furniture, safe))
    kept = F.filter(blocks, lambda b: ~F.arrays_overlap(b["ancestors"], dropped))
    if include:
        wanted = _positions(nodes, lambda n: node_matches(n, include))
        kept = F.filter(kept, lambda b: F.arrays_overlap(b["ancestors"], wanted))
    return F.coalesce(kept, F.array().cast(f"array<{BLOCK}>"))


def main_content(trees: DataFrame, include=(), exclude=(), main_only: bool = True) -> DataFrame:
    """One row per kept block."""
    kept = content_blocks(include, exclude, main_only)
    others = [c for c in trees.columns if c not in ("nodes", "blocks")]
    return trees.select(*others, F.explode_outer(kept).alias("b")).where("b is not null").select(
        *others, "b.pos", "b.tag", "b.level", "b.text", "b.markdown")


def _markdown(blocks: Column) -> Column:
    """Blocks joined by blank lines; items of one list follow each other."""
    lines = F.transform(blocks, lambda b, i: F.concat(
        F.when(i == 0, "")
        .when((b["tag"] == "li") & (F.get(blocks, i - 1)["tag"] == "li"), "\n")
        .when((b["tag"] == "tr") & (F.get(blocks, i - 1)["tag"] == "tr"), "\n")
        .otherwise("\n\n"), b["markdown"]))
    return F.array_join(lines, "")


def page_markdown(trees: DataFrame, include=(), exclude=(), main_only: bool = True,
                  content_type: str | None = None, raw: str | None = None) -> DataFrame:
    """Markdown per page; JSON pages become one fenced block of the raw text."""
    others = [c for c in trees.columns if c not in ("nodes", "blocks")]
    rows = trees.withColumn("_kept", content_blocks(include, exclude, main_only)).withColumn(
        "_md", _markdown(F.col("_kept")))
    md = clean_markdown_links("_md", once=True)
    if content_type is not None and raw is not None:
        md = F.when(F.coalesce(F.col(content_type), F.lit("")).contains("application/json"),
                    F.concat(F.lit("```json\n"), F.col(raw), F.lit("\n```"))).otherwise(md)
    return rows.select(*others, md.alias("markdown"))


def markdown_with_fallback(trees: DataFrame, include=(), exclude=()) -> DataFrame:
    """Main content, or the whole page where that is empty."""
    others = [c for c in trees.columns if c not in ("nodes", "blocks")]
    rows = trees.withColumns({
        "_main_kept": content_blocks(include, exclude, True),
        "_all_kept": content_blocks(include, exclude, False),
    }).withColumn("_main", _markdown(F.col("_main_kept"))).withColumn(
        "_fell", F.trim("_main") == "")
    chosen = F.when(F.col("_fell"), _markdown(F.col("_all_kept"))).otherwise(F.col("_main"))
    return rows.withColumn("_md", chosen).select(
        *others, F.col("_fell").alias("fell_back"), clean_markdown_links("_md", once=True).alias("markdown"))


def inner_text(trees: DataFrame) -> DataFrame:
    """Body text per page."""
    others = [c for c in trees.columns if c not in ("nodes", "blocks")]
    body = _positions(F.col("nodes"), lambda n: n["tag"] == "body")
    head = _positions(F.col("nodes"), lambda n: n["tag"] == "head")
    kept = F.filter("blocks", lambda b: ~F.arrays_overlap(b["ancestors"], head) & (
        (F.size(body) == 0) | F.arrays_overlap(b["ancestors"], body)))
    return trees.select(*others, F.array_join(
        F.transform(kept, lambda b: b["text"]), "\n").alias("text"))


def fulltext(pages: DataFrame) -> DataFrame:
    """Content, title and source URL per page."""
    titled = pages.withColumn("title", F.coalesce(page_title(H.strip_noise("html")), F.lit("")))
    trees = page_trees(titled, ("page_id", "url", "title"))
    return markdown_with_fallback(trees).select(
        "page_id", F.col("url").alias("source_url"), "title", F.col("markdown").alias("content"))


# --- attributes ------------------------------------------------------------


def _matcher(selector: str):
    return lambda n: node_matches(n, [selector])


def _attribute_of(name: str):
    if name.startswith("data-"):
        return lambda n: n["attrs"][name]
    return lambda n: F.coalesce(n["attrs"][name], n["attrs"]["data-" + name])


def extract_attributes(trees: DataFrame, selectors: list[tuple[str, str]]) -> DataFrame:
    """Attribute values per (selector, attribute), in document order.

    A missing attribute falls back to its ``data-`` form; a selector that is
    not understood yields no values.
    """
    asked = []
    for selector, name in selectors:
        simple = bool(selector) and all(
            ch.isalnum() or ch in "-_" for ch in selector.lstrip(".#")) and selector[-1] not in ".#"
        if simple:
            hits = F.filter("nodes", _matcher(selector))
            values = F.transform(hits, _attribute_of(name))
            values = F.filter(values, lambda v: v.isNotNull())
        else:
            values = F.array().cast("array<string>")
        asked.append(F.struct(
            F.lit(selector).alias("selector"), F.lit(name).alias("attribute"),
            values.alias("values")))
    others = [c for c in trees.columns if c not in ("nodes", "blocks")]
    return trees.select(*others, F.explode(F.array(*asked)).alias("_a")).select(
        *others, "_a.selector", "_a.attribute", "_a.values")


# --- site boilerplate ------------------------------------------------------

SIGNATURE_MIN_CHARS = 6


def block_signatures(trees: DataFrame, mode: str = "t") -> DataFrame:
    """Hash per block of at least six characters.

    ``mode`` picks what counts next to the tag path: `c` classes, `i` ids,
    `t` text; with `t` alone the text decides.
    """
    node = F.get(F.col("nodes"), F.element_at("b.ancestors", -1))
    parts = []
    if mode != "t":
        parts.append(F.array_join(F.transform(
            "b.ancestors", lambda a: F.get(F.col("nodes"), a)["tag"]), ">"))
    if "i" in mode:
        parts.append(F.coalesce(node["id"], F.lit("")))
    if "c" in mode:
        parts.append(F.array_join(node["classes"], " "))
    if "t" in mode:
        parts.append(F.col("b.text"))
    others = [c for c in trees.columns if c not in ("nodes", "blocks")]
    return trees.select(*others, "nodes", F.explode("blocks").alias("b")).where(
        F.length("b.text") >= SIGNATURE_MIN_CHARS).select(
        *others, "b.pos", "b.text",
        F.sha2(F.concat_ws("\u0001", *parts), 256).alias("signature"))


def site_signatures(signed: DataFrame, min_pages: int) -> DataFrame:
    """Signatures seen on at least ``min_pages`` pages of a registrable domain.

    Pages are first reduced to distinct signatures, then counted with map-side
    partial sums, so a frequent signature is not a hot spot.
    """
    once = U.with_domain(signed, domain=U.host("url")).select("domain", "signature", "page_id").distinct()
    return once.groupBy("domain", "signature").agg(F.count("*").alias("pages")).where(
        F.col("pages") >= min_pages)


def site_boilerplate(trees: DataFrame, min_pages: int, mode: str = "t") -> DataFrame:
    """Blocks whose signature is not site furniture."""
    # Pages are parsed once; both sides of the join read the written rows.
    signed = cut_lineage(U.with_domain(block_signatures(trees, mode), domain=U.host("url")))
    common = site_signatures(signed, min_pages).select("domain", "signature")
    return signed.join(common, ["domain", "signature"], "left_anti")


# --- markdown clean-up -----------------------------------------------------


def escaped_breaks(text: bytes) -> bytes:
    """A backslash before each line break inside brackets.

    The depth never falls below zero, so it is the running sum of brackets less
    the least sum so far: no stack, and one pass over the bytes.
    """
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((raw == 91) | (raw == 93) | (raw == 10))
    sums = np.cumsum(np.where(raw[at] == 91, 1, np.where(raw[at] == 93, -1, 0)))
    depth = sums - np.minimum(np.minimum.accumulate(sums), 0) if len(at) else sums
    inside = at[(raw[at] == 10) & (depth > 0)]
    return np.insert(raw, inside, 92).tobytes() if len(inside) else text


def _escaped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for start, length in pieces(batch):
            texts = batch.slice(start, length).cast(pa.binary()).to_pylist()
            yield pa.array([t if t is None else escaped_breaks(t) for t in texts], pa.binary()).cast(pa.string())


_escape_breaks = F.arrow_udf(_escaped, StringType())
_escape_breaks_once = F.arrow_udf(_escaped, StringType()).asNondeterministic()


def clean_markdown_links(md, once: bool = False) -> Column:
    """Escapes line breaks inside link text, drops skip-to-content anchors.

    Only texts with brackets and line breaks go through the escaping.  With
    ``once`` a filter on the result stays above it; else the optimizer copies
    the call, and all that makes its text, into the filter and runs both.
    """
    text = F.col(md) if isinstance(md, str) else md
    multi_line = text.contains("\n") & text.contains("[")
    escape = _escape_breaks_once if once else _escape_breaks
    return remove_skip_links(F.coalesce(escape(F.when(multi_line, text)), text))


def remove_skip_links(md) -> Column:
    text = F.col(md) if isinstance(md, str) else md
    return F.regexp_replace(text, r"(?i)\[skip to content\]\(#[^)]*\)", "")


def strip_inline_images(md) -> Column:
    """Embedded image data becomes a short placeholder."""
    text = F.col(md) if isinstance(md, str) else md
    return F.regexp_replace(
        text, r"(!\[.*?\])\(data:image/.*?;base64,.*?\)", "$1(<Base64-Image-Removed>)")
