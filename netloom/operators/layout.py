"""Positioned document text: lines, tables, headings, paragraphs, clean-up.

Inputs are tables of glyph runs (``doc_id, page, text, x, y, width,
font_size``), of lines (``doc_id, page, line_no, y, text, font_size``) or of
page figures.  Windows and ordered folds work within one page or one document,
which is one source row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from netloom.functions.html import once
from netloom.session import write_table

OCR_MIN_TEXT_OPS = 3
TEXT_PAGE_RATIO = 0.6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- documents -------------------------------------------------------------


def classify_documents(page_stats: DataFrame) -> DataFrame:
    """Kind of each document with confidence and the pages that need OCR.

    ``page_stats`` has ``doc_id, page, has_text, has_images, is_template,
    n_ops``.
    """
    flagged = F.col("is_template") | ((F.col("n_ops") < OCR_MIN_TEXT_OPS) & F.col("has_images"))
    totals = page_stats.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if("has_text").alias("text_pages"),
        F.count_if("has_images").alias("image_pages"), F.count_if("is_template").alias("template_pages"),
        F.sum("n_ops").alias("ops"), F.array_sort(F.collect_list("page")).alias("_all"),
        F.array_sort(F.collect_list(F.when(flagged, F.col("page")))).alias("_flagged"))
    text, images, ops = F.col("text_pages"), F.col("image_pages"), F.col("ops")
    ratio = text / F.col("pages")
    template_ratio = F.col("template_pages") / F.col("pages")
    template = (F.col("template_pages") > 0) & (text > 0)
    rules = (
        (template, "mixed", 0.5 + 0.3 * (1.0 - template_ratio), True),
        (ratio >= TEXT_PAGE_RATIO, "text", ratio, False),
        ((text == 0) & (images > 0) & (ops == 0), "scanned", F.lit(0.95), True),
        ((text == 0) & (images > 0), "image", F.lit(0.8), True),
        ((text > 0) & (images > 0), "mixed", F.lit(0.7), True),
        (ops == 0, "scanned", F.lit(0.9), True),
    )
    kind, sure, ocr = None, None, None
    for test, name, confidence, needs in rules:
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        sure = F.when(test, confidence) if sure is None else sure.when(test, confidence)
        ocr = F.when(test, needs) if ocr is None else ocr.when(test, needs)
    out = totals.select(
        "doc_id", "pages", kind.otherwise("text").alias("kind"),
        sure.otherwise(F.greatest(ratio, F.lit(0.5))).alias("confidence"),
        ocr.otherwise(False).alias("ocr_recommended"), "_all", "_flagged")
    pages = (F.when(F.col("kind").isin("scanned", "image"), F.col("_all"))
             .when(F.col("kind") == "mixed", F.col("_flagged"))
             .otherwise(F.array().cast("array<bigint>")))
    return out.select("doc_id", "pages", "kind", "confidence", "ocr_recommended",
                      pages.alias("ocr_pages"))


MS_PER_PAGE = 150
MIN_CONFIDENCE = 0.95


def extraction_route(docs: DataFrame, mode: str = "auto", budget_ms: int | None = None) -> DataFrame:
    """Adds ``route`` (`direct`, `fallback`, `refused`) and ``reason``.

    ``docs`` has ``kind, confidence, is_complex, has_text, pages``.
    """
    reason = (
        F.when(F.col("kind") != "text", "not text based")
        .when(F.col("confidence") < MIN_CONFIDENCE, "low confidence")
        .when(F.col("is_complex"), "complex layout").when(~F.col("has_text"), "empty text"))
    rows = docs.withColumn("_why", reason)
    needs_ocr = F.lit(mode == "fast") & F.col("kind").isin("scanned", "image")
    late = F.lit(False) if budget_ms is None else F.col("pages") * MS_PER_PAGE > budget_ms
    route = (
        F.when(needs_ocr, "refused").when(F.col("_why").isNull(), "direct").when(late, "refused")
        .otherwise("refused" if mode == "fast" else "fallback"))
    why = F.when(needs_ocr, "ocr required").when(
        F.col("_why").isNotNull() & late, "not enough time").otherwise(F.col("_why"))
    return rows.withColumns({"route": route, "reason": why}).drop("_why")


def page_selection(spec, last) -> Column:
    """Sorted page numbers of a text such as ``1-5,10``, within 1..last."""
    def number(text):
        return F.regexp_extract(text, r"^\s*([0-9]+)", 1).try_cast("int")

    def pages(part):
        ends = F.split(part, "-")
        lo = F.greatest(number(F.get(ends, 0)), F.lit(1))
        hi = F.least(number(F.get(ends, 1)), _c(last).cast("int"))
        single = number(part)
        none = F.array().cast("array<int>")
        span = F.when(lo.isNotNull() & number(F.get(ends, 0)).isNotNull()
                      & number(F.get(ends, 1)).isNotNull() & (lo <= hi), F.sequence(lo, hi)).otherwise(none)
        one = F.when(single.between(1, _c(last).cast("int")), F.array(single)).otherwise(none)
        return F.when(part.contains("-"), span).otherwise(one)

    parts = F.transform(F.split(_c(spec), ","), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def select_pages(pages: DataFrame, spec: str, last="last_page") -> DataFrame:
    return pages.where(F.array_contains(page_selection(F.lit(spec), last), F.col("page").cast("int")))


# --- lines and tables from glyph runs --------------------------------------


def _bands(items: DataFrame, tolerance: float) -> DataFrame:
    """Adds ``band``: runs of rounded y values at most ``tolerance`` apart, top down."""
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("_y"), "x", "_n")
    rows = items.withColumn("_y", F.round("y").cast("bigint")).withColumn(
        "_n", F.monotonically_increasing_id() if "word_no" not in items.columns else F.col("word_no"))
    gap = F.coalesce(F.lag("_y").over(order) - F.col("_y"), F.lit(0))
    return rows.withColumn("_new", (gap > tolerance).cast("int")).withColumn(
        "band", F.sum("_new").over(order)).drop("_new")


def _ordered_text(separator: str = " ") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "_n", "text"))),
                                    lambda s: s["text"]), separator)


def items_to_lines(items: DataFrame, tolerance: float = 2) -> DataFrame:
    """Glyph runs to text lines: ``doc_id, page, line_no, y, text``."""
    return _bands(items, tolerance).groupBy("doc_id", "page", F.col("band").alias("line_no")).agg(
        F.max("y").alias("y"), _ordered_text().alias("text"))


def _page_table(items: Column, row_tolerance: float, column_gap: float) -> Column:
    """The table of a page as an array of one row, NULL if it has none; ``items`` are sorted upwards.

    A band is a slice of the items, a cell holds what lies between two column starts.
    """
    xs = F.sort_array(F.array_distinct(F.filter(
        F.transform(items, lambda i: F.round(i["x"]).cast("bigint")), lambda x: x.isNotNull())))
    columns = once(xs, lambda found: F.filter(
        found, lambda x, i: (i == 0) | (x - F.get(found, i - 1) > column_gap)))
    cuts = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | F.coalesce(
        F.get(items, i)["y"] - F.get(items, i - 1)["y"] > row_tolerance, F.lit(False)))
    bands = once(cuts, lambda found: F.transform(found, lambda at, k: F.sort_array(F.transform(
        F.slice(items, at + 1, F.coalesce(F.get(found, k + 1), F.size(items)) - at),
        lambda i: F.struct(i["x"].alias("x"), i["n"].alias("n"), i["text"].alias("text"))))))

    def kept(starts: Column) -> Column:
        def inside(x: Column, start: Column, j: Column) -> Column:
            # without x, or left of all starts: the first column
            after = F.get(starts, j + 1)
            return ((start - 10 <= x) | (j == 0)) & ((x < after - 10) | after.isNull() | x.isNull())

        def row(band: Column) -> Column:
            return F.transform(starts, lambda s, j: F.trim(F.array_join(F.transform(
                F.filter(band, lambda i: inside(i["x"], s, j)), lambda i: i["text"]), " ")))

        rows = F.transform(F.transform(F.reverse(bands), row), lambda r: F.struct(
            r.alias("row"), F.size(F.filter(r, lambda c: c != "")).cast("bigint").alias("filled")))
        return F.filter(rows, lambda r: r["filled"] >= F.ceil(F.size(starts) / 2))

    def table(starts: Column, rows: Column) -> Column:
        height, width = F.size(rows).cast("bigint"), F.size(starts).cast("bigint")
        filled = F.aggregate(rows, F.lit(0).cast("bigint"), lambda n, r: n + r["filled"])
        return F.array(F.struct(
            F.transform(rows, lambda r: r["row"]).alias("rows"), height.alias("row_count"), width.alias("col_count"),
            F.round(filled / (height * width), 2).alias("confidence")))

    return once(columns, lambda starts: F.when(F.size(starts) >= 2, once(
        kept(starts), lambda rows: F.when(F.size(rows) >= 2, table(starts, rows)))))


def items_to_tables(items: DataFrame, row_tolerance: float = 3, column_gap: float = 30) -> DataFrame:
    """Tables of positioned text, at most one per page.

    Rows are bands, columns are clusters of x more than ``column_gap`` apart;
    rows at least half filled stay, and two rows, two columns and six items are
    needed.

    The items of a page meet once, in its row, and the table is cut out of them there:
    no item is joined or sorted beside those of other pages.  The array of one is
    exploded, so that no filter repeats what makes it.
    """
    page = ["doc_id", "page"]
    number = F.monotonically_increasing_id() if "word_no" not in items.columns else F.col("word_no")
    rows = items.where("doc_id is not null and page is not null").select(
        *page, F.struct(F.round("y").cast("bigint").alias("y"), "x", number.alias("n"), "text").alias("_item"))
    pages = rows.groupBy(*page).agg(F.sort_array(F.collect_list("_item")).alias("_items")).where(F.size("_items") >= 6)
    return pages.select(*page, F.explode(_page_table(F.col("_items"), row_tolerance, column_gap)).alias("t")).select(
        *page, "t.*")


def _row_line(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))


def table_markdown(rows) -> Column:
    """Header, separator and body of one table."""
    r = _c(rows)
    first = F.get(r, 0)
    rule = _row_line(F.transform(first, lambda c: F.lit("---")))
    body = F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), _row_line)
    return F.concat_ws("\n", _row_line(first), rule, F.when(
        F.size(r) > 1, F.array_join(body, "\n")))


def tables_to_markdown(tables: DataFrame) -> DataFrame:
    return tables.withColumn("markdown", table_markdown("rows"))


FOOTNOTE = r"^(\([0-9]*\)|[0-9]+\)|(?i)notes?:)"


def _trimmed(row: Column) -> Column:
    return F.transform(row, lambda c: F.trim(c))


def _is_continuation(row: Column) -> Column:
    others = F.filter(F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))), lambda c: c != "")
    count = F.size(others)
    chars = F.aggregate(others, F.lit(0), lambda a, c: a + F.octet_length(c))
    numeric = F.size(F.filter(others, lambda c: c.rlike(r"^[0-9.,\- ]*$")))
    sub_header = (count == 1) & (F.octet_length(F.get(others, 0)) <= 5)
    data = (count >= 2) & (chars / count <= 10.0) & (numeric > F.floor(count / 2))
    return (F.get(row, 0) == "") & (count > 0) & ~sub_header & ~data


def _merged_rows(body: Column) -> Column:
    """Rows with their continuation rows, each row read once.

    Header and first row stand for themselves; from there on a row is a segment's
    start unless it continues the row above, and a segment's cells are joined.
    """
    def merged(rows: Column) -> Column:
        def joined(at: Column, end: Column) -> Column:
            part = F.slice(rows, at + 1, end - at)
            return F.when(end - at == 1, F.get(rows, at)).otherwise(F.transform(F.get(rows, at), lambda c, j: F.array_join(
                F.filter(F.transform(part, lambda r: F.get(r, j)), lambda x: x != ""), " ")))

        starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i < 2) | ~F.coalesce(
            _is_continuation(F.get(rows, i)), F.lit(False)))
        segments = once(starts, lambda found: F.transform(
            found, lambda at, k: joined(at, F.coalesce(F.get(found, k + 1), F.size(rows)))))
        return F.when(F.size(rows) > 0, segments).otherwise(rows)

    return once(body, merged)


def padded_table_markdown(rows) -> Column:
    """Aligned table; continuation rows merged upwards, footnotes below."""
    clean = F.filter(F.transform(_c(rows), _trimmed), lambda r: F.exists(r, lambda c: c != ""))
    notes = F.filter(clean, lambda r: F.get(r, 0).rlike(FOOTNOTE))
    body = F.filter(clean, lambda r: ~F.get(r, 0).rlike(FOOTNOTE))
    return once(F.struct(_merged_rows(body).alias("rows"), notes.alias("notes")), _render_padded)


def _render_padded(t: Column) -> Column:
    rows = t["rows"]
    widths = F.transform(F.get(rows, 0), lambda c, i: F.greatest(F.lit(3), F.array_max(
        F.transform(rows, lambda r: F.coalesce(F.octet_length(F.get(r, i)), F.lit(0))))))

    def drawn(sizes: Column) -> Column:
        def line(row):
            return F.concat(F.lit("|"), F.array_join(F.zip_with(row, sizes, lambda c, w: F.concat(
                F.lit(" "), F.rpad(c, F.greatest(w, F.length(c)), " "), F.lit(" |"))), ""))

        rule = F.concat(F.lit("|"), F.array_join(F.transform(sizes, lambda w: F.concat(
            F.lit(" "), F.repeat(F.lit("-"), w), F.lit(" |"))), ""))
        return F.concat(F.array(line(F.get(rows, 0)), rule),
                        F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line))

    lines = once(widths, drawn)
    notes = F.transform(t["notes"], lambda n: F.array_join(F.filter(n, lambda c: c != ""), " "))
    tail = F.when(F.size(notes) > 0, F.concat(F.lit("\n"), F.array_join(notes, "\n"), F.lit("\n"))
                  ).otherwise("")
    return F.when(F.size(rows) == 0, "").otherwise(
        F.concat(F.array_join(lines, "\n"), F.lit("\n"), tail))


# --- running headers -------------------------------------------------------

EDGE_LINES = 5


def comparison_key(text) -> Column:
    """Line text without surrounding page numbers, white space collapsed."""
    squashed = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(squashed, r"^[0-9]+", "")), r"[0-9]+$", ""))


def _is_structural(text: Column) -> Column:
    return text.rlike(r"^\s*(#|- |\* |• )") | (
        text.rlike(r"^\s*[0-9]") & (text.contains(". ") | text.contains(") ")))


def _is_decoration(text: Column) -> Column:
    return text.rlike(r"^(.)\1*$")


def strip_repeated_lines(lines: DataFrame) -> DataFrame:
    """Drops running headers and footers of documents of three or more pages.

    Such a line repeats on enough pages, near a page edge and at a steady
    height; all fragments of its height on the page go with it.  The joined
    text of a height is tested too.

    The lines of a page meet once and leave one row for each height near an edge,
    with its keys.  A key is reduced to its pages, times and spread of height;
    what repeats drops its heights by an anti join.  No line carries anything of
    its document, so a document of any length takes many tasks.
    """
    band = ["doc_id", "page", "_band"]
    rows = lines.withColumn("_band", F.round(F.col("y") * 10).cast("bigint"))
    page = Window.partitionBy("doc_id", "page")
    near = rows.withColumns({
        "_up": F.dense_rank().over(page.orderBy("y")), "_down": F.dense_rank().over(page.orderBy(F.desc("y"))),
        "_reach": F.max("y").over(page) - F.min("y").over(page)}).withColumn(
        "_edge", (F.col("_up") <= EDGE_LINES) | (F.col("_down") <= EDGE_LINES))
    line = F.struct("line_no", "y", F.col("_edge").alias("edge"), "text")
    heights = near.groupBy(*band).agg(F.max("_edge").alias("_any"), F.first("_reach").alias("_reach"),
                                      F.sort_array(F.collect_list(line)).alias("_lines")).where("_any")
    first = F.get("_lines", 0)
    joined = F.when(F.size("_lines") >= 2, comparison_key(F.array_join(F.transform("_lines", lambda t: t["text"]), " ")))
    one = F.transform(F.filter("_lines", lambda t: t["edge"]), lambda t: F.struct(
        F.lit(0).alias("kind"), comparison_key(t["text"]).alias("key"), t["y"].alias("y"), F.lit(True).alias("counts")))
    # a joined text counts once, by its first line
    whole = F.array(F.struct(F.lit(1).alias("kind"), joined.alias("key"), first["y"].alias("y"), first["edge"].alias("counts")))
    heights = write_table(heights.select(*band, "_reach", F.concat(one, whole).alias("_keys")))
    documents = heights.groupBy("doc_id", "page").agg(F.first("_reach").alias("_reach")).groupBy("doc_id").agg(
        F.count("*").alias("_pages"), F.greatest(F.avg("_reach"), F.lit(1.0)).alias("_avg")).where("_pages >= 3")
    keyed = heights.select(*band, F.explode("_keys").alias("k")).select(*band, "k.*").where(
        (F.octet_length("key") >= 10) & ~_is_decoration(F.col("key")) & ~_is_structural(F.col("key")))
    repeated = keyed.where("counts").groupBy("doc_id", "kind", "key").agg(
        F.count_distinct("page").alias("_on"), F.count("*").alias("_times"), F.stddev_pop("y").alias("_spread")
    ).where("_on >= 3").join(documents, "doc_id").where(
        (F.col("_on") >= F.floor(F.col("_pages") * 30 / 100))
        & ((F.col("_times") < 2) | (F.col("_spread") / F.col("_avg") < 0.05)))
    gone = keyed.join(repeated.select("doc_id", "kind", "key"), ["doc_id", "kind", "key"], "left_semi").select(*band).distinct()
    return rows.join(gone, band, "left_anti").select(*lines.columns)


# --- headings and paragraphs -----------------------------------------------


def base_sizes(lines: DataFrame) -> DataFrame:
    """Body font size per document: most lines, then the smaller; 12 if unknown."""
    counted = lines.where("font_size >= 9").groupBy(
        "doc_id", F.floor(F.round(F.col("font_size") * 10, 4)).alias("_size")).agg(F.count("*").alias("_n"))
    best = counted.groupBy("doc_id").agg(
        F.max_by("_size", F.struct(F.col("_n"), -F.col("_size"))).alias("_best"))
    return lines.select("doc_id").distinct().join(best, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("_best") / 10.0, F.lit(12.0)).alias("base_size"))


def heading_tiers(lines: DataFrame) -> DataFrame:
    """Base size and up to four heading sizes per document, largest first."""
    sized = lines.join(base_sizes(lines), "doc_id")
    sizes = sized.groupBy("doc_id", "base_size").agg(F.sort_array(F.collect_set(F.when(
        F.col("font_size") / F.col("base_size") >= 1.2, F.col("font_size"))), asc=False).alias("_sizes"))
    empty = F.array().cast("array<double>")

    def step(acc, size):
        return F.when(F.exists(acc, lambda t: F.abs(t - size) < 0.5), acc).otherwise(
            F.concat(acc, F.array(size)))

    tiers = F.slice(F.aggregate("_sizes", empty, step), 1, 4)
    return sizes.select("doc_id", "base_size", tiers.alias("tiers"))


def heading_level(size, base, tiers) -> Column:
    s, b, t = _c(size), _c(base), _c(tiers)
    ratio = s / b
    near = F.filter(F.transform(t, lambda x, i: F.when(F.abs(x - s) < 0.5, i + 1)),
                    lambda i: i.isNotNull())
    tiered = F.when(F.size(near) > 0, F.get(near, 0)).when(
        ratio >= 1.5, F.least(F.size(t) + 1, F.lit(4)))
    plain = F.when(ratio >= 2.0, 1).when(ratio >= 1.5, 2).when(ratio >= 1.25, 3).otherwise(4)
    return F.when(ratio < 1.2, None).when(F.size(t) > 0, tiered).otherwise(plain)


def heading_levels(lines: DataFrame) -> DataFrame:
    """Adds ``level`` (NULL for body text)."""
    return lines.join(heading_tiers(lines), "doc_id").withColumn(
        "level", heading_level("font_size", "base_size", "tiers")).drop("base_size", "tiers")


def _heading_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the headings of lines sorted by page; a line that joins none has a number of its own."""
    page, level, top, number = None, None, 0.0, 0
    for batch in batches:
        numbers = []
        for doc, on, y, size, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "y", "font_size", "level"))):
            joins = (doc, on) == page and own is not None and own == level and 0 < top - y < size * 2
            if not joins:
                page, level, top, number = (doc, on), own, y, number + 1
            numbers.append(number)
        yield batch.append_column("segment", pa.array(numbers, pa.int64()))


def merge_headings(lines: DataFrame) -> DataFrame:
    """Joins wrapped headings: same page, same level, close to the first line.

    ``lines`` carries ``level``.  The distance counts from the first line of the
    heading, so the lines of a page are numbered in order, one at a time and
    holding none; the lines of a number are then joined.
    """
    rows = lines.select("doc_id", "page", "line_no", F.col("y").cast("double").alias("y"),
                        F.col("font_size").cast("double").alias("font_size"), "level", "text")
    numbered = rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "line_no").mapInArrow(
        _heading_segments, StructType([*rows.schema.fields, StructField("segment", LongType())]))
    line = F.struct("line_no", "y", "font_size", "level", "text")
    merged = numbered.groupBy("doc_id", "page", "segment").agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    head, rest = F.get("_lines", 0), F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))
    text = F.array_join(F.concat(F.array(head["text"]), F.transform(rest, lambda x: F.ltrim(x["text"]))), " ")
    return merged.select("doc_id", "page", head["line_no"].alias("line_no"), head["y"].alias("y"),
                         head["font_size"].alias("font_size"), head["level"].alias("level"), text.alias("text"))


def has_dot_leaders(text) -> Column:
    t = _c(text)
    return t.contains("....") | (F.regexp_count(t, F.lit(r"\.{3,}")) >= 2)


def paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs per document: ``doc_id, paragraph, page, text``.

    A gap well above the document's median line gap ends a paragraph, as does
    the end of the page; lines with dot leaders stand alone.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    based = lines.join(base_sizes(lines), "doc_id").withColumns({
        "_gap": F.lag("y").over(order) - F.col("y"), "_dots": has_dot_leaders("text"),
        "_dots_before": F.coalesce(F.lag(has_dot_leaders("text")).over(order), F.lit(True))})
    usable = (F.col("_gap") > 0) & (F.col("_gap") < F.col("base_size") * 10)
    gaps = based.groupBy("doc_id", "base_size").agg(
        F.array_sort(F.collect_list(F.when(usable, F.col("_gap")))).alias("_gaps"))
    median = F.get(F.col("_gaps"), F.floor(F.size("_gaps") / 2).cast("int"))
    limits = gaps.select("doc_id", F.when(F.size("_gaps") < 5, F.col("base_size") * 1.8).otherwise(
        F.greatest(median * 1.3, F.col("base_size") * 1.5)).alias("_limit"))
    breaks = (F.col("_gap").isNull() | (F.col("_gap") > F.col("_limit")) | F.col("_dots")
              | F.col("_dots_before"))
    whole = Window.partitionBy("doc_id").orderBy("page", "line_no")
    numbered = based.join(limits, "doc_id").withColumn("_break", breaks.cast("int")).withColumn(
        "paragraph", F.sum("_break").over(whole))
    return numbered.groupBy("doc_id", "paragraph").agg(F.min("page").alias("page"), F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ")
        .alias("text"))


# --- text clean-up ---------------------------------------------------------

_LETTER = "[a-zA-ZáàâãéèêíïóôõöúçñÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ]"
PAGE_NUMBER = (
    r"^(?:[0-9]{1,4}|(?i:page\s*(?:of(?: .*)?|[0-9].*)?)|[0-9]+\s* of \s*[0-9]+|-\s*[0-9]+\s*-)$")
BARE_URL = r"https?://[^\s<>)\]]+[^\s<>)\].,;]"


def _drop_page_numbers(text: Column) -> Column:
    """Page-number lines that stand alone or just before a rule."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.struct(s.alias("raw"), F.trim(s).alias("t")))

    def keep(rows):
        def test(line, i):
            n = F.size(rows)
            before, after = F.get(rows, i - 1)["t"], F.get(rows, i + 1)["t"]
            second = F.get(rows, i + 2)["t"]
            alone = ((i == 0) | F.coalesce(before.isin("---", ""), F.lit(False))) & (
                (i == n - 1) | F.coalesce(after.isin("---", ""), F.lit(False)))
            rule = F.coalesce((after == "---") | ((after == "") & (second == "---")), F.lit(False))
            return ~(line["t"].rlike(PAGE_NUMBER) & (alone | rule))
        return F.transform(F.filter(rows, test), lambda s: s["raw"])

    # The one-element transform names the line array, so it is built once.
    kept = F.get(F.transform(F.array(lines), keep), 0)
    return F.array_join(kept, "\n")


def _link_urls(text: Column) -> Column:
    """Bare URLs become links; those inside a link stay."""
    return F.regexp_replace(
        text, r"(\]\(" + BARE_URL + r"|\[[^\[\]]*" + BARE_URL + r"[^\[\]]*\])|(" + BARE_URL + ")",
        "$1\u0001$2\u0002")


def clean_text(md) -> Column:
    """Dot leaders, spaced hyphens, page numbers, bare URLs and blank lines."""
    text = F.regexp_replace(_c(md), r"\.{4,}", " ... ")
    text = F.regexp_replace(text, f"({_LETTER}) - ({_LETTER})", "$1-$2")
    text = _drop_page_numbers(text)
    text = F.regexp_replace(F.regexp_replace(_link_urls(text), "\u0001\u0002", ""),
                            "\u0001([^\u0002]*)\u0002", "[$1]($1)")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"))


# Ligatures and what they stand for.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def normalize_glyphs(text) -> Column:
    """Ligatures expanded, control and invisible characters dropped, wide blanks plain."""
    out = F.regexp_replace(
        _c(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\u00AD\u200B-\u200D\u2060\uFEFF]", "")
    out = F.regexp_replace(out, r"[\u2000-\u200A]", " ")
    for glyph, letters in LIGATURES:
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return out


# --- cells and line kinds --------------------------------------------------

_NUMBER = r"[0-9,.()\-+%]*[0-9][0-9,.()\-+%]*"
_VALUE = rf"(?:\$\s+{_NUMBER}|{_NUMBER}|[—–\-‒])"
ALL_VALUES = rf"^\s*{_VALUE}(?:\s+{_VALUE})*\s*$"


def split_value_cells(items: DataFrame) -> DataFrame:
    """Wide runs that hold only money or number values become one item each.

    A text of values has no letters.  Of its parts only those with a currency sign
    have white space, and a part carries the number of parts, not the parts.
    """
    values = F.regexp_extract_all("text", F.lit(rf"(?:\$\s+)?{_NUMBER}|[—–\-‒](?=\s|$)"), F.lit(0))
    eligible = (F.col("width") > F.col("font_size") * 20) & F.col("text").rlike(ALL_VALUES)
    rows = items.withColumn("_values", F.when(eligible, values))
    split = F.when(F.size("_values") >= 3, F.col("_values")).otherwise(F.array("text"))
    parts = rows.withColumn("_parts", split).drop("_values").withColumn("_n", F.size("_parts"))
    spacing = F.col("width") / F.col("_n")
    cut = F.col("_n") >= 3
    others = [c for c in items.columns if c not in ("text", "x", "width")]
    return parts.select(
        *others, "x", "width", "_n", F.posexplode("_parts").alias("part", "text")).select(
        *others, "part", F.when(cut & F.col("text").startswith("$"), F.regexp_replace("text", r"\s+", " ")).otherwise(
            F.col("text")).alias("text"),
        F.when(cut, F.col("x") + spacing * F.col("part") + spacing * 0.5).otherwise(F.col("x")).alias("x"),
        F.when(cut, spacing * 0.9).otherwise(F.col("width")).alias("width"))


# How captions, code and fixed-width fonts announce themselves.
CAPTION_PREFIXES = (
    "Figure ", "Figura ", "Fig. ", "Fig ", "Table ", "Tabela ", "Source:", "Fonte:", "Source ", "Fonte ",
    "Note:", "Nota:", "Chart ", "Gráfico ", "Graph ", "Diagram ", "Image ", "Imagem ", "Photo ", "Foto ",
)
CODE_PREFIXES = (
    "import ", "export ", "from ", "const ", "let ", "var ", "function ", "class ", "def ", "pub fn ",
    "fn ", "async fn ", "impl ", "=> ", "-> ", ":: ", ":= ",
)
FIXED_WIDTH_FONTS = (
    "courier", "consolas", "monaco", "menlo", "mono", "fixed", "terminal", "typewriter", "source code",
    "fira code", "jetbrains", "inconsolata", "dejavu sans mono", "liberation mono",
)
BULLETS = r"^\s*([•○●◦] |[\-*] )"


def is_caption(text) -> Column:
    t = F.trim(_c(text))
    hit = F.lower(t).rlike(r"^(figure |table |source:)")
    for p in CAPTION_PREFIXES:
        hit = hit | t.startswith(p)
    return hit


def is_list_item(text) -> Column:
    t = F.ltrim(_c(text))
    head = F.substring(t, 1, 5)
    numbered = head.rlike("[0-9]") & head.rlike(r"^[0-9]*[.)]")
    return t.rlike(BULLETS) | numbered | t.rlike(r"^([A-Za-z][.)]|\(.\))")


def is_code_like(text) -> Column:
    t = F.trim(_c(text))
    hit = t.rlike(r"[;{}]$")
    for p in CODE_PREFIXES:
        hit = hit | t.startswith(p)
    return hit | ((F.regexp_count(t, F.lit(r"[{}()\[\];=<>]")) >= 3) & (F.octet_length(t) < 200))


def is_fixed_width(font) -> Column:
    name, hit = F.lower(_c(font)), F.lit(False)
    for p in FIXED_WIDTH_FONTS:
        hit = hit | name.contains(p)
    return hit


def line_kind(text, font=None) -> Column:
    """caption, list_item, code, monospace or text: the first that fits."""
    kind = F.when(is_caption(text), "caption").when(is_list_item(text), "list_item").when(
        is_code_like(text), "code")
    if font is not None:
        kind = kind.when(F.coalesce(is_fixed_width(font), F.lit(False)), "monospace")
    return kind.otherwise("text")


# --- assembly and table acceptance -----------------------------------------


def assemble_document(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """One text per document: page marker and lines, then the tables.

    Lines and tables of a document meet once, in its row, where the lines, sorted by page,
    are cut into pages.
    """
    text = lines.select("doc_id", F.lit(0).alias("kind"), "page", "line_no", "text")
    drawn = tables.where("doc_id is not null").select(
        "doc_id", F.lit(1).alias("kind"), "page", F.lit(None).alias("line_no"), table_markdown("rows").alias("text"))
    documents = text.unionByName(drawn).groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("kind", "page", "line_no", "text"))).alias("_parts")).where(F.get("_parts", 0)["kind"] == 0)

    def texts(parts: Column) -> Column:
        return F.transform(parts, lambda p: p["text"])

    def pages(own: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | ~F.get(own, i)["page"].eqNullSafe(
            F.get(own, i - 1)["page"]))
        return once(firsts, lambda found: F.array_join(F.transform(found, lambda at, k: F.concat(
            F.lit("<!-- Page "), F.get(own, at)["page"].cast("string"), F.lit(" -->\n"), F.array_join(texts(
                F.slice(own, at + 1, F.coalesce(F.get(found, k + 1), F.size(own)) - at)), "\n"))), "\n\n"))

    def tail(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.concat(
            F.lit("\n\n## Detected Tables\n\n"), F.array_join(texts(found), "\n\n"))).otherwise("")

    return documents.select("doc_id", F.concat(
        once(F.filter("_parts", lambda p: p["kind"] == 0), pages),
        once(F.filter("_parts", lambda p: p["kind"] == 1), tail)).alias("markdown"))


def _looks_like_data(cell: Column) -> Column:
    digit = cell.rlike("[0-9]")
    unit = cell.rlike("[°VAµ]|Hz|pin")
    return (
        (cell.rlike(r"^[0-9.,\-+]+$") & digit)
        | (cell.rlike(r"^[0-9/\-]{4,10}$") & (F.regexp_count(cell, F.lit("[0-9]")) >= 4)
           & cell.rlike("[/-]"))
        | (cell.rlike(r"^[\p{L}\p{N}]+$") & (F.octet_length(cell) <= 10) & digit)
        | (digit & unit) | (cell.contains("(") & cell.contains(")") & digit)
        | (cell.rlike("°[CF]") & cell.contains("to")))


def table_quality(tables: DataFrame, small_font: bool = True) -> DataFrame:
    """Adds ``accepted`` and ``reason`` to tables with ``rows``.

    Tests in order: key-value layout, inconsistent columns, too little data,
    table of contents, paragraph text.
    """
    rows = F.col("rows")
    facts = tables.withColumns({
        "_cells": F.transform(F.flatten(rows), lambda c: F.trim(c)),
        "_data": F.filter(F.transform(F.flatten(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))),
                                      lambda c: F.trim(c)), lambda c: c != ""),
        "_fills": F.transform(rows, lambda r: F.size(F.filter(r, lambda c: c != ""))),
        "_firsts": F.transform(rows, lambda r: F.trim(F.get(r, 0))),
        "_n": F.size(rows), "_cols": F.size(F.get(rows, 0))})
    facts = facts.withColumns({
        "_filled": F.filter("_cells", lambda c: c != ""),
        "_mode": F.array_max(F.transform(F.array_distinct("_fills"), lambda v: F.struct(
            F.size(F.filter("_fills", lambda f: f == v)).alias("freq"), v.alias("count"))))["count"]})

    def share(array, test, total):
        return F.size(F.filter(array, test)) / F.nullif(total, F.lit(0))

    n, filled = F.col("_n"), F.size("_filled")
    label = share("_firsts", lambda f: f.endswith(":") | (
        (F.octet_length(f) > 3) & f.rlike(r"^[\p{Lu}\s()]+$")), n)
    key_value = (share("_fills", lambda f: f <= 2, n) > 0.7) & (label > 0.5) & (F.col("_cols") <= 6)
    steady = (n < 3) | (share("_fills", lambda f: F.abs(f - F.col("_mode")) <= 2, n) > 0.4)
    data = share("_data", _looks_like_data, F.size("_data"))
    enough = F.coalesce(data > (0.2 if small_font else 0.3), F.lit(False)) | (
        F.lit(small_font) & (F.col("_cols") >= 5) & (F.size("_data") > 0))
    dots = share("_filled", lambda c: (F.regexp_count(c, F.lit(r"\.")) >= 3) & (
        F.regexp_count(c, F.lit(r"\.")) > F.floor(F.octet_length(c) / 2)), filled)
    numbers = share("_filled", lambda c: F.regexp_replace(c, r"\s", "").rlike("^[0-9]{1,4}$"), filled)
    contents = (dots > 0.15) | ((dots > 0.05) & (numbers > 0.15))
    hyphens = share("_filled", lambda c: c.rlike(r"\p{L}-$"), filled)
    spaced = share("_filled", lambda c: (F.length(c) >= 9) & c.rlike(
        r"^(\p{L} )+\p{L}?$|^( \p{L})+ ?$"), filled)
    long_cells = share("_filled", lambda c: F.octet_length(c) > 60, filled)
    chars = F.aggregate("_filled", F.lit(0), lambda a, c: a + F.octet_length(c)) / F.nullif(filled, F.lit(0))
    empties = 1.0 - filled / F.nullif(n * F.col("_cols"), F.lit(0))
    prose = (filled >= 4) & (
        (hyphens > 0.03) | ((empties > 0.55) & (n > 10)) | (spaced > 0.08)
        | ((chars > 40.0) & (long_cells > 0.2)) | (long_cells > 0.3))
    reason = (
        F.when(key_value, "key-value layout").when(~steady, "inconsistent columns")
        .when(~enough, "too little data").when(F.coalesce(contents, F.lit(False)), "table of contents")
        .when(F.coalesce(prose, F.lit(False)), "paragraph text"))
    return facts.select(*tables.columns, reason.isNull().alias("accepted"), reason.alias("reason"))
